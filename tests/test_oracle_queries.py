"""Every registered query against its SQL."""

import os

import duckdb
import pytest
from oracle import compare, connect

import __spark_entry__ as entry_points
from strata.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["n_name", "created_year", "n_orders", "revenue"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    assert compare(QUERIES[name](spark, SF_DIR), connection, ORACLES[name]) is None


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """A folder of tables whose documents are beyond one prompt and must be cut: at lines, at sentences, anywhere."""
    folder = str(tmp_path_factory.mktemp("long"))
    texts = [
        "A sentence here. " * 3000, "word\n" * 9001, "x" * 45_000, "y" * 19_999 + ". " + "z" * 20_000, "é ü. " * 4001 + "\n" + "w" * 20_001,
        "short", "", "a" * 20_000, "b" * 20_001, "Dots.no.space" * 2000 + "\r\nend! " * 3000,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["build_prompts", "extract_records"])
def test_texts_beyond_one_prompt(spark, long_texts, name):
    view = f"CREATE VIEW documents AS SELECT * FROM '{long_texts}/documents.parquet/*.parquet'"
    connection = duckdb.connect()
    connection.execute(view)
    assert compare(QUERIES[name](spark, long_texts), connection, ORACLES[name]) is None
    assert QUERIES[name](spark, long_texts).count() > 20


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"promote", "run_manifest", "fetch_pages", "hive_roundtrip"}))
def test_no_all_pairs_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_costly_steps_run_once(spark):
    assert plan_of(QUERIES["scan_code"](spark, SF_DIR)).count("ArrowEvalPython") == 1
    assert plan_of(QUERIES["parse_json_logs"](spark, SF_DIR)).count("from_json") == 1
    assert plan_of(QUERIES["parse_replies"](spark, SF_DIR)).count("parseJson") == 1


def test_first_row_per_key_is_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["drop_duplicates_by_key"](spark, SF_DIR))
    assert "WindowGroupLimit" in plan.split("Exchange", 1)[1]


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["filter_rows"](spark, SF_DIR))
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThan(o_total" in plan
    assert "o_orderdate" not in plan.split("ReadSchema", 1)[1]
