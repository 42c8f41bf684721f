"""Quality rules by host against a plain version."""

import re

import duckdb
import pytest
from oracle import compare, connect

from strata.llm import quality_rules
from strata.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return [len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(again)]


def hosted(spark, folder):
    """Two junk hosts, large and small, among good ones; a junk row on a good host, a good row on the junk hosts, and rows without a host."""
    good = " ".join(f"word{i}" for i in range(80))
    junk = " ".join(f"## word{i}" for i in range(80))
    again = "buy this now " * 60
    rows = [(n, good + f" end{n}", f"good{n % 5}") for n in range(200)]
    rows += [(1000 + n, junk + f" {n}", "junk") for n in range(80)] + [(1900, good, "junk"), (1901, good, "tiny"), (1902, junk, "tiny")]
    rows += [(2000 + n, again, "copies") for n in range(60)] + [(2900, good, "copies"), (2901, again, "good1"), (3000, good, None), (3001, "few", None)]
    rows += [(3002, None, "good1"), (3003, "", None), (None, good, "junk"), (1900, good, "junk"), (3004, "\n \r\n", "good2")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")


def test_query(spark):
    assert compare(QUERIES["op12_quality_rules"](spark, SF_DIR), connect(SF_DIR), ORACLES["op12_quality_rules"]) is None


def test_hosts_that_fail_take_their_documents_along(spark, tmp_path):
    hosted(spark, tmp_path)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(QUERIES["op12_quality_rules"](spark, str(tmp_path)), connection, ORACLES["op12_quality_rules"]) is None
    judged = quality_rules.judge(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    rows = {r.doc_id: r for r in judged if r.doc_id is not None}
    assert rows[1900].host_failed == ["symbols"] and not rows[1900].base_failed and not rows[1900].kept
    assert rows[2900].host_failed == ["repetition"] and not rows[2900].kept
    assert rows[5].kept and rows[3000].kept and rows[1901].host_failed == [] and rows[1901].kept  # one bad row of two is carried by the prior
    assert not rows[3001].kept and not rows[2901].kept and rows[2901].host_failed == []
    assert len(judged) == 352 and sum(r.doc_id == 1900 for r in judged) == 2


def test_shrinking(spark):
    columns = ", ".join(f"{r} long" for r in quality_rules.rules())
    hosts = spark.createDataFrame([(f"h{i}", 1000, 100 + i % 7, 0, 1000, 500 * (i % 2), i) for i in range(20)], f"host string, n long, {columns}")
    found = quality_rules.priors(hosts)
    assert found["few_words"][1] == quality_rules.WEIGHTS[1]  # rates no further apart than chance
    assert found["repetition"] == (0.0, quality_rules.WEIGHTS[1]) and found["symbols"] == (1.0, quality_rules.WEIGHTS[1])
    assert found["word_length"][0] == 0.25 and 1 <= found["word_length"][1] < 4
    assert quality_rules.priors(hosts.limit(0))["symbols"][0] == 0.0
    assert quality_rules.priors(hosts.limit(1))["word_length"][0] in (0.0, 0.5)


def test_counts_of_messy_rows(messy, nothing, spark):
    found = quality_rules.count_words(messy).collect()
    assert sorted((r.doc_id or -1, *[r[c] for c in quality_rules.COUNTS]) for r in found) == sorted((r.doc_id or -1, *plain_counts(r.text)) for r in messy.collect())
    judged = quality_rules.judge(messy)
    assert judged.count() == messy.count() and "items" in judged.columns and judged.columns.count("n_words") == 1
    assert quality_rules.judge(nothing).count() == 0


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b\na b\n\n a b\n", "x " * 7, "a b c d a b c", "#1 é😀 $", "a\x0bb\x0cc\rd e", "1 2 3 9 1 2 3 4 1 2"])
def test_counts(spark, text):
    row = quality_rules.count_words(spark.createDataFrame([(text,)], "text string")).first()
    assert list(row) == plain_counts(text)


def test_no_python_and_no_text_in_the_shuffle(spark):
    plan = quality_rules.count_words(spark.read.parquet(f"{SF_DIR}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and plan.count("regexp_extract_all(coalesce") == 1
