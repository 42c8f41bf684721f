import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation

from strata import schema as S
from strata.operators import clean, quality, relate

PEOPLE = [(1, "Alice", "2024-01-01T10:00:00"), (2, "Bob", "2024-01-02T11:00:00"), (None, "Eve", None)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "id int, name string, created_at string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_template_steps(people):
    schema = {"id": "int", "created_at": "datetime64[ns]"}
    df = clean.derive_date_parts(clean.cast_columns(clean.drop_missing(people, ["id"]), schema))
    quality.require_schema(df, schema)
    assert rows(df.select("id", "created_date", "created_year")) == [
        (1, datetime.date(2024, 1, 1), 2024),
        (2, datetime.date(2024, 1, 2), 2024),
    ]


def test_drop_missing_takes_nan_and_needs_its_columns(spark, people):
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert rows(clean.drop_missing(nan, ["x"])) == [(1.0,)]
    with pytest.raises(ValueError, match="absent"):
        clean.drop_missing(people, ["absent"])


def test_cast_strict_names_the_column(spark):
    df = spark.createDataFrame([("1",), (" 2 ",), ("abc",), (None,)], "id string")
    assert rows(clean.cast_columns(df, {"id": "int", "absent": "int"}, "lenient")) == [(1,), (2,), (None,), (None,)]
    with pytest.raises(PySparkException, match="column id: cannot read 'abc' as int"):
        clean.cast_columns(df, {"id": "int"}).collect()


def test_cast_keeps_nulls_in_integers(spark):
    df = clean.cast_columns(spark.createDataFrame([("7",), (None,)], "id string"), {"id": "integer"})
    assert df.schema["id"].dataType.simpleString() == "bigint"
    assert rows(df) == [(7,), (None,)]


def test_standardize_dates(spark):
    df = spark.createDataFrame([("2024-01-05",), ("01/06/2024",), ("07 Jan 2024",), ("x",), (None,)], "d string")
    formats = ["yyyy-MM-dd", "MM/dd/yyyy", "dd MMM yyyy"]
    got = [r[0] for r in clean.standardize_dates(df, ["d"], formats).collect()]
    assert got == ["2024-01-05", "2024-01-06", "2024-01-07", None, None]
    dates = clean.standardize_dates(df, ["d"], formats, as_text=False)
    assert dates.schema["d"].dataType.simpleString() == "date"


def test_drop_duplicates(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "a", 2), (2, "c", None)], "k int, v string, o int")
    assert len(rows(clean.drop_duplicates(df))) == 3
    assert rows(clean.drop_duplicates(df, ["k"], ["-v"]).select("k", "v")) == [(1, "b"), (2, "c")]
    # Ties are broken by the other columns.
    assert rows(clean.drop_duplicates(df, ["k"], ["o"]).select("k", "v")) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError, match="order_by"):
        clean.drop_duplicates(df, ["k"])


def test_drop_duplicates_of_maps_and_variants(spark):
    df = spark.sql(
        """select * from values (1, map('a', 1, 'b', 2), parse_json('{"x":1,"y":2}')),
        (1, map('b', 2, 'a', 1), parse_json('{"y":2,"x":1}')), (1, map('a', 1), parse_json('{"x":1}')) t(k, m, v)"""
    )
    out = clean.drop_duplicates(df)
    assert out.columns == ["k", "m", "v"] and out.count() == 2


def test_drop_duplicates_with_a_hot_key(spark):
    df = spark.range(20000).selectExpr("if(id % 3 = 0, 0, id) as k", "id as v")
    kept = clean.drop_duplicates(df, ["k"], ["-v"])
    assert kept.filter("k = 0").first()["v"] == 19998
    assert kept.count() == df.select("k").distinct().count()


def test_derive_columns_in_order(spark):
    df = spark.createDataFrame([(1, 4), (2, 5)], "a int, b int")
    assert rows(clean.derive_columns(df, {"c": "a + b", "d": "c + 1"})) == [(1, 4, 5, 6), (2, 5, 7, 8)]


def test_project_to_schema(people):
    schema = {"name": "str", "age": "int", "id": "int"}
    with pytest.raises(ValueError, match="age"):
        clean.project_to_schema(people, schema)
    df = clean.project_to_schema(people, schema, on_missing="null")
    assert df.columns == ["name", "age", "id"]
    assert {f.dataType.simpleString() for f in df.schema.fields} == {"string", "bigint"}


def test_type_names_and_mismatches(people):
    wanted = {"id": "str", "name": "int", "created_at": "datetime64[ns]", "gone": "bool", "other": "weird"}
    messages = [m[-1] for m in S.mismatches(people.schema, wanted)]
    assert messages == [
        "id: expected str, got int",
        "name: expected int, got string",
        "created_at: expected datetime64[ns], got string",
        "Missing column: gone",
        "Missing column: other",
    ]
    with pytest.raises(quality.SchemaMismatch) as e:
        quality.check_schema(people, wanted, raise_on_mismatch=True)
    assert len(e.value.messages) == 5
    assert quality.check_schema(people, {"id": "int"}).count() == 0


def test_profile(spark):
    df = spark.createDataFrame([("1", "true"), ("x", "maybe"), (None, None)], "a string, b string")
    got = {r["column"]: (r["nulls"], r["bad_values"], r["example"]) for r in quality.profile_schema(df, {"a": "int", "b": "bool", "c": "int"}).collect()}
    assert got == {"a": (1, 1, "x"), "b": (1, 1, "maybe"), "c": (3, 0, None)}


def test_enrich(spark):
    sales = spark.createDataFrame([(1,), (1,), (2,), (None,)], "product_id int")
    prices = spark.createDataFrame([(1, 9.5), (3, 1.0)], "product_id int, price double")
    seen = Observation("lookup")
    out = relate.enrich(sales, prices, "product_id", ["price"], matched="known", observation=seen)
    assert rows(out) == [(1, 9.5, True), (1, 9.5, True), (2, None, False), (None, None, False)]
    assert seen.get == {"rows": 4, "unmatched": 2}
    twice = spark.createDataFrame([(1, 9.5), (1, 9.0)], "product_id int, price double")
    with pytest.raises(relate.LookupNotUnique, match="'product_id': 1"):
        relate.enrich(sales, twice, "product_id", ["price"])


def test_gold(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "g string, x double")
    assert rows(relate.gold_aggregate(df, ["g"], {"n": "count(*)", "total": "sum(x)"})) == [("a", 2, 3.0), ("b", 1, 3.0)]
