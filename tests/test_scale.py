"""Plans and hot keys: one key holds a third of the rows or more."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from strata.operators import clean, relate, reuse
from strata.operators.pages import stitch_pages
from strata.streaming.promote import new_rows


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def large(spark):
    """As if everything were too large to broadcast, and 20 kB a large partition."""
    return settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold=-1,
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes=20000,
        spark__sql__adaptive__skewJoin__skewedPartitionFactor=2,
        spark__sql__adaptive__advisoryPartitionSizeInBytes=20000,
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )


def run(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    return spark.range(120000).selectExpr("if(id % 3 = 0, 7, id) as key", "id as n", "sha2(string(id), 256) as filler").repartition(8)


def test_enrich_splits_a_hot_key(spark, hot):
    lookup = spark.range(120000).selectExpr("id as key", "id * 2 as twice")
    with large(spark):
        rows, plan = run(relate.enrich(hot, lookup, "key", ["twice"]))
    assert "skew=true" in plan
    assert len(rows) == 120000 and all(r.twice == r.key * 2 for r in rows)


def test_cache_lookups_split_a_hot_key(spark, hot):
    cache = spark.range(60000).selectExpr("id as key", "string(id) as payload", "timestamp_ntz '2024-01-01 00:00:00' as cached_at")
    with large(spark):
        hits, misses = reuse.split_cached(hot, cache, "2024-01-02 00:00:00")
        hit_rows, hit_plan = run(hits)
        miss_rows, _ = run(misses)
    assert "skew=true" in hit_plan
    assert len(hit_rows) + len(miss_rows) == 120000 and {r.key < 60000 for r in miss_rows} == {False}


def test_a_small_lookup_is_broadcast(spark, hot):
    lookup = spark.range(100).selectExpr("id as key", "id * 2 as twice")
    _, plan = run(relate.enrich(hot, lookup, "key", ["twice"]).agg(F.count("twice")))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_keep_first_sends_one_row_per_key_and_task(spark, hot):
    df = clean.drop_duplicates(hot, ["key"], ["-n"])
    rows, plan = run(df)
    below = plan.split("Exchange hashpartitioning(key", 1)[1]
    assert "WindowGroupLimit" in below
    assert {r.key: r.n for r in rows}[7] == 119997


def test_the_store_orders_no_hot_group(spark, hot):
    entries = hot.selectExpr("key", "filler as payload", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, n) as cached_at")
    rows, plan = run(reuse.store_cached(entries.limit(0), entries))
    assert "WindowGroupLimit" in plan and len(rows) == len({r.key for r in rows}) == 80000


def test_page_windows_see_counts_only(spark):
    body = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda x: x.cast("string")), ","), F.lit("]"))
    pages = spark.range(3000).selectExpr("if(id < 1000, 'hot', concat('s', id % 200)) as source", "id as n").withColumn(
        "page", F.when(F.col("source") == "hot", F.col("n") + 1).otherwise(F.floor((F.col("n") - 1000) / 200) + 1)
    ).withColumn("body", body)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=-1):
        df = stitch_pages(pages.select("source", "page", "body"))
        rows, plan = run(df.groupBy("source").agg(F.count("*").alias("n"), F.max("item").alias("last"), F.min("complete").alias("whole")))
    got = {r.source: (r.n, r.last, r.whole) for r in rows}
    assert got["hot"] == (20000, 19999, True) and set(got.values()) == {(20000, 19999, True), (200, 199, True)}
    window = plan.split("Window", 1)[1].split("Exchange", 2)[1]
    assert "body" not in window.split("\n", 1)[0]


def test_new_rows_do_not_shuffle_the_large_table(spark):
    batch = spark.range(100).selectExpr("id as key", "id as v")
    silver = spark.range(50, 400000).selectExpr("id as key", "sha2(string(id), 256) as filler")
    rows, plan = run(new_rows(batch, silver, ["key"]))
    assert sorted(r.key for r in rows) == list(range(50))
    assert plan.split("== Initial Plan ==")[0].count("BroadcastHashJoin") == 2
