import datetime
import glob
import json

import pytest
from plans import scanned
from pyspark.sql import Observation
from pyspark.sql import functions as F

from strata.operators.envelope import record_columns, unwrap_envelope
from strata.sinks import snapshots
from strata.sinks.layers import layer_path, new_batch_id, to_json_records, write_layer
from strata.sources import landing
from strata.streaming.promote import known_keys, new_rows, promote, store_keys

BODIES = [
    (1, '[{"id":1}]'),
    (2, '{"data":[{"id":2},{"id":3}],"results":[{"id":8}]}'),
    (3, '{"results":[{"id":4}]}'),
    (4, '{"id":5}'),
    (5, '{"data":7}'),
    (6, "3"),
    (7, "{bad"),
    (8, '{"recipes":[{"id":9}],"total":1}'),
    (9, None),
    (10, "[]"),
]


@pytest.mark.parametrize(
    "policy, key, want",
    [
        ("ingest", None, [(1, 1), (2, 2), (2, 3), (3, 4)]),
        ("transform", None, [(1, 1), (2, 2), (2, 3), (3, None), (4, 5), (6, None), (8, None)]),
        ("model", None, [(1, 1), (2, 8), (3, 4), (4, 5), (8, None)]),
        ("ingest", "recipes", [(1, 1), (8, 9)]),
    ],
)
def test_envelopes(spark, policy, key, want):
    df = spark.createDataFrame(BODIES, "n int, body string")
    out = record_columns(unwrap_envelope(df, "body", policy, key), {"id": "int"})
    assert sorted(((r.n, r.id) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_bodies_without_records_can_be_kept(spark):
    df = spark.createDataFrame(BODIES, "n int, body string")
    out = unwrap_envelope(df, "body", "ingest", keep_empty=True)
    assert {r.n: r.envelope for r in out.filter("record is null").collect()} == {
        **dict.fromkeys([4, 5, 6, 7, 8, 9], "unexpected"),
        10: "list",
    }


def test_bad_lines(spark):
    df = spark.createDataFrame([('{"id":1}',), ("{bad",), ('{"id":"x"}',), ("",), (None,)], "line string")
    good, bad = landing.split_bad_records(df, "line", "id int")
    assert [r.id for r in good.collect()] == [1]
    assert bad.count() == 4


def test_formats(spark, tmp_path):
    assert landing.format_of("a/b/page.XML") == "xml"
    assert landing.format_of("layer=landing/dataset=x") == "json"
    (tmp_path / "a.json").write_text('[{"id":1},\n{"id":2}]')
    assert sorted(r.id for r in landing.read_landing(spark, str(tmp_path / "a.json"), lines=False).collect()) == [1, 2]
    (tmp_path / "e.xml").write_text(
        "<feed><entry><id>1</id><title>One</title></entry><entry><id>2</id></entry></feed>"
    )
    xml = landing.read_landing(spark, str(tmp_path / "e.xml"), schema="id int, title string", row_tag="entry")
    assert sorted(map(tuple, xml.collect())) == [(1, "One"), (2, None)]
    with pytest.raises(ValueError, match="row_tag"):
        landing.read_landing(spark, str(tmp_path / "e.xml"))


def test_on_bad(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([('{"id":1}',), ('{"id":"x"}',)], "value string").write.text(path)
    skipped = Observation()
    assert [r.id for r in landing.read_landing(spark, path, "json", "id int", on_bad="skip", skipped=skipped).collect()] == [1]
    assert skipped.get == {"bad_records": 1}
    with pytest.raises(ValueError, match="an observation that counts"):
        landing.read_landing(spark, path, "json", "id int", on_bad="skip")
    good, bad = landing.split_corrupt(
        landing.read_landing(spark, path, "json", "id int", lines=True, on_bad="quarantine")
    )
    assert [r.id for r in good.collect()] == [1]
    assert [r["_corrupt_record"] for r in bad.select("id", "_corrupt_record").collect()] == ['{"id":"x"}']
    with pytest.raises(Exception):
        landing.read_landing(spark, path, "json", "id int", lines=True).collect()


def test_json_records_keep_nulls(spark):
    df = spark.sql("select 1 as a, cast(null as string) as b, timestamp_ntz '2024-01-01 10:00:00.5' as t")
    assert to_json_records(df).first().json == '{"a":1,"b":null,"t":"2024-01-01T10:00:00.500"}'


def test_write_layer_again_replaces_its_batch_only(spark, tmp_path):
    root, at = str(tmp_path), datetime.datetime(2026, 2, 15, 12)
    df = spark.range(10).withColumn("t", F.lit(None).cast("string"))
    for batch in ("20260215120000", "20260215120000", "20260215130000"):
        path = write_layer(df, root, "landing", "shop", "orders", at, batch)
    assert path == layer_path(root, "landing", "shop", "orders")
    assert spark.read.json(path).count() == 20
    found = glob.glob(f"{path}/year=2026/month=02/day=15/batch_id=*/*.json")
    assert len({f.split("batch_id=")[1].split("/")[0] for f in found}) == 2
    line = open(found[0]).readline()
    assert json.loads(line)["t"] is None
    assert new_batch_id(at) == "20260215120000"


def test_a_batch_that_lost_a_day(spark, tmp_path):
    days = spark.range(4).selectExpr("id", "make_date(2024, 1, cast(id as int) + 1) as d")
    root = str(tmp_path)
    write_layer(days, root, "silver", "s", "d", "d", "other")
    write_layer(days, root, "silver", "s", "d", "d", "mine")
    path = write_layer(days.filter("id < 3"), root, "silver", "s", "d", "d", "mine")
    count = {r.batch_id: r["count"] for r in spark.read.parquet(path).groupBy("batch_id").count().collect()}
    assert count == {"other": 4, "mine": 3}


def test_a_hot_day_is_written_by_many_tasks(spark, tmp_path):
    """One day holds everything; the rebalance splits it."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "100000")
    try:
        df = spark.range(100000).withColumn("t", F.sha2(F.col("id").cast("string"), 256)).repartition(8)
        path = write_layer(df, str(tmp_path), "silver", "s", "d", datetime.datetime(2026, 2, 15), "1")
    finally:
        spark.conf.unset(key)
    assert len(glob.glob(f"{path}/*/*/*/*/*.parquet")) > 4
    assert spark.read.parquet(path).count() == 100000


def test_partitions_are_pruned(spark, tmp_path):
    days = spark.range(6).selectExpr("id", "make_date(2024, 1, cast(id as int) + 1) as d")
    path = write_layer(days, str(tmp_path), "silver", "s", "d", "d", "1")
    df = spark.read.parquet(path).filter("day = 3")
    assert "PartitionFilters: [isnotnull(day" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1


def test_inventory(spark, tmp_path):
    at = datetime.datetime(2026, 2, 15)
    write_layer(spark.range(5), str(tmp_path), "silver", "shop", "orders", at, "1")
    write_layer(spark.range(5), str(tmp_path), "landing", "shop", "orders", at, "1")
    files = landing.inventory(spark, str(tmp_path))
    assert {(r.layer, r.year, r.month, r.day) for r in files.filter("path like '%part-%'").collect()} == {
        ("silver", "2026", "02", "15"),
        ("landing", "2026", "02", "15"),
    }
    stats = {r.layer: r for r in landing.inventory_stats(files).collect()}
    assert stats["silver"].days == 1 and stats["silver"].bytes > 0


def test_sample(spark):
    df = spark.createDataFrame([("b", "xxxxx"), ("a", "hello")], "path string, text string")
    assert landing.sample_text(df, "text", 3, per=[], order_by="path").collect() == [("a", "hel")]
    assert sorted(r.text for r in landing.sample_text(df, "text", 2).collect()) == ["he", "xx"]


def test_promote_reads_new_files_once(spark, tmp_path):
    root, checkpoint = str(tmp_path / "lake"), str(tmp_path / "checkpoint")

    def run():
        return promote(
            spark, root, "shop", "orders", lambda df: df.filter("id is not null"), checkpoint, "day_at",
            "id bigint, v string, day_at date", keys=["id"], order_by=["v"],
        )

    def land(values, batch):
        df = spark.createDataFrame(values, "id bigint, v string, day_at date")
        write_layer(df, root, "landing", "shop", "orders", datetime.datetime(2024, 1, 1), batch)

    day = datetime.date(2024, 1, 1)
    land([(1, "b", day), (1, "a", day), (2, "c", day), (None, "x", day)], "1")
    path = run()
    run()
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    land([(2, "z", day), (3, "d", datetime.date(2024, 1, 2))], "2")
    run()
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_rows_without_a_time_survive_a_second_write(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, timestamp_ntz '2024-01-01 00:00:00' AS ts UNION ALL SELECT 2, null")
    for _ in range(2):
        path = write_layer(df, str(tmp_path), "silver", "s", "d", "ts", "20240101000000")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    write_layer(df.filter("id = 1"), str(tmp_path), "silver", "s", "d", "ts", "20240101000000")
    assert [r.id for r in spark.read.parquet(path).collect()] == [1]


@pytest.mark.parametrize("name", ["year", "Month", "batch_id"])
def test_columns_named_like_levels_are_refused(spark, tmp_path, name):
    df = spark.range(1).withColumn(name, F.lit(1995))
    with pytest.raises(ValueError, match="named like levels"):
        write_layer(df, str(tmp_path), "gold", "s", "d", datetime.datetime(2024, 1, 1), "20240101000000")


def land(spark, root, name, *keys):
    folder = tmp = root / "layer=landing" / "source=s" / "dataset=d"
    folder.mkdir(parents=True, exist_ok=True)
    (tmp / f"{name}.json").write_text("".join(json.dumps({"k": k, "v": name}) + "\n" for k in keys))


def run_promote(spark, root, checkpoint, **options):
    def steps(df):
        return df.filter("k > 0").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))

    return promote(spark, str(root), "s", "d", steps, str(root / checkpoint), "ts", "k int, v string", keys=["k"], order_by=["v"], **options)


def test_a_first_micro_batch_without_rows(spark, tmp_path):
    land(spark, tmp_path, "a", -1)
    path = run_promote(spark, tmp_path, "c")
    land(spark, tmp_path, "b", 1, 2)
    assert run_promote(spark, tmp_path, "c") == path
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2]


def test_a_new_checkpoint_replaces_nothing(spark, tmp_path):
    land(spark, tmp_path, "a", 1)
    path = run_promote(spark, tmp_path, "c")
    (tmp_path / "layer=landing" / "source=s" / "dataset=d" / "a.json").write_text('{"k": 9, "v": "x"}\n{"k": 1, "v": "y"}\n')
    run_promote(spark, tmp_path, "other")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (9, "x")]


def test_a_micro_batch_reads_the_ledger_and_not_the_table(spark, tmp_path):
    land(spark, tmp_path, "a", 1, 2)
    path = run_promote(spark, tmp_path, "c")
    for f in glob.glob(f"{path}/**/*.parquet", recursive=True):
        with open(f, "r+b") as broken:
            broken.write(b"no longer parquet")
    land(spark, tmp_path, "b", 2, 3)
    run_promote(spark, tmp_path, "c")
    (new,) = (tmp_path / "layer=silver" / "source=s" / "dataset=d").glob("**/batch_id=00000000000001-*")
    assert [r.k for r in spark.read.parquet(str(new)).collect()] == [3]


def test_a_table_from_before_the_ledger(spark, tmp_path):
    land(spark, tmp_path, "a", 1, 2)
    path = run_promote(spark, tmp_path, "c")
    (tmp_path / "layer=silver" / "source=s" / "dataset=d_keys").rename(tmp_path / "aside")
    land(spark, tmp_path, "b", 2, 3)
    run_promote(spark, tmp_path, "c")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "a"), (3, "b")]


def test_a_small_micro_batch_reads_a_small_share_of_the_ledger(spark, tmp_path):
    """10,000 keys against 2,000,000: nearly all are new, so hardly any row group is read."""
    ledger = str(tmp_path / "keys")
    for k in range(4):
        store_keys(spark.range(500_000 * k, 500_000 * (k + 1)).withColumnRenamed("id", "k").repartition(4), ledger, ["k"], f"{k:014d}-abc", fan=100)
    batch = spark.range(1_999_998, 2_009_998).withColumnRenamed("id", "k")
    known = known_keys(batch, ledger, ["k"], "00000000000009-abc")
    assert scanned(known) < 600_000
    assert sorted(r.k for r in new_rows(batch, known_keys(batch, ledger, ["k"], "00000000000009-abc"), ["k"]).collect()) == list(range(2_000_000, 2_009_998))
    joined = known_keys(batch, ledger, ["k"], "00000000000009-abc", look_up=100)
    assert new_rows(batch, joined, ["k"]).count() == 9_998
    own = known_keys(batch, ledger, ["k"], "00000000000003-abc")
    assert new_rows(batch, own, ["k"]).count() == 10_000  # a repeated batch is not compared with its first attempt


def test_the_ledger_is_merged_and_repeated_batches_replace_theirs(spark, tmp_path):
    ledger = str(tmp_path / "keys")
    keys = lambda a, b: spark.range(a, b).withColumnRenamed("id", "k")
    for n in range(11):
        store_keys(keys(10 * n, 10 * n + 10), ledger, ["k"], f"{n:014d}-abc")
    parts = snapshots.latest(spark, ledger).parts
    assert len(parts) <= 5 and [p.tags["batch"] for p in parts if p.tags["batch"]][-1] == "00000000000010-abc"
    store_keys(keys(100, 105), ledger, ["k"], "00000000000010-abc")
    rows = snapshots.read_parts(spark, ledger, snapshots.latest(spark, ledger))
    assert sorted(r.k for r in rows.collect()) == list(range(105))
    store_keys(keys(0, 0), ledger, ["k"], "00000000000011-abc")
    assert known_keys(keys(0, 3), ledger, ["k"], "x").count() == 3 and known_keys(keys(0, 0), ledger, ["k"], "x").count() == 0
