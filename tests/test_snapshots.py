"""Versioned tables, and the cache table on them."""

import datetime
import json
import threading

import pytest
from plans import scanned
from pyspark.sql import functions as F

from strata.files import write_new
from strata.operators import reuse
from strata.sinks import snapshots


def entries(spark, first, last, payload, day=1):
    return spark.range(first, last).selectExpr("cast(id as string) as key", f"'{payload}' as payload", f"timestamp_ntz '2024-01-{day:02d} 00:00:00' as cached_at")


def payloads(spark, path):
    return {r.key: r.payload for r in reuse.read_cache(spark, path).collect()}


def test_entries_stored_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    for day in (1, 2):
        reuse.upsert_cache(path, entries(spark, 0, 20, f"d{day}", day))
    write, before = snapshots.write_parts, reuse.read_cache(spark, path)

    def late(*args, **kwargs):
        found = write(*args, **kwargs)
        monkeypatch.setattr(snapshots, "write_parts", write)
        reuse.upsert_cache(path, entries(spark, 15, 25, "late", 3))
        return found

    monkeypatch.setattr(snapshots, "write_parts", late)
    assert reuse.compact_cache(spark, path)
    assert payloads(spark, path) == {str(i): "late" if i >= 15 else "d2" for i in range(25)}
    assert reuse.cache_entries(spark, path).count() == 30
    assert {r.payload for r in before.collect()} == {"d2"} and before.count() == 20  # a reader keeps its version


def test_two_compactions_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    reuse.upsert_cache(path, entries(spark, 0, 9, "a"))
    reuse.upsert_cache(path, entries(spark, 0, 9, "b", 2))
    write = snapshots.write_parts

    def other(*args, **kwargs):
        monkeypatch.setattr(snapshots, "write_parts", write)
        assert reuse.compact_cache(spark, path)
        return write(*args, **kwargs)

    monkeypatch.setattr(snapshots, "write_parts", other)
    assert not reuse.compact_cache(spark, path)
    assert payloads(spark, path) == {str(i): "b" for i in range(9)} and reuse.cache_entries(spark, path).count() == 9


@pytest.mark.parametrize("step", ["write_parts", "commit"])
def test_a_crash_leaves_a_readable_table(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "cache")
    reuse.upsert_cache(path, entries(spark, 0, 9, "a"))
    want, real = payloads(spark, path), getattr(snapshots, step)

    def dies(*args, **kwargs):
        if step == "write_parts":
            real(*args, **kwargs)
        raise RuntimeError("lost")

    monkeypatch.setattr(snapshots, step, dies)
    for work in (lambda: reuse.compact_cache(spark, path), lambda: reuse.upsert_cache(path, entries(spark, 0, 9, "b", 2))):
        with pytest.raises(RuntimeError, match="lost"):
            work()
        assert payloads(spark, path) == want
    monkeypatch.undo()
    reuse.upsert_cache(path, entries(spark, 0, 9, "b", 2))
    assert set(payloads(spark, path).values()) == {"b"}
    assert reuse.vacuum_cache(spark, path) == 0  # nothing is old enough
    assert reuse.vacuum_cache(spark, path, datetime.timedelta(seconds=-60)) == 2
    assert set(payloads(spark, path).values()) == {"b"} and reuse.cache_entries(spark, path).count() == 18


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    parts = [snapshots.write_parts(spark.range(10 * k, 10 * k + 10), path) for k in range(6)]
    work = [threading.Thread(target=lambda own=own: snapshots.commit(spark, path, own, schema=spark.range(1).schema)) for own in parts]
    for t in work:
        t.start()
    for t in work:
        t.join()
    found = snapshots.latest(spark, path)
    assert found.version == 6 and sorted(r.id for r in snapshots.read_parts(spark, path, found).collect()) == list(range(60))


def test_a_version_is_written_once(spark, tmp_path):
    name = str(tmp_path / "v1.json")
    assert write_new(spark, name, "one") and not write_new(spark, name, "two")
    assert open(name).read() == "one" and len([f for f in tmp_path.iterdir() if not f.name.endswith(".crc")]) == 1


def test_merging_by_size(spark, tmp_path):
    mb = 1 << 20
    part = lambda k, size: snapshots.Part(f"f{k}", size)
    small, large = [part(k, mb // 2) for k in range(5)], [part(10 + k, 20 * mb) for k in range(3)]
    assert snapshots.tiers([*small, *large]) == [small] and snapshots.tiers(small[:3] + large) == []
    path = str(tmp_path / "cache")
    for k in range(9):
        reuse.upsert_cache(path, entries(spark, k, k + 3, f"p{k}", k + 1))
        reuse.compact_cache(spark, path, fan=4)
        assert len(snapshots.latest(spark, path).parts) <= 4
    assert payloads(spark, path) == {str(i): f"p{min(i, 8)}" for i in range(11)}
    assert reuse.compact_cache(spark, str(tmp_path / "cache2")) and reuse.drop_expired(spark, str(tmp_path / "cache2"), datetime.datetime(2030, 1, 1)) == 0


def test_columns_and_empty_stores(spark, tmp_path):
    path = str(tmp_path / "cache")
    reuse.upsert_cache(path, entries(spark, 0, 0, "a"))
    assert reuse.read_cache(spark, path).count() == 0
    reuse.upsert_cache(path, entries(spark, 0, 2, "a").withColumn("more", F.lit(1)))
    reuse.upsert_cache(path, entries(spark, 2, 4, "a").withColumn("cached_at", F.lit(None).cast("timestamp_ntz")))
    assert sorted((r.key, r.more) for r in reuse.read_cache(spark, path).collect()) == [("0", 1), ("1", 1), ("2", None), ("3", None)]
    with pytest.raises(ValueError, match="payload is string, not int"):
        reuse.upsert_cache(path, entries(spark, 0, 2, "a").withColumn("payload", F.lit(1)))
    with pytest.raises(FileNotFoundError):
        reuse.read_cache(spark, str(tmp_path / "none"))


def test_a_look_up_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.range(200_000).selectExpr("sha2(string(id), 256) as key", "repeat(sha2(string(id + 1), 256), 4) as payload", "timestamp_ntz '2024-01-01 00:00:00' as cached_at")
    spark.conf.set("parquet.block.size", str(4 << 20))
    try:
        for k in range(3):
            reuse.upsert_cache(path, rows.filter(f"id % 3 = {k}") if "id" in rows.columns else rows.filter(F.pmod(F.crc32("key"), F.lit(3)) == k))
    finally:
        spark.conf.unset("parquet.block.size")
    key = rows.first().key
    assert reuse.lookup_cache(spark, path, [key, "none"]).count() == 1
    assert scanned(reuse.lookup_cache(spark, path, [key])) < 30_000 and scanned(reuse.lookup_cache(spark, path, ["0" * 64])) < 30_000
    versions = sorted(tmp_path.glob("cache/_versions/*.json"))
    assert len(json.loads(versions[-1].read_text())["parts"]) == 3
