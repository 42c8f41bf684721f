"""Listing and checking of files by executors."""

import gzip
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strata.sources import landing
from strata.sources.listing import check_files, fault, list_files


def lake(root):
    for k in range(6):
        folder = root / "layer=silver" / f"day={k % 3}" / f"part {k}=ä"
        folder.mkdir(parents=True, exist_ok=True)
        for name in ("a.json", "b.json", "_SUCCESS", ".a.json.crc"):
            (folder / name).write_text("x" * k)
    (root / "_temporary").mkdir()
    (root / "_temporary" / "c.json").write_text("c")
    (root / "top.json").write_text("top")


def test_listing_equals_the_file_index(spark, tmp_path):
    lake(tmp_path)
    columns = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select(*columns)
    got = list_files(spark, str(tmp_path))

    def rows(df):
        return sorted((r.path, r["size"], int(r.modified.timestamp())) for r in df.collect())

    assert rows(got.where("size > 0")) == rows(want)  # which passes over empty files
    assert got.count() == 13
    assert list_files(spark, f"{tmp_path}/layer=silver/day=[01]").count() == 8
    assert list_files(spark, f"{tmp_path}/top.json").count() == 1
    (tmp_path / "none").mkdir()
    assert list_files(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(FileNotFoundError):
        list_files(spark, f"{tmp_path}/absent")


def test_faults(tmp_path):
    def reason(name, data, fmt):
        (tmp_path / name).write_bytes(data)
        return fault(f"file:{tmp_path}/{name}", len(data), fmt)

    pq.write_table(pa.table({"a": [1, 2]}), tmp_path / "good.parquet")
    good = (tmp_path / "good.parquet").read_bytes()
    assert reason("1.parquet", good, "parquet") is None
    assert reason("2.parquet", b"", "parquet") == reason("3.parquet", b"PAR1", "parquet") == "too short for Parquet"
    assert reason("4.parquet", good[:-5], "parquet") == reason("5.parquet", b'{"id": 12345}', "parquet") == "not Parquet, or cut off"
    assert reason("6.parquet", good[:-8] + b"\xff\xff\xff\x7fPAR1", "parquet") == "footer longer than the file"
    broken = good[: -8 - 20] + b"\xee" * 20 + good[-8:]
    assert reason("7.parquet", broken, "parquet") is not None
    packed = gzip.compress(os.urandom(3_000_000).hex().encode())
    assert reason("1.json.gz", packed, "json") is reason("2.json.gz", packed + packed, "json") is reason("3.json.gz", b"", "json") is None
    assert reason("4.json.gz", packed[:-9], "json") == "gzip data cut off"
    assert "error" in reason("5.json.gz", b"not packed", "json")
    assert reason("1.json", b'{"a":1}', "json") is reason("2.json", b"", "json") is None
    assert reason("3.json", good, "json") == "Parquet, not json text"
    assert reason("4.csv", "a,b".encode("utf-16"), "csv") == "UTF-16, not csv text"
    assert "FileNotFoundError" in fault(f"file:{tmp_path}/absent.json", 3, "json")


def test_files_refused_are_told(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).withColumn("k", F.col("id") % 2).repartition(1).write.partitionBy("k").parquet(path)
    (tmp_path / "t" / "k=1" / "bad.parquet").write_text("no Parquet at all")
    rows, refused = landing.read_checked(spark, path, "parquet")
    assert sorted((r.id, r.k) for r in rows.collect()) == [(i, i % 2) for i in range(10)]
    assert [(r.path.rsplit("/", 2)[1:], r.reason) for r in refused.collect()] == [(["k=1", "bad.parquet"], "not Parquet, or cut off")]
    checked = check_files(list_files(spark, path), "parquet")
    assert checked.where("reason is null").count() == 2
    only = str(tmp_path / "t" / "k=1" / "bad.parquet")
    with pytest.raises(ValueError, match="no schema"):
        landing.read_checked(spark, only, "parquet")
    rows, refused = landing.read_checked(spark, only, "parquet", schema="id long")
    assert (rows.count(), refused.count()) == (0, 1)
