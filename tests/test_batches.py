"""Batches that are seen whole or not at all."""

import datetime

import pytest
from pyspark.sql import functions as F

from strata.files import exists
from strata.sinks import layers
from strata.sinks.layers import complete_batches, write_batch
from strata.sources.landing import read_batches

DAYS = [datetime.datetime(2024, 3, d) for d in (1, 2, 3)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, at timestamp_ntz")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_complete_batches_only(spark, tmp_path):
    path = str(tmp_path / "t")
    write_batch(frame(spark, [(1, DAYS[0]), (2, DAYS[1]), (3, None)]), path, "at", "b1")
    write_batch(frame(spark, [(4, DAYS[1])]), path, "at", "b2")
    assert ids(read_batches(spark, path)) == ids(spark.read.parquet(path)) == [1, 2, 3, 4]
    assert ids(read_batches(spark, path, batches=["b2"])) == [4]
    assert {b: len(f) for b, f in complete_batches(spark, path).items()} == {"b1": 3, "b2": 1}
    with pytest.raises(ValueError, match="b9"):
        read_batches(spark, path, batches=["b2", "b9"])
    write_batch(frame(spark, []), path, "at", "b1")
    assert ids(read_batches(spark, path)) == ids(spark.read.parquet(path)) == [4]
    assert complete_batches(spark, path)["b1"] == []


@pytest.mark.parametrize("dies_at", ["write", "removal", "record"])
def test_a_run_that_dies_is_not_seen_and_heals(spark, tmp_path, monkeypatch, dies_at):
    path = str(tmp_path / "t")
    write_batch(frame(spark, [(1, DAYS[0]), (2, DAYS[1])]), path, "at", "b1")
    write_batch(frame(spark, [(9, DAYS[2])]), path, "at", "b2")
    again = frame(spark, [(5, DAYS[1])])

    def dead(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises((KeyboardInterrupt, Exception)):
        if dies_at == "removal":
            real = layers.remove_folder
            m.setattr(layers, "remove_folder", lambda s, p: real(s, p) if p.endswith(".json") else dead())
        if dies_at == "record":
            m.setattr(layers, "write_new", dead)
        bad = again.withColumn("id", F.raise_error(F.lit("lost")).cast("int")) if dies_at == "write" else again
        write_batch(bad, path, "at", "b1")
    assert ids(read_batches(spark, path)) == [9]
    write_batch(again, path, "at", "b1")
    assert ids(read_batches(spark, path)) == ids(spark.read.parquet(path)) == [5, 9]
    assert exists(spark, f"{path}/_batches/b1.json")


def test_no_batch_yet(spark, tmp_path):
    assert read_batches(spark, str(tmp_path), schema="id int").count() == 0
    with pytest.raises(ValueError, match="no complete batch"):
        read_batches(spark, str(tmp_path))
