"""Runs of growing sources: each record lands once."""

import json

import pytest
from pyspark.sql import functions as F

from strata.sinks import snapshots
from strata.sources import progress
from strata.sources.paged import FileFetcher
from strata.sources.requests import plan_requests

SIZE = 3


def dump(tmp_path, **counts):
    """Sources of so many items in pages of SIZE."""
    for source, n in counts.items():
        (tmp_path / f"source={source}").mkdir(exist_ok=True)
        for page in range(0, n, SIZE):
            items = [{"id": i} for i in range(page, min(n, page + SIZE))]
            (tmp_path / f"source={source}" / f"page={page // SIZE + 1}.json").write_text(json.dumps(items))


class Lake:
    def __init__(self):
        self.runs, self.asked = {}, []

    def land(self, records, run):
        self.runs[run] = sorted((r.source_id, r.page, json.loads(r.j)["id"]) for r in records.select("source_id", "page", F.to_json("record").alias("j")).collect())

    def all(self):
        return sorted((s, i) for rows in self.runs.values() for s, _, i in rows)


def run(spark, tmp_path, lake, names, **columns):
    sources = spark.createDataFrame([(n,) for n in names], "source_id string").withColumns({"type": F.lit("page")} | {k: F.lit(v) for k, v in columns.items()})
    return progress.ingest_new(sources, FileFetcher(f"file://{tmp_path}/dump"), str(tmp_path / "progress"), lake.land, pause=0)


@pytest.fixture
def where(tmp_path):
    (tmp_path / "dump").mkdir()
    return tmp_path


def test_each_record_lands_once(spark, where):
    lake = Lake()
    dump(where / "dump", a=7, b=3, still=4, none=0)
    assert run(spark, where, lake, ["a", "b", "still"]) == 1
    dump(where / "dump", a=20, b=4, late=2)
    assert run(spark, where, lake, ["a", "b", "still", "late"]) == 2
    assert lake.all() == sorted([("a", i) for i in range(20)] + [("b", i) for i in range(4)] + [("still", i) for i in range(4)] + [("late", i) for i in range(2)])
    assert ("a", 3, 7) in lake.runs["000000000002"] and ("a", 7, 19) in lake.runs["000000000002"] and ("b", 2, 3) in lake.runs["000000000002"]
    assert run(spark, where, lake, ["a"]) == 3 and lake.runs["000000000003"] == []  # nothing new
    kept = {r.source_id: (r.page, r.items) for r in progress.read_progress(spark, str(where / "progress")).collect()}
    assert kept == {"a": (7, 2), "b": (2, 1), "still": (2, 1), "late": (1, 2)}


def test_a_run_that_dies_is_repeated_under_its_number(spark, where, monkeypatch):
    lake = Lake()
    dump(where / "dump", a=5)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            run(spark, where, lake, ["a"])
    dump(where / "dump", a=8)
    assert run(spark, where, lake, ["a"]) == 1 and lake.all() == [("a", i) for i in range(8)]


def test_two_runs_at_once(spark, where, monkeypatch):
    lake, write = Lake(), snapshots.write_parts
    dump(where / "dump", a=5)

    def late(*args, **kwargs):
        monkeypatch.setattr(snapshots, "write_parts", write)
        run(spark, where, lake, ["a"])
        return write(*args, **kwargs)

    monkeypatch.setattr(snapshots, "write_parts", late)
    with pytest.raises(progress.ProgressMoved):
        run(spark, where, lake, ["a"])
    assert lake.all() == [("a", i) for i in range(5)]


def test_a_page_that_changed_is_refused(spark, where):
    lake = Lake()
    dump(where / "dump", a=5)
    run(spark, where, lake, ["a"])
    (where / "dump" / "source=a" / "page=2.json").write_text('[{"id": 99}, {"id": 4}, {"id": 5}]')
    with pytest.raises(ValueError, match="page 2 of source a"):
        run(spark, where, lake, ["a"])
    (where / "dump" / "source=a" / "page=2.json").write_text('[{"id": 3}]')
    with pytest.raises(ValueError, match="page 2 of source a"):
        run(spark, where, lake, ["a"])
    assert len(lake.runs) == 1


def test_requests_after_the_pages_done(spark):
    sources = spark.createDataFrame(
        [("o", "offset", "skip", 10, 45, None, 2), ("p", "page", None, 10, None, 3, 2), ("q", "page", None, 10, None, 2, 5), ("r", "page", None, 10, None, None, 7)],
        "source_id string, type string, offset_param string, limit_value int, max_items bigint, max_pages int, done_pages bigint",
    )
    got = [(r.source_id, r.seq, r.last, r.params.get("skip") or r.params.get("page")) for r in plan_requests(sources, 1, 2).orderBy("source_id", "seq").collect()]
    assert got == [("o", 1, 3, "20"), ("o", 2, 3, "30"), ("o", 3, 3, "40"), ("p", 1, 1, "3"), ("r", 1, None, "8"), ("r", 2, None, "9")]


def test_pages_are_stitched_once(spark, where):
    dump(where / "dump", a=7)
    lake, plans = Lake(), []

    def land(records, number):
        plans.append(records._jdf.queryExecution().optimizedPlan().toString())
        Lake.land(lake, records, number)

    lake.land = land
    run(spark, where, lake, ["a"])
    dump(where / "dump", a=8)
    run(spark, where, lake, ["a"])
    assert lake.all() == [("a", i) for i in range(8)]
    assert not any("Window" in plan or "Join" in plan for plan in plans)
