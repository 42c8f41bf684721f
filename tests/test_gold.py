"""Gold tables over increments: what is read equals a recomputation, whatever ran again."""

import pytest
from plans import scanned
from pyspark.sql import functions as F

from strata.sinks import gold, snapshots

MEASURES = {
    "n": ("count", "*"), "named": ("count", "x"), "total": ("sum", "cast(x as decimal(10, 2))"), "least": ("min", "x"),
    "most": ("max", "x"), "mean": ("avg", "x"), "ids": ("approx_distinct", "id"),
}
GOLD = gold.Gold(("day", "shop"), MEASURES)


def batch(spark, first, last):
    return spark.range(first, last, numPartitions=2).selectExpr(
        "id", "cast(id % 3 as int) as day", "if(id % 5 = 4, null, concat('s', id % 5)) as shop", "if(id % 7 = 0, null, cast(id as int)) as x"
    )


def plain(spark, df, by=("day", "shop")):
    return {
        tuple(r[b] for b in by): (r.n, r.named, r.total, r.least, r.most, r.mean, r.ids)
        for r in df.groupBy(*by).agg(
            *map(F.expr, (
                "count(*) as n", "count(x) as named", "sum(cast(x as decimal(10, 2))) as total", "min(x) as least", "max(x) as most", "avg(x) as mean",
                "count(distinct id) as ids",
            ))
        ).collect()
    }


def same(read, want, by=("day", "shop")):
    got = {tuple(r[b] for b in by): r for r in read.collect()}
    assert set(got) == set(want)
    for k, (*exact, mean, ids) in want.items():
        r = got[k]
        assert [r.n, r.named, r.total, r.least, r.most] == exact
        assert r.mean == pytest.approx(mean) and abs(r.ids - ids) <= 0.05 * ids


def test_batches_that_run_again(spark, tmp_path):
    path = str(tmp_path / "gold")
    for b in range(4):
        gold.put_batch(path, batch(spark, b * 100, b * 100 + 150), GOLD, f"b{b}")
    for b in range(4):
        gold.put_batch(path, batch(spark, b * 100, b * 100 + 100), GOLD, f"b{b}")
    want = plain(spark, batch(spark, 0, 400))
    same(gold.read_gold(spark, path, GOLD), want)
    assert gold.compact_gold(spark, path, GOLD) and len(snapshots.latest(spark, path).parts) == 1
    same(gold.read_gold(spark, path, GOLD), want)
    gold.put_batch(path, batch(spark, 1000, 1100), GOLD, "b1")  # its states lie in a folder with others
    rest = batch(spark, 0, 100).unionByName(batch(spark, 200, 400))
    want = plain(spark, rest.unionByName(batch(spark, 1000, 1100)))
    same(gold.read_gold(spark, path, GOLD), want)
    assert gold.drop_batches(spark, path, GOLD, ["b1", "none"])
    same(gold.read_gold(spark, path, GOLD), plain(spark, rest))
    same(gold.read_gold(spark, path, GOLD, ["day"]), plain(spark, rest, ("day",)), ("day",))
    same(gold.read_gold(spark, path, GOLD, []), plain(spark, rest, ()), ())
    assert {r.day for r in gold.read_gold(spark, path, GOLD, where="day = 2").collect()} == {2}


def test_only_states_are_read(spark, tmp_path):
    path = str(tmp_path / "gold")
    gold.put_batch(path, batch(spark, 0, 5000), GOLD, "a")
    gold.put_batch(path, batch(spark, 0, 0), GOLD, "empty")
    assert scanned(gold.read_gold(spark, path, GOLD)) == 15


@pytest.mark.parametrize("step", ["write_parts", "commit"])
def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "gold")
    gold.put_batch(path, batch(spark, 0, 90), GOLD, "a")
    with monkeypatch.context() as m:
        m.setattr(snapshots, step, lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            gold.put_batch(path, batch(spark, 0, 50), GOLD, "a")
    same(gold.read_gold(spark, path, GOLD), plain(spark, batch(spark, 0, 90)))
    gold.put_batch(path, batch(spark, 0, 50), GOLD, "a")
    same(gold.read_gold(spark, path, GOLD), plain(spark, batch(spark, 0, 50)))


def test_one_batch_by_two_writers_counts_once(spark, tmp_path, monkeypatch):
    path, commit = str(tmp_path / "gold"), snapshots.commit

    def late(*args, **kwargs):
        monkeypatch.setattr(snapshots, "commit", commit)
        gold.put_batch(path, batch(spark, 0, 70), GOLD, "a")
        return commit(*args, **kwargs)

    monkeypatch.setattr(snapshots, "commit", late)
    assert gold.put_batch(path, batch(spark, 0, 60), GOLD, "a") == 2
    same(gold.read_gold(spark, path, GOLD), plain(spark, batch(spark, 0, 60)))


def test_a_batch_during_a_compaction_stays(spark, tmp_path, monkeypatch):
    path, commit = str(tmp_path / "gold"), snapshots.commit
    for b in range(4):
        gold.put_batch(path, batch(spark, b * 10, b * 10 + 10), GOLD, f"b{b}")

    def late(*args, **kwargs):
        monkeypatch.setattr(snapshots, "commit", commit)
        gold.put_batch(path, batch(spark, 40, 60), GOLD, again)
        return commit(*args, **kwargs)

    for again, kept in (("b3", batch(spark, 0, 30).unionByName(batch(spark, 40, 60))), ("new", batch(spark, 0, 30).unionByName(batch(spark, 40, 60)).unionByName(batch(spark, 40, 60)))):
        monkeypatch.setattr(snapshots, "commit", late)
        assert gold.compact_gold(spark, path, GOLD) == (again == "new")
        got = gold.read_gold(spark, path, GOLD, []).first()
        assert got.n == kept.count()


def test_what_is_refused(spark, tmp_path):
    path = str(tmp_path / "gold")
    for by, measures in ((("day",), {}), (("day",), {"n": ("median", "x")}), (("n",), {"n": ("count", "*")}), (("a", "A"), {"n": ("count", "*")})):
        with pytest.raises(ValueError):
            gold.Gold(by, measures)
    gold.put_batch(path, batch(spark, 0, 9), GOLD, "a")
    with pytest.raises(gold.OtherMeasures):
        gold.put_batch(path, batch(spark, 0, 9), gold.Gold(("day",), MEASURES), "b")
    with pytest.raises(ValueError):
        gold.read_gold(spark, path, GOLD, ["x"])
