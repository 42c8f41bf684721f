"""Gold tables over increments: each batch leaves partial states of its measures, and reading merges them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.clean import need_columns
from strata.sinks import snapshots

BATCH = "_batch"
#: For each kind of measure its states: suffix, how a batch makes it from the rows, how two are merged.
STATES = {
    "count": [("n", F.count, F.sum)],
    "sum": [("s", F.sum, F.sum)],
    "min": [("m", F.min, F.min)],
    "max": [("m", F.max, F.max)],
    "avg": [("s", F.sum, F.sum), ("n", F.count, F.sum)],
    "approx_distinct": [("k", F.hll_sketch_agg, F.hll_union_agg)],
}


class OtherMeasures(ValueError):
    """The table holds states of other groups or measures than those given."""


@dataclass(frozen=True)
class Gold:
    """What a gold table holds: groups, and measures as `{"revenue": ("sum", "amount")}`, each a kind and an expression.

    Kinds: count (rows where the expression is not null; `*` for all), sum, min, max, avg (sum by count) and
    approx_distinct (a sketch, relative error about 1.6 %). Sums keep the type that the first sum has.
    """

    by: tuple[str, ...]
    measures: Mapping[str, tuple[str, str]]

    def __post_init__(self):
        if not self.measures:
            raise ValueError("a gold table needs at least one measure")
        for name, (kind, _) in self.measures.items():
            if kind not in STATES:
                raise ValueError(f"measure {name}: {kind} is none of {', '.join(STATES)}")
        named = [*self.by, *self.measures, *(n for n, *_ in self._states()), BATCH]
        if len({n.lower() for n in named}) < len(named):
            raise ValueError(f"names of groups and measures clash: {named}")

    def _states(self):
        for name, (kind, text) in self.measures.items():
            for suffix, make, merge in STATES[kind]:
                yield f"{name}__{suffix}", "1" if kind == "count" and text.strip() == "*" else text, make, merge

    def partial(self, df: DataFrame) -> DataFrame:
        """One row of states for each group; partially aggregated before the shuffle."""
        return df.groupBy(*self.by).agg(*[make(F.expr(text)).alias(n) for n, text, make, _ in self._states()])

    def merged(self, states: DataFrame, by: Sequence[str]) -> DataFrame:
        """States of coarser groups from those of finer ones, in the types they had."""
        kinds = {f.name: f.dataType for f in states.schema.fields}
        return states.groupBy(*by).agg(*[merge(F.col(n)).cast(kinds[n]).alias(n) for n, *_, merge in self._states()])

    def final(self, name: str) -> Column:
        kind = self.measures[name][0]
        if kind == "avg":
            return F.try_divide(F.col(f"{name}__s"), F.col(f"{name}__n"))
        state = F.col(f"{name}__{STATES[kind][0][0]}")
        if kind == "approx_distinct":
            return F.coalesce(F.hll_sketch_estimate(state), F.lit(0).cast("bigint"))
        return F.coalesce(state, F.lit(0).cast("bigint")) if kind == "count" else state

    def told(self) -> str:
        return json.dumps({"by": list(self.by), "measures": {n: list(m) for n, m in self.measures.items()}})


def _batches(part: snapshots.Part) -> set[str]:
    return set(json.loads(part.tags["batches"]))


def _latest(spark: SparkSession, path: str, gold: Gold) -> snapshots.Snapshot:
    found = snapshots.latest(spark, path)
    for part in found.parts:
        if part.tags["gold"] != gold.told():
            raise OtherMeasures(f"{path} holds {part.tags['gold']}, not {gold.told()}")
    return found


def _write(states: DataFrame, path: str, gold: Gold, batches: set[str]) -> snapshots.Part:
    tags = {"batches": json.dumps(sorted(batches)), "gold": gold.told()}
    spread = states.hint("rebalance")
    (part,) = snapshots.write_parts(spread.sortWithinPartitions(*gold.by) if gold.by else spread, path, tags=tags)
    return part


def put_batch(path: str, df: DataFrame, gold: Gold, batch_id: str) -> int:
    """Add the states of one batch of rows to the table at `path`; a batch that is there already is replaced.

    The batch is aggregated once. Other batches are not read, unless the old states of this one were merged into a folder with
    others (`compact_gold`): then that folder is rewritten without them. The new version has the new states and
    lacks the old ones, in one step; a run that dies before changes nothing, and an empty batch leaves no states.
    Returns the number of the version.
    """
    need_columns(df, gold.by)
    spark = df.sparkSession
    states = gold.partial(df).withColumn(BATCH, F.lit(batch_id))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in states.schema.fields])
    snapshots.joint_schema(_latest(spark, path, gold).schema, schema)
    new = _write(states, path, gold, {batch_id})
    while True:
        found = _latest(spark, path, gold)
        old = [p for p in found.parts if batch_id in _batches(p)]
        others = set().union(*map(_batches, old)) - {batch_id}
        add = [new]
        if others:
            shared = [p for p in old if _batches(p) != {batch_id}]
            add.append(_write(snapshots.read_parts(spark, path, found, shared).filter(F.col(BATCH) != batch_id), path, gold, others))
        # Only on the version that was looked at: another writer of the same batch would count it twice.
        done = snapshots.commit(spark, path, add, old, schema, on=found.version)
        if done is not None:
            return done.version


def compact_gold(spark: SparkSession, path: str, gold: Gold, fan: int = snapshots.FAN) -> bool:
    """Merge folders of like size, where there are `fan` of them; states keep their batch, so each can still be replaced.

    False if another writer replaced one of the folders meanwhile; then nothing changes.
    """
    found = _latest(spark, path, gold)
    for group in snapshots.tiers(found.parts, fan):
        part = _write(snapshots.read_parts(spark, path, found, group), path, gold, set().union(*map(_batches, group)))
        if snapshots.commit(spark, path, [part], group) is None:
            return False
    return True


def read_gold(spark: SparkSession, path: str, gold: Gold, by: Sequence[str] | None = None, where: str | Column | None = None) -> DataFrame:
    """The measures of each group, over all batches of the latest version; `by` names some of the groups for coarser ones.

    `where` is a condition on groups and reaches the scan; files are sorted by group, so row groups are skipped.
    """
    if by is not None and not set(by) <= set(gold.by):
        raise ValueError(f"groups are {', '.join(gold.by)}")
    states = snapshots.read_parts(spark, path, _latest(spark, path, gold))
    if where is not None:
        states = states.filter(where)
    wanted = list(gold.by if by is None else by)
    return gold.merged(states, wanted).select(*wanted, *[gold.final(n).alias(n) for n in gold.measures])


def drop_batches(spark: SparkSession, path: str, gold: Gold, batch_ids: Sequence[str]) -> bool:
    """Take batches out of the table, e.g. withdrawn ones; False if another writer replaced their folders meanwhile."""
    found, gone = _latest(spark, path, gold), set(batch_ids)
    old = [p for p in found.parts if gone & _batches(p)]
    shared = [p for p in old if _batches(p) - gone]
    add = []
    if shared:
        kept = snapshots.read_parts(spark, path, found, shared).filter(~F.col(BATCH).isin(sorted(gone)))
        add = [_write(kept, path, gold, set().union(*map(_batches, shared)) - gone)]
    return snapshots.commit(spark, path, add, old) is not None
