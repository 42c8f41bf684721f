"""Lookup joins and gold-layer aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strata.operators.clean import need_columns


class LookupNotUnique(ValueError):
    """A lookup key that occurs more than once."""


def require_unique(lookup: DataFrame, keys: Sequence[str]) -> None:
    """Raise if a key occurs twice. One pass over the key columns; keys with nulls never match."""
    twice = lookup.dropna(subset=list(keys)).groupBy(*keys).count().filter("count > 1").drop("count").first()
    if twice is not None:
        raise LookupNotUnique(f"lookup key is not unique: {twice.asDict()}")


def enrich(
    df: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    columns: Sequence[str],
    matched: str | None = None,
    observation: Observation | None = None,
    check: bool = True,
) -> DataFrame:
    """Left join that adds lookup columns and never multiplies rows.

    `check` makes sure that no key occurs twice in the lookup, by one job over its keys. It is a job
    of its own because an aggregate between shuffle and join would keep adaptive execution from
    splitting a hot key. There is no broadcast hint: Spark broadcasts the lookup when its size is
    under the session threshold, and otherwise shuffles both sides and splits skewed partitions.

    `matched` names a flag column; `observation` counts rows and unmatched rows as the query runs.
    """
    keys = [on] if isinstance(on, str) else list(on)
    need_columns(df, keys)
    need_columns(lookup, [*keys, *columns])
    if check:
        require_unique(lookup, keys)
    joined = df.join(lookup.select(*keys, *columns, F.lit(True).alias("_found")), keys, "left")
    if observation is not None:
        joined = joined.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("_found").isNull()).alias("unmatched"),
        )
    if matched:
        joined = joined.withColumn(matched, F.col("_found").isNotNull())
    return joined.drop("_found")


def gold_aggregate(df: DataFrame, by: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """Business aggregates: `{"n": "count(*)", ...}` per group, partially aggregated before the shuffle."""
    if not measures:
        raise ValueError("gold_aggregate needs at least one measure")
    return df.groupBy(*by).agg(*[F.expr(text).alias(name) for name, text in measures.items()])
