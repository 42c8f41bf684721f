"""Reusing results by content: keys, look-up with a time to live, upserts, statistics.

A cache is a table with a unique `key`, a `payload`, `cached_at`, and any further columns.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.clean import drop_duplicates
from strata.sinks import snapshots

# Length of a key, and how long an entry lives.
KEY_LENGTH = 16
TTL_DAYS = 30

MONTH = "cached_month"
# Filters are as large as the keys of a row group need.
BLOOM = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def content_key(df: DataFrame, content: str | Sequence[str], key_col: str = "key") -> DataFrame:
    """Add a key over canonical JSON: equal content gives an equal key, in whatever order its keys are.

    `content` is a column of JSON text or VARIANT, or a list of columns. Text that is not JSON has
    no canonical form and is hashed as it is.
    """
    if isinstance(content, str):
        kind = df.schema[content].dataType.typeName()
        value = F.col(content) if kind == "variant" else F.try_parse_json(F.col(content))
        text = F.to_json(value)
        canonical = text if kind == "variant" else F.coalesce(text, F.col(content))
    else:
        canonical = F.to_json(F.struct(*sorted(content)), {"ignoreNullFields": "false"})
    return df.withColumn(key_col, F.substring(F.sha2(canonical, 256), 1, KEY_LENGTH))


def _moment(at: datetime | str | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(str(at)).cast("timestamp_ntz")


def _live(now: datetime | str | Column, ttl_days: int) -> Column:
    """Not yet past `cached_at` plus the time to live, in a form that Spark pushes into the scan."""
    return F.col("cached_at").cast("timestamp_ntz") >= _moment(now) - F.make_dt_interval(F.lit(ttl_days))


def split_cached(
    df: DataFrame, cache: DataFrame, now: datetime | str | Column, ttl_days: int = TTL_DAYS, key: str = "key"
) -> tuple[DataFrame, DataFrame]:
    """(hits with the payload, rows still to compute). An entry has expired once `now` is past its end.

    The misses need the keys of the cache only, so payloads are not shuffled for them.
    """
    live = cache.filter(_live(now, ttl_days))
    return df.join(live.select(key, "payload"), key), df.join(live.select(key), key, "left_anti")


def store_cached(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: the latest entry per key wins. Storing the same entries twice changes nothing."""
    return drop_duplicates(cache.unionByName(new, allowMissingColumns=True), ["key"], ["-cached_at"])


def purge_expired(cache: DataFrame, now: datetime | str | Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    return cache.filter(_live(now, ttl_days))


def clear_cached(cache: DataFrame, condition: str | Column = "true") -> DataFrame:
    """The cache without the entries that meet the condition; all of them by default."""
    test = F.expr(condition) if isinstance(condition, str) else condition
    return cache.filter(~F.coalesce(test, F.lit(False)))


def _month() -> Column:
    return F.coalesce(F.date_format("cached_at", "yyyy-MM"), F.lit("none"))


def upsert_cache(path: str, new: DataFrame) -> None:
    """Store entries in the cache table at `path`: a new folder, sorted by key, and a version that names it.

    Nothing that is there is read or rewritten, and the entries are evaluated once. `read_cache` gives the latest
    entry per key, so storing the same entries again changes nothing there. Several writers may store at once.
    """
    spark, seen = new.sparkSession, Observation()
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in new.schema.fields])
    snapshots.joint_schema(snapshots.latest(spark, path).schema, schema)
    placed = new.observe(seen, F.max(_month()).alias("newest")).hint("rebalance").sortWithinPartitions("key")
    (part,) = snapshots.write_parts(placed, path, options=BLOOM)
    newest = seen.get["newest"]
    snapshots.commit(spark, path, [replace(part, tags={"newest": newest})] if newest else [], schema=schema)


def cache_entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the latest version, superseded ones included."""
    return snapshots.read_parts(spark, path, snapshots.latest(spark, path))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The latest entry of each key in the cache table at `path`. The frame stays with the version of this moment."""
    return drop_duplicates(cache_entries(spark, path), ["key"], ["-cached_at"])


def lookup_cache(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The latest entries of some keys. Bloom filters and ranges of the files keep all but a few row groups unread."""
    return drop_duplicates(cache_entries(spark, path).filter(F.col("key").isin(list(keys))), ["key"], ["-cached_at"])


def compact_cache(spark: SparkSession, path: str, fan: int | None = None) -> bool:
    """Keep the latest entry of each key, in folders by the month of `cached_at` and files of good size; False if
    another compaction came first.

    The work is done on one version, and committed in the place of just the folders that were read: entries stored
    meanwhile stay, and until the commit readers see the table as it was. With `fan`, only folders of like size are
    merged, where a month (or what was stored since) has `fan` of them, see `snapshots.tiers`: cheap enough after
    every few stores. Replaced folders go with `vacuum_cache`.
    """
    snapshot = snapshots.latest(spark, path)
    parts = snapshot.parts
    if fan is not None:
        months = defaultdict(list)
        for p in parts:
            months[p.tags.get(MONTH)].append(p)
        parts = [p for own in months.values() for group in snapshots.tiers(own, fan) for p in group]
    if not parts:
        return True
    latest = drop_duplicates(snapshots.read_parts(spark, path, snapshot, parts), ["key"], ["-cached_at"])
    placed = latest.withColumn(MONTH, _month()).hint("rebalance", MONTH).sortWithinPartitions(MONTH, "key")
    return snapshots.commit(spark, path, snapshots.write_parts(placed, path, MONTH, options=BLOOM), parts) is not None


def drop_expired(spark: SparkSession, path: str, now: datetime, ttl_days: int = TTL_DAYS) -> int:
    """Leave out the folders whose entries are all of months that have expired; returns how many. Reads no entry.

    Stored entries of several months lie in one folder until they are compacted.
    """
    last = (now - timedelta(days=ttl_days)).strftime("%Y-%m")
    while True:
        old = [p for p in snapshots.latest(spark, path).parts if p.tags.get(MONTH, p.tags.get("newest")) < last]
        if not old or snapshots.commit(spark, path, remove=old) is not None:
            return len(old)


def vacuum_cache(spark: SparkSession, path: str, older_than: timedelta = timedelta(days=1)) -> int:
    """Remove the folders that no version names any more and that are older than a while; returns how many."""
    return snapshots.vacuum(spark, path, older_than.total_seconds())


def cache_stats(cache: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entries, payload bytes and megabytes, in all or per group."""
    size = F.sum(F.octet_length("payload"))
    return cache.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(size, F.lit(0)).alias("bytes"),
        F.round(F.coalesce(size, F.lit(0)) / (1024 * 1024), 2).alias("megabytes"),
    )
