"""Keyed reuse and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.checkpoints import scratch_path
from strata.operators import logs, reuse
from strata.queries.registry import query, table

NOW = "1998-06-15 00:00:00"


@query(
    "content_key",
    """
    SELECT event_id, substr(sha256('{"a":{"x":' || user_id || ',"y":"' || event_type || '"},"b":' || event_id || '}'), 1, 16) AS key
    FROM events
    """,
)
def content_key(spark, sf):
    """The same content in two key orders."""
    inner = F.concat(F.lit('"x": '), F.col("user_id"), F.lit(', "y":"'), F.col("event_type"), F.lit('"'))
    swapped = F.concat(F.lit('"y":"'), F.col("event_type"), F.lit('","x":'), F.col("user_id"))
    body = F.when(
        F.col("event_id") % 2 == 0, F.concat(F.lit('{"b":'), F.col("event_id"), F.lit(',"a":{'), inner, F.lit("}}"))
    ).otherwise(F.concat(F.lit('{ "a": {'), swapped, F.lit('}, "b": '), F.col("event_id"), F.lit("}")))
    events = table(spark, sf, "events").select("event_id", body.alias("body"))
    return reuse.content_key(events, "body").select("event_id", "key")


@query(
    "content_key_columns",
    """
    SELECT o_orderkey, substr(sha256('{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}'), 1, 16) AS key
    FROM orders
    """,
)
def content_key_columns(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return reuse.content_key(orders, ["o_orderstatus", "o_custkey"]).select("o_orderkey", "key")


def _cache(spark, sf):
    orders = table(spark, sf, "orders").filter("o_orderkey % 3 = 0")
    return orders.select(
        F.col("o_orderkey").alias("key"),
        F.concat(F.lit("result of "), F.col("o_custkey")).alias("payload"),
        F.col("o_orderdate").alias("cached_at"),
        F.col("o_orderstatus").alias("pipeline"),
    )


def _newer(spark, sf):
    return table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("key"),
        F.lit("newer").alias("payload"),
        (F.col("o_orderdate") + F.expr("interval 1 day")).alias("cached_at"),
        F.col("o_orderstatus").alias("pipeline"),
    )


def _work(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")


_LIVE = f"o_orderkey % 3 = 0 AND TIMESTAMP '{NOW}' <= o_orderdate + INTERVAL 30 DAY"


@query(
    "split_cached_hits",
    f"SELECT o_orderkey AS key, o_totalprice, 'result of ' || o_custkey AS payload FROM orders WHERE {_LIVE}",
)
def split_cached_hits(spark, sf):
    return reuse.split_cached(_work(spark, sf), _cache(spark, sf), NOW)[0]


@query(
    "split_cached_misses",
    f"SELECT o_orderkey AS key, o_totalprice FROM orders WHERE NOT ({_LIVE})",
)
def split_cached_misses(spark, sf):
    return reuse.split_cached(_work(spark, sf), _cache(spark, sf), NOW)[1]


@query(
    "store_cached",
    """
    SELECT o_orderkey AS key,
           CASE WHEN o_orderkey % 2 = 0 THEN 'newer' ELSE 'result of ' || o_custkey END AS payload
    FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0
    """,
)
def store_cached(spark, sf):
    """New entries win over older ones; storing them twice changes nothing."""
    newer = _newer(spark, sf)
    once = reuse.store_cached(_cache(spark, sf), newer)
    return reuse.store_cached(once, newer).select("key", "payload")


@query(
    "upsert_cache",
    """
    SELECT o_orderkey AS key,
           CASE WHEN o_orderkey % 2 = 0 THEN 'newer' ELSE 'result of ' || o_custkey END AS payload
    FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0
    """,
)
def upsert_cache(spark, sf):
    """The same into a table on disk, by three appends."""
    path = scratch_path(spark, "cache")
    for entries in (_cache(spark, sf), _newer(spark, sf), _newer(spark, sf)):
        reuse.upsert_cache(path, entries)
    return reuse.read_cache(spark, path).select("key", "payload")


@query(
    "compact_cache",
    """
    SELECT o_orderkey AS key, count(*) AS entries, max(CASE WHEN o_orderkey % 2 = 0 THEN 'newer' ELSE 'result of ' || o_custkey END) AS payload
    FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 GROUP BY o_orderkey
    """,
)
def compact_cache(spark, sf):
    """After compaction the table holds one entry per key, as its files show."""
    path = scratch_path(spark, "cache")
    for entries in (_cache(spark, sf), _newer(spark, sf), _newer(spark, sf)):
        reuse.upsert_cache(path, entries)
    reuse.compact_cache(spark, path)
    return reuse.cache_entries(spark, path).groupBy("key").agg(F.count(F.lit(1)).alias("entries"), F.max("payload").alias("payload"))


@query(
    "lookup_cache",
    """
    SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'newer' ELSE 'result of ' || o_custkey END AS payload
    FROM orders WHERE (o_orderkey % 3 = 0 OR o_orderkey % 2 = 0) AND o_orderkey IN (2, 3, 4, 5, 6, 33, 34, 64, 65, 66, 96, 999)
    """,
)
def lookup_cache(spark, sf):
    """A few keys, from a table that was stored in six appends and merged by size."""
    path = scratch_path(spark, "cache")
    stores = [(_cache(spark, sf).filter(f"key % 4 = {k}"), 1) for k in range(4)] + [(_newer(spark, sf), 2)] * 2
    for entries, day in stores:
        reuse.upsert_cache(path, entries.withColumn("cached_at", F.make_timestamp_ntz(F.lit(1996), F.lit(1), F.lit(day), F.lit(0), F.lit(0), F.lit(0))))
    reuse.compact_cache(spark, path, fan=4)
    return reuse.lookup_cache(spark, path, [2, 3, 4, 5, 6, 33, 34, 64, 65, 66, 96, 999]).select("key", "payload")


@query(
    "clear_cached",
    "SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'F'",
)
def clear_cached(spark, sf):
    return reuse.clear_cached(_cache(spark, sf), "pipeline = 'F'").select("key")


@query(
    "purge_expired",
    f"SELECT o_orderkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS cached FROM orders WHERE {_LIVE}",
)
def purge_expired(spark, sf):
    live = reuse.purge_expired(_cache(spark, sf), NOW)
    return live.select("key", F.date_format("cached_at", "yyyy-MM-dd").alias("cached"))


@query(
    "cache_stats",
    """
    SELECT o_orderstatus AS pipeline, count(*) AS entries, CAST(sum(strlen('result of ' || o_custkey)) AS BIGINT) AS bytes,
           round(sum(strlen('result of ' || o_custkey)) / 1048576, 2) AS megabytes
    FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL
    """,
)
def cache_stats(spark, sf):
    return reuse.cache_stats(_cache(spark, sf), ["pipeline"])


def _log_lines(spark, sf):
    """Events as log lines: the type as pipeline, the value as duration; every 23rd line is cut off."""
    failed = F.col("event_id") % 9 == 0
    line = F.concat(
        F.lit('{"timestamp": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lit('Z", "level": "'), F.when(failed, "ERROR").otherwise("INFO"),
        F.lit('", "logger": "runner", "message": "run", "module": "runner", "function": "run", "line": 42, "pipeline_name": "'),
        F.col("event_type"), F.lit('", "agent_type": "'), F.when(F.col("event_id") % 2 == 0, "ingestion").otherwise("transformation"),
        F.lit('", "status": "'), F.when(failed, "failed").otherwise("success"),
        F.lit('", "duration_ms": '), F.col("value").cast("decimal(18,2)").cast("string"),
        F.when(F.col("event_id") % 23 == 0, "").otherwise("}"),
    )
    return table(spark, sf, "events").select(line.alias("line"))


@query(
    "parse_json_logs",
    """
    SELECT ts AS timestamp, event_type AS pipeline_name, CASE WHEN event_id % 9 = 0 THEN 'ERROR' ELSE 'INFO' END AS level,
           CAST(42 AS BIGINT) AS line, value AS duration_ms
    FROM events WHERE event_id % 23 <> 0
    """,
)
def parse_json_logs(spark, sf):
    good, _ = logs.parse_json_logs(_log_lines(spark, sf), "line")
    return good.select("timestamp", "pipeline_name", "level", "line", "duration_ms")


@query(
    "parse_json_logs_bad",
    "SELECT count(*) AS bad_lines FROM events WHERE event_id % 23 = 0",
)
def parse_json_logs_bad(spark, sf):
    return logs.parse_json_logs(_log_lines(spark, sf), "line")[1].agg(F.count(F.lit(1)).alias("bad_lines"))


@query(
    "run_metrics",
    """
    SELECT event_type AS pipeline_name, CASE WHEN event_id % 2 = 0 THEN 'ingestion' ELSE 'transformation' END AS agent_type,
           count(*) AS runs, count(*) FILTER (event_id % 9 = 0) AS errors,
           round(count(*) FILTER (event_id % 9 = 0) / count(*), 6) AS error_rate,
           round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
           CASE WHEN arg_max(event_id, ts) % 9 = 0 THEN 'failed' ELSE 'success' END AS last_status
    FROM events WHERE event_id % 23 <> 0 GROUP BY ALL
    """,
)
def run_metrics(spark, sf):
    good, _ = logs.parse_json_logs(_log_lines(spark, sf), "line")
    rounded = {c: F.round(c, 6) for c in ("error_rate", "mean_ms", "p95_ms")}
    return logs.run_metrics(good).withColumns(rounded)


@query(
    "run_summary",
    "SELECT count(*) AS records, count(*) FILTER (event_id % 9 = 0) AS error_count FROM events",
)
def run_summary(spark, sf):
    """Counts taken while the events are written, without reading them again."""
    events, counts = logs.with_summary(table(spark, sf, "events"), bad=F.col("event_id") % 9 == 0)
    events.write.parquet(scratch_path(spark, "events"))
    found = logs.summary_of(counts, "processed")
    return spark.range(1).select(
        F.lit(found["records_processed"]).cast("bigint").alias("records"),
        F.lit(found["error_count"]).cast("bigint").alias("error_count"),
    )
