"""Files, layers, envelopes, pages and requests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from strata.checkpoints import scratch_path
from strata.files import qualified, remove_folder
from strata.operators.envelope import record_columns, unwrap_envelope
from strata.operators.pages import stitch_cursor_pages, stitch_pages
from strata.plans.manifest import run_manifest
from strata.queries.registry import query, table
from strata.sinks.layers import BATCHES, to_json_records, write_layer
from strata.sources import landing, paged
from strata.sources.progress import ingest_new
from strata.sources.requests import plan_requests
from strata.streaming.promote import promote

ORDERS_DDL = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string"
ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query("read_landing_json", ORDERS_SQL)
def read_landing_json(spark, sf):
    path = scratch_path(spark, "json")
    _orders(spark, sf).write.json(path)
    return landing.read_landing(spark, path, "json", ORDERS_DDL, lines=True)


@query("read_landing_csv", ORDERS_SQL)
def read_landing_csv(spark, sf):
    path = scratch_path(spark, "csv")
    _orders(spark, sf).write.option("header", "true").csv(path)
    return landing.read_landing(spark, path, "csv", ORDERS_DDL)


@query("read_landing_xml", ORDERS_SQL)
def read_landing_xml(spark, sf):
    path = scratch_path(spark, "xml")
    _orders(spark, sf).write.format("xml").option("rowTag", "order").option("rootTag", "orders").save(path)
    return landing.read_landing(spark, path, "xml", ORDERS_DDL, row_tag="order")


@query("read_landing_parquet", ORDERS_SQL)
def read_landing_parquet(spark, sf):
    return landing.read_landing(spark, f"{sf}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"
    )


@query(
    "read_landing_quarantine",
    """
    SELECT o_orderkey % 19 <> 0 AS good, count(*) AS n,
           coalesce(sum(o_custkey) FILTER (o_orderkey % 19 <> 0), 0)::BIGINT AS customers
    FROM orders GROUP BY ALL
    """,
)
def read_landing_quarantine(spark, sf):
    path = scratch_path(spark, "bad-json")
    line = F.to_json(F.struct("o_orderkey", "o_custkey"))
    cut = F.when(F.col("o_orderkey") % 19 == 0, F.expr("left(line, length(line) - 3)")).otherwise(F.col("line"))
    table(spark, sf, "orders").withColumn("line", line).select(cut.alias("value")).write.text(path)
    read = landing.read_landing(
        spark, path, "json", "o_orderkey bigint, o_custkey bigint", lines=True, on_bad="quarantine"
    )
    good, bad = landing.split_corrupt(read)
    both = good.select(F.lit(True).alias("good"), "o_custkey").unionByName(
        bad.select(F.lit(False).alias("good"), "o_custkey")
    )
    return both.groupBy("good").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("good"), F.col("o_custkey")).otherwise(0)).alias("customers")
    )


@query("read_landing_arrays", "SELECT doc_id, text || ' \"}, {[' || chr(92) AS text, [n_chars, doc_id] AS sizes FROM documents")
def read_landing_arrays(spark, sf):
    """Files of one array each, with brackets, quotes and escapes in their texts, read by ranges of bytes."""
    path = scratch_path(spark, "arrays")
    text = F.concat("text", F.lit(' "}, {[\\')).alias("text")
    docs = table(spark, sf, "documents").select("doc_id", text, F.array(F.col("n_chars").cast("long"), "doc_id").alias("sizes"))
    lists = docs.groupBy(F.floor(F.col("doc_id") / 500).alias("part")).agg(F.to_json(F.collect_list(F.struct(*docs.columns))).alias("value"))
    lists.write.partitionBy("part").option("lineSep", "\n").text(path)
    rows = landing.read_landing(spark, path, "json", "doc_id long, text string, sizes array<long>", lines=False, split=True)
    return rows.drop("part")


@query(
    "read_checked",
    """
    SELECT month(o_orderdate)::INTEGER AS part, month(o_orderdate) % 4 <> 0 AS good, count(*) FILTER (month(o_orderdate) % 4 <> 0) AS n,
           CASE WHEN month(o_orderdate) % 4 = 0 THEN 'not Parquet, or cut off' END AS reason
    FROM orders GROUP BY ALL
    """,
)
def read_checked(spark, sf):
    """Each fourth month landed as text under a name of Parquet: refused with a reason, the others are read."""
    path = scratch_path(spark, "checked")
    orders = table(spark, sf, "orders").select("o_orderkey", F.month("o_orderdate").alias("part"))
    orders.where("part % 4 <> 0").write.partitionBy("part").parquet(path)
    damaged = orders.where("part % 4 = 0").select("part", F.col("o_orderkey").cast("string").alias("value"))
    damaged.repartition("part").write.mode("append").partitionBy("part").text(path)
    rows, refused = landing.read_checked(spark, path, "parquet")
    read = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("reason"))
    part = F.regexp_extract("path", r"/part=([0-9]+)/", 1).cast("int").alias("part")
    left = refused.select(part, F.lit(0).cast("long").alias("n"), "reason").distinct()
    return read.unionByName(left).select("part", F.col("reason").isNull().alias("good"), "n", "reason")


@query(
    "split_bad_records",
    """
    SELECT event_id, event_id % 13 <> 0 AND event_id % 17 <> 0 AS good,
           CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 THEN user_id END AS user_id
    FROM events
    """,
)
def split_bad_records(spark, sf):
    user = F.when(F.col("event_id") % 17 == 0, F.lit('"x"')).otherwise(F.col("user_id").cast("string"))
    line = F.concat(F.lit('{"user_id":'), user, F.when(F.col("event_id") % 13 == 0, "").otherwise("}"))
    lines = table(spark, sf, "events").select("event_id", line.alias("line"))
    good, bad = landing.split_bad_records(lines, "line", "user_id bigint")
    return good.select("event_id", F.lit(True).alias("good"), "user_id").unionByName(
        bad.select("event_id", F.lit(False).alias("good"), F.lit(None).cast("bigint").alias("user_id"))
    )


@query(
    "to_json_records",
    """
    SELECT '{"o_orderkey":' || o_orderkey || ',"o_custkey":' ||
           CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE o_custkey::VARCHAR END ||
           ',"o_orderstatus":"' || o_orderstatus || '","o_orderdate":"' ||
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || '"}' AS json
    FROM orders
    """,
)
def json_records(spark, sf):
    custkey = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey")
    return to_json_records(table(spark, sf, "orders").select("o_orderkey", custkey, "o_orderstatus", "o_orderdate"))


@query(
    "hive_roundtrip",
    """
    SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, count(*) AS n,
           CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total
    FROM (SELECT CASE WHEN event_id % 97 <> 0 THEN ts END AS ts, value FROM events) GROUP BY ALL
    """,
)
def hive_roundtrip(spark, sf):
    """Writing the same batch twice leaves one copy, of rows without a time too."""
    root = scratch_path(spark, "lake")
    events = table(spark, sf, "events").withColumn("ts", F.when(F.col("event_id") % 97 != 0, F.col("ts")))
    for _ in range(2):
        path = write_layer(events, root, "silver", "shop", "events", "ts", "20240301000000")
    level = {c: F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("year", 4), ("month", 2), ("day", 2))}
    return (
        spark.read.parquet(path)
        .withColumns(level)
        .groupBy("year", "month", "day")
        .agg(F.count(F.lit(1)).alias("n"), F.expr("cast(sum(cast(value as decimal(18, 2))) as double)").alias("total"))
    )


@query(
    "read_batches",
    """
    SELECT user_id % 3 AS part, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events WHERE user_id % 3 <> 1 GROUP BY ALL
    """,
)
def read_batches(spark, sf):
    """Three batches of one dataset; the run of the second is undone before its end, so that readers must not see it."""
    root = scratch_path(spark, "batches")
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    for k in range(3):
        path = write_layer(events.where(F.col("user_id") % 3 == k), root, "silver", "shop", "events", "ts", f"2024030{k + 1}000000")
    remove_folder(spark, f"{path}/{BATCHES}/20240302000000.json")
    days = F.countDistinct(F.to_date("ts")).alias("days")
    part = (F.col("user_id") % 3).alias("part")
    return landing.read_batches(spark, path).groupBy(part).agg(F.count(F.lit(1)).alias("n"), days)


@query(
    "inventory_stats",
    """
    SELECT 'landing' AS layer, 'shop' AS source, 'events' AS dataset,
           count(DISTINCT CAST(ts AS DATE)) AS days, true AS has_files FROM events
    UNION ALL
    SELECT 'silver', 'shop', 'events', count(DISTINCT CAST(ts AS DATE)), true FROM events WHERE event_type = 'error'
    """,
)
def inventory_stats(spark, sf):
    root = scratch_path(spark, "lake")
    events = table(spark, sf, "events").select("event_id", "ts", "event_type")
    write_layer(events, root, "landing", "shop", "events", "ts", "20240301000000")
    write_layer(events.filter("event_type = 'error'"), root, "silver", "shop", "events", "ts", "20240301000000")
    stats = landing.inventory_stats(landing.inventory(spark, root))
    has_files = (F.col("files") >= F.col("days")) & (F.col("bytes") > 0)
    return stats.select("layer", "source", "dataset", "days", has_files.alias("has_files"))


@query(
    "promote",
    "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS happened FROM events",
)
def promote_events(spark, sf):
    """A batch of which nothing is left, two that overlap, each promoted twice, and all again by a new stream."""
    root = scratch_path(spark, "lake")
    events = table(spark, sf, "events").select(
        "event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("happened")
    )

    def steps(df):
        return df.filter("event_id >= 0").select("event_id", "user_id", F.to_date("happened").alias("happened"))

    batches = [events.limit(1).withColumn("event_id", F.lit(-1).cast("long")), events.filter("event_id % 3 <> 2"), events.filter("event_id % 3 <> 0")]
    first, second = scratch_path(spark, "progress"), scratch_path(spark, "progress")
    for number, batch in enumerate(batches, 1):
        write_layer(batch, root, "landing", "shop", "events", datetime(2024, 3, number), f"2024030{number}000000")
        for checkpoint in (first, first, second)[: 3 if number == 3 else 2]:
            path = promote(
                spark, root, "shop", "events", steps, checkpoint, "happened",
                "event_id bigint, user_id bigint, happened string", keys=["event_id"], order_by=["user_id"],
            )
    return spark.read.parquet(path).select("event_id", "user_id", F.date_format("happened", "yyyy-MM-dd").alias("happened"))


@query(
    "sample_text",
    "SELECT doc_id, substr(text, 1, 5000) AS text FROM documents",
)
def sample_text(spark, sf):
    return landing.sample_text(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query(
    "sample_text_per_group",
    """
    SELECT source, min(doc_id) AS doc_id, substr(arg_min(text, doc_id), 1, 200) AS text
    FROM documents GROUP BY source
    """,
)
def sample_text_per_group(spark, sf):
    documents = table(spark, sf, "documents").select("source", "doc_id", "text")
    return landing.sample_text(documents, "text", 200, per=["source"], order_by="doc_id")


def _bodies(spark, sf):
    """Response bodies of six shapes, by event."""
    event = F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"user":'), F.col("user_id"), F.lit("}"))
    other = F.concat(F.lit('{"id":-'), F.col("event_id") + 1, F.lit(',"user":0}'))
    kind = F.col("event_id") % 6
    body = (
        F.when(kind == 0, F.concat(F.lit("["), event, F.lit(","), other, F.lit("]")))
        .when(kind == 1, F.concat(F.lit('{"results":['), other, F.lit('],"data":['), event, F.lit("]}")))
        .when(kind == 2, F.concat(F.lit('{"results":['), event, F.lit("]}")))
        .when(kind == 3, event)
        .when(kind == 4, F.lit('{"data":7}'))
        .otherwise(F.lit("{bad"))
    )
    return table(spark, sf, "events").select("event_id", body.alias("body"))


_EVENT = "SELECT event_id, '{kind}' AS envelope, 0 AS position, event_id AS id, user_id AS user FROM events WHERE event_id % 6 = {n}"
_OTHER = "SELECT event_id, '{kind}' AS envelope, {at} AS position, -(event_id + 1) AS id, CAST(0 AS BIGINT) AS user FROM events WHERE event_id % 6 = {n}"
_LIST = f"{_EVENT.format(kind='list', n=0)} UNION ALL {_OTHER.format(kind='list', n=0, at=1)}"
_NONE = """SELECT event_id, 'whole' AS envelope, 0 AS position, CAST(NULL AS BIGINT) AS id,
           CAST(NULL AS BIGINT) AS user FROM events WHERE event_id % 6 = {n}"""


def _unwrapped(spark, sf, policy):
    return record_columns(unwrap_envelope(_bodies(spark, sf), "body", policy), {"id": "int", "user": "int"})


@query(
    "unwrap_envelope_ingest",
    f"{_LIST} UNION ALL {_EVENT.format(kind='data', n=1)} UNION ALL {_EVENT.format(kind='results', n=2)}",
)
def unwrap_ingest(spark, sf):
    return _unwrapped(spark, sf, "ingest")


@query(
    "unwrap_envelope_transform",
    f"""{_LIST} UNION ALL {_EVENT.format(kind='data', n=1)} UNION ALL {_NONE.format(n=2)}
    UNION ALL {_EVENT.format(kind='whole', n=3)}""",
)
def unwrap_transform(spark, sf):
    return _unwrapped(spark, sf, "transform")


@query(
    "unwrap_envelope_model",
    f"""{_LIST} UNION ALL {_OTHER.format(kind='results', n=1, at=0)}
    UNION ALL {_EVENT.format(kind='results', n=2)} UNION ALL {_EVENT.format(kind='whole', n=3)}""",
)
def unwrap_model(spark, sf):
    return _unwrapped(spark, sf, "model")


@query(
    "unwrap_envelope_kinds",
    """
    SELECT CASE event_id % 6 WHEN 0 THEN 'list' WHEN 1 THEN 'data' WHEN 2 THEN 'results' ELSE 'unexpected' END
             AS envelope,
           count(*) AS bodies
    FROM events GROUP BY ALL
    """,
)
def unwrap_kinds(spark, sf):
    """Bodies without records stay visible, so that they can be counted."""
    rows = unwrap_envelope(_bodies(spark, sf), "body", "ingest", keep_empty=True)
    return rows.groupBy("envelope").agg(F.count_if(F.coalesce("position", F.lit(0)) == 0).alias("bodies"))


@query(
    "plan_requests",
    """
    WITH s AS (
      SELECT s_suppkey, s_suppkey % 4 AS kind, 30 + s_suppkey % 50 AS max_items, 10 + s_suppkey % 20 AS size
      FROM supplier),
    r AS (
      SELECT *, unnest(generate_series(1, CASE WHEN kind < 2 THEN CAST(ceil(max_items / size) AS BIGINT) ELSE 1 END)) AS seq
      FROM s)
    SELECT CAST(s_suppkey AS VARCHAR) AS source_id, seq,
           CASE kind
             WHEN 0 THEN 'from=' || ((seq - 1) * size) || '&max=' || least(size, max_items - (seq - 1) * size) || '&q=DOC'
             WHEN 1 THEN 'page=' || seq || '&per_page=' || size || '&q=DOC'
             ELSE 'q=DOC' END AS params
    FROM r
    """,
)
def requests_of_suppliers(spark, sf):
    key = F.col("s_suppkey")
    kind = key % 4
    sources = table(spark, sf, "supplier").select(
        key.cast("string").alias("source_id"),
        F.when(kind == 0, "offset_limit").when(kind == 1, "page").when(kind == 2, "none").otherwise("cursor").alias("type"),
        F.when(kind == 0, "from").alias("offset_param"),
        F.when(kind == 0, "max").alias("limit_param"),
        (10 + key % 20).cast("int").alias("limit_value"),
        (30 + key % 50).alias("max_items"),
        F.create_map(F.lit("q"), F.lit("DOC")).alias("params"),
    )
    entries = F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return plan_requests(sources).select(
        "source_id", "seq", F.array_join(F.array_sort(entries), "&").alias("params")
    )


def _event_pages(spark, sf):
    """Pages per user: a page holds up to five events, so there are thousands; some are emptied, some land twice."""
    record = F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit("}"))
    source = (F.col("event_id") % 2).alias("source")
    pages = (
        table(spark, sf, "events")
        .groupBy(source, (F.floor(F.col("event_id") / 10) + 1).alias("page"))
        .agg(F.sort_array(F.collect_list(F.struct("event_id", record.alias("r")))).alias("rs"))
    )
    full = F.concat(F.lit('{"data":['), F.array_join(F.transform("rs", lambda x: x["r"]), ","), F.lit("]}"))
    emptied = (F.col("source") == 1) & (F.col("page") == 77)
    pages = pages.select("source", "page", F.when(emptied, F.lit('{"data":[]}')).otherwise(full).alias("body"))
    # Landed again with its records in another order; the first as text counts.
    again = F.regexp_replace("body", r"\[(.*),([^,]*)\]", r"[$2,$1]")
    twice = pages.filter("source = 1 AND page % 50 = 0").withColumn("body", again)
    cap = F.when(F.col("source") == 1, 300).cast("bigint")
    return pages.unionByName(twice).withColumn("cap", cap)


@query(
    "stitch_pages",
    """
    WITH e AS (
      SELECT event_id, event_id % 2 AS source, event_id // 10 + 1 AS page,
             row_number() OVER (PARTITION BY event_id % 2 ORDER BY event_id) - 1 AS item
      FROM events)
    SELECT source, page, item, source = 0 AS complete, event_id FROM e WHERE source = 0 OR (page < 77 AND item < 300)
    """,
)
def stitched_events(spark, sf):
    stitched = stitch_pages(_event_pages(spark, sf), max_items="cap").drop("cap")
    return record_columns(stitched, {"event_id": "int"})


@query(
    "stitch_cursor_pages",
    """
    SELECT conv_id, turn, n - 1 AS position FROM (
      SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    WHERE turn = n - 1
    """,
)
def stitched_turns(spark, sf):
    """Turns as pages that each know the cursor of the next one."""
    turn = F.col("turn")
    pages = table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(turn > 0, F.concat(F.lit("c"), turn)).alias("cursor"),
        F.concat(F.lit("c"), turn + 1).alias("next_cursor"),
    )
    return stitch_cursor_pages(pages, source_col="conv_id").select("conv_id", "turn", "position")


def _dump_customers(spark, sf, source, key=None, where="true"):
    """Customers as page files: one folder per source, one file per 500 keys. Returns the root and the pages."""
    root = scratch_path(spark, "dump")
    customers = table(spark, sf, "customer").filter(where).select(
        source.alias("source"), (F.floor(F.col("c_custkey") / 500) + 1).alias("page"), "c_custkey"
    )
    body = F.to_json(F.sort_array(F.collect_list(F.struct("c_custkey"))))
    if key is not None:
        body = F.concat(F.lit(f'{{"{key}": '), body, F.lit("}"))
    pages = customers.groupBy("source", "page").agg(body.alias("value"))
    target = qualified(spark, root)

    def write(rows):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(target)
        made = set()
        for row in rows:
            folder = f"{base}/source={row.source}"
            if folder not in made:
                files.create_dir(folder)
                made.add(folder)
            with files.open_output_stream(f"{folder}/page={row.page}.json") as out:
                out.write(row.value.encode("utf-8"))

    # One file a page: Spark's own writer needs a folder, several files and a rename for each. A task that runs again writes
    # the same files again. By a hash of its own, as a shuffle by the columns grouped on is left out, and few tasks would write.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages.repartition(tasks, F.xxhash64("source", "page")).foreachPartition(write)
    return target, pages


@query(
    "fetch_pages",
    """
    SELECT CAST(c_nationkey % 5 AS VARCHAR) AS source, c_custkey // 500 + 1 AS page, c_custkey FROM customer
    """,
)
def fetched_customers(spark, sf):
    """Requests planned for a table of sources, by nation, then fetched and stitched."""
    root, pages = _dump_customers(spark, sf, F.col("c_nationkey") % 5)
    sources = pages.groupBy(F.col("source").cast("string").alias("source_id")).agg(
        F.lit("page").alias("type")
    )
    fetched = paged.read_paged(sources, paged.FileFetcher(root), wave=20)
    stitched = stitch_pages(fetched.select(F.col("source_id").alias("source"), "page", "body"))
    return record_columns(stitched.select("source", "page", "record"), {"c_custkey": "int"})


@query(
    "fetch_pages_named_key",
    "SELECT CAST(c_nationkey % 5 AS VARCHAR) AS source, c_custkey // 500 + 1 AS page, c_custkey FROM customer",
)
def fetched_by_key(spark, sf):
    """The same from bodies that hold their records under a name of their own."""
    root, pages = _dump_customers(spark, sf, F.col("c_nationkey") % 5, "customers")
    sources = pages.groupBy(F.col("source").cast("string").alias("source_id")).agg(F.lit("page").alias("type"))
    fetched = paged.read_paged(sources, paged.FileFetcher(root), record_key="customers")
    named = fetched.select(F.col("source_id").alias("source"), "page", "body")
    return record_columns(stitch_pages(named, record_key="customers").select("source", "page", "record"), {"c_custkey": "int"})


@query("paged_source", "SELECT c_custkey // 500 + 1 AS page, c_custkey FROM customer")
def paged_customers(spark, sf):
    """One source through `spark.read.format("paged")`; each run of pages is a partition."""
    root, _ = _dump_customers(spark, sf, F.lit("all"))
    paged.register_paged(spark)
    pages = spark.read.format("paged").option("root", root).option("source_id", "all").load()
    stitched = stitch_pages(pages.select(F.col("source_id").alias("source"), "page", "body"))
    return record_columns(stitched.select("page", "record"), {"c_custkey": "int"})


@query("run_manifest_ingestion", "SELECT c_custkey FROM customer")
def landed_customers(spark, sf):
    """An ingestion manifest: pages fetched, stitched and landed as JSON lines."""
    root, _ = _dump_customers(spark, sf, F.lit("customers_daily"))
    manifest = {
        "pipeline_name": "customers_daily",
        "agent_type": "generic_rest_api",
        "source": {"url": "https://example.com/customers", "pagination": {"type": "page", "limit_value": 500}},
        "target": {"bucket": "lake-data", "source": "shop", "dataset": "customers"},
    }
    lake = {"lake-data": scratch_path(spark, "lake")}
    result = run_manifest(spark, manifest, lake, datetime(2024, 3, 1), fetcher=paged.FileFetcher(root))
    return landing.read_landing(spark, result.target, "json", "c_custkey bigint", lines=True).select("c_custkey")


@query(
    "ingest_increments",
    """
    SELECT CAST(c_nationkey % 5 AS VARCHAR) AS source_id, c_custkey // 500 + 1 AS page, c_custkey,
           CASE WHEN c_custkey * 5 < 3 * max(c_custkey) OVER () THEN 1 ELSE 2 END AS run
    FROM customer
    """,
)
def customers_as_they_come(spark, sf):
    """Sources that grow between two runs, within their last page and beyond it; the second run lands what is new."""
    progress, landed = scratch_path(spark, "progress"), scratch_path(spark, "landed")
    source, most = F.col("c_nationkey") % 5, table(spark, sf, "customer").agg(F.max("c_custkey")).first()[0]
    for where in (F.col("c_custkey") * 5 < 3 * most, F.lit(True)):
        root, pages = _dump_customers(spark, sf, source, where=where)
        sources = pages.select(F.col("source").cast("string").alias("source_id")).distinct().withColumn("type", F.lit("page"))
        ingest_new(
            sources, paged.FileFetcher(root), progress,
            lambda records, run: record_columns(records, {"c_custkey": "int"}).write.parquet(f"{landed}/run={run}"),
        )
    return spark.read.parquet(landed).withColumn("run", F.col("run").cast("int"))
