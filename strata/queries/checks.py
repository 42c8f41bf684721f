"""Row rules, URL screening, and manifests: rules for them and whole runs."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from strata.checkpoints import scratch_path
from strata.operators import rules as R
from strata.operators.urls import screen_urls
from strata.plans.manifest import run_manifest
from strata.plans.rules import check_manifests
from strata.queries.registry import query, table
from strata.sinks.layers import layer_path, write_batch, write_layer


def _customer_rules():
    return [
        R.pattern("c_name", "Customer#[0-9]*[02468]"),
        R.length("c_mktsegment", 9, 9),
        R.number_range("c_acctbal", 0, 9000, open_low=True),
        R.one_of("c_mktsegment", ["BUILDING", "MACHINERY", "FURNITURE"]),
        R.required("nation"),
        R.required_when("nation", "c_acctbal > 5000", "large accounts"),
        R.not_prefix("c_mktsegment", "A"),
        R.not_contains("c_name", "00"),
        R.not_edge("c_name", "9"),
        R.not_blank("note"),
    ]


def _customers(spark, sf):
    nation = F.when(F.col("c_custkey") % 6 != 0, F.col("c_nationkey")).alias("nation")
    note = F.when(F.col("c_custkey") % 4 == 0, "  ").alias("note")
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", nation, note)


_BROKEN = {
    ("c_name", "pattern", "c_name does not match Customer#[0-9]*[02468]"): "c_custkey % 2 = 1",
    ("c_mktsegment", "length", "c_mktsegment must have 9 to 9 characters"): "length(c_mktsegment) <> 9",
    ("c_acctbal", "range", "c_acctbal must be above 0 and at most 9000"): "c_acctbal <= 0 OR c_acctbal > 9000",
    ("c_mktsegment", "one_of", "c_mktsegment must be one of BUILDING, MACHINERY, FURNITURE"):
        "c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')",
    ("nation", "required", "nation is required"): "c_custkey % 6 = 0",
    ("nation", "required_when", "nation is required for large accounts"): "c_custkey % 6 = 0 AND c_acctbal > 5000",
    ("c_mktsegment", "not_prefix", "c_mktsegment must not start with A"): "c_mktsegment LIKE 'A%'",
    ("c_name", "not_contains", "c_name must not contain 00"): "c_name LIKE '%00%'",
    ("c_name", "not_edge", "c_name must not start or end with 9"): "c_name LIKE '%9'",
    ("note", "not_blank", "note must not be blank"): "c_custkey % 4 = 0",
}


@query(
    "check_rules",
    " UNION ALL ".join(
        f"SELECT c_custkey, '{f}' AS field, '{r}' AS rule, '{m}' AS message FROM customer WHERE {bad}"
        for (f, r, m), bad in _BROKEN.items()
    ),
)
def check_rules(spark, sf):
    return R.check_rules(_customers(spark, sf), "c_custkey", _customer_rules())


@query(
    "rule_summary",
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, '{r}' AS rule, count(*) AS violations FROM customer WHERE {bad}"
        for (f, r, _), bad in _BROKEN.items()
    ),
)
def rule_summary(spark, sf):
    return R.rule_summary(check_rules(spark, sf))


@query(
    "rule_report",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS field, '{r}' AS rule, count(*) AS n_rows, count(*) FILTER ({bad}) AS violations,
            round(1 - count(*) FILTER ({bad}) / count(*), 9) AS pass_rate FROM customer"""
        for (f, r, _), bad in _BROKEN.items()
    ),
)
def rule_report(spark, sf):
    report = R.rule_report(_customers(spark, sf), _customer_rules())
    return report.withColumn("pass_rate", F.round("pass_rate", 9))


@query(
    "check_unknown_keys",
    """
    SELECT event_id, 'body' AS field, 'extra' AS unknown FROM events WHERE event_id % 5 = 0
    UNION ALL SELECT event_id, 'body', 'k' FROM events
    """,
)
def check_unknown_keys(spark, sf):
    extra = F.when(F.col("event_id") % 5 == 0, '{"extra":1,"id":2,').otherwise('{"id":2,')
    body = F.concat(extra, F.expr("substring(props, 2)"))
    events = table(spark, sf, "events").select("event_id", body.alias("body"))
    return R.check_unknown_keys(events, "event_id", "body", ["id", "name"])


# Hosts and what they are, by remainder of the page id; the last remainder keeps the page's own URL.
HOSTS = {
    "2130706433": "localhost",
    "0x7f.1": "localhost",
    "10.0.0.1": "private_ip",
    "172.31.0.1": "private_ip",
    "192.168.1.1:8080": "private_ip",
    "169.254.0.1": "private_ip",
    "198.51.100.7": "private_ip",
    "240.0.0.1": "private_ip",
    "224.0.0.1": "private_ip",
    "[ff02::1]": "private_ip",
    "172.32.0.1": "public",
    "100.64.0.1": "public",
    "[2001:4860:4860::8888]": "public",
    "[fe80::1]": "private_ip",
    "[fd00::1]:443": "private_ip",
    "[2001:db8::1]": "private_ip",
    "[64:ff9b::a00:1]": "private_ip",
    "[::ffff:10.0.0.1]": "private_ip",
    "[0000:0000:0000:0000:0000:0000:0000:0001]": "localhost",
    "EXAMPLE.Corp.com": "private_host",
    "my.localhost": "private_host",
    "api.land.gov": "private_host",
    "localhost.": "localhost",
    "user:pw@10.0.0.1": "private_ip",
    "1.2.3.256": "invalid",
}


@query(
    "screen_urls",
    f"""
    SELECT page_id, CASE page_id % {len(HOSTS) + 1}
      {' '.join(f"WHEN {i} THEN '{kind}'" for i, kind in enumerate(HOSTS.values()))} ELSE 'public' END AS url_class
    FROM pages
    """,
)
def screened_pages(spark, sf):
    host = F.lit(None).cast("string")
    for i, name in enumerate(HOSTS):
        host = F.when(F.col("page_id") % (len(HOSTS) + 1) == i, name).otherwise(host)
    path = F.regexp_extract("url", "^https?://[^/]*(.*)$", 1)
    url = F.coalesce(F.concat(F.lit("http://"), host, path), F.col("url"))
    return screen_urls(table(spark, sf, "pages").select("page_id", url.alias("url")), "url").drop("url")


def _manifests(spark, sf):
    """One manifest per supplier, most of them broken in some way."""
    key = F.col("s_suppkey")
    n = key % 8
    name = F.when(n == 0, F.concat(F.lit("My-"), key)).when(n == 1, F.concat(F.lit("a__"), key)).otherwise(
        F.concat(F.lit("load_"), key)
    )
    url = F.when(n == 2, "http://10.0.0.1/x").when(n == 3, F.lit(None)).otherwise("https://example.com/api")
    paging = F.when(n == 4, '{"type":"offset","limit_value":2000}').when(n == 7, '{"type":"page","limit_value":"lots"}').otherwise('{"type":"page"}')
    extra = F.when(n == 5, ',"owner":"me"').otherwise("")
    bucket = F.when(n == 6, "b-").otherwise("lake-data")
    manifest = F.concat(
        F.lit('{"pipeline_name":"'), name, F.lit('","agent_type":"generic_rest_api","source":{'),
        F.coalesce(F.concat(F.lit('"url":"'), url, F.lit('",')), F.lit("")),
        F.lit('"pagination":'), paging, F.lit('},"target":{"bucket":"'), bucket,
        F.lit('","source":"shop","dataset":"orders"}'), extra, F.lit("}"),
    )
    return table(spark, sf, "supplier").select("s_suppkey", manifest.alias("manifest"))


@query(
    "check_manifests",
    """
    SELECT s_suppkey, v.field, v.rule FROM supplier JOIN (VALUES
      (0, 'pipeline_name', 'pattern'), (1, 'pipeline_name', 'not_contains'), (2, 'source.url', 'public_url'),
      (3, 'source.url', 'required_when'), (4, 'source.pagination.offset_param', 'required_when'),
      (4, 'source.pagination.limit_value', 'range'), (5, 'owner', 'unknown_key'),
      (6, 'target.bucket', 'length'), (6, 'target.bucket', 'pattern'), (7, 'source.pagination.limit_value', 'type')
    ) v(n, field, rule) ON s_suppkey % 8 = v.n
    """,
)
def checked_manifests(spark, sf):
    return check_manifests(_manifests(spark, sf), "s_suppkey", "manifest").select("s_suppkey", "field", "rule")


@query(
    "run_manifest",
    """
    SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS ordered, o_totalprice AS amount
    FROM orders WHERE o_orderkey % 11 <> 0
    UNION ALL
    SELECT -2 * count(*), 'no list of records of ' || 2 * count(*), NULL FROM customer WHERE c_custkey <= 1000
    """,
)
def silver_orders(spark, sf):
    """Landing JSON to a typed silver table by a manifest; each order lands twice and comes out once.

    A broken line and one without records per customer of the first thousand land too, and come back as errors.
    """
    root = scratch_path(spark, "lake")
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    landed = table(spark, sf, "orders").select(
        F.when(key % 11 != 0, key.cast("string")).alias("id"),
        F.when(key % 2 == 0, F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "MM/dd/yyyy")).alias("ordered"),
        F.col("o_totalprice").cast("string").alias("amount"),
    )
    write_layer(landed.unionByName(landed), root, "landing", "shop", "orders", datetime(2024, 3, 1), "20240301000000")
    broken = F.explode(F.array(F.lit("{broken"), F.lit('{"data": 7}'))).alias("value")
    lines = table(spark, sf, "customer").filter("c_custkey <= 1000").select(broken)
    write_batch(lines, layer_path(root, "landing", "shop", "orders"), datetime(2024, 3, 1), "20240301000001", "text")
    manifest = {
        "pipeline_name": "orders_silver",
        "agent_type": "generic_ai_transformer",
        "source": {"bucket": "lake-data", "path": "layer=landing/source=shop/dataset=orders", "format": "json", "on_bad": "quarantine"},
        "target": {"bucket": "lake-data", "path": "layer=silver/source=shop/dataset=orders"},
        "ai_config": {
            "instruction": "Clean data, one date format, no duplicates",
            "schema": {"id": "int", "ordered": "string", "amount": "float"},
            "steps": [
                {"unwrap_envelope": {"policy": "transform"}},
                {"drop_missing": {"subset": ["id"]}},
                {"cast_columns": {"mode": "strict"}},
                {"standardize_dates": {"cols": ["ordered"], "formats": ["yyyy-MM-dd", "MM/dd/yyyy"]}},
                {"drop_duplicates": {"keys": ["id"], "order_by": ["ordered"]}},
                "project_to_schema",
            ],
        },
    }
    result = run_manifest(spark, manifest, {"lake-data": root}, datetime(2024, 3, 2))
    good = spark.read.parquet(result.target).select("id", "ordered", "amount")
    bad = spark.read.json(f"{result.target}_quarantine").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    told = F.concat("reason", F.lit(f" of {result.summary['error_count']}"))
    return good.unionByName(bad.select((-F.col("n")).cast("int").alias("id"), told.alias("ordered"), F.lit(None).cast("double").alias("amount")))


def _json_model(prompts):
    """Stands in for a model: a list with the first and the last word of the raw data."""
    words = [p.split("Raw Data:\n", 1)[1].split() for p in prompts]
    return ["```json\n" + json.dumps([{"first": w[0], "last": w[-1]}] if w else []) + "\n```" for w in words]


@query(
    "run_manifest_model",
    r"""
    SELECT CAST(c_custkey AS VARCHAR) AS first, c_mktsegment AS last FROM customer
    """,
)
def model_manifest(spark, sf):
    """Landed texts to records by way of a model: prompts, replies, typed rows."""
    root = scratch_path(spark, "lake")
    text = F.concat_ws(" ", F.col("c_custkey"), F.lit("is a customer of"), F.col("c_mktsegment")).alias("value")
    landing = layer_path(root, "landing", "shop", "notes")
    write_batch(table(spark, sf, "customer").select(text), landing, datetime(2024, 3, 1), "20240301000000", "text")
    manifest = {
        "pipeline_name": "notes_silver",
        "agent_type": "generic_ai_transformer",
        "source": {"bucket": "lake-data", "path": "layer=landing/source=shop/dataset=notes", "format": "json"},
        "target": {"bucket": "lake-data", "path": "layer=silver/source=shop/dataset=notes"},
        "ai_config": {
            "instruction": "Name the first and the last word",
            "schema": {"first": "string", "last": "string"},
            "steps": ["build_prompts", "extract_records", "parse_replies", {"check_rules": {"not_blank": ["first"]}}],
        },
    }
    result = run_manifest(spark, manifest, {"lake-data": root}, datetime(2024, 3, 2), model_fn=_json_model)
    return spark.read.parquet(result.target).select("first", "last")
