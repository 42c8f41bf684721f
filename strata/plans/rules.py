"""What a valid manifest is, as row rules over a table of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.rules import (
    Rule,
    length,
    non_empty_map,
    not_blank,
    not_contains,
    not_edge,
    not_prefix,
    number_range,
    one_of,
    pattern,
    required,
    required_when,
    violations,
)
from strata.operators.urls import url_class
from strata.sinks.layers import LAYERS
from strata.sources.landing import FORMATS
from strata.sources.requests import MAX_LIMIT, OFFSET_TYPES, PAGING_TYPES

# The two kinds of manifest, and the names and sizes that are allowed.
INGESTION = "generic_rest_api"
TRANSFORMATION = "generic_ai_transformer"
NAME = "[a-z0-9_]+"
BUCKET = "[a-z0-9][a-z0-9-]*[a-z0-9]"
SOURCE_TYPES = ("rest_api", "file", "database")
METHODS = ("GET", "POST", "PUT")
ON_BAD = ("fail", "skip", "quarantine")

# Kinds of JSON values, by field; what is not listed may hold anything its rules allow.
TYPES = {
    "STRING": (
        "pipeline_name agent_type source.type source.url source.method source.format source.bucket source.path source.record_key "
        "source.row_element source.on_bad source.pagination.type source.pagination.offset_param source.pagination.limit_param "
        "source.pagination.cursor_param source.pagination.page_param target.bucket target.layer target.source target.dataset "
        "target.path ai_config.instruction"
    ).split(),
    "BIGINT": "source.pagination.limit_value source.pagination.max_items source.pagination.max_pages".split(),
    "OBJECT": "source source.pagination source.params source.headers source.schema target ai_config ai_config.schema".split(),
    "ARRAY": ["ai_config.steps"],
}
KINDS = {"STRING": "text", "BIGINT": "a whole number", "OBJECT": "an object", "ARRAY": "a list"}

SCHEMA = """
  pipeline_name string, agent_type string,
  source struct<type: string, url: string, method: string, format: string,
    pagination: struct<type: string, offset_param: string, limit_param: string, limit_value: bigint,
      max_items: bigint, max_pages: bigint, cursor_param: string, page_param: string>,
    params: map<string,string>, headers: map<string,string>, bucket: string, path: string,
    record_key: string, row_element: string, on_bad: string, schema: map<string,string>>,
  target struct<bucket: string, layer: string, source: string, dataset: string, path: string>,
  ai_config struct<instruction: string, schema: map<string,string>>
"""

KEYS = {
    "$": "pipeline_name agent_type source target".split(),
    "$.source": "type url method format pagination params headers bucket path record_key row_element on_bad schema".split(),
    "$.source.pagination": "type offset_param limit_param limit_value max_items max_pages cursor_param page_param".split(),
    "$.target": "bucket layer source dataset path".split(),
    "$.ai_config": "instruction schema steps".split(),
}


def _bucket(field: str) -> list[Rule]:
    return [length(field, 3, 63), pattern(field, BUCKET)]


def manifest_rules() -> list[Rule]:
    """The rules on the columns of SCHEMA."""
    ingests, transforms = f"agent_type = '{INGESTION}'", f"agent_type = '{TRANSFORMATION}'"
    has_paging, has_config = "source.pagination is not null", "ai_config is not null"
    is_offset = f"source.pagination.type in {OFFSET_TYPES}"
    verdict = url_class("source.url")
    return [
        required("pipeline_name"),
        pattern("pipeline_name", NAME),
        length("pipeline_name", 3, 100),
        not_edge("pipeline_name", "_"),
        not_contains("pipeline_name", "__"),
        required("agent_type"),
        one_of("agent_type", (INGESTION, TRANSFORMATION)),
        required("source"),
        required("target"),
        one_of("source.type", SOURCE_TYPES),
        one_of("source.method", METHODS),
        one_of("source.format", FORMATS),
        one_of("source.on_bad", ON_BAD),
        Rule("source.url", "public_url", verdict != "public", "source.url must be a public http(s) URL"),
        *_bucket("source.bucket"),
        not_prefix("source.path", "/"),
        required_when("source.pagination.type", has_paging, "paging"),
        one_of("source.pagination.type", PAGING_TYPES),
        required_when("source.pagination.offset_param", is_offset, "offset paging"),
        number_range("source.pagination.limit_value", 0, MAX_LIMIT, open_low=True),
        number_range("source.pagination.max_items", 0, open_low=True),
        number_range("source.pagination.max_pages", 0, open_low=True),
        required_when("target.bucket", "target is not null", "a target"),
        *_bucket("target.bucket"),
        one_of("target.layer", LAYERS),
        pattern("target.source", NAME),
        pattern("target.dataset", NAME),
        not_prefix("target.path", "/"),
        required_when("source.url", ingests, "ingestion"),
        Rule(
            "source.type",
            "supported",
            F.expr(ingests) & (F.col("source.type") != "rest_api"),
            "source.type must be rest_api for ingestion",
        ),
        required_when("target.source", ingests, "ingestion"),
        required_when("target.dataset", ingests, "ingestion"),
        required_when("source.path", transforms, "transformation"),
        required_when("source.bucket", transforms, "transformation"),
        required_when("target.path", transforms, "transformation"),
        Rule(
            "ai_config", "required_when", F.expr(f"{transforms} and ai_config is null"), "ai_config is required for transformation"
        ),
        required_when("ai_config.instruction", has_config, "transformation"),
        length("ai_config.instruction", 10, 5000),
        not_blank("ai_config.instruction"),
        Rule(
            "ai_config.schema", "required_when", F.expr(f"{has_config} and ai_config.schema is null"), "ai_config.schema is required for transformation"
        ),
        non_empty_map("ai_config.schema"),
    ]


def _unknown(json: Column, ingests: Column) -> Column:
    """ARRAY of violations for keys that a manifest must not have, level by level."""
    nothing = F.array().cast("array<struct<field:string,rule:string,message:string>>")

    def level(path: str, allowed: list[str]) -> Column:
        part = json if path == "$" else F.get_json_object(json, path)
        known = F.array(*[F.lit(k) for k in allowed])
        if path == "$":
            known = F.when(ingests, known).otherwise(F.array_append(known, F.lit("ai_config")))
        prefix = F.lit("" if path == "$" else path[2:] + ".")

        def violation(name: Column) -> Column:
            full = F.concat(prefix, name)
            return F.struct(
                full.alias("field"),
                F.lit("unknown_key").alias("rule"),
                F.concat(full, F.lit(" is not a known key")).alias("message"),
            )

        return F.coalesce(F.transform(F.array_except(F.json_object_keys(part), known), violation), nothing)

    return F.concat(*[level(path, allowed) for path, allowed in KEYS.items()])


def _mistyped(json: Column) -> Column:
    """ARRAY of violations for values of another type than their field has, judged on the JSON itself."""
    value = F.try_parse_json(json)
    found = []
    for kind, fields in TYPES.items():
        for field in fields:
            held = F.try_variant_get(value, f"$.{field}", "variant")
            told = F.struct(F.lit(field).alias("field"), F.lit("type").alias("rule"), F.lit(f"{field} must be {KINDS[kind]}").alias("message"))
            found.append(F.when(~F.schema_of_variant(held).startswith(kind) & (F.schema_of_variant(held) != "VOID"), told))
    return F.array_compact(F.array(*found)).cast("array<struct<field:string,rule:string,message:string>>")


def check_manifests(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """One row `(key, field, rule, message)` per rule that a manifest (JSON text) breaks."""
    parsed = df.select(
        F.col(key).alias("_key"), F.col(json_col).alias("_json"), F.from_json(json_col, SCHEMA).alias("_m")
    ).select("_key", "_json", "_m.*")
    unreadable = Rule(
        "manifest",
        "json",
        F.try_parse_json("_json").isNull(),
        "the manifest is not a JSON object",
    )
    ingests = F.coalesce(F.col("agent_type") == INGESTION, F.lit(False))
    found = F.concat(violations([unreadable, *manifest_rules()]), _mistyped(F.col("_json")), _unknown(F.col("_json"), ingests))
    return parsed.select(F.col("_key").alias(key), F.explode(found).alias("v")).select(key, "v.*")
