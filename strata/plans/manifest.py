"""Running a manifest: validate it, chain the operators it names, write once."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata import schema as S
from strata.checkpoints import ensure_checkpoint_dir
from strata.functions.expr import observed, once, trim_all
from strata.operators import clean, model, relate, replies, reuse, rules, text
from strata.operators.envelope import record_columns, unwrap_envelope
from strata.operators.logs import summary_of, with_summary
from strata.operators.pages import stitch_pages
from strata.operators.model import ModelFn
from strata.operators.quality import require_schema
from strata.operators.urls import url_class
from strata.plans.rules import INGESTION, check_manifests
from strata.sinks.layers import BATCH_LEVELS, layer_path, new_batch_id, write_batch
from strata.sources.landing import CORRUPT, read_checked, read_landing
from strata.sources.paged import Fetcher, HttpFetcher, read_paged, require_pages

Manifest = Mapping[str, Any]


class ManifestError(ValueError):
    """A manifest that breaks rules, or a run that failed."""

    def __init__(self, message: str, problems: list[str] | None = None):
        super().__init__(message if not problems else f"{message}: {problems}")
        self.problems = problems or []


@dataclass
class RunResult:
    status: str
    target: str
    schema: str
    instruction: str = ""
    summary: dict = field(default_factory=dict)
    mismatches: list[str] = field(default_factory=list)


@dataclass
class Context:
    """What steps may need besides the frame: bucket roots, the target schema, the run's time and id, the model, and
    what is done with bad records.
    """

    spark: SparkSession
    roots: Mapping[str, str]
    schema: Mapping[str, str]
    at: datetime
    batch_id: str
    dry_run: bool = False
    model_fn: ModelFn | None = None
    instruction: str = ""
    on_bad: str = "skip"
    bad: list[tuple[Observation, DataFrame]] = field(default_factory=list)
    check_files: bool = False
    refused: DataFrame | None = None

    def landed(self, where: str, fmt: str, **options) -> DataFrame:
        """The landed rows; with `check_files` without the files that cannot be read, which stop the run (`fail`) or are kept in `refused`."""
        if not self.check_files or self.dry_run:
            return read_landing(self.spark, where, fmt, **options)
        rows, refused = read_checked(self.spark, where, fmt, **options)
        self.refused = refused.select(F.col("path").alias("record"), F.concat(F.lit("unreadable file: "), "reason").alias("reason"))
        told = self.refused.limit(20).collect() if self.on_bad == "fail" else []
        if told:
            raise ManifestError("files cannot be read", [f"{r['record']}: {r['reason']}" for r in told])
        return rows

    def without_bad(self, df: DataFrame, bad: Column, record: Column, reason: Column | str) -> DataFrame:
        """The rows that are not bad. The others are counted during the run; they stop it (`fail`), are
        left out (`skip`), or are left out and written beside the target (`quarantine`).
        """
        bad = F.coalesce(bad, F.lit(False))
        why = F.lit(reason) if isinstance(reason, str) else reason
        if self.on_bad == "fail":
            told = F.raise_error(F.concat_ws(": ", F.lit("bad record"), why)).cast("boolean")
            return df.filter(F.when(bad, told).otherwise(F.lit(True)))
        count = Observation()
        counted = df.observe(count, F.count_if(bad).alias("bad"))
        self.bad.append((count, df.filter(bad).select(record.cast("string").alias("record"), why.alias("reason"))))
        return counted.filter(~bad)

    def location(self, bucket: str, path: str) -> str:
        if bucket not in self.roots:
            raise ManifestError(f"no root is given for bucket {bucket}")
        return f"{self.roots[bucket].rstrip('/')}/{path}"


def load_manifest(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def validate_manifest(spark: SparkSession, manifest: Manifest) -> None:
    """Raise with every rule the manifest breaks."""
    one = spark.range(1).select("id", F.lit(json.dumps(manifest, default=str)).alias("manifest"))
    broken = check_manifests(one, "id", "manifest").collect()
    if broken:
        raise ManifestError("the manifest is not valid", [r["message"] for r in broken])


def _unwrap(df: DataFrame, c: Context, policy="transform", record_key=None, fields=None, body="body"):
    """Bodies to rows; fields are read as text unless `fields` gives types. A body without a list of records is bad."""
    wanted = fields or dict.fromkeys(c.schema, "string")
    told = df.filter(trim_all(F.coalesce(body, F.lit(""))) != "").select(F.col(body), F.col(body).alias("_text"))
    records = unwrap_envelope(told, body, policy, record_key, keep_empty=True)
    records = c.without_bad(records, F.col("envelope") == "unexpected", F.col("_text"), "no list of records")
    return record_columns(records.filter("position IS NOT NULL").select("record"), wanted)


def _check(df: DataFrame, c: Context, required=(), not_blank=(), one_of=None):
    """Rows that break a rule are bad."""
    each = [rules.required(f) for f in required] + [rules.not_blank(f) for f in not_blank]
    each += [rules.one_of(f, values) for f, values in (one_of or {}).items()]
    marked = once(df, "_broken", rules.violations(each))
    reason = F.array_join("_broken.message", "; ")
    return c.without_bad(marked, F.size("_broken") > 0, F.to_json(F.struct(*df.columns)), reason).drop("_broken")


def _screen(df: DataFrame, c: Context, col: str):
    verdict = url_class(col)
    return c.without_bad(df, verdict != "public", F.col(col), F.concat(F.lit("URL is not public: "), verdict))


def _ask(df: DataFrame, c: Context, **a):
    """Prompts to replies. They are kept before anything is built on them, so each prompt is asked once."""
    if c.model_fn is None:
        raise ManifestError("extract_records needs a model_fn")
    replies_ = model.extract_records(df, c.model_fn, **a)
    if not c.dry_run:
        ensure_checkpoint_dir(c.spark)
        replies_ = replies_.checkpoint()
    return c.without_bad(replies_, F.col("error").isNotNull(), F.to_json(F.struct(*replies_.columns)), F.col("error"))


def _enrich(df: DataFrame, c: Context, lookup, on, columns, matched=None):
    where = c.location(lookup["bucket"], lookup["path"])
    table = read_landing(c.spark, where, lookup.get("format", "parquet"), lookup.get("schema"), lines=True)
    return relate.enrich(df, table, on, columns, matched, check=not c.dry_run)


STEPS: dict[str, Callable[..., DataFrame]] = {
    "unwrap_envelope": _unwrap,
    "drop_missing": lambda df, c, subset: clean.drop_missing(df, subset),
    "cast_columns": lambda df, c, schema=None, mode="strict": clean.cast_columns(df, schema or c.schema, mode),
    "standardize_dates": lambda df, c, **a: clean.standardize_dates(df, **a),
    "derive_date_parts": lambda df, c, **a: clean.derive_date_parts(df, **a),
    "filter_rows": lambda df, c, condition: clean.filter_rows(df, condition),
    "drop_duplicates": lambda df, c, **a: clean.drop_duplicates(df, **a),
    "derive_columns": lambda df, c, expressions: clean.derive_columns(df, expressions),
    "project_to_schema": lambda df, c, schema=None, **a: clean.project_to_schema(df, schema or c.schema, **a),
    "add_audit_columns": lambda df, c: clean.add_audit_columns(df, c.at, c.batch_id),
    "extract_xml": lambda df, c, col, fields: text.extract_xml(df, col, fields),
    "extract_xml_rows": lambda df, c, col, rows, fields: text.extract_xml_rows(df, col, rows, fields),
    "summarize_text": lambda df, c, **a: text.summarize_text(df, **a),
    "enrich": _enrich,
    "check_rules": _check,
    "screen_urls": _screen,
    "content_key": lambda df, c, **a: reuse.content_key(df, **a),
    "build_prompts": lambda df, c, text_col="body", **a: replies.build_prompts(df, text_col, c.schema, c.instruction, **a),
    "extract_records": _ask,
    "parse_replies": lambda df, c, reply_col="reply": replies.parse_replies(df, reply_col, c.schema),
    "gold_aggregate": lambda df, c, by, measures: relate.gold_aggregate(df, by, measures),
}


def apply_steps(df: DataFrame, steps: list[Mapping[str, Any]], c: Context) -> DataFrame:
    """Each step is `{name: arguments}`, or the bare name."""
    for step in steps:
        name, arguments = (step, {}) if isinstance(step, str) else next(iter(step.items()))
        if name not in STEPS:
            raise ManifestError(f"unknown step: {name}")
        df = STEPS[name](df, c, **(arguments or {}))
    return df


def _ingestion(manifest: Manifest, c: Context, fetcher: Fetcher | None, pause: float) -> tuple[DataFrame, str, str, bool]:
    """What is landed, where, as what, and whether the manifest's own `max_pages` ended the source."""
    source, target = manifest["source"], manifest["target"]
    paging = {"type": "none", **(source.get("pagination") or {})}
    fmt, key, element = source.get("format", "json"), source.get("record_key"), source.get("row_element")
    if paging["type"] == "cursor":
        raise ManifestError("cursor paging is not fetched by a manifest; land the pages and use stitch_cursor_pages")
    if fmt != "json" and paging["type"] != "none" and not (element or paging.get("max_items") or paging.get("max_pages")):
        raise ManifestError(f"paging of {fmt} has no end: give row_element, max_items or max_pages")
    params = {k: str(v) for k, v in (source.get("params") or {}).items()}
    names = "offset_param limit_param limit_value max_items max_pages page_param".split()
    one = c.spark.createDataFrame(
        [(manifest["pipeline_name"], source["url"], paging["type"], params, *[paging.get(n) for n in names])],
        "source_id string, url string, type string, params map<string,string>, offset_param string, "
        "limit_param string, limit_value int, max_items bigint, max_pages int, page_param string",
    )
    fetcher = fetcher or HttpFetcher(source.get("method") or "GET", source.get("headers"))
    pages = require_pages(read_paged(one, fetcher, keep=not c.dry_run, pause=pause, record_key=key, row_element=element))
    most, capped = paging.get("max_pages"), False
    if most and not c.dry_run:
        capped = not pages.filter((F.col("page") == most) & ~F.col("is_empty")).isEmpty()
    if fmt == "json":
        named = pages.select(F.col("source_id").alias("source"), "page", "body")
        records = stitch_pages(named, max_items=paging.get("max_items"), record_key=key)
        told = F.raise_error("a page of the source is missing, repeated or unreadable").cast("boolean")
        out = records.filter(F.when(F.col("complete"), F.lit(True)).otherwise(told)).select(F.to_json("record").alias("value"))
    else:
        out = pages.filter(~F.col("is_empty")).select(F.to_json(F.struct("source_id", "page", "body")).alias("value"))
    path = layer_path("", target.get("layer") or "landing", target["source"], target["dataset"]).lstrip("/")
    return out, c.location(target["bucket"], path), "text", capped


def _transformation(manifest: Manifest, c: Context, lines: bool, row_tag: str | None) -> tuple[DataFrame, str, str]:
    source, target, config = manifest["source"], manifest["target"], manifest["ai_config"]
    where = c.location(source["bucket"], source["path"])
    fmt = source.get("format", "json")
    steps = list(config.get("steps") or [])
    first = next((s if isinstance(s, str) else next(iter(s)) for s in steps), None)
    raw = fmt == "json" and first in ("unwrap_envelope", "build_prompts")
    declared = source.get("schema")
    if raw or fmt == "parquet":
        df = c.landed(where, fmt, lines=lines, raw=raw)
    elif declared:
        fields = ", ".join(f"`{n}` {S.spark_type(t) or 'string'}" for n, t in declared.items())
        split = {"split": True} if fmt == "json" and not (lines or c.dry_run or c.check_files) else {}
        df = c.landed(where, fmt, schema=fields, row_tag=row_tag, lines=lines, on_bad="quarantine", **split)
        df = c.without_bad(df, F.col(CORRUPT).isNotNull(), F.col(CORRUPT), "unreadable record").drop(CORRUPT)
    elif c.dry_run:
        raise ManifestError(f"a dry run over {fmt} needs source.schema, as fields are inferred by reading the data")
    else:
        df = c.landed(where, fmt, row_tag=row_tag, lines=lines)
    out = apply_steps(df, steps, c)
    return out.drop(*set(BATCH_LEVELS) - set(c.schema)), c.location(target["bucket"], target["path"]), "parquet"


def run_manifest(
    spark: SparkSession,
    manifest: Manifest,
    roots: Mapping[str, str],
    at: datetime,
    dry_run: bool = False,
    fetcher: Fetcher | None = None,
    lines: bool = True,
    row_tag: str | None = None,
    pause: float = 1.0,
    model_fn: ModelFn | None = None,
    check_files: bool = False,
) -> RunResult:
    """Validate, chain, write, and say what happened; a failed run raises `ManifestError`.

    `roots` maps bucket names to folders. The run is one write action; its counts are taken on the way.
    Bad records (bodies without a list of records, broken rules, prompts without an answer, lines that do not fit
    a declared `source.schema`) are counted as errors; `source.on_bad` says what happens to them: `skip` (default), `fail`,
    or `quarantine`, which writes them below `<target>_quarantine` in a second pass that runs only if there are any.

    Ingestion keeps the fetched pages first, so that each is asked for once; a source with a failed, missing or unreadable
    page fails the run, and one that its own `max_pages` ended has the status `incomplete`. `dry_run` builds the same
    chain and returns its schema, schema mismatches and target, without reading data. `at` is the
    run's time: it gives the batch id, so a repeated run replaces its batch. `lines` says whether landed JSON holds one
    value per line (as written here) or per file. Without `unwrap_envelope` as first step and without
    `source.schema`, Spark reads JSON, XML and CSV once more to infer their fields. `check_files` checks landed files before
    they are read: those that cannot be read are bad records too (see `read_checked`); else one stops the run. `model_fn` answers `extract_records`.
    """
    validate_manifest(spark, manifest)
    ingests = manifest["agent_type"] == INGESTION
    schema = {} if ingests else manifest["ai_config"]["schema"]
    instruction = "" if ingests else manifest["ai_config"]["instruction"].strip()
    on_bad = manifest["source"].get("on_bad") or "skip"
    c = Context(spark, roots, schema, at, new_batch_id(at), dry_run, model_fn, instruction, on_bad, check_files=check_files)
    capped = False
    if ingests:
        df, target, fmt, capped = _ingestion(manifest, c, fetcher, pause)
    else:
        df, target, fmt = _transformation(manifest, c, lines, row_tag)
    about = (target, df.schema.simpleString(), instruction)
    if dry_run:
        return RunResult("dry_run_success", *about, mismatches=[m[-1] for m in S.mismatches(df.schema, schema)])
    require_schema(df, schema)
    counted, observation = with_summary(df, manifest["pipeline_name"])
    try:
        write_batch(counted, target, at, c.batch_id, fmt)
    except PySparkException as e:
        raise ManifestError(f"{manifest['pipeline_name']} failed: {str(e).splitlines()[0]}") from e
    # A count is missing where no good row is left and the plan was cut; then the bad ones are counted again.
    counts = [(observed(count).get("bad"), rows) for count, rows in c.bad]
    errors = [(rows.count() if n is None else n, rows) for n, rows in counts]
    if c.refused is not None:
        errors.append((c.refused.count(), c.refused))
    summary = summary_of(observation, "fetched" if ingests else "processed", sum(n for n, _ in errors))
    kept = [rows for n, rows in errors if n]
    if on_bad == "quarantine" and kept:
        write_batch(reduce(DataFrame.unionByName, kept), f"{target}_quarantine", at, c.batch_id, "json")
    status = "incomplete" if capped else "success"
    return RunResult(status, *about, summary | {"status": status})
