"""Paged sources that grow at their end: each run fetches what came since the run before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.pages import stitch_pages
from strata.sinks import snapshots
from strata.sources.paged import Fetcher, read_paged, require_pages

#: Of each source the last page with records, how many it had, and a digest of them.
SCHEMA = "source_id string, page bigint, items bigint, digest string"


class ProgressMoved(RuntimeError):
    """Another run of the same sources was faster."""


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA, one per source that has given records."""
    found = snapshots.latest(spark, path)
    return snapshots.read_parts(spark, path, found) if found.schema else spark.createDataFrame([], SCHEMA)


def resume(sources: DataFrame, progress: DataFrame) -> DataFrame:
    """Sources with `done_pages` for `plan_requests`: pages that were full. The last one is asked for again, as it may have grown."""
    done = progress.select(F.col("source_id").alias("_done"), (F.col("page") - 1).alias("done_pages"))
    return sources.join(done, F.col("source_id").cast("string") == F.col("_done"), "left").drop("_done")


def _digest(records: DataFrame) -> DataFrame:
    """Count and digest of records of one page of each source; no more than a page meets in one group."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("item", "json"))), lambda r: r["json"])
    return records.groupBy("source_id").agg(F.count("*").alias("items"), F.sha2(F.array_join(texts, "\n"), 256).alias("digest"))


def _refuse(told: Column) -> Column:
    return F.raise_error(told).cast("boolean")


def ingest_new(
    sources: DataFrame,
    fetcher: Fetcher,
    path: str,
    land: Callable[[DataFrame, str], None],
    record_key: str | None = None,
    row_element: str | None = None,
    **options,
) -> int:
    """Fetch what the sources have given since the run before, land it, and note how far each was read; returns the run's number.

    `land(records, run)` writes rows of `source_id`, `page`, `record`; those of a run that came before are not in them.
    `path` is a versioned table of one row per source, replaced in one step after `land`. A run that dies before that
    step is repeated under the same `run`, so a `land` that replaces what it wrote for a run (as `write_batch` does for a
    batch) lands each record once. Two runs at once: the slower one raises `ProgressMoved`, and what it landed is of a run
    that the other one has landed as well.

    A page with an error, or a missing one, fails the run, and so does a source whose last page no longer starts with
    the records it had: that one does not only grow at its end. `max_items` and `max_pages` count from the first run on.
    """
    spark = sources.sparkSession
    found = snapshots.latest(spark, path)
    before = read_progress(spark, path)
    resumed = resume(sources, before)
    fetched = read_paged(resumed, fetcher, record_key=record_key, row_element=row_element, **options)
    named = require_pages(fetched).select(F.col("source_id").alias("source"), "page", "body")
    stitched = stitch_pages(named, record_key=record_key)
    whole = F.when(F.col("complete"), F.lit(True)).otherwise(_refuse(F.concat(F.lit("a page is missing, repeated or unreadable: "), F.col("source"))))
    # Records are read four times below; the checkpoint lets pages be parsed and stitched once.
    known = before.select(F.col("source_id").alias("source"), F.col("page").alias("_page"), F.col("items").alias("_items"))
    records = stitched.filter(whole).join(known, "source", "left").select(
        F.col("source").alias("source_id"), (F.col("page") + F.coalesce(F.col("_page") - 1, F.lit(0))).alias("page"), "item",
        "record", F.to_json("record").alias("json"), (F.col("item") < F.coalesce("_items", F.lit(0))).alias("old"),
    ).checkpoint()

    # Every source that is among those asked, and has given pages, must still have them as they were.
    asked = before.join(fetched.select("source_id").distinct(), "source_id", "left_semi")
    again = _digest(records.filter("old")).select("source_id", F.col("digest").alias("now"))
    changed = asked.join(again, "source_id", "left").filter("NOT digest <=> now").select("source_id", "page").first()
    if changed is not None:
        raise ValueError(f"page {changed.page} of source {changed.source_id} has changed since it was read")

    run = found.version + 1
    land(records.filter("NOT old").select("source_id", "page", "record"), f"{run:012d}")
    last = records.groupBy("source_id").agg(F.max("page").alias("page"))
    ends = _digest(records.join(last, ["source_id", "page"], "left_semi")).join(last, "source_id")
    now = ends.select("source_id", "page", "items", "digest")
    after = now.unionByName(before.join(now.select("source_id"), "source_id", "left_anti"))
    new = snapshots.write_parts(after.to(snapshots.T.StructType.fromDDL(SCHEMA)), path)
    if snapshots.commit(spark, path, new, found.parts, snapshots.T.StructType.fromDDL(SCHEMA), on=found.version) is None:
        raise ProgressMoved(f"{path} has moved on from version {found.version}")
    return run
