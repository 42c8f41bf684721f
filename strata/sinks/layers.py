"""Writing layers: Hive folders per source, dataset and day, one folder per batch below."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata.files import matching, read_text, remove_folder, write_new
from strata.functions.expr import observed

# The layers, and the form of a batch id.
LAYERS = ("landing", "silver", "gold")
BATCH_FORMAT = "%Y%m%d%H%M%S"

DAY_LEVELS = ("year", "month", "day")
BATCH_LEVELS = (*DAY_LEVELS, "batch_id")
# Fixed value: the folder that Hive layouts give rows with a null level.
NULL_LEVEL = "__HIVE_DEFAULT_PARTITION__"


#: Beside the data, one small file for each batch that is complete; Spark's readers pass over such names.
BATCHES = "_batches"


def layer_path(root: str, layer: str, source: str, dataset: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer: {layer}")
    return f"{root.rstrip('/')}/layer={layer}/source={source}/dataset={dataset}"


def new_batch_id(at: datetime) -> str:
    return at.strftime(BATCH_FORMAT)


def to_json_records(df: DataFrame, col: str = "json") -> DataFrame:
    """Each row as one JSON object: nulls are kept, timestamps are ISO with milliseconds."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSS"
    options = {"ignoreNullFields": "false", "timestampFormat": stamp, "timestampNTZFormat": stamp}
    return df.select(F.to_json(F.struct(*df.columns), options).alias(col))


def complete_batches(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The complete batches of a dataset, each with the day folders that hold it, relative to the dataset."""
    found = {}
    for name in sorted(matching(spark, f"{path}/{BATCHES}/*.json")):
        told = json.loads(read_text(spark, name))
        found[told["batch_id"]] = told["folders"]
    return found


def write_batch(
    df: DataFrame, path: str, ts: Column | str | datetime, batch_id: str, fmt: str = "parquet"
) -> str:
    """Write one batch below a dataset path, in `year=/month=/day=/batch_id=`; returns the path.

    `ts` is the time that gives the day: a column, a column name, or one time for the whole batch.
    Only the folders of this batch are replaced, so running a batch again changes nothing and other
    batches are never touched. Days the batch no longer has lose its folder. Rows whose time is null go
    to the folders of null levels. Columns with the name of a level are refused.

    The last step writes the batch's record to `_batches`; the first of a repeated run removes it. So a batch whose run died at
    any place between is not complete: `read_batches` leaves it out, and running it again heals it. Readers of the plain
    folders see what is there.

    Rows are rebalanced by day before the write: files come out near the advisory size, and a day
    that holds most of the rows is split over many tasks instead of being written by one.
    """
    spark = df.sparkSession
    clash = [c for c in df.columns if c.lower() in BATCH_LEVELS]
    if clash:
        raise ValueError(f"columns named like levels of the layout: {clash}; rename them")
    if isinstance(ts, datetime):
        ts = F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")
    at = F.col(ts) if isinstance(ts, str) else ts
    dated = df.withColumns(
        {
            "year": F.date_format(at, "yyyy"),
            "month": F.date_format(at, "MM"),
            "day": F.date_format(at, "dd"),
            "batch_id": F.lit(batch_id),
        }
    )
    earlier = matching(spark, f"{path}/year=*/month=*/day=*/batch_id={batch_id}")
    record = f"{path}/{BATCHES}/{batch_id}.json"
    remove_folder(spark, record)
    days = Observation()
    day = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(c, F.lit(NULL_LEVEL))) for c in DAY_LEVELS])
    dated = dated.observe(days, F.collect_set(day).alias("written"))
    (
        dated.hint("rebalance", *DAY_LEVELS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", "false")
        .partitionBy(*BATCH_LEVELS)
        .format(fmt)
        .save(path)
    )
    told = observed(days)
    if not told and not df.isEmpty():
        raise RuntimeError(f"the folders of batch {batch_id} are not known; run it again")
    written = told.get("written", [])
    folders = sorted(f"{d}/batch_id={batch_id}" for d in written)
    for folder in earlier:
        if not folder.endswith(tuple(f"/{f}" for f in folders)):
            remove_folder(spark, folder)
    if not write_new(spark, record, json.dumps({"batch_id": batch_id, "folders": folders})):
        raise RuntimeError(f"batch {batch_id} was written by another run meanwhile; run it again")
    return path


def write_layer(
    df: DataFrame,
    root: str,
    layer: str,
    source: str,
    dataset: str,
    ts: Column | str | datetime,
    batch_id: str,
    fmt: str | None = None,
) -> str:
    """Write one batch to `layer=/source=/dataset=/`, see `write_batch`; returns the dataset path.

    Landing defaults to JSON lines, the other layers to Parquet.
    """
    fmt = fmt or ("json" if layer == "landing" else "parquet")
    return write_batch(df, layer_path(root, layer, source, dataset), ts, batch_id, fmt)
