"""Reading the landing layer: files in four formats, bad records, listings and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.expr import once
from strata.sinks.layers import complete_batches
from strata.sources.arrays import read_array_elements
from strata.sources.listing import check_files, list_files

FORMATS = ("json", "xml", "csv", "parquet")
CORRUPT = "_corrupt_record"


def format_of(path: str, default: str = "json") -> str:
    """Format by file extension; anything else is the default."""
    extension = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    return extension if extension in FORMATS else default


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_landing(
    spark: SparkSession,
    path: str | list[str],
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    row_tag: str | None = None,
    lines: bool = True,
    on_bad: str = "fail",
    raw: bool = False,
    skipped: Observation | None = None,
    split: bool = False,
    base: str | None = None,
) -> DataFrame:
    """Every file under a prefix, sub-folders and their Hive partitions included.

    Without `fmt` the format is taken from the file extension, else JSON. JSON files hold one value per line, which
    Spark can split; with `lines=False` each file is one value (a list gives one row per element), read by
    one task. With `split` as well, files that are lists of objects are cut at the borders of elements and read by many tasks
    (see `read_array_elements`); this needs a schema or `raw`, which then gives each element's text as `body`. `on_bad`: `fail` stops, `quarantine` keeps bad records in the column `_corrupt_record` for
    `split_corrupt`, `skip` drops them and counts them in the observation `skipped` (as `bad_records`), which it
    needs, as it needs a schema unless the format is Parquet. Unreadable files stop the read; `read_checked` leaves them
    out and tells which. `base` is the prefix of partition folders where the paths lie deeper. `raw` gives each file's text (or line) as `body`, for `unwrap_envelope`.
    """
    if on_bad not in ("fail", "skip", "quarantine"):
        raise ValueError(f"unknown on_bad: {on_bad}")
    paths = [path] if isinstance(path, str) else list(path)
    if split and (lines or (fmt or format_of(paths[0])) != "json" or (schema is None and not raw)):
        raise ValueError("splitting is for JSON with lines=False, and needs a schema or raw")
    if split:
        return _elements(spark, paths, schema, on_bad, skipped, raw)
    based = spark.read.option("basePath", base) if base else spark.read
    if raw:
        return based.text(paths, wholetext=not lines).withColumnRenamed("value", "body")
    fmt = fmt or format_of(paths[0])
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    reader = based.format(fmt)
    if on_bad == "skip" and fmt != "parquet" and (skipped is None or schema is None):
        raise ValueError("skipping bad records needs a schema and an observation that counts them")
    if fmt != "parquet":
        mode = "FAILFAST" if on_bad == "fail" else "PERMISSIVE"
        reader = reader.option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT)
    if fmt == "json":
        reader = reader.option("multiLine", str(not lines).lower())
    if fmt == "csv":
        reader = reader.option("header", "true")
    if fmt == "xml":
        if not row_tag:
            raise ValueError("XML needs row_tag, the element that is one row")
        reader = reader.option("rowTag", row_tag)
    if schema is not None:
        fields = _struct(schema)
        if on_bad != "fail" and fmt != "parquet" and CORRUPT not in fields.names:
            fields = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.schema(fields)
    rows = reader.load(paths)
    if on_bad == "skip" and CORRUPT in rows.columns:
        rows = rows.observe(skipped, F.count(CORRUPT).alias("bad_records")).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return rows


def read_checked(spark: SparkSession, path: str, fmt: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """`read_landing` of the files that can be read, and those that cannot: (path, size, modified, reason).

    Files are checked first (see `check_files`), the names of good ones go to the driver, as for any scan, and are then read
    without leave to skip anything: a file that is damaged where the check does not look stops the read. Options are those of
    `read_landing`, but for `split`. Where no file is good there are no rows, which needs a schema.
    """
    fmt = fmt or format_of(path)
    checked = check_files(list_files(spark, path), fmt).checkpoint()
    refused = checked.where("reason IS NOT NULL")
    good = [r["path"] for r in checked.where("reason IS NULL").select("path").orderBy("path").toLocalIterator()]
    if good:
        return read_landing(spark, good, fmt, base=path, **options), refused
    if options.get("schema") is None:
        raise ValueError(f"no file below {path} can be read, and no schema is given")
    return spark.createDataFrame([], _struct(options["schema"])), refused


def read_batches(spark: SparkSession, path: str, fmt: str = "parquet", batches: list[str] | None = None, **options) -> DataFrame:
    """`read_landing` of the complete batches of a dataset, or of those named: what unfinished runs left is not read.

    The folders come from the records of `write_batch`, so nothing is listed but them. Without any complete batch there
    are no rows, which needs a schema; a batch that is named and not complete is an error.
    """
    complete = complete_batches(spark, path)
    absent = sorted(set(batches or ()) - set(complete))
    if absent:
        raise ValueError(f"batches that are not complete: {absent}")
    folders = [f"{path}/{f}" for b in (complete if batches is None else dict.fromkeys(batches)) for f in complete[b]]
    if folders:
        return read_landing(spark, folders, fmt, base=path, **options)
    if options.get("schema") is None:
        raise ValueError(f"no complete batch below {path}, and no schema is given")
    return spark.createDataFrame([], _struct(options["schema"]))


def _elements(spark, paths, schema, on_bad, skipped, raw) -> DataFrame:
    texts = read_array_elements(spark, paths)
    if raw:
        return texts
    if on_bad == "skip" and skipped is None:
        raise ValueError("skipping bad records needs an observation that counts them")
    others = [c for c in texts.columns if c != "body"]
    names = [f.name for f in _struct(schema).fields if f.name != CORRUPT]
    # As in the other formats, the columns of the path come last, and win over fields of their names.
    flagged = flag_bad_records(texts.select("body", F.struct(F.lit(0).alias("_"), *others).alias("_path")), "body", schema)
    rows = flagged.select(*[n for n in names if n not in others], CORRUPT, *[F.col("_path")[c].alias(c) for c in others])
    if on_bad == "quarantine":
        return rows
    if on_bad == "skip":
        return rows.observe(skipped, F.count(CORRUPT).alias("bad_records")).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    told = F.raise_error(F.concat(F.lit("bad record: "), F.left(CORRUPT, F.lit(200)))).cast("boolean")
    return rows.filter(F.when(F.col(CORRUPT).isNull(), F.lit(True)).otherwise(told)).drop(CORRUPT)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a frame read with `on_bad="quarantine"` into good rows and bad records."""
    if CORRUPT not in df.columns:
        return df, df.sparkSession.createDataFrame([], f"{CORRUPT} string")
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull())


def flag_bad_records(df: DataFrame, line_col: str, schema: T.StructType | str) -> DataFrame:
    """Parse a column of JSON text in place; `_corrupt_record` holds the text of bad rows and is null for good ones.

    Bad is: not JSON, blank, null (then the text is empty), or a field that does not fit its type. One scan, one
    parse; a write partitioned by `_corrupt_record is null` splits it in one pass.
    """
    fields = T.StructType([*_struct(schema).fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    marked = once(df, "_parsed", F.from_json(F.col(line_col), fields, options))
    parsed = F.col("_parsed")
    text = F.coalesce(F.col(line_col), F.lit(""))
    bad = parsed.isNull() | parsed[CORRUPT].isNotNull() | (F.trim(text) == "")
    others = [c for c in df.columns if c != line_col]
    names = [f.name for f in fields.fields if f.name != CORRUPT]
    return marked.select(*others, *[parsed[n].alias(n) for n in names], F.when(bad, text).alias(CORRUPT))


def split_bad_records(
    df: DataFrame, line_col: str, schema: T.StructType | str
) -> tuple[DataFrame, DataFrame]:
    """The flagged frame as two: good rows have the fields, bad rows keep the text. Other columns stay in both."""
    flagged = flag_bad_records(df, line_col, schema)
    others = [c for c in df.columns if c != line_col]
    good = flagged.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, flagged.filter(F.col(CORRUPT).isNotNull()).select(*others, CORRUPT)


# The levels of the lake layout.
LEVELS = ("layer", "source", "dataset", "year", "month", "day")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, size, time and the partition values in its path. Reads no contents; executors list."""
    files = list_files(spark, path)
    levels = {
        level: F.nullif(F.regexp_extract("path", rf"/{level}=([^/]+)/", 1), F.lit("")) for level in LEVELS
    }
    return files.withColumns(levels)


def inventory_stats(files: DataFrame) -> DataFrame:
    """Files, bytes, days and the newest file per dataset."""
    day = F.concat_ws("-", "year", "month", "day")
    return files.groupBy("layer", "source", "dataset").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.countDistinct(F.when(day != "", day)).alias("days"),
        F.max("modified").alias("newest"),
    )


def sample_text(
    df: DataFrame, text_col: str, n: int = 5000, per: list[str] | None = None, order_by: str | None = None
) -> DataFrame:
    """The first `n` characters of every row, or of the first row per group.

    `per=[]` samples the first row of the whole frame. The text is cut before it is shuffled, and
    the minimum is taken in each map task first.
    """
    cut = df.withColumn(text_col, F.substring(F.col(text_col), 1, n))
    if per is None:
        return cut
    if order_by is None:
        raise ValueError("a sample per group needs order_by")
    first = F.min(F.struct(F.col(order_by), F.col(text_col))).alias("_first")
    return cut.groupBy(*per).agg(first).select(*per, f"_first.{order_by}", f"_first.{text_col}")
