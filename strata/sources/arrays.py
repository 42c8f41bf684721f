"""JSON files that are one array each, cut into their elements by many tasks.

A border between elements is a `}` outside texts that leaves only the array open. Whether a place lies in a text, and how
deep, depends on all that comes before it, yet composes: what a range of bytes does to both is known for either way of
entering it. So tasks scan ranges on their own, a running total over ranges (one row each) gives each its true start, and
then every range knows its borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.checkpoints import ensure_checkpoint_dir

_RANGE = ["_file", "_range"]
_SPACE = "[ \\t\\r\\n]*"
_OPENING = f"\\A\\uFEFF?{_SPACE}\\[{_SPACE}"


def _depth(text):
    """Opened less closed brackets; the closing braces are where pieces end and count there."""
    return F.length(F.translate(text, "]", "")) - F.length(F.translate(text, "[{", ""))


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Text up to each `}`, in order within each range of a file, with what its range so far does to quotes and depth.

    `_depth0` holds if the range begins outside texts, `_depth1` if it begins within one; `_odd` is whether the range has
    had an odd number of quotes. Brackets within texts do not count, escaped quotes are no quotes.
    """
    rows = spark.read.option("lineSep", "}").text(paths)
    place = {"_file": "_metadata.file_path", "_range": "_metadata.file_block_start", "_size": "_metadata.file_size"}
    rows = rows.withColumns({n: F.col(c) for n, c in place.items()}).withColumn("_at", F.monotonically_increasing_id())
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    texts = r'"[^"]*("|\z)'
    # What is within texts for one way of entering the piece is outside for the other, so the two add up to the whole.
    outside = _depth(F.regexp_replace(bare, texts, ""))
    rows = rows.withColumns(
        {
            "_quotes": F.length(bare) - F.length(F.translate(bare, '"', "")),
            "_out": outside,
            "_in": _depth(bare) - outside,
            "_opening": (F.col("_range") == 0) & F.col("value").rlike(_OPENING),
            "_octets": F.octet_length("value"),
        }
    )
    order = Window.partitionBy(*_RANGE).orderBy("_at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_odd", F.pmod(F.sum("_quotes").over(so_far), F.lit(2)))
    rows = rows.withColumn("_was", F.pmod(F.col("_odd") - F.col("_quotes"), F.lit(2)))
    for k in (0, 1):
        change = F.when(F.col("_was") == k, F.col("_out")).otherwise(F.col("_in")) - F.when(F.col("_odd") == k, 1).otherwise(0)
        rows = rows.withColumn(f"_change{k}", change).withColumn(f"_depth{k}", F.sum(f"_change{k}").over(so_far))
    return rows.withColumns({"_first": F.lag("_at").over(order).isNull(), "_last": F.lead("_at").over(order).isNull()})


def _here(name: str):
    """The column for the way in which the range really begins."""
    return F.when(F.col("_start") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))


def _is_border():
    return F.col("_array") & (F.col("_odd") == F.col("_start")) & (F.col("_base") + _here("_depth") == 1)


def _ranges(pieces: DataFrame) -> DataFrame:
    """One row for each range: how it begins (`_start`, `_base`), elements before it, and what its file is."""
    opens = F.col("_first") & F.col("_opening")
    counts = pieces.groupBy(*_RANGE, "_odd", "_depth0", "_depth1").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_quotes").alias("_quotes"),
        F.sum("_change0").alias("_change0"),
        F.sum("_change1").alias("_change1"),
        F.sum(F.col("_octets") + 1).alias("_bytes"),
        F.max("_size").alias("_size"),
        F.max(opens).alias("_opens"),
    )
    ensure_checkpoint_dir(pieces.sparkSession)
    counts = counts.checkpoint()
    names = ["_quotes", "_change0", "_change1", "_bytes"]
    totals = counts.groupBy(*_RANGE).agg(*[F.sum(n).alias(n) for n in names], F.max("_size").alias("_size"), F.max("_opens").alias("_opens"))
    before = Window.partitionBy("_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_file")

    def ahead(name):
        return F.coalesce(F.sum(name).over(before), F.lit(0))

    starts = (
        totals.withColumn("_start", F.pmod(ahead("_quotes"), F.lit(2)))
        .withColumn("_change", _here("_change"))
        .withColumn("_base", ahead("_change"))
        .select(
            *_RANGE,
            "_start",
            "_base",
            F.max("_opens").over(whole).alias("_array"),
            # The last piece of a file that does not end with a brace has no brace after it.
            (F.sum("_bytes").over(whole) != F.col("_size") + 1).alias("_closed"),
            F.max("_range").over(whole).alias("_end"),
        )
    )
    borders = counts.join(starts, _RANGE).groupBy(*_RANGE).agg(F.sum(F.when(_is_border(), F.col("_n")).otherwise(0)).alias("_borders"))
    return starts.join(borders, _RANGE).withColumn("_elements", ahead("_borders")).drop("_borders")


def read_array_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each element of each file, as JSON text in `body`, with the partition columns of the path.

    Elements are objects. Anything else in the array comes, as text, with the object after it; what is left after the last
    object (other elements, or the rest of a file cut off) is a row of its own that is not JSON. A file that is no array is
    one row, blank ones and empty arrays have none. A missing comma is not noticed. A file with several ranges, so beyond
    `spark.sql.files.maxPartitionBytes`, is read by several tasks; compressed files are read by one each.

    Files are read twice, and one row a range and depth is checkpointed between; text is shuffled by range, then by element.
    """
    paths = list(dict.fromkeys([path] if isinstance(path, str) else path))
    pieces = _pieces(spark, paths)
    others = [c for c in pieces.columns if c != "value" and not c.startswith("_")]
    so_far = Window.partitionBy(*_RANGE).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = (_is_border() & ~(F.col("_last") & (F.col("_range") == F.col("_end")))).cast("int")
    numbered = (
        pieces.join(_ranges(pieces), _RANGE)
        .withColumn("_border", border)
        .withColumn("_element", F.col("_elements") + F.sum("_border").over(so_far) - F.col("_border"))
    )
    elements = numbered.groupBy("_file", "_element").agg(
        F.sort_array(F.collect_list(F.struct("_range", "_at", "value"))).alias("_texts"),
        F.max("_border").alias("_whole"),
        F.max("_array").alias("_array"),
        F.max("_closed").alias("_closed"),
        *[F.first(c).alias(c) for c in others],
    )
    braced = (F.col("_whole") == 1) | (~F.col("_array") & F.col("_closed"))
    text = F.concat(F.array_join(F.col("_texts.value"), "}"), F.when(braced, "}").otherwise(""))
    lead = F.when(F.col("_element") == 0, F.regexp_replace(text, _OPENING, "")).otherwise(F.regexp_replace(text, f"\\A{_SPACE},{_SPACE}", ""))
    body = F.when(F.col("_array"), lead).otherwise(text)
    rest = F.col("_array") & (F.col("_whole") == 0) & F.col("body").rlike(f"\\A{_SPACE}\\]{_SPACE}\\z")
    blank = F.col("body").rlike(f"\\A\\uFEFF?{_SPACE}\\z")
    return elements.withColumn("body", body).where(~rest & ~blank).select("body", *others)
