"""Structured run logs: typed records, run metrics, and counts taken while a job runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strata.functions.expr import observed
from strata.sources.landing import CORRUPT, flag_bad_records

# The fields of a log record.
LOG_SCHEMA = (
    "timestamp string, level string, logger string, message string, module string, function string, "
    "line bigint, exception string, pipeline_name string, agent_type string, status string, duration_ms double"
)


def flag_json_logs(df: DataFrame, line_col: str) -> DataFrame:
    """Typed log records, with the text of bad lines in `_corrupt_record`; one scan and one parse.

    A record without a readable timestamp is a bad line too.
    """
    flagged = flag_bad_records(df.select(F.col(line_col), F.col(line_col).alias("_line")), line_col, LOG_SCHEMA)
    # ISO 8601 in UTC; a trailing Z is dropped so that the session time zone plays no part.
    stamp = F.regexp_replace("timestamp", r"Z\z", "").try_cast("timestamp_ntz")
    text = F.coalesce(CORRUPT, F.when(F.col("timestamp").isNull(), F.coalesce("_line", F.lit(""))))
    return flagged.withColumn("timestamp", stamp).withColumn(CORRUPT, text).drop("_line")


def parse_json_logs(df: DataFrame, line_col: str) -> tuple[DataFrame, DataFrame]:
    """(typed log records, bad lines), the two parts of `flag_json_logs`."""
    flagged = flag_json_logs(df, line_col)
    good = flagged.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, flagged.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def _same(left: str, right: str, names: Sequence[str]) -> Column:
    """Join condition on equal names that also matches nulls."""
    test = F.lit(True)
    for n in names:
        test = test & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return test


def _narrow(cells: DataFrame, by: Sequence[str], name: str, place: Column, p: float | None = None) -> DataFrame:
    """Cut every cell into bins and keep the bins that hold its wanted ranks.

    A cell has values `_v`, each `_n` times; `_skip` values lie below it, and `_at` is the wanted
    rank, which `p` gives for cells that are whole groups. Only counts per bin are put in order, and
    the few wanted bins are joined back to the values.
    """
    cells = cells.withColumn(name, place)
    whole = Window.partitionBy(*by)
    before = whole.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    bins = cells.groupBy(*by, name).agg(
        F.sum("_n").alias("_in"),
        F.min("_skip").alias("_below"),
        *([] if p is not None else [F.min("_at").alias("_at")]),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
    )
    bins = bins.withColumn("_skip", F.col("_below") + F.coalesce(F.sum("_in").over(before), F.lit(0)))
    if p is not None:
        bins = bins.withColumn("_at", (F.sum("_in").over(whole) - 1) * p)
    ends = F.col("_skip") + F.col("_in")
    holds = [(r >= F.col("_skip")) & (r < ends) for r in (F.floor("_at"), F.ceil("_at"))]
    wanted = bins.filter(holds[0] | holds[1])
    keys = [*by, name]
    return cells.alias("c").join(wanted.alias("w"), _same("c", "w", keys)).select(
        *[F.col(f"c.{k}").alias(k) for k in keys], "c._v", "c._n", "w._skip", "w._at", "w._low", "w._high"
    )


def exact_percentile(df: DataFrame, by: Sequence[str], value: str, p: float, name: str) -> DataFrame:
    """Exact interpolated percentile per group, also for a group with most of the rows.

    Equal values are counted first and cost one row. Bins by magnitude, then a thousand equal bins
    inside the one that holds the wanted rank, leave a small part of the values to be put in order.
    No task ever sorts all values of a large group. Nulls and NaN are left out.
    """
    counted = df.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return _percentile_of_counts(counted, by, p, name)


def _percentile_of_counts(counted: DataFrame, by: Sequence[str], p: float, name: str) -> DataFrame:
    """The percentile of values `_v` that occur `_n` times."""
    by = list(by)
    counted = counted.filter(F.col("_v").isNotNull() & ~F.isnan("_v")).select(*by, "_v", "_n")
    # Grows with the value: 16 bins per doubling, mirrored for negative values.
    size = F.floor(F.log2(F.abs(F.col("_v")) + 1) * 16)
    magnitude = F.when(F.col("_v") < 0, -size).otherwise(size)
    cells = _narrow(counted.withColumn("_skip", F.lit(0).cast("bigint")), by, "_magnitude", magnitude, p)
    width = F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    part = F.coalesce(F.floor((F.col("_v") - F.col("_low")) / width * 1000), F.lit(0))
    cells = _narrow(cells, [*by, "_magnitude"], "_part", part)

    inside = Window.partitionBy(*by, "_magnitude", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.withColumn("_upto", F.col("_skip") + F.sum("_n").over(inside))
    low, high = F.floor("_at"), F.ceil("_at")

    def at_rank(rank: Column) -> Column:
        here = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(here, F.col("_v")))

    share = F.max(F.col("_at") - low)
    return placed.groupBy(*by).agg((at_rank(low) + (at_rank(high) - at_rank(low)) * share).alias(name))


def run_metrics(logs: DataFrame, by: Sequence[str] = ("pipeline_name", "agent_type")) -> DataFrame:
    """Runs, errors, error rate, mean and 95th percentile of the duration, last status per group.

    The logs are read once: one aggregate per group and distinct duration carries all that the totals and the
    percentile need. Durations that are NaN are left out of the mean and the percentile.
    """
    by = list(by)
    failed = (F.col("level") == "ERROR") | F.coalesce(F.col("status").isin("error", "failed"), F.lit(False))
    counted = logs.groupBy(*by, F.col("duration_ms").cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(failed).alias("_failed"),
        F.max(F.struct("timestamp", "status")).alias("_last"),
    )
    timed = F.when(F.col("_v").isNotNull() & ~F.isnan("_v"), F.col("_n"))
    totals = counted.groupBy(*by).agg(
        F.sum("_n").alias("runs"),
        F.sum("_failed").alias("errors"),
        (F.sum(F.col("_v") * timed) / F.sum(timed)).alias("mean_ms"),
        F.max("_last").getField("status").alias("last_status"),
    )
    tail = _percentile_of_counts(counted, by, 0.95, "p95_ms")
    return (
        totals.alias("t")
        .join(tail.alias("p"), _same("t", "p", by), "left")
        .select(
            *[F.col(f"t.{k}").alias(k) for k in by],
            "runs",
            "errors",
            (F.col("errors") / F.col("runs")).alias("error_rate"),
            "mean_ms",
            "p95_ms",
            "last_status",
        )
    )


def with_summary(
    df: DataFrame, name: str = "summary", bad: Column | None = None
) -> tuple[DataFrame, Observation]:
    """Count records and errors while the frame is used, without a second pass over it."""
    observation = Observation(name)
    errors = F.count_if(bad) if bad is not None else F.sum(F.lit(0))
    counted = df.observe(
        observation, F.count(F.lit(1)).alias("records"), F.coalesce(errors, F.lit(0)).alias("error_count")
    )
    return counted, observation


def summary_of(observation: Observation, kind: str, errors: int = 0) -> dict:
    """The run result: `kind` is `fetched` or `processed`; `errors` were counted elsewhere. Waits for the action."""
    counts = {"records": 0, "error_count": 0} | observed(observation)
    counts["error_count"] += errors
    return {
        "status": "success",
        f"records_{kind}": counts["records"],
        "error_count": counts["error_count"],
        "message": f"{counts['records']} records {kind}, {counts['error_count']} errors",
    }
