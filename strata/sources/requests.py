"""From source configurations to the HTTP requests they need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.expr import trim_all

# Defaults and limits of paging.
PAGE_SIZE = 100
MAX_LIMIT = 1000
OFFSET_TYPES = ("offset", "offset_limit")
PAGING_TYPES = ("offset", "offset_limit", "cursor", "page", "none")

#: Requests that are planned at first for a source whose end is not known.
WAVE = 100

_DEFAULTS = {
    "offset_param": "string",
    "limit_param": "string",
    "limit_value": "int",
    "max_items": "bigint",
    "page_param": "string",
    "max_pages": "int",
    "params": "map<string,string>",
    "done_pages": "bigint",
}


def plan_requests(sources: DataFrame, first: int = 1, wave: int = WAVE) -> DataFrame:
    """One row per request: `(source_id, seq, params, last, ...)`, `seq` counting from 1.

    `offset` and `offset_limit` step by the page size and stop at `max_items`, clipping the last limit; `page`
    counts pages; `none` and `cursor` give one request, as the next cursor is only known after the answer.
    Static params are merged in, paging params win. A source with `max_items` or `max_pages` gets all its
    requests from `first` on; one without a known end gets the next `wave` of them, and `last` is null for it
    (`read_paged` goes on wave by wave). `done_pages` are not asked for again: `seq` 1 is the page after them. Columns of the sources that paging does not use are carried along.
    """
    absent = {n: F.lit(None).cast(t) for n, t in _DEFAULTS.items() if n not in sources.columns}
    df = sources.withColumns(absent) if absent else sources
    offset = F.col("type").isin(*OFFSET_TYPES)
    paged = offset | (F.col("type") == "page")
    problem = (
        F.when(~F.coalesce(F.col("type").isin(*PAGING_TYPES), F.lit(False)), "unknown paging type")
        .when(offset & (trim_all(F.coalesce("offset_param", F.lit(""))) == ""), "offset_param is required for offset paging")
        .when(~F.col("limit_value").between(1, MAX_LIMIT), f"limit_value must be from 1 to {MAX_LIMIT}")
        .when(F.col("max_items") <= 0, "max_items must be above 0")
        .when(F.col("max_pages") <= 0, "max_pages must be above 0")
    )
    size = F.coalesce(F.col("limit_value"), F.lit(PAGE_SIZE)).cast("bigint")
    by_items = F.ceil(F.col("max_items") / size)
    done = F.coalesce("done_pages", F.lit(0))
    n = F.when(paged, F.greatest(F.least(by_items, F.col("max_pages").cast("bigint")) - done, F.when(F.coalesce("max_items", "max_pages").isNotNull(), 0))).otherwise(F.lit(1).cast("bigint"))
    checked = F.when(
        problem.isNotNull(),
        F.raise_error(F.concat_ws(": ", F.col("source_id").cast("string"), problem)).cast("bigint"),
    ).otherwise(n)

    number = F.col("seq") + done
    start = (number - 1) * size
    limit = F.least(size, F.coalesce(F.col("max_items") - start, size))
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def one(name, value):
        return F.create_map(name, value.cast("string"))

    limit_pair = F.when(F.col("limit_param").isNotNull(), one(F.col("limit_param"), limit)).otherwise(nothing)
    paging = (
        F.when(offset, F.map_concat(one(F.col("offset_param"), start), limit_pair))
        .when(
            F.col("type") == "page",
            F.map_concat(
                one(F.coalesce("page_param", F.lit("page")), number),
                one(F.coalesce("limit_param", F.lit("per_page")), size),
            ),
        )
        .otherwise(nothing)
    )
    ahead = F.coalesce("last", F.lit(first + wave - 1).cast("bigint"))
    steps = F.when(ahead >= first, F.sequence(F.lit(first).cast("bigint"), ahead)).otherwise(F.array().cast("array<bigint>"))
    carried = [c for c in sources.columns if c not in (*_DEFAULTS, "source_id", "type", "seq", "last")]
    return (
        df.withColumn("last", checked)
        .withColumn("seq", F.explode(steps))
        .withColumn("paging", paging)
        .withColumn("static", F.coalesce("params", nothing))
        .select(
            "source_id",
            "seq",
            F.map_concat(
                F.map_filter("static", lambda k, _: ~F.map_contains_key("paging", k)), "paging"
            ).alias("params"),
            "last",
            *carried,
        )
    )
