"""Putting landed pages back into order: numbered pages and cursor chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.checkpoints import ensure_checkpoint_dir
from strata.functions.envelope import envelope_kind, envelope_records
from strata.functions.expr import once
from strata.operators.envelope import parsed


# Pages whose counts one window task adds up; totals of the blocks before it come from the level above.
BLOCK = 1000
# Links of cursor chains that are doubled as they are; of more, some are taken out first.
CONTRACT_ABOVE = 1_000_000


def stitch_pages(
    pages: DataFrame,
    max_pages: int | None = None,
    max_items: int | str | None = None,
    policy: str = "ingest",
    record_key: str | None = None,
) -> DataFrame:
    """`(source, page, body)` to one row per record `(source, page, item, complete, record)`.

    Pages count up from 1; those before the first page without records are kept, and at most `max_items`
    records per source (a number, or a column of `pages`; null: all), in page order. `item` is the 0-based position in
    the source. Of a page that landed more than once, the body that is first as text is taken. `complete` is
    false for a source with a missing or repeated page among the kept ones, one that ends at a body
    that holds no list of records, and one with records beyond `max_pages` (no limit by default).

    Offsets come from page *counts*, in two levels: totals of blocks of pages, then inside each block. So
    neither bodies nor counts of one large source meet in one task. The joins on the source have one
    row per source on their other side, and Spark can split hot sources there.
    """
    is_text = pages.schema["body"].dataType.typeName() != "variant"
    same = Window.partitionBy("source", "page")
    single = (
        pages.filter(F.col("page") >= 1)
        .withColumn("_copies", F.count(F.lit(1)).over(same))
        .withColumn("_nth", F.row_number().over(same.orderBy(F.col("body") if is_text else F.to_json("body"))))
        .filter("_nth = 1")
    )
    value = F.col("_body")
    found = F.struct(
        envelope_records(value, policy, record_key).alias("records"),
        (envelope_kind(value, policy, record_key) != "unexpected").alias("readable"),
    )
    bodies = once(once(single, "_body", parsed(pages, "body")).drop("body"), "_found", found).drop("_body", "_nth")
    n = F.greatest(F.coalesce(F.size("_found.records"), F.lit(0)), F.lit(0)).cast("bigint")
    counts = bodies.select("source", "page", n.alias("n"), (F.col("_copies") > 1).alias("repeated"), F.col("_found.readable").alias("readable"))

    inside = F.lit(True) if max_pages is None else F.col("page") <= max_pages
    empty = inside & (F.col("n") == 0)
    ends = counts.groupBy("source").agg(
        F.min(F.when(empty, F.col("page"))).alias("end"),
        F.coalesce(F.min_by("readable", F.when(empty, F.col("page"))), F.lit(True)).alias("sound_end"),
        F.max(~inside & (F.col("n") > 0)).alias("beyond"),
    )
    kept = counts.filter(inside).join(ends, "source").filter("end IS NULL OR page < end")
    states = kept.groupBy("source").agg(
        (
            (F.count(F.lit(1)) == F.max("page"))
            & ~F.max("repeated")
            & F.min("sound_end")
            & ~F.max(F.col("beyond") & F.col("end").isNull())
        ).alias("complete")
    )
    block = F.floor(F.col("page") / BLOCK).alias("block")
    totals = kept.groupBy("source", block).agg(F.sum("n").alias("total"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("source", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("source", "block").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        kept.select("source", "page", "n", block)
        .join(bases, ["source", "block"])
        .select("source", "page", (F.col("base") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("first_item"))
        .join(states, "source")
    )
    out = bodies.join(placed, ["source", "page"])
    records = F.col("_found.records")
    if max_items is not None:
        cap = F.col(max_items) if isinstance(max_items, str) else F.lit(max_items)
        out = out.filter(cap.isNull() | (F.col("first_item") < cap))
        room = F.least(cap - F.col("first_item"), F.size(records)).cast("int")
        records = F.slice(records, F.lit(1), room)
    keep = [c for c in pages.columns if c not in ("source", "page", "body")]
    return out.select(
        "source", "page", *keep, "complete", "first_item", F.posexplode(records).alias("at", "record")
    ).select(
        "source", "page", *keep, (F.col("first_item") + F.col("at")).alias("item"), "complete", "record"
    )


def _between(first: Column) -> Column:
    """Whether a page stands between others: it is not the first, and leads to another page."""
    return (F.col("c") != first) & (F.col("c") != F.col("t"))


def _take_out(links: DataFrame, first: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """Links without some pages, and those pages with the link that led to each (`before`, `c`, `w`).

    A page goes if its own coin of round `k` shows heads and that of its target tails, so a page and its target never go
    together. First pages stay, and so do pages without a target.
    """
    heads = lambda c: F.pmod(F.xxhash64("s", c, F.lit(k)), F.lit(2)) == 0
    going = heads(F.col("c")) & ~heads(F.col("t")) & _between(first)
    gone = links.filter(going).select("s", F.col("c").alias("t"), F.col("t").alias("after"), F.col("w").alias("more"))
    joined = links.filter(~F.coalesce(going, F.lit(False))).join(gone, ["s", "t"], "left").checkpoint()
    out = joined.filter("after is not null").select("s", F.col("c").alias("before"), F.col("t").alias("c"), "w")
    rest = joined.select("s", "c", F.coalesce("after", "t").alias("t"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
    return rest, out


def _double(links: DataFrame, first: Column) -> DataFrame:
    """`s`, `at`, `position` of all that first pages reach over weighted links, by doubling of jumps."""
    longest = links.groupBy("s").count().agg(F.max("count")).first()[0] or 0
    jumps = links.filter("t is not null").checkpoint()
    reached = links.filter(F.col("c") == first).select("s", F.col("c").alias("at"), F.lit(0).cast("bigint").alias("position")).checkpoint()
    step = 1
    while step <= longest and not jumps.isEmpty():
        movers = reached.select("s", F.col("at").alias("key"), "position", F.lit(None).cast("string").alias("c"), F.lit(0).alias("so_far"))
        doubled = jumps.select("s", F.col("t").alias("key"), F.lit(None).cast("bigint").alias("position"), "c", F.col("w").alias("so_far"))
        moved = movers.unionByName(doubled).join(jumps.select("s", F.col("c").alias("key"), "t", "w"), ["s", "key"]).checkpoint()
        ahead = moved.filter("position is not null").select("s", F.col("t").alias("at"), (F.col("position") + F.col("w")).alias("position"))
        # A chain that loops comes past a page again: its first visit counts.
        reached = reached.unionByName(ahead).groupBy("s", "at").agg(F.min("position").alias("position"))
        reached = reached.checkpoint()
        jumps = moved.filter("c is not null").select("s", "c", "t", (F.col("so_far") + F.col("w")).alias("w"))
        step *= 2
    return reached


def stitch_cursor_pages(
    pages: DataFrame,
    cursor_col: str = "cursor",
    next_col: str = "next_cursor",
    source_col: str = "source",
    start: str | None = None,
    keep_missing: bool = False,
    contract_above: int = CONTRACT_ABOVE,
) -> DataFrame:
    """Order landed cursor pages by following `next_cursor`, for many sources at once.

    The first page of a source is the one whose cursor is null (or equals `start`). Adds `position`,
    counted from 0. Pages that the chain does not reach are left out. With `keep_missing`, a cursor
    that leads to a page that never landed stays as a row with `landed` = false.

    While there are more than `contract_above` links, rounds take pages out: about a quarter of those left, no two of them
    neighbours, each leaving its predecessors with a longer link. So all these rounds together shuffle a small
    multiple of the links. What is left takes about log2(n) rounds of doubling for chains of n pages: in round k every reached
    page jumps 2^k links ahead and every jump is doubled, both in one join. Then the pages taken out get their places from
    their predecessors, last round first. All joins are on (source, cursor). That key is unique, so a source with very
    many pages is not a hot key. Each round is cut by a reliable checkpoint.
    """
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    first = F.lit("") if start is None else F.lit(start).cast("string")
    cursor = F.coalesce(F.col(cursor_col).cast("string"), F.lit("")) if start is None else F.col(
        cursor_col
    ).cast("string")
    target = F.nullif(F.col(next_col).cast("string"), F.lit(""))
    links = (
        pages.select(F.col(source_col).alias("s"), cursor.alias("c"), target.alias("t"))
        .groupBy("s", "c")
        .agg(F.min("t").alias("t"))
    )
    taken = []
    links = links.withColumn("w", F.lit(1).cast("bigint")).checkpoint()
    while links.filter(_between(first)).count() > contract_above:
        links, out = _take_out(links, first, len(taken))
        taken.append(out)
    reached = _double(links, first)
    for out in reversed(taken):
        before = reached.select("s", F.col("at").alias("before"), "position")
        placed = out.join(before, ["s", "before"]).groupBy("s", F.col("c").alias("at")).agg(F.min(F.col("position") + F.col("w")).alias("position"))
        reached = reached.unionByName(placed).checkpoint()
    keyed = pages.withColumn("_at", cursor).withColumnRenamed(source_col, "_s")
    order = reached.select(F.col("s").alias("_s"), F.col("at").alias("_at"), "position")
    joined = order.join(keyed.withColumn("landed", F.lit(True)), ["_s", "_at"], "left" if keep_missing else "inner")
    columns = [F.col("_s").alias(source_col) if c == source_col else F.col(c) for c in pages.columns]
    if not keep_missing:
        return joined.select(*columns, "position")
    columns = [
        F.coalesce(F.col(c), F.col("_at")).alias(c) if c == cursor_col and start is not None else col
        for c, col in zip(pages.columns, columns, strict=True)
    ]
    return joined.select(*columns, "position", F.coalesce("landed", F.lit(False)).alias("landed"))
