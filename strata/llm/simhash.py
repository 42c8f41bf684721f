"""Near-duplicates by SimHash: 64-bit fingerprints of word shingles, linked through covering masks."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.components import connected_components, cut
from strata.llm.texts import map_texts

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Distinct fingerprints of a bucket that one task compares in memory; larger buckets go through flipped bits.
IN_TASK = 16_384

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint_values(texts: list[str | None]) -> np.ndarray:
    """Signed 64-bit fingerprints; null texts and texts without words give zero."""
    hashes, counts = [np.zeros(0, np.uint64)], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(words) >= SHINGLE:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
            found = np.fromiter(map(_hash, shingles), np.uint64, len(words) - SHINGLE + 1)
        else:
            found = np.array([_hash(b" ".join(words))] if words else [], dtype=np.uint64)
        hashes.append(found)
        counts.append(len(found))
    counts = np.array(counts, dtype=np.int64)
    result = np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        bits = np.unpackbits(np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        majority = (2 * set_in > counts[some, None]).astype(np.uint8)
        result[some] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
    return result.view(np.int64)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without its text, with `bits`, the fingerprint as a long."""
    return map_texts(docs, text, "bits long", lambda: lambda texts: [pa.array(fingerprint_values(texts))], drop_text=True)


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks over 64 bits; any two values at most `radius` bits apart agree under one of them.

    Bit i gets the non-zero vector i mod (2^(radius+1) - 1) + 1. A mask keeps the bits whose vector has an odd
    product with the mask's own vector. The vectors of up to `radius` bits always have a common orthogonal
    vector, so the mask of that one keeps none of the differing bits.
    """
    top = 2 ** (radius + 1)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return [
        signed(sum(1 << i for i in range(64) if ((i % (top - 1) + 1) & vector).bit_count() % 2)) for vector in range(1, top)
    ]


def _stars(radius: int):
    """Per bucket, a spanning forest of its fingerprints: (fingerprint, one that it is linked to)."""

    def run(batches):
        for batch in batches:
            left, right = [], []
            for values in batch.column("members"):
                rest = np.unique(np.asarray(values.values, dtype=np.int64)).view(np.uint64)
                while len(rest) > 1:
                    todo, rest = [rest[0]], rest[1:]
                    while todo and len(rest):
                        at = todo.pop()
                        near = np.bitwise_count(rest ^ at) <= radius
                        if near.any():
                            found, rest = rest[near], rest[~near]
                            left += found.view(np.int64).tolist()
                            right += [int(at.view(np.int64))] * len(found)
                            todo += list(found)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _flipped(members: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links in buckets of any size: two values at most 3 bits apart meet at a value one flip from one of them and
    at most two from the other. Rows grow with the members, not with their square.
    """
    if radius > 3:
        raise ValueError("buckets beyond IN_TASK need a radius of 3 or less")
    singles = F.array(*[F.array(*[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64) if not (m >> i) & 1]) for m in masks])
    free = members.select("table", "bits", F.get(singles, F.col("table")).alias("flips"))
    one = free.select("bits", F.explode(F.concat(F.array(F.lit(0).cast("long")), "flips")).alias("flip"))
    one = one.select("bits", F.col("bits").bitwiseXOR(F.col("flip")).alias("meet"))
    hubs = cut(one.groupBy("meet").agg(F.min("bits").alias("hub")))
    two = free.select("bits", "flips", F.posexplode("flips").alias("i", "first"))
    two = two.select("bits", "first", F.explode(F.expr("slice(flips, i + 2, size(flips))")).alias("second"))
    two = two.select("bits", F.col("bits").bitwiseXOR(F.col("first")).bitwiseXOR(F.col("second")).alias("meet"))
    return one.unionByName(two).join(hubs, "meet").where("bits != hub").select(F.col("bits").alias("a"), F.col("hub").alias("b")).distinct()


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, in_task: int = IN_TASK) -> DataFrame:
    """`a`, `b`: links between different values of `bits`, enough of them to connect all within `radius` bits."""
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    keyed = distinct.where("bits IS NOT NULL").select("bits", F.inline(tables))
    shared = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(keyed.join(shared, ["table", "key"]))
    groups = members.where(F.col("n") <= in_task).groupBy("table", "key").agg(F.collect_list("bits").alias("members"))
    links = groups.select("members").mapInArrow(_stars(radius), "a long, b long").distinct()
    large = members.where(F.col("n") > in_task)
    return links if large.isEmpty() else links.unionByName(_flipped(large, masks, radius))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, in_task: int = IN_TASK) -> DataFrame:
    """One row per document: `doc_id`, `fingerprint` (16 hex digits), `component_id`.

    component_id is the smallest doc_id that links reach, the document itself included. Copies share a
    fingerprint and are one node, whatever their number. Documents without words (null text too) have fingerprint
    zero and are linked like any other. Rows with a null doc_id take part; a group of only such rows has a null
    component_id. Repeated rows stay repeated.
    """
    marked = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    nodes = marked.groupBy("bits").agg(F.min("doc_id").alias("first"))
    placed = _rooted(nodes, radius, in_task)
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    found = placed.join(lowest, "root").select("bits", "component_id")
    return marked.join(found, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def _rooted(nodes: DataFrame, radius: int, in_task: int) -> DataFrame:
    """Different fingerprints (`bits`) with `root`, a fingerprint for each group that links connect."""
    roots = connected_components(link_fingerprints(nodes.select("bits"), radius, in_task)).withColumnRenamed("node", "bits")
    return nodes.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with one left of each near-duplicate group: the smallest by (id, hash of the text). All columns stay.

    A row goes only where another row of its own group stays, so rows that share an id but not a text are judged
    each in its own group; of equal rows one is left. Rows without an id are kept.
    """
    key = F.struct(F.col(doc_id).alias("id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("hash"))
    marked = cut(fingerprints(docs.select(key.alias("__key"), F.col(text).alias("text"))))
    groups = _rooted(marked.select("bits").distinct(), RADIUS, IN_TASK)
    named = marked.where("__key.id IS NOT NULL").groupBy("bits").agg(F.min("__key").alias("__key"))
    kept = named.join(groups, "bits").groupBy("root").agg(F.min("__key").alias("__key")).select("__key")
    # Equal rows are cut to one by each task before they move.
    once = docs.where(F.col(doc_id).isNotNull()).withColumn("__key", key)
    once = once.withColumn("__copy", F.row_number().over(Window.partitionBy("__key").orderBy("__key"))).where("__copy = 1")
    return once.join(kept, "__key", "left_semi").drop("__key", "__copy").unionByName(docs.where(F.col(doc_id).isNull()))
