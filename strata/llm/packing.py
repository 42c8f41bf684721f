"""Packing of tokenised documents into sequences of a fixed length by exact complements, then best fit."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.bpe import encoder
from strata.llm.components import cut
from strata.llm.texts import slices

LENGTH = 2048


@dataclass
class Plan:
    """Where the pieces of each length go, as runs of ranks: the pieces of `length` with ranks from `first` on take
    place `offset` of the sequences from `sequence` on, one each.
    """

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


class SumIndex:
    """Available lengths by the sums they add up to: singles, pairs and triples.

    Counts only fall, so an entry that was found short of pieces never comes back. Each sum keeps its pairs in order of
    their shorter part, and where its first pair stands that may still be had; for triples it keeps the longest
    part that may still be had, the other two being a pair of what is left. Looking up a sum retires what is used up, so
    each entry is passed over once in all.
    """

    def __init__(self, counts: np.ndarray):
        self.left = np.array(counts, dtype=np.int64)
        there = self.left > 0
        #: The shorter parts of the pairs of each sum.
        self.pairs = [np.flatnonzero(there[: s // 2 + 1] & there[s - s // 2 : s + 1][::-1]) for s in range(len(there))]
        self.at = [0] * len(there)
        self.longest = [s - 2 for s in range(len(there))]

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.left[total] else None

    def pair(self, total: int, without: int = 0) -> tuple[int, int] | None:
        """The pair with the longest first part, while one piece of the length `without` is put aside."""
        left, lows, first = self.left, self.pairs[total], True
        for k in range(self.at[total], len(lows)):
            low = int(lows[k])
            high = total - low
            if left[high] and left[low] > (low == high):
                need = (low == without) + (high == without)
                if not need or left[without] > need:
                    return high, low
                first = False  # it may be had another time
            elif first:
                self.at[total] = k + 1
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        for a in range(self.longest[total], 0, -1):
            pair = self.pair(total - a, a) if self.left[a] else None
            if pair:
                return a, *pair
            self.longest[total] = a - 1
        return None

    def exact(self, total: int) -> tuple[int, ...] | None:
        """One, two or three available lengths with the sum `total`, the longest first part preferred."""
        return self.single(total) or self.pair(total) or self.triple(total)


def plan_packing(counts: np.ndarray, capacity: int) -> Plan:
    """Plan from the number of pieces of each length (`counts[n]`), longest first.

    The gap that a piece leaves is filled by one, two or three available lengths that add up to it, found in
    the index of sums; if there are none, the longest length that fits goes in and the rest of the gap is tried
    again. A combination is used as often as its lengths are available, so each step uses a length up (all
    but its last piece or two): the work, like the size of the index, depends on the capacity and not on the number of
    pieces.
    """
    index = SumIndex(counts)
    left = index.left
    taken = np.zeros(capacity + 1, dtype=np.int64)
    runs, sequences = [], 0
    for length in range(capacity, 0, -1):
        while left[length]:
            left[length] -= 1
            parts, gap = [length], capacity - length
            while gap:
                fill = index.exact(gap)
                if fill is None:
                    fits = np.flatnonzero(left[1 : gap + 1])
                    if not len(fits):
                        break
                    fill = (int(fits[-1]) + 1,)
                for x in fill:
                    left[x] -= 1
                    gap -= x
                parts += fill
            sizes, needs = np.unique(parts, return_counts=True)
            times = 1 + int((left[sizes] // needs).min())
            left[sizes] -= (times - 1) * needs
            offset = 0
            for x in parts:
                runs.append((x, taken[x], sequences, offset))
                taken[x] += times
                offset += x
            sequences += times
    runs.sort()
    columns = np.array(runs, dtype=np.int64).reshape(-1, 4).T
    return Plan(*columns, sequences)


def cut_pieces(docs: DataFrame, text: str, doc_id: str, vocabulary: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Each document's pieces, each with its rank among those of its length in its task."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long" + (", ids array<int>" if with_ids else "")
    names = [f.partition(" ")[0] for f in schema.split(", ")]

    def run(batches):
        encode, seen = encoder(vocabulary), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for key, ids in zip(part.column("doc_id").to_pylist(), encode.ids(part.column("text")), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    start, end = 0, (len(ids) - 1) % capacity + 1
                    for piece in range(-(-len(ids) // capacity)):
                        rows.append((key, piece, start, end - start, zlib.crc32(ids[start:end]), int(seen[end - start]), *([ids[start:end].tolist()] if with_ids else [])))
                        seen[end - start] += 1
                        start, end = end, end + capacity
                columns = list(zip(*rows, strict=True)) or [[] for _ in names]
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int32())][: len(names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return named.mapInArrow(run, schema).withColumn("task", F.spark_partition_id())


def pack_documents(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    vocabulary: str = "byte_bpe_50k.json",
    capacity: int = LENGTH,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` ids; one row per piece.

    A document is its ids and the end id. Only one longer than `capacity` is cut: into pieces of that length, the
    first one may be shorter. Columns: doc_id, piece, start (its document's ids before it), length, ids_crc32,
    sequence_id, offset; with `ids` on request. Null and empty texts are the end id alone. Rows with null or
    repeated ids are documents of their own.

    The pieces are kept in the checkpoint folder, so that ranks hold when tasks are repeated. What the driver plans from is the
    number of pieces of each length, at most `capacity` numbers; the plan holds runs of ranks, some for each
    length. Ranks within a length are those within a task plus the totals of the tasks before it, so a length
    that a third of the pieces share is spread over all tasks.
    """
    pieces = cut(cut_pieces(docs, text, doc_id, vocabulary, capacity, end_id, with_ids))
    per_task = cut(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row.length] = row.n
    plan = docs.sparkSession.sparkContext.broadcast(plan_packing(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = per_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "task")

    def place(batches):
        runs = plan.value
        # Runs are in order of length and rank; one number for both finds the run of a piece.
        most = int(counts.max(initial=0)) + 1
        keys = runs.length * most + runs.first
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * most + rank, "right") - 1
            columns = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            columns["sequence_id"] = pa.array(runs.sequence[at] + rank - runs.first[at])
            columns["offset"] = pa.array(runs.offset[at])
            yield pa.RecordBatch.from_arrays([columns[n] for n in out], names=out)

    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + (["ids"] if with_ids else [])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """`sequence_id`, `ids`, `doc_ids`: packed pieces (with ids) put together; at most `capacity` ids each."""
    members = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(members.alias("m")).select("sequence_id", F.flatten("m.ids").alias("ids"), F.col("m.doc_id").alias("doc_ids"))
