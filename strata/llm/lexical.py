"""Ranked lexical search by the Best Position Algorithm: impact lists with direct accesses, stopped early."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.components import cut
from strata.llm.decontaminate import words_of
from strata.llm.texts import map_texts

TOP = 10
#: Fixed value: a term is a run of 0-9, A-Z, a-z and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of items' terms that are sent to the executors at once; more items take several passes over the documents.
BLOCK_BYTES = 4 << 20
#: Positions that are read from each list in the first round; twice as many in each further round, up to MOST_READ.
FIRST_READ, MOST_READ = 32, 2048
#: A list that holds at least one of so many documents of its batch gets a dense table for direct accesses.
DENSE = 16
#: Local winners of an item are merged in so many groups of tasks first.
GROUPS = 64


class Lists:
    """The impact lists of a batch of documents: per term its documents by falling impact, equal ones by doc_id.

    Documents are numbered by ascending doc_id, null last.
    """

    def __init__(self, ids: pa.Array, n: np.ndarray, terms: pa.ListArray, tfs: pa.ListArray, weights: np.ndarray, documents: int, words: int):
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((values, missing))
        self.ids, self.missing = values[order], missing[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False)
        docs = np.repeat(place, sizes)
        wide = n.astype(object) if 90 * documents * int(n.max(initial=0)) >= 1 << 63 else n
        m = (10 + 90 * wide * documents // max(words, 1)).astype(np.int64)
        term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes)))
        some = np.flatnonzero(impact)
        order = some[np.lexsort((docs[some], -impact[some], term[some]))]
        self.docs, self.impacts = docs[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self._access: dict[int, tuple] = {}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[term], self.starts[term + 1])
        return self.docs[at], self.impacts[at]

    def positions(self, term: int, docs: np.ndarray) -> np.ndarray:
        """Direct access: where the documents stand in the list of a term, -1 where they do not."""
        if term not in self._access:
            own, _ = self.of(term)
            if len(own) * DENSE >= len(self.ids):
                table = np.full(len(self.ids), -1, np.int32)
                table[own] = np.arange(len(own))
                self._access[term] = (table,)
            else:
                order = np.argsort(own)
                self._access[term] = (own[order], order)
        found = self._access[term]
        if len(found) == 1:
            return found[0][docs]
        at = np.minimum(np.searchsorted(found[0], docs), len(found[0]) - 1)
        return np.where(found[0][at] == docs, found[1][at], -1)

    def best(self, terms: list[int], k: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The `k` best documents of the batch, as numbers and scores; `held`: scores of up to k documents from before.

        Lists are read side by side. A document that is met is scored at once by direct accesses, which mark its
        position in every list. The best position of a list is the end of its unbroken run of marked positions; no
        document that was not met can score more than the sum of the impacts there. When that sum is below (not at) the
        k-th score, nothing is left to find. Positions reached by direct accesses count, so the sum falls sooner than
        that of the positions last read.
        """
        lists = [(t, *self.of(t)) for t in terms if self.starts[t] < self.starts[t + 1]]
        marked = [np.zeros(len(docs), bool) for _, docs, _ in lists]
        reached = [0] * len(lists)
        met = np.zeros(len(self.ids), bool)
        top, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin, step = 0, FIRST_READ
        while any(r < len(m) for r, m in zip(reached, marked, strict=True)):
            fresh = np.unique(np.concatenate([docs[begin : begin + step] for _, docs, _ in lists]))
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            found = np.zeros(len(fresh), np.int64)
            for (term, _, impacts), mark in zip(lists, marked, strict=True):
                at = self.positions(term, fresh)
                there = np.flatnonzero(at >= 0)
                at = at[there]
                found[there] += impacts[at]
                mark[at] = True
            top, scores = np.append(top, fresh), np.append(scores, found)
            order = np.lexsort((top, -scores))[:k]
            top, scores = top[order], scores[order]
            begin, step = begin + step, min(2 * step, MOST_READ)
            limit = 0
            for i, ((_, _, impacts), mark) in enumerate(zip(lists, marked, strict=True)):
                rest = mark[reached[i] :]
                if len(rest):
                    gap = int(rest.argmin())
                    reached[i] += len(rest) if rest[gap] else gap
                if reached[i] < len(mark):
                    limit += int(impacts[reached[i] - 1])
            known = np.sort(np.append(held, scores))
            if len(known) >= k and limit < known[-k]:
                break
        return top, scores


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """`item`, `terms`: the different terms of each item. Rows that repeat an id are one item; rows with a null id are none."""
    words = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(TERM), F.lit(0))
    pairs = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), F.explode(words).alias("term")).distinct()
    return pairs.groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """Items in lists of at most `limit` bytes of terms each (a longer item alone)."""
    block, held = [], 0
    for row in items.orderBy("item").toLocalIterator():
        size = sum(len(t.encode()) for t in row.terms)
        if block and held + size > limit:
            yield block
            block, held = [], 0
        block.append((row.item, row.terms))
        held += size
    if block:
        yield block


def postings(docs: DataFrame, numbers: dict[bytes, int], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: `doc_id`, `n` (terms with repeats) and its terms that have a number, with how often each occurs."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def count(texts: list[str | None]):
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        known = sent.value.get
        flat = np.fromiter((known(w, -1) for own in words for w in own), np.int64, int(sizes.sum()))
        pairs = (np.repeat(np.arange(len(texts)), sizes) << 32 | flat)[flat >= 0]
        pairs, times = np.unique(pairs, return_counts=True)
        offsets = pa.array(np.searchsorted(pairs >> 32, np.arange(len(texts) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (pairs & 0xFFFFFFFF, times)]
        return [pa.array(sizes), *lists]

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(named, "text", "n long, terms array<int>, tfs array<int>", lambda: count, drop_text=True)


def _search(indexed: DataFrame, items: list[list[int]], weights: np.ndarray, documents: int, words: int, k: int) -> DataFrame:
    """The best documents of each task: (item number, doc_id, score)."""
    sent = indexed.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches):
        items, weights = sent.value
        nothing = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        held = {}
        for batch in batches:
            lists = Lists(batch.column("doc_id"), batch.column("n").to_numpy(), batch.column("terms"), batch.column("tfs"), weights, documents, words)
            for number, terms in enumerate(items):
                ids, missing, scores = held.get(number, nothing)
                top, found = lists.best(terms, k, scores)
                if len(top):
                    ids, missing, scores = np.append(ids, lists.ids[top]), np.append(missing, lists.missing[top]), np.append(scores, found)
                    order = np.lexsort((ids, missing, -scores))[:k]
                    held[number] = ids[order], missing[order], scores[order]
        for number, (ids, missing, scores) in held.items():
            columns = [pa.array([number] * len(ids), pa.int32()), pa.array(ids, pa.int64(), mask=missing), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "doc_id", "score"])

    return indexed.mapInArrow(run, "number int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`item_id`, `rank`, `doc_id`, `score`: the `k` best documents of each item with a score above 0, equal scores by
    ascending doc_id (null last).

    A term weighs floor(1000 ln((2N+2) / (2df+1))) times a saturated frequency that long documents get less of; all
    counts are over all documents. Each batch of documents has impact lists of its own and is searched by
    `Lists.best`; the exact winners of the tasks are merged. Documents that repeat rank as often as they occur; null
    and empty texts have no terms, and items without terms (null text too) no rows. Items are a stated query set,
    taken in blocks of at most `block_bytes` of terms; each block reads the texts once.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in _blocks(item_terms(items, item_id, item_text), block_bytes):
        numbers = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        indexed = cut(postings(docs, {t.encode(): i for t, i in numbers.items()}, text, doc_id))
        counts = indexed.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("words")).first()
        weights = np.zeros(len(numbers), np.int64)
        for row in indexed.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            weights[row.term] = math.floor(1000 * math.log((2 * counts.documents + 2) / (2 * row["count"] + 1)))
        local = _search(indexed, [[numbers[t] for t in terms] for _, terms in block], weights, counts.documents, counts.words or 0, k)
        by = [F.desc("score"), F.asc_nulls_last("doc_id")]
        first = Window.partitionBy("number", "__group").orderBy(*by)
        local = local.withColumn("__group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
        local = local.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*by))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"number int, item_id {kind}")
        found = found.unionByName(cut(ranked.join(names, "number").select("item_id", "rank", "doc_id", "score")))
    return found
