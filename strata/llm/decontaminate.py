"""Benchmark decontamination by winnowing: shared fingerprints of word k-grams, extended to whole shared spans."""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.components import cut
from strata.llm.texts import filter_texts, map_texts

WINDOW = 13
GRAM = 5
#: Benchmark bytes that are sent to the executors at once; a larger benchmark is taken in several blocks.
BLOCK_BYTES = 32 << 20

# Word characters are 0-9, a-z after lower-casing A-Z, and all bytes of characters beyond ASCII.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """At each position, a hash of the n words from there; positions without n words are left out."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    found, base = hashes[:size].copy(), np.uint64(_BASE)
    for i in range(1, n):
        found = found * base + hashes[i : i + size]
    return found ^ (found >> np.uint64(29))


def lowest_in_windows(values: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each position on, by doubling."""
    done = 1
    while done < n:
        step = min(done, n - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


def last_lowest(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The last position of the least of the n values from each start on."""
    rows = values[starts[:, None] + np.arange(n - 1, -1, -1)]
    return starts + (n - 1) - rows.argmin(axis=1)


class Fingerprints:
    """The fingerprints of benchmark items: for windows of 13 words, the least k-gram hash with where it occurs;
    for shorter items, the hash of the whole item.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.span = window, gram, window - gram + 1
        self.ids = [str(i) for i, _ in items]
        self.words = [words_of(text) for _, text in items]
        self.short: dict[int, dict[int, list[int]]] = {}
        at: list[tuple[int, int, int]] = []
        for k, words in enumerate(self.words):
            hashes = word_hashes(words)
            if 0 < len(words) < window:
                self.short.setdefault(len(words), {}).setdefault(int(gram_hashes(hashes, len(words))[0]), []).append(k)
            elif words:
                grams = gram_hashes(hashes, gram)
                spots = np.unique(last_lowest(grams, np.arange(len(words) - window + 1), self.span))
                at += [(int(grams[p]), k, int(p)) for p in spots]
        at.sort()
        self.keys, starts = np.unique(np.array([x[0] for x in at], dtype=np.uint64), return_index=True)
        edges = [*starts.tolist(), len(at)]
        self.places = [[x[1:] for x in at[a:b]] for a, b in pairwise(edges)]
        self.short_keys = {n: np.array(sorted(found), dtype=np.uint64) for n, found in self.short.items()}

    def spans(self, texts: list[str | None]):
        """Per text: its number of words and the spans (first word, end, item number) that it shares."""
        docs = [words_of(t) for t in texts]
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        ends = np.cumsum(sizes)
        flat = [w for d in docs for w in d]
        hashes = word_hashes(flat)
        left = np.repeat(ends, sizes) - np.arange(len(flat))  # words from each position to the end of its text
        found: list[dict] = [{} for _ in docs]
        if len(self.keys) and len(flat) >= self.window:
            grams = gram_hashes(hashes, self.gram)
            least = lowest_in_windows(grams, self.span)
            hits = np.flatnonzero(_among(least, self.keys) & (left[: len(least)] >= self.window))
            spots = np.unique(last_lowest(grams, hits, self.span))
            for p, key, d in zip(spots.tolist(), np.searchsorted(self.keys, grams[spots]).tolist(), np.searchsorted(ends, spots, "right").tolist(), strict=True):
                self._extend(docs[d], p - int(ends[d] - sizes[d]), self.places[key], found[d])
        for n, keys in self.short_keys.items():
            grams = gram_hashes(hashes, n)
            for p in np.flatnonzero(_among(grams, keys) & (left[: len(grams)] >= n)).tolist():
                d = int(np.searchsorted(ends, p, "right"))
                start = p - int(ends[d] - sizes[d])
                for k in self.short[n][int(grams[p])]:
                    if docs[d][start : start + n] == self.words[k]:
                        found[d][(k, "at", start)] = (start, start + n)
        return sizes.tolist(), [sorted((a, b, key[0]) for key, (a, b) in spans.items()) for spans in found]

    def _extend(self, words: list[bytes], p: int, places: list[tuple[int, int]], found: dict) -> None:
        for item, q in places:
            theirs, shift = self.words[item], p - q
            if any(a <= p < b for a, b in [found.get((item, shift, "last"), (0, 0))]):
                continue
            a, b = p, p
            while b < len(words) and b - shift < len(theirs) and words[b] == theirs[b - shift]:
                b += 1
            while a > 0 and a - shift > 0 and words[a - 1] == theirs[a - shift - 1]:
                a -= 1
            if b - a >= self.window:
                found[(item, shift, a)] = found[(item, shift, "last")] = (a, b)


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, values)
    return keys[np.minimum(at, len(keys) - 1)] == values


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("item", T.StringType())]))


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int):
    """The benchmark's rows in lists of at most `limit` bytes each (a longer row alone)."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    block, held = [], 0
    for row in rows.toLocalIterator():
        size = len(row.t.encode())
        if block and held + size > limit:
            yield block
            block, held = [], 0
        block.append((row.i, row.t))
        held += size
    yield block


def shared_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` without its text, with `n_words`, `n_hit` (words inside a shared window), `items` (ids as sorted
    strings) and `spans` (start, end, item: the whole shared spans, in words).

    Only the benchmark is sent to the executors, in blocks of checked size; the texts are read once per block and
    only what was found is merged when there are several. Null texts have no words; items with a null id or text
    are no items; items that repeat an id count once.
    """
    marked = None
    for k, block in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        sent = docs.sparkSession.sparkContext.broadcast(Fingerprints(block))
        own = map_texts(docs.withColumn("__row", F.monotonically_increasing_id()), text, "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long,item:string>>", lambda sent=sent: lambda texts: _report(sent.value, texts), drop_text=True)
        if k == 0:
            marked = own
            continue
        marked = cut(marked) if k == 1 else marked
        more = own.where("n_hit > 0").select("__row", F.col("spans").alias("__more"))
        joined = marked.join(cut(more), "__row", "left")
        spans = F.array_sort(F.concat("spans", F.coalesce("__more", F.array().cast(_SPANS))))
        marked = cut(joined.withColumn("spans", spans).withColumn("items", F.array_sort(F.array_distinct("spans.item"))).withColumn("n_hit", _covered("spans")).drop("__more"))
    return marked.drop("__row")


def _report(prints: Fingerprints, texts: list[str | None]):
    sizes, found = prints.spans(texts)
    hit = []
    for spans in found:
        total = reach = 0
        for a, b, _ in spans:
            total += max(0, b - max(a, reach))
            reach = max(reach, b)
        hit.append(total)
    items = [sorted({prints.ids[k] for _, _, k in spans}) for spans in found]
    told = [sorted({(a, b, prints.ids[k]) for a, b, k in spans}) for spans in found]
    return sizes, hit, items, [[{"start": a, "end": b, "item": i} for a, b, i in spans] for spans in told]


def _covered(spans: str):
    """Words inside sorted spans, each counted once."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach"))
    step = lambda s, x: F.struct(
        (s["total"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["reach"]))).alias("total"),
        F.greatest(s["reach"], x["end"]).alias("reach"),
    )
    return F.aggregate(spans, start, step, lambda s: s["total"])


def is_contaminated(n_hit, n_words):
    """At least one hit word, and at least a twentieth of the words."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that share less than a twentieth of their words with the benchmark; all columns stay."""
    clean = ~is_contaminated(F.col("n_hit"), F.col("n_words"))
    return filter_texts(docs, text, lambda wrapped: shared_spans(wrapped, benchmark), clean)


def items_digest(items):
    return F.sha2(F.array_join(items, ","), 256)


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
