"""Token ids in a compact binary format: Simple-8b words in self-contained blocks.

A block holds whole documents, about BLOCK_IDS ids. Its bytes, little-endian:
magic `S8B1`; counts of documents, ids and words (3 x uint32); ids per document (uint32 each); the 64-bit words.
A word has a 4-bit selector in its low bits and 60 bits of payload above it, first id lowest. Selector s packs
COUNTS[s] ids of WIDTHS[s] bits. Selectors 0 and 1 are runs of zeros. Selector 15 is the escape: one id of up
to 60 bits that fits no narrower packing. The last word of a block may be padded with zeros.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.checkpoints import scratch_path
from strata.llm.bpe import encoder
from strata.llm.components import cut
from strata.llm.texts import slices

# The packings of Simple-8b, by selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

#: Totals of parts (16 bytes each) that are sent to every block.
MOST_PARTS = 500_000
BLOCK_IDS = 1 << 16
#: Text bytes that are encoded at once: the more, the fewer distinct pieces are looked up. About 20 times this is held.
SLICE_BYTES = 4 << 20
MAGIC = b"S8B1"

# The first id too wide for each packing but the escape, and the narrowest packing of each id below 2^16.
_LIMITS = np.array([1 << w for w in WIDTHS[:-1]], dtype=np.uint64)
_LEAST = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)


def pack(ids: np.ndarray) -> np.ndarray:
    """Ids (less than 2^60) as Simple-8b words: greedily the selector that packs most."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    if int(ids.max()) >> 60:
        raise ValueError("ids take more than 60 bits")
    # For each id the narrowest packing it fits, for each position the widest of these over as many ids as a packing
    # takes: bytes, and each count is at most twice the one before. Zeros pad the last word.
    least = _LEAST[ids] if int(ids.max()) < len(_LEAST) else np.searchsorted(_LIMITS, ids, "right").astype(np.uint8)
    over, size = np.append(least, np.zeros(max(COUNTS), np.uint8)), 1
    best = np.empty(n, dtype=np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):
        over = np.maximum(over[: len(over) - (COUNTS[s] - size)], over[COUNTS[s] - size :])
        size = COUNTS[s]
        best[over[:n] <= s] = s
    # Words follow each other: every 16th by steps, those between for all at once.
    after = np.append(np.minimum(np.arange(n) + np.array(COUNTS)[best], n), n)
    far = after
    for _ in range(4):
        far = far[far]
    at, steps, follow = 0, [], memoryview(far)
    while at < n:
        steps.append(at)
        at = follow[at]
    between = [np.array(steps)]
    for _ in range(15):
        between.append(after[between[-1]])
    starts = np.stack(between, axis=1).ravel()
    starts = starts[starts < n]
    selectors = best[starts]
    words = selectors.astype(np.uint64)
    padded = np.concatenate([ids, np.zeros(max(COUNTS), np.uint64)])
    for s in np.unique(selectors).tolist():
        if WIDTHS[s]:
            rows = np.flatnonzero(selectors == s)
            values = padded[starts[rows][:, None] + np.arange(COUNTS[s])]
            shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s]) + np.uint64(4)
            words[rows] |= np.bitwise_or.reduce(values << shifts, axis=1)
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of Simple-8b words; the offset of each word follows from the selectors, all at once."""
    words = np.asarray(words, dtype=np.uint64)
    selectors = (words & np.uint64(15)).astype(np.int64)
    sizes = np.array(COUNTS)[selectors]
    offsets = np.cumsum(sizes) - sizes
    ids = np.zeros(int(sizes.sum()), dtype=np.uint64)
    for s in np.unique(selectors).tolist():
        if WIDTHS[s]:
            rows = np.flatnonzero(selectors == s)
            shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s]) + np.uint64(4)
            values = (words[rows][:, None] >> shifts) & np.uint64((1 << WIDTHS[s]) - 1)
            ids[offsets[rows][:, None] + np.arange(COUNTS[s])] = values
    if len(ids) < n:
        raise ValueError(f"the words hold {len(ids)} ids, not {n}")
    return ids[:n]


def write_block(documents: list[np.ndarray]) -> bytes:
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint64)
    words = pack(ids)
    head = np.array([len(documents), len(ids), len(words), *map(len, documents)], dtype="<u4")
    return MAGIC + head.tobytes() + words.astype("<u8").tobytes()


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block, and the number of ids of each document."""
    if data[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n_docs, n_ids, n_words = np.frombuffer(data, "<u4", 3, 4).tolist()
    lengths = np.frombuffer(data, "<u4", n_docs, 16).astype(np.int64)
    return unpack(np.frombuffer(data, "<u8", n_words, 16 + 4 * n_docs), n_ids), lengths


def write_tokens(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, partitions: int | None = None) -> None:
    """Write the ids of all texts, in ascending id order, as a table of blocks that Spark commits like any other.

    Each row is one block: `part` and `block` give the order, `first` the ids in the part before it, `n_ids`, the
    `doc_ids` and the `data`. Texts are dealt out by ranges of doc_id, so the order holds across parts. The end id
    follows each document. Null texts are empty; null ids come first; rows with one id keep the order of their
    texts. A single id with very many rows stays in one part.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = named.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        encode, block, first = encoder(vocabulary), 0, 0
        held, doc_ids, size = [], [], 0

        def row():
            values = [[block], [first], [size], [doc_ids], [write_block(held)]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        names = ["block", "first", "n_ids", "doc_ids", "data"]
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                for key, ids in zip(part.column("doc_id").to_pylist(), encode.ids(part.column("text")), strict=True):
                    held.append(np.append(ids, np.uint32(end_id)))
                    doc_ids.append(key)
                    size += len(ids) + 1
                    if size >= BLOCK_IDS:
                        yield row()
                        block, first = block + 1, first + size
                        held, doc_ids, size = [], [], 0
        if held:
            yield row()

    blocks = ordered.mapInArrow(run, "block long, first long, n_ids long, doc_ids array<long>, data binary")
    blocks.select(F.spark_partition_id().alias("part"), "*").write.parquet(path)


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of written blocks: `doc_id`, `start` (ids of all documents before it), `n_tokens` (with the end
    id), `ids_crc32` (of the ids as little-endian uint32), and the `ids` when asked for.

    Starts come from the totals of the parts, of which there are as many as write tasks; they are counted, and sent to
    the blocks if there are no more than MOST_PARTS of them.
    """
    blocks = spark.read.parquet(path)
    totals = cut(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    based = blocks.join(F.broadcast(bases) if totals.count() <= MOST_PARTS else bases, "part")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("doc_ids", "data", "at")}
                ids, lengths = read_block(row["data"])
                ends = np.cumsum(lengths)
                plain = ids.astype("<u4")
                crcs = [zlib.crc32(plain[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths + row["at"]), pa.array(lengths), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.partition(" ")[0] for f in schema.split(", ")])

    return based.select("doc_ids", "data", (F.col("base") + F.col("first")).alias("at")).mapInArrow(run, schema)


def token_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Write the tokens of all texts to the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, text, doc_id, vocabulary)
    return read_tokens(docs.sparkSession, path)
