"""Near-duplicates of embeddings by product quantisation: inverted lists with residual codes, then exact cosine."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.components import connected_components, cut

THRESHOLD = 0.98
#: Vectors that the lists and codes are fitted on, at most; every vector is indexed.
SAMPLE = 8192
LISTS = 512
PARTS = 8
CODES = 64
#: Rows of each side that one task compares at once; longer lists are compared in tiles of this size.
TILE = 1024
ROUNDS = 8


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def k_means(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    centres = x[random.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = squared_distances(x, centres).argmin(axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return np.unique(centres, axis=0)


@dataclass
class Quantiser:
    """Coarse centres, and for each part of a vector the code words of the residuals to them."""

    centres: np.ndarray
    cuts: list[int]
    words: list[np.ndarray]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, self.cuts, axis=1)

    def encode(self, x: np.ndarray, radius: float):
        """Per unit vector: its list, its code, the exact error of the code, and the lists to probe.

        A vector within `radius` may lie in another cell only if the border with that cell is no farther than
        the radius. So the probes hold the list of every such vector, for certain.
        """
        far = squared_distances(x, self.centres)
        home = far.argmin(axis=1)
        residual = x - self.centres[home]
        codes = np.stack([squared_distances(p, w).argmin(axis=1) for p, w in zip(self.parts(residual), self.words, strict=True)], axis=1)
        told = np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], axis=1)
        error = np.linalg.norm(residual - told, axis=1)
        between = np.sqrt(squared_distances(self.centres, self.centres))[home]
        border = (far - far[np.arange(len(x)), home][:, None]) / np.maximum(2 * between, 1e-12)
        border[np.arange(len(x)), home] = 0
        return home, codes.astype(np.uint8), error, [np.flatnonzero(b) for b in border <= radius + 1e-9]

    def table_distances(self, x: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Distances from whole vectors to codes of one list, summed from tables of the parts."""
        total = np.zeros((len(x), len(codes)))
        for m, (part, words) in enumerate(zip(self.parts(x - self.centres[home]), self.words, strict=True)):
            total += squared_distances(part, words)[:, codes[:, m]]
        return np.sqrt(total)


def fit(x: np.ndarray, lists: int, seed: int = 3) -> Quantiser:
    random = np.random.default_rng(seed)
    centres = k_means(x, lists, random)
    residual = x - centres[squared_distances(x, centres).argmin(axis=1)]
    cuts = [len(p) for p in np.array_split(np.arange(x.shape[1]), min(PARTS, x.shape[1]))]
    cuts = np.cumsum(cuts)[:-1].tolist()
    return Quantiser(centres, cuts, [k_means(p, CODES, random) for p in np.split(residual, cuts, axis=1)])


def untrained(dims: int) -> Quantiser:
    """One list for vectors of a size that the sample lacks: nothing is pruned, so nothing is lost."""
    return Quantiser(np.zeros((1, dims)), [], [np.zeros((1, dims))])


def _valid(vectors: DataFrame) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    sound = F.col("label").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(sound)


def _index(classes: DataFrame, models, radius: float) -> DataFrame:
    """`classes` with their list, code, error and probes."""

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
            homes, error = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
            codes, probes = [b""] * len(sizes), [[]] * len(sizes)
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                x = _matrix(column.take(pa.array(at)), dims)
                homes[at], code, error[at], near = (models.value.get(dims) or untrained(dims)).encode(unit(x), radius)
                for i, h, c, p in zip(at.tolist(), homes[at].tolist(), code, near, strict=True):
                    # A pair meets in the list of the higher number, which the other vector probes.
                    codes[i], probes[i] = c.tobytes(), p[p >= h].tolist()
            columns = [*batch.columns, pa.array(homes), pa.array(codes, pa.binary()), pa.array(error, pa.float64()), pa.array(probes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "home", "code", "error", "probes"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{kinds}, home int, code binary, error double, probes array<int>")


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _compare(models, threshold: float, radius: float):
    """Per tile: how many vectors each one is linked to, and links that connect what the tile connects.

    Each pair of vectors meets in one tile: the one of the lower home asks, of equal homes that of the lower number.
    """

    def run(batches):
        for batch in batches:
            out = [np.zeros((0, 3), np.int64)]
            for home, asked, there in zip(batch.column("home").to_pylist(), batch.column("asked"), batch.column("there"), strict=True):
                asked, there = asked.values, there.values
                dims = len(asked.field("embedding")[0])
                x, y = (_matrix(side.field("embedding"), dims) for side in (asked, there))
                model = models.value.get(dims) or untrained(dims)
                codes = np.frombuffer(b"".join(there.field("code").to_pylist()), np.uint8).reshape(len(y), -1)
                error = there.field("error").to_numpy()
                nodes = asked.field("node").to_numpy(), there.field("node").to_numpy()
                copies = asked.field("copies").to_numpy(), there.field("copies").to_numpy()
                near = model.table_distances(unit(x), home, codes) - error[None] <= radius + 1e-6
                near &= (asked.field("home").to_numpy() < home)[:, None] | (nodes[0][:, None] < nodes[1][None])
                rows, columns = np.nonzero(near)
                if not len(rows):
                    continue
                norms = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
                exact = np.zeros(near.shape, dtype=bool)
                for a in range(0, len(rows), 1 << 16):
                    r, c = rows[a : a + (1 << 16)], columns[a : a + (1 << 16)]
                    exact[r, c] = np.einsum("ij,ij->i", x[r], y[c]) / (norms[0][r] * norms[1][c]) >= threshold
                # A link of a node to itself carries its count; others connect, at most one for each two groups that meet.
                for own, counts in ((nodes[0], exact @ copies[1]), (nodes[1], copies[0] @ exact)):
                    some = np.flatnonzero(counts)
                    out.append(np.stack([own[some], own[some], counts[some]], axis=1))
                group = np.arange(len(y))
                for q in np.flatnonzero(exact.any(axis=1)).tolist():
                    linked = np.flatnonzero(exact[q])
                    groups, first = np.unique(group[linked], return_index=True)
                    ends = nodes[1][linked[first]]
                    out.append(np.stack([np.full(len(ends), nodes[0][q]), ends, np.zeros(len(ends), np.int64)], axis=1))
                    if len(groups) > 1:
                        group[np.isin(group, groups)] = groups[0]
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k].copy(), pa.int64()) for k in range(3)], names=["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, sample: int = SAMPLE, tile: int = TILE) -> DataFrame:
    """One row per vector: `vec_id`, `n_links`, `component_id`, `kept`.

    Vectors of one label (not null) and size are linked if their cosine is at least `threshold` (above 0). n_links
    counts the other vectors linked directly, component_id is the smallest vec_id that links reach, itself
    included, kept tells whether it is its own. Vectors that are null, zero, or hold null or non-finite numbers
    link with nothing. Identical vectors of a label are one class with a number of copies. Rows with a null vec_id
    take part and are never kept.

    The lists and codes are fitted on at most `sample` classes. Probes and pruning use bounds that hold
    for every pair within the threshold (the border between cells; the error of a code), so no link is lost
    whatever the codes are. Long lists are compared in tiles of at most about `tile` rows a side.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    classes = _valid(rows).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding")))
    radius = math.sqrt(2 - 2 * threshold)

    total = classes.count()
    fitted = {}
    by_size: dict[int, list] = {}
    for row in classes.select("embedding", "dims").orderBy(F.xxhash64("embedding"), "node").limit(sample).toLocalIterator():
        by_size.setdefault(row.dims, []).append(row.embedding)
    for dims, found in by_size.items():
        fitted[dims] = fit(unit(np.array(found, dtype=np.float64)), int(min(LISTS, max(1, math.sqrt(total)))))
    models = spark.sparkContext.broadcast(fitted)

    index = cut(_index(classes.select("node", "label", "dims", "embedding", "copies"), models, radius))
    key = ["label", "dims", "home"]
    asked = index.select("node", "label", "dims", "embedding", "copies", F.col("home").alias("own"), F.explode("probes").alias("home"))
    held = index.groupBy(key).agg(F.count("*").alias("n_there"))
    queries = asked.groupBy(key).agg(F.count("*").alias("n_asked"))
    sizes = held.join(queries, key)
    tiles = lambda n: F.ceil(F.col(n) / tile).cast("int")
    sizes = cut(sizes.select(*key, tiles("n_there").alias("tiles_there"), tiles("n_asked").alias("tiles_asked")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    nothing = F.lit(None)
    left = asked.join(sizes, key).select(*key, place("tiles_asked").alias("q"), spread("tiles_there").alias("t"), F.struct("node", "embedding", "copies", F.col("own").alias("home")).alias("asked"))
    right = index.join(sizes, key).select(*key, spread("tiles_asked").alias("q"), place("tiles_there").alias("t"), F.struct("node", "embedding", "copies", "code", "error").alias("there"))
    both = left.withColumn("there", nothing.cast(right.schema["there"].dataType)).unionByName(right.withColumn("asked", nothing.cast(left.schema["asked"].dataType)))
    grouped = both.groupBy(*key, "q", "t").agg(F.collect_list("asked").alias("asked"), F.collect_list("there").alias("there"))
    grouped = grouped.where((F.size("asked") > 0) & (F.size("there") > 0)).select("home", "asked", "there")
    links = cut(grouped.mapInArrow(_compare(models, threshold, radius), "a long, b long, n long"))

    counted = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(links)
    placed = classes.join(roots, "node", "left").join(counted, "node", "left")
    placed = placed.select("label", "embedding", "first", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("lowest"))
    placed = placed.join(lowest, "root").select("label", "embedding", "n_links", "lowest")
    found = rows.join(placed, ["label", "embedding"], "left")
    component = F.coalesce("lowest", "vec_id").alias("component_id")
    found = found.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
