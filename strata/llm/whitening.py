"""Whitening of embeddings: exact integer covariance by bit-sliced scatter, then principal components scaled to one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strata.llm.components import cut

COMPONENTS = 8
#: Entries become whole numbers floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Rows whose bit planes are packed at once.
ROWS = 1 << 14
#: Components whose eigenvalue is below this share of the largest have no direction of their own.
FLAT = 1e-12
#: Largest |entry| * SCALE that whole numbers of 64 bits and exact doubles hold.
_LARGEST = float(1 << 52)


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    scaled = SCALE * vectors.astype(np.float64)
    if np.abs(scaled).max(initial=0) >= _LARGEST:
        raise ValueError("vector entries beyond 2^42")
    return np.floor(scaled).astype(np.int64) + SHIFT


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Bits of unsigned values, planes x dimensions x words: bit r of a dimension's words in plane b is bit b of row r."""
    rows, dims = values.shape
    planes = max(1, int(values.max(initial=0)).bit_length())
    padded = np.zeros((dims, -(-rows // 64) * 64), np.uint64)
    padded[:, :rows] = values.T
    packed = [np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<u8") for b in range(planes)]
    return np.stack(packed)


def scatter(x: np.ndarray) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums by dimension and the upper triangle of cross-products of whole numbers, all exact.

    Values are shifted by the least of their dimension, so few bit planes remain. The product of two dimensions is the
    sum over pairs of their planes of 2^(a + b) times the number of rows with both bits; the shifts are put back after.
    """
    rows, dims = x.shape
    least = x.min(axis=0)
    planes = bit_planes((x - least).astype(np.uint64))
    low = [int(v) for v in least]
    ones = [sum(int(n) << b for b, n in enumerate(column)) for column in np.bitwise_count(planes).sum(axis=2, dtype=np.int64).T.tolist()]
    products = []
    for i in range(dims):
        counts = np.zeros((2 * len(planes) - 1, dims - i), np.int64)
        for a in range(len(planes)):
            if planes[a, i].any():
                counts[a : a + len(planes)] += np.bitwise_count(planes[:, i:] & planes[a, i]).sum(axis=2, dtype=np.int64)
        shifted = [sum(int(n) << b for b, n in enumerate(column)) for column in counts.T.tolist()]
        products.append([s + low[i] * ones[j] + low[j] * ones[i] + rows * low[i] * low[j] for j, s in enumerate(shifted, i)])
    return rows, [o + rows * v for o, v in zip(ones, low, strict=True)], products


def _dense(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length of a batch."""
    column = batch.column(name)
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dims)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, flat.reshape(len(at), dims)


def sound_vectors(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Rows whose vector is not null or empty and holds only finite numbers."""
    finite = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))
    column = F.col(f"`{embedding}`")
    return vectors.where(column.isNotNull() & (F.size(column) > 0) & F.forall(column, finite))


_SUMS = "dims int, i int, j int, value decimal(38,0)"


def cross_products(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """`dims`, `i`, `j`, `value`: exact sums over the vectors of each length. Dimensions count from 1; (0, 0) is the
    number of vectors, (0, j) the sum of dimension j, (i, j) with 1 <= i <= j that of products.

    Each task adds up what it has read and passes on one row for each pair, so the shuffle does not grow with the rows of a task.
    """

    def run(batches):
        held: dict[int, list] = {}

        def add(dims: int, found) -> None:
            rows, sums, products = found
            flat = [rows, *sums, *(v for row in products for v in row)]
            held[dims] = flat if dims not in held else [a + b for a, b in zip(held[dims], flat, strict=True)]

        for batch in batches:
            for _, values in _dense(batch, "v"):
                for begin in range(0, len(values), ROWS):
                    add(values.shape[1], scatter(whole_numbers(values[begin : begin + ROWS])))
        for dims, flat in held.items():
            pairs = [(0, 0), *((0, j) for j in range(1, dims + 1)), *((i, j) for i in range(1, dims + 1) for j in range(i, dims + 1))]
            i, j = zip(*pairs, strict=True)
            columns = [pa.array([dims] * len(flat), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(flat, pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["dims", "i", "j", "value"])

    parts = vectors.select(F.col(f"`{embedding}`").alias("v")).mapInArrow(run, _SUMS)
    return parts.groupBy("dims", "i", "j").agg(F.sum("value").cast("decimal(38,0)").alias("value"))


@dataclass
class Whitener:
    """The centre (sums and number of vectors) and the first components of vectors of one length."""

    n: int
    sums: np.ndarray  # whole numbers, as objects
    values: np.ndarray  # eigenvalues, falling
    directions: np.ndarray  # dims x components
    trace: float

    @property
    def sound(self) -> np.ndarray:
        return self.values > FLAT * max(self.values[0], 0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit where it fits, else whole numbers of any size."""
        most = self.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        if most < 1 << 62:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def __call__(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Exact deviations and whitened coordinates (NaN for components without a direction)."""
        y = self.centred(x)
        small = y.dtype != object and (len(y) == 0 or y.shape[1] * int(np.abs(y).max()) ** 2 < 1 << 63)
        z = y if small else y.astype(object)
        deviation = [int(v) for v in (z * z).sum(axis=1)]
        scale = np.where(self.sound, np.sqrt(np.where(self.sound, self.values, 1)), np.nan)
        return deviation, (y / self.n).astype(np.float64) @ self.directions / scale


def fit(sums: dict[tuple[int, int], int], dims: int, components: int = COMPONENTS) -> Whitener:
    """Eigenvectors of the covariance (divisor n), whose entries are centred as whole numbers: n * XX - S S'."""
    n = sums[0, 0]
    s = [sums[0, j] for j in range(1, dims + 1)]
    covariance = np.zeros((dims, dims))
    for i in range(1, dims + 1):
        for j in range(i, dims + 1):
            covariance[i - 1, j - 1] = covariance[j - 1, i - 1] = (n * sums[i, j] - s[i - 1] * s[j - 1]) / (n * n)
    values, directions = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    directions = directions[:, order]
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(order))])
    return Whitener(n, np.array(s, dtype=object), values[order], directions * np.where(signs == 0, 1, signs), float(np.trace(covariance)))


def train(vectors: DataFrame, embedding: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitener]:
    """A whitener for each vector length, fitted on all sound vectors. What reaches the driver is one number for
    each pair of dimensions, whatever the number of vectors.
    """
    found: dict[int, dict[tuple[int, int], int]] = {}
    for row in cross_products(sound_vectors(vectors, embedding), embedding).toLocalIterator():
        found.setdefault(row.dims, {})[row.i, row.j] = int(row.value)
    return {dims: fit(sums, dims, components) for dims, sums in found.items()}


def _projected(vectors: DataFrame, models: dict[int, Whitener], embedding: str) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(models)
    taken = {embedding.lower(), "dims", "deviation", "white"}
    kept = [f for f in vectors.schema.fields if f.name.lower() not in taken]
    names = [f.name for f in kept]
    added = T._parse_datatype_string("dims int, deviation decimal(38,0), white array<double>")
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches):
        for batch in batches:
            for at, values in _dense(batch, "__v"):
                part = batch.take(pa.array(at))
                deviation, white = sent.value[values.shape[1]](whole_numbers(values))
                offsets = pa.array(np.arange(0, white.size + 1, white.shape[1]), pa.int32())
                flat = pa.array(white.ravel(), pa.float64())
                columns = [*[part.column(n) for n in names], pa.array([values.shape[1]] * len(at), kinds[0]), pa.array(deviation, kinds[1]), pa.ListArray.from_arrays(offsets, flat)]
                yield pa.RecordBatch.from_arrays(columns, names=names + added.names)

    source = vectors.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{embedding}`").alias("__v"))
    return source.mapInArrow(run, T.StructType(kept + added.fields))


def _identity_errors(projected: DataFrame, models: dict[int, Whitener]) -> dict[int, float]:
    """Per vector length, how far the covariance of the whitened rows, as they are, is from the identity: their
    means first, then the products of what is left. Components without a direction are left out.
    """
    errors = {}
    for dims, model in models.items():
        rows = projected.where(F.col("dims") == dims)
        at = np.flatnonzero(model.sound).tolist()
        if not at:
            continue
        means = rows.agg(*[F.avg(F.get("white", F.lit(k))).alias(f"m{k}") for k in at]).first()
        left = {k: F.get("white", F.lit(k)) - F.lit(means[f"m{k}"]) for k in at}
        pairs = [(a, b) for a in at for b in at if a <= b]
        found = rows.agg(*[F.avg(left[a] * left[b]) for a, b in pairs]).first()
        errors[dims] = max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs, strict=True))
    return errors


def whiten(vectors: DataFrame, embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each sound vector and component: the other columns of `vectors`, `component` (from 1), `n`,
    `deviation` (exact, decimal), `whitened`, `explained`, `identity_error`.

    Rows whose vector is null, empty or holds null or non-finite entries are left out; vectors of different lengths
    are whitened each with their own. Repeated rows and rows with null ids count like others. Of fewer dimensions than
    `components` there are as many components as dimensions. A component without variance has no direction: its
    `whitened` is null and it does not count for identity_error, which is null if no component has any (as with one
    vector, or only equal ones); `explained` is null if nothing varies. Entries beyond 2^52 / 1024 are refused.
    """
    sound = sound_vectors(vectors, embedding)
    models = train(sound, embedding, components)
    named = {"component", "n", "whitened", "explained", "identity_error"}
    rest = sound.select(*[F.col(f"`{c}`") for c in sound.columns if c.lower() not in named or c.lower() == embedding.lower()])
    projected = cut(_projected(rest, models, embedding))
    errors = _identity_errors(projected, models)
    many = {dims: (m.n, errors.get(dims), [float(max(v, 0) / m.trace) if m.trace > 0 else None for v in m.values]) for dims, m in models.items()}
    of = lambda pick, kind: F.coalesce(*[F.when(F.col("dims") == d, F.lit(pick(m))) for d, m in many.items()], F.lit(None)).cast(kind)
    explained = F.coalesce(*[F.when(F.col("dims") == d, F.array(*[F.lit(v) for v in m[2]])) for d, m in many.items()], F.lit(None)).cast("array<double>")
    others = [F.col(f"`{c}`") for c in projected.columns if c not in ("dims", "deviation", "white")]
    return projected.select(
        *others, F.posexplode("white").alias("__k", "__w"), of(lambda m: m[0], "long").alias("n"), "deviation", explained.alias("__explained"), of(lambda m: m[1], "double").alias("identity_error")
    ).select(
        *others, (F.col("__k") + 1).alias("component"), "n", "deviation", F.nanvl("__w", F.lit(None).cast("double")).alias("whitened"),
        F.get("__explained", "__k").alias("explained"), "identity_error",
    )
