"""Quality classifier: a factorisation machine over hashed words and statistics of a text's structure."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.samples import PER_CLASS, Adagrad, labelled_texts, sigmoid
from strata.llm.texts import Remembered, filter_texts, map_texts

BUCKETS = 1 << 15
RANK = 8
EPOCHS = 4
THRESHOLD = 0.3
REMEMBERED = 200_000
STATISTICS = (
    "log of words", "log of bytes", "bytes per word", "upper case", "digits", "sentence marks", "other marks", "line ends",
    "beyond ASCII", "distinct words", "words repeated at once", "lines repeated", "marks per word", "commonest word", "lines without end mark",
)


class Features:
    """Bucket numbers and counts of a text's words, and its statistics."""

    def __init__(self):
        self.words = Remembered(self._hashes, 1, REMEMBERED, np.int64)

    @staticmethod
    def _hashes(words: list[str]) -> np.ndarray:
        return np.array([[zlib.crc32(w.encode("utf-8", "surrogatepass"))] for w in words])

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        split = [(t or "").lower().split() for t in texts]
        hashes = self.words.of(list(chain.from_iterable(split)))[:, 0]
        found, at = [], 0
        for text, words in zip(texts, split, strict=True):
            own, repeats = np.unique(hashes[at : at + len(words)], return_counts=True)
            at += len(words)
            buckets, places = np.unique(own % BUCKETS, return_inverse=True)
            values = np.log1p(np.bincount(places, repeats, len(buckets))).astype(np.float32)
            values /= max(1e-6, float(np.sqrt((values**2).sum())))
            data = (text or "").encode("utf-8", "surrogatepass")
            found.append((buckets, values, self._statistics(data, words, repeats)))
        return found

    @staticmethod
    def _statistics(data: bytes, words: list[str], counts: np.ndarray) -> np.ndarray:
        n, size = max(1, len(words)), max(1, len(data))
        found = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        letters = max(1, found[65:91].sum() + found[97:123].sum())
        ends = found[[33, 44, 46, 58, 59, 63]].sum()  # ! , . : ; ?
        marks = found[33:48].sum() + found[58:65].sum() + found[91:97].sum() + found[123:127].sum() - ends
        lines = data.split(b"\n")
        return np.array([
            np.log1p(len(words)), np.log1p(len(data)), min(len(data) / n, 100), found[65:91].sum() / letters, found[48:58].sum() / size,
            ends / size, marks / size, found[10] / n, found[128:].sum() / size, len(counts) / n,
            sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / len(lines), min((ends + marks) / n, 10), counts.max(initial=0) / n,
            sum(not x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines),
        ], dtype=np.float32)


@dataclass
class Model:
    """y = bias + sum w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j; the statistics come after the buckets."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, buckets: np.ndarray, values: np.ndarray, statistics: np.ndarray):
        """Numbers and values of all features of a text."""
        dense = np.clip((statistics - self.mean) / self.scale, -5, 5)
        return np.concatenate([buckets, np.arange(len(dense)) + BUCKETS]), np.concatenate([values, dense / 2]).astype(np.float32)

    def raw(self, at: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        """The score before the logistic function, pairs summed in linear time: the square of the sum less the sum
        of squares.
        """
        scaled = self.v[at] * x[:, None]
        total = scaled.sum(axis=0)
        return float(self.bias + self.w[at, 0] @ x + 0.5 * (total @ total - (scaled * scaled).sum())), total


def fit(rows: list[tuple], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit on (buckets, values, statistics) per row by Adagrad on the logistic loss, one batch of 32 rows at a time."""
    random = np.random.default_rng(seed)
    size = BUCKETS + len(STATISTICS)
    stats = np.array([r[2] for r in rows], dtype=np.float32).reshape(-1, len(STATISTICS))
    mean, scale = (stats.mean(axis=0), stats.std(axis=0) + 1e-4) if len(rows) else (np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    model = Model(0.0, np.zeros((size, 1), np.float32), random.normal(0, 0.05, (size, RANK)).astype(np.float32), mean, scale)
    w, v = Adagrad(model.w, 0.1, 1e-5), Adagrad(model.v, 0.05, 1e-4)
    inputs = [model.inputs(*r) for r in rows]
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for start in range(0, len(order), 32):
            ats, dws, dvs = [], [], []
            for k in order[start : start + 32].tolist():
                at, x = inputs[k]
                y, total = model.raw(at, x)
                error = float(sigmoid(np.array(y))) - labels[k]
                ats.append(at)
                dws.append((error * x)[:, None])
                dvs.append(error * x[:, None] * (total - model.v[at] * x[:, None]))
                model.bias -= 0.02 * error
            at = np.concatenate(ats)
            w.step(at, np.concatenate(dws))
            v.step(at, np.concatenate(dvs))
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> Model:
    """Fit on about `per_class` labelled documents of each quality that meet `learn`.

    Features are computed where the texts are; the driver gets those of the sample and fits in numpy. Without
    labelled documents every score is a half.
    """
    sample = labelled_texts(docs, labels, "quality", learn, per_class)

    def make():
        features = Features()
        return lambda texts: zip(*features(texts), strict=True)

    outputs = "buckets array<int>, amounts array<float>, statistics array<float>"
    found = map_texts(sample, "text", outputs, make, drop_text=True).toArrow()
    found = found.sort_by([("label", "ascending")])
    rows = [tuple(np.asarray(found.column(c)[i].values) for c in ("buckets", "amounts", "statistics")) for i in range(found.num_rows)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0].tobytes(), rows[i][2].tobytes()))
    known = found.column("label").to_numpy()
    return fit([rows[i] for i in order], np.array([float(known[i] == 1) for i in order]))


def score_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without its text, with `score` (0 to 1, higher: better) and `predicted` (1 from the threshold on).

    Only the text decides; null texts score like empty ones. Nothing is shuffled, and repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        features, own = Features(), sent.value
        return lambda texts: [[float(sigmoid(np.array(own.raw(*own.inputs(*f))[0]))) for f in features(texts)]]

    return map_texts(docs, text, "score double", make, drop_text=True).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents predicted to be good; all columns stay."""
    return filter_texts(docs, text, lambda wrapped: score_quality(wrapped, model), F.col("predicted") == 1)
