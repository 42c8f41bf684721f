"""Bounded samples of labelled rows, the only rows that classifiers are fitted on."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each class that a classifier is fitted on, about; all rows of a smaller class are taken.
PER_CLASS = 3000
_SCALE = 1_000_000

#: Runs of letters (and letter-like numbers) of a lower-cased text.
WORD = re.compile(r"[^\W\d_]+")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n, F.lit(0))


def per_class(rows: DataFrame, label: str, key: str, n: int = PER_CLASS, classes: int = 1000) -> DataFrame:
    """About `n` rows of each class, chosen by a hash of the key, so that the same rows give the same sample.

    Only the label is read to count the classes; of more than `classes` classes the largest are taken. Rows with a
    null label or key are not labelled.
    """
    named = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    counted = named.groupBy(label).count().orderBy(F.desc("count"), label).limit(classes).collect()
    if not counted:
        return named.limit(0)
    shares = [x for row in counted for x in (F.lit(row[0]), F.lit(min(_SCALE, -(-_SCALE * n // row[1]))))]
    return named.where(F.pmod(F.xxhash64(key), F.lit(_SCALE)) < F.coalesce(F.try_element_at(F.create_map(*shares), F.col(label)), F.lit(0)))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, n: int = PER_CLASS, more: tuple[str, ...] = ()) -> DataFrame:
    """`text` and `label` of a sample of the labelled documents that meet `learn` (a condition on doc_id).

    The sample of the labels is sent to the documents: about n rows for each class, so it stays small.
    Documents that repeat an id and ids labelled twice add rows of their own.
    """
    chosen = per_class(labels.where(learn).select("doc_id", label), label, "doc_id", n)
    joined = docs.select("doc_id", "text", *more).join(F.broadcast(chosen), "doc_id")
    return joined.select("text", F.col(label).cast("int").alias("label"), *more)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adagrad:
    """Steps for rows of a parameter table; only the rows with a gradient are touched."""

    def __init__(self, values: np.ndarray, rate: float, decay: float = 0.0):
        self.values, self.rate, self.decay = values, rate, decay
        self.seen = np.full(values.shape, 1e-6, dtype=values.dtype)

    def step(self, rows: np.ndarray, grads: np.ndarray) -> None:
        """Gradients of the same row are added up first."""
        order = np.argsort(rows, kind="stable")
        rows, grads = rows[order], grads[order]
        if not len(rows):
            return
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        rows, grads = rows[starts], np.add.reduceat(grads, starts, axis=0) + self.decay * self.values[rows[starts]]
        self.seen[rows] += grads**2
        self.values[rows] -= self.rate * grads / np.sqrt(self.seen[rows])
