"""Run a function over the texts of a table, in Arrow batches of bounded size, next to the other columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Text bytes that are turned into Python objects at once.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `limit` bytes of text; a row is never cut."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    text: str,
    outputs: str,
    make: Callable[[], Callable[[list[str | None]], Iterable]],
    drop_text: bool = False,
) -> DataFrame:
    """Append columns computed from a text column; nothing is shuffled and every row stays.

    outputs: the new columns as a DDL string. `make` runs once per task and gives a function from a list of
    texts (null: None) to one sequence per new column. Input columns with the name of a new one (in any case)
    are replaced.
    """
    added = T._parse_datatype_string(outputs)
    taken = {f.name.lower() for f in added.fields} | ({text.lower()} if drop_text else set())
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    names = [f.name for f in kept]
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, "__text"):
                new = work(part.column("__text").to_pylist())
                columns = [part.column(n) for n in names]
                columns += [v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in zip(new, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names + added.names)

    source = df.select(*[df[f"`{n}`"] for n in names], df[f"`{text}`"].alias("__text"))
    return source.mapInArrow(run, T.StructType(kept + added.fields))


def filter_texts(df: DataFrame, text: str, mark: Callable[[DataFrame], DataFrame], condition: Column) -> DataFrame:
    """The rows that meet a condition on what `mark` adds to (`__doc`, `text`); no column can clash."""
    wrapped = df.select(F.struct("*").alias("__doc"), df[f"`{text}`"].alias("text"))
    return mark(wrapped).where(condition).select("__doc.*")


class Remembered:
    """A table with a row for each distinct word a Python worker has met; row 0 is all zero, for padding.

    Beyond `limit` words, those met once are forgotten. Results don't depend on what is remembered.
    """

    def __init__(self, rows_of: Callable[[list[str]], np.ndarray], width: int, limit: int, dtype=np.float32):
        self.rows_of, self.limit = rows_of, limit
        self.number: dict[str, int] = {}
        self.table, self.met = np.zeros((1, width), dtype), np.zeros(1, np.int64)
        self._used = 1

    def _trim(self) -> None:
        kept = np.flatnonzero(self.met[: self._used] > 1)
        kept = kept[kept > 0]
        if len(kept) > self.limit // 2:
            kept = kept[:0]
        new = np.full(self._used, -1)
        new[kept] = np.arange(1, len(kept) + 1)
        self.number = {w: int(new[k]) for w, k in self.number.items() if new[k] > 0}
        self.table = self.table[np.append(0, kept)]
        self.met = np.append(0, np.ones(len(kept), np.int64))
        self._used = len(self.table)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The row of each word. Rows are valid until the next call."""
        if self._used > self.limit:
            self._trim()
        fresh = list(set(words).difference(self.number))
        for begin in range(0, len(fresh), 4096):
            part = fresh[begin : begin + 4096]
            end = self._used + len(part)
            while end > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.met = np.concatenate([self.met, np.zeros_like(self.met)])
            self.table[self._used : end] = self.rows_of(part)
            self.number.update(zip(part, range(self._used, end), strict=True))
            self._used = end
        found = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.met += np.bincount(found, minlength=len(self.met))
        return found

    def of(self, words: list[str]) -> np.ndarray:
        """The rows of the words themselves."""
        numbers = self.numbers(words)
        return self.table[numbers]
