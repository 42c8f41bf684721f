"""Language identification: known words by their frequency per language, unseen ones by shorter and shorter n-grams."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.samples import WORD, per_class
from strata.llm.texts import Remembered, filter_texts, map_texts, slices

#: Documents of each language that the tables are counted over, about.
SAMPLE = 1000
#: Entries of the tables of words and n-grams that are kept for each language.
ENTRIES = 20_000
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
#: Distinct words that a Python worker remembers.
REMEMBERED = 200_000
#: A document is kept if its language is known with this score.
LEAST = 0.5


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return WORD.findall((text or "").lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Languages in order, and log frequencies per language: `logs` has a row for each word (order 0) and n-gram that
    is known, `rows` finds it by order and entry.
    """

    languages: list[str]
    rows: dict[int, dict[str, int]]
    logs: np.ndarray

    def found(self, word: str) -> list[int]:
        """The rows a word is judged by: its own, else its known n-grams of the highest order that has any."""
        known = self.rows[0].get(word)
        if known is not None:
            return [known]
        for n in ORDERS:
            have = self.rows[n]
            found = [have[g] for g in grams_of(word, n) if g in have]
            if found:
                return found
        return []

    def of_words(self, words: list[str]) -> np.ndarray:
        """Per word the mean log frequencies of its rows, and 1 if it has a letter."""
        found = [self.found(letters) if (letters := w if w.isalpha() else "".join(filter(str.isalpha, w))) else None for w in words]
        sizes = np.array([len(f) if f else 0 for f in found])
        out = np.zeros((len(words), len(self.languages) + 1), dtype=np.float32)
        out[:, -1] = [f is not None for f in found]
        some = np.flatnonzero(sizes)
        if len(some):
            flat = self.logs[[r for f in found if f for r in f]]
            out[some, :-1] = np.add.reduceat(flat, (np.cumsum(sizes) - sizes)[some], axis=0) / sizes[some, None]
        return out


def count_entries(rows: DataFrame, text: str, language: str) -> DataFrame:
    """`language`, `n` (0: words), `entry`, `times` of all given rows."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words: dict[str, Counter] = {}
                for lang, text in zip(part.column("language").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words.setdefault(lang, Counter()).update(w for w in words_of(text) if w.isalpha())
                found: Counter = Counter()
                for lang, counted in words.items():
                    for word, times in counted.items():
                        found[lang, 0, word] += times
                        for n in ORDERS:
                            for gram in grams_of(word, n):
                                found[lang, n, gram] += times
                columns = zip(*((*key, times) for key, times in found.items()), strict=True)
                kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
                names = ["language", "n", "entry", "times"]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    counted = rows.select(F.col(language).alias("language"), F.col(text).alias("text")).mapInArrow(run, "language string, n int, entry string, times long")
    return counted.groupBy("language", "n", "entry").agg(F.sum("times").alias("times"))


def train(rows: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """Count words and n-grams over about `sample` documents of each language; Spark counts, the driver gets the
    most frequent `entries` of each language and order.
    """
    counted = count_entries(per_class(rows, language, key, sample), text, language)
    best = Window.partitionBy("language", "n").orderBy(F.desc("times"), "entry")
    kept = counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= entries).drop("place")
    found = kept.toArrow().to_pydict()
    languages = sorted(set(found["language"]))
    at = {x: i for i, x in enumerate(languages)}
    rows: dict[int, dict[str, int]] = {n: {} for n in (0, *ORDERS)}
    entries_at = [rows[n].setdefault(entry, sum(map(len, rows.values()))) for n, entry in zip(found["n"], found["entry"], strict=True)]
    counts = np.zeros((sum(map(len, rows.values())), len(languages)))
    counts[entries_at, [at[x] for x in found["language"]]] = found["times"]
    logs = np.zeros_like(counts)
    for table in rows.values():
        if table:
            own = list(table.values())
            logs[own] = np.log((counts[own] + 0.5) / (counts[own].sum(axis=0) + 0.5 * len(own)))
    return Model(languages, rows, logs)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.words = Remembered(model.of_words, len(model.languages) + 1, REMEMBERED)

    def __call__(self, texts: list[str | None]):
        """Predicted language and score of each text."""
        split = [words_of(t) for t in texts]
        ends = np.cumsum([len(w) for w in split])
        numbers = self.words.numbers(list(chain.from_iterable(split)))
        found, scores = [], []
        for words, end in zip(split, ends.tolist(), strict=True):
            sums = self.words.table[numbers[end - len(words) : end]].sum(axis=0, dtype=np.float64)
            n = sums[-1]
            if not n or not self.model.languages:
                found.append(UNKNOWN)
                scores.append(0.0)
                continue
            logs = sums[:-1] / n * min(n, 20.0)
            odds = np.exp(logs - logs.max())
            found.append(self.model.languages[int(odds.argmax())])
            scores.append(float(odds.max() / odds.sum()))
        return found, scores


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without its text, with `lang_pred` and `score`.

    Only the text decides. The score is the share of the predicted language, from the mean log frequency per word,
    weighted as if the text had at most 20 words. A null text, a text without letters, and any text if
    no language was learned give `und` and 0. Ties go to the language first in order. Repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, text, "lang_pred string, score double", lambda: Scorer(sent.value), drop_text=True)


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = LEAST) -> DataFrame:
    """The documents whose language is known with a score of at least `least`; all columns stay."""
    known: Column = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    return filter_texts(docs, text, lambda wrapped: identify(wrapped, model), known)
