"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.samples import PER_CLASS, WORD, Adagrad, labelled_texts, sigmoid
from strata.llm.texts import Remembered, map_texts

BUCKETS = 1 << 16
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 4
#: Batches of 32 texts that are trained on at least; small samples are gone through more often.
LEAST_STEPS = 400
THRESHOLD = 0.7
#: A word is hashed whole and by its parts of so many bytes, so unseen forms of a word come near the known ones.
PARTS = (4, 5, 6)
REMEMBERED = 200_000
#: Of the sample, one document in so many is not trained on but calibrates the thresholds, with all beyond the sample.
CALIBRATE = 10
#: Characters of text that reach the driver at most, to be fitted on.
SAMPLE_BYTES = 64 << 20
#: Scores are counted in so many bins for the thresholds.
BINS = 1000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def parts_of(word: str) -> list[int]:
    """Embedding rows of a word: its own and those of its parts, edges marked."""
    data = b"<" + word.encode("utf-8", "surrogatepass") + b">"
    found = {crc32(data) % BUCKETS}
    for n in PARTS:
        found.update([crc32(data[i : i + n]) % BUCKETS for i in range(len(data) - n + 1)])
    return sorted(found)


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS x SIZE
    filters: list[np.ndarray]  # per width: width x SIZE x FILTERS
    shift: np.ndarray  # one per filter
    top: np.ndarray
    bias: float = 0.0
    #: Hashes of the texts that the model was fitted on.
    seen: set[int] = field(default_factory=set)

    def wide(self) -> np.ndarray:
        """SIZE x (all positions of all widths, FILTERS each): what a word adds to each filter at each position."""
        return np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)


def convolve(products: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The response of each filter at each position.

    products: what each word adds at each filter position; numbers: word numbers of all texts, each text followed
    by padding.
    """
    rows, best, column = products[numbers], [], 0
    for width in WIDTHS:
        total = rows[:, column : column + FILTERS].copy()
        for j in range(1, width):
            total[:-j] += rows[j:, column + j * FILTERS : column + (j + 1) * FILTERS]
        best.append(total)
        column += width * FILTERS
    return np.concatenate(best, axis=1)


def padded(texts_words: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of all texts in a row, each text followed by padding, and the starts."""
    gap = np.full(max(WIDTHS), pad, dtype=np.int64)
    pieces = [x for words in texts_words for x in (words, gap)]
    sizes = np.array([len(w) + len(gap) for w in texts_words])
    return np.concatenate(pieces), np.cumsum(sizes) - sizes


def fit(texts: list[list[str]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Adagrad on the logistic loss, 32 texts at a time; gradients flow to the highest response of each filter."""
    random = np.random.default_rng(seed)
    many = FILTERS * len(WIDTHS)
    filters = [random.normal(0, 1 / np.sqrt(SIZE * w), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    model = Model(random.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32), filters, np.zeros(many, np.float32), random.normal(0, 0.3, many).astype(np.float32))
    numbers: dict[str, int] = {}
    rows = [np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64) for words in texts]
    parts = [np.array(parts_of(w), dtype=np.int64) for w in numbers] + [np.zeros(0, np.int64)]
    pad = len(parts) - 1
    steps = Adagrad(model.embedding, 0.1)
    dense = [Adagrad(f.reshape(1, -1), 0.05) for f in model.filters]
    tops, shifts = Adagrad(model.top.reshape(1, -1), 0.05), Adagrad(model.shift.reshape(1, -1), 0.05)
    for _ in range(max(epochs, -(-32 * LEAST_STEPS // max(1, len(rows))))):
        order = random.permutation(len(rows))
        for begin in range(0, len(order), 32):
            chosen = order[begin : begin + 32]
            flat, starts = padded([rows[k] for k in chosen.tolist()], pad)
            words, local = np.unique(flat, return_inverse=True)
            own = [parts[w] for w in words.tolist()]
            sizes = np.array([len(p) for p in own])
            vectors = np.zeros((len(words), SIZE), np.float32)
            some = np.flatnonzero(sizes)
            if len(some):
                edges = np.cumsum(sizes[some]) - sizes[some]
                vectors[some] = np.add.reduceat(model.embedding[np.concatenate(own)], edges, axis=0) / np.sqrt(sizes[some])[:, None]
            response = convolve(vectors @ model.wide(), local)
            ends = np.append(starts[1:], len(flat))
            at = np.array([a + response[a : b - max(WIDTHS) + 1].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
            high = response[at, np.arange(many)] + model.shift
            hidden = np.maximum(high, 0)
            error = sigmoid(hidden @ model.top + model.bias) - labels[chosen]
            back = error[:, None] * model.top * (high > 0)
            tops.step(np.zeros(len(error), int), error[:, None] * hidden)
            shifts.step(np.zeros(len(error), int), back)
            model.bias -= 0.02 * float(error.sum())
            grads = np.zeros_like(vectors)
            for k, width in enumerate(WIDTHS):
                mine = slice(k * FILTERS, (k + 1) * FILTERS)
                change = np.zeros_like(model.filters[k])
                for j in range(width):
                    who = local[np.minimum(at[:, mine] + j, len(local) - 1)]
                    change[j] = np.einsum("dfs,df->sf", vectors[who], back[:, mine])
                    np.add.at(grads, who, back[:, mine, None] * model.filters[k][j].T[None])
                dense[k].step(np.zeros(1, int), change.reshape(1, -1))
            used = np.flatnonzero(np.abs(grads).sum(axis=1) * (sizes > 0))
            if len(used):
                spread = np.repeat(grads[used] / np.sqrt(sizes[used])[:, None], sizes[used], axis=0)
                steps.step(np.concatenate([own[k] for k in used.tolist()]), spread)
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model, self.wide = model, model.wide()
        self.words = Remembered(self._products, self.wide.shape[1], REMEMBERED)

    def _products(self, words: list[str]) -> np.ndarray:
        """What each word adds to each filter at each position."""
        rows = [parts_of(w) for w in words]
        sizes = np.array([len(r) for r in rows])
        sums = np.add.reduceat(self.model.embedding[[x for r in rows for x in r]], np.cumsum(sizes) - sizes, axis=0)
        return sums / np.sqrt(sizes)[:, None] @ self.wide

    def __call__(self, texts: list[str | None]) -> list[float]:
        split = [words_of(t) for t in texts]
        numbers = self.words.numbers(list(chain.from_iterable(split)))
        found, group, held, end = [], [], 0, 0
        for words in split:
            rows = numbers[end : end + len(words)]
            end += len(words)
            if held and held + len(rows) > 1 << 16:
                found += self._score(group)
                group, held = [], 0
            group.append(rows)
            held += len(rows)
        return found + (self._score(group) if group else [])

    def _score(self, group: list[np.ndarray]) -> list[float]:
        flat, starts = padded(group, 0)
        response = convolve(self.words.table, flat)
        # The words of a text and the first position of its padding: no window reaches the next text.
        ends = starts + [len(rows) + 1 for rows in group]
        high = np.maximum.reduceat(response, np.stack([starts, ends], axis=1).ravel(), axis=0)[::2] + self.model.shift
        return sigmoid(np.maximum(high, 0) @ self.model.top + self.model.bias).tolist()


def calibrate(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The threshold with the best F1; the middle of the gap where several do equally well. Equal scores stay together."""
    if not len(scores) or labels.min() == labels.max():
        return THRESHOLD
    order = np.argsort(-scores)
    scores, labels = scores[order], labels[order]
    weights = np.ones(len(scores)) if weights is None else weights[order]
    f1 = 2 * np.cumsum(weights * labels) / (np.cumsum(weights) + (weights * labels).sum())
    f1[:-1][scores[:-1] == scores[1:]] = -1
    k = int(f1.argmax())
    below = scores[k + 1] if k + 1 < len(scores) else 0.0
    return float((scores[k] + below) / 2)


def counted(scored: DataFrame, labels: DataFrame, learn: Column) -> list[tuple[str, int, int, bool, int]]:
    """(language, label, bin of the score, whether fitted on, rows) over all labelled documents that meet `learn`.

    scored: `doc_id`, `lang`, `score`, `fitted` of all documents. These narrow rows are joined with the labels; no
    text moves, and only the counts reach the driver.
    """
    known = labels.where(learn).where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("toxic") == 1).cast("int").alias("label"))
    at = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    joined = scored.where(learn).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "score", "fitted").join(known, "doc_id")
    return [tuple(r) for r in joined.groupBy("lang", "label", at, "fitted").count().collect()]


def thresholds(counts: list[tuple[str, int, int, bool, int]]) -> dict[str, float]:
    """The threshold of each language, from the rows that were not fitted on, weighted so that each class has its share
    of all rows. A language that lacks such rows of a class gets the threshold of all languages together.
    """

    def of(rows: list[tuple[int, int, bool, int]]) -> float | None:
        every, left = Counter(), Counter()
        for _, label, fitted, n in rows:
            every[label] += n
            left[label] += 0 if fitted else n
        kept = sorted((at, label, n * every[label] / left[label]) for at, label, fitted, n in rows if not fitted)
        if not left[0] or not left[1]:
            return None
        at, known, weights = (np.array(c, dtype=float) for c in zip(*kept, strict=True))
        return calibrate((at + 0.5) / BINS, known, weights)

    rows = defaultdict(list)
    for lang, label, at, fitted, n in counts:
        rows[lang].append((at, label, fitted, n))
    common = of([r for own in rows.values() for r in own])
    common = THRESHOLD if common is None else common
    return {lang: common if (own := of(rows[lang])) is None else own for lang in sorted(rows)}


def _hash(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"))


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> Model:
    """Fit on about `per_class` labelled documents of each class that meet `learn`, in an order by hash and of at most
    SAMPLE_BYTES in all; a tenth of them is left for the thresholds.
    """
    sample = labelled_texts(docs, labels, "toxic", learn, per_class).select(F.coalesce("text", F.lit("")).alias("text"), "label")
    found, held = [], 0
    for row in sample.orderBy(F.crc32("text"), "text", "label").toLocalIterator():
        held += len(row.text)
        if found and held > SAMPLE_BYTES:
            break
        found.append(row)
    rest = [r for i, r in enumerate(found) if i % CALIBRATE]
    model = fit([words_of(r.text) for r in rest], np.array([float(r.label == 1) for r in rest]))
    model.seen = {_hash(r.text) for r in rest}
    return model


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without its text, with `score` (0 to 1, higher: likelier toxic), `fitted` (whether the model was fitted on
    the same text) and `predicted` (1 from 0.7 on).

    Only the text decides the score; null texts score like empty ones. Nothing is shuffled, and repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score, seen = Scorer(sent.value), sent.value.seen
        return lambda texts: [pa.array(score(texts), pa.float64()), pa.array([_hash(t) in seen for t in texts], pa.bool_())]

    scored = map_texts(docs, text, "score double, fitted boolean", make, drop_text=True)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def flag(scored: DataFrame, labels: DataFrame, learn: Column, language: str = "lang") -> DataFrame:
    """`scored` with `flagged`: 1 from the threshold of the row's language on.

    Thresholds come from the scores of all labelled documents that meet `learn`, less those fitted on; the language
    is no input of a score. `scored` is used twice, so hand in a frame that is kept (a checkpoint or a table).
    """
    narrow = scored.select("doc_id", F.col(language).alias("lang"), "score", "fitted")
    found = thresholds(counted(narrow, labels, learn))
    limits = F.create_map(*[F.lit(x) for pair in found.items() for x in pair]) if found else F.create_map().cast("map<string,double>")
    limit = F.coalesce(F.try_element_at(limits, F.coalesce(F.col(language), F.lit(""))), F.lit(THRESHOLD))
    return scored.withColumn("flagged", (F.col("score") >= limit).cast("int"))
