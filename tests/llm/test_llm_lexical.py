"""Ranked search against a plain version."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connect

from strata.llm import lexical
from strata.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans(lexical.UPPER, lexical.LOWER)


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k=10):
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, words = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for (d, c), size in zip(counts, sizes, strict=True):
            m = 10 + 90 * size * n // max(words, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query(spark):
    assert compare(QUERIES["op11_lexical"](spark, SF_DIR), connect(SF_DIR), ORACLES["op11_lexical"]) is None


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_with_ties_and_copies(spark, seed):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)]
    texts = [" ".join(r.choices(words, k=r.choice([1, 2, 5, 30]))) for _ in range(60)]
    docs = [(r.choice([None, *range(500)]), r.choice(texts)) for _ in range(900)]
    items = [(i, " ".join(r.choices(words, k=12))) for i in range(15)] + [(3, "w1 w2"), (None, "w1"), (90, None), (91, ""), (92, "unseen")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = lexical.search(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=[1 << 20, 100][seed % 2])
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and order(found.collect()) == order(plain(docs, items))


def lists(rows, weights):
    """rows: (doc_id, {term: tf}); every document has ten words."""
    terms, tfs = [sorted(r[1]) for r in rows], [[r[1][t] for t in sorted(r[1])] for r in rows]
    kind = pa.list_(pa.int32())
    return lexical.Lists(pa.array([r[0] for r in rows], pa.int64()), np.full(len(rows), 10), pa.array(terms, kind), pa.array(tfs, kind), np.array(weights), len(rows), 10 * len(rows))


def test_stops_early_and_only_strictly_below(monkeypatch):
    monkeypatch.setattr(lexical, "FIRST_READ", 1)
    monkeypatch.setattr(lexical, "MOST_READ", 1)
    rows = [(i, {0: 50 - i // 2, 1: 50 - i // 2}) for i in range(90)]
    index = lists(rows, [1000, 1000])
    asked, access = [], index.positions
    monkeypatch.setattr(index, "positions", lambda term, docs: asked.extend(docs.tolist()) or access(term, docs))
    top, scores = index.best([0, 1], 3, np.zeros(0, np.int64))
    assert top.tolist() == [0, 1, 2] and scores[0] == scores[1] > scores[2]
    assert max(asked) <= 4  # equal to the third is read on, below it is not
    asked.clear()
    index.best([0, 1], 3, np.array([10**12] * 3))
    assert max(asked) == 0  # better documents are known from before


def test_best_position_is_beyond_the_last_read(monkeypatch):
    monkeypatch.setattr(lexical, "FIRST_READ", 1)
    monkeypatch.setattr(lexical, "MOST_READ", 1)
    # List 0: 0 1 2 3 ..., list 1: 1 0 2 3 ... so that a first round marks two positions of each.
    rows = [(0, {0: 40, 1: 39}), (1, {0: 39, 1: 40}), *[(i, {0: 3, 1: 3}) for i in range(2, 50)]]
    index = lists(rows, [1000, 1000])
    asked, access = [], index.positions
    monkeypatch.setattr(index, "positions", lambda term, docs: asked.append(docs.tolist()) or access(term, docs))
    assert index.best([0, 1], 2, np.zeros(0, np.int64))[0].tolist() == [0, 1]
    assert sum(map(len, asked)) <= 8 and len(asked) <= 4


def test_rows_of_every_kind(messy, nothing, spark):
    items = spark.createDataFrame([(1, "The quick FOX no words", 5), (2, "word", 5), (3, "½ àé", 5), (4, None, 5)], "item_id long, text string, rank int")
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert order(lexical.search(messy, items).collect()) == order(plain(rows, [(r.item_id, r.text) for r in items.collect()]))
    assert lexical.search(nothing, items).count() == 0 and lexical.search(messy, items.limit(0)).count() == 0
