"""SimHash, decontamination and vectors against plain versions."""

import hashlib
import itertools
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from strata.llm import decontaminate, simhash, vectors
from strata.llm.components import connected_components
from strata.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_components(n, links):
    """The smallest member that each of n numbers reaches."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_simhash(rows):
    """(fingerprint, component) for (doc_id, text) rows."""
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = plain_components(len(rows), links)
    lowest = {}
    for (doc_id, _), root in zip(rows, roots, strict=True):
        if doc_id is not None:
            lowest[root] = min(doc_id, lowest.get(root, doc_id))
    return [(d, f"{p:016x}", lowest.get(r)) for (d, _), p, r in zip(rows, prints, roots, strict=True)]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert order(QUERIES["op1_simhash"](spark, SF_DIR).collect()) == order(plain_simhash(rows))


def test_simhash_messy_rows(messy, nothing):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert order(simhash.near_duplicates(messy).collect()) == order(plain_simhash(rows))
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_of_each_group_stays(messy):
    kept = simhash.keep_first(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 6, 7, 8, 9]
    assert kept.where("doc_id IS NULL").count() == 2


def test_rows_that_share_an_id_are_judged_by_their_own_groups(spark):
    first, other = "alpha beta gamma delta epsilon", "totally different words stand here now"
    rows = [(1, first), (1, other), (2, other), (2, first), (2, other), (3, "one more text of its own"), (0, first)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, kept.collect())) == [(0, first), (1, other), (3, "one more text of its own")]


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    draw = random.Random(radius)
    for _ in range(3000):
        flips = sum(1 << b for b in draw.sample(range(64), radius))
        assert any(m & flips == 0 for m in masks)


@pytest.mark.parametrize("in_task", [1, 4, 10_000])
def test_buckets_of_any_size_link_the_same(spark, in_task):
    """Around some centres many values a few bits apart, and random ones; small limits use flipped bits."""
    draw = random.Random(5)
    centres = [draw.getrandbits(64) for _ in range(3)]
    values = {c ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for c in centres for _ in range(60)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values | {draw.getrandbits(64) for _ in range(50)})
    unsigned = [v % (1 << 64) for v in values]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (unsigned[i] ^ unsigned[j]).bit_count() <= 3]
    expected = plain_components(len(values), pairs)
    links = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in values], "bits long"), in_task=in_task).collect()
    at = {v: i for i, v in enumerate(values)}
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 3 for r in links)
    assert plain_components(len(values), [(at[r.a], at[r.b]) for r in links]) == expected


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5), (None, 3), (2000, 1000)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(301), 0), **dict.fromkeys([*range(1000, 1400), 2000], 1000)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_spans(text, items):
    """(n_words, n_hit, ids of the items found)."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, theirs in items:
        n = min(13, len(theirs))
        windows = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for p in range(len(words) - n + 1):
            if n and tuple(words[p : p + n]) in windows:
                hit.update(range(p, p + n))
                found.add(item)
    return len(words), len(hit), sorted(found)


def plain_items(rows):
    return [(str(i), re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for i, t in rows if i is not None]


@pytest.mark.parametrize("block_bytes", [1 << 25, 700])
def test_decontamination_of_small_texts(spark, block_bytes):
    """Few distinct words, so that windows repeat, overlap and meet at edges; short, repeated and empty items."""
    draw = random.Random(11)
    some = lambda n: " ".join(draw.choice(["Ab", "c", "D-e", "ü"]) for _ in range(n))
    items = [(k, some(draw.choice([0, 1, 3, 6, 12, 13, 14, 30]))) for k in range(25)] + [(3, "c c c c c"), (None, "c"), (99, None)]
    long = [items[k][1] for k in range(25) if len(items[k][1]) > 60]
    texts = [(k, some(draw.randint(0, 60)) + " " + draw.choice(long) + " " + some(5)) for k in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, spans int, N_HIT int").repartition(3)
    found = decontaminate.shared_spans(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    expected = {d: plain_spans(t, plain_items(items)) for d, t in texts}
    rows = found.collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == expected and len(rows) == len(texts)
    for r in rows:
        assert len({w for s in r.spans for w in range(s.start, s.end)}) == r.n_hit


def test_decontamination_query(spark):
    items = plain_items([(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()])
    rows = {r.doc_id: r for r in QUERIES["op2_decontaminate"](spark, SF_DIR).collect()}
    for d in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        n, hit, ids = plain_spans(d.text, items)
        r = rows[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0 and 20 * hit >= n)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert any(r.contaminated for r in rows.values())


def test_decontamination_keeps_all_columns(spark, messy, nothing):
    items = spark.createDataFrame([(1, messy.first().text)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(messy, items)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 3
    assert decontaminate.drop_contaminated(nothing, items).count() == 0
    assert decontaminate.drop_contaminated(messy, items.limit(0)).count() == messy.count()


def plain_vectors(rows, threshold=0.98):
    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    def sound(e, label):
        return label is not None and e is not None and any(e) and all(x is not None and math.isfinite(x) for x in e)

    fine = [i for i, (_, e, label) in enumerate(rows) if sound(e, label)]
    links = [
        (i, j) for i, j in itertools.combinations(fine, 2)
        if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= threshold
    ]
    roots = plain_components(len(rows), links)
    lowest, counts = {}, [0] * len(rows)
    for i, r in enumerate(roots):
        if rows[i][0] is not None:
            lowest[r] = min(rows[i][0], lowest.get(r, rows[i][0]))
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    return [(v[0], counts[i], lowest.get(roots[i]), v[0] is not None and v[0] == lowest.get(roots[i])) for i, v in enumerate(rows)]


@pytest.mark.parametrize("tile", [5, 1024])
def test_vectors_against_all_pairs(spark, tile):
    draw = random.Random(2)
    centres = [[draw.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    near = lambda c, s: [x + draw.gauss(0, s) for x in c]
    rows = [(k, near(centres[k % 6], draw.choice([0, 0.02, 0.1, 0.15, 0.6])), k % 2) for k in range(300)]
    rows += [(300, [1.0] * 7, 1), (301, [2.0] * 7, 1), (302, [1.0] * 7, None), (303, None, 1), (304, [0.0] * 16, 1), (305, [], 1)]
    rows += [(306, [1.0, None] * 8, 1), (307, [float("nan")] * 16, 1), (308, [float("inf")] * 16, 0), (None, centres[0], 0), (4, centres[4], 0)]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile=tile)
    assert order(found.collect()) == order(plain_vectors(rows))
    assert sum(r.n_links for r in found.collect()) > 1000


def test_vectors_of_nothing(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    one = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in vectors.near_vectors(one).collect()] == [(1, 0, 1, True)]


def test_codes_find_every_link_of_the_table(spark):
    """Recall against all pairs is 1: the query equals its SQL, which compares all pairs."""
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert order(QUERIES["op6_vectors"](spark, SF_DIR).select("vec_id", "n_links", "component_id", "kept").collect()) == order(plain_vectors(rows))
