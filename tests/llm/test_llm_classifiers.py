"""Classifiers: held-out accuracy, what their scores may depend on, and rows of every kind."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import lang_id, quality, toxicity
from strata.llm.components import cut
from strata.llm.queries import QUERIES
from strata.llm.samples import per_class
from strata.llm.texts import Remembered

SF_DIR = "/root/testdata/sf0.01"


def rows_of(spark, name, key="doc_id"):
    return {r[key]: r for r in spark.read.parquet(f"{SF_DIR}/{name}.parquet").collect()}


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def held_out(spark, query, n, at, label):
    """(true, row) of the labelled documents that were held out."""
    found = QUERIES[query](spark, SF_DIR).collect()
    assert len(found) == len(rows_of(spark, "documents"))
    assert all(r.held_out == (fold(r.doc_id, n) == at) and 0 <= r.score <= 1 for r in found)
    known = rows_of(spark, "labels") if label else rows_of(spark, "documents")
    return [(known[r.doc_id][label or "lang"], r) for r in found if r.held_out and r.doc_id in known]


def test_language_query(spark):
    pairs = held_out(spark, "op7_language", 5, 0, None)
    assert np.mean([lang == r.lang_pred for lang, r in pairs]) > 0.97


def test_quality_query(spark):
    pairs = held_out(spark, "op10_quality", 5, 0, "quality")
    assert all(r.predicted == int(r.score >= 0.3) for _, r in pairs)
    assert np.mean([q == r.predicted for q, r in pairs]) > 0.95


def test_toxicity_query(spark):
    pairs = held_out(spark, "op5_toxicity", 3, 1, "toxic")
    assert all(r.predicted == int(r.score >= 0.7) for _, r in pairs)
    assert np.mean([t == r.predicted for t, r in pairs]) > 0.95
    toxic, rest = [r.score for t, r in pairs if t], [r.score for t, r in pairs if not t]
    assert np.mean([a > b for a in toxic for b in rest]) > 0.9


@pytest.fixture(scope="module")
def models(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    return lang_id.train(docs), quality.train(docs, labels, F.lit(True)), toxicity.train(docs, labels, F.lit(True))


def test_messy_rows(messy, nothing, models):
    language, good, toxic = models
    labels = messy.select("doc_id", F.lit(1).alias("toxic"))
    found = {r.doc_id: r for r in lang_id.identify(messy, language).collect()}
    assert {k for k, r in found.items() if r.lang_pred == "und"} == {3, 4, 5, 9, None} or {k for k, r in found.items() if r.lang_pred == "und"} == {3, 4, 5, 9}
    assert all(r.score == 0 for r in found.values() if r.lang_pred == "und")
    for scored in (quality.score_quality(messy, good), toxicity.score_toxicity(messy, toxic), toxicity.flag(toxicity.score_toxicity(messy, toxic), labels, F.lit(True))):
        rows = scored.collect()
        assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
        assert "text" not in scored.columns and len({c.lower() for c in scored.columns}) == len(scored.columns)
    assert lang_id.keep_identified(messy, language).columns == messy.columns == quality.keep_good(messy, good).columns
    assert [f(nothing).count() for f in (lambda d: lang_id.identify(d, language), lambda d: quality.score_quality(d, good), lambda d: toxicity.score_toxicity(d, toxic))] == [0, 0, 0]


def test_only_the_text_decides(messy, models):
    language, good, toxic = models
    other = messy.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")).withColumn("doc_id", F.lit(1).cast("long"))
    for run in (lambda d: lang_id.identify(d, language), lambda d: quality.score_quality(d, good), lambda d: toxicity.score_toxicity(d, toxic)):
        assert Counter(r.score for r in run(messy).collect()) == Counter(r.score for r in run(other).collect())


def test_training_without_rows(spark, nothing, messy):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.lang_pred for r in lang_id.identify(messy, lang_id.train(nothing)).collect()} == {"und"}
    assert quality.score_quality(messy, quality.train(messy, labels, F.lit(True))).count() == messy.count()
    assert toxicity.score_toxicity(messy, toxicity.train(messy, labels, F.lit(True))).count() == messy.count()


def test_samples_are_bounded_and_repeatable(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 10 = 0, 'rare', 'common') AS label").union(spark.sql("SELECT null, 'x'"))
    found = Counter(r.label for r in per_class(rows, "label", "doc_id", 1000).collect())
    assert 850 < found["rare"] < 1150 and 850 < found["common"] < 1150 and found["x"] == 0
    assert per_class(rows, "label", "doc_id", 10_000).where("label = 'rare'").count() == 2000


def test_pairs_in_linear_time():
    random = np.random.default_rng(1)
    size = quality.BUCKETS + len(quality.STATISTICS)
    model = quality.Model(0.3, random.normal(size=(size, 1)), random.normal(size=(size, quality.RANK)), np.zeros(15), np.ones(15))
    at, x = random.choice(size, 20, replace=False), random.normal(size=20)
    pairs = sum(model.v[at[i]] @ model.v[at[j]] * x[i] * x[j] for i in range(20) for j in range(i))
    assert model.raw(at, x)[0] == pytest.approx(0.3 + model.w[at, 0] @ x + pairs)


def test_backoff_goes_to_shorter_grams():
    rows = {n: {} for n in (0, 5, 4, 3, 2, 1)}
    rows[0]["the"], rows[3]["<th"], rows[1]["x"], rows[1]["y"] = 0, 1, 2, 3
    logs = np.array([[-1.0, -9.0], [-2.0, -3.0], [-5.0, -4.0], [-1.0, -2.0]])
    found = lang_id.Model(["a", "b"], rows, logs).of_words(["the", "thy", "xy", "q", "½", "½the"])
    assert found.tolist() == [[-1, -9, 1], [-2, -3, 1], [-3, -3, 1], [0, 0, 1], [0, 0, 0], [-1, -9, 1]]


def test_forgetting_changes_nothing():
    words = Remembered(lambda part: np.array([[len(w), ord(w[0])] for w in part], dtype=np.float32), 2, 3)
    for text in ("a bb a", "ccc d e f a", "bb a", "g h i j k a bb", "a"):
        assert words.of(text.split()).tolist() == [[len(w), ord(w[0])] for w in text.split()]
    assert len(words.number) < 11 and words.table[0].tolist() == [0, 0]


def plain_score(model, words):
    vectors = [model.embedding[toxicity.parts_of(w)].sum(axis=0) / np.sqrt(len(toxicity.parts_of(w))) for w in words]
    vectors += [np.zeros(toxicity.SIZE)] * 3
    high = []
    for filters in model.filters:
        every = [sum(vectors[p + j] @ filters[j] for j in range(len(filters)) if p + j < len(vectors)) for p in range(len(vectors))]
        high.append(np.max(every, axis=0))
    hidden = np.maximum(np.concatenate(high) + model.shift, 0)
    return 1 / (1 + np.exp(-(hidden @ model.top + model.bias)))


def test_scores_are_those_of_the_network(models, monkeypatch):
    model = models[2]
    texts = ["one two three two", "", None, "a", "words that nobody saw before " * 30]
    expected = [plain_score(model, toxicity.words_of(t)) for t in texts]
    assert toxicity.Scorer(model)(texts) == pytest.approx(expected, abs=1e-4)
    monkeypatch.setattr(toxicity, "REMEMBERED", 2)
    scorer = toxicity.Scorer(model)
    assert [scorer([t])[0] for t in texts] == pytest.approx(expected, abs=1e-4)


def test_thresholds():
    assert toxicity.calibrate(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1.0, 1, 0, 0])) == pytest.approx(0.55)
    assert toxicity.calibrate(np.array([]), np.array([])) == toxicity.THRESHOLD


def test_thresholds_come_from_all_labelled_rows(spark):
    vile, nice = "you vile foul rotten thing", "what a nice good sunny day"
    rows = [(i, f"{vile if i % 10 == 0 else nice} number{chr(97 + i % 26)} {chr(97 + i // 26 % 26)}word", "aa" if i % 50 > 1 else "bb", int(i % 10 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    learn = F.col("doc_id") % 3 != 0
    model = toxicity.train(docs, labels, learn, per_class=40)
    assert 40 < len(model.seen) < 100
    scored = cut(toxicity.score_toxicity(docs, model))
    counts = toxicity.counted(scored, labels, learn)
    found = toxicity.thresholds(counts)
    assert found.keys() == {"aa", "bb"} and toxicity.THRESHOLD not in found.values()
    assert sum(n for *_, n in counts) == 400 and sum(n for *_, fitted, n in counts if fitted) == len(model.seen)
    flagged = toxicity.flag(scored, labels, learn)
    assert all(r.flagged == int(r.doc_id % 10 == 0) for r in flagged.where("lang = 'bb'").collect())
    assert toxicity.flag(scored, labels.limit(0), learn).where("flagged <> predicted").count() == 0


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.range(90).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 100) AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) AS toxic")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 20_000)
    assert 20 < len(toxicity.train(docs, labels, F.lit(True)).seen) < 40


def test_thresholds_keep_the_share_of_classes():
    # Nearly all toxic rows were fitted on; by their share, 80 of 100 rows at 0.6 are toxic, so the threshold is below.
    counts = [("x", 1, 900, True, 9), ("x", 1, 600, True, 70), ("x", 1, 600, False, 1), ("x", 0, 600, False, 20), ("x", 0, 100, False, 500), ("y", 0, 5, False, 3)]
    assert toxicity.thresholds(counts) == {"x": pytest.approx(0.3505), "y": pytest.approx(0.3505)}
    assert toxicity.thresholds(counts[-1:]) == {"y": toxicity.THRESHOLD}
    assert toxicity.calibrate(np.array([0.9, 0.5, 0.5, 0.1]), np.array([1.0, 1, 0, 0])) == pytest.approx(0.3)
