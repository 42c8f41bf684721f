"""The pipeline stage by stage, the queries against their SQL, and what their plans must not hold."""

import pytest
from oracle import compare, connect
from test_llm_duplicates import plain_items, plain_simhash, plain_spans
from test_llm_tokens import check_packing

import __spark_entry__ as entry_points
import corpus_pipeline
from strata.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    language = stages["language"](spark, docs, SF_DIR)
    assert language.columns == columns and 0.95 * docs.count() < language.count() <= docs.count()
    good = stages["quality"](spark, language, SF_DIR)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    left = {r.doc_id for r in good.collect()}
    there = [r.doc_id for r in language.collect()]
    assert sum((d in left) == (labels[d] == 1) for d in there if d in labels) >= 0.9 * sum(d in labels for d in there)
    texts = {r.doc_id: r.text for r in good.collect()}
    distinct = stages["near_duplicates"](spark, good, SF_DIR)
    kept = sorted(d for d, _, c in plain_simhash(list(texts.items())) if d == c)
    assert distinct.columns == columns and sorted(r.doc_id for r in distinct.collect()) == kept and len(kept) < len(texts)
    items = plain_items([(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()])
    clean = stages["decontamination"](spark, distinct, SF_DIR)
    counts = {d: plain_spans(texts[d], items) for d in kept}
    kept = sorted(d for d, (n, hit, _) in counts.items() if not (hit and 20 * hit >= n))
    assert clean.columns == columns and sorted(r.doc_id for r in clean.collect()) == kept
    packed = stages["packing"](spark, clean, SF_DIR).collect()
    check_packing(packed, [(d, texts[d]) for d in kept], 2048)
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in whole} == {(r.doc_id, r.piece, r.ids_crc32) for r in packed}


def test_messy_rows_pass_every_stage(spark, messy, nothing):
    for docs in (messy, nothing):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            assert out.count() >= 0
            docs = out if out.columns == docs.columns else docs


def test_entry_points_hold_the_operators():
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and "pipeline" not in entry_points.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_all_pairs_joins(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
