import datetime
import json

import pytest

from strata.plans.manifest import ManifestError, load_manifest, run_manifest

AT = datetime.datetime(2026, 2, 15, 12)

INGEST = {
    "pipeline_name": "shop_daily",
    "agent_type": "generic_rest_api",
    "source": {
        "url": "https://example.com/items",
        "pagination": {"type": "page", "limit_value": 2, "max_items": 5},
        "params": {"kind": "all"},
    },
    "target": {"bucket": "lake-data", "source": "shop", "dataset": "items"},
}

TRANSFORM = """
pipeline_name: items_silver
agent_type: generic_ai_transformer
source: {bucket: lake-data, path: layer=landing/source=shop/dataset=items, format: json}
target: {bucket: lake-data, path: layer=silver/source=shop/dataset=items}
ai_config:
  instruction: "Typed items with a price, each once"
  schema: {id: int, price: float, created_at: "datetime64[ns]", created_year: int}
  steps:
    - unwrap_envelope: {policy: transform}
    - drop_missing: {subset: [id]}
    - cast_columns: {mode: lenient}
    - derive_date_parts: {col: created_at}
    - filter_rows: {condition: "price > 1"}
    - drop_duplicates: {keys: [id], order_by: [created_at]}
    - add_audit_columns
"""


@pytest.fixture
def items():
    def fetch(source_id, params):
        assert params["kind"] == "all"
        page = int(params["page"])
        rows = [{"id": str(i), "price": str(i + 0.5), "created_at": "2024-01-01T10:00:00"} for i in range(2 * page - 2, 2 * page)]
        return json.dumps({"data": rows + [{"id": None, "price": "9"}] if page == 1 else rows})

    return fetch


@pytest.fixture
def manifest(tmp_path):
    (tmp_path / "m.yaml").write_text(TRANSFORM)
    return load_manifest(str(tmp_path / "m.yaml"))


def test_landing_to_silver(spark, tmp_path, manifest, items):
    roots = {"lake-data": str(tmp_path / "lake")}
    for _ in range(2):
        landed = run_manifest(spark, INGEST, roots, AT, fetcher=items, pause=0)
    assert landed.status == "success" and landed.summary["records_fetched"] == 5
    assert landed.target.endswith("layer=landing/source=shop/dataset=items")
    assert spark.read.json(landed.target).count() == 5

    planned = run_manifest(spark, manifest, roots, AT, dry_run=True)
    assert planned.status == "dry_run_success" and planned.mismatches == []
    assert not (tmp_path / "lake" / "layer=silver").exists()

    for _ in range(2):
        done = run_manifest(spark, manifest, roots, AT)
    assert done.summary["records_processed"] == 3
    silver = spark.read.parquet(done.target)
    assert sorted((r.id, r.price, r.created_year) for r in silver.collect()) == [(1, 1.5, 2024), (2, 2.5, 2024), (3, 3.5, 2024)]
    assert {r.batch_id for r in silver.select(silver.batch_id.cast("string").alias("batch_id")).collect()} == {"20260215120000"}


def test_dry_run_fetches_nothing(spark, tmp_path):
    def never(source_id, params):
        raise AssertionError

    result = run_manifest(spark, INGEST, {"lake-data": str(tmp_path)}, AT, dry_run=True, fetcher=never)
    assert result.status == "dry_run_success"


def test_xml_pages_land_as_they_are(spark, tmp_path):
    source = {
        "url": "https://example.com/feed", "format": "xml",
        "pagination": {"type": "offset_limit", "offset_param": "from", "limit_param": "max", "limit_value": 20, "max_items": 60},
    }
    result = run_manifest(
        spark, {**INGEST, "source": source}, {"lake-data": str(tmp_path)}, AT,
        fetcher=lambda s, p: f"<feed><from>{p['from']}</from></feed>", pause=0,
    )
    bodies = sorted(r.body for r in spark.read.json(result.target).collect())
    assert bodies == [f"<feed><from>{n}</from></feed>" for n in (0, 20, 40)]


def test_xml_pages_to_silver(spark, tmp_path):
    """Feeds land as they are; a second manifest reads their entries."""
    source = {"url": "https://example.com/feed", "format": "xml", "pagination": {"type": "page", "limit_value": 2, "max_items": 4}}
    roots = {"lake-data": str(tmp_path)}

    def feed(source_id, params):
        n = int(params["page"])
        entries = "".join(f"<entry><id>E{n}{i}</id><date>0{i}/02/2024</date><text>One {i}. Two. Three.</text></entry>" for i in (1, 2))
        return f"<feed>{entries}</feed>"

    run_manifest(spark, {**INGEST, "source": source}, roots, AT, fetcher=feed, pause=0)
    fields = {"id": "id", "date": "date", "text": "text"}
    silver = {
        "pipeline_name": "feed_silver",
        "agent_type": "generic_ai_transformer",
        "source": {"bucket": "lake-data", "path": "layer=landing/source=shop/dataset=items"},
        "target": {"bucket": "lake-data", "path": "layer=silver/source=shop/dataset=items"},
        "ai_config": {
            "instruction": "Entries of the feed with a summary",
            "schema": {"id": "string", "date": "string", "summary": "string"},
            "steps": [
                {"unwrap_envelope": {"policy": "transform", "fields": {"body": "string"}}},
                {"extract_xml_rows": {"col": "body", "rows": "/feed/entry", "fields": fields}},
                {"standardize_dates": {"cols": ["date"], "formats": ["dd/MM/yyyy"]}},
                {"summarize_text": {"col": "text", "n": 2}},
                "project_to_schema",
            ],
        },
    }
    done = run_manifest(spark, silver, roots, AT)
    got = sorted((r.id, r.date, r.summary) for r in spark.read.parquet(done.target).collect())
    assert got[0] == ("E11", "2024-02-01", "One 1. Two.") and len(got) == 4


def test_invalid_manifests_are_refused(spark, tmp_path, manifest):
    with pytest.raises(ManifestError, match="public http"):
        run_manifest(spark, {**INGEST, "source": {"url": "http://localhost/x"}}, {}, AT)
    manifest["ai_config"]["steps"].append("explode_everything")
    (tmp_path / "layer=landing").mkdir()
    with pytest.raises(ManifestError, match="unknown step|no root"):
        run_manifest(spark, manifest, {}, AT)


def test_a_failed_run_raises(spark, tmp_path, manifest, items):
    roots = {"lake-data": str(tmp_path / "lake")}
    run_manifest(spark, INGEST, roots, AT, fetcher=items, pause=0)
    manifest["ai_config"]["steps"] = [{"unwrap_envelope": {}}, {"derive_columns": {"expressions": {"id": "concat('x', id)"}}}, "cast_columns"]
    manifest["ai_config"]["schema"] = {"id": "int"}
    with pytest.raises(ManifestError, match="items_silver failed"):
        run_manifest(spark, manifest, roots, AT)
    manifest["ai_config"]["steps"].pop()
    with pytest.raises(ValueError, match="id: expected int, got string"):
        run_manifest(spark, manifest, roots, AT)


def api(n, key="data"):
    def fetch(source_id, params):
        page = int(params["page"])
        return json.dumps({key: [{"id": page}] if page <= n else []})

    return fetch


def with_source(manifest, **source):
    return {**manifest, "source": {**manifest["source"], **source}}


def test_a_source_of_many_pages_lands_whole(spark, tmp_path):
    roots = {"lake-data": str(tmp_path)}
    endless = with_source(INGEST, pagination={"type": "page", "limit_value": 1})
    done = run_manifest(spark, endless, roots, AT, fetcher=api(1200), pause=0)
    assert (done.status, done.summary["records_fetched"]) == ("success", 1200) and spark.read.json(done.target).count() == 1200
    capped = with_source(INGEST, pagination={"type": "page", "limit_value": 1, "max_pages": 5})
    done = run_manifest(spark, capped, roots, AT, fetcher=api(1200), pause=0)
    assert (done.status, done.summary["status"], done.summary["records_fetched"]) == ("incomplete", "incomplete", 5)
    assert run_manifest(spark, capped, roots, AT, fetcher=api(3), pause=0).status == "success"


def test_named_records_land(spark, tmp_path):
    roots = {"lake-data": str(tmp_path)}
    named = with_source(INGEST, record_key="recipes", pagination={"type": "page"})
    assert run_manifest(spark, named, roots, AT, fetcher=api(30, "recipes"), pause=0).summary["records_fetched"] == 30
    with pytest.raises(ManifestError, match="failed"):
        run_manifest(spark, with_source(INGEST, pagination={"type": "page"}), roots, AT, fetcher=api(30, "recipes"), pause=0)


def test_what_ingestion_refuses(spark, tmp_path):
    roots = {"lake-data": str(tmp_path)}
    with pytest.raises(ManifestError, match="stitch_cursor_pages"):
        run_manifest(spark, with_source(INGEST, pagination={"type": "cursor"}), roots, AT)
    with pytest.raises(ManifestError, match="has no end"):
        run_manifest(spark, with_source(INGEST, format="xml", pagination={"type": "page"}), roots, AT)
    with pytest.raises(ManifestError, match="must be a whole number"):
        run_manifest(spark, with_source(INGEST, pagination={"type": "page", "limit_value": "lots"}), roots, AT)


def test_feeds_end_where_they_have_no_entries(spark, tmp_path):
    def feed(source_id, params):
        return "<feed><entry/></feed>" if int(params["page"]) <= 12 else "<feed><total>0</total></feed>"

    source = with_source(INGEST, format="xml", row_element="entry", pagination={"type": "page"})
    assert run_manifest(spark, source, {"lake-data": str(tmp_path)}, AT, fetcher=feed, pause=0).summary["records_fetched"] == 12


@pytest.mark.parametrize("on_bad", [None, "skip", "quarantine", "fail"])
def test_bad_bodies_are_counted(spark, tmp_path, manifest, on_bad):
    landing = tmp_path / "layer=landing" / "source=shop" / "dataset=items"
    landing.mkdir(parents=True)
    (landing / "a.json").write_text('{"id": "1"}\n{broken\n\n{"data": []}\n{"data": 7}\n{"data": [{"id": "2"}, {"id": "3"}]}\n')
    manifest["ai_config"] |= {"schema": {"id": "int"}, "steps": [{"unwrap_envelope": {}}, "cast_columns"]}
    manifest["source"] |= {"on_bad": on_bad} if on_bad else {}
    if on_bad == "fail":
        with pytest.raises(ManifestError, match="failed"):
            run_manifest(spark, manifest, {"lake-data": str(tmp_path)}, AT)
        return
    for _ in range(2):
        done = run_manifest(spark, manifest, {"lake-data": str(tmp_path)}, AT)
    assert (done.summary["records_processed"], done.summary["error_count"]) == (3, 2)
    beside = tmp_path / "layer=silver" / "source=shop" / "dataset=items_quarantine"
    assert beside.exists() == (on_bad == "quarantine")
    if on_bad == "quarantine":
        assert sorted(r.record for r in spark.read.json(str(beside)).collect()) == ['{"data": 7}', "{broken"]


def test_a_dry_run_starts_no_job_on_data(spark, tmp_path, manifest):
    (tmp_path / "layer=landing" / "source=shop" / "dataset=items").mkdir(parents=True)
    roots = {"lake-data": str(tmp_path)}
    manifest["ai_config"] |= {"schema": {"id": "int"}, "steps": ["cast_columns"]}
    with pytest.raises(ManifestError, match="source.schema"):
        run_manifest(spark, manifest, roots, AT, dry_run=True)
    manifest["source"]["schema"] = {"id": "string"}
    (tmp_path / "layer=landing" / "source=shop" / "dataset=items" / "a.json").write_text('{"id": "4"}\n{"id": \n')
    assert run_manifest(spark, manifest, roots, AT, dry_run=True).mismatches == []
    assert run_manifest(spark, manifest, roots, AT).summary["error_count"] == 1


def test_a_model_in_a_manifest(spark, tmp_path, manifest):
    asked = spark.sparkContext.accumulator(0)

    def answer(prompts):
        asked.add(len(prompts))
        return ["nothing useful" if "hopeless" in p else json.dumps([{"name": p.split()[-1]}]) for p in prompts]

    landing = tmp_path / "layer=landing" / "source=shop" / "dataset=items"
    landing.mkdir(parents=True)
    (landing / "a.json").write_text("from Ada\nfrom Bo\nhopeless\n")
    manifest["ai_config"] |= {"schema": {"name": "string"}, "steps": ["build_prompts", "extract_records", "parse_replies"]}
    done = run_manifest(spark, manifest, {"lake-data": str(tmp_path)}, AT, model_fn=answer)
    assert sorted(r.name for r in spark.read.parquet(done.target).collect()) == ["Ada", "Bo"]
    assert done.summary["error_count"] == 1 and asked.value == 5
    with pytest.raises(ManifestError, match="model_fn"):
        run_manifest(spark, manifest, {"lake-data": str(tmp_path)}, AT)


def test_checks_as_steps(spark, tmp_path, manifest):
    landing = tmp_path / "layer=landing" / "source=shop" / "dataset=items"
    landing.mkdir(parents=True)
    lines = [{"id": "1", "url": "https://example.com/"}, {"id": "\t\n", "url": "https://example.com/"}, {"id": "3", "url": "http://10.0.0.1/"}]
    (landing / "a.json").write_text("\n".join(map(json.dumps, lines)))
    steps = [{"unwrap_envelope": {}}, {"check_rules": {"not_blank": ["id"]}}, {"screen_urls": {"col": "url"}}, {"content_key": {"content": ["id"]}}, "project_to_schema"]
    manifest["ai_config"] |= {"schema": {"id": "string", "url": "string"}, "steps": steps}
    done = run_manifest(spark, manifest, {"lake-data": str(tmp_path)}, AT)
    assert [r.id for r in spark.read.parquet(done.target).collect()] == ["1"] and done.summary["error_count"] == 2


@pytest.mark.parametrize("on_bad", ["skip", "quarantine", "fail"])
def test_files_that_cannot_be_read_are_counted(spark, tmp_path, manifest, on_bad):
    landing = tmp_path / "layer=landing" / "source=shop" / "dataset=items"
    landing.mkdir(parents=True)
    (landing / "a.json").write_text('{"id": "1"}\n{"id": "2"}\n')
    (landing / "b.json").write_bytes(b"PAR1 no text")
    (landing / "c.json.gz").write_bytes(b"\x1f\x8b cut off")
    manifest["ai_config"] |= {"schema": {"id": "int"}, "steps": ["cast_columns"]}
    manifest["source"] |= {"on_bad": on_bad, "schema": {"id": "string"}}
    roots = {"lake-data": str(tmp_path)}
    if on_bad == "fail":
        with pytest.raises(ManifestError, match="files cannot be read"):
            run_manifest(spark, manifest, roots, AT, check_files=True)
        return
    done = run_manifest(spark, manifest, roots, AT, check_files=True)
    assert (done.summary["records_processed"], done.summary["error_count"]) == (2, 2)
    beside = tmp_path / "layer=silver" / "source=shop" / "dataset=items_quarantine"
    assert beside.exists() == (on_bad == "quarantine")
    if on_bad == "quarantine":
        assert sorted(r.record.rsplit("/", 1)[1] for r in spark.read.json(str(beside)).collect()) == ["b.json", "c.json.gz"]


def test_landed_arrays_are_split(spark, tmp_path, manifest):
    landing = tmp_path / "layer=landing" / "source=shop" / "dataset=items"
    landing.mkdir(parents=True)
    roots = {"lake-data": str(tmp_path)}
    manifest["ai_config"] |= {"schema": {"id": "int"}, "steps": ["cast_columns"]}
    manifest["source"]["schema"] = {"id": "int"}
    for text, counts in (('[{"id": 1},\n {"id": {"no": "}"}}, {"id": 3}, {"id"', (2, 2)), ('[{"id": "x"}, {"id": "y"}, {"id"', (0, 3))):
        (landing / "a.json").write_text(text)
        done = run_manifest(spark, manifest, roots, AT, lines=False)
        assert (done.summary["records_processed"], done.summary["error_count"]) == counts
