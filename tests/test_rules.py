import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from strata.operators import rules as R
from strata.operators.urls import screen_urls, url_host
from strata.plans.rules import check_manifests
from strata.queries.checks import HOSTS


def classes(spark, urls, **options):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return {r.url: r.url_class for r in screen_urls(df, "url", **options).collect()}


def test_hosts(spark):
    urls = {f"http://{h}/api?x=1": kind for h, kind in HOSTS.items()}
    assert classes(spark, urls) == urls


# First, second and last address of private ranges, and public neighbours just outside them.
RANGES = "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 224.0.0.0/4 fc00::/7 fe80::/10 ff00::/8".split()
OUTSIDE = "9.255.255.255 11.0.0.0 126.255.255.255 128.0.0.0 169.253.255.255 169.255.0.0 172.15.255.255 172.32.0.0 192.167.255.255 192.169.0.0".split()


def test_edges_of_private_ranges(spark):
    inside = {}
    for name in RANGES:
        net = ipaddress.ip_network(name)
        for ip in (net[0], net[1], net[-1]):
            inside[f"https://{f'[{ip}]' if ip.version == 6 else ip}:8443/p"] = str(ip)
    assert {u for u, c in classes(spark, list(inside)).items() if c == "public"} == set()
    mapped = [f"http://[::ffff:{ipaddress.ip_network(n)[1]}]/" for n in RANGES if ":" not in n]
    assert "public" not in classes(spark, mapped).values()
    assert set(classes(spark, [f"http://{ip}/" for ip in OUTSIDE]).values()) == {"public"}


def test_malformed_and_escaped_urls(spark):
    bad = ["plain text", "gopher://example.org", "https://", "http://a.7/", "http://[::7", "http://example.org:70000/"]
    hidden = ["http://%31%30.0.0.9/", "http:\\\\10.0.0.9\\y", "http:///10.0.0.9/y", "http://01200000011/", "http://example.org@10.0.0.9/"]
    assert "public" not in classes(spark, bad + hidden).values()
    fine = ["http://example.org?to=http://10.0.0.9", "http://example.org#@10.0.0.9", "HTTPS://Y.ORG", "http://10.0.0.9.example.org/", "http://example.org:65535"]
    assert set(classes(spark, fine).values()) == {"public"}


def test_null_and_suffix(spark):
    assert classes(spark, [None]) == {None: None}
    urls = ["http://api.land.gov/", "http://x.lan/", "http://corp.example.com/"]
    assert list(classes(spark, urls, host_match="suffix").values()) == ["public", "private_host", "private_host"]
    df = spark.createDataFrame([("http://u:p@EXAMPLE.com:80/x",)], "url string")
    assert df.select(url_host("url")).first()[0] == "example.com"


def test_addresses_against_the_standard_library(spark):
    rng = random.Random(5)
    nets = (
        "0.0.0.0/0 10.0.0.0/7 172.16.0.0/11 192.0.0.0/23 192.0.2.0/23 198.18.0.0/14 198.51.100.0/23 203.0.113.0/23 "
        "224.0.0.0/3 100.64.0.0/9 169.254.0.0/15 ::/0 ::/96 64:ff9b::/95 2001::/22 2001:db8::/31 2002::/15 fc00::/6 "
        "fe80::/9 ff00::/7 2000::/3 2001:1::/126 2001:3::/31 2001:4:112::/47 2001:20::/27 2001:30::/27 fe00::/8"
    ).split()
    want = {}
    for _ in range(3000):
        net = ipaddress.ip_network(rng.choice(nets), strict=False)
        ip = net[rng.randrange(net.num_addresses)]
        text = f"[{ip.exploded if rng.random() < 0.3 else ip}]" if ip.version == 6 else rng.choice([str(ip), str(int(ip)), hex(int(ip))])
        private = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast
        want[f"http://{text}/"] = "private" if private else "public"
    got = {u: "public" if c == "public" else "private" for u, c in classes(spark, list(want)).items()}
    # 3fff::/20 is judged differently by Python versions.
    assert {u: (got[u], want[u]) for u in want if got[u] != want[u] and "[3fff:0" not in u} == {}


def test_rule_kinds(spark):
    df = spark.createDataFrame(
        [(1, "good_name", 5, {"a": "b"}), (2, "Bad-", None, {}), (3, "_x__\n", 1001, None)],
        "id int, name string, n int, m map<string,string>",
    )
    rules = [
        R.pattern("name", "[a-z0-9_]+"), R.not_edge("name", "_"), R.not_contains("name", "__"),
        R.required("n"), R.number_range("n", 0, 1000, open_low=True), R.non_empty_map("m"),
        R.length("name", 5), R.not_prefix("name", "_"), R.required_when("n", "name like 'B%'", "names with B"),
    ]
    broken = {(r.id, r.field, r.rule) for r in R.check_rules(df, "id", rules).collect()}
    assert broken == {
        (2, "name", "pattern"), (2, "n", "required"), (2, "m", "non_empty"), (2, "name", "length"), (2, "n", "required_when"),
        (3, "name", "pattern"), (3, "name", "not_edge"), (3, "name", "not_contains"), (3, "n", "range"), (3, "name", "not_prefix"),
    }
    report = {(r.field, r.rule): (r.violations, r.pass_rate) for r in R.rule_report(df, rules).collect()}
    assert report["name", "pattern"] == (2, pytest.approx(1 / 3))
    summary = R.rule_summary(R.check_rules(df, "id", rules), 3)
    assert {(r.field, r.rule): r.violations for r in summary.collect()} == {k: v for k, (v, _) in report.items() if v}


def test_a_trailing_newline_does_not_pass(spark):
    df = spark.createDataFrame([(1, "abc\n")], "id int, name string")
    assert R.check_rules(df, "id", [R.pattern("name", "[a-z]+")]).count() == 1


def test_unknown_keys_of_maps(spark):
    df = spark.createDataFrame([(1, {"a": 1, "z": 2})], "id int, m map<string,int>")
    assert R.check_unknown_keys(df, "id", "m", ["a"]).collect() == [(1, "m", "z")]


INGEST = {
    "pipeline_name": "load_items",
    "agent_type": "generic_rest_api",
    "source": {"url": "https://shop.example/items"},
    "target": {"bucket": "lake-data", "source": "shop", "dataset": "items"},
}
TRANSFORM = {
    "pipeline_name": "orders_silver",
    "agent_type": "generic_ai_transformer",
    "source": {"bucket": "lake-data", "path": "layer=landing/source=a/dataset=b"},
    "target": {"bucket": "lake-data", "path": "layer=silver/source=a/dataset=b"},
    "ai_config": {"instruction": "Keep the orders that were paid", "schema": {"id": "int"}},
}


def changed(base, **parts):
    out = json.loads(json.dumps(base))
    for path, value in parts.items():
        at = out
        *heads, last = path.split("__")
        for head in heads:
            at = at.setdefault(head, {})
        if value is ...:
            at.pop(last)
        else:
            at[last] = value
    return out


CASES = [
    (INGEST, set()),
    (TRANSFORM, set()),
    *[(changed(INGEST, pipeline_name=n), set()) for n in ("load_items", "items_2024_v2", "a1b")],
    *[(changed(INGEST, pipeline_name=n), {"pipeline_name"}) for n in ("Load-Items", "_items", "items_", "load__items", "it")],
    (changed(INGEST, source__url=...), {"source.url"}),
    (changed(INGEST, source__url="http://192.168.1.1/x"), {"source.url"}),
    (changed(INGEST, source__type="database"), {"source.type"}),
    (changed(INGEST, source__method="DELETE"), {"source.method"}),
    (changed(INGEST, source__format="avro"), {"source.format"}),
    (changed(INGEST, source__pagination={"type": "offset"}), {"source.pagination.offset_param"}),
    (changed(INGEST, source__pagination={"type": "page", "limit_value": 2000}), {"source.pagination.limit_value"}),
    (changed(INGEST, source__pagination={"type": "page", "limit_value": -10}), {"source.pagination.limit_value"}),
    (changed(INGEST, source__pagination={"type": "page", "max_items": 0}), {"source.pagination.max_items"}),
    (changed(INGEST, source__pagination={"limit_value": 5}), {"source.pagination.type"}),
    (changed(INGEST, source__pagination={"type": "page", "pages": 5}), {"source.pagination.pages"}),
    *[(changed(INGEST, target__bucket=b), {"target.bucket"}) for b in ("lk", "Lake-Data", "lake-", "lake..data")],
    (changed(INGEST, target__bucket=...), {"target.bucket"}),
    (changed(INGEST, target__layer="bronze"), {"target.layer"}),
    (changed(INGEST, target__source=...), {"target.source"}),
    (changed(INGEST, target__dataset="Has Space"), {"target.dataset"}),
    (changed(INGEST, agent_type="other"), {"agent_type"}),
    (changed(INGEST, ai_config=TRANSFORM["ai_config"]), {"ai_config"}),
    (changed(INGEST, target=...), {"target", "target.source", "target.dataset"}),
    (changed(TRANSFORM, source__path="/abs"), {"source.path"}),
    (changed(TRANSFORM, source__path=...), {"source.path"}),
    (changed(TRANSFORM, source__bucket=...), {"source.bucket"}),
    (changed(TRANSFORM, target__path=...), {"target.path"}),
    (changed(TRANSFORM, ai_config=...), {"ai_config"}),
    (changed(TRANSFORM, ai_config__instruction="Short"), {"ai_config.instruction"}),
    (changed(TRANSFORM, ai_config__instruction=" " * 20), {"ai_config.instruction"}),
    (changed(TRANSFORM, ai_config__schema={}), {"ai_config.schema"}),
    (changed(TRANSFORM, ai_config__model="x"), {"ai_config.model"}),
]


def test_manifests(spark):
    df = spark.createDataFrame([(i, json.dumps(m)) for i, (m, _) in enumerate(CASES)], "id int, manifest string")
    found = {}
    for r in check_manifests(df, "id", "manifest").collect():
        found.setdefault(r.id, set()).add(r.field)
    assert {i: found.get(i, set()) for i in range(len(CASES))} == {i: want for i, (_, want) in enumerate(CASES)}


def test_an_unreadable_manifest(spark):
    df = spark.createDataFrame([(1, "{oops")], "id int, manifest string")
    assert "manifest" in {r.field for r in check_manifests(df, "id", "manifest").collect()}
