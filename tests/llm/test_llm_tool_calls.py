"""Tool calls: links, order, validation, canonical JSON."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from strata.llm.tool_calls import canonical, link_calls, link_every_call, violations

SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["string", "null"]}}, "additionalProperties": False}}
SCHEMA = "conv_id long, turn long, role string, text string, extra int, status string, json string"


def call(key, arguments='{"a": 1}', name="add", after=()):
    return f'{{"id": {json.dumps(key)}, "name": "{name}", "arguments": {arguments}, "after": {json.dumps(list(after))}}}'


def calls(*each):
    return f'{{"tool_calls": [{", ".join(each)}]}}'


def result(key, content="ok"):
    return json.dumps({"tool_call_id": key, "content": content})


def linked(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    return link_calls(frame, SCHEMAS, **options)


def test_links(spark):
    rows = [
        (1, 0, "user", "please"), (1, 1, "assistant", calls(call("p"), call("q", '{"b": 1, "c": 2}'))), (1, 2, "tool", result("q", "two")),
        (1, 3, "tool", result("p", None)), (1, 4, "tool", result("gone")), (1, 5, "assistant", calls(call("late", name="sub"))),
        (1, 6, "assistant", calls(call("p", '{"a": 9}'))), (1, 7, "tool", result("p", "again")),
        (2, 0, "tool", result("p", "first")), (2, 1, "assistant", calls(call("p"))),
        (None, 0, "assistant", calls(call("p"))), (None, 1, "tool", result("p")),
        (3, 0, "assistant", calls(call(None))), (3, 1, "assistant", None), (3, 2, "assistant", "{broken"), (3, 3, "tool", "[]"),
        (3, 4, "tool", json.dumps({"content": "whose?"})), (3, 5, None, calls(call("p"))), (3, 6, "assistant", '{"tool_calls": null}'),
    ]
    found = {(r.conv_id, r.call_id): r for r in linked(spark, rows).collect()}
    states = {k: (r.status, r.call_turn, r.result_turn, r.n_calls, r.n_results) for k, r in found.items()}
    assert states == {
        (1, "p"): ("linked", 1, 3, 2, 2), (1, "q"): ("linked", 1, 2, 1, 1), (1, "gone"): ("orphan", None, 4, 0, 1),
        (1, "late"): ("unanswered", 5, None, 1, 0), (2, "p"): ("early", 1, 0, 1, 1), (None, "p"): ("linked", 0, 1, 1, 1),
        (3, None): ("unanswered", 0, None, 1, 0),
    }
    assert found[1, "q"].errors == ["a: missing", "b: not string or null", "c: unknown"]
    assert found[1, "late"].errors == ["unknown tool: sub"] and found[1, "p"].errors == []
    assert found[1, "q"].json == '{"arguments":{"b":1,"c":2},"id":"q","name":"add","result":"two"}'
    assert found[1, "gone"].json == '{"arguments":null,"id":"gone","name":null,"result":"ok"}'


def position(r):
    return (r.order_turn, r.order_step, r.call_place)


def test_calls_come_after_what_they_need(spark):
    rows = [
        (1, 0, "assistant", calls(call("a", after=["b"]), call("b", after=["d", "missing"]), call("c"))),
        (1, 5, "assistant", calls(call("d", after=["c"]), call("e", after=["a"]))),
        (2, 0, "assistant", calls(call("a", after=["z"]))), (3, 0, "assistant", calls(call("z"))),
    ]
    found = {(r.conv_id, r.call_id): r for r in linked(spark, rows).collect()}
    for before, after in (("d", "b"), ("b", "a"), ("c", "d"), ("a", "e")):
        assert position(found[1, before]) < position(found[1, after])
    assert position(found[2, "a"]) == (0, 0, 0) and all(r.status == "unanswered" for r in found.values())


def test_long_chains_and_cycles(spark):
    chain = [(1, 0, "assistant", calls(*[call(f"k{i}", after=[f"k{i + 1}"]) for i in range(12)], call("k12")))]
    found = sorted(linked(spark, chain).collect(), key=position)
    assert [r.call_id for r in found] == [f"k{i}" for i in range(12, -1, -1)]
    cycle = [(1, 0, "assistant", calls(call("a", after=["b"]), call("b", after=["a"]), call("c", after=["c"]), call("d")))]
    assert {r.call_id: r.status for r in linked(spark, cycle, most_steps=6).collect()} == {"a": "cycle", "b": "cycle", "c": "cycle", "d": "unanswered"}


def _tangled():
    """A chain of 130 against its places, an early call that waits for a late one with a chain behind it, two cycles with calls around."""
    chain = [(1, 0, "assistant", calls(*[call(f"k{i}", after=[f"k{i + 1}"]) for i in range(130)], call("k130")))]
    wait = [(2, 0, "assistant", calls(call("w0", after=["late"]), *[call(f"w{i}", after=[f"w{i - 1}"]) for i in range(1, 110)])), (2, 9, "assistant", calls(call("late")))]
    after = {"a": "b", "b": "ca", "c": "a", "d": "c", "e": "d", "x": "yc", "y": "x", "f": "y", "s": "s", "g": "s", "h": "", "a0": "h"}
    return [*chain, *wait, (3, 0, "assistant", calls(*[call(k, after=[*v]) for k, v in after.items()]))], after


@pytest.mark.parametrize("in_task", [200_000, 4])
def test_order_and_cycles_are_exact(spark, in_task):
    rows, after = _tangled()
    if in_task == 4:  # rounds of joins, for a short chain and the cycles
        rows = [(1, 0, "assistant", calls(*[call(f"k{i}", after=[f"k{i + 1}"]) for i in range(5)], call("k5"))), rows[-1]]
    found = {(r.conv_id, r.call_id): r for r in linked(spark, rows, in_task=in_task).collect()}
    assert {k[1] for k, r in found.items() if r.status == "cycle"} == set("abcxys")
    chain = sorted((r for k, r in found.items() if k[0] == 1), key=position)
    assert [r.call_id for r in chain] == [f"k{i}" for i in reversed(range(len(chain)))]
    assert all(position(found[3, a]) > position(found[3, b]) for a, b in ("dc", "ed", "fy", "gs", "xc"))
    if (2, "late") in found:
        waiting = sorted((r for k, r in found.items() if k[0] == 2), key=position)
        assert [r.call_id for r in waiting] == ["late", *[f"w{i}" for i in range(110)]]


def test_every_call_and_result_stays(spark):
    rows = [
        (1, 0, "tool", result("p", "zero")), (1, 1, "assistant", calls(call("p"), call("q", after=["p"]))), (1, 2, "tool", result("p", "one")),
        (1, 3, "tool", result("p", "more")), (1, 4, "assistant", calls(call("p", '{"a": -9}'), call("q", after=["p", "q"]))), (1, 5, "tool", result("p", "two")),
        (1, 6, "tool", json.dumps({"content": "whose?"})), (1, 7, "tool", "[]"), (1, 7, "tool", "plain"), (1, 8, "assistant", calls(call(None))),
        (2, 0, "tool", result("p", "soon")), (2, 1, "assistant", calls(call("p"))),
        *[row for i in range(3) for row in ((None, 0, "assistant", calls(call("p"))), (None, 1, "tool", result("p", f"n{i}")))],
    ]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    found = [(r, json.loads(r.json)["result"]) for r in link_every_call(frame, SCHEMAS).collect()]
    assert sorted(((r.call_id or "", r.call_turn or 0, r.result_turn or 0, r.status, text) for r, text in found if r.conv_id == 1), key=str) == sorted([
        ("p", 0, 0, "orphan", "zero"), ("p", 1, 2, "linked", "one"), ("p", 0, 3, "repeated", "more"), ("p", 4, 5, "linked", "two"),
        ("q", 1, 0, "unanswered", None), ("q", 4, 0, "unanswered", None), ("", 0, 6, "orphan", "whose?"), ("", 8, 0, "unanswered", None),
    ], key=str)
    assert [r.errors for r, _ in found if r.conv_id == 1 and r.call_turn == 4 and r.call_id == "p"] == [["a: below 0"]]
    assert [(r.status, text) for r, text in found if r.conv_id == 2] == [("early", "soon")]
    assert sorted((r.status, text, r.n_calls) for r, text in found if r.conv_id is None) == [("linked", f"n{i}", 3) for i in range(3)]
    assert all(r.order_step == 0 for r, _ in found)


def test_nothing(spark):
    assert linked(spark, []).count() == 0


@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3)))
def test_canonical_json_is_one_form(value):
    text = canonical(value)
    assert json.loads(text) == value and canonical(json.loads(text)) == text
    if isinstance(value, dict):
        assert canonical(dict(reversed(list(value.items())))) == text


@pytest.mark.parametrize(
    ("value", "schema", "expected"),
    [
        (True, {"type": "integer"}, ["arguments: not integer"]),
        (2.0, {"type": "integer"}, []),
        (3, {"enum": [1, 2]}, ["arguments: not among the allowed values"]),
        (3, {"minimum": 4}, ["arguments: below 4"]),
        (3, {"maximum": 2}, ["arguments: above 2"]),
        ("abc", {"maxLength": 2}, ["arguments: longer than 2"]),
        ([1, "x"], {"type": "array", "items": {"type": "number"}}, ["arguments[1]: not number"]),
        ({"x": {"y": 1}}, {"properties": {"x": {"required": ["z"]}}}, ["x.z: missing"]),
        (None, {"type": "null"}, []),
    ],
)
def test_violations(value, schema, expected):
    assert violations(value, schema) == expected


@pytest.mark.parametrize(
    "arguments, errors, written",
    [
        ('{"text":"\\ud800"}', [], '{"text":"\\ud800"}'),
        ('{"\\udfff":1}', ["\\udfff: unknown"], '{"\\udfff":1}'),
        ('{"text":"\\ud83d\\ude00"}', [], '{"text":"\U0001f600"}'),
        ('{"n":NaN}', ["arguments: not JSON"], '"{\\"n\\":NaN}"'),
        ('{"n":1e999}', ["arguments: not JSON"], '"{\\"n\\":1e999}"'),
        ('{"n":-Infinity}', ["arguments: not JSON"], '"{\\"n\\":-Infinity}"'),
        ('{"n":true}', ["n: not among the allowed values"], '{"n":true}'),
        ('{"n":1.0}', [], '{"n":1.0}'),
    ],
)
def test_arguments_that_are_hard_to_write(spark, arguments, errors, written):
    schema = {"ask": {"type": "object", "additionalProperties": False, "properties": {"text": {"type": "string"}, "n": {"enum": [1]}}}}
    call = json.dumps({"tool_calls": [{"id": "a", "name": "ask", "arguments": arguments}]})
    messages = spark.createDataFrame([(1, 0, "assistant", call)], "conv_id long, turn long, role string, text string")
    row = link_every_call(messages, schema).first()
    assert row.errors == errors and row.json == '{"arguments":' + written + ',"id":"a","name":"ask","result":null}'


def test_deep_arguments(spark):
    call = json.dumps({"tool_calls": [{"id": "a", "name": "ask", "arguments": "[" * 5000 + "]" * 5000}]})
    messages = spark.createDataFrame([(1, 0, "assistant", call)], "conv_id long, turn long, role string, text string")
    assert link_every_call(messages, {"ask": {}}).first().errors in (["arguments: not JSON"], [])
