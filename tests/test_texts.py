import json

import pytest
from pyspark.sql import functions as F

from strata.operators import chats, model, replies, scripts, text


def one(spark, value, name="t"):
    return spark.createDataFrame([(value,)], f"{name} string")


FEED = "<entry><id>E1</id><meta><date>2024-01-05</date></meta><title>A &amp; B</title><link href='h'/><summary> One. Two. </summary></entry>"


@pytest.mark.parametrize("prefix", ["/entry/", "//entry/"])
def test_xml(spark, prefix):
    """Plain paths are read by schema, others by XPath; both give the same."""
    fields = {"key": "id", "date": "meta/date", "title": "title", "href": "link/@href", "summary": "summary", "no": "gone"}
    df = spark.createDataFrame([(FEED,), ("<entry><id>2</id></entry>",), ("<entry><id>3</entry>",), (None,)], "x string")
    out = text.extract_xml(df, "x", {k: prefix + v for k, v in fields.items()}).drop("x")
    assert [tuple(r) for r in out.collect()] == [
        ("E1", "2024-01-05", "A & B", "h", "One. Two.", None),
        ("2", *[None] * 5),
        (None,) * 6,
        (None,) * 6,
    ]


def test_xml_xpath_parses_once(spark):
    """A few XPath expressions share one parse; many are split below the limits of the JDK's compiler."""
    df = spark.createDataFrame([("<a>" + "".join(f"<b{i} k=''>{i}<!--c--></b{i}>" for i in range(40)) + "</a>",)], "x string")
    few = text.extract_xml(df, "x", {"f": "//b1", "g": "/a/*[name()='b2']", "h": "//b3/@k", "no": "//b3/@l"}).drop("x")
    assert few._jdf.queryExecution().optimizedPlan().toString().lower().count("xpath") == 1
    assert tuple(few.first()) == ("1", "2", "", None)
    for form in ("//b%d", "/a/*[name()='b%d' or name()='no']", "((//b%d))[1]"):
        many = text.extract_xml(df, "x", {f"f{i}": form % i for i in range(40)}).drop("x")
        assert list(many.first()) == [str(i) for i in range(40)]
    assert text.extract_xml(df, "x", {}).columns == ["x"]


def test_xml_rows(spark):
    feed = "<feed><n>2</n><entry id='1'><title> A </title></entry><entry id='2'><title>B</title><m><d>x</d></m></entry></feed>"
    df = spark.createDataFrame([(1, feed), (2, "<feed/>"), (3, "<feed><entry></feed>"), (4, None), (5, "<feed><entry id='9'/></feed>")], "n int, x string")
    out = text.extract_xml_rows(df, "x", "/feed/entry", {"id": "@id", "title": "title", "deep": "m/d"})
    assert sorted(map(tuple, out.collect())) == [(1, "1", "A", None), (1, "2", "B", "x"), (5, "9", None, None)]
    with pytest.raises(ValueError, match="plain"):
        text.extract_xml_rows(df, "x", "//entry", {"id": "@id"})


@pytest.mark.parametrize(
    "value, want",
    [
        ("One. Two! Three?", "One. Two!"),
        ("No end", "No end"),
        (" A line\nbreak. B 1.5 c. D.", "A line\nbreak. B 1.5 c."),
        ("Only one.", "Only one."),
        (None, None),
    ],
)
def test_summary(spark, value, want):
    assert text.summarize_text(one(spark, value), "t").first().summary == want


def test_prompts_lose_nothing(spark):
    long = "".join(chr(97 + i % 26) for i in range(45001))
    df = spark.createDataFrame([(1, long), (2, "short"), (3, "")], "id int, t string")
    rows = replies.build_prompts(df, "t", {"a": "int"}, "Do it").orderBy("id", "part").collect()
    head = "Instruction: Do it\n\nRaw Data:\n"
    assert [(r.id, r.part) for r in rows] == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)]
    assert all(r.prompt.startswith(head) for r in rows)
    assert "".join(r.prompt.removeprefix(head) for r in rows[:3]) == long
    assert '{\n  "a": "int"\n}' in rows[0].system
    assert replies.build_prompts(df, "t", {"a": "int"}, "Do it", overflow="truncate").count() == 3


def test_prompts_are_cut_at_line_and_sentence_ends(spark):
    text = "First line\nSecond one. Third! And a wordwithoutanyend\n\nlast"
    rows = replies.build_prompts(one(spark, text), "t", {"a": "int"}, "Do", max_chars=20).orderBy("part").collect()
    pieces = [r.prompt.split("Raw Data:\n", 1)[1] for r in rows]
    assert pieces == ["First line\n", "Second one. Third! ", "And a wordwithoutany", "end\n\nlast"]


VALUES = {
    '[{"id":1},{"id":2}]': [1, 2], '{"data":[{"id":9}],"results":[{"id":5}]}': [5], '{"data":[{"id":6}]}': [6], '{"id":7}': [7],
    "[]": [], "12": None, "{broken": None,
}


def test_replies(spark):
    """Every value in every kind of fence, closed and open, with and without white space before it."""
    cases = [(None, None)]
    for value, ids in VALUES.items():
        for mark in ("", "```", "```json"):
            for lead in ("", " \n\t"):
                for end in ("", "\n", "\n```", "\n```\n") if mark else ("", "\n"):
                    cases.append((lead + (f"{mark}\n" if mark else "") + value + end, ids))
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "n int, reply string")
    got = {}
    for r in replies.parse_replies(df, "reply", {"id": "int"}).collect():
        got.setdefault(r.n, []).append(r.id)
    assert got == {i: w for i, (_, w) in enumerate(cases) if w}
    flags = {r.n: r.reply_ok for r in replies.parse_replies(df, "reply", {"id": "int"}, keep_bad=True).collect()}
    assert flags == {i: w is not None for i, (_, w) in enumerate(cases)}
    # What the check of the model accepts is what the parse can read.
    assert [model.json_problem(r) is None for r, _ in cases[1:]] == ["{broken" not in r for r, _ in cases[1:]]


def test_code_blocks(spark):
    """One block per text: its mark, whether it is closed and parses, and where it stands."""
    cases = []
    for mark in ("python", "", "sql"):
        for body, parses in (("a = 1\nb = [a,\n\n     2]", True), ("def f(:", False)):
            for closed in (True, False):
                for before, after in (("", ""), ("Look:\n\n", "\n\nDone."), ("One.\n", "")):
                    text = f"{before}```{mark}\n\n{body}\n\n" + ("```" if closed else "") + after
                    cases.append((text, body if parses and closed and mark != "sql" else None))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate([*cases, ("no fence", None)])], "i int, t string")
    got = [r.code for r in replies.extract_code_blocks(df, "t").orderBy("i").collect()]
    assert got == [w for _, w in cases] + [None]
    both = one(spark, "```\nbare = 1\n```\nthen\n```python\nmarked = 2\n```\n")
    assert replies.extract_code_blocks(both, "t").first().code == "marked = 2"
    whole = [one(spark, t) for t in ("  import json\n", "no code here")]
    assert [replies.extract_code_blocks(t, "t", whole_text=True).first().code for t in whole] == ["import json", None]


def test_yaml_blocks(spark):
    df = spark.createDataFrame([("x\n```yaml\na: 1\n```\n",), ("```\nb: 2\n```",), (" `c: 3` ",)], "t string")
    assert [r.code for r in replies.extract_code_blocks(df, "t", lang="yaml").collect()] == ["a: 1", "b: 2", "c: 3"]


def test_model_attempts(spark):
    def stub(prompts):
        out = []
        for p in prompts:
            if "down" in p:
                raise OSError("model is down")
            out.append('[{"id": 1}]' if "ERROR" in p or "good" in p else "hm")
        return out

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, prompt string").coalesce(1)
    got = {r.id: (r.reply, r.attempts, r.error) for r in model.extract_records(df, stub).collect()}
    assert got == {1: ('[{"id": 1}]', 1, None), 2: ('[{"id": 1}]', 2, None)}
    failed = model.extract_records(spark.createDataFrame([(1, "down")], "id int, prompt string"), stub).first()
    assert (failed.reply, failed.attempts, failed.error) == (None, 3, "model is down")


def cases_of_rules():
    """A script for each listed name, and what must be found in it."""
    for name in scripts.DANGEROUS_IMPORTS:
        yield f"import {name}", {"dangerous_import"}
    for name in scripts.ALLOWED_IMPORTS:
        yield f"from {name} import anything", set()
    for name in scripts.DANGEROUS_CALLS:
        extra = {"file_open"} if name == "open" else set()
        yield f"y = {name}('z')", {"dangerous_call"} | extra
        yield f"{name}('z')", {"dangerous_call"} | extra | ({"dynamic_execution"} if name in scripts.DYNAMIC_CALLS else set())
    for word in scripts.SHELL_WORDS:
        yield f"make().{word.upper()}_now(1)", {"system_call"}
    yield from [("import zoneinfo", {"uncommon_import"}), ("from . import sibling", {"uncommon_import"})]
    yield from [("x = (", {"syntax"}), ("break", {"compile"}), ("", set()), ("\t\n # only a remark", set()), (None, set())]
    yield "a" + ".b" * 1200 + "()", None


def test_scan(spark):
    cases = list(cases_of_rules())
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "id int, code string")
    found = {}
    for r in scripts.scan_code(df, "id", "code").collect():
        found.setdefault(r.id, set()).add(r.rule)
        assert r.severity in ("error", "warning") and r.suggestion
    assert {i: found.get(i, set()) for i, (_, w) in enumerate(cases) if w is not None} == {i: w for i, (_, w) in enumerate(cases) if w is not None}
    errors = {r for r, (s, _) in scripts.RULES.items() if s == "error"}
    valid = {r.id: r.valid for r in scripts.annotate_code(df, "code").collect()}
    assert all(valid[i] == (not w & errors) for i, (_, w) in enumerate(cases) if w is not None)
    exact = scripts.scan_code(one(spark, "import codecs\nimport code.x", "code").withColumn("id", F.lit(1)), "id", "code", match="module")
    assert [(r.rule, r.name) for r in exact.collect()] == [("uncommon_import", "codecs"), ("dangerous_import", "code.x")]


def test_chats(spark):
    turns = [(1, 1, "user", "b"), (1, 0, "system", "a"), (2, 5, "user", "c"), (2, 7, "assistant", "d")]
    df = spark.createDataFrame(turns, "conv int, turn int, role string, text string")

    def told(**options):
        out = chats.assemble_chats(df, "conv", "turn", "role", "text", **options)
        return {(r.conv, r.part): [(m.role, m.content) for m in r.messages] for r in out.collect()}

    assert told(system="S") == {
        (1, 0): [("system", "a"), ("user", "b")],
        (2, 0): [("system", "S"), ("user", "c"), ("assistant", "d")],
    }
    assert told(turns_per_part=1) == {(1, 0): [("system", "a")], (1, 1): [("user", "b")], (2, 0): [("user", "c")], (2, 1): [("assistant", "d")]}


def test_a_long_chat_is_cut_only_on_request(spark):
    """Turn numbers far apart (times, say) are turns like others."""
    df = spark.range(5000).selectExpr("1 as conv", "id * 1000003 as turn", "'user' as role", "cast(id as string) as text")
    whole = chats.assemble_chats(df, "conv", "turn", "role", "text", system="S").collect()
    assert [(r.part, len(r.messages)) for r in whole] == [(0, 5001)]
    out = chats.assemble_chats(df, "conv", "turn", "role", "text", system="S", turns_per_part=1000).orderBy("part").collect()
    assert [len(r.messages) for r in out] == [1000, 1000, 1000, 1000, 1000, 1]
    assert [int(m.content) for r in out for m in r.messages if m.role == "user"] == list(range(5000))
    assert json.dumps([m.role for m in out[0].messages[:2]]) == '["system", "user"]'


def test_short_answers_are_tried_again(spark):
    calls = spark.sparkContext.accumulator(0)

    def forgetful(prompts):
        calls.add(1)
        return ["[]"] * (len(prompts) - 1)

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string").coalesce(1)
    rows = model.extract_records(df, forgetful).collect()
    assert {(r.reply, r.attempts, r.error) for r in rows} == {(None, 3, "1 answers to 2 prompts")} and calls.value == 3
