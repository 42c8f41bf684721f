"""XML, summaries, prompts, replies, code and chats."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from strata.operators import chats, model, replies, scripts, text
from strata.queries.registry import query, table


_XML_SQL = """
    SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id, c_name AS title,
           CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment,
           CAST(c_nationkey AS VARCHAR) AS nation
    FROM customer WHERE c_custkey % 10 <> 0
    UNION ALL
    SELECT c_custkey, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 10 = 0
    """


def _customer_xml(spark, sf):
    """A customer as XML text; some have no segment, every tenth is not well-formed."""
    key = F.col("c_custkey")
    segment = F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("<segment> "), F.col("c_mktsegment"), F.lit("\n</segment>")))
    end = F.when(key % 10 == 0, "</entri>").otherwise("</entry>")
    xml = F.concat(
        F.lit("<entry><id>"), key, F.lit("</id><title>"), F.col("c_name"), F.lit("</title>"), segment,
        F.lit('<home nation="'), F.col("c_nationkey"), F.lit('"/>'), end,
    )
    return table(spark, sf, "customer").select("c_custkey", xml.alias("xml"))


@query("extract_xml", _XML_SQL)
def extract_xml(spark, sf):
    fields = {"id": "/entry/id", "title": "/entry/title", "segment": "/entry/segment", "nation": "/entry/home/@nation"}
    return text.extract_xml(_customer_xml(spark, sf), "xml", fields).drop("xml")


@query("extract_xml_xpath", _XML_SQL)
def extract_xml_xpath(spark, sf):
    fields = {"id": "//id", "title": "/entry/title", "segment": "/entry/*[name()='segment']", "nation": "//home/@nation"}
    # A table of few row groups is read by few tasks, and these would parse all of it.
    spread = _customer_xml(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return text.extract_xml(spread, "xml", fields).drop("xml")


@query("extract_xml_rows", "SELECT c_nationkey, c_name AS title, CAST(c_custkey AS VARCHAR) AS id FROM customer")
def extract_xml_rows(spark, sf):
    """Pages of at most 500 customers each as one XML text."""
    entry = F.concat(F.lit('<entry id="'), F.col("c_custkey"), F.lit('"><title>'), F.col("c_name"), F.lit("</title></entry>"))
    pages = table(spark, sf, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 500)).agg(
        F.concat(F.lit("<feed><list>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</list></feed>")).alias("xml")
    )
    return text.extract_xml_rows(
        pages.select("c_nationkey", "xml"), "xml", "/feed/list/entry", {"title": "title", "id": "@id"}
    )


@query(
    "summarize_text",
    r"""
    SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN s = '' THEN text ELSE s END, '\s+\z', ''), '\A\s+', '') AS summary
    FROM (SELECT doc_id, text, regexp_extract(text, '(?s)\A(?:.*?[.!?](?:\s+|\z)){1,2}', 0) AS s FROM documents)
    """,
)
def summarize_text(spark, sf):
    return text.summarize_text(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


#: The pieces of each text by the rule of build_prompts: after the last line or sentence end in reach, else at the limit.
_CUTS = r"""
    WITH RECURSIVE cuts(doc_id, part, piece, rest) AS (
      SELECT doc_id, -1, '', text FROM documents
      UNION ALL
      SELECT doc_id, part + 1, substr(rest, 1, n), substr(rest, n + 1) FROM (
        SELECT *, CASE WHEN length(rest) <= 20000 THEN length(rest) + 1
                       WHEN fit = '' THEN 20000 ELSE length(fit) - length(stop) END AS n
        FROM (SELECT *, regexp_extract(stop || substr(rest, 1, 20000), '(?s)^.*(?:\n|[.!?][ \t\r])') AS fit
              FROM (SELECT *, regexp_extract(piece, '[.!?]$') AS stop FROM cuts WHERE part < 0 OR rest <> ''))))
    """


@query(
    "build_prompts",
    _CUTS
    + r"""
    SELECT doc_id, CAST(part AS INTEGER) AS part, sha256(E'Instruction: List the names\n\nRaw Data:\n' || piece) AS prompt
    FROM cuts WHERE part >= 0
    """,
)
def build_prompts(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    prompts = replies.build_prompts(documents, "text", {"name": "str"}, "List the names")
    return prompts.select("doc_id", "part", F.sha2("prompt", 256).alias("prompt"))


def counting_model(prompts):
    """A stand-in for a model: answers with the length of the raw text, and badly when it is even."""
    answers = []
    for p in prompts:
        n = len(p.partition("\n\nRaw Data:\n")[2].partition("\n\nYour previous answer")[0])
        retry = "Your previous answer" in p
        answers.append(json.dumps([{"n": n}]) if n % 2 or retry else "sorry")
    return answers


@query(
    "extract_records",
    _CUTS
    + """
    SELECT doc_id, length(piece) AS n, CASE WHEN length(piece) % 2 = 1 THEN 1 ELSE 2 END AS attempts
    FROM cuts WHERE part >= 0
    """,
)
def extract_records(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    prompts = replies.build_prompts(documents, "text", {"n": "int"}, "Count characters").drop("system", "part")
    answered = model.extract_records(prompts, counting_model).drop("error")
    return replies.parse_replies(answered, "reply", {"n": "int"}).select("doc_id", "n", "attempts")


@query(
    "parse_replies",
    """
    SELECT event_id, event_id % 7 <> 6 AS reply_ok,
           CASE WHEN event_id % 7 <> 6 THEN event_id END AS id,
           CASE WHEN event_id % 7 <> 6 THEN event_type END AS kind
    FROM events
    UNION ALL
    SELECT event_id, true, -1, NULL FROM events WHERE event_id % 7 = 0
    """,
)
def parse_replies(spark, sf):
    n = F.col("event_id") % 7
    record = F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"kind":"'), F.col("event_type"), F.lit('"}'))
    reply = (
        F.when(n == 0, F.concat(F.lit("```json\n["), record, F.lit(',{"id":-1}]\n```')))
        .when(n == 1, F.concat(F.lit("```\n["), record, F.lit("]\n```")))
        .when(n == 2, F.concat(F.lit("["), record, F.lit("]")))
        .when(n == 3, F.concat(F.lit('{"results":['), record, F.lit("]}")))
        .when(n == 4, F.concat(F.lit('{"data":['), record, F.lit('],"other":1}')))
        .when(n == 5, record)
        .otherwise(F.concat(F.lit("Sorry, "), record))
    )
    rows = table(spark, sf, "events").select("event_id", reply.alias("reply"))
    return replies.parse_replies(rows, "reply", {"id": "int", "kind": "str"}, keep_bad=True)


@query(
    "extract_code_blocks",
    """
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'x = ' || doc_id WHEN 1 THEN 'import json'
                                   WHEN 2 THEN 'y = 2' WHEN 4 THEN 'import os' END AS code
    FROM documents
    """,
)
def extract_code_blocks(spark, sf):
    n = F.col("doc_id") % 5
    reply = (
        F.when(n == 0, F.concat(F.col("text"), F.lit("\n```python\n\nx = "), F.col("doc_id"), F.lit("\n\n```\n"), F.col("text")))
        .when(n == 1, F.concat(F.col("text"), F.lit("\n```\nimport json\n```\n")))
        .when(n == 2, F.concat(F.lit("```python\ndef f(\n``` and\n```\ny = 2\n```\n"), F.col("text")))
        .when(n == 3, F.concat(F.lit("```python\nx = 1\n"), F.translate("text", "`", "")))
        .otherwise(F.lit("\nimport os\n"))
    )
    rows = table(spark, sf, "documents").select("doc_id", reply.alias("reply"))
    return replies.extract_code_blocks(rows, "reply", whole_text=True).drop("reply")


@query(
    "extract_yaml_blocks",
    "SELECT doc_id, 'id: ' || doc_id AS code FROM documents",
)
def extract_yaml_blocks(spark, sf):
    n, line = F.col("doc_id") % 3, F.concat(F.lit("id: "), F.col("doc_id"))
    reply = (
        F.when(n == 0, F.concat(F.col("text"), F.lit("\n```yaml\n"), line, F.lit("\n```\n")))
        .when(n == 1, F.concat(F.lit("```\n"), line, F.lit("\n```\n"), F.col("text")))
        .otherwise(F.concat(F.lit(" `"), line, F.lit("`\n")))
    )
    rows = table(spark, sf, "documents").select("doc_id", reply.alias("reply"))
    return replies.extract_code_blocks(rows, "reply", lang="yaml").drop("reply")


# Scripts, and the findings they must give: (rule, name, line).
SCRIPTS = [
    ("import os\nos.system('ls')\n", [("uncommon_import", "os", 1), ("system_call", "os.system", 2)]),
    ("import subprocess\nsubprocess.run(['ls'])\n", [("dangerous_import", "subprocess", 1)]),
    ("x = '1'\neval(x)\n", [("dangerous_call", "eval", 2), ("dynamic_execution", "eval", 2)]),
    ("import pandas as pd\nprint(pd.DataFrame())\n", []),
    ("def f(\n", [("syntax", "'(' was never closed", 1)]),
    ("return 1\n", [("compile", "'return' outside function", 1)]),
    ("import codecs\nimport socketserver\n", [("dangerous_import", "codecs", 1), ("dangerous_import", "socketserver", 2)]),
    ("f = open('x')\n", [("dangerous_call", "open", 1), ("file_open", "open", 1)]),
    ("from os import system\n", [("dangerous_import", "os.system", 1), ("uncommon_import", "os", 1)]),
    ("", []),
]

_FINDINGS = ", ".join(
    "({}, '{}', '{}', {}, '{}')".format(i, rule, name.replace("'", "''"), line, scripts.RULES[rule][0])
    for i, (_, found) in enumerate(SCRIPTS)
    for rule, name, line in found
)


def _scripts(spark, sf):
    code = F.lit(None).cast("string")
    for i, (source, _) in enumerate(SCRIPTS):
        code = F.when(F.col("doc_id") % len(SCRIPTS) == i, source).otherwise(code)
    # The document follows as comment lines, so that whole texts are scanned.
    comment = F.concat(F.lit("# "), F.regexp_replace("text", r"[\r\n\f\x0B\x00]+", "\n# "))
    return table(spark, sf, "documents").select("doc_id", F.concat(code, comment).alias("code"))


@query(
    "scan_code",
    f"""
    SELECT doc_id, rule, name, CAST(line AS INTEGER) AS line, severity
    FROM documents JOIN (VALUES {_FINDINGS}) f(n, rule, name, line, severity) ON doc_id % {len(SCRIPTS)} = n
    """,
)
def scan_code(spark, sf):
    return scripts.scan_code(_scripts(spark, sf), "doc_id", "code").drop("suggestion")


@query(
    "scan_report",
    f"""
    SELECT severity, rule, count(*) AS findings, count(DISTINCT doc_id) AS scripts
    FROM documents JOIN (VALUES {_FINDINGS}) f(n, rule, name, line, severity) ON doc_id % {len(SCRIPTS)} = n
    GROUP BY ALL
    """,
)
def scan_report(spark, sf):
    return scripts.scan_report(scripts.scan_code(_scripts(spark, sf), "doc_id", "code"), "doc_id")


@query(
    "script_verdicts",
    f"SELECT doc_id, doc_id % {len(SCRIPTS)} IN (3, 9) AS valid FROM documents",
)
def script_verdicts(spark, sf):
    return scripts.annotate_code(_scripts(spark, sf), "code").select("doc_id", "valid")


@query(
    "assemble_chats",
    """
    WITH turns AS (
      SELECT conv_id, turn, role, text FROM conversations
      UNION ALL
      SELECT conv_id, min(turn) - 0.5, 'system', 'Be brief.' FROM conversations
      GROUP BY conv_id HAVING arg_min(role, turn) <> 'system')
    SELECT conv_id, count(*) AS n, sha256(string_agg(role || ':' || text, '|' ORDER BY turn)) AS chat
    FROM turns GROUP BY conv_id
    """,
)
def assemble_chats(spark, sf):
    turns = table(spark, sf, "conversations")
    chat = chats.assemble_chats(turns, "conv_id", "turn", "role", "text", system="Be brief.")
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return chat.select(
        "conv_id", F.size("messages").cast("bigint").alias("n"), F.sha2(F.array_join(lines, "|"), 256).alias("chat")
    )


@query(
    "assemble_chats_parts",
    """
    SELECT conv_id, part, count(*) AS n, sha256(string_agg(text, '|' ORDER BY turn)) AS chat
    FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS part FROM conversations)
    GROUP BY conv_id, part
    """,
)
def assemble_chats_parts(spark, sf):
    chat = chats.assemble_chats(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", turns_per_part=4)
    lines = F.transform("messages", lambda m: m["content"])
    return chat.select(
        "conv_id", "part", F.size("messages").cast("bigint").alias("n"), F.sha2(F.array_join(lines, "|"), 256).alias("chat")
    )
