"""The operators with production parameters over their whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import (
    decontaminate, lang_id, lexical, packing, quality, quality_rules, simhash, simple8b, token_counts, tool_calls, toxicity, vectors, whitening,
)
from strata.llm.components import cut
from strata.llm.samples import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_WORDS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


@query(
    f"""
    WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
    i AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item, coalesce({_WORDS}, []) AS w FROM benchmark),
    iw AS MATERIALIZED (SELECT DISTINCT item, least(len(w), 13) AS n, list_aggregate(w[p : p + least(len(w), 13) - 1], 'string_agg', ' ') AS g
        FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS p FROM i WHERE len(w) > 0)),
    dw AS (SELECT doc_id, p, n, list_aggregate(w[p : p + n - 1], 'string_agg', ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
    hits AS MATERIALIZED (SELECT doc_id, p, n, item FROM dw JOIN iw USING (n, g)),
    words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """
)
def op2_decontaminate(spark, sf_dir):
    found = decontaminate.shared_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_digest("items").alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query()
def op3_simple8b(spark, sf_dir):
    return simple8b.token_index(table(spark, sf_dir, "documents"))


#: The tool that op4 derives from plain conversations: users ask it, the next turn answers.
ASK = {
    "ask": {
        "type": "object", "required": ["text", "turn"], "additionalProperties": False,
        "properties": {"text": {"type": "string", "maxLength": 200}, "turn": {"type": "integer", "minimum": 0}},
    }
}


def asked(conversations: DataFrame) -> DataFrame:
    """Conversations as tool messages: a user turn is a call that comes after the user turn two before, an assistant turn the result
    of the turn before it.
    """
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)
    turn = F.col("turn")
    arguments = F.struct("turn", "text")
    call = F.struct(name(turn).alias("id"), F.lit("ask").alias("name"), arguments.alias("arguments"), F.array(name(turn - 2)).alias("after"))
    calls = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    result = F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), F.col("text").alias("content")))
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    role = F.when(user, "assistant").when(answer, "tool").otherwise(F.col("role"))
    text = F.when(user, calls).when(answer, result).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))


@query(
    """
    WITH m AS (SELECT *, 'c' || conv_id || '-' || CASE WHEN role = 'user' THEN turn ELSE turn - 1 END AS id FROM conversations),
    c AS (SELECT conv_id, id, min(turn) AS call_turn, arg_min(text, turn) AS text, count(*) AS n_calls FROM m WHERE role = 'user' GROUP BY ALL),
    r AS (SELECT conv_id, id, min(turn) AS result_turn, arg_min(text, turn) AS result, count(*) AS n_results FROM m WHERE role = 'assistant' GROUP BY ALL)
    SELECT conv_id, id AS call_id, call_turn, CASE WHEN call_turn IS NOT NULL THEN 0 END AS call_place, result_turn,
        coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
        CASE WHEN call_turn IS NULL THEN 'orphan' WHEN result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
        coalesce(call_turn, result_turn) AS order_turn, 0 AS order_step,
        CASE WHEN length(text) > 200 THEN 'text: longer than 200' ELSE '' END AS errors,
        sha256('{"arguments":' || CASE WHEN call_turn IS NULL THEN 'null' ELSE '{"text":' || to_json(text) || ',"turn":' || call_turn || '}' END
            || ',"id":"' || id || '","name":' || CASE WHEN call_turn IS NULL THEN 'null' ELSE '"ask"' END
            || ',"result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}') AS json_sha256
    FROM c FULL JOIN r USING (conv_id, id)
    """
)
def op4_tool_calls(spark, sf_dir):
    linked = tool_calls.link_every_call(asked(table(spark, sf_dir, "conversations")), ASK)
    return linked.withColumn("errors", F.array_join("errors", "; ")).withColumn("json_sha256", F.sha2("json", 256)).drop("json")


@query()
def op5_toxicity(spark, sf_dir):
    documents, labels, part = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3)
    model = toxicity.train(documents, labels, part != 1)
    scored = cut(toxicity.score_toxicity(documents.select("doc_id", "lang", "text"), model))
    return toxicity.flag(scored, labels, part != 1).select("doc_id", (part == 1).alias("held_out"), "score", "predicted", "flagged")


_SOUND = "label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@query(
    f"""
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_SOUND}),
    links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
        AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
    c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id,
        vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
    FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
    """
)
def op6_vectors(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op7_language(spark, sf_dir):
    documents, part = table(spark, sf_dir, "documents"), fold("doc_id", 5)
    model = lang_id.train(documents.where(part != 0))
    found = lang_id.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (part == 0).alias("held_out"), "lang_pred", "score")


@query()
def op8_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op9_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query()
def op10_quality(spark, sf_dir):
    documents, part = table(spark, sf_dir, "documents"), fold("doc_id", 5)
    model = quality.train(documents, table(spark, sf_dir, "labels"), part != 0)
    return quality.score_quality(documents.select("doc_id", "text"), model).select("doc_id", (part == 0).alias("held_out"), "score", "predicted")


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
    tf AS MATERIALIZED (SELECT row, doc_id, term, count(*) AS tf FROM (SELECT row, doc_id, {_TERMS} AS term FROM d) GROUP BY ALL),
    n AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
    i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark WHERE item_id IS NOT NULL)),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total
        WHERE term IN (SELECT term FROM i) GROUP BY term, docs),
    m AS (SELECT row, 10 + (90 * n * docs) // words AS m FROM n, total),
    s AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
        FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
    WHERE rank <= 10
    """
)
def op11_lexical(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_HOST_RULES = ["few_words", "repetition", "symbols", "word_length", "repeated_lines"]


def _host_sql() -> str:
    """Shrunk rates of each rule by host, and the hosts that fail one."""
    moments = ", ".join(f"sum({r}) / sum(n) AS m_{r}, sum({r} * {r} / n) - sum({r}) * (sum({r}) / sum(n)) AS s_{r}" for r in _HOST_RULES)
    shared = ", ".join(f"CASE WHEN m_{r} > 0 AND m_{r} < 1 AND room > 0 THEN (s_{r} / (m_{r} * (1 - m_{r})) - (hosts - 1)) / room ELSE 0 END AS x_{r}" for r in _HOST_RULES)
    weights = ", ".join(f"m_{r}, CASE WHEN x_{r} <= 0 THEN 1e6 ELSE least(greatest(1 / x_{r} - 1, 1), 1e6) END AS w_{r}" for r in _HOST_RULES)
    failed = " OR ".join(f"({r} + m_{r} * w_{r}) / (n + w_{r}) > 0.5" for r in _HOST_RULES)
    return f"""
    hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(sum(CAST({r} AS INT)) AS DOUBLE) AS {r}" for r in _HOST_RULES)}
        FROM judged WHERE source IS NOT NULL GROUP BY source),
    moments AS (SELECT count(*) AS hosts, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room, {moments} FROM hosts),
    shared AS (SELECT *, {shared} FROM moments),
    prior AS (SELECT {weights} FROM shared),
    failing AS (SELECT source FROM hosts, prior WHERE {failed})"""


@query(
    rf"""
    WITH t AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    l AS (SELECT *, list_filter(string_split(text, E'\n'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
    g AS (SELECT row, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT row, w, unnest(generate_series(1, len(w) - 2)) AS p FROM t)),
    twice AS (SELECT row, p FROM (SELECT row, p, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1),
    again AS (SELECT row, count(DISTINCT q) AS n FROM (SELECT row, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY row),
    c AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
        FROM l LEFT JOIN again USING (row)),
    judged AS (SELECT *, n_words < 50 AS few_words, 100 * n_repeat_words > 50 * n_words AS repetition, 10 * n_symbols > n_words AS symbols,
        n_words > 0 AND word_chars NOT BETWEEN 3 * n_words AND 10 * n_words AS word_length, 10 * n_dup_lines > 3 * n_lines AS repeated_lines FROM c),
    {_host_sql()}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repetition AS base_failed,
        NOT (few_words OR repetition) AND failing.source IS NULL AS kept
    FROM judged LEFT JOIN failing USING (source)
    """
)
def op12_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op13_whitening(spark, sf_dir):
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))
