"""Prompts for a model and what comes back: records and code blocks from reply texts."""

from __future__ import annotations

import ast
import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.envelope import envelope_records
from strata.functions.expr import let, once, trim_all
from strata.operators.envelope import typed_fields

# The form of a user prompt, and how much text one prompt holds.
PROMPT_HEAD = "Instruction: "
PROMPT_BODY = "\n\nRaw Data:\n"
MAX_CHARS = 20000

FENCE = "```"


def system_text(schema: Mapping[str, str]) -> str:
    return (
        "Extract records from the raw data below. Answer with a JSON list of objects and nothing else. "
        "Each object has these fields:\n" + json.dumps(dict(schema), indent=2)
    )


def build_prompts(
    df: DataFrame,
    text_col: str,
    schema: Mapping[str, str],
    instruction: str,
    max_chars: int = MAX_CHARS,
    overflow: str = "split",
) -> DataFrame:
    """Add `part`, `system` and `prompt`, in place of the text column.

    A prompt holds at most `max_chars` characters of raw text. A longer text becomes several prompts, each
    cut after the last line end, or the last space after a sentence, that it has room for; only where there is none
    it is cut at the limit. So nothing is lost. `overflow="truncate"` keeps the first prompt only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    if overflow not in ("split", "truncate"):
        raise ValueError(f"unknown overflow: {overflow}")
    some = f".{{1,{max_chars}}}"
    regex = rf"(?s){some}(?:\z|(?<=\n)|(?<=[.!?][ \t\r]))|{some}"
    pieces = F.when(F.length(text) <= max_chars, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(regex), F.lit(0)))
    if overflow == "truncate":
        pieces = F.slice(pieces, 1, 1)
    head = f"{PROMPT_HEAD}{instruction}{PROMPT_BODY}"
    others = [c for c in df.columns if c != text_col]
    return df.select(*others, F.posexplode(pieces).alias("part", "_piece")).select(
        *others,
        "part",
        F.lit(system_text(schema)).alias("system"),
        F.concat(F.lit(head), "_piece").alias("prompt"),
    )


def strip_fences(reply: Column) -> Column:
    """Remove white space around a reply, and code fences from one that then starts with one."""

    def bare(text: Column) -> Column:
        no_bare = F.replace(text, F.lit(FENCE), F.lit(""))
        no_json = F.replace(F.replace(text, F.lit(f"{FENCE}json"), F.lit("")), F.lit(FENCE), F.lit(""))
        return F.when(text.startswith(f"{FENCE}json"), no_json).when(text.startswith(FENCE), no_bare).otherwise(text)

    return let(trim_all(reply), bare)


def parse_replies(
    df: DataFrame, reply_col: str, schema: Mapping[str, str], keep_bad: bool = False
) -> DataFrame:
    """One typed row per record of a reply, in place of the reply column.

    A reply that is not JSON, or holds no records, gives no rows; with `keep_bad` it gives one row
    of nulls with `reply_ok` = false.
    """
    others = [c for c in df.columns if c != reply_col]
    value = once(df, "_value", F.try_parse_json(strip_fences(F.col(reply_col))))
    found = once(value, "_records", envelope_records(F.col("_value"), "model"))
    # An outer explode, as a plain one adds a filter on its input.
    rows = found.select(
        *others, F.col("_records").isNotNull().alias("reply_ok"), F.posexplode_outer("_records").alias("_at", "_record")
    )
    if not keep_bad:
        rows = rows.filter("_at is not null")
    return rows.select(*others, *(["reply_ok"] if keep_bad else []), *typed_fields("_record", schema))


def _parses(code: str) -> bool:
    try:
        ast.parse(code)
    except Exception:
        return False
    return True


def _first_that_parses(candidates: Column) -> Column:
    """The only Python step: Spark has no check of Python syntax."""

    @F.pandas_udf("string")
    def first(lists: pd.Series) -> pd.Series:
        return lists.map(lambda texts: None if texts is None else next((t for t in texts if _parses(t)), None))

    return first(candidates)


def _block(text: Column, regex: str) -> Column:
    return F.when(text.rlike(regex), trim_all(F.regexp_extract(text, regex, 1)))


def extract_code_blocks(
    df: DataFrame, text_col: str, lang: str = "python", whole_text: bool = False, code_col: str = "code"
) -> DataFrame:
    """Add the code block of a reply, trimmed, or null.

    Python: the first block marked `python`, else the first one without a mark, else, with
    `whole_text`, a whole text that has `import` or `def `. The first of these that parses is taken.
    YAML: the first block that is bare or marked `yaml`, else the text without back-ticks around it.
    """
    text = F.col(text_col)
    if lang == "yaml":
        marked = rf"(?s){FENCE}(?:yaml)?\n(.*?)\n{FENCE}"
        bare = F.regexp_replace(trim_all(text), r"\A`+|`+\z", "")
        return df.withColumn(code_col, F.coalesce(_block(text, marked), trim_all(bare)))
    if lang != "python":
        raise ValueError(f"unknown language: {lang}")
    candidates = [
        _block(text, rf"(?s){FENCE}python\s*\n(.*?)\n{FENCE}"),
        _block(text, rf"(?s){FENCE}\s*\n(.*?)\n{FENCE}"),
    ]
    if whole_text:
        candidates.append(F.when(text.contains("import") | text.contains("def "), trim_all(text)))
    found = let(F.array_compact(F.array(*candidates)), lambda c: F.when(F.size(c) > 0, c))
    return once(df, "_code", _first_that_parses(found)).withColumn(code_col, F.col("_code")).drop("_code")
