"""Fields from XML, short summaries."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.expr import once, trim_all

_SIMPLE_PATH = re.compile(r"/[A-Za-z_][\w.-]*(/[A-Za-z_][\w.-]*)*(/@[A-Za-z_][\w.-]*)?")
_CORRUPT = "_corrupt_record"
# No character of XML, so no text holds it.
_APART = "\uffff"
# The JDK compiles expressions of up to 100 operators and 10 groups.
_HEAVIEST = 90


def _nested(steps: list[list[str]]) -> T.StructType:
    """Schema that reads the given element paths; an attribute `@x` is the field `_x`."""
    heads: dict[str, list[list[str]]] = {}
    for path in steps:
        heads.setdefault(path[0], []).append(path[1:])
    fields = []
    for head, rests in heads.items():
        deeper = [r for r in rests if r]
        if deeper and len(deeper) < len(rests):
            deeper.append(["_VALUE"])
        fields.append(T.StructField(head, _nested(deeper) if deeper else T.StringType()))
    return T.StructType(fields)


def _steps(path: str) -> list[str]:
    return [s.replace("@", "_", 1) if s.startswith("@") else s for s in path.strip("/").split("/")]


def _read(value: Column, kind: T.DataType, path: list[str]) -> Column:
    for step in path:
        value, kind = value[step], kind[step].dataType
    return trim_all(value["_VALUE"] if isinstance(kind, T.StructType) else value)


def _parse(df: DataFrame, col: str, root: str, schema: T.StructType) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "rowTag": root}
    fields = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    return once(df, "_xml", F.from_xml(F.col(col), fields, options))


def _weight(path: str) -> int:
    """No less than what the path adds to an expression: its operators, and its groups as shares of the fewer allowed."""
    return 5 + len(re.findall(r"[^\w\s]|\b(?:and|or|div|mod)\b", path)) + 9 * len(re.findall(r"(?<![\w-])\(|\b(?:and|or|div|mod)\(", path))


def _xpath_texts(text: Column, paths: list[str]) -> Column:
    """The text of the first node that each XPath finds (empty: none), with one parse for all paths that fit an expression."""
    together: list[list[str]] = [[]]
    for path in paths:
        if together[-1] and sum(map(_weight, [*together[-1], path])) > _HEAVIEST:
            together.append([])
        together[-1].append(path)
    joined = [f", '{_APART}', ".join(some) for some in together]
    whole = [f"concat({j})" if len(some) > 1 else j for some, j in zip(together, joined, strict=True)]
    return F.concat(*[F.split(F.xpath_string(text, F.lit(e)), _APART) for e in whole])


def extract_xml(df: DataFrame, col: str, fields: Mapping[str, str]) -> DataFrame:
    """Add named fields of an XML text column, given as paths.

    Plain paths from one root (`/entry/title`, `/entry/link/@href`) are read in one parse of the
    text. Other XPath expressions work too, with one parse for as many as fit one expression. An absent element and
    text that is not well-formed give null.
    """
    if not fields:
        return df
    paths = {n: _steps(p) for n, p in fields.items()}
    roots = {p[0] for p in paths.values()}
    if all(_SIMPLE_PATH.fullmatch(p) for p in fields.values()) and len(roots) == 1 and min(map(len, paths.values())) > 1:
        schema = _nested([list(p) for p in {tuple(p[1:]) for p in paths.values()}])
        parsed = _parse(df, col, roots.pop(), schema)
        whole = F.col(f"_xml.{_CORRUPT}").isNull()
        values = {n: F.when(whole, _read(F.col("_xml"), schema, p[1:])) for n, p in paths.items()}
        return parsed.withColumns(values).drop("_xml")

    probe = F.from_xml(F.col(col), f"{_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    probed = once(df, "_readable", probe[_CORRUPT].isNull())
    texts = {n: p if p.endswith(")") or "/@" in p else f"{p}/text()" for n, p in fields.items()}
    # Text nodes are never empty; attributes may be, so what else is asked for is counted as well.
    asked = [q for p in texts.values() for q in ([p] if p.endswith("/text()") else [p, f"count({p})"])]
    probed = once(probed, "_found", F.when(F.col("_readable"), _xpath_texts(F.col(col), asked)))
    found = {q: F.col("_found")[i] for i, q in enumerate(asked)}
    there = {p: found[f"count({p})"] != "0" if f"count({p})" in found else found[p] != "" for p in texts.values()}
    return probed.withColumns({n: F.when(there[p], trim_all(found[p])) for n, p in texts.items()}).drop("_readable", "_found")


def extract_xml_rows(df: DataFrame, col: str, rows: str, fields: Mapping[str, str]) -> DataFrame:
    """One row per element of an XML text, in place of the text column.

    `rows` is the plain path of the repeated element (`/feed/entry`), `fields` are plain paths below
    it (`title`, `link/@href`). A text without such elements, or not well-formed, gives no rows.
    """
    if not _SIMPLE_PATH.fullmatch(rows) or not all(_SIMPLE_PATH.fullmatch(f"/x/{p}") for p in fields.values()):
        raise ValueError("extract_xml_rows needs plain paths")
    root, *inner = _steps(rows)
    if not inner:
        raise ValueError("the repeated element must be below the root")
    paths = {n: _steps(p) for n, p in fields.items()}
    element = _nested([list(p) for p in {tuple(p) for p in paths.values()}])
    kind: T.DataType = T.ArrayType(element)
    for step in reversed(inner):
        kind = T.StructType([T.StructField(step, kind)])
    value = F.col("_xml")
    for step in inner:
        value = value[step]
    found = F.when(F.col(f"_xml.{_CORRUPT}").isNull(), value)
    others = [c for c in df.columns if c != col]
    return (
        _parse(df, col, root, kind)
        .select(*others, F.explode(found).alias("_row"))
        .select(*others, *[_read(F.col("_row"), element, p).alias(n) for n, p in paths.items()])
    )


def summarize_text(df: DataFrame, col: str, n: int = 2, summary_col: str = "summary") -> DataFrame:
    """The first `n` sentences; a text without a sentence end is its own summary."""
    sentences = rf"(?s)\A(?:.*?[.!?](?:\s+|\z)){{1,{n}}}"
    found = F.regexp_extract(F.col(col), sentences, 0)
    return df.withColumn(summary_col, trim_all(F.when(found == "", F.col(col)).otherwise(found)))
