"""Cleaning steps of the silver layer. All are narrow, but for the two de-duplications."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata import schema as S


def need_columns(df: DataFrame, names: Sequence[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {absent}")


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with a null or NaN in any of the given columns; an absent column is an error."""
    need_columns(df, subset)
    return df.na.drop(subset=list(subset))


def cast_columns(df: DataFrame, schema: Mapping[str, str], mode: str = "strict") -> DataFrame:
    """Cast the columns that are present; `strict` fails on a bad value, `lenient` gives null."""
    if mode not in ("strict", "lenient"):
        raise ValueError(f"unknown mode: {mode}")
    casts = {}
    for name, expected in schema.items():
        if name in df.columns:
            actual = df.schema[name].dataType
            cast = S.lenient(F.col(name), expected, actual)
            casts[name] = cast if mode == "lenient" else S.strict(F.col(name), expected, actual, name)
    return df.withColumns(casts) if casts else df


def standardize_dates(
    df: DataFrame, cols: Sequence[str], formats: Sequence[str], as_text: bool = True
) -> DataFrame:
    """Bring mixed date texts to one form; formats are tried in order, none matching gives null."""
    need_columns(df, cols)

    def one(name: str) -> Column:
        if isinstance(df.schema[name].dataType, T.StringType):
            tries = [F.try_to_timestamp(F.col(name), F.lit(f)) for f in formats]
            value = F.to_date(F.coalesce(*tries))
        else:
            value = F.to_date(F.col(name))
        return F.date_format(value, "yyyy-MM-dd") if as_text else value

    return df.withColumns({c: one(c) for c in cols})


def derive_date_parts(df: DataFrame, col: str = "created_at", prefix: str | None = None) -> DataFrame:
    """Add `<prefix>_date` and `<prefix>_year`; without the column the input is returned unchanged."""
    if col not in df.columns:
        return df
    prefix = prefix or col.removesuffix("_at")
    return df.withColumns({f"{prefix}_date": F.to_date(col), f"{prefix}_year": F.year(col)})


def filter_rows(df: DataFrame, condition: str | Column) -> DataFrame:
    """Keep rows for which the condition is true."""
    return df.filter(condition)


def derive_columns(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """Add expression columns in order; a later expression may use an earlier column."""
    for name, text in expressions.items():
        df = df.withColumn(name, F.expr(text))
    return df


def _orderable(data_type: T.DataType) -> bool:
    if isinstance(data_type, (T.MapType, T.VariantType)):
        return False
    if isinstance(data_type, T.ArrayType):
        return _orderable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_orderable(f.dataType) for f in data_type.fields)
    return True


def _distinct_rows(df: DataFrame) -> DataFrame:
    """Spark compares no maps and variants, so those are compared in a canonical form."""
    stand_ins = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.MapType):
            stand_ins[f"_key_{f.name}"] = F.to_json(F.array_sort(F.map_entries(f.name)))
        elif isinstance(f.dataType, T.VariantType):
            stand_ins[f"_key_{f.name}"] = F.to_json(f.name)
    if not stand_ins:
        return df.dropDuplicates()
    plain = [f.name for f in df.schema.fields if f"_key_{f.name}" not in stand_ins]
    return df.withColumns(stand_ins).dropDuplicates([*plain, *stand_ins]).drop(*stand_ins)


def drop_duplicates(
    df: DataFrame, keys: Sequence[str] | None = None, order_by: Sequence[str | Column] | None = None
) -> DataFrame:
    """Whole-row de-duplication, or the first row per key in an explicit order.

    Spark has no file order, so keys need `order_by` ("-name" sorts descending). The other columns
    break ties, which makes the kept row the same on every run. The rank filter is pushed below the
    shuffle as a window group limit: each map task sends at most one row per key, so a key that
    holds much of the table does not pile up in one task.
    """
    if keys is None:
        return _distinct_rows(df)
    if not order_by:
        raise ValueError("drop_duplicates by key needs order_by")
    need_columns(df, keys)
    named = [o for o in order_by if isinstance(o, str)]
    order = [
        o if isinstance(o, Column) else F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc()
        for o in order_by
    ]
    used = {*keys, *(n.removeprefix("-") for n in named)}
    ties = [F.col(f.name) for f in df.schema.fields if f.name not in used and _orderable(f.dataType)]
    window = Window.partitionBy(*keys).orderBy(*order, *ties)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def project_to_schema(
    df: DataFrame, schema: Mapping[str, str], on_missing: str = "error", mode: str = "strict"
) -> DataFrame:
    """Exactly the target columns, in order, cast; a missing column is an error or null."""
    if on_missing not in ("error", "null"):
        raise ValueError(f"unknown on_missing: {on_missing}")
    if on_missing == "error":
        need_columns(df, list(schema))
    out = []
    for name, expected in schema.items():
        if name not in df.columns:
            value = F.lit(None).cast(S.spark_type(expected) or "string")
        else:
            actual = df.schema[name].dataType
            cast = S.lenient if mode == "lenient" else S.strict
            value = cast(F.col(name), expected, actual, *([] if mode == "lenient" else [name]))
        out.append(value.alias(name))
    return df.select(*out)


def add_audit_columns(
    df: DataFrame, ts: datetime | str, batch_id: str, source_file: bool = False
) -> DataFrame:
    """Add `processed_date` and `batch_id`, and for frames read from files the `source_file`."""
    stamp = F.lit(str(ts)).cast("timestamp_ntz")
    audit = {"processed_date": stamp, "batch_id": F.lit(batch_id)}
    if source_file:
        audit["source_file"] = F.col("_metadata.file_name")
    return df.withColumns(audit)
