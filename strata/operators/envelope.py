"""Response bodies to records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import schema as S
from strata.functions.envelope import envelope_kind, envelope_records, field
from strata.functions.expr import once


def parsed(df: DataFrame, col: str) -> Column:
    """The column as VARIANT; text that is not JSON becomes null."""
    if df.schema[col].dataType.typeName() == "variant":
        return F.col(col)
    return F.try_parse_json(F.col(col))


def unwrap_envelope(
    df: DataFrame,
    body_col: str,
    policy: str = "ingest",
    record_key: str | None = None,
    record_col: str = "record",
    keep_empty: bool = False,
) -> DataFrame:
    """One row per record, in place of the body column.

    `envelope` says where the records were found. With `keep_empty`, bodies without records stay as
    one row with a null record, so that unexpected bodies can be counted or quarantined.
    """
    value = F.col("_body")
    expand = F.posexplode_outer if keep_empty else F.posexplode
    return (
        once(df, "_body", parsed(df, body_col))
        .drop(body_col)
        .select(
            *[F.col(c) for c in df.columns if c != body_col],
            envelope_kind(value, policy, record_key).alias("envelope"),
            expand(envelope_records(value, policy, record_key)).alias("position", record_col),
        )
    )


def typed_fields(record: str | Column, schema: Mapping[str, str]) -> list[Column]:
    """Top-level fields of a VARIANT record as typed columns; a value that does not fit is null."""
    value = F.col(record) if isinstance(record, str) else record
    return [field(value, name, S.spark_type(t) or "variant").alias(name) for name, t in schema.items()]


def record_columns(df: DataFrame, schema: Mapping[str, str], record_col: str = "record") -> DataFrame:
    """Replace the record column by its fields."""
    return df.select(
        *[F.col(c) for c in df.columns if c != record_col], *typed_fields(record_col, schema)
    )
