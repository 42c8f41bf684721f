"""Schema checks: on the declared types (no job) and on the values (one pass)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata import schema as S


class SchemaMismatch(ValueError):
    def __init__(self, messages: list[str]):
        super().__init__(f"schema check failed: {messages}")
        self.messages = messages


def require_schema(df: DataFrame, schema: Mapping[str, str]) -> None:
    """Raise with every mismatch; reads only the schema, so no job runs."""
    found = S.mismatches(df.schema, schema)
    if found:
        raise SchemaMismatch([m[-1] for m in found])


def check_schema(
    df: DataFrame, schema: Mapping[str, str], raise_on_mismatch: bool = False
) -> DataFrame:
    """One row per absent or wrongly typed column, with the number of rows it touches.

    Extra columns are ignored. The check itself needs no job; evaluating the result counts rows.
    """
    if raise_on_mismatch:
        require_schema(df, schema)
    fields = ("position", "column", "expected", "actual", "message")
    kind = "array<struct<position:int,column:string,expected:string,actual:string,message:string>>"
    rows = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, m, strict=True)])
        for m in S.mismatches(df.schema, schema)
    ]
    found = F.array(*rows).cast(kind)
    return (
        df.agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.explode(found).alias("m"), "n_rows")
        .select("m.*", "n_rows")
    )


def profile_schema(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Per target column: rows, nulls, values that do not cast, and the smallest such value."""
    present = [(c, t) for c, t in schema.items() if c in df.columns]
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    for i, (name, expected) in enumerate(present):
        value = F.col(name)
        cast = S.lenient(value, expected, df.schema[name].dataType)
        bad = value.isNotNull() & cast.isNull()
        aggregates += [
            F.count_if(value.isNull()).alias(f"nulls_{i}"),
            F.count_if(bad).alias(f"bad_{i}"),
            F.min(F.when(bad, value.cast("string"))).alias(f"example_{i}"),
        ]
    lines = []
    for name, expected in schema.items():
        at = next((i for i, (c, _) in enumerate(present) if c == name), None)
        known = at is not None
        lines.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(expected).alias("expected"),
                F.lit(df.schema[name].dataType.simpleString() if known else None)
                .cast("string").alias("actual"),
                F.col("n_rows"),
                (F.col(f"nulls_{at}") if known else F.col("n_rows")).alias("nulls"),
                (F.col(f"bad_{at}") if known else F.lit(0).cast("bigint")).alias("bad_values"),
                (F.col(f"example_{at}") if known else F.lit(None).cast("string")).alias("example"),
            )
        )
    return df.agg(*aggregates).select(F.explode(F.array(*lines)).alias("p")).select("p.*")
