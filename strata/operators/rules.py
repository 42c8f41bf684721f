"""Declarative row rules: each is one boolean expression, all are checked in one narrow pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.expr import trim_all


@dataclass(frozen=True)
class Rule:
    """`bad` is a Spark SQL condition or Column; a row breaks the rule when it is true.

    A null value breaks only the `required` kinds.
    """

    field: str
    name: str
    bad: Column | str
    message: str

    def broken(self) -> Column:
        bad = F.expr(self.bad) if isinstance(self.bad, str) else self.bad
        return F.coalesce(bad, F.lit(False))


def _blank(field: str) -> Column:
    return F.col(field).isNull() | (F.col(field).cast("string") == "")


def required(field: str) -> Rule:
    return Rule(field, "required", F.col(field).isNull(), f"{field} is required")


def required_when(field: str, condition: str | Column, because: str) -> Rule:
    """Required, and not empty, only where another condition holds."""
    test = F.expr(condition) if isinstance(condition, str) else condition
    return Rule(field, "required_when", test & _blank(field), f"{field} is required for {because}")


def pattern(field: str, regex: str) -> Rule:
    """The whole value matches; a trailing newline does not slip through."""
    return Rule(field, "pattern", ~F.col(field).rlike(rf"\A(?:{regex})\z"), f"{field} does not match {regex}")


def length(field: str, low: int | None = None, high: int | None = None) -> Rule:
    size = F.length(field)
    bad = F.lit(False)
    if low is not None:
        bad = bad | (size < low)
    if high is not None:
        bad = bad | (size > high)
    return Rule(field, "length", bad, f"{field} must have {low or 0} to {high or 'any number of'} characters")


def number_range(field: str, low: float | None = None, high: float | None = None, open_low: bool = False) -> Rule:
    """`low` to `high`; with `open_low` the value must be above `low`."""
    value, bad = F.col(field), F.lit(False)
    if low is not None:
        bad = bad | ((value <= low) if open_low else (value < low))
    if high is not None:
        bad = bad | (value > high)
    bounds = f"{'above' if open_low else 'at least'} {low}" if low is not None else ""
    bounds += " and " if bounds and high is not None else ""
    bounds += f"at most {high}" if high is not None else ""
    return Rule(field, "range", bad, f"{field} must be {bounds}")


def one_of(field: str, values: Sequence[str]) -> Rule:
    return Rule(field, "one_of", ~F.col(field).isin(*values), f"{field} must be one of {', '.join(map(str, values))}")


def not_prefix(field: str, text: str) -> Rule:
    return Rule(field, "not_prefix", F.col(field).startswith(text), f"{field} must not start with {text}")


def not_contains(field: str, text: str) -> Rule:
    return Rule(field, "not_contains", F.col(field).contains(text), f"{field} must not contain {text}")


def not_edge(field: str, text: str) -> Rule:
    value = F.col(field)
    bad = value.startswith(text) | value.endswith(text)
    return Rule(field, "not_edge", bad, f"{field} must not start or end with {text}")


def not_blank(field: str) -> Rule:
    return Rule(field, "not_blank", trim_all(F.col(field)) == "", f"{field} must not be blank")


def non_empty_map(field: str) -> Rule:
    return Rule(field, "non_empty", F.size(field) == 0, f"{field} must not be empty")


_VIOLATION = "array<struct<field:string,rule:string,message:string>>"


def violations(rules: Sequence[Rule]) -> Column:
    """ARRAY of the rules a row breaks, in rule order."""
    each = [
        F.when(
            r.broken(),
            F.struct(F.lit(r.field).alias("field"), F.lit(r.name).alias("rule"), F.lit(r.message).alias("message")),
        )
        for r in rules
    ]
    return F.array_compact(F.array(*each)).cast(_VIOLATION)


def check_rules(df: DataFrame, key: str | Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """One row `(key, field, rule, message)` per broken rule. No shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys, F.explode(violations(rules)).alias("v")).select(*keys, "v.*")


def check_unknown_keys(df: DataFrame, key: str, col: str, allowed: Sequence[str]) -> DataFrame:
    """One row `(key, field, unknown)` per top-level key of a JSON or map column that is not allowed."""
    if df.schema[col].dataType.typeName() == "map":
        names = F.map_keys(F.col(col))
    else:
        names = F.json_object_keys(F.col(col))
    known = F.array(*[F.lit(a) for a in allowed]).cast("array<string>")
    return df.select(key, F.lit(col).alias("field"), F.explode(F.array_except(names, known)).alias("unknown"))


def rule_summary(found: DataFrame, total: int | None = None) -> DataFrame:
    """Violations per field and rule, with the pass rate if the number of rows is given."""
    out = found.groupBy("field", "rule").agg(F.count(F.lit(1)).alias("violations"))
    return out if total is None else out.withColumn("pass_rate", 1 - F.col("violations") / F.lit(total))


def rule_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows, violations and pass rate of every rule, also of those nobody breaks.

    All rules are counted in one aggregate, so only one row per task is shuffled.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(r.broken()).alias(f"bad_{i}") for i, r in enumerate(rules)],
    )
    lines = [
        F.struct(
            F.lit(r.field).alias("field"),
            F.lit(r.name).alias("rule"),
            F.col("n_rows"),
            F.col(f"bad_{i}").alias("violations"),
            F.when(F.col("n_rows") > 0, 1 - F.col(f"bad_{i}") / F.col("n_rows")).alias("pass_rate"),
        )
        for i, r in enumerate(rules)
    ]
    return counts.select(F.explode(F.array(*lines)).alias("r")).select("r.*")
