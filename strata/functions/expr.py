"""Small building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value inside one expression: it is computed once per row, however often it is used.

    Without this, a value used n times is n copies of its expression tree, and nested uses multiply.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is costly to compute and used often, among others in filters.

    A filter on a plain column is pushed below it and computes the value again, once per mention. A
    one-element explode stops that: the value is computed once, and nothing is shuffled.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def trim_all(text: Column) -> Column:
    """Without white space of any kind on either side."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def observed(observation: Observation) -> dict:
    """What was observed; nothing where the optimizer, before or during the run, found that no rows are left and cut the plan."""
    try:
        return dict(observation.get)
    except Py4JJavaError as e:
        if "AssertionError" not in str(e):
            raise
        return {}
