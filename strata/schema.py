"""Target schemas: the ten type names, and how they map to Spark types."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

# The vocabulary of a target schema.
TYPE_NAMES = {
    "int": "bigint",
    "integer": "bigint",
    "float": "double",
    "number": "double",
    "str": "string",
    "string": "string",
    "bool": "boolean",
    "boolean": "boolean",
    "datetime64[ns]": "timestamp_ntz",
    "object": None,
}

_ACCEPTED = {
    "bigint": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "double": (T.FloatType, T.DoubleType),
    "string": (T.StringType,),
    "boolean": (T.BooleanType,),
    "timestamp_ntz": (T.TimestampNTZType, T.TimestampType),
}


def spark_type(name: str) -> str | None:
    """Spark type for a type name; None means "leave the value as it is"."""
    if name in TYPE_NAMES:
        return TYPE_NAMES[name]
    if name.startswith("datetime"):
        return "timestamp_ntz"
    log.warning("uncommon type name %r: values are left as they are", name)
    return None


def accepts(name: str, actual: T.DataType) -> bool:
    """Does a column of Spark type `actual` satisfy the type name?"""
    target = spark_type(name)
    return target is None or isinstance(actual, _ACCEPTED[target])


def mismatches(actual: T.StructType, schema: Mapping[str, str]) -> list[tuple[int, str, str, str, str]]:
    """(position, column, expected, actual, message) for every column that is absent or wrongly typed."""
    types = {f.name: f.dataType for f in actual.fields}
    found = []
    for position, (name, expected) in enumerate(schema.items(), 1):
        if name not in types:
            found.append((position, name, expected, "", f"Missing column: {name}"))
        elif not accepts(expected, types[name]):
            got = types[name].simpleString()
            found.append((position, name, expected, got, f"{name}: expected {expected}, got {got}"))
    return found


def lenient(value: Column, name: str, actual: T.DataType) -> Column:
    """Cast to a named type; a value that does not fit becomes null."""
    target = spark_type(name)
    if target is None or accepts(name, actual) and target in ("string", "boolean", "timestamp_ntz"):
        return value
    return value.try_cast(target)


def strict(value: Column, name: str, actual: T.DataType, label: str) -> Column:
    """Cast to a named type; a value that does not fit fails the query and names the column."""
    cast = lenient(value, name, actual)
    if spark_type(name) is None or accepts(name, actual):
        return cast
    message = F.concat(
        F.lit(f"column {label}: cannot read '"), value.cast("string"), F.lit(f"' as {name}")
    )
    return F.when(value.isNotNull() & cast.isNull(), F.raise_error(message)).otherwise(cast)
