"""Column functions that find the list of records inside a JSON response body.

Three policies say where the list is looked for:

* `ingest`     a list; else the field `data`; else `results`; else nothing.
* `transform`  a list; else the field `data`; else the whole value as one record.
* `model`      a list; else the field `results`; else `data`; else an object as one record.

The first field that is present decides, even when it does not hold a list. `record_key` names
another field to use in place of the policy's fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields that may wrap the list, in the order they are tried.
POLICY_FIELDS = {"ingest": ("data", "results"), "transform": ("data",), "model": ("results", "data")}


def _path(key: str) -> str:
    return f"$['{key}']" if "'" not in key else f'$["{key}"]'


def as_list(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def has_field(value: Column, key: str) -> Column:
    return F.try_variant_get(value, _path(key), "variant").isNotNull()


def field(value: Column, key: str, spark_type: str) -> Column:
    return F.try_variant_get(value, _path(key), spark_type)


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def _fields(policy: str, record_key: str | None) -> tuple[str, ...]:
    if policy not in POLICY_FIELDS:
        raise ValueError(f"unknown envelope policy: {policy}")
    return (record_key,) if record_key else POLICY_FIELDS[policy]


def envelope_kind(value: Column, policy: str, record_key: str | None = None) -> Column:
    """`list`, the name of the wrapping field, `whole`, or `unexpected` when there are no records."""
    keys = _fields(policy, record_key)
    kind = F.when(value.isNull(), "unexpected").when(as_list(value).isNotNull(), "list")
    for key in keys:
        held = as_list(value, _path(key)).isNotNull()
        kind = kind.when(has_field(value, key), F.when(held, key).otherwise("unexpected"))
    if record_key or policy == "ingest":
        return kind.otherwise("unexpected")
    if policy == "model":
        return kind.when(is_object(value), "whole").otherwise("unexpected")
    return kind.otherwise("whole")


def envelope_records(value: Column, policy: str, record_key: str | None = None) -> Column:
    """ARRAY<VARIANT> of records; null when the body has none of the expected shapes."""
    keys = _fields(policy, record_key)
    found = F.when(as_list(value).isNotNull(), as_list(value))
    for key in keys:
        found = found.when(has_field(value, key), as_list(value, _path(key)))
    if record_key or policy == "ingest":
        return found
    if policy == "model":
        return found.when(is_object(value), F.array(value))
    return found.when(value.isNotNull(), F.array(value))
