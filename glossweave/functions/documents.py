"""Total accessors for JSON documents whose schema isn't known: a wrong type gives '', 0 or nothing, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import prefix_int, strict_int


def document(text: Column) -> Column:
    return F.try_parse_json(text)


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def get_string(v: Column, key: str) -> Column:
    """A string as it is; numbers and all else are ''."""
    path = f"$.{key}"
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string")).otherwise(F.lit(""))


def _number(v: Column, key: str, parse) -> Column:
    path = f"$.{key}"
    kind = _kind(v, path)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(number, F.try_variant_get(v, path, "double").try_cast("bigint")).when(kind == "STRING", parse(F.try_variant_get(v, path, "string"))).otherwise(F.lit(0)).cast("bigint")


def get_int(v: Column, key: str) -> Column:
    """A number without its fraction, a strict whole number in a string, else 0."""
    return F.coalesce(_number(v, key, strict_int), F.lit(0).cast("bigint"))


def get_prefix_int(v: Column, key: str) -> Column:
    """As get_int, but a string counts by the number it starts with."""
    return F.coalesce(_number(v, key, prefix_int), F.lit(0).cast("bigint"))


def objects(v: Column, path: str = "$") -> Column:
    """The objects of the array at path; anything else gives none."""
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def members(v: Column, path: str) -> Column:
    """Key and array of objects of each member of the object at path."""
    kept = F.coalesce(F.try_variant_get(v, path, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.transform_values(kept, lambda _, x: objects(x))
