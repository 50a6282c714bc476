"""Ordered lists as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_ids(existing: Column, new: Column) -> Column:
    """existing as it is, then what is new, in order and without blanks."""
    none = F.array().cast("array<string>")
    have, add = F.coalesce(existing, none), F.filter(F.coalesce(new, none), lambda x: x != "")
    return F.concat(have, F.array_except(add, have))


def ordered_keys(order: Column, keys: Column) -> Column:
    """Keys that `order` lists, in that order, then the others in their own."""
    return F.concat(F.array_intersect(order, keys), F.array_except(keys, order))


def first_seen(rows: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """Distinct values of each key in the order of first sight. Values are reduced to one row each before they are gathered."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("_first"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", F.col(value).alias("v")))), lambda s: s["v"]).alias(out))


def last_value(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The value of the last row of each key, also when it is blank."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def digest(values: Column, shown: int = 3) -> Column:
    """The first few values joined, and how many more there are."""
    more = F.size(values) - shown
    head = F.array_join(F.slice(values, 1, shown), "; ")
    return F.when(more > 0, F.concat(head, F.lit("; "), more.cast("string"), F.lit(" more"))).otherwise(head)


def error_digest(values: Column) -> Column:
    """How many errors there are and digest() of them; null if there are none."""
    return F.when(F.size(values) > 0, F.concat(F.size(values).cast("string"), F.lit(" failed: "), digest(values)))


def skipped_digest(names: Column, details: Column, limit: int = 280) -> Column:
    """Skipped categories with their details, of each at most `limit` characters; null if nothing was skipped. names and details: arrays of one length."""
    short = lambda d: F.when(F.length(d) > limit, F.concat(F.substring(d, 1, limit), F.lit("…"))).otherwise(d)
    part = lambda n, d: F.when(F.trim(d) != "", F.concat(n, F.lit(": "), short(F.trim(d)))).otherwise(n)
    return F.when(F.size(names) > 0, F.concat(F.lit("data sync skipped: "), F.array_join(F.zip_with(names, F.transform(details, lambda d: F.coalesce(d, F.lit(""))), part), "; ")))


def complete_enough(texts: Column) -> Column:
    """Whether at least half of the texts, rounded up, aren't blank."""
    from .text import trim

    return F.size(F.filter(texts, lambda t: trim(t) != "")) >= F.ceil(F.size(texts) / 2)
