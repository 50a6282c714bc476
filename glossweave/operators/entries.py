"""Reading stored entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches, natural_key
from ..model import CATEGORIES, RANK, UNKNOWN


def select_entries(entries: DataFrame, category: str, field: str, source: str | None = None) -> DataFrame:
    """Entries of a field, of one source if it is given. ValueError for an unknown category or a blank field."""
    if category not in CATEGORIES or not field:
        raise ValueError(f"unknown category or blank field: {category!r}, {field!r}")
    rows = entries.where((F.col("category") == category) & (F.col("field") == field))
    return rows.where(F.col("source") == source) if source else rows


def flat(entries: DataFrame) -> DataFrame:
    return entries.select("category", "field", "jp_key", "cn_text")


def search(entries: DataFrame, query: str) -> DataFrame:
    """Entries whose key or text holds the query, whatever its case; a blank query finds all."""
    return entries.where(matches(query, F.col("jp_key"), F.col("cn_text"))) if query else entries


def by_rank(entries: DataFrame) -> DataFrame:
    """Entries that need work first, then by key with numbers by value."""
    rank = F.lit(RANK[UNKNOWN])
    for source, value in RANK.items():
        rank = F.when(F.col("source") == source, value).otherwise(rank)
    return entries.orderBy(rank, natural_key(F.col("jp_key")), "jp_key")
