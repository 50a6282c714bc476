"""Comparing snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with `side`; repeated rows count."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def flat_compat(flat: DataFrame, entries: DataFrame) -> DataFrame:
    """Per category of flat rows (category, field, jp_key, text): texts that differ from the stored ones, and keys that aren't stored."""
    stored = entries.select("category", "field", "jp_key", "cn_text", F.lit(True).alias("there"))
    rows = flat.join(stored, ["category", "field", "jp_key"], "left")
    return rows.groupBy("category").agg(F.count_if(F.col("there") & (F.col("cn_text") != F.col("text"))).alias("text_diffs"), F.count_if(F.col("there").isNull()).alias("missing"))
