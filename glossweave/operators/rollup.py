"""Counts and summaries of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CATEGORIES, CN, HUMAN, LLM, PENDING, PINNED

SOURCES = {"cn_count": CN, "human_count": HUMAN, "pinned_count": PINNED, "llm_count": LLM}


def field_counts(entries: DataFrame) -> DataFrame:
    """Per category and field: all rows, rows of each known source, and the rest as unknown. One aggregation."""
    counts = entries.groupBy("category", "field").agg(F.count("*").alias("total"), *(F.count_if(F.col("source") == s).alias(c) for c, s in SOURCES.items()))
    return counts.withColumn("unknown_count", F.col("total") - sum((F.col(c) for c in SOURCES), F.lit(0)))


def source_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("category", "field", "source").agg(F.count("*").alias("n"))


def category_info(entries: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    """(ordinal, category, fields): one row a known category with its fields' counts, in their order. Unknown categories are left out."""
    counts = field_counts(entries.where(F.col("category").isin(categories)))
    field = F.struct(F.col("field").alias("name"), "total", *SOURCES, "unknown_count")
    rows = counts.groupBy("category").agg(F.array_sort(F.collect_list(field)).alias("fields"))
    return rows.select(ordinal(F.col("category"), categories).alias("ordinal"), "category", "fields")


def ordinal(c: Column, values: list[str]) -> Column:
    return (F.array_position(F.array(*map(F.lit, values)), c) - 1).cast("int")


def pending_work(counts: DataFrame) -> DataFrame:
    return counts.withColumn("pending", F.col("llm_count") + F.col("unknown_count"))


def is_pending_title() -> Column:
    return (F.col("title") != "") & F.col("title_source").isin(PENDING)


def story_summaries(stories: DataFrame, episodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Each story's episodes and what it still lacks: lines without text, and pending titles."""
    eps = episodes.groupBy("event_id").agg(F.count("*").alias("episode_count"), F.count_if(is_pending_title()).alias("titles"))
    blank = lines.where(F.col("cn_text") == "").groupBy("event_id").agg(F.count("*").alias("blank"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return stories.join(eps, "event_id", "left").join(blank, "event_id", "left").select("event_id", "source", "last_updated", zero("episode_count").alias("episode_count"), (zero("blank") + zero("titles")).alias("untranslated_count"))


def sync_states(stories: DataFrame, episodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Each story's flags: official, machine-made, and whether a person edited any part of it."""
    edited = [HUMAN, PINNED]
    touched = lines.where(F.col("source").isin(edited)).select("event_id").union(episodes.where(F.col("title_source").isin(edited)).select("event_id")).distinct()
    return stories.join(touched.withColumn("touched", F.lit(True)), "event_id", "left").select(
        "event_id", "source", F.col("source").isin("official_cn", "official_cn_legacy").alias("is_official"), (F.col("source") == LLM).alias("is_llm"), (F.col("source").isin(edited) | F.col("touched").isNotNull()).alias("preserve")
    )


def sync_bounds(states: DataFrame) -> DataFrame:
    """One row: greatest id, latest official, first machine-made, and where the next sync starts."""
    one = states.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("max_id"), F.max(F.when(F.col("is_official"), F.col("event_id"))).alias("latest_official"), F.min(F.when(F.col("is_llm"), F.col("event_id"))).alias("first_llm"))
    return one.withColumn("start_id", F.coalesce("first_llm", F.col("latest_official") + 1, F.lit(1)))


def skipped_categories(events: DataFrame) -> DataFrame:
    """(category, detail): of events (ord, category, detail) each category once, with its last detail."""
    return events.groupBy("category").agg(F.max_by("detail", "ord").alias("detail"))


def run_totals(results: DataFrame) -> DataFrame:
    """Totals of a run over results (event_id, candidates, translated, skipped, error)."""
    return results.agg(F.countDistinct(F.when(F.col("translated") > 0, F.col("event_id"))).alias("stories"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("candidates", "translated", "skipped")), F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"))
