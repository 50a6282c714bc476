"""Merges of new rows into stored entries, as joins that yield the whole next snapshot with an action for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import merge_ids
from ..model import CN, ENTRY_KEY, HUMAN, LLM, PINNED, RANK, UNKNOWN

ENTRY_COLUMNS = [*ENTRY_KEY, "cn_text", "source", "ids", "updated_at", "updated_by"]


def _no_ids() -> Column:
    return F.array().cast("array<string>")


def sync_merge(entries: DataFrame, pairs: DataFrame, traces: DataFrame, now: int, strict_precedence: bool = False, actor: str = "cn-sync") -> DataFrame:
    """Entries after official texts arrived, with `action`: insert, update, trace or keep.

    pairs: (category, field, jp_key, cn_text), one row a key. traces: (category, field, jp_key, ids). A text that arrived replaces
    all but pinned ones; a blank one only blanks what has no text. With strict_precedence it spares texts of a higher rank too.
    Ids are appended in order. A key with a trace but no pair only gains ids, if it is stored, and keeps its time and author.
    """
    new = pairs.select(*ENTRY_KEY, F.col("cn_text").alias("new_text"), F.lit(True).alias("paired"))
    new = new.join(traces.select(*ENTRY_KEY, F.col("ids").alias("new_ids")), ENTRY_KEY, "full")
    both = entries.select(*ENTRY_COLUMNS, F.lit(True).alias("stored")).join(new, ENTRY_KEY, "full")
    stored, paired = F.col("stored").isNotNull(), F.col("paired").isNotNull()
    spared = stored & (F.col("source") == PINNED)
    if strict_precedence:
        rank = F.coalesce(*(F.when(F.col("source") == source, value) for source, value in RANK.items()), F.lit(0))
        spared = spared | (stored & (F.col("cn_text") != "") & (rank > RANK[CN]))
    arrived = F.col("new_text") != ""
    keeps = (arrived & spared) | (~arrived & stored & (F.col("cn_text") != ""))
    text = F.when(~paired | keeps, F.col("cn_text")).when(arrived, F.col("new_text")).otherwise(F.lit(""))
    source = F.when(~paired | keeps, F.col("source")).when(arrived, F.lit(CN)).otherwise(F.lit(UNKNOWN))
    ids = merge_ids(F.col("ids"), F.col("new_ids"))
    both = both.where(stored | paired).withColumns({"_text": text, "_source": source, "_ids": ids})
    more = stored & (F.coalesce("ids", _no_ids()) != F.col("_ids"))
    changed = (F.col("_text") != F.col("cn_text")) | (F.col("_source") != F.col("source"))
    action = F.when(~stored, "insert").when(paired & (changed | more), "update").when(~paired & more, "trace").otherwise("keep")
    both = both.withColumn("action", action)
    touched = F.col("action").isin("insert", "update")
    return both.select(
        *ENTRY_KEY, F.col("_text").alias("cn_text"), F.col("_source").alias("source"), F.col("_ids").alias("ids"),
        F.when(touched, F.lit(now)).otherwise(F.col("updated_at")).cast("bigint").alias("updated_at"), F.when(touched, F.lit(actor)).otherwise(F.col("updated_by")).alias("updated_by"), "action",
    )


def copy_field(merged: DataFrame, category: str = "mysekai", source_field: str = "tag", target_field: str = "flavorText") -> DataFrame:
    """After sync_merge: texts of one field copied onto the same key of another, where they differ; action becomes copy.

    A blank text of unknown source copies nothing. Times, authors and ids stay.
    """
    told = merged.where((F.col("category") == category) & (F.col("field") == source_field) & ~((F.col("cn_text") == "") & (F.col("source") == UNKNOWN)))
    told = told.select("category", "jp_key", F.lit(target_field).alias("field"), F.col("cn_text").alias("t_text"), F.col("source").alias("t_source"))
    both = merged.join(told, ["category", "field", "jp_key"], "left")
    differs = F.coalesce((F.col("t_text") != F.col("cn_text")) | (F.col("t_source") != F.col("source")), F.lit(False))
    return both.select(
        *ENTRY_KEY, F.when(differs, F.col("t_text")).otherwise(F.col("cn_text")).alias("cn_text"), F.when(differs, F.col("t_source")).otherwise(F.col("source")).alias("source"),
        "ids", "updated_at", "updated_by", "action", differs.alias("copied"),
    )


def count_changes(merged: DataFrame) -> DataFrame:
    """One row: rows that a merge changed; a copied text counts beside its row's own action."""
    copied = F.count_if("copied") if "copied" in merged.columns else F.lit(0)
    return merged.agg((F.count_if(F.col("action") != "keep") + copied).alias("changed"))


def fill_merge(entries: DataFrame, updates: DataFrame, now: int, actor: str = "ai") -> DataFrame:
    """Entries after machine translations (category, field, jp_key, cn_text), with action: insert, update, skip or keep.

    Texts of pinned, human and cn source are skipped, and texts of a source that isn't known here; blank and machine texts are replaced.
    """
    both = entries.select(*ENTRY_COLUMNS, F.lit(True).alias("stored")).join(updates.select(*ENTRY_KEY, F.col("cn_text").alias("new_text"), F.lit(True).alias("offered")), ENTRY_KEY, "full")
    stored, offered = F.col("stored").isNotNull(), F.col("offered").isNotNull()
    guarded = F.col("source").isin(PINNED, HUMAN, CN) | ((F.col("cn_text") != "") & ~F.col("source").isin(UNKNOWN, LLM))
    action = F.when(~offered, "keep").when(~stored, "insert").when(guarded, "skip").otherwise("update")
    both = both.withColumn("action", action)
    put = F.col("action").isin("insert", "update")
    pick = lambda new, old, kind: F.when(put, new).otherwise(F.col(old)).cast(kind).alias(old)
    return both.select(*ENTRY_KEY, pick(F.col("new_text"), "cn_text", "string"), pick(F.lit(LLM), "source", "string"), F.coalesce("ids", _no_ids()).alias("ids"), pick(F.lit(now), "updated_at", "bigint"), pick(F.lit(actor), "updated_by", "string"), "action")


def fill_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if(F.col("action").isin("insert", "update")).alias("translated"), F.count_if(F.col("action") == "skip").alias("skipped"))


def edit_merge(entries: DataFrame, edits: DataFrame, now: int) -> DataFrame:
    """Entries after edits (category, field, jp_key, cn_text, source, updated_by), with action: ok, noop or keep."""
    new = edits.select(*ENTRY_KEY, F.col("cn_text").alias("n_text"), F.col("source").alias("n_source"), F.col("updated_by").alias("n_by"), F.lit(True).alias("edited"))
    both = entries.select(*ENTRY_COLUMNS).join(new, ENTRY_KEY, "full")
    same = (F.col("n_text") == F.col("cn_text")) & (F.col("n_source") == F.col("source"))
    both = both.withColumn("action", F.when(F.col("edited").isNull(), "keep").when(F.coalesce(same, F.lit(False)), "noop").otherwise("ok"))
    ok = F.col("action") == "ok"
    pick = lambda new, old, kind: F.when(ok, new).otherwise(F.col(old)).cast(kind).alias(old)
    return both.select(*ENTRY_KEY, pick(F.col("n_text"), "cn_text", "string"), pick(F.col("n_source"), "source", "string"), F.coalesce("ids", _no_ids()).alias("ids"), pick(F.lit(now), "updated_at", "bigint"), pick(F.col("n_by"), "updated_by", "string"), "action")


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows, replaced by new ones of equal key, and the other new ones."""
    return stored.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_absent(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows and those new ones whose key isn't stored."""
    return stored.unionByName(new.join(stored.select(*key), key, "left_anti"))


def replace_groups(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows without any group of which new rows came, and the new rows."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
