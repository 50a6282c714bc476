"""The search index: names of all categories with their translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import get_prefix_int, get_string
from ..functions.text import trim

#: Document, group, name member, category and field of the translation.
SOURCES = [("events", "events", "name", "events", "name"), ("musics", "music", "title", "music", "title"), ("cards", "cards", "prefix", "cards", "prefix"), ("gachas", "gacha", "name", "gacha", "name"), ("mysekaiFixtures", "mysekai", "name", "mysekai", "fixtureName"), ("virtualLives", "live", "name", "virtualLive", "name"), ("costumes", "costumes", "name", "costumes", "name")]


def with_text(rows: DataFrame, entries: DataFrame, category: str, field: str, name: str) -> DataFrame:
    """rows with `cn`: the stored text of `name`, or null where there is none or it only repeats the name."""
    known = entries.where((F.col("category") == category) & (F.col("field") == field) & (F.col("cn_text") != "") & (F.col("cn_text") != F.col("jp_key")))
    return rows.join(known.select(F.col("jp_key").alias(name), F.col("cn_text").alias("cn")), name, "left")


def index_rows(documents: dict[str, DataFrame], entries: DataFrame) -> DataFrame | None:
    """(part, ord, id, n, g, c, cn) of the documents that are there, in published order; None if there are none.

    Blank names are left out, of costumes dashes too. Only cards have c, and 0 is none. Names are looked up as they are, untrimmed.
    """
    out = None
    for part, (file, group, name, category, field) in enumerate(SOURCES):
        if file not in documents:
            continue
        rows = documents[file].select("ord", get_prefix_int(F.col("doc"), "id").alias("id"), get_string(F.col("doc"), name).alias("n"), F.nullif(get_prefix_int(F.col("doc"), "characterId"), F.lit(0)).alias("c"))
        rows = rows.where(trim(F.col("n")) != "")
        rows = rows.where("n <> '-'") if group == "costumes" else rows
        rows = with_text(rows, entries, category, field, "n")
        c = F.col("c") if group == "cards" else F.lit(None).cast("bigint")
        rows = rows.select(F.lit(part).alias("part"), "ord", "id", "n", F.lit(group).alias("g"), c.alias("c"), "cn")
        out = rows if out is None else out.union(rows)
    return out


def index_json() -> Column:
    """Each row as JSON; what is null has no member."""
    return F.to_json(F.struct("id", "n", "g", "c", "cn"))


def next_index(documents: dict[str, DataFrame], entries: DataFrame, old: DataFrame | None) -> DataFrame | None:
    """index_rows() of the documents that could be got, or the old index if none could."""
    new = index_rows(documents, entries)
    return old if new is None else new
