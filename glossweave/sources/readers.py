"""Readers of nested JSON documents and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import ordered_keys
from ..functions.text import id_of_file
from ..model import CATEGORIES, UNKNOWN
from .snapshot import SnapshotTable

#: How published documents are nested, and in full_rows() the notation of values stored as strings.
_FLAT = "map<string,map<string,string>>"
_STORY = "struct<meta:struct<source:string,version:string,last_updated:bigint>,episodes:map<string,struct<scenarioId:string,title:string,titleSource:string,talkData:map<string,string>,talkSources:map<string,string>,talkOrder:array<string>,speakerNames:map<string,string>>>>"


def stored(table: SnapshotTable, category: str | None = None) -> DataFrame:
    """A stored table, of one category if it is given; where the table is partitioned by it, others aren't read."""
    if category is None:
        return table.read()
    by_category = table.partition == "category" and not table.buckets
    return table.read(parts=[f"p{category}"] if by_category else None).where(F.col("category") == category)


def documents(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(name, value): each file whole, under its name; only those of some names if a glob is given. Spark decodes .gz files itself."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(F.col("_metadata.file_name").alias("name"), "value")


def flat_rows(files: DataFrame) -> DataFrame:
    """(category, field, jp_key, text) of flat category documents (name, value)."""
    fields = files.select(F.regexp_replace("name", r"\.json$", "").alias("category"), F.explode(F.from_json("value", _FLAT)).alias("field", "rows"))
    return fields.select("category", "field", F.explode("rows").alias("jp_key", "text"))


def full_rows(files: DataFrame, flat: DataFrame) -> DataFrame:
    """(category, field, jp_key, cn_text, source, ids, recovered) of full category documents.

    A value is an object, or a string with another language's notation of one. Of such a string source and ids are taken, and the text
    from the flat rows, as quotes in it can't be told apart. Any other value stops the job.
    """
    parsed = files.select(F.regexp_replace("name", r"\.full\.json$", "").alias("category"), F.parse_json("value").alias("doc"))
    fields = parsed.select("category", F.explode(F.variant_get("doc", "$", "map<string,map<string,variant>>")).alias("field", "rows"))
    cells = fields.select("category", "field", F.explode("rows").alias("jp_key", "v"))
    kind = F.schema_of_variant("v")
    cells = cells.withColumns({"is_object": kind.startswith("OBJECT") | (kind == "VOID"), "said": F.when(kind == "STRING", F.try_variant_get("v", "$", "string"))})
    wrong = F.raise_error(F.concat_ws(" ", F.lit("unparseable value:"), "category", "field", "jp_key"))
    none = F.array().cast("array<string>")
    list_ = F.regexp_extract("said", r"'ids'\s*:\s*\[([^\]]*)\]", 1)
    source = F.regexp_extract("said", r"'source'\s*:\s*'([^']*)'", 1)
    has_source = F.col("said").rlike(r"'source'\s*:\s*'[^']*'")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    rows = cells.join(flat.select("category", "field", "jp_key", F.col("text").alias("flat_text")), ["category", "field", "jp_key"], "left")
    told = F.when(F.col("is_object"), F.struct(F.coalesce(get("$.text", "string"), F.lit("")).alias("cn_text"), F.coalesce(get("$.source", "string"), F.lit("")).alias("source"), F.coalesce(get("$.ids", "array<string>"), none).alias("ids")))
    told = told.when(F.col("said").isNotNull(), F.struct(F.coalesce("flat_text", F.lit("")).alias("cn_text"), F.when(has_source, source).otherwise(UNKNOWN).alias("source"), F.regexp_extract_all(list_, F.lit("'([^']*)'"), F.lit(1)).alias("ids")))
    checked = F.when(F.col("is_object") | F.col("said").isNotNull(), F.col("said").isNotNull()).otherwise(wrong.cast("boolean"))
    return rows.select("category", "field", "jp_key", told.alias("e"), checked.alias("recovered")).select("category", "field", "jp_key", "e.*", "recovered")


def load_categories(full: DataFrame, flat_files: DataFrame) -> DataFrame:
    """Rows of all known categories: from the full document where there is one, else from the flat one with unknown source; a blank source is unknown."""
    flat = flat_rows(flat_files.where(F.regexp_replace("name", r"\.json$", "").isin(CATEGORIES)))
    full = full.where(F.regexp_replace("name", r"\.full\.json$", "").isin(CATEGORIES))
    rows = full_rows(full, flat)
    have = full.select(F.regexp_replace("name", r"\.full\.json$", "").alias("category"))
    rest = flat.join(have, "category", "left_anti").select("category", "field", "jp_key", F.col("text").alias("cn_text"), F.lit(UNKNOWN).alias("source"), F.array().cast("array<string>").alias("ids"), F.lit(False).alias("recovered"))
    return rows.withColumn("source", F.when(F.col("source") == "", UNKNOWN).otherwise(F.col("source"))).unionByName(rest)


def recovery_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("rows"), F.count_if("recovered").alias("recovered"))


def stories(files: DataFrame) -> DataFrame:
    """Nested stories for operators.story.store_story, of event_N.json documents; broken ones and other names are left out.

    Lines are in the order that the document lists, then in that of its talk data.
    """
    rows = files.select(id_of_file(F.col("name")).alias("event_id"), F.from_json("value", _STORY).alias("s")).where("event_id >= 0 and s.episodes is not null")
    talk = lambda e: F.transform(ordered_keys(F.coalesce(e["talkOrder"], F.array().cast("array<string>")), F.coalesce(F.map_keys(e["talkData"]), F.array().cast("array<string>"))), lambda k: F.struct(k.alias("jp_key"), F.coalesce(F.try_element_at(e["talkData"], k), F.lit("")).alias("cn_text"), F.try_element_at(e["talkSources"], k).alias("source"), F.try_element_at(e["speakerNames"], k).alias("speaker_name")))
    episodes = F.transform(F.map_entries("s.episodes"), lambda kv: F.struct(kv["key"].alias("episode_no"), kv["value"]["scenarioId"].alias("scenario_id"), kv["value"]["title"].alias("title"), kv["value"]["titleSource"].alias("title_source"), talk(kv["value"]).alias("talk")))
    return rows.select("event_id", F.coalesce("s.meta.source", F.lit("")).alias("source"), F.coalesce("s.meta.version", F.lit("")).alias("version"), "s.meta.last_updated", episodes.alias("episodes"))


def import_report(files: DataFrame) -> DataFrame:
    """(name, problem) of story documents (name, value) that stories() leaves out, and why; import goes on without them."""
    parsed = files.select("name", id_of_file(F.col("name")).alias("event_id"), F.from_json("value", _STORY).alias("s"))
    problem = F.when(F.coalesce(F.col("event_id"), F.lit(-1)) < 0, "no event in the name").when(F.col("s").isNull() | F.col("s.episodes").isNull(), "no episodes, or not JSON")
    return parsed.select("name", problem.alias("problem")).where("problem is not null")


def is_valid_source(names: list[str]) -> bool:
    """Whether a folder with these file names holds any known category."""
    return any(f"{c}{end}" in names for c in CATEGORIES for end in (".json", ".full.json"))
