"""Import of a folder of published documents: categories and stories into their tables, in one job with a report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CATEGORIES
from ..operators import story
from ..sources import commits, readers
from ..sources.snapshot import SnapshotTable
from . import stories as jobs


@dataclass
class Report:
    """What an import took, and what it took another way or not at all: the first few of `problems` warnings."""

    categories: int = 0
    entries: int = 0
    stories: int = 0
    problems: int = 0
    warnings: list[str] = field(default_factory=list)


def import_folder(entries: SnapshotTable, tables: jobs.Tables, spark: SparkSession, folder: str, now: int, shown: int = 20) -> Report:
    """Replace the categories of which `folder` has documents, and the stories under its eventStory, by what these say.

    Categories and stories that it lacks stay. A story that can't be read is left out with a warning; a value that had to be recovered
    has one too. ValueError, before anything is written, if no category is there. Entries are partitioned by category, so that the
    other categories' files stay as they are.
    """
    top = folder.rstrip("/")
    names = sorted(commits.names(spark, top))
    if not readers.is_valid_source(names):
        raise ValueError(f"{top}: no category document")
    with commits.RunLock(spark, f"{entries.path}-lock", "import"), tables.lock("import"):
        files = readers.documents(spark, [f"{top}/{n}" for n in names if n.removesuffix(".json").removesuffix(".full") in CATEGORIES and n.endswith(".json")])
        is_full = F.col("name").endswith(".full.json")
        rows = readers.load_categories(files.where(is_full), files.where(~is_full)).persist()
        taken = [c for c in CATEGORIES if f"{c}.json" in names or f"{c}.full.json" in names]
        stamped = rows.select("category", "field", "jp_key", "cn_text", "source", "ids", F.lit(now).cast("bigint").alias("updated_at"), F.lit("import").alias("updated_by"))
        by_category = entries.partition == "category" and not entries.buckets
        entries.read()  # the version that this replaces categories of
        if by_category:
            entries.replace(stamped, [f"p{c}" for c in taken])
        else:
            entries.write(entries.read().where(~F.col("category").isin(taken)).unionByName(stamped))
        report = Report(len(taken), rows.count())
        recovered = rows.where("recovered").select(F.format_string("%s/%s: %s recovered", "category", "field", "jp_key").alias("w"))
        warnings = recovered
        if "eventStory" in names:
            found = readers.documents(spark, [f"{top}/eventStory"], "event_*.json").persist()
            known = readers.stories(found).where("event_id > 0")
            heads, episodes, lines = story.store_story(known, now)
            jobs._store(tables, heads, episodes, lines)
            report.stories = heads.count()
            warnings = warnings.unionByName(readers.import_report(found).select(F.concat_ws(": ", "name", "problem").alias("w")))
        report.problems = warnings.count()
        report.warnings = [r.w for r in warnings.orderBy("w").limit(shown).collect()]
        rows.unpersist()
    return report


def summary(spark: SparkSession, report: Report) -> DataFrame:
    """One row of a report's counts."""
    return spark.createDataFrame([(report.categories, report.entries, report.stories, report.problems)], "categories int, entries bigint, stories bigint, problems bigint")
