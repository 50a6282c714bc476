"""The sync job: documents of two editions into the next snapshot of entries, and what is published from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CATEGORIES
from ..operators import extract, merge
from ..sources.commits import RunLock
from ..sources.snapshot import SnapshotTable


def gather(source: dict[str, DataFrame], target: dict[str, DataFrame], categories: list[str] = CATEGORIES) -> tuple[DataFrame | None, DataFrame | None, dict[str, str]]:
    """(pairs, traces, skipped) of all categories; skipped: why a category has none."""
    pairs = traces = None
    skipped: dict[str, str] = {}
    for c in categories:
        try:
            p, t = extract.extract(c, source, target)
        except LookupError as e:
            skipped[c] = str(e)
            continue
        pairs, traces = (p, t) if pairs is None else (pairs.union(p), traces.union(t))
    return pairs, traces, skipped


def sync(table: SnapshotTable, source: dict[str, DataFrame], target: dict[str, DataFrame], now: int, strict_precedence: bool = False) -> dict:
    """Merge all categories at once and store the next snapshot, if anything changed. Counts by category, and what was skipped."""
    pairs, traces, skipped = gather(source, target)
    if pairs is None:
        return {"changed": {}, "skipped": skipped}
    with RunLock(table.spark, f"{table.path}-lock", "sync"):
        merged = merge.copy_field(merge.sync_merge(table.read(), pairs, traces, now, strict_precedence)).persist()
        counts = merged.groupBy("category").agg((F.count_if(F.col("action") != "keep") + F.count_if("copied")).alias("n")).where("n > 0")
        changed = {r.category: r.n for r in counts.collect()}  # a row a category
        if changed:
            # A table by category keeps the files of categories without a change.
            touched = merged.where(F.col("category").isin(*changed))
            table.replace(touched) if table.partition == "category" and not table.buckets else table.write(merged)
        merged.unpersist()
    return {"changed": changed, "skipped": skipped}
