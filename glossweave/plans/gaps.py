"""Jobs that fill gaps: of fields, of one story, and of all stories. Answers are logged as they come and put into the tables by partition."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..model import CN, ENTRY_KEY, HUMAN, PINNED
from ..operators import fill, merge, story
from ..sources import commits
from ..sources.snapshot import SnapshotTable
from . import waves

#: Story sources that gaps are never filled in: official ones and a person's.
FINAL = ["official_cn", "official_cn_legacy", CN, HUMAN, PINNED]

_ENTRY_LOG = "category string, field string, jp_key string, cn_text string"
_STORY_KEY = ["event_id", "episode_no", "kind", "jp"]
_STORY_LOG = "event_id bigint, episode_no string, kind string, jp string, cn_text string"


def _lock(table: SnapshotTable, mode: str) -> commits.RunLock:
    return commits.RunLock(table.spark, f"{table.path}-lock", mode)


def breaker(table: SnapshotTable) -> waves.SharedBreaker:
    """The breaker of the service that fills a table's gaps."""
    return waves.SharedBreaker(table.spark, f"{table.path}-breaker")


def _planned(table: SnapshotTable, rows: DataFrame) -> tuple[DataFrame, str]:
    """rows, stored beside the table, as a plan must not change while answers come in; and their folder."""
    folder = f"{table.path}-plans/{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return table.spark.read.schema(rows.schema).parquet(folder), folder


def fill_entries(table: SnapshotTable, translate: fill.Translate, now: int, limit: int = 200, size: int = fill.BATCH, tries: int = fill.TRIES, wait: float = 1.0, publish: waves.Publish | None = None) -> dict:
    """Translate at most `limit` candidates of each field and store what came back, also when some batches failed. Counts, and the first errors.

    A field's batches end with its first failure. Answers of a run that died are stored by the next one, without asking again.
    """
    log = waves.BatchLog(table.spark, f"{table.path}-log", _ENTRY_LOG, ENTRY_KEY)
    with _lock(table, "fill entries") as lock:
        earlier = log.runs()
        todo = fill.batches(fill.candidates(table.read(), limit).join(log.read().select(*ENTRY_KEY), ENTRY_KEY, "left_anti"), ["category", "field"], ["jp_key"], size)
        plan, folder = _planned(table, todo.withColumn("group_no", F.xxhash64("category", "field")).withColumn("jp", F.col("jp_key")))
        outcome, run = waves.ask_all(plan, log, translate, waves.Settings(tries, wait), breaker=breaker(table), publish=publish, stage="entries", each_wave=lock.renew)
        came = log.read()
        table.restart()  # what others committed meanwhile stays, and is no conflict
        entries = table.read()
        wanted = came.join(fill.candidates(entries), ENTRY_KEY, "left_semi")
        parts = table.parts_of(wanted)
        merged = merge.fill_merge(table.read(parts=parts), wanted, now)
        if parts:
            table.replace(merged.drop("action"), parts)
        log.forget([*earlier, run])
        commits.delete(table.spark, folder)
    return {"translated": outcome.translated, "skipped": outcome.candidates - outcome.translated, "errors": "; ".join(outcome.shown) + (f"; {outcome.errors - 3} more" if outcome.errors > 3 else "")}


def _pending(stories: SnapshotTable, episodes: SnapshotTable, lines: SnapshotTable, event_id: int | None) -> DataFrame:
    """What is left to translate of one story, or of all that are neither official nor a person's."""
    if event_id is not None:
        of = F.col("event_id") == event_id
        parts = lambda t: t.parts_of(t.spark.createDataFrame([(event_id,)], "event_id bigint"))
        return story.untranslated_targets(episodes.read(parts=parts(episodes)).where(of), lines.read(parts=parts(lines)).where(of))
    source = F.lower(F.trim("source"))
    machine = stories.read().where(~text.story_source(F.col("source")).isin(*FINAL) & ~source.isin(*FINAL)).select("event_id")
    return story.untranslated_targets(episodes.read(), lines.read()).join(machine, "event_id", "left_semi")


def _put(stories: SnapshotTable, episodes: SnapshotTable, lines: SnapshotTable, answers: DataFrame, now: int) -> None:
    """Put answers where a text is still missing, and say of these stories whether anything is left; only their partitions are written.

    Tables are read anew, so what others committed while the service was asked stays, and is no conflict.
    """
    for t in (stories, episodes, lines):
        t.restart()
    ids = answers.select("event_id").distinct()
    parts = {t: t.parts_of(ids) for t in (stories, episodes, lines)}
    if not parts[lines]:
        return
    eps, talk = episodes.read(parts=parts[episodes]), lines.read(parts=parts[lines])
    wanted = answers.join(story.untranslated_targets(eps, talk).select(*_STORY_KEY), _STORY_KEY, "left_semi")
    new_eps, new_talk = story.apply_results(eps, talk, wanted)
    episodes.replace(new_eps, parts[episodes])
    lines.replace(new_talk, parts[lines])
    left = story.untranslated_targets(episodes.read(parts=parts[episodes]), lines.read(parts=parts[lines])).groupBy("event_id").agg(F.count("*").alias("left"))
    heads = stories.read(parts=parts[stories]).join(ids.withColumn("put", F.lit(True)), "event_id", "left").join(left, "event_id", "left")
    source = F.when(F.col("put").isNull(), F.col("source")).when(F.col("left").isNull(), "llm").otherwise("jp_pending")
    stories.replace(heads.withColumns({"source": source, "last_updated": F.when(F.col("put").isNotNull(), F.lit(now)).otherwise(F.col("last_updated")).cast("bigint")}), parts[stories])


def fill_stories(
    stories: SnapshotTable, episodes: SnapshotTable, lines: SnapshotTable, translate: fill.Translate, now: int, size: int = fill.BATCH, tries: int = fill.TRIES, wait: float = 1.0,
    settings: waves.Settings | None = None, automatic: bool = False, event_id: int | None = None, publish: waves.Publish | None = None, service: waves.SharedBreaker | None = None,
) -> dict:
    """Translate what all stories lack that are neither official nor a person's, or what one story lacks. Totals of the run.

    A story's batches go in order and end with its first failure; other stories go on, but in an automatic run the first failure ends
    the run and pauses automatic runs for a while. Each batch's answers are logged when they come, and put into the tables when the
    run ends, whatever ended it; what a run that died has logged is put by the next one, which asks only for the rest.
    """
    log = waves.BatchLog(lines.spark, f"{lines.path}-log", _STORY_LOG, _STORY_KEY)
    with _lock(stories, "fill stories") as lock:
        earlier, run, folder, outcome = log.runs(), None, None, waves.Outcome()
        todo = _pending(stories, episodes, lines, event_id).join(log.read().select(*_STORY_KEY), _STORY_KEY, "left_anti")
        batched = fill.batches(todo, ["event_id"], ["target_no"], size).withColumn("group_no", F.col("event_id"))
        plan, folder = _planned(lines, batched)
        try:
            outcome, run = waves.ask_all(plan, log, translate, settings or waves.Settings(tries, wait), automatic, service or breaker(lines), publish, "stories", lock.renew)
        finally:
            _put(stories, episodes, lines, log.read(), now)
            commits.delete(lines.spark, folder)
        log.forget([*earlier, run])
    totals = {"stories": outcome.groups, "candidates": outcome.candidates, "translated": outcome.translated, "skipped": outcome.candidates - outcome.translated, "errors": outcome.errors}
    return totals | ({"shown": outcome.shown} if outcome.shown else {}) | ({"paused": outcome.paused} if outcome.paused else {})


def fill_story(stories: SnapshotTable, episodes: SnapshotTable, lines: SnapshotTable, event_id: int, translate: fill.Translate, now: int, size: int = fill.BATCH, **more) -> int:
    """Translate what one story lacks, whatever its source. Texts that came; RuntimeError with what the service said if a batch failed, after the texts before it are stored."""
    totals = fill_stories(stories, episodes, lines, translate, now, size, event_id=event_id, **more)
    if totals["errors"]:
        raise RuntimeError(f"story {event_id}: {'; '.join(totals['shown'])}, after {totals['translated']} texts")
    return totals["translated"]
