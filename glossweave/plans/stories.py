"""Story jobs: sync of all stories, retry of some, and their lines in the order of the source edition.

Documents come landed as tables: lists (ord, doc) of both editions, and scenarios (event_id, episode_no, doc), doc being null where
getting it failed. Stories, episodes and lines are snapshot tables; each job writes each of them once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import error_digest
from ..functions.documents import get_int, get_string, objects
from ..functions.text import trim
from ..operators import rollup, story
from ..sources.commits import RunLock, delete
from ..sources.snapshot import SnapshotTable

OFFICIAL, PENDING = "official_cn", "jp_pending"


@dataclass
class Tables:
    stories: SnapshotTable
    episodes: SnapshotTable
    lines: SnapshotTable

    def lock(self, mode: str) -> RunLock:
        """The lock that one run at a time holds; runs that fill these tables take the same one."""
        return RunLock(self.stories.spark, f"{self.stories.path}-lock", mode)


@dataclass
class Landed:
    """Documents of one sync: lists of stories, ids (event_id) of the target's events, and scenarios."""

    source_list: DataFrame
    target_list: DataFrame
    target_events: DataFrame
    source_scenarios: DataFrame
    target_scenarios: DataFrame


def _failures(wanted: DataFrame, scenarios: DataFrame, edition: str) -> DataFrame:
    """(event_id, error) of episodes with a scenario that isn't there."""
    have = scenarios.where(F.col("doc").isNotNull()).select("event_id", "episode_no")
    lost = wanted.where("scenario_id <> ''").join(have, ["event_id", "episode_no"], "left_anti")
    return lost.select("event_id", F.format_string(f"event %d: no {edition} scenario of episode %s", "event_id", "episode_no").alias("error"))


def official(landed: Landed) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(episodes, lines, built, failures) of the stories that both editions list; built as story.availability() takes it."""
    ours, theirs = (story.story_episodes(story.story_index(x)) for x in (landed.source_list, landed.target_list))
    both = ours.join(theirs.select("event_id", "episode_no"), ["event_id", "episode_no"], "left_semi")
    episodes, lines = story.build_official(ours.join(theirs.select("event_id").distinct(), "event_id", "left_semi"), theirs, story.pair_scenarios(landed.source_scenarios, landed.target_scenarios))
    failures = _failures(both, landed.source_scenarios, "source").union(_failures(both, landed.target_scenarios, "target"))
    talk = lines.select("event_id").distinct().withColumn("has_talk", F.lit(True))
    built = talk.join(failures.select("event_id").distinct().withColumn("failed", F.lit(True)), "event_id", "full")
    return episodes, lines, built, failures


def pending(landed: Landed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(episodes, lines, failures) of the source edition alone."""
    ours = story.story_episodes(story.story_index(landed.source_list))
    return *story.build_pending(ours, story.pending_lines(landed.source_scenarios)), _failures(ours, landed.source_scenarios, "source")


def _store(tables: Tables, heads: DataFrame, episodes: DataFrame, lines: DataFrame) -> None:
    """Put whole stories in the place of those of equal id; partitions without any of them keep their files."""
    ids = heads.select("event_id")
    for table, rows in ((tables.lines, lines), (tables.episodes, episodes), (tables.stories, heads)):
        parts = table.parts_of(ids)
        stored = table.read(parts=parts)
        new = rows.join(ids, "event_id", "left_semi").select(*(F.col(f.name).cast(f.dataType) for f in stored.schema))
        table.replace(stored.join(ids, "event_id", "left_anti").unionByName(new), parts)


def _heads(ids: DataFrame, source: str, now: int) -> DataFrame:
    return ids.select("event_id", F.lit(source).alias("source"), F.lit("1.0").alias("version"), F.lit(now).cast("bigint").alias("last_updated"))


def sync_stories(tables: Tables, landed: Landed, now: int, limit: int = 3) -> dict:
    """Take official stories in order of id, up to `limit` in a row that aren't there; newer ones that aren't stored then come from the source edition alone. Counts, and the first errors.

    Official stories and those that a person edited stay; one of which a scenario is missing is left for the next run.
    """
    with tables.lock("sync stories"):
        return _sync(tables, landed, now, limit)


def _first_errors(errors: DataFrame) -> str | None:
    """How many different errors there are, and the first three; none of the others leaves its task."""
    told = errors.select("error").distinct()
    shown = told.orderBy("error").limit(3).agg(F.array_sort(F.collect_list("error")).alias("e")).first().e
    more = told.count() - len(shown) if len(shown) == 3 else 0
    return f"{len(shown) + more} failed: {'; '.join(shown)}" + (f"; {more} more" if more else "") if shown else None


def _sync(tables: Tables, landed: Landed, now: int, limit: int) -> dict:
    states = rollup.sync_states(tables.stories.read(), tables.episodes.read(), tables.lines.read()).persist()
    start = rollup.sync_bounds(states).first().start_id
    episodes, lines, built, failures = official(landed)
    index = story.story_index(landed.source_list).select("event_id")
    outcomes = story.availability(states, index, landed.target_events, story.story_index(landed.target_list).select("event_id"), built)
    walked = story.walk_streak(outcomes, start, limit).persist()
    found = walked.where("outcome = 'found'").select("event_id")
    late = story.fallback_events(index, states, walked).persist()
    p_episodes, p_lines, p_failures = pending(landed)
    late = late.join(p_episodes.select("event_id").distinct(), "event_id", "left_semi")
    heads = _heads(found, OFFICIAL, now).unionByName(_heads(late, PENDING, now)).persist()
    lost = failures.join(walked.where("outcome = 'error'").select("event_id"), "event_id", "left_semi").union(p_failures.join(late, "event_id", "left_semi"))
    counts = {r.source: r.n for r in heads.groupBy("source").agg(F.count("*").alias("n")).collect()}
    errors = _first_errors(lost)
    if counts:
        of = lambda rows, ids: rows.join(ids, "event_id", "left_semi")
        _store(tables, heads, of(episodes, found).unionByName(of(p_episodes, late)), of(lines, found).unionByName(of(p_lines, late)))
    for df in (states, walked, late, heads):
        df.unpersist()
    return {"official": counts.get(OFFICIAL, 0), "pending": counts.get(PENDING, 0), "errors": errors}


def retry_stories(tables: Tables, landed: Landed, event_ids: list[int], now: int) -> dict[int, dict]:
    """Take some stories anew, whatever they are: the official one if all of it is there and it has lines, else the source edition's.

    LookupError for an id that the source edition doesn't list, or of which no episode came. Texts that persons edited go too.
    """
    with tables.lock("retry stories"):
        return _retry(tables, landed, event_ids, now)


def _retry(tables: Tables, landed: Landed, event_ids: list[int], now: int) -> dict[int, dict]:
    ids = landed.source_list.sparkSession.createDataFrame([(i,) for i in event_ids], "event_id bigint")
    episodes, lines, built, _ = official(landed)
    there = landed.target_events.select("event_id").distinct()
    whole = built.where(F.coalesce("has_talk", F.lit(False)) & ~F.coalesce("failed", F.lit(False))).join(there, "event_id", "left_semi").join(ids, "event_id", "left_semi").select("event_id").persist()
    rest = ids.join(whole, "event_id", "left_anti")
    p_episodes, p_lines, p_failures = pending(landed)
    rest = rest.join(p_episodes.select("event_id").distinct(), "event_id", "left_semi").persist()
    heads = _heads(whole, OFFICIAL, now).unionByName(_heads(rest, PENDING, now)).persist()
    of = lambda rows, which: rows.join(which, "event_id", "left_semi")
    eps = of(episodes, whole).unionByName(of(p_episodes, rest))
    told = heads.join(eps.groupBy("event_id").agg(F.count("*").alias("episodes")), "event_id", "left").join(of(p_failures, rest).groupBy("event_id").agg(F.count("*").alias("n"), error_digest(F.array_sort(F.collect_list("error"))).alias("e")), "event_id", "left")
    result = {r.event_id: {"source": r.source, "episodes": r.episodes or 0} | ({"errors": r.e} if r.n else {}) for r in told.collect()}  # a row for each id asked for
    if missing := sorted(set(event_ids) - set(result)):
        raise LookupError(f"nothing came of stories {missing}")
    _store(tables, heads, eps, of(lines, whole).unionByName(of(p_lines, rest)))
    for df in (whole, rest, heads):
        df.unpersist()
    return result


def source_order(source_scenarios: DataFrame, lines: DataFrame) -> DataFrame:
    """(event_id, episode_no, keys) of stored lines in the order in which the source edition first says them, bodies before their speakers."""
    talk = source_scenarios.select("event_id", "episode_no", F.posexplode(objects(F.col("doc"), "$.TalkData")).alias("pos", "t"))
    said = talk.select("event_id", "episode_no", F.posexplode(F.array(trim(get_string(F.col("t"), "Body")), trim(get_string(F.col("t"), "WindowDisplayName")))).alias("sub", "jp_key"), (F.col("pos") * 2).alias("at"))
    first = said.where("jp_key <> ''").groupBy("event_id", "episode_no", "jp_key").agg(F.min(F.col("at") + F.col("sub")).alias("at"))
    known = first.join(lines.select("event_id", "episode_no", "jp_key"), ["event_id", "episode_no", "jp_key"], "left_semi")
    return known.groupBy("event_id", "episode_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "jp_key"))), lambda x: x["jp_key"]).alias("keys"))


def reorder_stories(tables: Tables, source_scenarios: DataFrame, event_ids: list[int] | None = None) -> int:
    """Put the lines of some stories, or of all that have scenarios, into the order of the source edition; what it doesn't say comes last. Episodes reordered."""
    with tables.lock("reorder stories"):
        if event_ids is not None:
            source_scenarios = source_scenarios.where(F.col("event_id").isin(event_ids))
        parts = tables.lines.parts_of(source_scenarios.select("event_id").distinct())
        lines = tables.lines.read(parts=parts)
        wanted = source_order(source_scenarios, lines).persist()
        n = wanted.count()
        if n:
            tables.lines.replace(story.reorder_lines(lines, wanted), parts)
        wanted.unpersist()
    return n


#: Gets scenarios of some episodes (event_id, episode_no, scenario_id) of an edition, "source" or "target": (event_id, episode_no, doc), doc being null where that failed.
Fetch = Callable[[DataFrame, str], DataFrame]


def _by_id(listed: DataFrame, folder: str) -> DataFrame:
    """(event_id, ord, doc) of a list document's objects, stored in order of id, so that a range of ids reads little of it."""
    rows = listed.select(get_int(F.col("doc"), "eventId").cast("bigint").alias("event_id"), "ord", "doc").where("event_id <> 0")
    return stored(rows.sort("event_id"), folder)


def stored(rows: DataFrame, folder: str) -> DataFrame:
    """rows, written into a folder of their own under `folder` and read again; they keep few files, where cached rows would have a part for each task."""
    path = f"{folder}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _doubling(ids: DataFrame, first: int) -> list[int]:
    """Last ids of waves of about `first`, twice, four times ... as many ids, and so a few waves whatever their number."""
    told = ids.agg(F.count("*").alias("n"), F.max("event_id").alias("last")).first()
    if not told.n:
        return []
    shares, size = [], first
    while size < told.n:
        shares.append(size / told.n)
        size = size * 2 + first
    cuts = ids.agg(F.percentile_approx("event_id", shares, 10000)).first()[0] if shares else []
    return sorted({*cuts, told.last})


def walk_stories(tables: Tables, source_list: DataFrame, target_list: DataFrame, target_events: DataFrame, fetch: Fetch, now: int, limit: int = 3, wave: int = 8, publish: Callable[[str, str, int, int], None] | None = None) -> dict:
    """sync_stories() for scenarios that are still to be fetched: stories are taken in waves in order of id, and fetching ends with the wave that holds the `limit`-th miss in a row.

    Only stories that both editions list and that aren't kept are fetched; what a wave found is stored before the next one begins, so
    a run that ends early is carried on by the next. Newer stories, which only the source edition has and all of which are taken, come
    in waves that double, as each one writes the tables anew. Scenarios of a wave are stored beside the lines until they are used, as
    they are read several times and must be fetched once.
    """
    spark = source_list.sparkSession
    counts, n_errors, shown = {OFFICIAL: 0, PENDING: 0}, 0, []
    beside = f"{tables.lines.path}-landed"
    with tables.lock("sync stories") as lock:
        run = f"{beside}/{uuid.uuid4().hex}"
        lists = {"source": _by_id(source_list, run), "target": _by_id(target_list, run)}
        states = rollup.sync_states(tables.stories.read(), tables.episodes.read(), tables.lines.read())
        bounds = rollup.sync_bounds(states).first()
        index, theirs = (lists[e].select("event_id").distinct() for e in ("source", "target"))
        none = spark.createDataFrame([], "event_id bigint, has_talk boolean, failed boolean")
        # Without any scenario, what is there counts as a miss; so a miss of an id that is there means that it must be fetched.
        there = target_events.select("event_id").join(theirs, "event_id", "left_semi").distinct().withColumn("there", F.lit(True))
        known = story.availability(states, index, target_events, theirs, none).join(there, "event_id", "left").where(F.col("event_id") >= bounds.start_id)
        known = stored(known.sort("event_id"), run)
        total, after, streak, newest, stopped = known.count(), bounds.start_id - 1, 0, bounds.max_id, False

        def landed(ids: DataFrame, low: int, high: int, editions: list[str]) -> tuple[Landed, list[str]]:
            folders, docs, listed = [], {}, {}
            for edition in ("source", "target"):
                listed[edition] = lists[edition].where(F.col("event_id").between(low, high)).join(ids, "event_id", "left_semi").select("ord", "doc")
                if edition in editions:
                    wanted = story.story_episodes(story.story_index(listed[edition])).where("scenario_id <> ''")
                    folders.append(f"{beside}/{uuid.uuid4().hex}")
                    fetch(wanted.select("event_id", "episode_no", "scenario_id"), edition).write.parquet(folders[-1])
                    docs[edition] = spark.read.schema("event_id bigint, episode_no string, doc variant").parquet(folders[-1])
                else:
                    docs[edition] = spark.createDataFrame([], "event_id bigint, episode_no string, text string").select("event_id", "episode_no", F.parse_json("text").alias("doc"))
            return Landed(listed["source"], listed["target"], target_events, docs["source"], docs["target"]), folders

        def put(ids: DataFrame, n: int, source: str, episodes: DataFrame, lines: DataFrame) -> None:
            _store(tables, _heads(ids, source, now), episodes, lines)
            counts[source] += n

        done = 0
        while not stopped and (rows := known.where(F.col("event_id") > after).orderBy("event_id").limit(wave).collect()):
            low, high, talk, told, folders = rows[0].event_id, rows[-1].event_id, set(), {}, []
            fetched = any(r.there and r.outcome == "miss" for r in rows)
            if fetched:
                got, folders = landed(known.where(F.col("event_id").between(low, high) & F.col("there") & (F.col("outcome") == "miss")).select("event_id"), low, high, ["source", "target"])
                folders.append(f"{beside}/{uuid.uuid4().hex}")
                episodes, lines, _, failures = official(got)
                episodes, lines = stored(episodes, folders[-1]), stored(lines, folders[-1])
                talk = {r.event_id for r in lines.select("event_id").distinct().collect()}  # ids of the wave
                told = {r.event_id: r.error for r in failures.groupBy("event_id").agg(F.min("error").alias("error")).collect()}
            found = []
            for r in rows:
                outcome = "error" if r.event_id in told else "found" if r.event_id in talk else r.outcome
                done, after = done + 1, r.event_id
                if outcome == "miss":
                    streak += 1
                    if stopped := streak >= limit:
                        break
                elif outcome == "error":
                    n_errors, shown = n_errors + 1, sorted([*shown, told[r.event_id]])[:3]
                else:
                    streak = 0
                    found += [r.event_id] if outcome == "found" else []
            if found:
                newest = max(newest, *found)
                put(spark.createDataFrame([(i,) for i in found], "event_id bigint"), len(found), OFFICIAL, episodes, lines)
            for f in folders:
                delete(spark, f)
            lock.renew()
            if publish:
                publish("stories", f"event {after}", done, total)
        after = newest
        late = index.where(F.col("event_id") > after).join(tables.stories.read().select("event_id"), "event_id", "left_anti")
        late = stored(late.sort("event_id"), run) if stopped else late
        for last in _doubling(late, wave) if stopped else []:
            of = late.where((F.col("event_id") > after) & (F.col("event_id") <= last))
            got, folders = landed(of, after + 1, last, ["source"])
            episodes, lines, failures = pending(got)
            folders.append(f"{beside}/{uuid.uuid4().hex}")
            episodes, lines = stored(episodes, folders[-1]), stored(lines, folders[-1])
            some = episodes.select("event_id").distinct()
            lost = stored(failures.join(some, "event_id", "left_semi").groupBy("event_id").agg(F.min("error").alias("error")), folders[-1])
            n_errors, shown = n_errors + lost.count(), sorted([*shown, *(r.error for r in lost.orderBy("error").limit(3).collect())])[:3]
            if n := some.count():
                put(some, n, PENDING, episodes, lines)
            for f in folders:
                delete(spark, f)
            after = last
            lock.renew()
        delete(spark, run)
    text = f"{n_errors} failed: {'; '.join(shown)}" + (f"; {n_errors - 3} more" if n_errors > 3 else "") if n_errors else None
    return {"official": counts[OFFICIAL], "pending": counts[PENDING], "errors": text}
