"""Ordered stories: episodes, lines, their sync against two editions, and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.documents import get_int, get_string, objects
from ..functions.text import or_default, strict_int, trim
from ..model import HUMAN, LLM
from .rollup import is_pending_title


def store_story(stories: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stories, episodes, lines) rows of nested stories.

    stories: (event_id, source, version, last_updated, episodes array<struct<episode_no, scenario_id, title, title_source, talk array<struct<
    jp_key, cn_text, source, speaker_name>>>>). A talk item of null text is a listed key without value: it has no row but keeps its place,
    so places can have gaps. A line without source takes the story's.
    """
    head = stories.select("event_id", "source", or_default(F.col("version"), "1.0").alias("version"), F.when(F.coalesce(F.col("last_updated"), F.lit(0)) == 0, F.lit(now)).otherwise(F.col("last_updated")).cast("bigint").alias("last_updated"))
    eps = stories.select("event_id", F.col("source").alias("story_source"), F.posexplode("episodes").alias("position", "e"))
    episodes = eps.select("event_id", "e.episode_no", F.coalesce("e.scenario_id", F.lit("")).alias("scenario_id"), F.coalesce("e.title", F.lit("")).alias("title"), F.coalesce("e.title_source", F.lit("")).alias("title_source"), "position")
    talk = eps.select("event_id", "story_source", "e.episode_no", F.posexplode("e.talk").alias("position", "t")).where(F.col("t.cn_text").isNotNull())
    lines = talk.select("event_id", "episode_no", "t.jp_key", "t.cn_text", or_default(F.col("t.source"), F.col("story_source")).alias("source"), F.coalesce("t.speaker_name", F.lit("")).alias("speaker_name"), "position")
    return head, episodes, lines


def ordered_detail(stories: DataFrame, episodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Stories nested again: episodes and lines in stored order; lines of no known episode are dropped."""
    line = F.struct("position", "jp_key", "cn_text", F.col("source").alias("source"), "speaker_name")
    talk = lines.groupBy("event_id", "episode_no").agg(F.array_sort(F.collect_list(line)).alias("talk"))
    none = F.array().cast("array<struct<position:int,jp_key:string,cn_text:string,source:string,speaker_name:string>>")
    eps = episodes.join(talk, ["event_id", "episode_no"], "left")
    episode = F.struct("position", "episode_no", "scenario_id", "title", "title_source", F.coalesce("talk", none).alias("talk"))
    nested = eps.groupBy("event_id").agg(F.array_sort(F.collect_list(episode)).alias("episodes"))
    return stories.join(nested, "event_id", "left")


def map_detail(ordered: DataFrame) -> DataFrame:
    """(event_id, episode_no, talk_data, talk_sources, talk_order, speaker_names) of ordered_detail; empty source and speaker maps are null."""
    e = ordered.select("event_id", F.explode("episodes").alias("e"))
    as_map = lambda value, keep: F.map_from_entries(F.transform(F.filter("e.talk", keep), lambda t: F.struct(t["jp_key"], t[value])))
    every = lambda t: t["jp_key"].isNotNull()
    speakers = as_map("speaker_name", lambda t: t["speaker_name"] != "")
    sources = as_map("source", every)
    return e.select("event_id", "e.episode_no", as_map("cn_text", every).alias("talk_data"), F.when(F.size(sources) > 0, sources).alias("talk_sources"), F.col("e.talk.jp_key").alias("talk_order"), F.when(F.size(speakers) > 0, speakers).alias("speaker_names"))


def untranslated_targets(episodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(event_id, target_no, episode_no, kind, jp): pending titles by place, then blank lines by episode, as text, and place."""
    titles = episodes.where(is_pending_title()).select("event_id", F.lit(0).alias("part"), F.lit("").alias("by_text"), "position", "episode_no", F.lit("title").alias("kind"), F.col("title").alias("jp"))
    blank = lines.where(F.col("cn_text") == "").select("event_id", F.lit(1).alias("part"), F.col("episode_no").alias("by_text"), "position", "episode_no", F.lit("talk").alias("kind"), F.col("jp_key").alias("jp"))
    order = Window.partitionBy("event_id").orderBy("part", "by_text", "position", "jp")
    return titles.union(blank).select("event_id", F.row_number().over(order).alias("target_no"), "episode_no", "kind", "jp")


def _talk(scenarios: DataFrame, side: str) -> DataFrame:
    """(event_id, episode_no, pos, body, name) of scenario documents (event_id, episode_no, doc)."""
    talk = scenarios.select("event_id", "episode_no", F.posexplode(objects(F.col("doc"), "$.TalkData")).alias("pos", "t"))
    return talk.select("event_id", "episode_no", "pos", trim(get_string(F.col("t"), "Body")).alias(f"{side}_body"), trim(get_string(F.col("t"), "WindowDisplayName")).alias(f"{side}_name"))


def _in_order(parts: DataFrame) -> DataFrame:
    """Lines (event_id, episode_no, jp_key, cn_text, speaker_name, position) of parts (…, ord, jp, cn, speaker): first place, last value."""
    key = ["event_id", "episode_no", "jp"]
    lines = parts.groupBy(*key).agg(F.min("ord").alias("first"), F.max_by("cn", "ord").alias("cn_text"), F.max_by("speaker", F.when(F.col("speaker") != "", F.col("ord"))).alias("speaker_name"))
    place = Window.partitionBy("event_id", "episode_no").orderBy("first")
    return lines.select("event_id", "episode_no", F.col("jp").alias("jp_key"), "cn_text", F.coalesce("speaker_name", F.lit("")).alias("speaker_name"), (F.row_number().over(place) - 1).alias("position"))


def pair_scenarios(source: DataFrame, target: DataFrame) -> DataFrame:
    """Lines of two editions paired by place, up to the shorter one's end.

    Of each place the two bodies, then the two speaker names, make a line if both are there and differ; a body's line names its target speaker.
    """
    both = _talk(source, "s").join(_talk(target, "t"), ["event_id", "episode_no", "pos"])
    part = lambda sub, jp, cn, speaker: F.struct((F.col("pos") * 2 + sub).alias("ord"), F.col(jp).alias("jp"), F.col(cn).alias("cn"), speaker.alias("speaker"))
    parts = both.select("event_id", "episode_no", F.explode(F.array(part(0, "s_body", "t_body", F.col("t_name")), part(1, "s_name", "t_name", F.lit("")))).alias("p")).select("event_id", "episode_no", "p.*")
    return _in_order(parts.where("jp <> '' and cn <> '' and jp <> cn"))


def pending_lines(source: DataFrame) -> DataFrame:
    """Lines of one edition that wait for a translation: bodies with their speakers, then speaker names."""
    part = lambda sub, jp, speaker: F.struct((F.col("pos") * 2 + sub).alias("ord"), F.col(jp).alias("jp"), F.lit("").alias("cn"), speaker.alias("speaker"))
    parts = _talk(source, "s").select("event_id", "episode_no", F.explode(F.array(part(0, "s_body", F.col("s_name")), part(1, "s_name", F.lit("")))).alias("p")).select("event_id", "episode_no", "p.*")
    return _in_order(parts.where("jp <> ''"))


def _numbered(episodes: DataFrame, source: str) -> DataFrame:
    place = Window.partitionBy("event_id").orderBy(strict_int(F.col("episode_no")), "episode_no")
    return episodes.select("event_id", "episode_no", "scenario_id", "title", F.lit(source).alias("title_source"), (F.row_number().over(place) - 1).alias("position"))


def build_official(source_episodes: DataFrame, target_episodes: DataFrame, lines: DataFrame, line_source: str = "cn") -> tuple[DataFrame, DataFrame]:
    """(episodes, lines) of an official edition.

    Episodes (event_id, episode_no, scenario_id, title) of both editions; a target title that only repeats the source's is blank; an episode
    with neither lines nor title goes. Episodes are in numeric order.
    """
    theirs = target_episodes.select("event_id", "episode_no", trim(F.col("title")).alias("t_title"))
    title = F.when(F.col("t_title") == trim(F.col("title")), "").otherwise(F.coalesce("t_title", F.lit("")))
    has = lines.select("event_id", "episode_no").distinct().withColumn("has", F.lit(True))
    eps = source_episodes.join(theirs, ["event_id", "episode_no"], "left").withColumn("title", title).join(has, ["event_id", "episode_no"], "left")
    eps = eps.where(F.col("has").isNotNull() | (F.col("title") != ""))
    return _numbered(eps, line_source), lines.withColumn("source", F.lit(line_source))


def build_pending(source_episodes: DataFrame, lines: DataFrame, line_source: str = "unknown") -> tuple[DataFrame, DataFrame]:
    """(episodes, lines) of a story known in its source edition only. A title alone keeps its episode, also where the scenario failed."""
    has = lines.select("event_id", "episode_no").distinct().withColumn("has", F.lit(True))
    eps = source_episodes.withColumn("title", trim(F.col("title"))).join(has, ["event_id", "episode_no"], "left")
    return _numbered(eps.where(F.col("has").isNotNull() | (F.col("title") != "")), line_source), lines.withColumn("source", F.lit(line_source))


#: Ids of a range that one task walks; ranges are then chained by a row each.
WALK_RANGE = 1 << 16


def walk_streak(checks: DataFrame, start_id: int, limit: int = 3) -> DataFrame:
    """Checks (event_id, outcome) that a sync visits, in order of id, with `streak`, up to the first that completes `limit` misses in a row.

    Outcomes: keep and found reset the streak, miss adds to it, error does neither. Each range of ids counts its misses and those up to
    its last reset; only these counts, a row a range, are chained in one window.
    """
    seen = checks.where(F.col("event_id") >= start_id).withColumn("range", F.floor(F.col("event_id") / WALK_RANGE))
    within = Window.partitionBy("range").orderBy("event_id")
    seen = seen.withColumn("missed", F.count_if(F.col("outcome") == "miss").over(within))
    seen = seen.withColumn("at_reset", F.max(F.when(F.col("outcome").isin("keep", "found"), F.col("missed"))).over(within))
    ranges = seen.groupBy("range").agg(F.max("missed").alias("misses"), F.max("at_reset").alias("last_reset"))
    chain = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("misses").over(chain), F.lit(0)))
    ranges = ranges.select("range", "before", F.max(F.col("before") + F.col("last_reset")).over(chain).alias("base"))
    streak = F.col("before") + F.col("missed") - F.coalesce(F.col("before") + F.col("at_reset"), F.col("base"), F.lit(0))
    marked = seen.join(ranges, "range").select("event_id", "outcome", streak.alias("streak"))
    stop = marked.where((F.col("outcome") == "miss") & (F.col("streak") >= limit)).agg(F.min("event_id").alias("stop_id"))
    return marked.join(stop, F.col("stop_id").isNull() | (F.col("event_id") <= F.col("stop_id")), "inner").select("event_id", "outcome", "streak", "stop_id")


def availability(states: DataFrame, source_stories: DataFrame, target_events: DataFrame, target_stories: DataFrame, built: DataFrame) -> DataFrame:
    """(event_id, outcome) for walk_streak. built: (event_id, has_talk, failed) of stories whose scenarios were read."""
    kept = states.select("event_id", (F.col("is_official") | F.col("preserve")).alias("kept"))
    there = target_events.select("event_id").distinct().join(target_stories.select("event_id").distinct(), "event_id", "left_semi").withColumn("there", F.lit(True))
    rows = source_stories.select("event_id").distinct().join(kept, "event_id", "left").join(there, "event_id", "left").join(built, "event_id", "left")
    outcome = F.when(F.coalesce("kept", F.lit(False)), "keep").when(F.col("there").isNull(), "miss").when(F.coalesce("failed", F.lit(False)), "error").when(F.coalesce("has_talk", F.lit(False)), "found").otherwise("miss")
    return rows.select("event_id", outcome.alias("outcome"))


def fallback_events(source_stories: DataFrame, states: DataFrame, walked: DataFrame) -> DataFrame:
    """Ids after the last stored one that aren't stored, if the walk stopped on a streak; none otherwise."""
    after = states.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("max_id")).join(walked.agg(F.max("stop_id").alias("stop_id"), F.max(F.when(F.col("outcome") == "found", F.col("event_id"))).alias("found_id")))
    rows = source_stories.select("event_id").distinct().join(states.select("event_id"), "event_id", "left_anti")
    return rows.join(after, F.col("stop_id").isNotNull() & (F.col("event_id") > F.greatest("max_id", F.coalesce("found_id", F.lit(0))))).select("event_id")


def reorder_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines with new places: those that wanted (event_id, episode_no, keys array) lists come first, in that order, the rest as they were. Episodes without a list stay."""
    order = wanted.select("event_id", "episode_no", F.posexplode(F.array_distinct("keys")).alias("want", "jp_key"))
    listed = wanted.select("event_id", "episode_no", F.lit(True).alias("listed")).distinct()
    rows = lines.join(listed, ["event_id", "episode_no"], "left").join(order, ["event_id", "episode_no", "jp_key"], "left")
    place = Window.partitionBy("event_id", "episode_no").orderBy(F.col("want").asc_nulls_last(), "position", "jp_key")
    return rows.select(*lines.columns[:-1], F.when(F.col("listed").isNotNull(), F.row_number().over(place) - 1).otherwise(F.col("position")).cast("int").alias("position"))


def apply_results(episodes: DataFrame, lines: DataFrame, results: DataFrame, source: str = LLM) -> tuple[DataFrame, DataFrame]:
    """(episodes, lines) after results (event_id, episode_no, kind, jp, cn_text); blank ones change nothing."""
    put = results.where(F.col("cn_text") != "")
    titles = put.where(F.col("kind") == "title").groupBy("event_id", "episode_no").agg(F.max("cn_text").alias("new"))
    talk = put.where(F.col("kind") == "talk").select("event_id", "episode_no", F.col("jp").alias("jp_key"), F.col("cn_text").alias("new")).dropDuplicates(["event_id", "episode_no", "jp_key"])
    eps = episodes.join(titles, ["event_id", "episode_no"], "left").withColumns({"title": F.coalesce("new", "title"), "title_source": F.when(F.col("new").isNotNull(), source).otherwise(F.col("title_source"))})
    out = lines.join(talk, ["event_id", "episode_no", "jp_key"], "left").withColumns({"cn_text": F.coalesce("new", "cn_text"), "source": F.when(F.col("new").isNotNull(), source).otherwise(F.col("source"))})
    return eps.select(*episodes.columns), out.select(*lines.columns)


def set_source(stories: DataFrame, episodes: DataFrame, lines: DataFrame, now: int, event_ids: list[int] | None = None) -> DataFrame:
    """Stories, all or some of them, whose source tells whether anything is left to translate: llm if nothing, else jp_pending."""
    left = untranslated_targets(episodes, lines).groupBy("event_id").agg(F.count("*").alias("n"))
    of = F.lit(True) if event_ids is None else F.col("event_id").isin(event_ids)
    rows = stories.join(left, "event_id", "left")
    return rows.withColumns({"source": F.when(of, F.when(F.coalesce("n", F.lit(0)) == 0, LLM).otherwise("jp_pending")).otherwise(F.col("source")), "last_updated": F.when(of, F.lit(now)).otherwise(F.col("last_updated")).cast("bigint")}).select(*stories.columns)


def promote(stories: DataFrame, episodes: DataFrame, lines: DataFrame, event_id: int, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Everything of one story marked as a person's."""
    of = F.col("event_id") == event_id
    mark = lambda df, c: df.withColumn(c, F.when(of, HUMAN).otherwise(F.col(c)))
    return mark(stories, "source").withColumn("last_updated", F.when(of, F.lit(now)).otherwise(F.col("last_updated")).cast("bigint")), mark(episodes, "title_source"), mark(lines, "source")


def edit_line(episodes: DataFrame, lines: DataFrame, event_id: int, episode_no: str, text: str, source: str, jp_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One title (without jp_key) or line set anew; LookupError where there is none."""
    at = (F.col("event_id") == event_id) & (F.col("episode_no") == episode_no)
    table = episodes if jp_key is None else lines
    at = at if jp_key is None else at & (F.col("jp_key") == jp_key)
    if table.where(at).isEmpty():
        raise LookupError(f"no such row: story {event_id}, episode {episode_no}")
    text_column, source_column = ("title", "title_source") if jp_key is None else ("cn_text", "source")
    edited = table.withColumns({text_column: F.when(at, text).otherwise(F.col(text_column)), source_column: F.when(at, or_default(F.lit(source), HUMAN)).otherwise(F.col(source_column))})
    return (edited, lines) if jp_key is None else (episodes, edited)


def touch(stories: DataFrame, event_id: int, now: int) -> DataFrame:
    return stories.withColumn("last_updated", F.when(F.col("event_id") == event_id, F.lit(now)).otherwise(F.col("last_updated")).cast("bigint"))


def story_index(stories: DataFrame) -> DataFrame:
    """(event_id, bundle, episodes array<variant>) of a list document's objects (doc variant); an id of 0 is none, the last of equal ids holds."""
    rows = stories.select("ord", get_int(F.col("doc"), "eventId").alias("event_id"), get_string(F.col("doc"), "assetbundleName").alias("bundle"), objects(F.col("doc"), "$.eventStoryEpisodes").alias("episodes"))
    return rows.where("event_id <> 0").groupBy("event_id").agg(F.max_by(F.struct("bundle", "episodes"), "ord").alias("s")).select("event_id", "s.*")


def story_episodes(index: DataFrame) -> DataFrame:
    """(event_id, episode_no, scenario_id, title) of story_index."""
    e = index.select("event_id", F.posexplode("episodes").alias("ord", "e"))
    rows = e.select("event_id", "ord", get_int(F.col("e"), "episodeNo").cast("string").alias("episode_no"), get_string(F.col("e"), "scenarioId").alias("scenario_id"), get_string(F.col("e"), "title").alias("title"))
    return rows.groupBy("event_id", "episode_no").agg(F.max_by(F.struct("scenario_id", "title"), "ord").alias("s")).select("event_id", "episode_no", "s.*")


def display_rows(stories: DataFrame, episodes: DataFrame, lines: DataFrame, normal: Column | None = None) -> DataFrame:
    """(event_id, ord, key, text, source, speaker_name) as an editor lists a story: each episode's title, then its lines."""
    from ..functions.text import row_key

    shown = F.lower(trim(F.col("story_source")))
    shown = normal if normal is not None else F.when(shown.isin("official_cn", "official_cn_legacy", "cn"), "cn").when(shown.isin("llm", "human", "pinned"), shown).otherwise("unknown")
    of = stories.select("event_id", F.col("source").alias("story_source"))
    titles = episodes.where(trim(F.col("title")) != "").select("event_id", "episode_no", F.lit(-1).alias("position"), F.lit("title").alias("kind"), F.col("title").alias("jp"), F.col("title").alias("text"), F.col("title_source").alias("own"), F.lit("").alias("speaker_name"))
    talk = lines.join(episodes.select("event_id", "episode_no"), ["event_id", "episode_no"], "left_semi").select("event_id", "episode_no", "position", F.lit("talk").alias("kind"), F.col("jp_key").alias("jp"), F.col("cn_text").alias("text"), F.col("source").alias("own"), "speaker_name")
    rows = titles.union(talk).join(of, "event_id")
    order = Window.partitionBy("event_id").orderBy(strict_int(F.col("episode_no")), "episode_no", "position", "jp")
    return rows.select("event_id", F.row_number().over(order).alias("ord"), row_key(F.col("episode_no"), F.col("kind"), F.col("jp")).alias("key"), "text", or_default(F.col("own"), shown).alias("source"), "speaker_name")
