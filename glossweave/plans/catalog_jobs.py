"""Queries that run whole jobs over the driver's tables, in a shared folder: commits, fills, the story walk, streams and published files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import arrays, text
from ..operators import entries as entry_ops
from ..operators import extract, merge, rollup, search_index, story
from ..sources import export, readers, scratch, transport
from ..sources.snapshot import SnapshotTable
from ..streaming import refresh
from . import gaps, waves
from . import stories as jobs
from .catalog import _ENTRIES, _STORIES, _entries, _stories, query, read


def _story_tables(spark: SparkSession, sf_dir: str, partition: str | None = None, buckets: int | None = None) -> jobs.Tables:
    """The stories of the driver's conversations, stored."""
    top = scratch.folder(spark, "stories")
    made = jobs.Tables(*(SnapshotTable(spark, f"{top}/{n}", schema, partition, buckets) for n, schema in (("s", model.STORIES), ("p", model.EPISODES), ("l", model.LINES))))
    for table, rows in zip((made.stories, made.episodes, made.lines), _stories(spark, sf_dir), strict=True):
        table.write(rows)
    return made


# --- commits


@query(f"with {_ENTRIES} select category, field, jp_key, case when category = 'events' then upper(cn_text) else cn_text end cn_text, source from e where category <> 'music'")
def q_replace_partition(spark, sf_dir):
    """One partition rewritten and one emptied, each by a commit of its own; the third keeps its files."""
    table = SnapshotTable(spark, scratch.folder(spark, "entries"), model.ENTRIES, "category")
    table.write(_entries(spark, sf_dir))
    table.replace(readers.stored(table, "events").withColumn("cn_text", F.upper("cn_text")))
    table.replace(table.read(parts=[]), ["pmusic"])
    return table.read().select("category", "field", "jp_key", "cn_text", "source")


@query(f"with {_ENTRIES} select category, field, jp_key, cn_text, source from e")
def q_old_version(spark, sf_dir):
    """The first version of a table, read after two more were committed."""
    table = SnapshotTable(spark, scratch.folder(spark, "entries"), model.ENTRIES, "category", 8)
    table.write(_entries(spark, sf_dir))
    table.write(table.read().withColumn("cn_text", F.lit("")))
    table.replace(table.read().where("category = 'cards'"))
    return table.read(version=1).select("category", "field", "jp_key", "cn_text", "source")


# --- fills


def _upper(texts: list[str]) -> list[str]:
    return [t.upper() for t in texts]


_FILLED = f"""{_STORIES}, machine as (select event_id from s where source in ('llm', 'jp_pending'))"""


@query(f"""with {_FILLED} select event_id, episode_no, jp_key, case when m.event_id is not null and cn_text = '' then upper(jp_key) else cn_text end cn_text, case when m.event_id is not null and cn_text = '' then 'llm' else source end source
from ln left join machine m using (event_id)""")
def q_fill_stories(spark, sf_dir):
    """All stories that neither an edition nor a person owns, filled in logged batches."""
    t = _story_tables(spark, sf_dir, "event_id", 8)
    gaps.fill_stories(t.stories, t.episodes, t.lines, _upper, 5, settings=waves.Settings(groups=1 << 20, span=1 << 20))
    return t.lines.read().select("event_id", "episode_no", "jp_key", "cn_text", "source")


@query(f"""with {_FILLED}, c as (select event_id, (select count(*) from ln where ln.event_id = m.event_id and cn_text = '') + (select count(*) from ep where ep.event_id = m.event_id and title <> '' and title_source in ('', 'unknown', 'jp_pending')) n from machine m)
select cast(count(*) filter (n > 0) as bigint) stories, cast(sum(n) as bigint) candidates, cast(sum(n) as bigint) translated, cast(0 as bigint) skipped, cast(0 as bigint) errors from c""")
def q_fill_totals(spark, sf_dir):
    t = _story_tables(spark, sf_dir)
    totals = gaps.fill_stories(t.stories, t.episodes, t.lines, _upper, 5, settings=waves.Settings(groups=1 << 20, span=1 << 20))
    return spark.createDataFrame([tuple(totals[k] for k in ("stories", "candidates", "translated", "skipped", "errors"))], "stories bigint, candidates bigint, translated bigint, skipped bigint, errors bigint")


@query(f"""with {_ENTRIES}, c as (select *, row_number() over (partition by category, field order by jp_key) r from e where source in ('llm', 'unknown') and cn_text = ''),
f as (select category, field, jp_key from c where r <= 3)
select category, field, jp_key, case when f.jp_key is not null then upper(jp_key) else cn_text end cn_text, case when f.jp_key is not null then 'llm' else source end source from e left join (select *, jp_key k from f) f using (category, field, jp_key)""")
def q_fill_entries(spark, sf_dir):
    """The first three candidates of each field, filled."""
    table = SnapshotTable(spark, scratch.folder(spark, "entries"), model.ENTRIES, "category")
    table.write(_entries(spark, sf_dir))
    gaps.fill_entries(table, _upper, 5, limit=3)
    return table.read().select("category", "field", "jp_key", "cn_text", "source")


# --- the story walk, over a transport


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """List documents of both editions and ids of the target's events: conversations are stories of one episode, whose scenario is named by their turns; the target has those of four turns or more."""
    turns = read(spark, sf_dir, "conversations").groupBy((F.col("conv_id") + 1).alias("i")).agg(F.max("turn").alias("n"))
    episode = F.struct(F.lit(1).alias("episodeNo"), F.concat(F.lit("turns"), F.col("n").cast("string")).alias("scenarioId"), F.concat(F.lit("t"), F.col("i").cast("string")).alias("title"))
    doc = F.parse_json(F.to_json(F.struct(F.col("i").alias("eventId"), F.lit("a").alias("assetbundleName"), F.array(episode).alias("eventStoryEpisodes"))))
    rows = turns.select("i", "n", F.col("i").alias("ord"), doc.alias("doc"))
    theirs = rows.where("n >= 4")
    return rows.select("ord", "doc"), theirs.select("ord", "doc"), theirs.select(F.col("i").alias("event_id"))


def _scenario(url: str) -> str:
    """A transport that makes up a scenario from its address; the target's scenarios of seven turns are lost."""
    edition, scenario, event = url.split("/")
    if (edition, scenario) == ("target", "turns7"):
        raise OSError("http 404")
    body = lambda t: t.upper() if edition == "target" else t
    return json.dumps({"TalkData": [{"Body": body(f"line of {event}"), "WindowDisplayName": body("name")}]})


@query("""with o as (select conv_id + 1 i, case when max(turn) < 4 then 'miss' when max(turn) = 7 then 'error' else 'found' end o from conversations group by conv_id),
x as (select *, sum(case when o = 'found' then 1 else 0 end) over (order by i) g from o), y as (select *, sum(case when o = 'miss' then 1 else 0 end) over (partition by g order by i) st from x),
stop as (select min(i) s from y where o = 'miss' and st >= 3), last as (select coalesce(max(i), 0) m from o, stop where o = 'found' and i <= s), r as (select i, o = 'found' and (s is null or i <= s) official, s is not null and i > m late from o, stop, last)
select i event_id, case when official then 'official_cn' else 'jp_pending' end source, case when official then 'LINE OF ' || i else '' end line from r where official or late""")
def q_walk_stories(spark, sf_dir):
    """Stories synced in waves from a transport, until three in a row are missing; newer ones wait for a translation."""
    spark.dataSource.register(transport.source("glossweave_scenarios", _scenario, transport.whole_talk, again=0))
    top = scratch.folder(spark, "walk")
    t = jobs.Tables(*(SnapshotTable(spark, f"{top}/{n}", schema) for n, schema in (("s", model.STORIES), ("p", model.EPISODES), ("l", model.LINES))))
    fetch = transport.scenario_fetch(spark, "glossweave_scenarios", lambda edition, event, scenario: [f"{edition}/{scenario}/{event}"], 8)
    jobs.walk_stories(t, *_lists(spark, sf_dir), fetch, 5, wave=1024)
    first = t.lines.read().where("jp_key like 'line%'").select("event_id", F.col("cn_text").alias("line"))
    return t.stories.read().select("event_id", "source").join(first, "event_id")


def _turned(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """Scenarios of both roles of a conversation, whose lines come in the opposite order."""
    talk = F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("at"), F.expr(body).alias("Body"))))
    rows = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("event_id"), F.col("role").alias("episode_no")).agg(talk.alias("TalkData"))
    return rows.select("event_id", "episode_no", F.parse_json(F.to_json(F.struct("TalkData"))).alias("doc"))


@query(f"""with {_STORIES} select event_id, episode_no, jp_key, row_number() over (partition by event_id, episode_no order by position desc) - 1 as position from ln""")
def q_reorder_job(spark, sf_dir):
    """All stored lines in the order of a source edition that says them from last to first."""
    t = _story_tables(spark, sf_dir, "event_id", 4)
    jobs.reorder_stories(t, _turned(spark, sf_dir, "concat('t', cast(turn as string))"))
    return t.lines.read().select("event_id", "episode_no", "jp_key", F.col("position").cast("bigint").alias("position"))


# --- streams


@query("""with x as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) p from events)
select event_id, event_type as version, p previous from x where p is not null and p <> event_type""")
def q_version_change_stream(spark, sf_dir):
    """The rows of q_version_change, from a stream of files in several batches, with a value of state for each source."""
    top = scratch.folder(spark, "polls")
    polls = read(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("polled_at"), F.col("event_type").alias("version"))
    at = polls.agg(F.percentile_approx("polled_at", [0.25, 0.5, 0.75]).alias("q"), F.max("polled_at").alias("m"), F.min("polled_at").alias("n")).first()
    bounds = [at.n - 1, *sorted(set(at.q)), at.m] if at.q else []
    for low, high in zip(bounds, bounds[1:], strict=False):  # four files at most, in the order of their polls
        polls.where((F.col("polled_at") > low) & (F.col("polled_at") <= high)).coalesce(1).write.mode("append").parquet(f"{top}/in")
    if not bounds:
        polls.write.parquet(f"{top}/in")
    stream = spark.readStream.schema(polls.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    changes = refresh.version_changes_stream(stream)
    changes.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{top}/out").select(F.col("polled_at").alias("event_id"), "version", "previous")


# --- published files


_JSON = "replace(replace(replace(replace(replace({0}, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e'), chr(8232), '\\u2028'), chr(8233), '\\u2029')"


def _json(x: str, html: bool = True) -> str:
    """SQL of a text as a JSON string."""
    return _JSON.format(f"cast(to_json({x}) as varchar)") if html else f"replace(replace(cast(to_json({x}) as varchar), chr(8232), '\\u2028'), chr(8233), '\\u2029')"


@query(f"""with {_ENTRIES}, r as (select category, field, '    ' || {_json("jp_key")} || ': ' k, jp_key, {_json("cn_text")} t, source, ids[1] id from e),
f as (select category, field, '  ' || {_json("field")} || ': {{' || chr(10) || string_agg(k || t, ',' || chr(10) order by encode(jp_key)) || chr(10) || '  }}' flat,
  '  ' || {_json("field")} || ': {{' || chr(10) || string_agg(k || '{{' || chr(10) || '      "text": ' || t || ',' || chr(10) || '      "source": "' || source || '",' || chr(10) || '      "ids": [' || chr(10) || '        "' || id || '"' || chr(10) || '      ]' || chr(10) || '    }}', ',' || chr(10) order by encode(jp_key)) || chr(10) || '  }}' whole from r group by category, field),
g as (select category, '{{' || chr(10) || string_agg(flat, ',' || chr(10) order by encode(field)) || chr(10) || '}}' flat, '{{' || chr(10) || string_agg(whole, ',' || chr(10) order by encode(field)) || chr(10) || '}}' whole from f group by category),
n as (select unnest({model.CATEGORIES}) category)
select 'translation/' || category || '.json' path, md5(coalesce(flat, '{{}}')) digest from n left join g using (category) union all select 'translation/' || category || '.full.json', md5(coalesce(whole, '{{}}')) from n left join g using (category)""")
def q_category_files(spark, sf_dir):
    return export.category_files(_entries(spark, sf_dir)).select("path", F.md5("body").alias("digest"))


@query(f"""with {_STORIES}, t as (select event_id, episode_no, string_agg('        ' || {_json("jp_key", False)} || ': ' || {_json("cn_text", False)}, ',' || chr(10) order by position, jp_key) talk from ln group by all),
p as (select event_id, string_agg('    ' || {_json("episode_no", False)} || ': {{' || chr(10) || '      "scenarioId": "s",' || chr(10) || '      "title": ' || {_json("title", False)} || ',' || chr(10) || '      "talkData": {{' || chr(10) || talk || chr(10) || '      }}' || chr(10) || '    }}', ',' || chr(10) order by position, episode_no) eps from ep join t using (event_id, episode_no) group by event_id)
select 'translation/eventStory/event_' || event_id || '.json' path, md5('{{' || chr(10) || '  "meta": {{' || chr(10) || '    "source": "' || source || '",' || chr(10) || '    "version": "1.0",' || chr(10) || '    "last_updated": 0' || chr(10) || '  }},' || chr(10) || '  "episodes": {{' || chr(10) || eps || chr(10) || '  }}' || chr(10) || '}}') digest from s join p using (event_id)""")
def q_story_files(spark, sf_dir):
    return export.story_files(story.ordered_detail(*_stories(spark, sf_dir))).select("path", F.md5("body").alias("digest"))


def _names(rows: DataFrame, id_: str, name: str, c: str | None = None) -> DataFrame:
    """(ord, doc) of documents with an id, a name under two members, and a character."""
    cells = [F.col(id_).alias("id"), F.col(name).alias("name"), F.col(name).alias("prefix"), *([F.col(c).alias("characterId")] if c else [])]
    return rows.select(F.col(id_).cast("bigint").alias("ord"), F.parse_json(F.to_json(F.struct(*cells))).alias("doc"))


@query(f"""with {_ENTRIES}, named as (select jp_key, cn_text from e where category = 'cards' and field = 'prefix'),
r as (select 2 part, p_partkey id, case when p_partkey % 3 = 0 then 'k' || p_partkey else p_name end n, 'cards' g, nullif(p_size - 25, 0) c from part union all select 6, s_suppkey, case when s_suppkey % 4 = 0 then '-' else s_name end, 'costumes', null from supplier),
st as (select 'k' || p_partkey jp_key, case when p_partkey % 4 = 0 then '' else p_name end cn_text from part)
select cast(part as int) part, cast(id as bigint) id, n, g, cast(c as bigint) c, case when g = 'cards' then nullif(nullif(cn_text, ''), n) end cn from r left join st on g = 'cards' and st.jp_key = n where not (g = 'costumes' and n = '-')""")
def q_index_rows(spark, sf_dir):
    """Names of parts as cards and of suppliers as costumes, with the stored texts of card names."""
    part, supplier = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    key = F.concat(F.lit("k"), F.col("p_partkey").cast("string"))
    cards = _names(part.withColumns({"n": F.when(F.col("p_partkey") % 3 == 0, key).otherwise(F.col("p_name")), "c": F.col("p_size") - 25}), "p_partkey", "n", "c")
    costumes = _names(supplier.withColumn("n", F.when(F.col("s_suppkey") % 4 == 0, "-").otherwise(F.col("s_name"))), "s_suppkey", "n")
    stored = _entries(spark, sf_dir).withColumns({"category": F.lit("cards"), "field": F.lit("prefix")})
    return search_index.index_rows({"cards": cards, "costumes": costumes}, stored).select("part", "id", "n", "g", "c", "cn")


# --- edits, order and totals


@query(f"""with {_ENTRIES}, tag as (select 'k' || p_size jp_key, max(upper(p_name)) cn_text from part group by 1), m as (select 'flavorText' field, jp_key, cn_text, source from e union all select 'tag', jp_key, cn_text, 'human' from tag)
select m.field, m.jp_key, case when t.cn_text is not null then t.cn_text else m.cn_text end cn_text, case when t.cn_text is not null then 'human' else m.source end source, t.cn_text is not null and (t.cn_text <> m.cn_text or m.source <> 'human') copied from m left join tag t on m.field = 'flavorText' and t.jp_key = m.jp_key""")
def q_copy_field(spark, sf_dir):
    """Texts of tags, one for each size of part, copied onto flavour texts of equal key."""
    e = _entries(spark, sf_dir).withColumns({"category": F.lit("mysekai"), "field": F.lit("flavorText"), "action": F.lit("keep")})
    tags = read(spark, sf_dir, "part").groupBy(F.concat(F.lit("k"), F.col("p_size").cast("string")).alias("jp_key")).agg(F.max(F.upper("p_name")).alias("cn_text"))
    none = F.array().cast("array<string>")
    tags = tags.select(F.lit("mysekai").alias("category"), F.lit("tag").alias("field"), "jp_key", "cn_text", F.lit("human").alias("source"), none.alias("ids"), F.lit(0).cast("bigint").alias("updated_at"), F.lit("x").alias("updated_by"), F.lit("keep").alias("action"))
    return merge.copy_field(e.unionByName(tags)).select("field", "jp_key", "cn_text", "source", "copied")


@query(f"""with {_STORIES}, one as (select max(event_id) i from s)
select event_id, case when event_id = i then 'human' else source end source, cast(case when event_id = i then 9 else 0 end as bigint) last_updated, (select count(*) from ln where ln.event_id = s.event_id and (source = 'human' or s.event_id = i)) human_lines from s, one""")
def q_promote(spark, sf_dir):
    stories, episodes, lines = _stories(spark, sf_dir)
    heads, _, talk = story.promote(stories, episodes, lines, stories.agg(F.max("event_id")).first()[0], 9)
    n = talk.groupBy("event_id").agg(F.count_if(F.col("source") == "human").alias("human_lines"))
    return heads.join(n, "event_id", "left").select("event_id", "source", "last_updated", F.coalesce("human_lines", F.lit(0).cast("bigint")).alias("human_lines"))


@query(f"""with {_STORIES}, one as (select max(event_id) i from ln), f as (select min(episode_no) n from ln, one where event_id = i), k as (select min(jp_key) k from ln, one, f where event_id = i and episode_no = n)
select event_id, episode_no, jp_key, case when event_id = i and episode_no = n and jp_key = k then 'edited' else cn_text end cn_text, case when event_id = i and episode_no = n and jp_key = k then 'human' else source end source from ln, one, f, k""")
def q_edit_line(spark, sf_dir):
    _, episodes, lines = _stories(spark, sf_dir)
    last = lines.orderBy(F.desc("event_id"), "episode_no", "jp_key").first()
    edited = story.edit_line(episodes, lines, last.event_id, last.episode_no, "edited", "", last.jp_key)[1]
    return edited.select("event_id", "episode_no", "jp_key", "cn_text", "source")


@query(f"""with {_STORIES}, l as (select event_id, (select count(*) from ln where ln.event_id = s.event_id and cn_text = '') + (select count(*) from ep where ep.event_id = s.event_id and title <> '' and title_source in ('', 'unknown', 'jp_pending')) n from s)
select event_id, case when n = 0 then 'llm' else 'jp_pending' end source, cast(3 as bigint) last_updated from l""")
def q_set_source(spark, sf_dir):
    """Every story told by whether anything is left in it."""
    return story.set_source(*_stories(spark, sf_dir), 3).select("event_id", "source", "last_updated")


@query("""with r as (select o_custkey, count(*) candidates, count(*) filter (o_orderstatus = 'F') translated, count(*) filter (o_orderstatus <> 'F') skipped, max(case when o_orderstatus = 'P' then 'x' else '' end) error from orders group by all)
select count(*) filter (translated > 0) stories, cast(sum(candidates) as bigint) candidates, cast(sum(translated) as bigint) translated, cast(sum(skipped) as bigint) skipped, count(*) filter (error <> '') errors from r""")
def q_run_totals(spark, sf_dir):
    status = F.col("o_orderstatus")
    one = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("event_id")).agg(F.count("*").alias("candidates"), F.count_if(status == "F").alias("translated"), F.count_if(status != "F").alias("skipped"), F.max(F.when(status == "P", "x").otherwise("")).alias("error"))
    return rollup.run_totals(one)


@query("""select p_brand category, count(*) as rows, count(*) filter (p_partkey % 3 = 0) recovered from part group by 1""")
def q_recovery_report(spark, sf_dir):
    """Full documents of a file for each brand, every third value in the notation of another language, read back."""
    p = read(spark, sf_dir, "part")
    key = F.concat(F.lit("k"), F.col("p_partkey").cast("string"))
    well = F.struct(F.col("p_name").alias("text"), F.lit("cn").alias("source"), F.array(F.col("p_partkey").cast("string")).alias("ids"))
    odd = F.concat(F.lit("{'text': '"), F.col("p_name"), F.lit("', 'source': 'cn', 'ids': ['"), F.col("p_partkey").cast("string"), F.lit("']}"))
    value = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.array(odd))).otherwise(F.to_json(F.array(well)))
    value = F.expr("substr(v, 2, length(v) - 2)")
    rows = p.withColumn("v", F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.array(odd))).otherwise(F.to_json(F.array(well)))).select("p_brand", "p_name", key.alias("k"), value.alias("v"))
    files = rows.groupBy("p_brand").agg(F.concat(F.lit('{"f": {'), F.array_join(F.collect_list(F.concat(F.lit('"'), "k", F.lit('": '), "v")), ","), F.lit("}}")).alias("value")).select(F.concat("p_brand", F.lit(".full.json")).alias("name"), "value")
    flat = rows.select(F.col("p_brand").alias("category"), F.lit("f").alias("field"), F.col("k").alias("jp_key"), F.col("p_name").alias("text"))
    return readers.recovery_report(readers.full_rows(files, flat))


@query("""with k as (select conv_id, list(distinct role order by role) keys, list(role order by turn desc) seen from conversations group by conv_id), o as (select conv_id, array_agg(role order by t desc) ord from (select conv_id, role, max(turn) t from conversations where turn > 1 group by all) group by conv_id)
select conv_id, array_to_string(list_concat(list_filter(coalesce(ord, []), lambda x: list_contains(keys, x)), list_filter(keys, lambda x: not list_contains(coalesce(ord, []), x))), ',') keys from k left join o using (conv_id)""")
def q_ordered_keys(spark, sf_dir):
    """Roles of a conversation: those of later turns in the order of their last one, then the others."""
    c = read(spark, sf_dir, "conversations")
    keys = c.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("keys"))
    last = c.where("turn > 1").groupBy("conv_id", "role").agg(F.max("turn").alias("t"))
    order = last.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("t")).alias("t"), "role"))), lambda s: s["role"]).alias("o"))
    none = F.array().cast("array<string>")
    return keys.join(order, "conv_id", "left").select("conv_id", F.array_join(arrays.ordered_keys(F.coalesce("o", none), F.col("keys")), ",").alias("keys"))


_LOCALE = "translate(p_name, 'aeou', 'áéあ漢') || ' ' || p_partkey % 100"


@query(f"""with k as (select p_partkey, {_LOCALE} k from part)
select p_partkey, dense_rank() over (order by regexp_replace(k, '([0-9]+)$', '') collate en, cast(regexp_extract(k, '([0-9]+)$', 1) as int)) place from k""")
def q_locale_order(spark, sf_dir):
    """Names with accented, kana and kanji letters and a number at their end, in the order of the Unicode collation."""
    from pyspark.sql import Window

    key = F.concat(F.translate("p_name", "aeou", "áéあ漢"), F.lit(" "), (F.col("p_partkey") % 100).cast("string"))
    rows = read(spark, sf_dir, "part").select("p_partkey", text.natural_key(key).alias("k"))
    # Places of distinct keys by range: as many tasks as there are, not one window.
    distinct = rows.select("k").distinct().repartitionByRange(8, "k").withColumn("part", F.spark_partition_id())
    own = distinct.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("k"))).persist()
    before = {r.part: r.n for r in own.groupBy("part").agg(F.count("*").alias("n")).collect()}
    shift = spark.createDataFrame([(p, sum(n for q, n in before.items() if q < p)) for p in before], "part int, shift bigint")
    places = own.join(F.broadcast(shift), "part").select("k", (F.col("n") + F.col("shift")).alias("place"))
    return rows.join(places, "k").select("p_partkey", "place")


@query("""select p_partkey, case p_partkey % 4 when 0 then 'https://site/cards/' || p_partkey || '/' when 1 then 'https://site/live/' || p_partkey || '/' when 2 then 'https://site/eventstory/' || p_brand || '/' end link from part""")
def q_link(spark, sf_dir):
    k = F.col("p_partkey")
    category = F.element_at(F.array(*map(F.lit, ["cards", "virtualLive", "eventStory", "skills"])), (k % 4 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", text.link(category, F.col("p_brand"), F.array(k.cast("string")), "https://site/").alias("link"))


# --- second editions of whole tables, without subsets of ids


def _as_stories(part: DataFrame, upper: bool) -> DataFrame:
    return part.select((F.col("p_partkey") - 1).alias("ord"), F.parse_json(F.to_json(F.struct(F.col("p_partkey").alias("id"), (F.upper("p_name") if upper else F.col("p_name")).alias("name")))).alias("doc"))


@query("""with p as (select p_partkey, p_name, case when p_retailprice > 1200 then p_partkey + 1000000 else p_partkey end k from part), l as (select p_name jp, arg_max(coalesce(u.cn, ''), p.p_partkey) cn from p left join (select k, max(upper(p_name)) cn from p group by k) u on u.k = p.p_partkey group by p_name)
select jp jp_key, case when cn = jp then '' else cn end cn_text from l""")
def q_extract_moved_keys(spark, sf_dir):
    """Names of one edition paired with the other's, of which dear parts have other keys."""
    part = read(spark, sf_dir, "part")
    moved = part.withColumn("p_partkey", F.when(F.col("p_retailprice") > 1200, F.col("p_partkey") + 1000000).otherwise(F.col("p_partkey")))
    pairs, _ = extract.extract("events", {"events": _as_stories(part, False)}, {"events": _as_stories(moved, True)})
    return pairs.select("jp_key", "cn_text")


@query(f"""with {_ENTRIES}, d as (select category, field, jp_key, case when cn_text = '' then 'said ' || jp_key else cn_text end t, case when cn_text = '' then 'human' else source end s, cn_text, source from e)
select category, field, jp_key, t cn_text, s source, case when t = cn_text and s = source then 'noop' else 'ok' end as action from d""")
def q_edit_all(spark, sf_dir):
    """Every entry edited: blank ones by a person, the others as they were."""
    e = _entries(spark, sf_dir)
    blank = F.col("cn_text") == ""
    edits = e.select("category", "field", "jp_key", F.when(blank, F.concat(F.lit("said "), "jp_key")).otherwise(F.col("cn_text")).alias("cn_text"), F.when(blank, "human").otherwise(F.col("source")).alias("source"), F.lit("editor").alias("updated_by"))
    return merge.edit_merge(e, edits, 5).select("category", "field", "jp_key", "cn_text", "source", "action")


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus = 'F' and o_orderpriority = '2-HIGH'")
def q_select_orders(spark, sf_dir):
    """Orders as entries, selected by category and field."""
    category = F.when(F.col("o_orderstatus") == "F", "cards").otherwise("events")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", category.alias("category"), F.col("o_orderpriority").alias("field"), F.lit("cn").alias("source"))
    return entry_ops.select_entries(rows, "cards", "2-HIGH", "cn").select("o_orderkey", "o_orderstatus", F.col("field").alias("o_orderpriority"))
