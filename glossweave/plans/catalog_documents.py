"""Queries that run the extraction of every category, and story and merge operators, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract, merge, rollup, story
from .catalog import _ENTRIES, _STORIES, _entries, _stories, query, read

#: Columns of `part` that stand for the texts of a category's fields, in turn.
_COLUMNS = ["p_type", "p_brand", "p_name", "p_brand", "p_type", "p_name"]


def _text_sql(column: str, rule: str) -> str:
    """A source text: some are dashes where a rule reads these, some have blanks around them."""
    dash = "when p_partkey % 11 = 0 then '-' " if rule != extract.PLAIN else ""
    return f"case {dash}when p_partkey % 5 = 0 then ' ' || {column} || ' ' else {column} end"


def _other_sql(column: str) -> str:
    """The other edition's text: it repeats some texts."""
    return f"case when p_size % 7 = 0 then {column} else upper({column}) || '-' || cast(p_size as string) end"


def _documents(part: DataFrame, s: extract.Source, other: bool) -> DataFrame:
    key = "concat('u', cast(p_partkey as string))" if s.text_key else "cast(if(p_partkey % 3 = 0, 0, p_partkey) as bigint)" if s.spare_key else "cast(p_partkey as bigint)"
    if other:  # small parts have keys of their own there
        key = f"if(p_size > 10, {key}, " + ("concat('moved', cast(p_partkey as string)))" if s.text_key else "cast(p_partkey + 1000000000 as bigint))")
    cells = {s.key: key} | {member: _other_sql(c) if other else _text_sql(c, rule) for (_, member, rule), c in zip(s.fields, _COLUMNS, strict=False)}
    cells |= {s.spare_key: "cast(if(p_size > 10, p_partkey * 2, p_partkey + 2000000000) as bigint)" if other else "cast(p_partkey * 2 as bigint)"} if s.spare_key else {}
    cells |= {s.needs: "if(p_partkey % 4 = 0, '', 'x')"} if s.needs else {}
    doc = F.parse_json(F.to_json(F.struct(*(F.expr(sql).alias(name) for name, sql in cells.items()))))
    return part.select((F.col("p_partkey").cast("bigint") - 1).alias("ord"), doc.alias("doc"))


def _extract_sql(category: str) -> str:
    """Pairs and ids of a category: of equal keys the last text, and ids in the order of first sight."""
    parts = []
    for step, s in enumerate(extract.SPECS[category].sources):
        for sub, ((name, _, rule), c) in enumerate(zip(s.fields, _COLUMNS, strict=False)):
            jp = _text_sql(c, rule)
            jp = f"case when trim({jp}) = '-' then '' else {'trim(' + jp + ')' if rule == extract.SAFE else jp} end" if rule != extract.PLAIN else jp
            met = "p_size > 10" if s.text_key else "p_size > 10 and p_partkey <> 0"
            cn = f"case when {met} then {_other_sql(c)} else '' end" if s.two_sided else "''"
            ref = "'u' || p_partkey" if s.text_key else "cast(case when p_partkey % 3 = 0 then p_partkey * 2 else p_partkey end as string)" if s.spare_key else "cast(p_partkey as string)"
            where = "where p_partkey % 4 <> 0" if s.needs else ""
            raw = "true" if s.raw_pairs else "false"
            parts.append(f"select '{name}' field, {jp} jp, {cn} cn, {ref} ref, {step} * 1000000000000 + (p_partkey - 1) * 64 + {sub} ord, {raw} raw from part {where}")
    return f"""with r as ({" union all ".join(parts)}),
p as (select field, case when raw then jp else trim(jp) end k, case when raw then '' when trim(cn) = trim(jp) then '' else trim(cn) end cn, ord from r),
pair as (select field, k, arg_max(cn, ord) cn_text from p where k <> '' group by all),
seen as (select field, trim(jp) k, trim(ref) ref, min(ord) ord from r where trim(jp) <> '' and ref <> '0' group by all),
ids as (select field, k, array_to_string(list(ref order by ord), ',') ids from seen group by all)
select '{category}' category, coalesce(pair.field, ids.field) field, coalesce(pair.k, ids.k) jp_key, cn_text, ids from pair full join ids using (field, k)"""


def _extract(category: str):
    def run(spark, sf_dir):
        part = read(spark, sf_dir, "part")
        sources = extract.SPECS[category].sources
        pairs, traces = extract.extract(category, {s.file: _documents(part, s, False) for s in sources}, {s.file: _documents(part, s, True) for s in sources if s.two_sided})
        both = pairs.join(traces, ["category", "field", "jp_key"], "full")
        return both.select("category", "field", "jp_key", "cn_text", F.array_join("ids", ",").alias("ids"))

    run.__name__ = f"q_extract_{category.lower()}"
    return run


for _category in extract.SPECS:
    query(_extract_sql(_category))(_extract(_category))


@query(f"""with {_ENTRIES}, d as (select category, field, case when source = 'llm' then 'new ' else '' end || jp_key k, 'edit ' || jp_key t, 'human' s from e)
select e.category, e.field, e.jp_key, coalesce(t, cn_text) cn_text, coalesce(s, source) source, case when k is null then 'keep' when cn_text = t and source = s then 'noop' else 'ok' end as action from e left join d on d.category = e.category and d.field = e.field and d.k = e.jp_key
union all select category, field, k, t, s, 'ok' from d where k not in (select jp_key from e)""")
def q_edit_merge(spark, sf_dir):
    """Every entry edited, machine texts under a new key."""
    e = _entries(spark, sf_dir)
    key = F.concat(F.when(F.col("source") == "llm", "new ").otherwise(""), "jp_key").alias("jp_key")
    edits = e.select("category", "field", key, F.concat(F.lit("edit "), F.col("jp_key")).alias("cn_text"), F.lit("human").alias("source"), F.lit("editor").alias("updated_by"))
    return merge.edit_merge(e, edits, 5).select("category", "field", "jp_key", "cn_text", "source", "action")


@query(f"""with {_ENTRIES} select category, field, jp_key, cn_text, source from e where category <> 'events'
union all select 'events', 'new', jp_key, cn_text, source from e where category = 'music'
union all select category, field, jp_key, cn_text, source from e where category = 'events' and not exists (select 1 from e m where m.category = 'music')""")
def q_replace_category(spark, sf_dir):
    e = _entries(spark, sf_dir).select("category", "field", "jp_key", "cn_text", "source")
    new = e.where("category = 'music'").select(F.lit("events").alias("category"), F.lit("new").alias("field"), "jp_key", "cn_text", "source")
    return merge.replace_groups(e, new, "category")


@query(f"""with {_STORIES}, t as (select *, row_number() over (partition by event_id, episode_no order by position) - 1 as place from ln)
select event_id, episode_no, place as position, jp_key, cn_text, source, '' speaker_name from t""")
def q_store_story(spark, sf_dir):
    _, episodes, lines = _stories(spark, sf_dir)
    talk = lines.groupBy("event_id", "episode_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "jp_key", "cn_text", "source", "speaker_name"))), lambda t: F.struct(t["jp_key"].alias("jp_key"), t["cn_text"].alias("cn_text"), t["source"].alias("source"), t["speaker_name"].alias("speaker_name"))).alias("talk"))
    nested = episodes.join(talk, ["event_id", "episode_no"]).groupBy("event_id").agg(F.collect_list(F.struct("episode_no", "scenario_id", "title", "title_source", "talk")).alias("episodes"))
    stories = nested.select("event_id", F.lit("llm").alias("source"), F.lit("").alias("version"), F.lit(0).cast("bigint").alias("last_updated"), "episodes")
    return story.store_story(stories, 3)[2].select("event_id", "episode_no", "position", "jp_key", "cn_text", "source", "speaker_name")


@query(f"""with {_STORIES}, has as (select distinct event_id, episode_no from ln where cn_text <> '')
select event_id, episode_no, trim(title) title, 'unknown' title_source, row_number() over (partition by event_id order by episode_no) - 1 as position
from ep left join (select *, true h from has) using (event_id, episode_no) where h or trim(title) <> ''""")
def q_build_pending(spark, sf_dir):
    _, episodes, lines = _stories(spark, sf_dir)
    eps, _ = story.build_pending(episodes.select("event_id", "episode_no", "scenario_id", "title"), lines.where("cn_text <> ''"))
    return eps.select("event_id", "episode_no", "title", "title_source", "position")


@query(f"""with {_STORIES}, has as (select distinct event_id, episode_no from ln where cn_text <> ''),
b as (select event_id, episode_no, case when t.title is null or trim(t.title) = trim(ep.title) then '' else trim(t.title) end title
  from ep left join (select event_id, episode_no, upper(title) title from (select * replace (case when event_id % 2 = 0 then event_id else -1 - event_id end as event_id) from ep)) t using (event_id, episode_no))
select event_id, episode_no, title, 'cn' title_source, row_number() over (partition by event_id order by episode_no) - 1 as position
from b left join (select *, true h from has) using (event_id, episode_no) where h or title <> ''""")
def q_build_official(spark, sf_dir):
    _, episodes, lines = _stories(spark, sf_dir)
    ours = episodes.select("event_id", "episode_no", "scenario_id", "title")
    theirs = ours.withColumns({"event_id": F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(-1 - F.col("event_id")), "title": F.upper("title")})
    eps, _ = story.build_official(ours, theirs, lines.where("cn_text <> ''"))
    return eps.select("event_id", "episode_no", "title", "title_source", "position")


def _scenario_docs(spark, sf_dir, target: bool) -> DataFrame:
    """Conversations as scenarios: a turn is a line of its role; the other edition has a mark before each text and ends a turn earlier."""
    c = read(spark, sf_dir, "conversations")
    other = lambda c: F.concat(F.lit("T "), c) if target else F.col(c)
    talk = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", other("text").alias("Body"), other("role").alias("WindowDisplayName")))).alias("TalkData"))
    talk = talk.withColumn("TalkData", F.slice("TalkData", 1, F.size("TalkData") - 1)) if target else talk
    return talk.select(F.col("conv_id").alias("event_id"), F.lit("1").alias("episode_no"), F.parse_json(F.to_json(F.struct("TalkData"))).alias("doc"))


_PLACES = """c as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 pos, count(*) over (partition by conv_id) n, text, trim(text) body, role from conversations),
p as (select conv_id, pos * 2 ord, body jp, trim('T ' || text) cn, 'T ' || role speaker, role own, pos < n - 1 met from c union all select conv_id, pos * 2 + 1, role, 'T ' || role, '', '', pos < n - 1 from c)"""


@query(f"""with {_PLACES}, l as (select conv_id, jp, min(ord) first, arg_max(cn, ord) cn_text, coalesce(arg_max(speaker, ord) filter (speaker <> ''), '') speaker_name from p where met and jp <> '' and cn <> '' and jp <> cn group by all)
select conv_id event_id, jp jp_key, cn_text, speaker_name, row_number() over (partition by conv_id order by first) - 1 as position from l""")
def q_pair_scenarios(spark, sf_dir):
    lines = story.pair_scenarios(_scenario_docs(spark, sf_dir, False), _scenario_docs(spark, sf_dir, True))
    return lines.select("event_id", "jp_key", "cn_text", "speaker_name", "position")


@query(f"""with {_PLACES}, l as (select conv_id, jp, min(ord) first, coalesce(arg_max(own, ord) filter (own <> ''), '') speaker_name from p where jp <> '' group by all)
select conv_id event_id, jp jp_key, '' cn_text, speaker_name, row_number() over (partition by conv_id order by first) - 1 as position from l""")
def q_pending_lines(spark, sf_dir):
    return story.pending_lines(_scenario_docs(spark, sf_dir, False)).select("event_id", "jp_key", "cn_text", "speaker_name", "position")


@query(f"""with {_STORIES} select event_id, episode_no, jp_key, case when cn_text = '' then upper(jp_key) else cn_text end cn_text, case when cn_text = '' then 'llm' else source end source from ln""")
def q_apply_results(spark, sf_dir):
    _, episodes, lines = _stories(spark, sf_dir)
    results = story.untranslated_targets(episodes, lines).withColumn("cn_text", F.upper("jp"))
    return story.apply_results(episodes, lines, results)[1].select("event_id", "episode_no", "jp_key", "cn_text", "source")


@query(f"""with {_STORIES}, st as (select event_id, source like 'official%' or source in ('human', 'pinned')
  or event_id in (select event_id from ln where source in ('human', 'pinned') union select event_id from ep where title_source in ('human', 'pinned')) kept from s),
c as (select conv_id event_id, bool_or(role = 'assistant') and bool_or(role = 'user') there, max(turn) >= 3 talk, conv_id % 11 = 0 failed from conversations group by conv_id)
select event_id, case when kept then 'keep' when not there then 'miss' when failed then 'error' when talk then 'found' else 'miss' end outcome from c join st using (event_id)""")
def q_availability(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("event_id", F.col("conv_id"))
    built = c.groupBy("event_id").agg((F.max("turn") >= 3).alias("has_talk")).withColumn("failed", F.col("event_id") % 11 == 0)
    states = rollup.sync_states(*_stories(spark, sf_dir))
    return story.availability(states, c, c.where("role = 'assistant'"), c.where("role = 'user'"), built)


@query("""with x as (select event_id, event_type = 'error' e from events), y as (select *, sum(case when not e then 1 else 0 end) over (order by event_id) g from x),
z as (select event_id, e, sum(case when e then 1 else 0 end) over (partition by g order by event_id) st from y), w as (select min(event_id) stop_id from z where e and st >= 3)
select distinct event_id from events, w where event_id not in (select doc_id from documents) and stop_id is not null
  and event_id > greatest((select max(doc_id) from documents), coalesce((select max(event_id) from z where not e and event_id <= stop_id), 0))""")
def q_fallback_events(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    checks = events.select("event_id", F.when(F.col("event_type") == "error", "miss").otherwise("found").alias("outcome"))
    stored = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"))
    return story.fallback_events(events, stored, story.walk_streak(checks, 0))
