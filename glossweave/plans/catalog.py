"""Queries over the driver's tables, one or more for each operator shape, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, documents, text
from ..operators import entries as entry_ops
from ..operators import fill, merge, rollup, search_index, story, verify
from ..streaming import refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stored entries: a category and field of the type, the key of the number, a text and a source by rule."""
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    source = F.element_at(F.array(*map(F.lit, ["cn", "human", "pinned", "llm", "unknown"])), (k % 5 + 1).cast("int"))
    return part.select(
        F.element_at(F.array(*map(F.lit, ["cards", "events", "music"])), (k % 3 + 1).cast("int")).alias("category"), F.col("p_brand").alias("field"), F.concat(F.lit("k"), k.cast("string")).alias("jp_key"),
        F.when(k % 4 == 0, "").otherwise(F.col("p_name")).alias("cn_text"), source.alias("source"), F.array(k.cast("string")).alias("ids"), F.lit(0).cast("bigint").alias("updated_at"), F.lit("seed").alias("updated_by"),
    )


#: The same entries in SQL.
_ENTRIES = """e as (select ['cards', 'events', 'music'][cast(p_partkey % 3 + 1 as int)] category, p_brand field, 'k' || p_partkey jp_key,
  case when p_partkey % 4 = 0 then '' else p_name end cn_text, ['cn', 'human', 'pinned', 'llm', 'unknown'][cast(p_partkey % 5 + 1 as int)] source,
  [cast(p_partkey as varchar)] ids, p_partkey from part)"""


def _stories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as stories: a conversation is a story, its role an episode, a turn a line."""
    c = read(spark, sf_dir, "conversations")
    source = F.element_at(F.array(*map(F.lit, ["official_cn", "llm", "human", "jp_pending"])), (F.col("conv_id") % 4 + 1).cast("int"))
    stories = c.select("conv_id").distinct().select(F.col("conv_id").alias("event_id"), source.alias("source"), F.lit("1.0").alias("version"), F.lit(0).cast("bigint").alias("last_updated"))
    episodes = c.groupBy("conv_id", "role").agg(F.min("turn").alias("first")).select(F.col("conv_id").alias("event_id"), F.col("role").alias("episode_no"), F.lit("s").alias("scenario_id"), F.when(F.col("first") % 2 == 0, F.col("role")).otherwise("").alias("title"), F.when(F.col("conv_id") % 3 == 0, "unknown").otherwise("cn").alias("title_source"), F.col("first").cast("int").alias("position"))
    lines = c.select(F.col("conv_id").alias("event_id"), F.col("role").alias("episode_no"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("jp_key"), F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("text")).alias("cn_text"), F.when((F.col("turn") == 2) & (F.col("conv_id") % 7 == 0), "pinned").otherwise("cn").alias("source"), F.lit("").alias("speaker_name"), F.col("turn").cast("int").alias("position"))
    return stories, episodes, lines


_STORIES = """s as (select distinct conv_id event_id, ['official_cn', 'llm', 'human', 'jp_pending'][cast(conv_id % 4 + 1 as int)] source from conversations),
ep as (select conv_id event_id, role episode_no, case when min(turn) % 2 = 0 then role else '' end title, case when conv_id % 3 = 0 then 'unknown' else 'cn' end title_source, min(turn) as position
  from conversations group by conv_id, role),
ln as (select conv_id event_id, role episode_no, 't' || turn jp_key, case when turn % 3 = 1 then '' else text end cn_text,
  case when turn = 2 and conv_id % 7 = 0 then 'pinned' else 'cn' end source, turn as position from conversations)"""


# --- counts


@query("""
select lang, source, count(*) total, count(*) filter (n_chars < 1000) short_rows, count(*) filter (n_chars >= 1000) long_rows
from documents group by lang, source""")
def q_source_rollup(spark, sf_dir):
    n = F.col("n_chars")
    rows = read(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.col("source").alias("field"), F.when(n < 1000, "llm").when(n >= 1000, "cn").alias("source"))
    return rollup.field_counts(rows).select(F.col("category").alias("lang"), F.col("field").alias("source"), "total", F.col("llm_count").alias("short_rows"), F.col("cn_count").alias("long_rows"))


@query(f"with {_ENTRIES} select category, field, source, count(*) n from e group by all")
def q_source_counts(spark, sf_dir):
    return rollup.source_counts(_entries(spark, sf_dir))


@query(f"""with {_ENTRIES} select category, field, count(*) total, count(*) filter (source = 'cn') cn_count, count(*) filter (source = 'human') human_count,
  count(*) filter (source = 'pinned') pinned_count, count(*) filter (source = 'llm') llm_count, count(*) filter (source not in ('cn', 'human', 'pinned', 'llm')) unknown_count,
  count(*) filter (source not in ('cn', 'human', 'pinned')) pending from e group by all""")
def q_field_counts(spark, sf_dir):
    return rollup.pending_work(rollup.field_counts(_entries(spark, sf_dir)))


@query(f"""with {_ENTRIES}, f as (select category, field, count(*) total, count(*) filter (source = 'llm') l from e group by all)
select case category when 'cards' then 0 when 'events' then 2 else 4 end as ordinal, category, string_agg(field || ':' || total || ':' || l, ',' order by field) fields from f group by category""")
def q_category_info(spark, sf_dir):
    info = rollup.category_info(_entries(spark, sf_dir))
    return info.select("ordinal", "category", F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["total"].cast("string"), f["llm_count"].cast("string"))), ",").alias("fields"))


@query("""select lang, string_agg(source || '=' || n, ';' order by source) sources from (select lang, source, count(*) n from documents group by all) group by lang""")
def q_field_nested(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.col("source").alias("field"), F.lit("cn").alias("source"))
    langs = [r.category for r in rows.select("category").distinct().collect()]  # a row a language
    info = rollup.category_info(rows, langs)
    return info.select(F.col("category").alias("lang"), F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["total"].cast("string"))), ";").alias("sources"))


@query("""select max(o_orderkey) max_id, max(case when o_orderstatus = 'F' then o_orderkey end) latest_f, min(case when o_orderstatus = 'P' then o_orderkey end) first_p from orders""")
def q_bounds(spark, sf_dir):
    status = F.col("o_orderstatus")
    states = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), (status == "F").alias("is_official"), (status == "P").alias("is_llm"))
    return rollup.sync_bounds(states).select("max_id", F.col("latest_official").alias("latest_f"), F.col("first_llm").alias("first_p"))


@query("""select c_custkey, (select count(*) from orders o where o.o_custkey = c.c_custkey) n,
  (select count(*) from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P') + (select count(*) from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT') u from customer c""")
def q_correlated_counts(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("event_id", F.col("o_custkey"))
    episodes = o.select("event_id", F.lit("t").alias("title"), F.when(F.col("o_orderpriority") == "1-URGENT", "unknown").otherwise("cn").alias("title_source"))
    lines = o.select("event_id", F.when(F.col("o_orderstatus") == "P", "").otherwise("there").alias("cn_text"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), F.lit("").alias("source"), F.lit(0).alias("last_updated"))
    return rollup.story_summaries(customers, episodes, lines).select(F.col("event_id").alias("c_custkey"), F.col("episode_count").alias("n"), F.col("untranslated_count").alias("u"))


# --- filters and projections


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT'")
def q_entry_filter(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"))
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(f"with {_ENTRIES} select category, field, jp_key, cn_text, source from e where category = 'cards' and field = 'Brand#11' and source = 'cn'")
def q_select_entries(spark, sf_dir):
    return entry_ops.select_entries(_entries(spark, sf_dir), "cards", "Brand#11", "cn").select("category", "field", "jp_key", "cn_text", "source")


@query("select doc_id, lang from documents where contains(lower(text), 'license')")
def q_search(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(text.matches("LICENSE", F.col("text"))).select("doc_id", "lang")


@query("""select p_partkey, case when p_size > 25 then 'big' when p_size > 10 then 'mid' else 'none' end size_name, p_brand = 'Brand#11' as preferred,
  not (p_size > 25 and p_brand = 'Brand#11') other from part""")
def q_flags(spark, sf_dir):
    size, first = F.col("p_size"), F.col("p_brand") == "Brand#11"
    name = F.when(size > 25, "big").when(size > 10, "mid").otherwise("")
    return read(spark, sf_dir, "part").select("p_partkey", text.or_default(name, "none").alias("size_name"), first.alias("preferred"), (~((size > 25) & first)).alias("other"))


@query("select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') then '********' else c_name end shown from customer")
def q_mask(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.mask(F.col("c_mktsegment"), F.col("c_name"), ["BUILDING", "MACHINERY"]).alias("shown"))


@query("""select s_suppkey, k, v from (select s_suppkey, 'name' k, s_name v from supplier union all select s_suppkey, 'nation', cast(s_nationkey as varchar) from supplier)""")
def q_unpivot(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation")).unpivot("s_suppkey", ["name", "nation"], "k", "v")


@query(f"with {_ENTRIES} select jp_key, cast(row_number() over (order by case source when 'unknown' then 0 when 'llm' then 1 when 'cn' then 2 when 'human' then 3 else 4 end, p_partkey) as int) place from e where category = 'cards' and field = 'Brand#11'")
def q_rank_order(spark, sf_dir):
    rows = entry_ops.select_entries(_entries(spark, sf_dir), "cards", "Brand#11")
    rank = F.element_at(F.map_from_arrays(F.array(*map(F.lit, ["unknown", "llm", "cn", "human", "pinned"])), F.array(*map(F.lit, range(5)))), F.col("source"))
    return rows.select("jp_key", F.row_number().over(Window.partitionBy("category", "field").orderBy(rank, text.natural_key(F.col("jp_key")))).alias("place"))


# --- joins and sets


@query("""select distinct doc_id from (select doc_id from labels where toxic = 1 union select doc_id from documents where lang = 'fr')""")
def q_preserve_union(spark, sf_dir):
    """Documents as stories: toxic ones have a line, French ones a title that a person edited."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ids = docs.select("doc_id").union(labels.select("doc_id")).distinct()
    stories = ids.select(F.col("doc_id").alias("event_id"), F.lit("cn").alias("source"))
    titles = docs.select(F.col("doc_id").alias("event_id"), F.when(F.col("lang") == "fr", "human").otherwise("cn").alias("title_source"))
    lines = labels.select(F.col("doc_id").alias("event_id"), F.when(F.col("toxic") == 1, "pinned").otherwise("cn").alias("source"))
    return rollup.sync_states(stories, titles, lines).where("preserve").select(F.col("event_id").alias("doc_id"))


@query("select doc_id, lang from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)")
def q_semi(spark, sf_dir):
    """Documents that a label touches, as stories that a person edited."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("lang").alias("source"))
    labelled = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), F.lit("human").alias("source"))
    none = docs.select("event_id", F.lit("cn").alias("title_source"))
    return rollup.sync_states(docs, none, labelled).where("preserve").select(F.col("event_id").alias("doc_id"), F.col("source").alias("lang"))


@query("select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def q_anti(spark, sf_dir):
    """Documents that no label touches."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("lang").alias("source"))
    labelled = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), F.lit("human").alias("source"))
    none = docs.select("event_id", F.lit("cn").alias("title_source"))
    return rollup.sync_states(docs, none, labelled).where("not preserve").select(F.col("event_id").alias("doc_id"), F.col("source").alias("lang"))


@query("""with a as (select p_name, p_brand, max(p_type) t from part group by all)
select f.p_name, t.t from a t join a f on t.p_name = f.p_name where t.p_brand = 'Brand#11' and f.p_brand = 'Brand#12' and not (t.t = '' and t.p_brand = '') and t.t <> f.t""")
def q_tag_copy(spark, sf_dir):
    """Types of one brand's parts copied onto the parts of equal name of another."""
    a = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("field"), F.col("p_name").alias("jp_key")).agg(F.max("p_type").alias("cn_text"))
    more = {"category": F.lit("parts"), "source": F.lit("cn"), "ids": F.array().cast("array<string>"), "updated_at": F.lit(0).cast("bigint"), "updated_by": F.lit("x"), "action": F.lit("keep")}
    return merge.copy_field(a.withColumns(more), "parts", "Brand#11", "Brand#12").where("copied").select(F.col("jp_key").alias("p_name"), F.col("cn_text").alias("t"))


@query("""select u.conv_id, cast(u.p as bigint) p, u.text a, b.text t
from (select *, row_number() over (partition by conv_id order by turn) p from conversations where role = 'user') u
join (select *, row_number() over (partition by conv_id order by turn) p from conversations where role = 'assistant') b on u.conv_id = b.conv_id and u.p = b.p""")
def q_pair_position(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    p = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint")
    side = lambda role, name: c.where(F.col("role") == role).select("conv_id", p.alias("p"), F.col("text").alias(name))
    return side("user", "a").join(side("assistant", "t"), ["conv_id", "p"])


@query(f"""with {_ENTRIES} select p.p_partkey id, p.p_name n, e.cn_text cn from part p left join e on e.category = 'cards' and e.field = 'Brand#11' and e.jp_key = 'k' || p.p_partkey and e.cn_text <> '' and e.cn_text <> e.jp_key""")
def q_lookup_dict(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("n"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"))
    return search_index.with_text(part, _entries(spark, sf_dir), "cards", "Brand#11", "key").select("id", "n", "cn")


@query("""with a as (select cast(doc_id as varchar) k, text from documents),
b as (select case when doc_id % 2 = 0 then '' else 'old' end || doc_id k, case when doc_id % 5 = 0 then text || '!' else text end text, true there from documents)
select count(*) filter (there and a.text <> b.text) text_diffs, count(*) filter (there is null) missing from a left join b using (k)""")
def q_flat_compat(spark, sf_dir):
    d, name = read(spark, sf_dir, "documents"), [F.lit("c").alias("category"), F.lit("f").alias("field")]
    key, even = F.col("doc_id").cast("string"), F.col("doc_id") % 2 == 0
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    stored = d.select(*name, F.when(even, key).otherwise(F.concat(F.lit("old"), key)).alias("jp_key"), changed.alias("cn_text"))
    return verify.flat_compat(d.select(*name, key.alias("jp_key"), "text"), stored).select("text_diffs", "missing")


@query("""with a as (select lang, source from documents), b as (select lang, case when doc_id % 4 = 0 then 'other' else source end source from documents)
select lang, source, side, cast(count(*) as bigint) n from (select *, 'left' side from (select * from a except all select * from b) union all select *, 'right' from (select * from b except all select * from a)) group by all""")
def q_diff(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    second = d.select("lang", F.when(F.col("doc_id") % 4 == 0, "other").otherwise(F.col("source")).alias("source"))
    return verify.difference(d.select("lang", "source"), second).groupBy("lang", "source", "side").agg(F.count("*").alias("n"))



# --- order


@query("select conv_id, string_agg(role, ',' order by turn) roles from conversations group by conv_id")
def q_ordered_lines(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "event_id")
    stories, episode = c.select("event_id").distinct(), F.lit("1").alias("episode_no")
    episodes = stories.select("event_id", episode, F.lit("s").alias("scenario_id"), F.lit("").alias("title"), F.lit("").alias("title_source"), F.lit(0).alias("position"))
    lines = c.select("event_id", episode, F.col("role").alias("jp_key"), F.lit("").alias("cn_text"), F.lit("").alias("source"), F.lit("").alias("speaker_name"), F.col("turn").cast("int").alias("position"))
    nested = story.ordered_detail(stories, episodes, lines)
    return nested.select(F.col("event_id").alias("conv_id"), F.array_join(F.col("episodes")[0]["talk"]["jp_key"], ",").alias("roles"))


@query("""select conv_id, turn, cast(row_number() over (partition by conv_id order by case when role = 'assistant' then 0 else 1 end, turn) - 1 as bigint) p from conversations""")
def q_reorder(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    lines = c.select(F.col("conv_id").alias("event_id"), F.lit("1").alias("episode_no"), F.col("turn").cast("string").alias("jp_key"), F.lit("").alias("cn_text"), F.lit("").alias("source"), F.lit("").alias("speaker_name"), F.col("turn").cast("int").alias("position"))
    keys = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", F.col("turn").cast("string").alias("k")))))
    wanted = c.groupBy("conv_id").agg(keys.alias("s")).select(F.col("conv_id").alias("event_id"), F.lit("1").alias("episode_no"), F.col("s.k").alias("keys"))
    return story.reorder_lines(lines, wanted).select(F.col("event_id").alias("conv_id"), F.col("jp_key").cast("bigint").alias("turn"), F.col("position").cast("bigint").alias("p"))


@query("select md5(text) as text_key, max(doc_id) last_id from documents group by text")
def q_last_wins(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.md5("text").alias("text_key"), F.col("doc_id").alias("last_id"))
    return arrays.last_value(rows, ["text_key"], "last_id", "last_id")


@query("select md5(text) as text_key, string_agg(source, ',' order by f) sources from (select text, source, min(doc_id) f from documents group by all) group by text")
def q_trace_ids(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.md5("text").alias("text_key"), "source", F.col("doc_id").alias("ord"))
    return arrays.first_seen(rows, ["text_key"], "source", "ord", "sources").select("text_key", F.array_join("sources", ",").alias("sources"))


@query("""with x as (select event_id, event_type = 'error' e from events), y as (select *, sum(case when not e then 1 else 0 end) over (order by event_id) g from x),
z as (select event_id, e, cast(sum(case when e then 1 else 0 end) over (partition by g order by event_id) as bigint) st from y)
select event_id, st streak from z where event_id <= coalesce((select min(event_id) from z where e and st >= 3), (select max(event_id) from z))""")
def q_streak(spark, sf_dir):
    checks = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "miss").otherwise("found").alias("outcome"))
    return story.walk_streak(checks, 0).select("event_id", "streak")


@query("""with d as (select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 n from documents where doc_id not in (select doc_id from labels))
select doc_id, lang, cast(n // 20 as int) batch_no, cast(n % 20 + 1 as int) item_no from d""")
def q_fill_targets(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return fill.batches(rows, ["lang"], ["doc_id"], 20)


# --- merges


@query(f"""with {_ENTRIES}, n as (select category, field, case when p_partkey % 3 = 1 then 'x' else '' end || jp_key jp_key, case when p_partkey % 6 = 0 then '' else 'new ' || cn_text end new_text, [cast(p_partkey + 1 as varchar)] new_ids from e
  union all select 'cards', 'fresh', 'f' || p_partkey, case when p_partkey % 2 = 0 then '' else p_name end, [] from part),
m as (select coalesce(e.category, n.category) category, coalesce(e.field, n.field) field, coalesce(e.jp_key, n.jp_key) jp_key, e.jp_key is not null stored, n.jp_key is not null paired, cn_text, source, ids, new_text, new_ids from e full join n using (category, field, jp_key)),
r as (select *, case when not paired or (new_text <> '' and stored and source = 'pinned') or (new_text = '' and stored and cn_text <> '') then cn_text when new_text <> '' then new_text else '' end t,
  case when not paired or (new_text <> '' and stored and source = 'pinned') or (new_text = '' and stored and cn_text <> '') then source when new_text <> '' then 'cn' else 'unknown' end s,
  case when not paired then ids when not stored then new_ids when list_contains(ids, new_ids[1]) then ids else list_concat(ids, new_ids) end i from m)
select category, field, jp_key, t cn_text, s source, array_to_string(i, ',') ids, case when not stored then 'insert' when t <> cn_text or s <> source or i <> ids then 'update' else 'keep' end as action from r""")
def q_merge(spark, sf_dir):
    e = _entries(spark, sf_dir)
    k = F.col("ids")[0].cast("bigint")
    key = F.concat(F.when(k % 3 == 1, "x").otherwise(""), "jp_key").alias("jp_key")
    pairs = e.select("category", "field", key, F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("new "), F.col("cn_text"))).alias("cn_text"))
    p = F.col("p_partkey")
    fresh = read(spark, sf_dir, "part").select(F.lit("cards").alias("category"), F.lit("fresh").alias("field"), F.concat(F.lit("f"), p.cast("string")).alias("jp_key"), F.when(p % 2 == 0, "").otherwise(F.col("p_name")).alias("cn_text"))
    traces = e.select("category", "field", key, F.array((k + 1).cast("string")).alias("ids"))
    merged = merge.sync_merge(e, pairs.union(fresh), traces, now=1)
    return merged.select("category", "field", "jp_key", "cn_text", "source", F.array_join("ids", ",").alias("ids"), "action")


@query(f"""with {_ENTRIES}, u as (select category, field, case when p_partkey % 2 = 0 then '' else 'x' end || jp_key jp_key, 'ai ' || jp_key new_text from e),
m as (select *, case when new_text is null then 'keep' when p_partkey is null then 'insert' when source in ('llm', 'unknown') then 'update' else 'skip' end a from e full join u using (category, field, jp_key))
select category, field, jp_key, case when a in ('insert', 'update') then new_text else cn_text end cn_text, case when a in ('insert', 'update') then 'llm' else source end source, a as action from m""")
def q_fill_merge(spark, sf_dir):
    e = _entries(spark, sf_dir)
    key = F.concat(F.when(F.col("ids")[0].cast("bigint") % 2 == 0, "").otherwise("x"), "jp_key")
    updates = e.select("category", "field", key.alias("jp_key"), F.concat(F.lit("ai "), F.col("jp_key")).alias("cn_text"))
    return merge.fill_merge(e, updates, now=1).select("category", "field", "jp_key", "cn_text", "source", "action")


@query(f"with {_ENTRIES} select category, field, count(*) filter (source in ('llm', 'unknown') and cn_text = '') candidates, count(*) filter (not (source in ('llm', 'unknown') and cn_text = '')) rejected from e group by all")
def q_candidates(spark, sf_dir):
    return fill.candidate_counts(_entries(spark, sf_dir))


@query("select doc_id, coalesce(l.quality, cast(d.n_chars % 2 as int)) quality from documents d left join labels l using (doc_id) union all select doc_id, quality from labels where doc_id not in (select doc_id from documents)")
def q_upsert(spark, sf_dir):
    stored = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return merge.upsert(stored, read(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])


@query("select doc_id, quality from labels union all select doc_id, cast(n_chars % 2 as int) from documents where doc_id not in (select doc_id from labels)")
def q_insert_absent(spark, sf_dir):
    new = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return merge.insert_absent(read(spark, sf_dir, "labels").select("doc_id", "quality"), new, ["doc_id"])


# --- stories


@query(f"""with {_STORIES} select event_id, source, cast(0 as bigint) last_updated, (select count(*) from ep where ep.event_id = s.event_id) episode_count,
  (select count(*) from ln where ln.event_id = s.event_id and cn_text = '') + (select count(*) from ep where ep.event_id = s.event_id and title <> '' and title_source in ('', 'unknown', 'jp_pending')) untranslated_count from s""")
def q_story_summary(spark, sf_dir):
    return rollup.story_summaries(*_stories(spark, sf_dir))


@query(f"""with {_STORIES} select event_id, source, source in ('official_cn', 'official_cn_legacy') is_official, source = 'llm' is_llm,
  source in ('human', 'pinned') or event_id in (select event_id from ln where source in ('human', 'pinned') union select event_id from ep where title_source in ('human', 'pinned')) preserve from s""")
def q_sync_states(spark, sf_dir):
    return rollup.sync_states(*_stories(spark, sf_dir))


@query(f"""with {_STORIES} select max(event_id) max_id, max(case when source like 'official%' then event_id end) latest_official, min(case when source = 'llm' then event_id end) first_llm,
  coalesce(min(case when source = 'llm' then event_id end), max(case when source like 'official%' then event_id end) + 1, 1) start_id from s""")
def q_sync_bounds(spark, sf_dir):
    return rollup.sync_bounds(rollup.sync_states(*_stories(spark, sf_dir)))


@query(f"""with {_STORIES}, t as (select event_id, 0 part, '' by_text, position, episode_no, 'title' kind, title jp from ep where title <> '' and title_source in ('', 'unknown', 'jp_pending')
  union all select event_id, 1, episode_no, position, episode_no, 'talk', jp_key from ln where cn_text = '')
select event_id, cast(row_number() over (partition by event_id order by part, by_text, position, jp) as int) target_no, episode_no, kind, jp from t""")
def q_targets(spark, sf_dir):
    return story.untranslated_targets(*_stories(spark, sf_dir)[1:])


@query(f"""with {_STORIES} select event_id, count(*) episodes, string_agg(episode_no || ':' || n, ',' order by position) shape from (select ep.event_id, ep.position, ep.episode_no, count(ln.jp_key) n from ep left join ln using (event_id, episode_no) group by all) group by event_id""")
def q_ordered_detail(spark, sf_dir):
    nested = story.ordered_detail(*_stories(spark, sf_dir))
    shape = F.array_join(F.transform("episodes", lambda e: F.concat(e["episode_no"], F.lit(":"), F.size(e["talk"]).cast("string"))), ",")
    return nested.select("event_id", F.size("episodes").cast("bigint").alias("episodes"), shape.alias("shape"))


@query(f"""with {_STORIES}, r as (select event_id, episode_no, position, 1 k, 'talk' kind, jp_key jp, cn_text as text, case when source = '' then '?' else source end source from ln
  union all select event_id, episode_no, -1, 0, 'title', title, title, title_source from ep where title <> '')
select event_id, cast(row_number() over (partition by event_id order by episode_no, position, jp) as int) ord, episode_no || '|' || case when kind = 'title' then '__title__|' else '' end || jp as key, md5(text) text_key, source from r""")
def q_display_rows(spark, sf_dir):
    return story.display_rows(*_stories(spark, sf_dir)).select("event_id", "ord", "key", F.md5("text").alias("text_key"), "source")


# --- text functions


@query("""select event_id, coalesce(cast(json_extract(props, '$.k') as bigint), 0) k from events""")
def q_json_project(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", documents.get_int(documents.document(F.col("props")), "k").alias("k"))


@query("select doc_id, '\"' || substr(sha256(text), 1, 32) || '\"' etag from documents")
def q_etag(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.etag(F.col("text")).alias("etag"))


@query("select doc_id, case when length(text) > 30 then substr(text, 1, 30) || '…' else text end short from documents")
def q_truncate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 30).alias("short"))


@query("select page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) escaped, md5(html) back from pages")
def q_xml(spark, sf_dir):
    escaped = text.xml_escape(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.md5(escaped).alias("escaped"), F.md5(text.xml_unescape(escaped)).alias("back"))


@query("""select conv_id, array_to_string(list(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') order by turn), '|') items from conversations group by conv_id""")
def q_xml_items(spark, sf_dir):
    """A round trip: texts to numbered items, read back as a reply, aligned by id."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("texts"))
    reply = F.regexp_replace(F.regexp_replace(text.xml_items(F.col("texts")), "<item id", "<t id"), "</item>", "</t>")
    back = text.parse_xml_items(reply, F.size("texts"))
    return c.select("conv_id", F.array_join(F.transform(back, text.xml_escape), "|").alias("items"))


@query("""select o_orderkey, case when o_orderpriority ~ '^[0-9]+$' then cast(o_orderpriority as bigint) else 0 end strict, cast(regexp_extract(o_orderpriority, '^\\s*([+-]?\\d+)', 1) as bigint) prefix from orders""")
def q_integers(spark, sf_dir):
    p = F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.strict_int(p).alias("strict"), text.prefix_int(p).alias("prefix"))


# --- time


@query("""with x as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 hour then 0 else 1 end b from events),
y as (select *, sum(b) over (partition by user_id order by ts) g from x)
select user_id, max(ts) + interval 1 hour fires_at, count(*) changes from y group by user_id, g""")
def q_debounce(spark, sf_dir):
    return refresh.debounced(read(spark, sf_dir, "events"), "user_id", "ts", "1 hour")


@query("""with x as (select user_id, ts, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) p from events)
select event_id, event_type as version, p previous from x where p is not null and p <> event_type""")
def q_version_change(spark, sf_dir):
    polls = read(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("polled_at"), F.col("event_type").alias("version"))
    return refresh.version_changes(polls).select(F.col("polled_at").alias("event_id"), "version", "previous")


from . import catalog_documents, catalog_jobs  # noqa: E402, F401  (register the queries of documents and of jobs)
