"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import attention_lm, bpe, centroids, decontam, fingerprints, importance, licenses, line_crf, line_dedup, near_dup, url_rules, vafile, warc
from .common import read


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.nearest(read(spark, sf_dir, "embeddings"))


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages"))


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(read(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents")).select("doc.doc_id", "new_text", "removed_words")


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_topk, op2_decontam, op3_licenses, op4_url_rules, op5_attention_lm, op6_warc, op7_bpe, op8_line_dedup, op9_line_crf, op10_near_dup, op11_importance, op12_centroids, op13_fingerprints)
}

ORACLE_SQL = {
    "op1_topk": """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) c
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(256 * cast(x as double)))) = 0),
q as (select vec_id, min({'n': len(c), 'c': c}).c c from v where vec_id % 50 = 0 group by vec_id),
s as (
  select q.vec_id query_id, v.vec_id, cast(list_inner_product(q.c, v.c) as bigint) score
  from q join v on len(q.c) = len(v.c) and q.vec_id <> v.vec_id)
select query_id, cast(rank as int) rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 5""",
    "op11_importance": """
with tab as (
  select list(list_reduce([i] || range(8), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) t
  from range(256) r(i)),
d as (
  select doc_id, row_number() over () k,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws
  from documents),
f as (select k, unnest(ws) w from d),
b as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) w
  from benchmark),
crc as (
  select w, xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(w))), lambda i: cast('0x' || substr(hex(encode(w)), cast(2 * i + 1 as int), 2) as bigint)),
    lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295) % 10000 bucket
  from (select distinct w from (select w from f union all select w from b)), tab),
s as (select bucket, count(*) s from f join crc using (w) group by bucket),
t as (select bucket, count(*) t from b join crc using (w) group by bucket),
g as (
  select i bucket, cast(floor(1000 * ln((cast(coalesce(t, 0) as double) + 1) * ((select count(*) from f) + 10000.0::double)
    / ((cast(coalesce(s, 0) as double) + 1) * ((select count(*) from b) + 10000.0::double)))) as bigint) gain
  from range(10000) r(i) left join s on s.bucket = i left join t on t.bucket = i),
w as (select k, cast(sum(gain) as bigint) weight from f join crc using (w) join g using (bucket) group by k),
sc as (
  select doc_id, cast(len(ws) as bigint) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln(
    (cast(cast('0x' || substr(sha256('2024:' || cast(doc_id as varchar)), 1, 8) as bigint) as double) + 0.5) / 4294967296.0::double))) as bigint) score
  from d left join w using (k)),
r as (select doc_id, n_features, weight, score, row_number() over (order by score desc, doc_id) rank from sc where n_features >= 20)
select doc_id, n_features, weight, score, rank from r where rank <= (select count(*) from r) * 10 // 100
union all select doc_id, n_features, weight, score, null from r where rank > (select count(*) from r) * 10 // 100
union all select doc_id, n_features, weight, score, null from sc where n_features < 20""",
    "op12_centroids": """
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
c0 as materialized (
  select row_number() over (order by sha256('1:' || cast(vec_id as varchar))) - 1 c, v from v order by c limit 16),"""
    + "".join(f"""
a{i} as materialized (
  select vec_id, v.v, arg_min(c, struct_pack(d := d, c := c)) c, min(d) d
  from (select vec_id, v.v, c, list_sum(list_transform(list_zip(v.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from v, c{i}) v group by vec_id, v.v),
p{i} as (select c, j, sum(x)::hugeint s, count(*)::hugeint n from (select c, unnest(v) x, generate_subscripts(v, 1) j from a{i}) group by c, j),
c{i + 1} as materialized (
  select c{i}.c, coalesce(m.v, c{i}.v) v
  from c{i} left join (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) v from p{i} group by c) m on m.c = c{i}.c),""" for i in range(3))
    + """
a as materialized (
  select vec_id, arg_min(c, struct_pack(d := d, c := c)) c, min(d) d
  from (select vec_id, v.v, c, list_sum(list_transform(list_zip(v.v, c3.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from v, c3) group by vec_id, v)
select vec_id, cast(a.c as int) as cluster, cast(d as bigint) distance, cast(sum(d) over (partition by a.c) as bigint) cluster_inertia,
  cast(sum(d) over () as bigint) inertia, sha256(array_to_string(c3.v, ',')) centroid_sha256
from a join c3 on a.c = c3.c""",
    "op10_near_dup": """
with recursive w as (
  select doc_id, string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '[\\x20\\x09-\\x0D]+') a from documents),
sh as (
  select doc_id, unnest(case when a[1] = '' then [] when len(a) < 3 then [array_to_string(a, ' ')]
    else list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) end) s from w),
n as (select doc_id, count(*) n from sh group by doc_id),
common as (select x.doc_id a, y.doc_id b, count(*) c from sh x join sh y on x.s = y.s and x.doc_id < y.doc_id group by all),
link as (select a, b from common join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)),
edge as (select a, b from link union all select b, a from link),
reach as (select doc_id, doc_id other from w union select reach.doc_id, edge.b from reach join edge on reach.other = edge.a)
select w.doc_id, coalesce(n.n, 0) n_shingles, r.component_id, w.doc_id = r.component_id kept
from w left join n using (doc_id) join (select doc_id, min(other) component_id from reach group by doc_id) r using (doc_id)""",
    "op6_warc": """
with p as (select page_id, sha256(coalesce(html, '')) payload_digest, cast(octet_length(encode(coalesce(html, ''))) as bigint) payload_bytes from pages),
f as (select *, row_number() over (partition by payload_digest order by page_id) r, min(page_id) over (partition by payload_digest) first_id from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and r > 1 then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 100 and r > 1 then first_id end refers_to
from f""",
}
