"""Registered queries against their SQL, and what every operator does with odd input."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossweave.llm import attention_lm, bpe, decontam, licenses, line_crf, line_dedup, near_dup, queries, url_rules, vafile, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, sf_dir, duck, as_rows, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    assert as_rows(got[list(want.columns)]) == as_rows(want)


def test_url_query_against_sql_and_mined_rules(spark, sf_dir, duck):
    """Hosts, paths, stated rules and their verdicts by SQL; the other verdicts by trying every mined rule on every page."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_rules.STATED)
    want = duck.execute(f"""
with r as (select * from (values {values}) t(verdict, h, p)),
p as (select page_id, coalesce(url, '') url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end tail from pages),
q as (select page_id, url, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) path from p),
f as (select page_id, arg_max(h || r.p, length(h || r.p)) as rule, arg_max(verdict, length(h || r.p)) verdict from q join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, r.p) group by page_id)
select page_id, url, host, path, rule, verdict from q left join f using (page_id)""").fetchall()
    got = {r.page_id: r for r in queries.op4_url_rules(spark, sf_dir).collect()}
    assert len(got) == len(want) and {(r.page_id, r.host, r.path, r.rule) for r in got.values()} == {(i, h, p, rule) for i, _, h, p, rule, _ in want}
    of_url = {u: (v == "block") for _, u, _, _, _, v in want if v}
    labelled = spark.createDataFrame([(u, v == "block") for _, u, _, _, _, v in want if v], "url string, block boolean")
    rules = url_rules.mine(labelled).collect()
    urls = spark.createDataFrame([(i, u) for i, u, *_ in want], "page_id long, url string")
    has = {r.page_id: set(r.t) for r in urls.select("page_id", url_rules.tokens(urls.url).alias("t")).collect()}
    assert of_url and rules and any(v is None for *_, v in want)
    for i, *_, stated in want:
        fits = [(r.confidence, r.support, len(r["items"]), r.verdict) for r in rules if set(r["items"]) <= has[i]]
        assert got[i].verdict == (stated or (max(fits)[3] if fits else "allow"))


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blank and very long texts, and repeated rows, with columns named as the operators name theirs."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(None, "a text without an id " * 5), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, "x" * 50_000), (6, "one two three four five six seven"), (6, "one two three four five six seven"), (6, "other words of the same id"), (7, "\u0000 \U0001f600 　 é")]
    frame = spark.createDataFrame([(i, t, "k", 1, 2, 3.0, True) for i, t in rows], "doc_id long, text string, keep string, n long, token long, score double, kept boolean")
    return frame, rows


OPERATORS = {
    "crf": lambda s, d: line_crf.classify(d, s.createDataFrame([(4, 1), (5, 0), (4, 1), (None, 1), (6, None)], "doc_id long, quality int")),
    "near": lambda s, d: near_dup.near_duplicates(d),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "bpe": lambda s, d: bpe.digests(d),
    "lm": lambda s, d: attention_lm.score(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_a_row_of_odd_input(spark, odd, name):
    assert OPERATORS[name](spark, odd[0]).count() == len(odd[1])


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, _docs(spark, [])).count() == 0


def test_searches_take_odd_input(spark, odd):
    bench = spark.createDataFrame([(1, None), (None, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10"), (2, "short"), (3, " ".join(f"word{i}" for i in range(100, 130)))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(odd[0], bench).collect()} == {(4, 3)}
    assert decontam.without_leaks(odd[0], bench).columns == odd[0].columns
    assert decontam.without_leaks(odd[0], bench).count() == len(odd[1]) - 1
    assert decontam.leaks(odd[0], bench.limit(0)).count() == 0
    assert licenses.scan(odd[0]).count() == 0
    assert licenses.scan(odd[0].limit(0)).count() == 0


def test_stages_keep_columns(spark, odd, sf_dir):
    labels = spark.createDataFrame([(4, 1), (6, 1)], "doc_id long, quality int")
    for out in (line_crf.accepted(odd[0], labels), line_dedup.deduplicated(odd[0]), near_dup.one_of_each(odd[0])):
        assert out.columns == odd[0].columns
        out.collect()


def test_pages_of_odd_kinds(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://EXAMPLE.com/en/7x?q#f", "h" * 200), (3, "http://EXAMPLE.com/en/7x?q#f", "h" * 200), (4, "http://a.org/es/", "h" * 200), (None, "http://b.net/de/1", "h" * 200), (5, "http://é.net\r\n/x", "z" * 99)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.warc_digest(pages).collect())
    # Of the two rows of page 3 one answers for the other too.
    assert kinds == [("1", "response", None), ("2", "response", None), ("3", "response", None), ("3", "revisit", 3), ("4", "revisit", 3), ("5", "response", None), ("None", "revisit", 3)]
    verdicts = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages).collect()}
    assert {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "example.com", "/en/7x", "example.com/en/7", "allow"), (4, "a.org", "/es/", "org/es/", "block")} <= verdicts
    assert warc.warc_digest(pages.limit(0)).count() == 0 and url_rules.judge(pages.limit(0)).count() == 0


def test_records_come_back_byte_for_byte(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "ü" * 80), (2, "http://b/", "ü" * 80), (3, "http://c/", ""), (1, "http://a/", "ü" * 80)], "page_id long, url string, html string")
    archive = warc.write_archive(pages, f"{tmp_path}/warc", date="2024-01-31T12:00:00Z")
    assert archive[1].count() == 2
    rows = warc.reconstruct(*archive).collect()
    fields = []
    for r in rows:
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        field = dict(x.split(": ", 1) for x in lines[1:])
        html = "ü" * 80 if r.page_id == 1 and field["WARC-Type"] == "response" else ""
        assert lines[0] == "WARC/1.1" and body == html.encode() + b"\r\n\r\n" and field["Content-Length"] == str(len(html.encode()))
        assert field["WARC-Date"] == "2024-01-31T12:00:00Z" and field["WARC-Type"] in ({1: ["response", "revisit"], 2: ["revisit"], 3: ["response"]}[r.page_id])
        fields.append((r.page_id, field))
    assert len({f["WARC-Record-ID"] for _, f in fields}) == 4
    assert sorted(f["WARC-Type"] for i, f in fields if i == 1) == ["response", "revisit"]
    again = dict(fields)[2]
    assert again["WARC-Profile"] == warc.PROFILE and again["WARC-Refers-To"] in {f["WARC-Record-ID"] for i, f in fields if i == 1 and f["WARC-Type"] == "response"}


def test_a_damaged_archive_stops_the_job(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "http://a/", "x" * 200), (2, "http://b/", "y")], "page_id long, url string, html string")
    headers, payloads = warc.write_archive(pages, f"{tmp_path}/warc")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(headers, payloads.withColumn("payload", F.concat("payload", F.lit(b"!")))).collect()
    with pytest.raises(Exception, match="payload missing"):
        warc.read_archive(headers, payloads.where("length(payload) > 1")).collect()


def _nearest(rows, every=50, k=5, scale=256):
    """Brute force in whole numbers of any size: a query id of several vectors searches for the least."""
    from fractions import Fraction
    from math import floor, isfinite

    usable = {(i, tuple(floor(Fraction(x) * scale) for x in v)) for i, v in rows if i is not None and v and all(x is not None and isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        own = min((len(v), v) for i, v in usable if i == q)[1]
        best = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in usable if i != q and len(v) == len(own))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best[:k], 1)]
    return out


def _found(spark, rows, kind="double"):
    got = vafile.nearest(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, key string, r int"))
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in got.orderBy("query_id", "rank").collect()]


def test_large_components_take_part(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e7, 0.0]), (2, [0.5, 0.5]), (3, [-3e12, 1e3]), (4, [0.0, 2.0**44]), (50, [0.001, -1.0]), (6, [float("inf"), 1.0]), (7, [1e308, 1.0])]
    small = [r for r in rows if r[0] != 7]
    assert (0, 2, 1, 655_360_000_000) in _nearest(small)
    with pytest.raises(Exception, match="fits no long"):
        _found(spark, [*rows[:3], (8, [1e300, 0.0])])
    # 256 * 1e308 is not finite; scores that are too small for a long do no harm where they are not among the best.
    assert _found(spark, [(0, [1.0, 1.0]), (1, [-1e300, 0.0]), *[(i, [float(i), 1.0]) for i in range(2, 9)], (9, [1e308, 1.0])]) == _nearest([(0, [1.0, 1.0]), *[(i, [float(i), 1.0]) for i in range(2, 9)]])
    assert _found(spark, small) == _nearest(small)


def test_an_outlier_and_equal_vectors_leave_few_bounds(spark, monkeypatch):
    import numpy as np

    draw = np.random.default_rng(5)
    rows = [(i, (draw.standard_normal(16) / 4).tolist()) for i in range(2000)]
    read = []
    cut = vafile.cut
    monkeypatch.setattr(vafile, "cut", lambda df: (lambda out: (read.append(out.count()) if "low" in out.columns else None, out)[1])(cut(df)))
    for more in ([], [(2001, [8.0e6] + [0.0] * 15)], [(3000 + i, rows[7][1]) for i in range(1500)]):
        read.clear()
        assert _found(spark, rows + more) == _nearest(rows + more)
        assert read[0] < 20 * 41 + 41 * 5 * (len(more) == 1500) * 2, more[:1]


def test_copies_of_blocks_are_not_broadcast(spark, monkeypatch):
    """Every block meets every other, with more blocks than tasks too, and the copies of blocks that this needs don't go through the driver."""
    import numpy as np

    draw = np.random.default_rng(6)
    rows = [(i, (draw.standard_normal(8 if i % 3 else 4) / 4).tolist()) for i in range(1500)]
    plans, cut = [], vafile.cut
    monkeypatch.setattr(vafile, "cut", lambda df: (lambda out: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if "low" in out.columns else None, out)[1])(cut(df)))
    for name, n in (("BLOCK", 100), ("QUERIES", 8), ("TASKS", 12)):
        monkeypatch.setattr(vafile, name, n)
    assert _found(spark, rows) == _nearest(rows)
    assert len(plans) == 1 and "isFinalPlan=true" in plans[0] and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_leftovers_are_read_at_once_where_they_are_few(spark, monkeypatch):
    """Few vectors left are read in one round, many in rounds that grow; the rows are the same."""
    import numpy as np

    draw = np.random.default_rng(7)
    rows = [(i, (draw.standard_normal(12) / 4).tolist()) for i in range(1200)]
    rounds, cut = [], vafile.cut
    monkeypatch.setattr(vafile, "cut", lambda df: (rounds.append(1) if "digits" in df.columns else None, cut(df))[1])
    monkeypatch.setattr(vafile, "BLOCK", 100)
    want = _nearest(rows)
    for first, least, most in ((40, 1, 1), (1, 2, 4)):
        rounds.clear()
        monkeypatch.setattr(vafile, "FIRST_READ", first)
        assert _found(spark, rows) == want and least <= len(rounds) <= most, (first, len(rounds))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([-3.0, -1.0, 0.0, 1.0, 2.0, 1e6, -1e15, 2.0**54]), min_size=3, max_size=3), min_size=1, max_size=40), st.lists(st.sampled_from([-2.0, 0.0, 1.0, 1e9]), min_size=3, max_size=3))
def test_bounds_hold(vectors, query):
    import numpy as np

    v, q = np.array(vectors), np.array([query])
    marks, cell = vafile.approximate(v, 8)
    low, high = vafile.bounds(q, marks[np.arange(3), cell], marks[np.arange(3), cell + np.int16(1)])
    for i, x in enumerate(vectors):
        exact = sum(int(a) * int(b) for a, b in zip(query, x, strict=True))
        assert int(low[0, i]) <= exact <= int(high[0, i])


def test_ids_of_several_vectors_ties_and_empty_tables(spark):
    rows = [(0, [2.0, 1.0]), (0, [1.0, 3.0]), (0, [1.0, 3.0]), *[(i, [1.0, 1.0]) for i in range(1, 12)], (3, [5.0, 5.0]), (50, [-1.0, 0.5]), (100, [1.0])]
    assert _found(spark, rows) == _nearest(rows)
    assert _found(spark, [(1, [1.0])]) == [] and _found(spark, []) == []


def test_vectors_of_odd_kinds(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 0.0, 0.0]), (8, [0.5, 0.5]), (None, [1.0, 1.0]), (50, [-1.0, 0.25])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vafile.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    v = {0: (256, 0), 1: (128, 128), 8: (128, 128), 50: (-256, 64)}
    want = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[o], strict=True)), o) for o in v if o != q)
        want += [(q, i, o, -s) for i, (s, o) in enumerate(best[:5], 1)]
    assert got == want


def test_the_pipeline_takes_odd_and_empty_tables(spark, tmp_path):
    """Nulls in any column, blank and repeated rows and columns named as stages name theirs, through all stages; and no rows at all."""
    import corpus_pipeline

    def prose(d):
        rng = random.Random(d)
        word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
        return "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(6))

    kinds = DOCS + ", doc string, keep boolean, hit long, token string, id long, found string"
    row = lambda i, t: (i, t, None, "web", None if t is None else len(t), "clash", None, 3, None, 4, "x")
    rows = [row(i, prose(i)) for i in range(1, 30)] + [row(None, prose(77)), row(40, None), row(41, ""), row(42, " \n\t"), row(5, prose(5)), row(43, prose(5)), row(44, "y" * 200_000), row(45, "words " * 60_000)]
    labels = [(i, i % 3 > 0) for i in range(1, 30)] + [(None, True), (40, None), (5, True)]
    for name, docs, marks, items in (("odd", rows, labels, [(1, None), (None, "no id"), (2, prose(7)[:300]), (2, prose(7)[:300])]), ("none", [], [], [])):
        spark.createDataFrame(docs, kinds).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, None if q is None else int(q), 0) for i, q in marks], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    current = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    columns = current.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, f"{tmp_path}/odd").write.parquet(f"{tmp_path}/stage{k}")
        current = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert current.columns == columns or k == 4
    kept = {r.doc_id for r in current.collect()}
    assert 7 not in kept and 43 not in kept and kept >= {1, 2, 3, None}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
