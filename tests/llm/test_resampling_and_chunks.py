"""Importance resampling, centroid clustering and fingerprints against brute force, and with odd input."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossweave.llm import centroids, fingerprints, importance, queries
from glossweave.llm.fingerprints import as_set, containment, digests, ends, parsed, written

DOCS = "doc_id long, text string, rank string, score double, part long, v binary"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1.0, 2, b"") for i, t in rows], DOCS)


# --- importance resampling


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _features(text, runs=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


def _resampled(docs, target, percent=10, least=20, runs=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw, wanted = ([bucket(f) for t in texts for f in _features(t, runs)[1]] for texts in ([t for _, t in docs], target))
    s, t = np.bincount(raw, minlength=buckets), np.bincount(wanted, minlength=buckets)
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * (len(raw) + buckets) / (float(s[b] + 1) * (len(wanted) + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        n, f = _features(text, runs)
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append((doc_id, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    ranks = {}
    for r, x in enumerate(order[: percent * len(order) // 100], 1):
        ranks.setdefault(x, []).append(r)
    rows = []
    for x in sorted(out, key=str):
        rows.append((x[0], *x[2:], ranks[x].pop(0) if ranks.get(x) else None))
    return sorted(rows, key=str)


def _rows(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_of_odd_rows_against_brute_force(spark):
    rng = random.Random(4)
    names = ["Alpha", "beta-Gamma", "7up", "naïve", "Ünal", "kana かな", "x_y", "\u0000z", "İ"]
    docs = [(i, " ".join(rng.choices(names, k=rng.randrange(0, 60)))) for i in range(120)] + [(None, "alpha " * 30), (None, "alpha " * 30), (5, "gamma " * 25), (7, None), (8, ""), (9, " - _ \n"), (2**63 - 1, "alpha " * 21), *[(500, "alpha beta " * 20)] * 7, (600, "word " * 40_000)]
    target = ["alpha alpha beta", None, "", "naïve 7up 7UP"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for percent, least, runs in ((10, 20, 1), (100, 0, 1), (50, 3, 2), (0, 20, 1)):
        got = importance.resample(_docs(spark, docs), bench, percent, least, runs, buckets=97)
        assert _rows(got) == _resampled(docs, target, percent, least, runs, buckets=97)
    assert [r.dataType.simpleString() for r in got.schema] == ["bigint"] * 5


def test_resampling_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert importance.resample(_docs(spark, []), bench).count() == 0
    docs = [(i, "a b c d " * 6) for i in range(20)]
    assert _rows(importance.resample(_docs(spark, docs), bench.limit(0))) == _resampled(docs, [])


def test_words_across_slices(monkeypatch):
    text = "Ab1 c" * 300
    whole = [x.tolist() for _, x in importance.features(text, 3)]
    monkeypatch.setattr(importance, "SLICE", 7)
    parts = [x.tolist() for _, x in importance.features(text, 3)]
    assert len(parts) > 50 and sorted(sum(parts, [])) == sorted(sum(whole, [])) and sum(n for n, _ in importance.features(text, 3)) == 301


def test_ties_go_to_smaller_ids_and_repeats_get_ranks_of_their_own(spark):
    rows = [(i, 1, 0, s) for i, s in [(4, 10), (3, 10), (None, 10), (3, 10), (9, 11), (1, 9), (2, 9)]]
    scored = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long")
    got = sorted((r["rank"], r.doc_id) for r in importance.ranked(scored, 6).collect() if r["rank"])
    assert got == [(1, 9), (2, 3), (3, 3), (4, 4), (5, None), (6, 1)]
    assert importance.ranked(scored, 0).where("rank is not null").count() == 0


# --- centroid clustering


def _clustered(rows, k=16, rounds=3, dim=64, scale=64, seed=1):
    kept = [(i, tuple(math.floor(Fraction(x) * scale) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: ("z" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), centroids.pack(list(r[1]))))
    at = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        at = [tuple(sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)) if n in groups else c for n, c in enumerate(at)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, c, d in out:
        inertia[c] = inertia.get(c, 0) + d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, c, d in out), key=str)


def _found(spark, rows, kind="float", **more):
    frame = spark.createDataFrame([(i, v, 0, b"x", "y") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, v binary, n string")
    return sorted((tuple(r) for r in centroids.cluster(frame, **more).collect()), key=str)


def test_clusters_against_brute_force(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in draw.standard_normal(64) / 8]) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(7, rows[7][1]), (7, rows[7][1]), (None, rows[9][1]), (None, rows[11][1]), (2**62 + 1, rows[12][1])]
    odd = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [1.0] * 63 + [None]), (205, [float("nan")] + [1.0] * 63), (206, [float("-inf")] + [1.0] * 63)]
    got = _found(spark, rows + odd)
    assert got == _clustered(rows) and len(got) == len(rows)


def test_few_vectors_and_ties(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([1, -1, 1, -1, 0, 0, 3])]
    for k in (1, 2, 3, 16):
        assert _found(spark, rows, k=k, dim=2) == _clustered(rows, k=k, dim=2)
    assert _found(spark, []) == [] and _found(spark, [(1, [1.0])]) == []
    assert _found(spark, [(None, [1.0, 2.0])], dim=2) == _clustered([(None, [1.0, 2.0])], dim=2)


def test_components_of_any_size(spark):
    rows = [(0, [1e4, 1.0]), (1, [-1e4, 3.0]), (2, [1e5, 0.5]), (3, [1e5 + 1, 0.25]), (4, [2.0**24, 0.0]), (5, [-(2.0**24), 1.0]), (6, [0.1, 0.2]), (7, [600.0, 3.0])]
    for k in (2, 3, 8):
        assert _found(spark, rows, "double", k=k, dim=2) == _clustered(rows, k=k, dim=2)
    huge = [(0, [1e30, 1.0]), (1, [-1e300, 2.0]), (2, [1.5e308, 0.0]), (3, [0.0, 0.0])]
    assert _found(spark, huge, "double", dim=2) == _clustered(huge, dim=2)  # each is a centroid of its own
    with pytest.raises(Exception, match="fits no long"):
        _found(spark, huge, "double", dim=2, k=1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(-200, 200), st.integers(-(2**70), 2**70), st.sampled_from([127, 128, -128, -129, 2**15, -(2**15), 2**31, 2**63, -(2**63)])), min_size=1, max_size=6))
def test_packed_vectors_come_back(v):
    assert [int(x) for x in centroids.unpack([centroids.pack(v)], len(v))[0]] == v


def test_packing_in_bulk_is_packing_one_by_one(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([0, 1.99, 2, -2, -2.01, 511.9, -512, 512, 1e9, 1e17])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: bytes(r.v) for r in centroids.quantised(frame, dim=2).collect()}
    assert got == {i: centroids.pack([math.floor(x * 64) for x in v]) for i, v in rows}


# --- fingerprints


def _plain_ends(text):
    """Chunk ends by the rule, a byte at a time."""
    out, begin = [], 0
    h = lambda p: sum(int(fingerprints._GEAR[text[p - 1 - j]]) << j for j in range(min(16, p))) & 0xFFFFFFFF
    while begin < len(text):
        p = begin + fingerprints.LEAST
        while p < min(begin + fingerprints.MOST, len(text)) and h(p) & int(fingerprints.HARD if p < begin + fingerprints.NORMAL else fingerprints.EASY):
            p += 1
        begin = min(p, begin + fingerprints.MOST, len(text))
        out.append(begin)
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1500), st.sampled_from([7, 16, 100, 1 << 20]))
def test_chunk_ends_by_the_rule(text, size):
    was, fingerprints.SLICE = fingerprints.SLICE, size
    try:
        cuts = ends(text)
        assert cuts == _plain_ends(text)
        for k in range(0, len(cuts), 3):
            assert ends(text, cuts[k]) == cuts[k + 1 :]
    finally:
        fingerprints.SLICE = was


def _print(text):
    raw = (text or "").encode("utf-8", "surrogatepass")
    return as_set(digests(raw, ends(raw)))


def test_an_insertion_changes_the_chunks_around_it_only():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(4000))
    a, b = _print(text), _print(text[:9000] + "inserted words" + text[9000:])
    assert 0.985 < containment(a, b) < 1 and 0.985 < containment(b, a) < 1
    assert containment(a, a) == 1 and containment(a, _print("")) == 0 and containment(_print(""), _print("")) == 1 and containment(_print(""), a) == 0
    # Bytes that repeat count as often as they do, though their digests are kept once.
    lines = _print("one line of the many that repeat\n" * 50 + "and one that does not, at the end of the text")
    assert len(lines) < 10 and lines["length"].sum() == 50 * 33 + 45
    half = containment(a, _print(text[: len(text) // 2]))
    assert 0.49 < half < 0.51 and containment(_print(text[: len(text) // 2]), a) > 0.99
    assert (parsed(written(a)) == a).all() and len(written(a)) == 16 * len(a)
    size = np.diff([0, *ends(text.encode())])
    assert size[:-1].min() >= fingerprints.LEAST and size.max() <= fingerprints.MOST and 40 < size.mean() < 55


def _compared(rows):
    """Brute force over rows in the documented order."""
    signed = lambda n: n - 2**64 if n >= 2**63 else n  # noqa: E731, F841
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, e = _print(text), _print(edited)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(a), written(e), containment(a, e), containment(a, _print(after))))
    return sorted(out, key=str)


def _in_order(spark, rows):
    from pyspark.sql import functions as F

    u = _docs(spark, rows).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("u")).collect()
    return [(r.doc_id, r.text) for r in sorted(u, key=lambda r: (-(2**63) if r.doc_id is None else r.doc_id, r.u), reverse=True)]


@pytest.mark.parametrize(("rows", "parts"), [(256, 20_000), (3, 20_000), (1, 5), (7, 1)])
def test_fingerprints_against_brute_force(spark, monkeypatch, rows, parts):
    monkeypatch.setattr(fingerprints, "PART_ROWS", rows)
    monkeypatch.setattr(fingerprints, "PARTS", parts)
    rng = random.Random(8)
    docs = [(rng.randrange(-50, 10**6), "".join(rng.choices("abc de é漢😀\n", k=rng.randrange(0, 400)))) for _ in range(60)]
    docs += [(77, f"same id {i} " * 20) for i in range(40)] + [(None, None), (None, "no id"), (5, ""), (6, None), (2**63 - 1, "x"), (docs[0][0], docs[0][1]), (docs[0][0], docs[0][1])]
    got = sorted((tuple(r) for r in fingerprints.compared(_docs(spark, docs)).collect()), key=str)
    assert got == _compared(_in_order(spark, docs))


def test_fingerprints_of_few_and_of_long_texts(spark):
    assert fingerprints.compared(_docs(spark, [])).count() == 0
    long = "".join(random.Random(3).choices("abcdefgh ", k=3_000_000))
    for docs in ([(1, "only one of some length, longer than a chunk")], [(1, None)], [(1, "a"), (2, long), (3, "ab" * 500_000)]):
        assert sorted((tuple(r) for r in fingerprints.compared(_docs(spark, docs)).collect()), key=str) == _compared(_in_order(spark, docs))


def test_fingerprint_query_against_brute_force(spark, sf_dir, duck):
    docs = duck.execute("select doc_id, text from documents order by doc_id desc").fetchall()
    got = sorted((tuple(r) for r in queries.op13_fingerprints(spark, sf_dir).collect()), key=str)
    assert got == _compared(docs)
    assert np.mean([g[5] - g[6] > 0.3 for g in got if g[1] >= 300]) > 0.99


def test_fingerprints_alone_and_as_columns(spark):
    from pyspark.sql import functions as F

    docs = _docs(spark, [(1, "one text of some words, and some more of them"), (2, None), (3, "one text of some words, and some more of them")])
    rows = fingerprints.fingerprints(docs)
    assert {r.doc_id: r.fingerprint for r in rows.collect()} == {1: written(_print(docs.first().text)), 2: "", 3: written(_print(docs.first().text))}
    both = rows.alias("a").join(rows.alias("b"), F.col("a.doc_id") < F.col("b.doc_id")).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), fingerprints.contained(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("c"))
    assert {(r.a, r.b): r.c for r in both.collect()} == {(1, 2): 0.0, (1, 3): 1.0, (2, 3): 0.0}
