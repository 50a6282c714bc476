"""Each method against brute force, an exact round trip, or held-out labels."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossweave.llm import attention_lm, bpe, common, decontam, licenses, line_crf, line_dedup, near_dup, queries, url_rules

RANKS = bpe.load_ranks(bpe.TOKENIZER)
CODEC = bpe.Codec(RANKS, leaf=16)
PLAIN = tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = st.lists(st.sampled_from(["the", " the", "  ", "\n", "\n\n ", "'s", "'", "l", "'ll", "12", "345", "é", "ß", "…", "!!", "\t", "　", "😀", "a", "Zz", "_"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_tree_encodes_as_the_library(text):
    ids = CODEC.encode(text)
    assert ids == PLAIN.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=30).map(lambda t: t.encode("utf-8", "ignore")), max_size=8))
def test_word_hashes_tell_words_apart(texts):
    words = [w for t in texts for w in t.lower().split()]
    h, ends = common.word_hashes(texts) if texts else (np.zeros(0), np.zeros(0))
    assert len(h) == len(words) and len(ends) == len(texts)
    assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))


def test_no_pattern_makes_two_words_alike():
    word = "a"
    for _ in range(13):
        other = word.translate(str.maketrans("ab", "ba"))
        a, b = common.word_hashes([f"{word} {other}".encode()])[0]
        assert a != b or word == other
        word += other
    short = [bytes((x, y)) * k for x in b"abyz" for y in b"abyz" for k in (1, 2, 4, 8, 16, 60, 64, 65, 70)]
    h = common.word_hashes([b" ".join(short)])[0].tolist()
    assert len(set(h)) == len(set(short))


def test_words_of_a_text_in_slices(monkeypatch):
    text = b"Word " * 50 + b"longer-than-a-slice" * 9 + b"\n\tlast one"
    want = common.word_hashes([text, b"b"])
    monkeypatch.setattr(common, "SLICE", 16)
    got = common.word_hashes([text, b"b"])
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist() == [53, 54]


def _turned_words(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [2048, 4096])
def test_documents_of_different_words_stay_apart(spark, n):
    one, two = _turned_words(n)
    rows = spark.createDataFrame([(1, one), (2, two), (3, f"{one} x y z"), (4, f"{two} x y z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(rows).collect()} == {(i, i) for i in (1, 2, 3, 4)}


def test_bpe_query(spark, sf_dir):
    import hashlib

    got = {r.doc_id: r for r in queries.op7_bpe(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = PLAIN.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_encode_and_decode(spark):
    docs = spark.createDataFrame([(1, "Größe, l'été!"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: bytes(r.data).decode() for r in bpe.decode(bpe.encode(docs)).collect()} == {1: "Größe, l'été!", 2: ""}


def _edit(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.random()
        if kind < 0.34:
            chars[at] = "q"
        elif kind < 0.67:
            del chars[at]
        else:
            chars.insert(at, "q")
    return "".join(chars)


def test_leaks_within_the_edit_budget_are_all_found():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(40))[: decontam.SEGMENT]) for i in range(20)]
    index = decontam.Index(items)
    budget = int(index.edits[0])
    for i, text in items:
        noise = [" ".join(word() for _ in range(50)) for _ in range(2)]
        found = index.search([noise[0] + " " + _edit(rng, text, rng.randint(0, budget)).upper() + " " + noise[1], noise[0], None, ""])
        assert [f[0] for f in found[0]] == [i] and found[0][0][3] <= budget
        assert found[1:] == [[], [], []]


def test_partial_leaks_are_found_at_every_offset():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    text, noise = " ".join(word() for _ in range(60))[:233], " ".join(word() for _ in range(30))
    index = decontam.Index([(7, text)])
    for size in (decontam.FINE + decontam.FINE_STEP - 1, 100, 120, 160):
        parts = [f"{noise} {text[a : a + size]} {noise}" for a in range(len(text) - size + 1)]
        assert all([f[0] for f in found] == [7] for found in index.search(parts)), size


def test_short_items_are_found_whole_and_exactly():
    index = decontam.Index([(1, "Who wrote it?"), (2, "forty-two"), (3, " \n"), (4, "x"), (5, "a question of thirty-nine characters ok")])
    found = index.search(["They asked: who\nwrote it? No.", "who wrote at?", "FORTY-TWO, forty-twos", "forty-twos", "ox x", "a question of thirty-nine characters ok", "a question of thirty-nine characters o", None, ""])
    assert [[f[0] for f in t] for t in found] == [[1], [], [2], [], [4], [5], [], [], []]
    assert found[0] == [(1, 12, 25, 0)]


def _semiglobal(pattern, text):
    """Fewest edits between a pattern and any part of a text, by plain dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_leaks_against_all_edits_of_all_segments(monkeypatch):
    """Neither more nor fewer: an item is found where some segment of it is within its budget of some part of the text."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(13, 40)))[: rng.randint(45, 150)]) for i in range(8)]
    index = decontam.Index(items)
    texts = []
    for _ in range(40):
        _, text = rng.choice(items)
        a = rng.randrange(max(1, len(text) - 70))
        part = text[a : a + rng.randint(60, 130)]
        texts.append(f"{word()} {_edit(rng, part, rng.randint(0, 7))} {' '.join(word() for _ in range(6))}")
    found = index.search(texts)
    monkeypatch.setattr(decontam, "_MANY", 20)  # counted in parts
    assert index.search(texts) == found
    near = 0
    for text, got in zip(texts, found, strict=True):
        want = set()
        for s, item in enumerate(index.item):
            if item not in want and _semiglobal("".join(map(chr, index.code[s])), text) <= index.edits[s]:
                want.add(item)
        assert {f[0] for f in got} == want
        near += bool(want)
    assert 10 < near < 40


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab-= ", min_size=1, max_size=9), st.integers(1, 60)), max_size=6))
def test_long_repeats_are_squeezed_by_whole_periods(parts):
    text = "".join(unit * n for unit, n in parts)
    code = decontam.plain(text)
    got, place = decontam.squeezed(code)
    if place is None:
        assert got is code
    else:
        assert (code[place] == got).all() and (np.diff(place) > 0).all() and len(got) < len(code)
    if parts and len(parts[0][0]) == 1:
        unit = parts[0][0]
        sizes = {len(decontam.squeezed(decontam.plain(unit * n))[0]) for n in (100, 1000, 12345)}
        assert len(sizes) == 1 and sizes.pop() <= decontam.KEEP + decontam.PERIOD


@pytest.mark.parametrize("unit", ["-", "- ", "=-*", " . .", "| --- ", "ab cd ef", "a line of some length that comes again\n"])
def test_texts_of_repeating_characters_take_little_time(unit):
    import time

    words = "some words of an item that stand before the rule and are telling enough on their own"
    index = decontam.Index([(1, (unit * 200)[:200]), (2, f"{words} {(unit * 100)[:100]} and some that come after it, as many or a few more"), (3, "- " * 90 + "-" * 90)])
    began = time.process_time()
    found = index.search([unit * (1_000_000 // len(unit)), f"{words} {unit * (4000 // len(unit))} and some that come after it", "no such text " * 9])
    assert time.process_time() - began < 2
    assert 1 in {f[0] for f in found[0]} and 2 in {f[0] for f in found[1]} and found[2] == []
    item, a, z, _ = next(f for f in found[1] if f[0] == 2)
    assert 0 <= a < z <= len(words) + 4040 + len(unit)


def test_a_benchmark_in_several_passes(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(12)] + [(50, "an exact short one")]
    docs = [(d, f"{word()} {items[d % 13][1]} {word()} {items[(d * 5) % 13][1]}") for d in range(20)] + [(99, None), (98, "nothing here")]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(tuple, decontam.leaks(docs, bench).collect()))
    assert len({i for _, i, *_ in once}) == 13
    monkeypatch.setattr(decontam, "PASS_CHARS", 300)
    assert len(list(decontam._indexes(bench))) > 4
    assert sorted(map(tuple, decontam.leaks(docs, bench).collect())) == once
    assert {r.doc_id for r in decontam.without_leaks(docs, bench).collect()} == {98, 99}


def test_leaks_query_holds_every_whole_item(spark, sf_dir, duck):
    want = set(map(tuple, duck.execute("select doc_id, item_id from documents d join benchmark b on contains(replace(lower(d.text), chr(10), ' '), replace(lower(b.text), chr(10), ' '))").fetchall()))
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontam(spark, sf_dir).collect()}
    assert want <= got


def test_license_query_against_all_windows(spark, sf_dir):
    import re

    words = lambda t: re.sub(rb"[^A-Za-z0-9\x80-\xff]", b" ", t.encode()).lower().split()
    templates = {n: words(t) for n, t in licenses.TEMPLATES.items()}
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        w = words(r.text)
        for name, t in templates.items():
            k = min(licenses.SHINGLE, len(t))
            own = {tuple(t[j : j + k]) for j in range(len(t) - k + 1)}
            at = [j for j in range(len(w) - k + 1) if tuple(w[j : j + k]) in own]
            if any(len({tuple(w[j : j + k]) for j in at if a <= j < a + len(t)}) >= licenses.CONTAINMENT * len(own) for a in at):
                want.add((r.doc_id, name))
    assert {(r.doc_id, r.license) for r in queries.op3_licenses(spark, sf_dir).collect()} == want


def test_edited_license_is_found():
    text = licenses.TEMPLATES["mit"].replace("sublicense", "SUBLICENCE").split()
    found = licenses.Scanner(licenses.TEMPLATES).scan([b"some words before " * 30 + " ".join(text).encode() + b" and after", b"nothing at all"])
    assert [(f[0], licenses.Scanner(licenses.TEMPLATES).names[f[1]]) for f in found] == [(0, "mit")]
    assert found[0][2] == 90


def test_of_many_copies_of_a_license_none_overlaps_another():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    notice, name = licenses.TEMPLATES["gpl-3.0-notice"], scanner.names.index("gpl-3.0-notice")
    size = len(notice.replace("-", " ").split())
    text = "first " + " ".join(f"{notice} {' '.join(f'n{i}x{j}' for j in range(i % 5))}" for i in range(200))
    found = sorted(f[2:] for f in scanner.scan([text.encode()]) if f[1] == name)
    assert len(found) == 200 and all(f[2] == 1 and f[1] - f[0] == size for f in found)
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_rules_are_mined_from_whole_baskets(spark):
    names = "&".join(f"name{chr(97 + i)}=1" for i in range(11))
    urls = [(f"http://a.org/?{names}{'&bad=1' if i < 40 else ''}", i < 40) for i in range(80)] + [(f"http://a.org/?z{i % 2}", False) for i in range(20)]
    rules = {tuple(r["items"]): (r.verdict, r.confidence, r.support) for r in url_rules.mine(spark.createDataFrame(urls, "url string, block boolean")).collect()}
    verdict, confidence, support = rules["q:bad",]
    assert (verdict, confidence) == ("block", 1) and support == pytest.approx(0.4)


def test_mined_rules_against_counts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    from pyspark.sql import functions as F

    url = F.col("url")
    rows = pages.select("url", url_rules.tokens(url).alias("t"), url_rules.stated_rule(url_rules.host_of(url), url_rules.path_of(url)).alias("s")).collect()
    labelled = [(set(r.t), r.s.verdict) for r in rows if r.s]
    rules = url_rules.mine(spark.createDataFrame([(r.url, r.s.verdict == "block") for r in rows if r.s], "url string, block boolean"))
    found = rules.collect()
    assert found
    for r in found:
        fits = [v for t, v in labelled if set(r["items"]) <= t]
        assert r.support >= url_rules.MIN_SUPPORT - 1e-9
        assert r.confidence == pytest.approx(fits.count(r.verdict) / len(fits))
    best = {}
    for r in rows:
        fit = [(x.confidence, x.support, len(x["items"]), x.verdict) for x in found if set(x["items"]) <= set(r.t)]
        best[r.url] = max(fit)[3] if fit else None
    import hashlib

    got = {m.key: (m.mined, m.n) for m in url_rules.match(pages, rules).collect()}
    urls = Counter(r.url for r in rows)
    assert got == {hashlib.sha256(u.encode()).hexdigest(): (best[u], n) for u, n in urls.items()}


def test_mined_rules_are_all_rules(spark):
    from itertools import combinations

    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    urls = []
    for _ in range(200):  # tokens of nearly all URLs, of half and of few, and labels that follow some of them
        own = [w for w, share in zip(words, (0.97, 0.93, 0.5, 0.3, 0.1), strict=True) if rng.random() < share]
        urls.append((f"http://www.site.org/{'/'.join(own)}/x", "gamma" in own and rng.random() < 0.9 or "eps" in own))
    urls += [(None, True), ("http://www.site.org/alpha", None)]
    labelled = [(set(u.split("/")[3:]) & set(words), b) for u, b in urls if u is not None and b is not None]
    want = {}
    for k in range(1, 6):
        for items in combinations(words, k):
            fits = [b for t, b in labelled if set(items) <= t]
            for block in (True, False):
                hits = fits.count(block)
                if hits >= 0.02 * len(labelled) and hits / len(fits) >= 0.8:
                    want[tuple(sorted(f"p:{x}" for x in items)), "block" if block else "allow"] = (hits / len(labelled), hits / len(fits))
    got = {(tuple(r["items"]), r.verdict): (r.support, r.confidence) for r in url_rules.mine(spark.createDataFrame(urls, "url string, block boolean")).collect()}
    assert set(got) == set(want) and len(want) > 5
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_base_score_against_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    words = lambda t: t.encode().lower().split()
    counts, ends = Counter(), 0
    for r in docs:
        if not out(r.doc_id):
            counts.update(words(r.text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = {r.doc_id: r for r in queries.op5_attention_lm(spark, sf_dir).collect()}
    for r in docs:
        g, w = got[r.doc_id], words(r.text)
        base = sum(np.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(counts[x] for x in w), ends])
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, out(r.doc_id))
        assert g.base_score == pytest.approx(base) and g.score < 0


def _trained(rng, n_ids=30, texts=20, steps=40):
    seqs = [rng.integers(0, n_ids, rng.integers(0, 120)) for _ in range(texts)]
    counts = np.bincount(np.concatenate(seqs), minlength=n_ids + 1).astype(float)
    counts[-1] = len(seqs)
    model = attention_lm.starting(counts)
    gain = {k: np.full_like(v, 1e-4) for k, v in model.w.items()}
    rows = np.concatenate([attention_lm.records(s, attention_lm.drawn(i, -(-(len(s) + 1) // attention_lm.HOP), 1)[0], n_ids) for i, s in enumerate(seqs)])
    attention_lm.train(model, gain, rows, 0, steps, 1)
    return seqs, counts, model


def _plain_attention(m, ids, n_ids):
    """log10 probability of every id at every place of a text, by loops over places and masked attention over one window each."""
    w, out = m.w, []
    for t in range(len(ids) + 1):
        start = t // attention_lm.HOP * attention_lm.HOP - attention_lm.CONTEXT - 1
        place = t - start - 1  # of the last input, in its window
        window = [n_ids if start + k < 0 else int(ids[start + k]) for k in range(place + 1)]
        e = [w["E"][m.spot[i]].astype(float) for i in window]
        q = e[-1] @ w["Q"] / np.sqrt(attention_lm.WIDTH)
        pull = np.array([q @ (x @ w["K"]) + w["B"][place - attention_lm.CONTEXT, k] for k, x in enumerate(e)])
        share = np.exp(pull - pull.max()) / np.exp(pull - pull.max()).sum()
        hid = e[-1] + sum(s * (x @ w["V"]) for s, x in zip(share, e, strict=True))
        g = hid + np.maximum(hid @ w["1"] + w["b1"], 0) @ w["2"]
        kinds = np.exp(g @ w["C"] + w["bc"])
        p = np.empty(n_ids + 1)
        for c, (a, z) in enumerate(zip(m.first[:-1], m.first[1:], strict=True)):
            own = np.exp(g @ w["O"][a:z].T + w["bo"][a:z])
            p[a:z] = kinds[c] / kinds.sum() * own / own.sum()
        out.append(np.log10(p[m.spot]))
    return np.array(out)


def test_scores_are_those_of_plain_masked_attention():
    rng = np.random.default_rng(3)
    n_ids = 30
    seqs, _, model = _trained(rng, n_ids)
    seqs += [np.zeros(0, int), rng.integers(0, n_ids, 24), rng.integers(0, n_ids, 23)]
    got = attention_lm.score_ids(attention_lm.folded(model), seqs)
    for s, score in zip(seqs, got, strict=True):
        plain = _plain_attention(model, s, n_ids)
        assert np.allclose((10**plain).sum(axis=1), 1, atol=1e-4)
        assert len(plain) == len(s) + 1  # each token once, and the end
        assert score == pytest.approx(plain[np.arange(len(s) + 1), [*s, n_ids]].sum(), rel=1e-3)


def test_each_token_is_a_target_once():
    rng = np.random.default_rng(8)
    for n in [0, 1, 22, 23, 24, 25, 47, 48, 300]:
        s = rng.integers(0, 9, n)
        _, want, _ = attention_lm.stream([s], 9, 9)
        assert want[want >= 0].tolist() == [*s, 9]
        rows = attention_lm.records(s, attention_lm.drawn(5, -(-(n + 1) // attention_lm.HOP), 1)[0], 9)
        targets = rows[:, attention_lm.CONTEXT + 1 :].ravel()
        assert targets[targets <= 9].tolist() == [*s, 9]


def test_texts_scored_together_or_alone_score_alike():
    seqs, _, model = _trained(np.random.default_rng(3))
    scorer = attention_lm.folded(model)
    together = attention_lm.score_ids(scorer, seqs)
    alone = np.array([attention_lm.score_ids(scorer, [s])[0] for s in seqs])
    assert np.allclose(together, alone, rtol=1e-4)


def test_training_learns_what_follows(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    n_ids = 40
    step = lambda x: (3 * x + rng.integers(0, 2)) % n_ids
    seqs = []
    for _ in range(300):
        s = [int(rng.integers(0, n_ids))]
        while len(s) < 60:
            s.append(int(step(s[-1])))
        seqs.append(np.array(s))
    kind = attention_lm.id_type(n_ids)
    tokens = spark.createDataFrame([(i, i % 10 == 0, len(s), bytearray(s.astype(kind).tobytes())) for i, s in enumerate(seqs)], "doc_id long, held_out boolean, n_ids long, ids binary")
    counts, windows, shards = attention_lm.gathered(tokens, n_ids)
    trained = [s for i, s in enumerate(seqs) if i % 10]
    assert counts.tolist() == [*np.bincount(np.concatenate(trained), minlength=n_ids), len(trained)] and shards == 1
    assert windows.agg(F.sum(F.length("data"))).first()[0] == len(trained) * 3 * (attention_lm.WINDOW + 1) * 2
    held = seqs[::10]
    before = attention_lm.score_ids(attention_lm.folded(attention_lm.starting(counts)), held).sum()
    after = attention_lm.score_ids(attention_lm.folded(attention_lm.fit(counts, windows, 1)), held).sum()
    assert before / (61 * len(held)) < -1.5 and after / (61 * len(held)) > -0.6  # one of two follows: 0.30 at best, and the first one is free


def test_shards_are_averaged_and_what_trains_grows_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "LEAST", 64)
    monkeypatch.setattr(attention_lm, "SHARD", 32)
    monkeypatch.setattr(attention_lm, "_FAN", 2)
    rng, n_ids = np.random.default_rng(4), 12
    sizes = []
    for n in (100, 2000):
        seqs = [np.repeat(rng.integers(0, n_ids, 12), 6) for _ in range(n)]
        kind = attention_lm.id_type(n_ids)
        tokens = spark.createDataFrame([(i, False, len(s), bytearray(s.astype(kind).tobytes())) for i, s in enumerate(seqs)], "doc_id long, held_out boolean, n_ids long, ids binary")
        counts, windows, shards = attention_lm.gathered(tokens, n_ids)
        sizes.append(sum(len(r.data) for r in windows.collect()) // (2 * (attention_lm.WINDOW + 1)))
    assert 30 < sizes[0] < 110 and 150 < sizes[1] < 360 and shards > 4
    one = attention_lm.score_ids(attention_lm.folded(attention_lm.starting(counts)), seqs[:50]).sum()
    assert attention_lm.score_ids(attention_lm.folded(attention_lm.fit(counts, windows, shards)), seqs[:50]).sum() > one


def test_every_window_of_the_training_part_trains(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "LEAST", 64)  # far fewer than there are
    monkeypatch.setattr(attention_lm, "fit", lambda counts, windows, shards: trained.append(windows.toPandas()) or attention_lm.starting(counts))
    trained = []
    docs = spark.range(300).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> concat('word', id % 7 + x))) text")
    assert attention_lm.score(docs).count() == 300
    rows = np.frombuffer(b"".join(trained[0].data), "<u2").reshape(-1, attention_lm.WINDOW + 1)
    targets = rows[:, attention_lm.CONTEXT + 1 :].ravel()
    ranks = bpe.load_ranks(bpe.TOKENIZER)
    encoding = attention_lm.Tokens("all", ranks).encoding
    ids = [encoding.encode(r.text) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 10]
    assert (targets <= max(ranks.values()) + 1).sum() == sum(len(i) + 1 for i in ids)  # each token once, and each text's end


def test_each_record_moves_to_its_shard_once(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "LEAST", 64)
    monkeypatch.setattr(attention_lm, "SHARD", 512)
    rng, n_ids = np.random.default_rng(6), 50
    kind = attention_lm.id_type(n_ids)
    seqs = [rng.integers(0, n_ids, rng.integers(0, 200)) for _ in range(400)]
    tokens = spark.createDataFrame([(i, False, len(s), bytearray(s.astype(kind).tobytes())) for i, s in enumerate(seqs)], "doc_id long, held_out boolean, n_ids long, ids binary")
    _, windows, shards = attention_lm.gathered(tokens, n_ids, 1)
    cells = Counter()
    for r in windows.collect():
        for row in np.frombuffer(r.data, kind).reshape(-1, attention_lm.WINDOW + 1):
            cells[r.shard, r.turn, tuple(row.tolist())] += 1
    want = Counter()
    for i, s in enumerate(seqs):
        chosen, number = attention_lm.drawn(i, -(-(len(s) + 1) // attention_lm.HOP), 1)
        for x, row in zip(number.tolist(), attention_lm.records(s, chosen, n_ids).tolist(), strict=True):
            want[x % shards, x // shards % attention_lm.ROUNDS, tuple(row)] += 1
    assert shards > 1 and cells == want
    assert {t for _, t, _ in cells} == set(range(attention_lm.ROUNDS))
    # A round's plan reads and shuffles the records of its own turn alone.
    plan = windows.where("turn = 1 or turn is null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_words_of_a_pattern_are_told_apart_by_the_unigram(spark):
    one, two = _turned_words(2048)
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10]
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = attention_lm.score(spark.createDataFrame([(ids[0], f"{one} word"), (out, two)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known) for r in got} == {(ids[0], 3, 3), (out, 2, 1)}


def test_forward_backward_against_all_labelings():
    rng = np.random.default_rng(0)
    ends = np.array([1, 4, 9])
    pull, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    p, pairs = line_crf.forward_backward(pull, moves, ends)
    want, seen = np.zeros(9), np.zeros((2, 2))
    for a, b in ((0, 1), (1, 4), (4, 9)):
        weights = []
        for code in range(2 ** (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            weights.append((np.exp(sum(pull[a + k] * v for k, v in enumerate(y)) + sum(moves[y[k], y[k + 1]] for k in range(len(y) - 1))), y))
        total = sum(w for w, _ in weights)
        for w, y in weights:
            want[a:b] += w / total * np.array(y)
            for k in range(len(y) - 1):
                seen[y[k], y[k + 1]] += w / total
    assert np.allclose(p, want) and np.allclose(pairs, seen)


def test_the_fit_is_bounded_whatever_is_labelled(spark):
    """A labelled text of many lines is not fitted on, and copies of one id neither gather on the driver nor change the fit."""
    import time

    from glossweave.llm.common import crc_bucket

    ids = [r.i for r in spark.range(60).select(F.col("id").alias("i"), crc_bucket(F.col("id"), 5).alias("c")).where("c <> 0").collect()]
    rows = [(i, "A good line of words, as they are.\nAnd one more of them." if i % 2 else "@@ ## $$ 11\n|| == 99 !!") for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    line_crf.train(plain, labels)  # what starts at first use
    want = line_crf.train(plain.where(F.col("doc_id") != ids[0]), labels)
    copies = spark.range(100_000).select(F.lit(ids[1]).alias("doc_id"), F.lit(dict(rows)[ids[1]]).alias("text"))
    hard = plain.where(F.col("doc_id") != ids[0]).union(spark.createDataFrame([(ids[0], "\n" * 99_999)], "doc_id long, text string")).union(copies)
    began = time.monotonic()
    got = line_crf.train(hard, labels)
    assert time.monotonic() - began < 10
    assert np.allclose(got.weights, want.weights) and np.allclose(got.moves, want.moves)
    assert (line_crf.FIT_ROWS, line_crf.FIT_LINES) == (2000, 500)


def test_no_more_lines_than_stated_are_fitted_on(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(line_crf, "FIT_ALL_LINES", 25)
    monkeypatch.setattr(line_crf, "fit", lambda x, n, ends, y: fitted.append((len(x), len(ends))))
    docs = spark.createDataFrame([(i, "a\nb\nc") for i in range(1, 60)], "doc_id long, text string")
    line_crf.train(docs, spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int"))
    assert fitted == [(24, 8)]


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op9_line_crf(spark, d).where("held_out").toPandas()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.95
    assert both.score.between(0, 1).all()


def _pairs(a, b):
    """Of each line of a that b has: its place, b's first one, and whether both have it once."""
    return tuple(np.array(x, int) for x in zip(*[(i, b.index(x), a.count(x) == 1 == b.count(x)) for i, x in enumerate(a) if x in b], strict=True)) or (np.zeros(0, int),) * 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=14), st.lists(st.integers(0, 12), max_size=14))
def test_patience_aligns_unique_lines_in_order_and_what_follows_them(a, b):
    i, j, unique = _pairs(a, b)
    aligned = line_dedup.patience(i, j, unique == 1)
    at = j[unique == 1].tolist()
    longest: list = []  # of the chain that ends at each unique line
    for k, q in enumerate(at):
        longest.append(1 + max((n for n, r in zip(longest, at[:k], strict=True) if r < q), default=0))
    assert line_dedup.chain(i[unique == 1], j[unique == 1]).sum() == max(longest, default=0) <= (aligned & (unique == 1)).sum()
    for p, q in zip(i[aligned], j[aligned], strict=True):
        assert a[p] == b[q]
        near = {(p + k, q + k) for k in range(-14, 15)} & set(zip(i.tolist(), j.tolist(), strict=True))
        assert any(u for p2, q2, u in zip(i, j, unique, strict=True) if (p2, q2) in near)
    if a == b and len(set(a)) == len(a):
        assert aligned.all()


def _without_repeats(texts, least):
    """Brute force: lines with words in a run of as many words that one earlier document holds as a run."""
    full = {d: [x.strip() for x in lines if x.strip()] for d, lines in texts.items()}
    out = {}
    for d, lines in full.items():
        held = {tuple(e[a:z]) for o, e in full.items() if o < d for a in range(len(e)) for z in range(a + 1, len(e) + 1)}
        gone = set()
        for a in range(len(lines)):
            for z in range(a + 1, len(lines) + 1):
                if tuple(lines[a:z]) in held and sum(len(x.split()) for x in lines[a:z]) >= least:
                    gone.update(range(a, z))
        at = [i for i, x in enumerate(texts[d]) if x.strip()]
        out[d] = "\n".join(x for i, x in enumerate(texts[d]) if i not in {at[k] for k in gone})
    return out


@pytest.mark.parametrize(("seed", "rare"), [(0, 64), (1, 64), (2, 2), (3, 0)])
def test_line_dedup_against_brute_force(spark, monkeypatch, seed, rare):
    monkeypatch.setattr(line_dedup, "RARE", rare)
    rng = random.Random(seed)
    pool = [" ".join(f"l{k}w{i}" for i in range(rng.randint(1, 14))) for k in range(12)]
    texts = {}
    for d in range(60):
        if d % 3 == 2:  # a copy of an earlier text, cut, turned or put together anew
            e = list(texts[rng.choice(list(texts))])
            a = rng.randrange(len(e) + 1)
            texts[d] = rng.choice([e, e[a:] + e[:a], e[::-1], e + e, e[a:]]) or ["x"]
        else:
            texts[d] = [rng.choice([*pool, *pool, "", f"own {d} {k}"]) for k in range(rng.randint(1, 14))]
    rows = spark.createDataFrame([(d, "\n".join(x)) for d, x in texts.items()], "doc_id long, text string")
    assert {r.doc.doc_id: r.new_text for r in line_dedup.dedup_lines(rows).collect()} == _without_repeats(texts, line_dedup.MIN_WORDS)


def test_lines_of_several_documents_make_no_common_block(spark):
    line = lambda name: " ".join(f"{name}w{i}" for i in range(12))
    turned = [line(f"t{k}") for k in range(6)]
    texts = {1: [line("a")], 2: [line("b")], 3: [line("c")], 4: turned, 9: [line("a"), line("b"), line("c")], 10: [*turned[::-1]]}
    rows = spark.createDataFrame([(d, "\n".join(x)) for d, x in texts.items()], "doc_id long, text string")
    assert {r.removed_words for r in line_dedup.dedup_lines(rows).collect()} == {0}


def test_alignment_of_turned_lines_takes_little_time():
    import time

    n = np.arange(40_000)
    began = time.process_time()
    assert not len(line_dedup.common_blocks(n, n[::-1], n >= 0, np.full(len(n), 12), 30))
    assert time.process_time() - began < 5
    assert line_dedup.common_blocks(n + 1, n + 1, n >= 0, np.full(len(n), 12), 30).tolist() == (n + 1).tolist()


def _passages():
    line = lambda name, k: " ".join(f"{name}{k}w{i}" for i in range(12))
    texts = {}
    for d in range(1, 31):
        own = [line(f"own{d}x", k) for k in range(4)]
        first = texts.get(d - 10) if d <= 20 else texts.get(d - 20)
        texts[d] = [*own, *([*first[1:4], own[0] + " again", *first[5:9]] if first and d % 3 else [line(f"new{d}x", k) for k in range(9)]), "", f"end of {d}"]
    return texts


def test_alignment_decides_and_windows_get_what_it_leaves_open(spark, monkeypatch):
    """Passages in their order are settled by alignment alone; without it everything would be left to windows."""
    texts = _passages()
    rows = spark.createDataFrame([(d, "\n".join(x)) for d, x in texts.items()], "doc_id long, text string")
    want, posted = _without_repeats(texts, line_dedup.MIN_WORDS), []
    cut = line_dedup.cut

    def counted(df):
        out = cut(df)
        if out.columns == ["doc_id", "text_key", "a", "z", "t", "u"]:
            posted.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "cut", counted)
    assert {r.doc.doc_id: r.new_text for r in line_dedup.dedup_lines(rows).collect()} == want
    assert posted == [] and sum(len(w) < len("\n".join(texts[d])) for d, w in want.items()) > 10
    # What moved is left open, and found by windows of the lines around it only.
    moved = {**texts, 40: [*texts[1][3:6], "a line between", *texts[1][0:3]], 41: [*texts[2][2:8]]}
    rows = spark.createDataFrame([(d, "\n".join(x)) for d, x in moved.items()], "doc_id long, text string")
    assert {r.doc.doc_id: r.new_text for r in line_dedup.dedup_lines(rows).collect()} == _without_repeats(moved, line_dedup.MIN_WORDS)
    assert len(posted) == 1 and 0 < posted[0] < 60
    monkeypatch.setattr(line_dedup, "RARE", 0)
    posted.clear()
    rows = spark.createDataFrame([(d, "\n".join(x)) for d, x in texts.items()], "doc_id long, text string")
    assert {r.doc.doc_id: r.new_text for r in line_dedup.dedup_lines(rows).collect()} == want
    assert posted[0] > 100


def test_a_long_document_whose_lines_many_share_costs_linear_rows(spark, monkeypatch):
    rng = random.Random(6)
    lines = [" ".join(f"{k}w{i}" for i in range(31)) for k in range(3000)]
    texts = [(0, "\n".join(lines))] + [(d, "\n".join([f"own {d}", *(lines[k] for k in rng.sample(range(3000), 5))])) for d in range(1, 400)]
    sizes, cut = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df: (lambda out: (sizes.append(out.select(F.sum(F.size("m"))).first()[0]) if "m" in out.columns else None, out)[1])(cut(df)))
    got = {r.doc.doc_id: r.removed_words for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {0: 0} | {d: 5 * 31 for d in range(1, 400)} and sizes == [399 * 5]


def test_repeated_passages_go_from_later_documents(spark):
    passage = "\n".join(" ".join(f"p{k}w{i}" for i in range(20)) for k in range(3))
    own = lambda d: f"intro of {d}\n", lambda d: f"\nclosing words of {d}"
    rows = [(5, own[0](5) + passage + own[1](5)), (2, own[0](2) + passage + own[1](2)), (9, own[0](9) + "short shared line" + own[1](9)), (3, own[0](3) + "short shared line" + own[1](3))]
    got = {r.doc.doc_id: (r.new_text, r.removed_words) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == (dict(rows)[2], 0) and got[9] == (dict(rows)[9], 0)
    assert got[5] == ("intro of 5\nclosing words of 5", 60)


def test_passages_repeated_inside_one_document_go_too(spark):
    line = lambda name, n: " ".join(f"{name}w{i}" for i in range(n))
    p, r = [line("p0", 20), line("p1", 3), line("p2", 20)], [line("r0", 12), line("r1", 12), line("r2", 12)]
    texts = {
        1: ["u1", *p, "v1", *p, "w1"],
        2: ["u2", r[0], "x2", r[0], "y2", r[1], "v2", r[1], "w2"],
        3: ["u3", r[1], "x3", r[2], "v3", r[1], "z3", r[2], "w3", r[0], "q3"],
        4: ["u4", *r, "v4", *r, "w4"],
        5: ["u5", *p, "v5"],
        6: ["u6", *p, "v6", *p, "w6", *p, "x6"],
        7: ["u7", *r, "v7"],
        8: ["u8", p[0], "v8", p[2], "w8"],
    }
    rng = random.Random(8)
    for d in range(10, 40):
        texts[d] = [x for k in range(rng.randint(1, 4)) for x in (f"o{d} {k}", *(p if rng.random() < 0.5 else r)[rng.randint(0, 1) : rng.randint(2, 3)])] + [f"end {d}"]
    want = {}
    for d, lines in texts.items():
        held = {tuple(e[a:z]) for o, e in texts.items() if o < d for a in range(len(e)) for z in range(a + 1, len(e) + 1)}
        gone = set()
        for a in range(len(lines)):
            for z in range(a + 1, len(lines) + 1):
                if tuple(lines[a:z]) in held and sum(len(x.split()) for x in lines[a:z]) >= line_dedup.MIN_WORDS:
                    gone.update(range(a, z))
        want[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert want[5] == "u5\nv5" and want[6] == "u6\nv6\nw6\nx6" and want[7] == "u7\nv7" and "r0w1" in want[4]
    rows = spark.createDataFrame([(d, "\n".join(x)) for d, x in texts.items()], "doc_id long, text string")
    assert {r.doc.doc_id: r.new_text for r in line_dedup.dedup_lines(rows).collect()} == want


@pytest.mark.parametrize("tile", [4, near_dup.TILE])
def test_near_duplicates_of_five_words_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(near_dup, "TILE", tile)
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(80)] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(76)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {i: (find(i), find(i) == i) for i in sets}

    # One family, its smallest documents leading: all links come from the tiles.
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    leading = [i for i in sets if find(i) == 0]
    members = spark.createDataFrame([(i, 0, 0 if i in leading else i, 76) for i in sets], "doc_id long, family long, component long, high long")
    links = near_dup._within_families(members, texts, 5, 80).collect()
    linked = [(r.a, r.b) for r in links] + [(0, i) for i in leading]
    found = {r.id: r.component for r in near_dup.components(spark.createDataFrame(linked, "a long, b long")).collect()}
    assert {i: found.get(i, i) for i in sets} == {i: find(i) for i in sets}


@pytest.mark.parametrize("in_one_task", [0, 1_000_000])
def test_components(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(common, "TASK_LINKS", in_one_task)
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {r.id: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, d)
        assert out.columns == docs.columns, name
        assert out.count() <= rows.count()
        rows = out
    got = corpus_pipeline.run(spark, d)
    assert got.count() == rows.count() == got.select("doc_id").distinct().count()
