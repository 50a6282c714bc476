"""Repeated passages: documents that share rare lines are aligned by patience diff, and common blocks go from the later one.

Every shared line names the smallest document that holds it, and where. A document and one with which it shares a rare line are a
pair; of a pair the lines that are unique in both are brought into the longest rising chain, each anchor of the chain grows along the
lines that follow it in both, and blocks of enough words are deleted from the later document. A line sends one row, however many
documents hold it, and the later document has all it needs to be aligned with each of its partners, so no document is sent to another.

What an alignment can't see (blocks that moved, lines that a third document held first, passages that no rare line names) is left
open, and lines are left open only there. For these, and for no others, windows find the rest exactly: the shortest runs of enough
words from each shared line on, and up to each one, that hold an open line. So the lines that go are those in a run of lines with
enough words that one earlier document holds as a run too, and no others.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, small_batches, utf8

#: Words of a run of common lines from which on it is deleted.
MIN_WORDS = 30
#: Times that a line may occur that is rare enough to make pairs. Windows find exactly what commoner lines make up.
RARE = 4096
#: Open lines that are broadcast, two numbers each; more of them are met by a shuffle.
FEW = 50_000
_KEY = "doc_id long, text_key long"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, h, g, words, once, n_lines): of each text's lines with words their places, two hashes, word counts, and whether the text has them once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, h, g, words, once, n = [], [], [], [], [], []
            for text in utf8(b.text):
                lines = text.split(b"\n")
                full = [(i, line.strip()) for i, line in enumerate(lines) if line and not line.isspace()]
                both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(line) for _, line in full), "<i8").reshape(-1, 2)
                at.append(np.array([i for i, _ in full], np.int32))
                h.append(both[:, 0])
                g.append(both[:, 1])
                words.append(np.array([len(line.split()) for _, line in full], np.int32))
                _, of, many = np.unique(both[:, 0], return_inverse=True, return_counts=True)
                once.append(many[of] == 1)
                n.append(len(lines))
            yield pd.DataFrame({"doc_id": b.doc_id, "text_key": b.text_key, "at": at, "h": h, "g": g, "words": words, "once": once, "n_lines": n})

    rows = small_batches(docs).where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInPandas(run, f"{_KEY}, at array<int>, h array<long>, g array<long>, words array<int>, once array<boolean>, n_lines int")


def _runs(marked: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """The marked lines that are in a run of neighbours with at least so many words together."""
    if not marked.any():
        return marked
    edge = np.diff(marked.astype(np.int8), prepend=0, append=0)
    total = np.concatenate(([0], np.cumsum(words)))
    out = np.zeros(len(marked), bool)
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out[a:b] = total[b] - total[a] >= least
    return out


def _windows(marked: np.ndarray, words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Of the marked lines' runs (first, last + 1) of at least so many words the shortest that begin, and that end, at each line.

    A run of as many words holds the one from its first line on, the one up to its last line, and between them all its lines.
    """
    out: set[tuple[int, int]] = set()
    edge = np.diff(marked.astype(np.int8), prepend=0, append=0)
    total = np.concatenate(([0], np.cumsum(words)))
    least = max(least, 1)
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        own = total[a : b + 1]
        first = np.arange(np.searchsorted(own, own[-1] - least, "right"))
        out.update(zip((first + a).tolist(), (np.searchsorted(own, own[first] + least) + a).tolist(), strict=True))
        end = np.arange(np.searchsorted(own, own[0] + least), len(own))
        out.update(zip((np.searchsorted(own, own[end] - least, "right") - 1 + a).tolist(), (end + a).tolist(), strict=True))
    return sorted(out)


def chain(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of places (i, j) of equal lines, i rising: which make up the longest chain in which j rises too."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, at in enumerate(j.tolist()):
        p = bisect_left(tops, at)
        back.append(ends[p - 1] if p else -1)
        tops[p : p + 1] = [at]
        ends[p : p + 1] = [k]
    out, k = np.zeros(len(j), bool), ends[-1] if ends else -1
    while k >= 0:
        out[k] = True
        k = back[k]
    return out


def patience(i: np.ndarray, j: np.ndarray, unique: np.ndarray) -> np.ndarray:
    """Which pairs of equal lines of two documents, (i, j) with i rising, a patience diff aligns; unique: lines that both have once.

    Anchors are the longest chain of unique lines; each grows along pairs whose lines follow each other in both documents.
    """
    anchor = np.zeros(len(i), bool)
    at = np.flatnonzero(unique)
    anchor[at[chain(i[at], j[at])]] = True
    run = np.cumsum(np.concatenate(([1], (np.diff(i) != 1) | (np.diff(j) != 1))))[: len(i)]
    return np.isin(run, run[anchor])


def common_blocks(i: np.ndarray, j: np.ndarray, unique: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Lines of the later document in aligned blocks, which follow each other in both documents, of at least so many words; words: of each pair's line."""
    aligned = patience(i, j, unique)
    i, j, words = i[aligned], j[aligned], words[aligned]
    if not len(i):
        return i
    block = np.cumsum(np.concatenate(([0], (np.diff(i) != 1) | (np.diff(j) != 1))))
    return i[np.bincount(block, words)[block] >= least]


def _shared(tokens: DataFrame) -> DataFrame:
    """The tokens (t, u, doc_id, ...) that more than one doc_id holds, with the smallest of these as `earlier`."""
    first = tokens.groupBy("t", "u").agg(F.min("doc_id").alias("earlier"), F.max("doc_id").alias("last"), F.count("*").alias("df"))
    return join_counted(tokens, cut(first.where("earlier < last").drop("last")), ["t", "u"], "df")


def _settle(min_words: int):
    """Of each text, with its shared lines: those that alignments delete, and those that may have to go but that none settles."""

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hits, left, t, u, df = [], [], [], [], []
            for words, h, g, i, e, ekey, ei, once, n in zip(b.words, b.h, b.g, b.i, b.e, b.ekey, b.ei, b.once, b.df, strict=True):
                words, order = np.asarray(words), np.argsort(i)
                i, e, ekey, ei, once, n = (np.asarray(x)[order] for x in (i, e, ekey, ei, once, n))
                later = np.zeros(len(words), bool)
                later[i] = True
                open_ = _runs(later, words, min_words)  # nothing else can be in a block
                found = [np.zeros(0, np.int64)]
                if open_.any():
                    partner = np.unique(np.stack((e, ekey)), axis=1, return_inverse=True)[1].ravel()
                    rare = np.bincount(partner, (n <= RARE) & open_[i]) > 0
                    by = np.argsort(partner, kind="stable")  # of each partner its pairs, in the order of the text
                    for of in np.split(by, np.cumsum(np.bincount(partner))[:-1]):
                        if rare[partner[of[0]]]:
                            found.append(common_blocks(i[of], ei[of], once[of], words[i[of]], min_words))
                hit = np.unique(np.concatenate(found))
                open_[hit] = False
                rest = np.flatnonzero(open_)
                many = np.zeros(len(words), np.int64)
                many[i] = n
                hits.append(hit.astype(np.int32))
                left.append(rest.astype(np.int32))
                t.append(np.asarray(h)[rest])
                u.append(np.asarray(g)[rest])
                df.append(many[rest])
            yield pd.DataFrame({"doc_id": b.doc_id, "text_key": b.text_key, "hit": hits, "open": left, "t": t, "u": u, "df": df})

    return settle


def _posted(min_words: int):
    """Windows of shared lines that hold an open one, of each text that has such a line."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, runs = [], []
            for d, key, words, h, g, at in zip(b.doc_id, b.text_key, b.words, b.h, b.g, b.wanted, strict=True):
                words, at = np.asarray(words), np.asarray(at, np.int64)
                total = np.concatenate(([0], np.cumsum(words)))
                # The lines that a shortest run of enough words around an open line can reach.
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.searchsorted(total, total[at] - min_words, "right"), 1)
                np.add.at(edge, np.minimum(np.searchsorted(total, total[at] + min_words), len(words)), -1)
                held = np.concatenate(([0], np.cumsum(np.isin(np.arange(len(words)), at))))
                both = np.stack((h, g), axis=1).tobytes()
                for a, z in _windows(np.cumsum(edge)[:-1] > 0, words, min_words):
                    if held[z] > held[a]:
                        out.append((d, key, a, z))
                        runs.append(both[16 * a : 16 * z])
            if out:
                rows = pd.DataFrame(out, columns=["doc_id", "text_key", "a", "z"])
                rows[["t", "u"]] = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, runs)), "<i8").reshape(-1, 2)
                yield rows

    return post


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, keep array<boolean>, removed_words): for each text that loses lines, which of its lines stay."""
    own = cut(_lines(docs))
    key = ["doc_id", "text_key"]
    if not own.groupBy(*key).count().where("count > 1").isEmpty():
        own = cut(own.dropDuplicates(key))  # equal texts of one doc_id lose the same lines
    line = F.posexplode(F.arrays_zip("h", "g", "once")).alias("i", "x")
    tokens = own.select("doc_id", "text_key", line).select("doc_id", "text_key", "i", F.col("x.once").alias("once"), F.col("x.h").alias("t"), F.col("x.g").alias("u"))
    # Each line's smallest document, and its place there.
    first = tokens.groupBy("t", "u").agg(F.min(F.struct("doc_id", "text_key", "i", "once")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("df"))
    first = first.where("first.doc_id < last").select("t", "u", "df", F.col("first.doc_id").alias("e"), F.col("first.text_key").alias("ekey"), F.col("first.i").alias("ei"), F.col("first.once").alias("eonce"))
    met = join_counted(tokens, cut(first), ["t", "u"], "df").select("doc_id", "text_key", "i", "e", "ekey", "ei", (F.col("once") & F.col("eonce")).alias("once"), "df")
    seen = cut(met.where("e < doc_id").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("i", "e", "ekey", "ei", "once", "df")).alias("m")))
    lists = [F.col(f"m.{c}").alias(c) for c in ("i", "e", "ekey", "ei", "once", "df")]
    pairs = own.select("doc_id", "text_key", "words", "h", "g").join(seen, key).select("doc_id", "text_key", "words", "h", "g", *lists)
    settled = cut(pairs.mapInPandas(_settle(min_words), f"{_KEY}, hit array<int>, open array<int>, t array<long>, u array<long>, df array<long>"))
    hits = settled.where(F.size("hit") > 0).select("doc_id", "text_key", "hit")

    wanted = cut(settled.select(F.explode(F.arrays_zip("t", "u", "df")).alias("x")).select("x.*").distinct())
    if n := wanted.count():
        shared = own.select("doc_id", "text_key", F.posexplode(F.arrays_zip("h", "g")).alias("i", "x")).select("doc_id", "text_key", "i", F.col("x.h").alias("t"), F.col("x.g").alias("u"))
        if n <= FEW:
            held = shared.join(F.broadcast(wanted.select("t", "u")), ["t", "u"], "left_semi")
        else:
            held = join_counted(shared, wanted, ["t", "u"], "df")
        held = held.groupBy("doc_id", "text_key").agg(F.collect_set("i").alias("wanted"))
        near = own.select("doc_id", "text_key", "words", "h", "g").join(held, key)
        posted = near.mapInPandas(_posted(min_words), f"{_KEY}, a int, z int, t long, u long")
        windows = _shared(cut(posted)).where("earlier < doc_id")
        hits = hits.unionByName(windows.select("doc_id", "text_key", F.sequence("a", F.col("z") - 1).alias("hit")))
    # At most as many rows as the text has open lines, and windows from and up to each line, beside what was aligned.
    hits = hits.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep, lost = [], []
            for at, words, n, hit in zip(b["at"], b.words, b.n_lines, b.hit, strict=True):
                gone = np.asarray(hit, int)
                stays = np.ones(n, bool)
                stays[np.asarray(at)[gone]] = False
                keep.append(stays)
                lost.append(int(np.asarray(words)[gone].sum()))
            yield pd.DataFrame({"doc_id": b.doc_id, "text_key": b.text_key, "keep": keep, "removed_words": lost})

    chosen = own.select("doc_id", "text_key", "at", "words", "n_lines").join(hits, key)
    return cut(chosen.mapInPandas(decide, f"{_KEY}, keep array<boolean>, removed_words long").where("removed_words > 0"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs (doc_id, text, any other columns) as a struct `doc`, with `new_text` and `removed_words`.

    A line goes if it is in a run of lines with at least min_words words together that one document of smaller doc_id holds as a
    run too; the smallest one so keeps its lines. Null ids and texts
    stay as they are; rows of one doc_id are never each other's earlier document, and each of its texts loses its own lines.
    Blank lines neither match nor break a run, and stay. An empty table gives an empty table.
    """
    found = find_repeats(docs, min_words).select(F.col("doc_id").alias("k1"), F.col("text_key").alias("k2"), "keep", "removed_words")
    rows = docs.select(F.struct("*").alias("doc"))
    joined = rows.join(found, (F.col("doc.doc_id") == F.col("k1")) & (F.xxhash64("doc.text") == F.col("k2")), "left")
    left = F.filter(F.split("doc.text", "\n"), lambda x, i: F.col("keep")[i])
    text = F.when(F.col("keep").isNull(), F.col("doc.text")).otherwise(F.array_join(left, "\n"))
    return joined.select("doc", text.alias("new_text"), F.coalesce("removed_words", F.lit(0).cast("long")).alias("removed_words"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated lines deleted from `text`, and `n_chars`, where there is one, counted anew.

    A document that loses all its words goes; one that had none before stays.
    """
    found = dedup_lines(docs, min_words)
    found = found.where((F.col("removed_words") == 0) | F.col("new_text").rlike(r"\S"))
    doc = F.col("doc").withField("text", F.col("new_text"))
    if "n_chars" in docs.columns:
        size = F.when(F.col("removed_words") > 0, F.length("new_text")).otherwise(F.col("doc.n_chars"))
        doc = doc.withField("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return found.select(doc.alias("doc")).select("doc.*")
