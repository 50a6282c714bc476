"""Benchmark passages inside documents, found through the q-gram lemma.

Benchmark items are cut into overlapping segments of two lengths; the short ones lie so close that every verbatim stretch of
FINE + FINE_STEP - 1 characters holds a whole one. Items under MIN_CHARS are looked up whole and exactly. A segment with at most e edits in a text shares L - q + 1 - q * e of its
q-grams with it, all within a band of e + 1 diagonals. Shared q-grams are counted in overlapping bands twice that wide; bands
with enough of them are verified by banded alignment. A text is searched as a whole within its own row, so no data moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import mix, small_batches

#: Characters of a q-gram and of a segment, the step between segments, and edits a character of a segment.
Q, SEGMENT, STEP, EDITS = 10, 120, 60, 0.08
#: Characters of the short segments beside these, and their step.
FINE, FINE_STEP = 60, 10
#: Shorter items must be there whole, without edits, and not as parts of longer words.
MIN_CHARS = 40
#: Characters of benchmark items whose index is broadcast at once; a larger benchmark is searched in several passes. Each one's index
#: has some six postings a character, of 14 bytes and as much again for its keys.
PASS_CHARS = 750_000
#: Characters that repeat after one to PERIOD others are left out, whole periods at a time, from KEEP of them in a row on: rules of
#: dashes, dots, blanks or table marks. Else each q-gram of such a text would meet each of such a segment.
PERIOD, KEEP = 8, 32
_CHUNK = 400_000
#: Shared q-grams of a chunk from which on parts that a text repeats are left out, and that are counted at once.
_MANY = 500_000
#: Characters around a place that hold any match it is in.
_AROUND = 256
_BITS = 24
_GAP = 0x10FFFF  # no text holds this; it parts texts from each other


def plain(text: str) -> np.ndarray:
    """Code points, one for each character: lower-cased where that keeps the length, white space as plain spaces."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((code <= 32) | (code == 0xA0) | (code == 0x3000), np.uint32(32), code)


def _repeats(code: np.ndarray) -> bool:
    """Whether a run of KEEP repeating characters is there: every eighth place is looked at, at lags that periods up to 8 divide, and all places between three that fit."""
    for lag in (7, 8, 10, 12):
        if len(code) < KEEP:
            break
        same = code[lag::8] == code[: len(code) - lag : 8]
        at = 8 * np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        for k in range(1, 16):
            if not len(at):
                break
            at = at[code[at + k + lag] == code[at + k]]
        if len(at):
            return True
    return False


def squeezed(code: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(code, place): a text without the rest of its long runs of repeating characters, and where its characters were; None if all stay."""
    place = None
    if not _repeats(code):
        return code, place
    for p in range(1, PERIOD + 1):
        if len(code) <= p + KEEP:
            break
        edge = np.diff((code[p:] == code[:-p]).astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        gone = np.maximum(last - first - KEEP, 0) // p * p
        if not gone.any():
            continue
        out = np.zeros(len(code) + 1, np.int64)
        np.add.at(out, last + p - gone, 1)
        np.add.at(out, last + p, -1)
        keep = np.cumsum(out)[:-1] == 0
        place = np.flatnonzero(keep) if place is None else place[keep]
        code = code[keep]
    return code, place


def grams(code: np.ndarray) -> np.ndarray:
    """A hash of each run of Q = 10 code points: 2, 4, 8 and then 10 of them at a time."""
    base = np.uint64(0x9E3779B97F4A7C15)
    power = lambda n: np.uint64(pow(int(base), n, 1 << 64))
    if len(code) < Q:
        return np.zeros(0, np.uint64)
    one = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    one ^= one >> np.uint64(29)
    two = one[:-1] * base + one[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    return eight[:-2] * power(2) + two[8:]


def _short_grams(code: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k code points, Q at most."""
    if k == Q:
        return grams(code)
    h = np.zeros(max(0, len(code) - k + 1), np.uint64)
    for i in range(k):
        h = mix(h + code[i : i + len(h)] + np.uint64(1))
    return h


class Index:
    """Segments of the items and where their q-grams are; short items by their first characters."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.code, gram, segment, offset = [], [], [], [], []
        self.short: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
        for item, text in items:
            code = squeezed(plain(text))[0]
            if len(code) < MIN_CHARS:
                own = np.flatnonzero(code != 32)
                code = code[own[0] : own[-1] + 1] if len(own) else code[:0]
                if len(code):
                    k = min(Q, len(code))
                    self.short.setdefault(k, {}).setdefault(int(_short_grams(code[:k], k)[0]), []).append((item, code))
                continue
            parts = {}
            for length, step in ((SEGMENT, STEP), (FINE, FINE_STEP)):
                last = max(0, len(code) - length)
                parts |= {(at, len(code[at : at + length])): None for at in (*range(0, last, step), last)}
            for at, length in parts:
                part = code[at : at + length]
                g = grams(part)
                segment.append(np.full(len(g), len(self.item), np.int32))
                offset.append(np.arange(len(g), dtype=np.int16))
                gram.append(g)
                self.item.append(item)
                self.code.append(part)
        size = np.array([len(c) for c in self.code], np.int64)
        self.size = size
        self.items = sorted(set(self.item))
        of = {x: k for k, x in enumerate(self.items)}
        self.number = np.array([of[x] for x in self.item], np.int64)
        self.edits = np.minimum((size * EDITS).astype(np.int64), (size - Q) // Q)
        self.least = size - Q + 1 - Q * self.edits
        gram, segment, offset = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((gram, np.uint64), (segment, np.int32), (offset, np.int16)))
        order = np.argsort(gram, kind="stable").astype(np.int32)
        gram, self.segment, self.offset = gram[order], segment[order], offset[order]
        del order
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(gram)), bool), gram[1:] != gram[:-1])))
        self.key, self.first, self.many = gram[first], first.astype(np.int32), np.diff(first, append=len(gram)).astype(np.int32)
        del gram
        self.bits = np.zeros(1 << (_BITS - 3), np.uint8)
        slot = mix(self.key) >> np.uint64(64 - _BITS)
        np.bitwise_or.at(self.bits, slot >> np.uint64(3), (1 << (slot & np.uint64(7))).astype(np.uint8))

    def places(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, key) of q-grams of the text that segments hold."""
        g = grams(code)
        slot = mix(g) >> np.uint64(64 - _BITS)
        at = np.flatnonzero((self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
        k = np.minimum(np.searchsorted(self.key, g[at]), max(len(self.key) - 1, 0))
        same = self.key[k] == g[at] if len(self.key) else np.zeros(0, bool)
        return at[same], k[same]

    def regions(self, code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, lowest diagonal) of the bands with enough shared q-grams; owner: the text of each place, as several may follow each other.

        Of parts that a text repeats, all around a place included, the first is enough: its match is no worse and comes first.
        """
        at, k = self.places(code)
        if int(self.many[k].sum(dtype=np.int64)) > _MANY:
            h = np.concatenate((np.full(_AROUND, _GAP), code, np.full(_AROUND, _GAP))).astype(np.uint64)
            size = 1
            while size < 2 * _AROUND:
                h = mix(mix(h[:-size] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15) + h[size:])
                size *= 2
            first = np.sort(np.unique(mix(h[at]) ^ mix(owner[at].astype(np.uint64) + np.uint64(1)), return_index=True)[1])
            at, k = at[first], k[first]
        segments, lows = [], []
        begin, total = 0, np.concatenate(([0], np.cumsum(self.many[k], dtype=np.int64)))
        while begin < len(at):  # some at a time; two parts overlap by as much as a match can need
            end = max(int(np.searchsorted(total, total[begin] + _MANY)), begin + 1)
            end = max(end, int(np.searchsorted(at, at[begin] + 3 * _AROUND)))
            s, low = self._bands(len(code), at[begin:end], k[begin:end])
            segments.append(s)
            lows.append(low)
            if end < len(at) and at[end] - at[end - 1] <= _AROUND:
                begin = int(np.searchsorted(at, at[end - 1] - _AROUND))
            else:
                begin = end
        if len(segments) < 2:
            return (segments[0], lows[0]) if segments else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        both = np.unique(np.stack((np.concatenate(segments), np.concatenate(lows))), axis=1)
        return both[0], both[1]

    def _bands(self, length: int, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.many[k].astype(np.int64)
        post = np.repeat(self.first[k].astype(np.int64) - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        place, segment, offset = np.repeat(at, n), self.segment[post].astype(np.int64), self.offset[post].astype(np.int64)
        width = 2 * (self.edits[segment] + 1)
        diagonal = place - offset + SEGMENT  # not negative
        span = np.int64(length + 4 * SEGMENT)
        found = []
        for shift in (0, 1):
            band = (diagonal + shift * width // 2) // width
            # A q-gram of the segment counts once in a band, however often the text repeats it.
            own = np.unique((segment * span + band) * np.int64(SEGMENT) + offset) // SEGMENT
            key, n = np.unique(own, return_counts=True)
            s = key // span
            ok = n >= self.least[s] if len(key) else np.zeros(0, bool)
            found.append((s[ok], (key[ok] % span) * 2 * (self.edits[s[ok]] + 1) - shift * (self.edits[s[ok]] + 1) - SEGMENT))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def align(self, code: np.ndarray, segment: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end in the text) of the best alignment of each segment that stays in its band of diagonals."""
        best, end = np.full(len(segment), 1 << 20), np.zeros(len(segment), np.int64)
        for size in np.unique(self.size[segment]):
            rows = np.flatnonzero(self.size[segment] == size)
            for k in range(0, len(rows), 2048):
                r = rows[k : k + 2048]
                width = int(2 * (self.edits[segment[r[0]]] + 1))
                pattern = np.stack([self.code[s] for s in segment[r]])
                lane = np.arange(width)
                at = low[r][:, None] + lane
                cost = np.zeros((len(r), width), np.int32)
                for i in range(size):
                    here = at + i
                    text = np.where((here >= 0) & (here < len(code)), code[np.clip(here, 0, len(code) - 1)], _GAP)
                    step = cost + (text != pattern[:, i : i + 1])
                    step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
                    cost = np.minimum.accumulate(step - lane, axis=1) + lane
                j = cost.argmin(1)
                best[r], end[r] = cost[np.arange(len(r)), j], low[r] + j + size
        return best, end

    def whole(self, code: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the short items; an end that is a letter or digit has none beside it in the text."""
        free = lambda a, b: not (0 <= a and b < len(code) and chr(code[a]).isalnum() and chr(code[b]).isalnum())
        for k, table in self.short.items():
            g = _short_grams(code, k)
            for at in np.flatnonzero(np.isin(g, np.array(list(table), np.uint64))).tolist():
                for item, part in table[int(g[at])]:
                    end = at + len(part)
                    if free(at - 1, at) and free(end - 1, end) and np.array_equal(code[at:end], part):
                        yield item, at, end

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its (item, start, end, edits), one for each item: of its matches the one with fewest edits, then the first, then the longest."""
        out: list[list] = [[] for _ in texts]
        first = 0
        while first < len(texts) and (len(self.key) or self.short):
            codes, places, total, last = [], [], 0, first
            while last < len(texts) and (not codes or total < _CHUNK):
                code, place = squeezed(plain(texts[last] or ""))
                codes.append(code)
                places.append(place)
                total += len(code)
                last += 1
            gap = np.full(SEGMENT, _GAP, np.uint32)
            code = np.concatenate([x for c in codes for x in (c, gap)])
            starts = np.concatenate(([0], np.cumsum([len(c) + SEGMENT for c in codes])[:-1]))
            for item, a, z in self.whole(code):
                t = int(np.searchsorted(starts, a, side="right")) - 1
                out[first + t].append((0, int(a - starts[t]), int(z - starts[t]), item))
            owner = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) + SEGMENT for c in codes])
            segment, low = self.regions(code, owner) if len(self.key) else ((), ())
            if len(segment):
                edits, end = self.align(code, segment, low)
                ok = edits <= self.edits[segment]
                segment, n, end = segment[ok], edits[ok], end[ok]
                t = np.searchsorted(starts, end - 1, side="right") - 1
                stop = np.minimum(end - starts[t], np.array([len(c) for c in codes])[t])
                begin = np.maximum(0, stop - self.size[segment])
                item = self.number[segment]
                order = np.lexsort((-stop, begin, n, item, t))  # of each text and item the best comes first
                lead = order[np.concatenate((np.ones(min(1, len(order)), bool), (np.diff(t[order]) != 0) | (np.diff(item[order]) != 0)))]
                for k in lead.tolist():
                    out[first + int(t[k])].append((int(n[k]), int(begin[k]), int(stop[k]), self.items[item[k]]))
            for t, place in enumerate(places):
                if place is not None:  # back to where it was in the text
                    place = np.append(place, len(texts[first + t])).tolist()
                    out[first + t] = [(n, place[a], place[z - 1] + 1 if z > a else place[a], item) for n, a, z, item in out[first + t]]
            first = last
        kept = []
        for found in out:
            best: dict[int, tuple] = {}
            for n, a, z, item in sorted(found, key=lambda f: (f[0], f[1], -f[2], f[3])):
                best.setdefault(item, (item, a, z, n))
            kept.append(sorted(best.values()))
        return kept


def _indexes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in passes of about PASS_CHARS characters, the most that the driver holds at once."""
    items = benchmark.where(F.col("item_id").isNotNull() & (F.length("text") > 0)).select("item_id", "text").distinct()
    passes = 1 + int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // PASS_CHARS
    for p in range(passes):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == p) if passes > 1 else items
        yield sorted((r[0], r[1]) for r in part.collect())


_FOUND = ArrayType(StructType([StructField("item_id", LongType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("edits", IntegerType())]))
_made: dict = {}


def _finder(spark: SparkSession, items: list[tuple[int, str]]):
    shared = spark.sparkContext.broadcast(items)
    name = hash(tuple(items))

    @F.pandas_udf(_FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _made:
            _made.clear()
            _made[name] = Index(shared.value)
        for texts in batches:
            yield pd.Series([[{"item_id": i, "start": a, "end": z, "edits": n} for i, a, z, n in found] for found in _made[name].search(list(texts))], dtype=object)

    return find


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits): benchmark items of which a document holds a segment, with its place in the text.

    Null or empty texts hold none; long runs of a few repeating characters are alike whatever their length; null or blank items are not searched, and items under MIN_CHARS are found whole only. Repeated rows each give their matches; equal item
    rows count once. Without items the result is empty.
    """
    found, docs = None, small_batches(docs)
    for items in _indexes(benchmark):
        find = _finder(docs.sparkSession, items)
        part = docs.select("doc_id", find("text").alias("found")).where(F.size("found") > 0).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
        found = part if found is None else found.union(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no benchmark passage, all columns as they are."""
    kept = small_batches(docs).select(F.struct("*").alias("doc"))
    for items in _indexes(benchmark):
        kept = kept.where(F.size(_finder(docs.sparkSession, items)("doc.text")) == 0)
    return kept.select("doc.*")
