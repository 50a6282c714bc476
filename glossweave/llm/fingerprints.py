"""Document fingerprints: digests of content-defined chunks, and how much of one text another holds.

A gear hash over the last 16 bytes marks places in a text; a chunk ends at a mark, hard ones counting until it has its normal
length and easy ones from then on. Ends depend on the bytes close by alone, so an insertion changes the chunks around it and no
others. A fingerprint is the set of its chunks' digests, each with the bytes it stands for, and its containment in another is the share of
these bytes whose digests the other has too.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_ids, small_batches, with_ids

#: Bytes of a chunk: at least, from where on easy marks end it, and at most.
LEAST, NORMAL, MOST = 16, 40, 128
#: One place in 64 is a hard mark, one in 16 an easy one.
HARD, EASY = np.uint32(0xFC000000), np.uint32(0xF0000000)
DIGEST = 8
#: Bytes of a text that are hashed at once.
SLICE = 1 << 20
#: Rows of a part of the ids' order, about, and the most parts there are: a bound and a key of each go through the driver.
PART_ROWS, PARTS = 256, 20_000

_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([c]), digest_size=4).digest(), "big") for c in range(256)], np.uint32)


def marks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places after hard and after easy marks of a text, rising; every hard one is easy too."""
    hard, easy = [], []
    for a in range(0, len(text), SLICE):
        first = max(0, a - 15)
        h = _GEAR[np.frombuffer(text[first : a + SLICE], np.uint8)]
        for k in (1, 2, 4, 8):  # of the last 2, 4, 8 and 16 bytes, each older one a bit further up
            more = h.copy()
            more[k:] += h[:-k] << np.uint32(k)
            h = more
        h = h[a - first :]
        at = np.flatnonzero(h & EASY == 0)
        easy.append(at + a + 1)
        hard.append(at[h[at] & HARD == 0] + a + 1)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *hard]), np.concatenate([none, *easy])


def ends(text: bytes, begin: int = 0) -> list[int]:
    """Ends of the chunks of text from `begin`, where a chunk begins."""
    at = max(0, begin - 15)
    hard, easy = marks(text[at:] if at else text)
    hard, easy = (hard + at).tolist(), (easy + at).tolist()
    # Sentinels end every search.
    hard.append(len(text) + MOST + 1), easy.append(len(text) + MOST + 1)
    out, i, j, size = [], 0, 0, len(text)
    while begin < size:
        low, mid, top = begin + LEAST, begin + NORMAL, min(begin + MOST, size)
        while hard[i] < low:
            i += 1
        if hard[i] < mid:
            end = hard[i]
        else:
            while easy[j] < mid:
                j += 1
            end = easy[j]
        begin = min(end, top)
        out.append(begin)
    return out


#: A fingerprint: digests as rising 64-bit numbers, each once, and the bytes of the text that its chunks hold.
_ENTRY = np.dtype([("digest", "<u8"), ("length", "<u4")])


def digests(text: bytes, cuts: list[int], begin: int = 0) -> np.ndarray:
    """Digest and length of each chunk of text, in the order of the text; cuts are the chunks' ends from `begin` on."""
    out = np.empty(len(cuts), _ENTRY)
    if cuts:
        starts = [begin, *cuts[:-1]]
        out["digest"] = np.frombuffer(b"".join([hashlib.blake2b(text[a:b], digest_size=DIGEST).digest() for a, b in zip(starts, cuts, strict=True)]), "<u8")
        out["length"] = np.subtract(cuts, starts)
    return out


def as_set(chunks: np.ndarray) -> np.ndarray:
    """Chunks in the order of their digests, each digest once, with the bytes of all its chunks."""
    digest, at = np.unique(chunks["digest"], return_inverse=True)
    out = np.empty(len(digest), _ENTRY)
    out["digest"] = digest
    out["length"] = np.bincount(at, chunks["length"], len(digest))
    return out


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's bytes whose chunks b has too; 1 if both sets are empty, 0 if one is."""
    if not len(a):
        return float(not len(b))
    n = a["length"].astype(np.int64)
    return float(n[np.isin(a["digest"], b["digest"], assume_unique=True)].sum() / n.sum())


def written(chunks: np.ndarray) -> str:
    """A set of chunks as text, 16 characters a chunk."""
    return base64.b64encode(chunks.tobytes()).decode()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), _ENTRY)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): a row for each row of docs (doc_id, text), of its whole text; a null or empty text has an empty fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b.id, "no_id": b.no_id, "fingerprint": [written(as_set(digests(t, ends(t)))) for t in map(_bytes, b.text)]})

    rows = plain_ids(small_batches(docs).select("doc_id", "text"), "doc_id")
    return with_ids(rows.mapInPandas(run, "id long, no_id boolean, fingerprint string"), "doc_id")


def contained(a: Column, b: Column) -> Column:
    """Containment of fingerprint a in b; null if one is."""

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else containment(parsed(p), parsed(q)) for p, q in zip(x, y, strict=True)], dtype="Float64")

    return share(a, b)


def _bytes(text: str | None) -> bytes:
    return ("" if text is None else text).encode("utf-8", "surrogatepass")


class _Ranges:
    """Ranges of falling (id, hash): bounds are ids of a sorted sample, and an id that is several bounds fills several ranges by its hash."""

    def __init__(self, sample: np.ndarray, parts: int):
        sample = np.sort(sample)
        self.at, many = np.unique(sample[np.arange(1, parts) * len(sample) // parts] if len(sample) else sample, return_counts=True)
        self.own = np.where(many > 1, many, 0)
        self.base = np.concatenate(([0], np.cumsum(1 + self.own)))

    def of(self, k: np.ndarray, u: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.at, k)
        rising = self.base[i]
        near = np.minimum(i, len(self.at) - 1)
        hot = (i < len(self.at)) & (self.own[near] > 0) & (self.at[near] == k) if len(self.at) else np.zeros(len(k), bool)
        own = self.own[near[hot]]
        rising[hot] += 1 + np.minimum((u[hot] / 2.0**64 + 0.5) * own, own - 1).astype(np.int64)
        return self.base[-1] - rising


def _keyed(docs: DataFrame) -> DataFrame:
    rows = plain_ids(docs.select("doc_id", "text"), "doc_id")
    return rows.withColumn("k", F.when(F.col("no_id"), F.lit(-(2**63))).otherwise(F.col("id"))).withColumn("u", F.xxhash64(F.coalesce("text", F.lit("")))).drop("id")


def in_order(docs: DataFrame) -> DataFrame:
    """(part, guest, id, no_id, text) of docs (doc_id, text), as plain_ids() tells ids: rows of a part by falling doc_id, then guests, one after the other in one task.

    A part's last row is followed by the first row of the next one, its guest, so every row's successor is at hand and no window
    over all rows is needed; the last part's guest is the first row of all. Null ids come last; rows of one id are in the order of
    a hash of their text, and fill several parts if they are many. Texts are moved once. The driver sees a sample of 20 ids a part,
    which only bounds the parts, and each part's first key.
    """
    spark = docs.sparkSession
    rows = _keyed(docs)
    n = rows.count()
    parts = max(1, min(PARTS, -(-n // PART_ROWS)))
    sample = rows.select("k").sample(min(1.0, 20 * parts / max(n, 1)), seed=1).toPandas().k.to_numpy(np.int64)
    ranges = _Ranges(sample, parts)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"part": ranges.of(b.k.to_numpy(np.int64), b.u.to_numpy(np.int64)), "k": b.k, "u": b.u})

    key = F.struct("k", "u")
    firsts = rows.select("k", "u").mapInPandas(place, "part long, k long, u long").groupBy("part").agg(F.max(key).alias("first")).collect()  # one row a part
    first = {r.part: tuple(r.first) for r in firsts}
    there = sorted(first)
    host = dict(zip(there, there[-1:] + there[:-1], strict=True))  # where a part's first row is the guest

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part = ranges.of(b.k.to_numpy(np.int64), b.u.to_numpy(np.int64))
            leads = np.array([first[p] == (k, u) for p, k, u in zip(part.tolist(), b.k.tolist(), b.u.tolist(), strict=True)], bool)
            yield b.assign(part=part, guest=False)
            if leads.any():
                yield b[leads].assign(part=[host[p] for p in part[leads].tolist()], guest=True)

    dealt = small_batches(rows).mapInPandas(deal, "no_id boolean, text string, k long, u long, part long, guest boolean")
    # The number of Spark's partitions follows its setting; parts are dealt to them by hash.
    return dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "guest", F.desc("k"), F.desc("u")).select("part", "guest", F.col("k").alias("id"), "no_id", "text")


def _half_edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of compared() from rows of in_order(); each text is cut once, and of an edited text only what its end changes."""
    names = ["id", "no_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None  # the row whose successor comes next
    for b in batches:
        out = []
        for guest, id_, no_id, text in zip(b.guest, b.id, b.no_id, b.text, strict=True):
            if guest and held is None:
                continue  # equal rows lead the next part; the first was enough
            text = "" if text is None else text
            raw = _bytes(text)
            cuts = ends(raw)
            chunks = digests(raw, cuts)
            own = as_set(chunks)
            if held:
                was_id, was_none, was, was_cuts, was_chunks, was_own = held
                half = len(was) // 2
                head = _bytes(was[: len(was) - half])
                edited = head + _bytes(text[:half])
                kept = bisect.bisect(was_cuts, len(head)) if half else len(was_cuts)
                begin = was_cuts[kept - 1] if kept else 0
                changed = as_set(np.concatenate((was_chunks[:kept], digests(edited, ends(edited, begin), begin))))
                out.append((was_id, was_none, len(was), hashlib.sha256(edited).hexdigest(), written(was_own), written(changed), containment(was_own, changed), containment(was_own, own)))
            held = None if guest else (id_, no_id, text, cuts, chunks, own)
        if out:
            yield pd.DataFrame(out, columns=names)


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): a row for each row of docs (doc_id, text).

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the next document by falling doc_id, or all
    of it if it has fewer; the next of the last is the first, of a single one itself. near_edited and near_next say how much of the
    document the edited text and the next document contain: 1 for equal texts, 0 if nothing is shared. A null text is as an empty
    one: an empty fingerprint, which only another empty one contains. Null ids come after all others, repeated rows are rows of
    their own, other columns are ignored, and an empty table gives no row.
    """
    rows = in_order(docs).mapInPandas(_half_edited, "id long, no_id boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return with_ids(rows, "doc_id")
