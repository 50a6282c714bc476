"""Helpers that the training-data operators share: checkpoints, words and their hashes, components."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step takes at once, unless a single text is longer.
CHUNK_BYTES = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share.

    Only a local session, whose executors are this process, gets one of its own where that is unset; a cluster must name it.
    """
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.TemporaryDirectory(prefix="glossweave-")
        _own_folders.append(own)  # deleted at exit
        sc.setCheckpointDir(own.name)
    return sc.getCheckpointDir()


_own_folders: list = []


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder that an operator wrote beside the checkpoints."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in the shared folder.

    Spark deletes the files with the last frame that reads them if spark.cleaner.referenceTracking.cleanCheckpoints is true; a
    cluster where it isn't keeps them until the folder is cleared.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """df, written as Parquet and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch. Rows hold whole texts, so Spark's own 10,000 would take hundreds of MB beside the heap.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session's Arrow batches held to BATCH_ROWS rows from now on."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plain_ids(df: DataFrame, name: str) -> DataFrame:
    """df with `id` long and `no_id` boolean for the column `name`: pandas makes floats of longs among which there are nulls, and rounds large ones."""
    value = F.col(name).cast("long")
    return df.withColumns({"id": F.coalesce(value, F.lit(0).cast("long")), "no_id": value.isNull()}).drop(*([name] if name not in ("id", "no_id") else []))


def with_ids(df: DataFrame, name: str) -> DataFrame:
    """The column `name` again in the place of `id` and `no_id`, first of all."""
    return df.select(F.when(~F.col("no_id"), F.col("id")).alias(name), *(c for c in df.columns if c not in ("id", "no_id")))


def crc_bucket(doc_id, modulus: int):
    """crc32 of the id as text, modulo; 0 for a null id, which so is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(0))


def chunks(values: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges (first, last + 1) of values of about limit bytes together; a longer value has a range of its own."""
    first = size = i = 0
    for i, v in enumerate(values):
        if size and size + len(v) > limit:
            yield first, i
            first, size = i, 0
        size += len(v) + 1
    if size:
        yield first, i + 1


def utf8(texts: Iterable[str | None]) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them (the splitmix64 finisher)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of a text that are split at once, and of a word that is hashed in numpy.
SLICE, WORD_BYTES = 1 << 22, 128
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _slices(text: bytes) -> Iterator[bytes]:
    """text in pieces of about SLICE bytes, each cut before a blank."""
    a = 0
    while len(text) - a > SLICE and (m := _BLANK.search(text, a + SLICE)):
        yield text[a : m.start()]
        a = m.start()
    yield text[a:] if a else text


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    text = b"\n".join(texts) + b"\n" + bytes(8)
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    word = ~_SPACE[raw[:-8]]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
    size = end - start
    # Eight bytes go in by steps that can be undone, the length first: words of up to eight bytes of one length never collide.
    h = mix(size.astype(np.uint64) * _BASE)
    live = np.flatnonzero(size <= WORD_BYTES)
    for k in range(0, WORD_BYTES, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        h[live] = mix(h[live] * _BASE ^ (eight[start[live] + k] & _FIRST[np.minimum(size[live] - k, 8)]))
    for i in np.flatnonzero(size > WORD_BYTES):
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h, np.searchsorted(start, ends_at)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of all words `[^\\x20\\x09-\\x0D]+` of the texts, A-Z lower-cased: 64-bit hashes, and each text's end in them.

    Words of the same length of up to eight bytes have different hashes. Of any other n words two share one with a chance of
    about n^2 / 2^65, whatever pattern they have; those of over WORD_BYTES bytes take a cryptographic hash.
    """
    if not any(len(t) > SLICE for t in texts):
        return _word_hashes(texts) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    out, ends, n = [], [], 0
    for text in texts:
        for part in _slices(text):
            out.append(_word_hashes([part])[0])
            n += len(out[-1])
        ends.append(n)
    return np.concatenate(out), np.array(ends, np.int64)


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words (a shorter text's whole sequence is one), and each text's end in them."""
    words, ends = word_hashes(texts)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    n = ends - starts
    if len(words) == 0:
        return words, np.zeros(len(texts), np.int64)
    h = np.zeros(len(words), np.uint64)
    for i in range(k):  # the word i places on; runs over a text's end are dropped below
        h[: len(words) - i] = mix(h[: len(words) - i] * _BASE + words[i:] + np.uint64(i + 1))
    keep = np.arange(len(words)) - np.repeat(starts, n) <= np.repeat(n - k, n)
    for t in np.flatnonzero((n > 0) & (n < k)):
        v = np.zeros(1, np.uint64)
        for i, w in enumerate(words[starts[t] : ends[t]]):
            v = mix(v * _BASE + w + np.uint64(i + 1))
        h[starts[t]] = mix(v + np.uint64(0x51ED))[0]
        keep[starts[t]] = True
    return h[keep], np.cumsum(np.where(n < k, np.minimum(n, 1), n - k + 1))


def distinct_sets(h: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Each text's sorted distinct hashes."""
    out, a = [], 0
    for b in ends:
        s = np.sort(h[a:b])
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s)
        a = b
    return out


#: A key is hot when it has more than one in so many of the rows that are to meet; so fewer keys than this are hot.
HOT_KEYS = 1000


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of big with small, one checkpointed row a key; column n of small tells how many rows of big the key has.

    Hot keys, fewer than HOT_KEYS rows, are broadcast, so no task gets all rows of one; the others are met by a shuffle.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    hot = small.where(F.col(n) * HOT_KEYS > total)
    met = big.join(F.broadcast(hot), keys)
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small.where(F.col(n) * HOT_KEYS <= total).hint("merge"), keys)
    return met.unionByName(rest)


#: Links that one task joins. More of them are joined by rounds of shuffles.
TASK_LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """Smallest id that each linked id reaches: (id, component) of checkpointed links (a, b), longs.

    Up to TASK_LINKS links are joined by one task. More are joined in rounds: labels take the least label among neighbours, then
    their label's label, until none changes; every round is a few joins over a checkpointed table, so nothing is gathered and a
    lost executor costs one round at most.
    """
    links = links.select("a", "b")
    if links.count() <= TASK_LINKS:
        return links.coalesce(1).mapInPandas(_join_links, "id long, component long")
    both = cut(links.union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("low"))
        low = labels.join(near.hint("merge"), "id").select("id", F.col("component").alias("was"), F.least("component", "low").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("lower"))
        found = cut(low.join(jump.hint("merge"), "low").select("id", "was", F.least("low", "lower").alias("component")))
        labels = found.select("id", "component")
        if not found.agg(F.count_if(F.col("was") != F.col("component"))).first()[0]:
            return labels


def _join_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.a.tolist(), batch.b.tolist(), strict=True):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    yield pd.DataFrame({"id": list(root), "component": [find(x) for x in list(root)]}, dtype="int64")
