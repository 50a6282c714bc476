"""Importance resampling towards a target's words, drawn by an exact histogram of whole-number scores.

Hashed word runs of all texts are counted in a fixed number of buckets, each task adding up its own first. A bucket's gain is the
logarithm of its share in the target over its share in the raw texts; the gains are one array of fixed size, and a document's
weight is the sum of its features' entries. With a Gumbel term from its id, the highest scores are a draw without replacement.

Nothing is sorted to find them: scores are whole numbers, so documents are counted by score, the counts are summed from the top,
and the sums are the first ranks of each score. The cutoff score follows, and only documents from it up are ranked by id, each
score for itself.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, plain_ids, small_batches, with_ids

BUCKETS, RUNS, SEED = 10_000, 1, 2024
#: Of documents with at least LEAST_WORDS words, so many per cent are drawn.
PERCENT, LEAST_WORDS = 10, 20
#: Bytes of a text whose words are held at once.
SLICE = 1 << 20

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, A-Z lower-cased, some at a time and in order."""
    plain = ("" if text is None else text).encode("utf-8", "surrogatepass").translate(_WORDS)
    a = 0
    while a < len(plain):
        b = plain.find(b" ", a + SLICE)
        b = len(plain) if b < 0 else b
        yield plain[a:b].split()
        a = b


def features(text: str | None, runs: int = RUNS, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets) of a text, some words at a time: all runs of 1 to `runs` words, joined by a space, by their crc32."""
    tail: list[bytes] = []
    for part in words(text):
        found = [list(map(zlib.crc32, part))]
        for k in range(2, runs + 1):
            seq = tail[len(tail) - min(k - 1, len(tail)) :] + part
            found.append([zlib.crc32(b" ".join(seq[i : i + k])) for i in range(len(seq) - k + 1)])
        tail = (tail + part)[-(runs - 1) :] if runs > 1 else []
        flat = np.array([x for f in found for x in f] if runs > 1 else found[0], np.int64)
        yield len(part), flat % buckets


def bucket_counts(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts of (text) by bucket; each task sends one row a bucket at most. Null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.text:
                for _, at in features(text, runs, buckets):
                    n += np.bincount(at, minlength=buckets)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": at, "n": n[at]})

    return small_batches(texts).select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket: s of S features of raw, t of T of target.

    The counts of at most 2 x `buckets` rows are all that leaves Spark, however much text there is.
    """
    both = bucket_counts(raw, runs, buckets).withColumn("side", F.lit(0)).unionByName(bucket_counts(target, runs, buckets).withColumn("side", F.lit(1)))
    n = np.zeros((2, buckets))
    for r in both.collect():
        n[r.side, r.bucket] = r.n
    (s, t), (total, wanted) = n, n.sum(axis=1)
    ratio = ((t + 1) * (total + buckets)) / ((s + 1) * (wanted + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def scores(docs: DataFrame, gain: np.ndarray, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), longs, of documents (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros((3, len(b)), np.int64)
            for i, text in enumerate(b.text):
                for n, at in features(text, runs, len(gain)):
                    out[:, i] += n, len(at), gain[at].sum()
            yield pd.DataFrame({"id": b.id, "no_id": b.no_id, "n_words": out[0], "n_features": out[1], "weight": out[2]})

    rows = plain_ids(small_batches(docs).select("doc_id", "text"), "doc_id").mapInPandas(run, "id long, no_id boolean, n_words long, n_features long, weight long")
    rows = with_ids(rows, "doc_id")
    salted = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(salted, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", (F.col("weight") + noise).cast("long"))


def ranked(scored: DataFrame, want: int) -> DataFrame:
    """scored (doc_id, n_features, weight, score), checkpointed, with `rank`: 1 to want by falling score, then rising doc_id, nulls last.

    What is not drawn has a null rank. Rows alike in all four columns are counted before they meet and share one row until each
    gets its rank, so repeats make no large group; other rows of one score are few, as every id has its own noise.
    """
    columns = ["doc_id", "n_features", "weight", "score"]
    scored = scored.select(*columns)
    counted = scored.groupBy("score").agg(F.count("*").alias("n")).repartitionByRange(F.desc("score"))
    counted = cut(counted.select("score", "n", F.spark_partition_id().alias("part")))
    # A row a partition: the parts are in the order of their scores, so what lies above a part is a sum over the parts before it.
    above, parts = 0, []
    for r in counted.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        parts.append((r.part, above))
        above += r.n
    parts = scored.sparkSession.createDataFrame(parts, "part int, higher long")
    down = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    first = counted.join(F.broadcast(parts), "part").select("score", (F.col("higher") + F.coalesce(F.sum("n").over(down), F.lit(0))).alias("above")).where(F.col("above") < want)
    first = cut(first)
    cutoff = first.agg(F.min("score")).first()[0]
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    alike = scored.where(F.col("score") >= cutoff).groupBy(*columns).agg(F.count("*").alias("alike"))
    by_id = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    place = F.col("above") + F.sum("alike").over(by_id) - F.col("alike")
    drawn = alike.join(first.hint("merge"), "score").withColumn("place", place).select(*columns, F.explode(F.sequence(F.col("place") + 1, F.col("place") + F.col("alike"))).alias("rank"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= want, F.col("rank")))
    return drawn.unionByName(scored.where(F.col("score") < cutoff).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), longs: a row for each row of docs (doc_id, text), as drawn for target (text).

    Of the N rows with at least least_words words, floor(percent N / 100) have a rank. Null and blank texts have no feature and a
    weight of 0; a null id takes part with the noise of the text `null` and ranks behind others of its score; repeated rows are
    rows of their own. Other columns are ignored. An empty target has gains by the raw counts alone, empty docs give no row.
    """
    scored = cut(scores(docs, gains(docs, target, runs, buckets), runs, seed))
    long_enough = F.col("n_words") >= least_words
    n = scored.where(long_enough).count()
    short = scored.where(~long_enough).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked(scored.where(long_enough), percent * n // 100).unionByName(short)
