"""Exact top-k inner products with a vector-approximation file.

Every block of vectors is kept twice: as whole numbers, and as cells, one byte a component. Cells lie between marks that each block
sets for each of its dimensions at equal shares of its values, so one far-off vector widens one cell only. A query's scores
with all cells of a block are bounded by matrix products; vectors whose upper bound is below the k-th lower bound are out.
Exact vectors are then read in the order of their upper bounds, some more each round, until the k-th exact score of every
query is above the bounds of all that it has not read, or what is left is few enough to be read at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 5
SCALE = 256
#: Cells of a dimension in a block.
CELLS = 256
#: Vectors and queries of a block. A block pair is a unit of work, so memory doesn't follow the input.
BLOCK, QUERIES = 8192, 4096
#: Tasks that a scan is dealt to, if it has as many pairs of blocks; each keeps its queries' best bounds from block to block.
TASKS = 4096
#: Blocks of vectors that a task scans in a row where this leaves each core so many tasks, as the bounds of earlier blocks spare rows of later ones.
RUN, WAVES = 8, 4
#: Exact vectors that a query reads in the first round; each later round reads so many times more than the one before.
FIRST_READ, MORE = 2 * K, 4
#: Sums of products below this are exact in a double.
_EXACT = 2.0**53


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, v array<double>) of floor(scale * x), whole numbers as doubles so that any size of component is kept.

    Null ids and vectors, empty vectors, and those that hold null or non-finite components, also after scaling, take no part.
    """
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    # floor() gives a long, which large doubles do not fit; they have no fraction.
    big = F.transform("embedding", lambda c: F.when(F.abs(c.cast("double")) * scale < _EXACT, F.floor(c.cast("double") * scale).cast("double")).otherwise(c.cast("double") * scale))
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale < float("inf")))
    small = F.forall("embedding", lambda c: F.abs(c.cast("double")) * scale < _EXACT)
    rows = embeddings.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(usable, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.when(small, x).otherwise(big).alias("v"))


def _pack(rows: DataFrame, block: str, out: str) -> DataFrame:
    """One row a block and dim: the ids and vectors of its rows as bytes."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        v = np.stack(pdf.v.to_numpy()).astype("<f8")
        return pd.DataFrame({"dim": [key[1]], block: [key[0]], f"{out}_ids": [pdf.vec_id.to_numpy("<i8").tobytes()], f"{out}_keys": [pdf.key.to_numpy("<i8").tobytes()], f"{out}_v": [v.tobytes()]})

    return rows.groupBy(block, "dim").applyInPandas(pack, f"dim int, {block} long, {out}_ids binary, {out}_keys binary, {out}_v binary")


def approximate(v: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(marks, cell) of a block: marks[j] rise from the least to the largest value of dimension j, each a value or one above it; cell[i, j] says between which two v[i, j] lies."""
    at = np.linspace(0, len(v) - 1, min(cells, len(v)) + 1).astype(int)
    marks = np.sort(v, axis=0)[at].T.copy()
    cell = np.empty(v.shape, np.uint8)
    for j, m in enumerate(marks):
        cell[:, j] = np.clip(np.searchsorted(m, v[:, j], "right") - 1, 0, len(m) - 2)
    return marks, cell


def _cells(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [approximate(np.frombuffer(raw, "<f8").reshape(-1, dim)) for dim, raw in zip(b.dim, b.x_v, strict=True)]
            yield pd.DataFrame({"dim": b.dim, "x_block": b.x_block, "x_ids": b.x_ids, "x_keys": b.x_keys, "marks": [m.tobytes() for m, _ in made], "cells": [c.tobytes() for _, c in made]})

    return blocks.mapInPandas(run, "dim int, x_block long, x_ids binary, x_keys binary, marks binary, cells binary")


def bounds(q: np.ndarray, floor: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the score of each query with each vector, whose components lie between floor and top."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    low, high = up @ floor.T + down @ top.T, up @ top.T + down @ floor.T
    # Whole sums of up to 2^53 are exact; beyond that a margin keeps the bounds on the safe side.
    reach = np.abs(q) @ np.maximum(np.abs(floor), np.abs(top)).max(axis=0)
    slack = np.where(reach < _EXACT, 0, reach * (q.shape[1] + 2) * 2.0**-51)[:, None]
    return low - slack, high + slack


def _scan(k: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple, np.ndarray] = {}  # of each query of this task its k best lower bounds so far
        for b in batches:
            for r in b.itertuples(index=False):
                ids, keys, qids = (np.frombuffer(x, "<i8") for x in (r.x_ids, r.x_keys, r.q_ids))
                marks, cell = np.frombuffer(r.marks, "<f8").reshape(r.dim, -1), np.frombuffer(r.cells, "u1").reshape(-1, r.dim)
                q = np.frombuffer(r.q_v, "<f8").reshape(-1, r.dim)
                place = np.arange(r.dim)
                floor, top = marks[place, cell], marks[place, cell + np.int16(1)]
                seen = best.setdefault((r.dim, r.q_block), np.full((len(q), k), -np.inf))
                for i in range(0, len(q), 128):
                    with np.errstate(over="ignore", invalid="ignore"):  # what overflows is not bounded, and read
                        low, high = bounds(q[i : i + 128], floor, top)
                    low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf
                    own = qids[i : i + 128, None] == ids[None, :]
                    low[own] = -np.inf
                    both = np.concatenate((seen[i : i + 128], low), axis=1)
                    seen[i : i + 128] = np.partition(both, -k, axis=1)[:, -k:]
                    a, c = np.nonzero((high >= seen[i : i + 128].min(axis=1)[:, None]) & ~own)
                    if len(a):
                        yield pd.DataFrame({"query_id": qids[i : i + 128][a], "vec_id": ids[c], "key": keys[c], "low": low[a, c], "high": high[a, c]})

    return scan


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact scores as text of a whole number, so that any size of score has a place; `short` where it fits a long."""
    for b in batches:
        if not len(b):
            continue
        out = []
        for q, v in zip(b.qv, b.v, strict=True):
            reach = float(np.abs(q) @ np.abs(v)) if len(q) else 0.0
            out.append(int(q @ v) if reach < _EXACT else sum(int(x) * int(y) for x, y in zip(q.tolist(), v.tolist(), strict=True)))
        fits = [-(2**63) <= s < 2**63 for s in out]
        yield pd.DataFrame({
            "query_id": b.query_id, "vec_id": b.vec_id, "score": pd.array([s if f else None for s, f in zip(out, fits, strict=True)], "Int64"),
            "size": [float(s) if abs(s) < 10**308 else math.copysign(math.inf, s) for s in out], "digits": [_ordered(s) for s in out],
        })


def _ordered(s: int) -> str:
    """Text of a whole number that sorts as the number does; empty where a double holds it, as that sorts it alone."""
    if abs(s) < _EXACT:
        return ""
    n = s if s >= 0 else s + (1 << 2200)
    return f"{n:0680d}"


def search(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with other vectors, ties to the smaller vec_id.

    queries and vectors: (vec_id, dim, v) of whole_vectors(). A query meets vectors of its own length only, and never a row of
    its own vec_id. A query id of several vectors searches for the least of them; repeated rows of equal vec_id and vector count
    once, and of several vectors of one vec_id each has a row. A score among the k highest that no long holds stops the
    job. Empty tables give an empty table.
    """
    empty = queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = cut(queries.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("m")).select("vec_id", "m.dim", "m.v", F.lit(0).cast("long").alias("key")))
    # Of equal vectors only the k + 1 smallest ids can be among a query's best; tasks drop the others before the shuffle.
    same = Window.partitionBy("v_hash", "v").orderBy("vec_id")  # the hash first, as comparing it costs less
    vectors = vectors.groupBy("vec_id", "dim", "v").agg(F.lit(0)).select("vec_id", "dim", "v", F.xxhash64("v").alias("v_hash")).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    vectors = cut(vectors.select("vec_id", "dim", "v", F.xxhash64("vec_id", "v").alias("key")))
    n, n_queries = vectors.count(), queries.count()
    if not n or not n_queries:
        return empty
    x_blocks, q_blocks = -(-n // BLOCK), -(-n_queries // QUERIES)
    x = _pack(vectors.withColumn("x_block", F.pmod(F.xxhash64("vec_id"), F.lit(x_blocks))), "x_block", "x")
    q = _pack(queries.withColumn("q_block", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks))), "q_block", "q")
    # Every block pair is stated by an equi-join: a block of vectors goes to each block of queries, a block of queries to each group
    # of blocks of vectors, which one task scans. The join is a merge join, as Spark takes exploded rows for as small as they were
    # before, and would send all copies of them through the driver to broadcast them.
    busy = WAVES * queries.sparkSession.sparkContext.defaultParallelism
    groups = min(x_blocks, -(-TASKS // q_blocks), max(-(-busy // q_blocks), -(-x_blocks // RUN)))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    x = _cells(x).withColumns({"q_block": each(q_blocks), "x_group": F.col("x_block") % groups})
    q, keys = q.withColumn("x_group", each(groups)).drop("q_keys"), ["dim", "q_block", "x_group"]
    pairs = x.repartition(q_blocks * groups, *keys).join(q.repartition(q_blocks * groups, *keys).hint("merge"), keys)
    found = cut(pairs.mapInPandas(_scan(k), "query_id long, vec_id long, key long, low double, high double"))

    # A window keeps k rows of each task before its shuffle, so many blocks make no long group.
    by_low = Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id", "key")
    kth = found.withColumn("r", F.row_number().over(by_low)).where(F.col("r") <= k).groupBy("query_id").agg(F.min("low").alias("kth_low"), F.count("*").alias("n"))
    kth = kth.select("query_id", F.when(F.col("n") == k, F.col("kth_low")).otherwise(float("-inf")).alias("kth_low"))
    left = cut(found.join(kth, "query_id").where("high >= kth_low").select("query_id", "vec_id", "key", "high"))

    by_high = Window.partitionBy("query_id").orderBy(F.desc("high"), "vec_id", "key")
    best = Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("digits"), "vec_id")
    one, other = vectors.select("vec_id", "key", "v"), queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    read, exact = FIRST_READ, None
    while True:
        # What is no more than a first round may read is read at once: a round costs a shuffle of all vectors, however few it reads.
        last = left.count() <= FIRST_READ * n_queries
        next_ones = left if last else left.withColumn("r", F.row_number().over(by_high)).where(F.col("r") <= read)
        scores = next_ones.join(one, ["vec_id", "key"]).join(other, "query_id").select("query_id", "vec_id", "qv", "v").mapInPandas(_products, "query_id long, vec_id long, score long, size double, digits string")
        exact = scores if exact is None else exact.unionByName(scores)
        exact = cut(exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
        if last:
            break
        # What a query has not read stays if its bound reaches the k-th exact score; a little below it, as doubles round.
        sure = exact.groupBy("query_id").agg(F.min("size").alias("least"), F.count("*").alias("n"))
        sure = sure.select("query_id", F.when(F.col("n") == k, F.col("least") - F.abs("least") * 1e-12).otherwise(float("-inf")).alias("least"))
        left = cut(left.join(next_ones.select("query_id", "vec_id", "key"), ["query_id", "vec_id", "key"], "left_anti").join(sure, "query_id").where("high >= least").drop("least"))
        read *= MORE
    held = F.when(F.col("score").isNull(), F.raise_error(F.lit("a score fits no long"))).otherwise(F.col("score"))
    return exact.withColumn("rank", F.row_number().over(best)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", held.cast("long").alias("score"))


def nearest(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """search() for the vectors of embeddings (vec_id, embedding) whose id is divisible by `every`, among all of them.

    Other columns are ignored; what whole_vectors() leaves out neither searches nor is found, and an empty table finds nothing.
    """
    vectors = whole_vectors(embeddings.select("vec_id", "embedding"))
    return search(vectors.where(F.col("vec_id") % every == 0), vectors)
