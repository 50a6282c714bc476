"""Centroid clustering of quantised vectors in whole numbers: equal vectors are one row with a weight.

Vectors become whole numbers, packed in as few bytes as they need, and equal ones are grouped with their number. Lloyd's rounds run
over the distinct vectors: each task adds up, for each centroid, the weight times the components of what is nearest to it, and only
these sums meet. Last, the distinct vectors' clusters are joined back to all ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, plain_ids, with_ids

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Vectors that one numpy step holds.
ROWS = 8192
#: Sums are sent as digits to this base, so that no size of component or number of vectors overflows them.
_DIGIT = 32
_KINDS = {b"1": "<i1", b"2": "<i2", b"4": "<i4", b"8": "<i8"}


def pack(v: list[int]) -> bytes:
    """The whole numbers of a vector in the fewest bytes that hold them: equal vectors, and only these, have equal bytes."""
    low, high = min(v, default=0), max(v, default=0)
    for kind, code in _KINDS.items():
        bits = 8 * int(kind) - 1
        if -(1 << bits) <= low and high < 1 << bits:
            return kind + np.array(v, code).tobytes()
    return b"t" + ",".join(map(str, v)).encode()


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    """Vectors as rows of longs, or of Python's whole numbers where one needs more."""
    kinds = {p[:1] for p in packed}
    if len(kinds) == 1 and b"t" not in kinds:
        kind = kinds.pop()
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)[:, 1:]
        return np.ascontiguousarray(raw).view(_KINDS[kind]).astype(np.int64)
    if b"t" not in kinds:
        return np.array([np.frombuffer(p, _KINDS[p[:1]], offset=1) for p in packed], np.int64).reshape(-1, dim)
    return np.array([[int(x) for x in p[1:].split(b",")] if p[:1] == b"t" else np.frombuffer(p, _KINDS[p[:1]], offset=1).tolist() for p in packed], object).reshape(-1, dim)


def quantised(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id long, v binary): floor(scale * x) of vectors of `dim` components, none null or non-finite; the others are left out."""
    ok = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = embeddings.where((F.size("embedding") == dim) & F.coalesce(ok, F.lit(False)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = []
            for x in b.x:
                scaled = np.floor(np.asarray(x, float) * scale)
                if not dim or np.abs(scaled).max() < 32767:
                    small = scaled.astype("<i2")
                    tiny = small.astype("<i1")
                    packed.append(b"1" + tiny.tobytes() if (tiny == small).all() else b"2" + small.tobytes())
                else:  # what overflows a double when scaled is still a whole number
                    packed.append(pack([int(s) if np.isfinite(s) else int(f) * scale for s, f in zip(scaled.tolist(), np.asarray(x, float).tolist(), strict=True)]))
            yield pd.DataFrame({"id": b.id, "no_id": b.no_id, "v": packed})

    rows = plain_ids(rows.select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "vec_id")
    return with_ids(rows.mapInPandas(run, "id long, no_id boolean, v binary"), "vec_id")


def _reach(v: np.ndarray) -> int:
    """The largest size of a component."""
    return max(abs(int(v.min())), abs(int(v.max()))) if v.size else 0


def nearest(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector; of equally near centroids the first."""
    reach = max(_reach(v), max((abs(x) for c in centroids for x in c), default=0))
    most = 4 * reach * reach * v.shape[1]  # bounds every distance, and every sum on the way to it
    if most >= 1 << 63:
        v, kind = v.astype(object), object
    else:
        kind = float if most < 1 << 53 else np.int64  # doubles are exact so far, and quicker
    v, c = v.astype(kind), np.array(centroids, kind)
    d = (v * v).sum(axis=1)[:, None] - 2 * v.dot(c.T) + (c * c).sum(axis=1)[None, :]
    best = d.argmin(axis=1)
    least = d[np.arange(len(v)), best]
    return best, least if kind is object else least.astype(np.int64)


def _steps(batches: Iterator[pd.DataFrame], dim: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for b in batches:
        for i in range(0, len(b), ROWS):
            part = b.iloc[i : i + ROWS]
            yield part, unpack(part.v.tolist(), dim)


def sums(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(cluster, place, digit, n): weighted sums of the vectors (v, n) nearest to each centroid, by place; place -1 counts them.

    A sum is that of n * 2^(32 digit) over its digits. A task sends one row for each of these at most.
    """
    k, dim = len(centroids), len(centroids[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = [0] * k, [[0] * dim for _ in range(k)]
        for part, v in _steps(batches, dim):
            best, _ = nearest(v, centroids)
            n = part.n.to_numpy(np.int64)
            most = int(n.sum()) * max(1, _reach(v))
            kind = float if most < 1 << 53 else np.int64 if most < 1 << 63 else object
            for c in np.unique(best):
                at = best == c
                count[c] += int(n[at].sum())
                total[c] = [a + int(x) for a, x in zip(total[c], n[at].astype(kind).dot(v[at].astype(kind)), strict=True)]
        out = []
        for c in range(k):
            for place, s in enumerate([count[c], *total[c]], -1):
                digit = 0
                while s not in (0, -1):
                    out.append((c, place, digit, s & ((1 << _DIGIT) - 1)))
                    s >>= _DIGIT
                    digit += 1
                if s:
                    out.append((c, place, digit, -1))
        yield pd.DataFrame(out, columns=["cluster", "place", "digit", "n"]).astype("int64")

    return vectors.select("v", "n").mapInPandas(run, "cluster long, place long, digit long, n long").groupBy("cluster", "place", "digit").agg(F.sum("n").alias("n"))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floor(sum / count) of what is nearest to each; what has nothing stays."""
    total: dict[tuple[int, int], int] = {}
    for r in sums(vectors, centroids).collect():  # a row for each centroid, component and digit
        total[r.cluster, r.place] = total.get((r.cluster, r.place), 0) + (r.n << _DIGIT * r.digit)
    return [[total.get((c, j), 0) // total[c, -1] for j in range(len(was))] if total.get((c, -1)) else was for c, was in enumerate(centroids)]


def start(rows: DataFrame, k: int = CENTROIDS, dim: int = DIM, seed: int = SEED) -> list[list[int]]:
    """The k vectors of (vec_id, v) with the smallest SHA-256 of `<seed>:<vec_id>`, in that order; null ids come last, ties by their bytes."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return [[int(x) for x in unpack([bytes(r.v)], dim)[0]] for r in first]


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): a row for each vector of embeddings (vec_id, embedding) that is kept.

    Vectors of another length, null, or with null or non-finite components are left out. Null ids are clustered as others, but
    start a cluster only where there are too few others; repeated rows count each. Fewer vectors than k make fewer clusters; an
    empty table makes no row. Other columns are ignored. A distance or inertia that no long holds stops the job.
    """
    spark = embeddings.sparkSession
    rows = cut(quantised(embeddings.select("vec_id", "embedding"), dim, scale))
    distinct = cut(rows.groupBy("v").agg(F.count("*").alias("n")))
    centroids = start(rows, k, dim, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(distinct, centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, v in _steps(batches, dim):
            best, distance = nearest(v, centroids)
            if distance.dtype == object and any(d >= 2**63 for d in distance):
                raise OverflowError("a squared distance fits no long")
            yield pd.DataFrame({"v": part.v.tolist(), "n": part.n.to_numpy(), "cluster": best.astype(np.int32), "distance": distance.astype(np.int64)})

    near = cut(distinct.mapInPandas(run, "v binary, n long, cluster int, distance long"))
    weighted = (F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")).cast("decimal(38,0)")
    of_cluster = {r.cluster: int(r.d) for r in near.groupBy("cluster").agg(F.sum(weighted).alias("d")).collect()}
    told = [(c, d, sum(of_cluster.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in of_cluster.items()]
    if any(t >= 2**63 for _, *t, _ in told for t in t):
        raise OverflowError("an inertia fits no long")
    told = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # a row a cluster
    return join_counted(rows, near, ["v"], "n").join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
