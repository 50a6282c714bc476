"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad given features of itself and its two neighbours. Documents are labelled, lines are not, so the field
is fitted in rounds: a bad document's lines are bad at first, later those that the field itself finds bad. A document's quality
is the mean of its lines' marginals, weighted by length, put on the scale of the labels by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_bucket, cut, small_batches, utf8, word_hashes

#: Labelled rows that the field is fitted on at most, the longest text among them in characters and lines, and lines of all of them
#: together. Features are 47 numbers a line, so the driver holds some 150 MB at most.
FIT_ROWS, FIT_CHARS, FIT_LINES, FIT_ALL_LINES = 2000, 100_000, 500, 200_000
#: A document is kept from this score on.
KEEP_FROM = 0.3
ROUNDS, STEPS, RATE, SHRINK = 3, 80, 0.1, 1e-3

_B = np.arange(256)
_UPPER, _LOWER, _DIGIT = (_B >= 65) & (_B <= 90), (_B >= 97) & (_B <= 122), (_B >= 48) & (_B <= 57)
_BLANK, _WIDE = np.isin(_B, [9, 10, 11, 12, 13, 32]), _B >= 128
_STOP = np.isin(_B, list(b".,;:?'\"-"))
_BANG, _BAR = _B == ord("!"), _B == ord("|")
_ODD = ~(_UPPER | _LOWER | _DIGIT | _BLANK | _WIDE | _STOP | _BANG | _BAR)
_KINDS = [_UPPER, _LOWER, _DIGIT, _BLANK, _WIDE, _STOP, _BANG, _BAR, _ODD]
N_OWN = len(_KINDS) + 6


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes, the line at which each text ends). An empty text is one empty line."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = (ends - starts).astype(float)
    text_ends = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]) - 1) + 1
    x = np.empty((len(ends), N_OWN))
    for j, kind in enumerate(_KINDS):
        x[:, j] = np.add.reduceat(kind.view(np.uint8)[raw], starts, dtype=np.int32)
    x[:, 3] -= 1  # of blanks, the line end itself
    n_words = np.zeros(len(ends))
    same = [np.zeros(len(ends)) for _ in range(3)]
    h, _ = word_hashes([raw[:-1].tobytes()])
    if len(h):
        word = ~_BLANK[raw]
        at = np.searchsorted(ends, np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)) == 1))
        n_words = np.bincount(at, minlength=len(ends)).astype(float)
        for lag, out in enumerate(same, 1):
            hit = (h[lag:] == h[:-lag]) & (at[lag:] == at[:-lag])
            out += np.bincount(at[lag:], weights=hit, minlength=len(ends))
    x[:, : len(_KINDS)] /= np.maximum(n, 1)[:, None]
    k = len(_KINDS)
    for j, s in enumerate(same):
        x[:, k + j] = s / np.maximum(n_words, 1)
    x[:, k + 3] = np.log1p(n) / 8
    x[:, k + 4] = np.minimum(n / np.maximum(n_words, 1), 40) / 10
    x[:, k + 5] = n_words == 0
    first = np.concatenate(([0], text_ends[:-1]))
    before, after = np.vstack((np.zeros(N_OWN), x[:-1])), np.vstack((x[1:], np.zeros(N_OWN)))
    before[first], after[text_ends - 1] = 0, 0
    edge = np.zeros((len(x), 2))
    edge[first, 0] = edge[text_ends - 1, 1] = 1
    return np.hstack((x, before, after, edge)), n, text_ends


@dataclass
class Field:
    """Weights: of the standardised features for bad against good, of transitions, and of the closing logistic curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def pull(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights[1:] + self.weights[0]


def forward_backward(pull: np.ndarray, moves: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's chance to be good, and the summed chances of pairs of neighbouring labels, label 1 being good.

    All texts advance together, line by line; those that have ended drop out.
    """
    starts = np.concatenate(([0], ends[:-1]))
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    starts, size = starts[order], size[order]
    score = np.stack((np.zeros(len(pull)), pull), axis=1)
    ahead, back = score.copy(), np.zeros_like(score)
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]) if len(size) else 0)]  # of more than t lines
    for t in range(1, len(active)):
        at = starts[: active[t]] + t
        prev = ahead[at - 1]
        ahead[at] += np.logaddexp(prev[:, :1] + moves[0], prev[:, 1:] + moves[1])
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        nxt = score[at] + back[at]
        back[at - 1] = np.logaddexp(moves[:, 0] + nxt[:, :1], moves[:, 1] + nxt[:, 1:])
    both = ahead + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    pairs = np.zeros((2, 2))
    inner = np.ones(len(pull), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    for i in range(2):
        for j in range(2):
            pairs[i, j] = np.exp(ahead[at - 1, i] + moves[i, j] + score[at, j] + back[at, j] - total[at]).sum()
    return np.exp(both[:, 1] - total), pairs


def _adam(value: np.ndarray, grad, steps: int) -> np.ndarray:
    m, v = np.zeros_like(value), np.zeros_like(value)
    for t in range(1, steps + 1):
        g = grad(value)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        value = value - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return value


def _by_text(values: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean of the lines' values, weighted by length; an empty line counts as one byte."""
    starts, w = np.concatenate(([0], ends[:-1])), lengths + 1
    return np.add.reduceat(values * w, starts) / np.add.reduceat(w, starts)


def _odds(share: np.ndarray) -> np.ndarray:
    s = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(s / (1 - s))


def fit(x: np.ndarray, lengths: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> Field:
    starts = np.concatenate(([0], ends[:-1]))
    text_of = np.repeat(np.arange(len(ends)), ends - starts)
    f = Field(x.mean(0), x.std(0) + 1e-3, np.zeros(x.shape[1] + 1), np.zeros((2, 2)))
    z = np.hstack((np.ones((len(x), 1)), (x - f.mean) / f.scale))
    y = labels[text_of].astype(float)
    inner = np.ones(len(x), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    n = z.shape[1]
    for r in range(ROUNDS):
        if r:
            p, _ = forward_backward(f.pull(x), f.moves, ends)
            lowest = np.minimum.reduceat(p, starts)[text_of]
            y = np.where(labels[text_of] == 1, 1.0, ((p > 0.5) & (p > lowest)).astype(float))
        seen = np.array([[np.sum((y[at - 1] == i) & (y[at] == j)) for j in range(2)] for i in range(2)], float)

        def grad(v: np.ndarray, y=y, seen=seen) -> np.ndarray:
            p, pairs = forward_backward(z @ v[:n], v[n:].reshape(2, 2), ends)
            return np.concatenate((z.T @ (p - y), (pairs - seen).ravel())) / len(ends) + SHRINK * v

        found = _adam(np.concatenate((f.weights, f.moves.ravel())), grad, STEPS)
        f.weights, f.moves = found[:n], found[n:].reshape(2, 2)
    share = _odds(_by_text(forward_backward(f.pull(x), f.moves, ends)[0], lengths, ends))
    curve = _adam(np.array([1.0, 0.0]), lambda c: np.array([((e := 1 / (1 + np.exp(-c[0] * share - c[1])) - labels) * share).mean(), e.mean()]) + [SHRINK * c[0], 0], 300)
    f.slope, f.shift = max(float(curve[0]), 1e-3), float(curve[1])
    return f


def score_texts(f: Field, texts: list[bytes]) -> np.ndarray:
    """Scores 0 to 1. A text without any word has score 0."""
    x, lengths, ends = line_features(texts)
    share = _by_text(forward_backward(f.pull(x), f.moves, ends)[0], lengths, ends)
    s = 1 / (1 + np.exp(-f.slope * _odds(share) - f.shift))
    return np.where([not t.strip() for t in texts], 0.0, s)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, rows: int = FIT_ROWS) -> Field:
    """Fit on labelled documents whose crc32(doc_id) isn't 0 modulo folds: at most `rows` of them, in the order of a hash.

    The sample's features are made by tasks and gathered: at most `rows` texts of FIT_CHARS characters and FIT_LINES lines, as many
    as have FIT_ALL_LINES lines together. Of several texts of one id the one with the least hash counts, and the others never leave
    their tasks. Null ids, texts and labels take no part. Without labels of both kinds, every text with words scores the share of good labels (1 if none).
    """
    wanted = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), folds) != 0))
    wanted = wanted.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    n_lines = 1 + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    texts = small_batches(docs).select("doc_id", "text").where(F.length("text").between(1, FIT_CHARS) & (n_lines <= FIT_LINES))
    sample = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))
    sample = cut(sample.select("doc_id", "quality", F.col("m.text").alias("text")))
    sizes = sample.select("doc_id", F.xxhash64("doc_id").alias("h"), n_lines.alias("n")).orderBy("h", "doc_id").collect()  # at most `rows`
    total = np.cumsum([r.n for r in sizes])
    sample = sample.where(F.col("doc_id").isin([r.doc_id for r, t in zip(sizes, total, strict=True) if t <= FIT_ALL_LINES]))

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = utf8(b.text)
            for lo, hi in chunks(raw):
                x, n, ends = line_features(raw[lo:hi])
                cuts = ends[:-1]
                yield pd.DataFrame({"doc_id": b.doc_id.iloc[lo:hi], "quality": b.quality.iloc[lo:hi], "x": [v.astype("f4").tobytes() for v in np.split(x, cuts)], "n": [v.astype("f8").tobytes() for v in np.split(n, cuts)]})

    found = sample.mapInPandas(prepare, "doc_id long, quality int, x binary, n binary").toPandas().sort_values("doc_id", kind="stable")
    y = found.quality.to_numpy(int) if len(found) else np.ones(0, int)
    width = 3 * N_OWN + 2
    if len(set(y)) < 2:
        share = np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6)
        return Field(np.zeros(width), np.ones(width), np.zeros(width + 1), np.zeros((2, 2)), 1e-3, float(np.log(share / (1 - share))))
    n = [np.frombuffer(v) for v in found.n]
    x = np.concatenate([np.frombuffer(v, "f4").reshape(-1, width) for v in found.x]).astype(float)
    return fit(x, np.concatenate(n), np.cumsum([len(v) for v in n]), y)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of docs (doc_id, text); one row for each row, a null text being empty."""
    field = train(docs, labels, folds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = utf8(b.text)
            scores = [score_texts(field, raw[lo:hi]) for lo, hi in chunks(raw)]
            yield pd.DataFrame({"doc_id": b.doc_id, "held_out": b.held_out, "score": np.concatenate(scores) if scores else []})

    rows = docs.select("doc_id", (crc_bucket(F.col("doc_id"), folds) == 0).alias("held_out"), "text")
    scored = rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of docs whose text scores KEEP_FROM or more, all columns as they are; only texts go through Python."""
    field = train(docs, labels, folds)

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            raw = utf8(texts)
            scores = [score_texts(field, raw[lo:hi]) for lo, hi in chunks(raw)]
            yield pd.Series(np.concatenate(scores) if scores else np.zeros(0))

    return docs.where(quality("text") >= KEEP_FROM)
