"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved until a part is a leaf; leaves are encoded, and neighbours are joined by encoding anew a window around their
border. The window grows until it starts and ends at cuts that every longer text would keep, so tokens outside it stand.
Decoding concatenates token bytes up the same tree. Texts are rows, so the work is a map without any shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Characters of a leaf, and of the first window on either side of a border.
LEAF, WINDOW = 512, 64
#: A letter or digit before a plain space: no match of PATTERN goes over that border, whatever surrounds the two.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?= )")

Encode = Callable[[str], np.ndarray]


def load_ranks(path: str) -> dict[bytes, int]:
    """A public vocabulary file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _last_cut(text: str) -> int:
    """The last safe cut of text, looked for in growing windows at its end; 0 if there is none."""
    size = WINDOW
    while True:
        low = max(0, len(text) - size)
        found = [m.start() for m in _SAFE.finditer(text, low)]
        if found or low == 0:
            return found[-1] if found else 0
        size *= 2


def _first_cut(text: str) -> int:
    m = _SAFE.search(text)
    return m.start() if m else len(text)


def _tokens_in(lengths: np.ndarray, n_bytes: int, from_end: bool) -> int:
    """How many tokens at one end make up n_bytes; a safe cut always lies between tokens."""
    if n_bytes == 0:
        return 0
    run = np.cumsum(lengths[::-1] if from_end else lengths)
    return int(np.searchsorted(run, n_bytes)) + 1


def join(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray], encode: Encode, lengths: np.ndarray) -> tuple[str, np.ndarray]:
    """The element of text a + b from those of a and b; associative, with the empty text as its unit."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    low, high = _last_cut(a[0]), _first_cut(b[0])
    tail, head = a[0][low:], b[0][:high]
    keep = len(a[1]) - _tokens_in(lengths[a[1]], len(tail.encode()), True)
    drop = _tokens_in(lengths[b[1]], len(head.encode()), False)
    return a[0] + b[0], np.concatenate((a[1][:keep], encode(tail + head), b[1][drop:]))


def encode_tree(text: str, encode: Encode, lengths: np.ndarray, leaf: int = LEAF) -> tuple[str, np.ndarray]:
    if len(text) <= leaf:
        return text, encode(text)
    half = len(text) // 2
    return join(encode_tree(text[:half], encode, lengths, leaf), encode_tree(text[half:], encode, lengths, leaf), encode, lengths)


def decode_tree(ids: list[int], table: list[bytes], leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return b"".join(map(table.__getitem__, ids))
    half = len(ids) // 2
    return decode_tree(ids[:half], table, leaf) + decode_tree(ids[half:], table, leaf)


class Codec:
    """Encoder and decoder of one vocabulary, built once in each Python worker from its broadcast ranks."""

    _made: dict[int, Codec] = {}

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF):
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.table = [b""] * size
        for token, rank in ranks.items():
            self.table[rank] = token
        self.lengths = np.array([len(t) for t in self.table])
        self.names = [str(i) for i in range(size)]
        self.leaf = leaf
        self._plain = lambda text: np.array(encoding.encode_ordinary(text), np.int64)

    @classmethod
    def of(cls, ranks) -> Codec:
        if ranks.id not in cls._made:
            cls._made = {ranks.id: cls(ranks.value)}
        return cls._made[ranks.id]

    def encode(self, text: str) -> list[int]:
        return encode_tree(text, self._plain, self.lengths, self.leaf)[1].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return decode_tree(ids, self.table, self.leaf)


class _Broadcast:
    """Ranks of one vocabulary file, with the file's path to know them by."""

    def __init__(self, spark: SparkSession, path: str):
        self.id, self._shared = path, spark.sparkContext.broadcast(load_ranks(path))

    @property
    def value(self):
        return self._shared.value


def encode(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids array<int>) of docs (doc_id, text); a null or empty text has no ids. Repeated rows each get a row.

    The vocabulary is broadcast: a file of fixed size, whatever the input.
    """
    ranks = _Broadcast(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(ranks)
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.iloc[k : k + 512]
                yield pd.DataFrame({"doc_id": part.doc_id, "ids": [codec.encode(t or "") for t in part.text]})

    return small_batches(docs).select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, data binary) of tokens (doc_id, ids array<int>)."""
    ranks = _Broadcast(tokens.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(ranks)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "data": [codec.decode([] if i is None else list(i)) for i in b.ids]})

    return small_batches(tokens).select("doc_id", "ids").mapInPandas(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded, in one pass.

    The digests stand in for ids and bytes, which encode() and decode() return whole; with_ids adds `ids` here.
    """
    ranks = _Broadcast(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(ranks)
        name = codec.names.__getitem__
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.iloc[k : k + 512]
                n, told, back, kept = [], [], [], []
                for text in part.text:
                    ids = codec.encode(text or "")
                    n.append(len(ids))
                    told.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if with_ids:
                        kept.append(np.array(ids, np.int32))
                out = {"doc_id": part.doc_id, "n_tokens": n, "ids_sha256": told, "decoded_sha256": back}
                yield pd.DataFrame(out | {"ids": kept} if with_ids else out)

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(run, kinds + ", ids array<int>" * with_ids)
