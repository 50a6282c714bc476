"""License texts inside documents: MinHash bands over overlapping word windows, then exact shingle containment.

For every length of template, a text is covered by windows of that many words at a fixed step. A window's MinHash bands look up
templates of that length; a text that holds a template agrees with it in at least one band with a chance over 0.999 (see
BANDS). Each pair found is verified by the share of the template's shingles that the window and its surroundings hold.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, small_batches, utf8, word_hashes

#: Wordings of public licenses and notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
#: Words of a shingle, and the share of a template's shingles that a match holds. A template of fewer words is one shingle.
SHINGLE, CONTAINMENT = 5, 0.8
#: A window that holds 0.8 of a template's n shingles and lies up to half a step of n/4 off it has a similarity of 0.5 at
#: least. 32 bands of 2 rows then agree somewhere with a chance of 1 - (1 - 0.5^2)^32 = 0.9999.
BANDS, ROWS = 32, 2

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with ASCII punctuation read as blanks."""
    return word_hashes([t.translate(_PLAIN) for t in texts])


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        h = mix(h + words[i : i + len(h)] + np.uint64(i + 1))
    return h


class Scanner:
    """Bands of the templates, by their length in words."""

    def __init__(self, templates: dict[str, str]):
        self.factors = mix(np.arange(101, 101 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)
        self.names = sorted(templates)
        self.sets, self.classes = [], {}
        for t, name in enumerate(self.names):
            words, _ = _words(utf8([templates[name]]))
            k = min(SHINGLE, len(words))
            shingles = np.unique(_runs(words, k)) if k else np.zeros(0, np.uint64)
            self.sets.append(shingles)
            if k:
                self.classes.setdefault((len(words), k), []).append(t)
        self.known = {size: np.unique(np.concatenate([self.sets[t] for t in ts])) for size, ts in self.classes.items()}
        self.bands = {}
        for (size, k), ts in self.classes.items():
            table = self.bands[size, k] = {}
            for t in ts:
                for key in self._keys(self.sets[t][None, :])[0]:
                    table.setdefault(int(key), []).append(t)

    def _keys(self, windows: np.ndarray) -> np.ndarray:
        """Band keys of each row of shingle hashes."""
        sig = np.stack([mix(windows * f).min(axis=1) for f in self.factors], axis=1).reshape(len(windows), BANDS, ROWS)
        key = np.zeros(sig.shape[:2], np.uint64)
        for r in range(ROWS):
            key = mix(key + sig[:, :, r])
        return mix(key + np.arange(BANDS, dtype=np.uint64))

    def scan(self, texts: list[bytes]) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, end word, containment). Of overlapping matches of a template the best, then first, stays."""
        words, ends = _words(texts)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        found = []
        for (size, k), known in self.known.items():
            n = size - k + 1  # shingles of a window
            h = _runs(words, k)
            # A window without any template shingle has similarity 0 to every template, so only the others are signed.
            hit = np.flatnonzero(np.isin(h, known)) if len(h) else np.zeros(0, np.int64)
            text = np.searchsorted(ends, hit, side="right")
            inside = hit + k <= ends[text] if len(hit) else np.zeros(0, bool)
            hit, text = hit[inside], text[inside]
            if not len(hit):
                continue
            step = max(1, n // 4)
            rel = hit - starts[text]
            last = np.maximum(ends[text] - starts[text] - size, 0)  # the last window of a text
            at = [np.minimum(np.maximum(rel // step - j, 0) * step, last) for j in range(n // step + 1)] + [last]
            pairs = np.unique(np.stack((np.tile(text, len(at)), np.concatenate(at)), axis=1), axis=0)
            for lo in range(0, len(pairs), 4096):
                part = pairs[lo : lo + 4096]
                first = starts[part[:, 0]] + part[:, 1]
                stop = ends[part[:, 0]]
                place = np.minimum(first[:, None] + np.arange(n), np.maximum(stop - k, first)[:, None])
                place = np.minimum(place, len(h) - 1)
                keys = self._keys(h[place])
                for i in range(len(part)):
                    for t in sorted({t for key in keys[i].tolist() for t in self.bands[size, k].get(key, ())}):
                        a = max(int(starts[part[i, 0]]), int(first[i]) - step)
                        z = min(int(stop[i]), int(first[i]) + size + step)
                        at_ = np.flatnonzero(np.isin(h[a : z - k + 1], self.sets[t]))
                        share = len(np.unique(h[a : z - k + 1][at_])) / len(self.sets[t])
                        if share >= CONTAINMENT:
                            o = int(starts[part[i, 0]])
                            found.append((int(part[i, 0]), t, a + int(at_[0]) - o, a + int(at_[-1]) + k - o, share))
        kept: list = []
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}  # kept places by text and template, in their order
        for m in sorted(set(found), key=lambda m: (m[0], m[1], -m[4], m[2], m[3])):
            own = spans.setdefault(m[:2], [])
            # Kept places don't overlap, so only the last one that starts before this one's end can overlap it.
            at = bisect_left(own, (m[3],))
            if not at or own[at - 1][1] <= m[2]:
                own.insert(at, (m[2], m[3]))
                kept.append(m)
        return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, first_word, end_word, containment) of every match in docs (doc_id, text); words are counted in the text.

    A text is scanned whole within its row, so nothing is shuffled. Null and empty texts hold nothing, repeated rows each
    give their matches, and templates without words match nothing. An empty table gives an empty table.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = utf8(b.text)
            for lo, hi in chunks(raw):
                rows = scanner.scan(raw[lo:hi])
                if not rows:
                    continue
                ids = b.doc_id.iloc[lo:hi].array
                yield pd.DataFrame({"doc_id": ids[[r[0] for r in rows]], "license": [scanner.names[r[1]] for r in rows], "first_word": [r[2] for r in rows], "end_word": [r[3] for r in rows], "containment": [r[4] for r in rows]})

    return small_batches(docs).select("doc_id", "text").where(F.length("text") > 0).mapInPandas(run, "doc_id long, license string, first_word int, end_word int, containment double")
