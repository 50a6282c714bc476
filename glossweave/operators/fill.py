"""Filling gaps through a pluggable text function: candidates, batches, calls and what comes back."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import CN, HUMAN, PINNED

#: Texts of a call, and tries of a call.
BATCH, TRIES = 20, 3
Translate = Callable[[list[str]], list[str]]


#: Seconds that automatic calls pause after a failure, and the longest that one may take.
COOLDOWN, AUTOMATIC_TIMEOUT = 600.0, 30.0


class Breaker:
    """Whether automatic calls may go on: after a failure they pause, until a call goes well or the pause is over."""

    def __init__(self, cooldown: float = COOLDOWN):
        self.cooldown, self.until, self.error = cooldown, 0.0, ""

    def went_well(self) -> None:
        self.until, self.error = 0.0, ""

    def failed(self, error: str, now: float) -> None:
        self.until, self.error = now + self.cooldown, error

    def closed(self, now: float) -> str | None:
        """Why calls pause, or None."""
        if now < self.until:
            return f"paused for {self.until - now:.0f} s: {self.error}"
        self.went_well()
        return None


def automatic(timeout: float) -> dict:
    """Settings of an automatic call, which fails fast: one try, and not long."""
    return {"timeout": min(timeout, AUTOMATIC_TIMEOUT), "tries": 1}


def candidates(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Blank texts that no person or official edition owns, by key; at most `limit` of each field, the first in order."""
    rows = entries.where(~F.col("source").isin(HUMAN, PINNED, CN) & (F.col("cn_text") == "")).select("category", "field", "jp_key")
    if limit is None:
        return rows
    order = Window.partitionBy("category", "field").orderBy("jp_key")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).drop("r")


def candidate_counts(entries: DataFrame) -> DataFrame:
    """Per field: candidates and rows that aren't."""
    is_one = ~F.col("source").isin(HUMAN, PINNED, CN) & (F.col("cn_text") == "")
    return entries.groupBy("category", "field").agg(F.count_if(is_one).alias("candidates"), F.count_if(~is_one).alias("rejected"))


def batches(rows: DataFrame, groups: list[str], order: list[str], size: int = BATCH) -> DataFrame:
    """Rows with the number of their batch within their group, and their place in it from 1."""
    n = F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1
    return rows.withColumn("_n", n).withColumn("batch_no", F.floor(F.col("_n") / size).cast("int")).withColumn("item_no", (F.col("_n") % size + 1).cast("int")).drop("_n")


def _enough(texts: list[str]) -> bool:
    return sum(bool(t.strip()) for t in texts) >= (len(texts) + 1) // 2


def call(translate: Translate, texts: list[str], tries: int = TRIES, wait: float = 1.0) -> tuple[list[str], str]:
    """(texts, error) of one batch: as many as were asked for, blank where nothing came. A call must fill at least half, else it is tried again."""
    error = ""
    for n in range(1, tries + 1):
        try:
            got = [*translate(texts), *[""] * len(texts)][: len(texts)]
            if _enough(got):
                return got, ""
            error = f"{sum(bool(t.strip()) for t in got)} of {len(texts)} texts came back"
        except Exception as e:  # a service may fail in any way; the batch says so in its row
            error = f"{type(e).__name__}: {e}"
        if n < tries:
            time.sleep(n * wait)
    return [""] * len(texts), error


def translated(batched: DataFrame, translate: Translate, groups: list[str], text: str, tries: int = TRIES, wait: float = 1.0) -> DataFrame:
    """batched rows with `cn_text` and `error`, a call for each batch of a group. A batch is small by construction, so a group fits a task."""
    names = [*groups, "batch_no"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batched.schema) + ", cn_text string, error string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_no")
        got, error = call(translate, list(pdf[text]), tries, wait)
        return pdf.assign(cn_text=pd.Series(got, index=pdf.index, dtype=object), error=pd.Series([error] * len(pdf), index=pdf.index, dtype=object))

    return batched.groupBy(*names).applyInPandas(run, schema)


def resumable(pending: Callable[[], DataFrame], step: Callable[[DataFrame], None], size: int) -> Iterator[int]:
    """Take the first `size` of what is pending, have `step` commit it, and go on until nothing is or nothing changes.

    What is pending is read anew each time from the committed state, so a run after a failure goes on where it ended.
    """
    before = None
    while True:
        left = pending()
        n = left.count()
        if n == 0 or n == before:
            return
        step(left.limit(size))
        before = n
        yield n
