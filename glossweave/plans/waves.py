"""Calls of a service that is paid for and can't be repeated: in waves of batches, each logged for good before the next wave begins.

A plan lists what to ask for in numbered batches of groups (a story, a field). A wave takes the next batches of some groups, whole
groups in a task; a group's batches go one after the other and end with its first failure. Every task's answers are a file of the log
as soon as the task ends, so a run that dies loses the calls of running tasks at most, and a run after it asks only for the rest.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fill
from ..sources import commits

#: What a run tells while it goes on: stage, detail, how much is done, and of how much.
Publish = Callable[[str, str, int, int], None]


class Progress:
    """Counts of what tasks have done, published from the driver while their job runs."""

    def __init__(self, spark: SparkSession, publish: Publish | None, stage: str, total: int, every: float = 1.0):
        self.publish, self.stage, self.total, self.every = publish, stage, total, every
        self.done = spark.sparkContext.accumulator(0)
        self._told = -1

    def tell(self, detail: str = "") -> None:
        n = min(int(self.done.value), self.total)  # a task that ran twice counts twice
        if self.publish and n > self._told:
            self._told = n
            self.publish(self.stage, detail, n, self.total)

    @contextmanager
    def watched(self, detail: str = "") -> Iterator[None]:
        """Tell what is done every few seconds until the block ends, and then once more."""
        over = threading.Event()

        def watch() -> None:
            while not over.wait(self.every):
                self.tell(detail)

        watcher = threading.Thread(target=watch, daemon=True)
        self.tell(detail)
        watcher.start()
        try:
            yield
        finally:
            over.set()
            watcher.join()
            self.tell(detail)


class SharedBreaker:
    """A breaker whose state is a small file, so that runs of other sessions pause too."""

    def __init__(self, spark: SparkSession, folder: str, cooldown: float = fill.COOLDOWN, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.clock, self.state = spark, folder.rstrip("/"), clock, fill.Breaker(cooldown)

    def _save(self) -> None:
        content = f"{self.state.until!r} {self.state.error}"
        while not commits.create_once(self.spark, f"{self.folder}/{commits.number((n := commits.newest(self.spark, self.folder)) + 1)}", content):
            pass
        for name in commits.names(self.spark, self.folder):
            if name.isdigit() and int(name) < n:
                commits.delete(self.spark, f"{self.folder}/{name}")

    def _load(self) -> None:
        if n := commits.newest(self.spark, self.folder):
            until, error = commits.text(self.spark, f"{self.folder}/{commits.number(n)}").split(" ", 1)
            self.state.until, self.state.error = float(until), error

    def closed(self) -> str | None:
        """Why automatic calls pause, or None."""
        self._load()
        return self.state.closed(self.clock())

    def went_well(self) -> None:
        self._load()
        if self.state.until:
            self.state.went_well()
            self._save()

    def failed(self, error: str) -> None:
        self.state.failed(error, self.clock())
        self._save()


class BatchLog:
    """Answers of a service, only ever added to: a folder for each run, with one for each wave in it.

    Rows are known by their key, so answers that a task gave twice, or that a run before had given already, count once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def add(self, rows: DataFrame, run: str, wave: int) -> DataFrame:
        """Have rows computed, and read back what was stored of them. Tasks commit their own files, whatever becomes of the job."""
        folder = f"{self.path}/{run}/{wave:08d}"
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def runs(self) -> list[str]:
        return sorted(commits.names(self.spark, self.path))

    def read(self) -> DataFrame:
        """Every answer that isn't blank, one for each key."""
        if not self.runs():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{r}" for r in self.runs()))
        return rows.where("cn_text <> ''").groupBy(*self.key).agg(F.max("cn_text").alias("cn_text"))

    def forget(self, runs: list[str]) -> None:
        """Delete runs whose answers are in the tables."""
        for r in runs:
            commits.delete(self.spark, f"{self.path}/{r}")


@dataclass
class Settings:
    """How calls are made: tries and waits of a batch, batches that a group makes in a wave, groups of a wave, and the pause between a group's batches."""

    tries: int = fill.TRIES
    wait: float = 1.0
    span: int = 4
    groups: int | None = None
    delay: float = 0.0

    def automatic(self) -> Settings:
        """Fail fast: one try of each batch, one batch of a group at a time."""
        return Settings(fill.automatic(0)["tries"], 0.0, 1, self.groups, self.delay)


@dataclass
class Outcome:
    """What a run did: answers, and the first few errors of those there were; `paused` says why automatic calls stopped."""

    candidates: int = 0
    translated: int = 0
    groups: int = 0
    errors: int = 0
    shown: list[str] = field(default_factory=list)
    paused: str = ""


#: Groups that one task asks for at most, so that a run that dies loses no more than these, and tasks of a wave whose groups are few.
GROUPS_OF_TASK, TASKS_A_CORE = 256, 4


def _asker(translate: fill.Translate, names: list[str], settings: Settings, done):
    """Of a task's rows in the order of group, batch and item: answers, batch by batch, so that no group is held whole."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, last, failed = None, None, None  # rows of a batch that may go on, the group that was asked for last, the group that failed

        def answers(rows: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
            nonlocal last, failed
            at, texts, errors, group, jp = [], [], [], rows["group_no"].tolist(), rows["jp"].tolist()
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if group[lo] == failed:
                    continue  # the rest of this group waits for another run
                if group[lo] == last and settings.delay:
                    time.sleep(settings.delay)
                got, error = fill.call(translate, jp[lo:hi], settings.tries, settings.wait)
                last, failed = group[lo], group[lo] if error else failed
                at += range(lo, hi)
                texts += [t.strip() for t in got]
                errors += [error] * (hi - lo)
                if not error:
                    done.add(hi - lo)
            return rows.iloc[at][names].assign(cn_text=pd.Series(texts, dtype=object).to_numpy(), error=pd.Series(errors, dtype=object).to_numpy())

        for frame in frames:
            rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            new = (rows[["group_no", "batch_no"]] != rows[["group_no", "batch_no"]].shift()).any(axis=1)
            cuts = [0, *(i for i in new.to_numpy().nonzero()[0].tolist() if i)]
            rest = rows.iloc[cuts[-1] :].reset_index(drop=True)
            yield answers(rows, cuts)
        if rest is not None and len(rest):
            yield answers(rest, [0, len(rest)])

    return ask


def ask_all(plan: DataFrame, log: BatchLog, translate: fill.Translate, settings: Settings | None = None, automatic: bool = False, breaker: SharedBreaker | None = None, publish: Publish | None = None, stage: str = "fill", each_wave: Callable[[], None] | None = None) -> tuple[Outcome, str]:
    """Ask for all rows of a stored plan (group_no long, batch_no, item_no, jp, and the log's key), groups in order. What came of it, and the run's name in the log.

    An automatic run makes no call while the breaker is open, opens it at a failure and stops after that wave; any run's calls set it.
    A failure in another run ends its group only. each_wave is called after every wave, when its answers are stored. The driver gets
    counts and the first errors of a wave, whatever its groups.
    """
    spark, run = plan.sparkSession, f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex}"
    settings = (settings or Settings()).automatic() if automatic else settings or Settings()
    size = settings.groups or spark.sparkContext.defaultParallelism
    outcome = Outcome(candidates=plan.count())
    progress = Progress(spark, publish, stage, outcome.candidates)
    names = ["group_no", *log.key]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.select(*names).schema) + ", cn_text string, error string"
    ask = _asker(translate, names, settings, progress.done)
    after, wave = None, 0
    while True:
        left = plan if after is None else plan.where(F.col("group_no") > after)
        groups = left.where("group_no is not null").groupBy("group_no").agg(F.max("batch_no").alias("last"))
        ends = [F.min("group_no").alias("low"), F.max("group_no").alias("high"), F.max("last").alias("last"), F.count("*").alias("n")]
        if (frontier := groups.agg(*ends).first()).n > size:
            frontier = groups.orderBy("group_no").limit(size).agg(*ends).first()
        if frontier.low is None:
            break
        after, at, of = frontier.high, 0, plan.where(F.col("group_no").between(frontier.low, frontier.high))
        answered, last = None, frontier.last  # groups of the frontier that were answered in its earlier waves, and its last batch
        while last is not None and at <= last:
            if automatic and breaker and (why := breaker.closed()):
                outcome.paused = why
                return outcome, run
            rows = of.where(F.col("batch_no").between(at, at + settings.span - 1))
            n = rows.select("group_no").distinct().count()
            tasks = max(1, min(n, spark.sparkContext.defaultParallelism * TASKS_A_CORE), -(-n // GROUPS_OF_TASK))
            with progress.watched(f"groups {frontier.low} to {frontier.high}"):
                ordered = rows.select(*names, *({"batch_no", "item_no", "jp"} - set(names))).repartition(tasks, "group_no").sortWithinPartitions("group_no", "batch_no", "item_no")
                stored = log.add(ordered.mapInPandas(ask, schema), run, wave)
            came = stored.where("cn_text <> ''").select("group_no")
            new = came.distinct() if answered is None else came.distinct().join(answered, "group_no", "left_anti")
            outcome.translated += came.count()
            outcome.groups += new.count()
            answered = new if answered is None else answered.union(new)
            failed = stored.where("error <> ''").groupBy("group_no").agg(F.max("error").alias("error"))
            wrong = failed.count()
            outcome.errors += wrong
            first = [r.error for r in failed.orderBy("group_no").limit(3).collect()] if wrong else []
            outcome.shown = [*outcome.shown, *first][:3]
            if breaker and wrong:
                breaker.failed(first[0])
            elif breaker:
                breaker.went_well()
            wave, at = wave + 1, at + settings.span
            if each_wave:
                each_wave()
            if wrong and automatic:
                outcome.paused = first[0]
                return outcome, run
            if wrong:
                of = of.join(failed.select("group_no"), "group_no", "left_anti")
                last = of.agg(F.max("batch_no")).first()[0]
    return outcome, run
