"""Documents behind a transport as a Spark source: `spark.read.format(name)`, partitions of some documents each, errors as rows.

The transport is a function of an address, so a source for a real service and one for a test differ by it alone. It runs in the
executors; a document is asked for by the task that holds it, at its mirrors in turn.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.documents import objects
from . import fetch

#: Tasks that fetch at the same time: usually, at least and at most.
TASKS, TASKS_LEAST, TASKS_MOST = 4, 1, 12


def tasks(wanted: int = TASKS) -> int:
    return min(max(wanted, TASKS_LEAST), TASKS_MOST)


@dataclass
class Documents(InputPartition):
    """Some documents that one task gets: keys, and each one's addresses."""

    items: list[tuple[str, list[str]]]


#: What gets one document of a source at its addresses, for each source made here, by its name.
_getters: dict[str, Callable[[list[str]], str]] = {}


def whole_talk(body: str) -> bool:
    """Whether a scenario document has any talk; one without may only be half there."""
    try:
        return bool(isinstance(talk := json.loads(body).get("TalkData"), list) and talk)
    except (ValueError, AttributeError):
        return False


def source(name: str, get: Callable[[str], str], complete: Callable[[str], bool] | None = None, delay: float = 2.0, again: float = 0.5) -> type[DataSource]:
    """A data source class for spark.dataSource.register(): (key, body, error) of the documents of option `documents`, JSON [[key, [address, ...]], ...], in `tasks` tasks.

    The first answer of the mirrors holds, the next one being asked after `delay` seconds or a failure; where `complete` tells whole
    documents from others, mirrors are asked one after the other until one has it whole. A document that can't be got has its error.
    """

    def document(urls: list[str]) -> str:
        mirrors = fetch.distinct(urls)
        return fetch.first_complete(get, mirrors, complete, again) if complete else fetch.first_good(get, mirrors, delay, again)

    _getters[name] = document

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.items = [(str(k), list(urls)) for k, urls in json.loads(options.get("documents", "[]"))]
            self.n = tasks(int(options.get("tasks", TASKS)))

        def partitions(self) -> list[InputPartition]:
            return [Documents(part) for i in range(self.n) if (part := self.items[i :: self.n])] or [Documents([])]

        def read(self, partition: Documents) -> Iterator[tuple]:
            for key, urls in partition.items:
                try:
                    yield key, document(urls), None
                except Exception as e:  # one document's failure is a row, not the job's
                    yield key, None, str(e)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "key string, body string, error string"

        def reader(self, schema) -> DataSourceReader:
            return Reader({k.lower(): v for k, v in self.options.items()})

    return Source


def load(spark: SparkSession, name: str, wanted: list[tuple[str, list[str]]], at_once: int = TASKS) -> DataFrame:
    """(key, body, error) of some documents of a registered source. They are fetched whenever rows are computed, so store them first if they are read twice."""
    return spark.read.format(name).option("documents", json.dumps(wanted)).option("tasks", str(at_once)).load()


def array_documents(rows: DataFrame) -> DataFrame:
    """(key, ord, doc) of bodies that are JSON arrays: their elements that are objects, in order. Another body, or an error, stops the job with its key."""
    parsed = rows.withColumn("v", F.try_parse_json("body"))
    no_array = F.raise_error(F.concat(F.lit("no JSON array: "), "key", F.coalesce(F.concat(F.lit(": "), "error"), F.lit(""))))
    checked = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(F.parse_json(no_array.cast("string")))
    return parsed.select("key", F.posexplode(objects(checked, "$")).alias("ord", "doc"))


#: Documents that a task hands on together.
_TOGETHER = 64


def scenario_fetch(spark: SparkSession, name: str, urls: Callable[[str, int, str], list[str]], at_once: int = TASKS) -> Callable[[DataFrame, str], DataFrame]:
    """A Fetch for plans.stories.walk_stories over a source made by source(); urls(edition, event_id, scenario_id) names a scenario's mirrors.

    The episodes that it is given go to the tasks that fetch, so there may be any number of them.
    """
    document = _getters[name]

    def get(wanted: DataFrame, edition: str) -> DataFrame:
        def body(event: int, scenario: str) -> str | None:
            try:
                return document(urls(edition, event, scenario))
            except Exception:  # one document's failure is a row, not the job's
                return None

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for lo in range(0, len(frame), _TOGETHER):
                    part = frame.iloc[lo : lo + _TOGETHER]
                    yield part[["event_id", "episode_no"]].assign(body=[body(e, s) for e, s in zip(part.event_id.tolist(), part.scenario_id.tolist(), strict=True)])

        docs = wanted.select("event_id", "episode_no", "scenario_id").repartition(tasks(at_once)).mapInPandas(run, "event_id bigint, episode_no string, body string")
        return docs.select("event_id", "episode_no", F.try_parse_json("body").alias("doc"))

    return get


class Landing:
    """Documents of a source stored in a folder as they came, so that what is read from them again is not fetched again."""

    def __init__(self, spark: SparkSession, name: str, folder: str):
        self.spark, self.name, self.folder = spark, name, folder.rstrip("/")

    def land(self, wanted: list[tuple[str, list[str]]], at_once: int = TASKS) -> DataFrame:
        path = f"{self.folder}/{int(time.time() * 1000):013d}-{uuid.uuid4().hex}"
        load(self.spark, self.name, wanted, at_once).write.parquet(path)
        return self.spark.read.schema("key string, body string, error string").parquet(path)

    def editions(self, documents: dict[str, list[str]], at_once: int = TASKS) -> dict[str, DataFrame]:
        """(ord, doc) by name of the documents of one edition for plans.sync.sync; names whose document didn't come are left out."""
        rows = self.land(list(documents.items()), at_once)
        came = [r.key for r in rows.where("error is null").select("key").collect()]  # as many as there are documents
        return {n: array_documents(rows.where(F.col("key") == n)).select(F.col("ord").cast("bigint").alias("ord"), "doc") for n in came}
