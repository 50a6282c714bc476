"""A place for what a job writes between its steps, that the driver and all executors reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[tempfile.TemporaryDirectory] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, which only a local session may leave so, under one of this process."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.TemporaryDirectory(prefix="glossweave-jobs-"))  # deleted at exit
        top = _own[0].name
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
