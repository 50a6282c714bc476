"""Small files that are made once: what decides between writers that would commit the same version, and between runs that would hold one lock.

All of it goes through Hadoop's file systems, on the driver, and handles a line of text at a time; data files are Spark's.
"""

from __future__ import annotations

import contextlib
import os
import time
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> dict[str, float]:
    """Names in a folder and when each was changed, in seconds; none if there is no folder."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return {}
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(p)}


def text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Make the file `path`, whole, if there is none; False if another writer was first.

    It is written under a name of its own and then renamed without replacing, which HDFS does in one step. Java's rename on local
    disks would replace, so there a hard link takes the name. A store whose renames are copies needs a lock of its own.
    """
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    own = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(own)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()
    if fs.getScheme() == "file":
        local = lambda x: unquote(urlsplit(x).path) if x.startswith("file:") else x
        try:
            os.link(local(own), local(path))
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(at, False)
    jvm = spark._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(at, p, how)
        return True
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    finally:
        fs.delete(at, False)


def newest(spark: SparkSession, folder: str) -> int:
    """The highest number of the files that create_once() made in a folder, named by numbers; 0 if there is none."""
    return max((int(n) for n in names(spark, folder) if n.isdigit()), default=0)


def number(n: int) -> str:
    return f"{n:020d}"


class Busy(RuntimeError):
    """Another run holds the lock."""


class RunLock:
    """One run at a time: a lease that other sessions see, taken by making the next of a row of numbered files.

    A lease ends by release(), or when its seconds are over, so a driver that died holds up nobody for long; renew() before that.
    Use it as a context: `with RunLock(spark, folder, "fill"): ...`.
    """

    def __init__(self, spark: SparkSession, folder: str, mode: str, seconds: float = 3600.0, clock=time.time):
        self.spark, self.folder, self.mode, self.seconds, self.clock = spark, folder.rstrip("/"), mode, seconds, clock
        self.token, self.at = uuid.uuid4().hex, 0

    def _last(self) -> tuple[int, str, float, str]:
        n = newest(self.spark, self.folder)
        if not n:
            return 0, "", 0.0, ""
        token, until, mode = text(self.spark, f"{self.folder}/{number(n)}").split(" ", 2)
        return n, token, float(until), mode

    def _put(self, n: int, until: float) -> bool:
        if not create_once(self.spark, f"{self.folder}/{number(n)}", f"{self.token} {until!r} {self.mode}"):
            return False
        self.at = n
        for old in names(self.spark, self.folder):  # only the newest one counts
            if old.isdigit() and int(old) < n:
                delete(self.spark, f"{self.folder}/{old}")
        return True

    def acquire(self) -> None:
        """Take the lock; Busy if a run holds it."""
        n, _, until, mode = self._last()
        now = self.clock()
        if until > now:
            raise Busy(f"{mode} is running")
        if not self._put(n + 1, now + self.seconds):
            raise Busy("another run was first")

    def renew(self) -> None:
        """Hold the lock for its seconds from now on; Busy if it went to another run meanwhile."""
        n, token, _, mode = self._last()
        if token != self.token or not self._put(n + 1, self.clock() + self.seconds):
            raise Busy(f"{mode} took over")

    def release(self) -> None:
        n, token, _, _ = self._last()
        if token == self.token:
            self._put(n + 1, 0.0)

    def __enter__(self) -> RunLock:
        self.acquire()
        return self

    def __exit__(self, *_) -> None:
        with contextlib.suppress(Exception):  # a lease ends by itself, and the error of the run counts
            self.release()
