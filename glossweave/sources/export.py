"""Published documents: byte-stable JSON of categories and stories, and a versioned table that holds them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import etag
from ..model import CATEGORIES

#: Characters that the category files escape beside JSON's own.
_HTML = {"&": "\\u0026", "<": "\\u003c", ">": "\\u003e"}
_LINES = {" ": "\\u2028", " ": "\\u2029"}


def dumps(value, escape_html: bool) -> str:
    """Two-space JSON, as is but for <, > and & where asked and the two line separators always."""
    text = json.dumps(value, ensure_ascii=False, indent=2)
    for c, e in (_HTML | _LINES if escape_html else _LINES).items():
        text = text.replace(c, e)
    return text


#: Characters of a piece of a category file, about.
PIECE = 1 << 20


def category_pieces(entries: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    """(path, part, piece, body): a flat and a full document of each category in pieces, whose bodies make the file in the order of part and piece.

    Keys are sorted by their bytes; a category without rows has empty documents. Rows are dealt by ranges of their keys, so many tasks
    write one file's pieces, each of bounded size. Every row begins with what parts it from the one before, so it only has to know
    whether it is its field's first and its field the category's first, for which a row a field is joined.
    """
    spark = entries.sparkSession
    rows = entries.where(F.col("category").isin(categories)).select("category", "field", "jp_key", "cn_text", "source", "ids")
    first = rows.groupBy("category", "field").agg(F.min("jp_key").alias("first_key"))
    lead = first.groupBy("category").agg(F.min("field").alias("first_field"))
    rows = rows.join(first, ["category", "field"]).join(lead, "category")
    rows = rows.withColumn("opens", (F.col("jp_key") == F.col("first_key")).cast("int") + ((F.col("jp_key") == F.col("first_key")) & (F.col("field") == F.col("first_field"))).cast("int"))
    ordered = rows.drop("first_key", "first_field").repartitionByRange("category", "field", "jp_key").sortWithinPartitions("category", "field", "jp_key").withColumn("part", F.spark_partition_id().cast("long"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        category, flat, full, size, piece = None, [], [], 0, 0

        def out() -> pd.DataFrame:
            names = [f"translation/{category}.json", f"translation/{category}.full.json"]
            return pd.DataFrame({"path": names, "part": part, "piece": piece, "body": ["".join(flat), "".join(full)]})

        for b in batches:
            for r in b.itertuples(index=False):
                if flat and (r.category != category or size >= PIECE):
                    yield out()
                    flat, full, size, piece = [], [], 0, piece + 1
                category, part = r.category, r.part
                ids = {"ids": list(r.ids)} if r.ids is not None and len(r.ids) else {}
                before = ("{\n" if r.opens == 2 else "\n  },\n") + f"  {dumps(r.field, True)}: {{\n" if r.opens else ",\n"
                key = f"    {dumps(r.jp_key, True)}: "
                flat.append(before + key + dumps(r.cn_text, True))
                full.append(before + key + dumps({"text": r.cn_text, "source": r.source} | ids, True).replace("\n", "\n    "))
                size += len(full[-1])
        if flat:
            yield out()

    kinds = "path string, part bigint, piece bigint, body string"
    pieces = ordered.mapInPandas(write, kinds)
    known = spark.createDataFrame([(c,) for c in categories], "category string")
    both = lambda rows, part, body: rows.select(F.explode(F.array(F.format_string("translation/%s.json", "category"), F.format_string("translation/%s.full.json", "category"))).alias("path"), F.lit(part).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("piece"), F.lit(body).alias("body"))
    return pieces.unionByName(both(lead, 2**62, "\n  }\n}")).unionByName(both(known.join(lead, "category", "left_anti"), 0, "{}"))


def category_files(entries: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    """(path, body): the documents of category_pieces() whole, for files that fit a row; write_files() takes the pieces of any."""
    pieces = category_pieces(entries, categories).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "piece", "body"))).alias("p"))
    return pieces.select("path", F.array_join("p.body", "").alias("body"))


def story_files(ordered: DataFrame) -> DataFrame:
    """(path, body) of operators.story.ordered_detail rows: head and episodes in their order, lines in story order."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths, bodies = [], []
            for r in b.itertuples(index=False):
                episodes = {e["episode_no"]: {"scenarioId": e["scenario_id"], "title": e["title"], "talkData": {t["jp_key"]: t["cn_text"] for t in e["talk"]}} for e in (r.episodes if r.episodes is not None else [])}
                paths.append(f"translation/eventStory/event_{r.event_id}.json")
                bodies.append(dumps({"meta": {"source": r.source, "version": r.version, "last_updated": int(r.last_updated)}, "episodes": episodes}, False))
            yield pd.DataFrame({"path": paths, "body": bodies})

    return ordered.select("event_id", "source", "version", "last_updated", "episodes").mapInPandas(write, "path string, body string")


def assets(files: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(path, body, etag) of files, and of kept assets outside translation/ that the files don't replace."""
    rows = files.select("path", "body", etag(F.col("body").cast("binary")).alias("etag"))
    if kept is None:
        return rows
    other = kept.where(~F.col("path").startswith("translation/")).join(rows.select("path"), "path", "left_anti")
    return rows.unionByName(other.select("path", "body", "etag"))


def write_files(files: DataFrame, root: str) -> int:
    """Files under root from rows (path, body), or from pieces (path, part, piece, body) in their order. Number of files, counted by the tasks that write.

    A task has all pieces of a file, sorted, and holds a batch of them at a time. A file is written under a name of its own and then
    moved, so it is whole or as it was, also where a task runs twice. root is a folder or address that all executors reach: a path,
    or what pyarrow's file systems know (hdfs:, s3:, gs:).
    """
    rows = files if "piece" in files.columns else files.withColumns({"part": F.lit(0).cast("bigint"), "piece": F.lit(0).cast("bigint")})
    dealt = small_rows(rows.select("path", "part", "piece", "body")).repartition("path").sortWithinPartitions("path", "part", "piece").select("path", "body")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs as stores

        store, top = stores.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (stores.LocalFileSystem(), root)
        n, path, out, own = 0, None, None, None

        def done() -> int:
            if out is None:
                return 0
            out.close()
            store.move(own, f"{top}/{path}")
            return 1

        for b in batches:
            for name, body in zip(b.path, b.body, strict=True):
                if name != path:
                    n += done()
                    path, own = name, f"{top}/{name}.{uuid.uuid4().hex}.part"
                    store.create_dir(own.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(own)
                out.write(body.encode())
        n += done()
        yield pd.DataFrame({"n": [n]})

    return dealt.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: Rows of an Arrow batch where rows are whole documents or pieces of them.
BATCH_ROWS = 100


def small_rows(df: DataFrame) -> DataFrame:
    """df, its session's Arrow batches held to BATCH_ROWS rows from now on, as a batch of large rows has no other bound."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df
