"""WARC archives by content address.

The archive is two tables: payload bytes once for each SHA-256 digest, and the exact header block of each record. Records come back
by a join of headers to payloads, and what they say is read from the rebuilt bytes. Everything is DataFrame expressions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, cut, delete, join_counted, shared_folder

#: Payloads shorter than this always stay responses of their own.
MIN_REVISIT_BYTES = 100
CRLF = "\r\n"
#: Fixed value: the profile of records whose payload another record holds.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _records(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Each page with its digest, a record id of its own, and the record that answers for its digest; no payload."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), _payload().alias("payload"))
    rows = rows.select("page_id", "url", F.length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"), F.xxhash64("payload").alias("second"), F.expr("uuid()").alias("id"))
    rows = cut(rows)  # ids are drawn once
    order = F.struct(F.col("page_id").isNull().alias("null"), "page_id", "id")
    first = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min("second").alias("low"), F.max("second").alias("high"), F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    # Equal digests must come from equal bytes: length and a hash of another family agree, else the job stops.
    sound = (F.col("low") == F.col("high")) & (F.col("least") == F.col("most"))
    first = first.select("digest", "n", F.when(F.coalesce(sound, F.lit(True)), F.col("first")).otherwise(F.raise_error(F.concat(F.lit("different payloads share digest "), "digest"))).alias("first"))
    again = (F.col("bytes") >= min_bytes) & (F.col("id") != F.col("first.id"))
    return join_counted(rows, cut(first), ["digest"], "n").withColumn("record_type", F.when(again, "revisit").otherwise("response"))


def _header(date: Column) -> Column:
    """The header block of a record of _records(), up to the empty line before its block."""
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    again = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.concat(F.lit("WARC-Date: "), date),
        # A header value can't hold a line end; the table keeps the exact url.
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"),
        F.concat(F.lit("X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first.id")))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of pages (page_id, url, html), written as tables under path.

    date is that of the records, as 2024-01-31T12:00:00Z; by default, now. A null html is an empty payload, a null url an empty
    target. Every row has a record with an id of its own; of rows of equal page_id and html one answers for the others too. A null page_id
    sorts after all others, so it answers only where no other page has its payload. No pages: empty tables.
    """
    when = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    headers = _stored(_records(pages, min_bytes).select("page_id", "url", "digest", _header(when).alias("header")), f"{path}/headers")
    # Tasks drop copies before the shuffle, so a payload that a third of all pages share moves once a task.
    payloads = pages.select(F.sha2(_payload(), 256).alias("digest"), _payload().alias("payload")).groupBy("digest").agg(F.first("payload").alias("payload"), F.count("*").alias("pages"))
    return headers, _stored(payloads, f"{path}/payloads")


def _field(name: str) -> Column:
    return F.regexp_extract("header", f"(?m)^{name}: ([^\\r\\n]*)", 1)


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, record_type, header, record): the exact bytes of each WARC record. A revisit carries no block."""
    headers = headers.select("page_id", "digest", "header", _field("WARC-Type").alias("record_type"))
    bare = headers.where("record_type = 'revisit'").select("page_id", "record_type", "header", F.concat(F.col("header").cast("binary"), F.lit((CRLF * 2).encode())).alias("record"))
    whole = headers.where("record_type <> 'revisit'")
    # A payload has one response, but for short ones; of these the ones of many pages, fewer than HOT_KEYS, are broadcast.
    many = (F.length("payload") < MIN_REVISIT_BYTES) & (F.col("pages") * HOT_KEYS > F.lit(payloads.agg(F.sum("pages")).first()[0] or 0))
    hot, rest = payloads.where(many), payloads.where(~many)
    met = whole.join(F.broadcast(hot), "digest").unionByName(whole.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest.hint("merge"), "digest", "left"))
    record = F.concat(F.col("header").cast("binary"), F.coalesce("payload", F.raise_error(F.concat(F.lit("payload missing: "), "digest")).cast("binary")), F.lit((CRLF * 2).encode()))
    return met.select("page_id", "record_type", "header", record.alias("record")).unionByName(bare)


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, from its rebuilt bytes.

    A response's digest is taken anew from its block, and must be the one that its header states, else the job stops; a revisit
    takes those of the response it refers to.
    """
    id_of = lambda name: F.regexp_extract(_field(name), "<urn:uuid:(.*)>", 1)
    block = F.expr("substring(record, length(cast(header as binary)) + 1, length(record) - length(cast(header as binary)) - 4)")
    rebuilt = reconstruct(headers, payloads).select(
        "record_type", id_of("WARC-Record-ID").alias("id"), id_of("WARC-Refers-To").alias("refers_id"), F.expr("try_cast(regexp_extract(header, '(?m)^X-Page-ID: ([^\\r\\n]*)', 1) as long)").alias("page_id"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "").alias("told"), _field("Content-Length").cast("long").alias("told_bytes"), F.length(block).cast("long").alias("payload_bytes"), F.sha2(block, 256).alias("payload_digest"),
    )
    sound = (F.col("payload_bytes") == F.col("told_bytes")) & ((F.col("payload_digest") == F.col("told")) | (F.col("record_type") == "revisit"))
    rebuilt = cut(rebuilt.withColumn("told", F.when(sound, F.col("told")).otherwise(F.raise_error(F.concat(F.lit("damaged payload: "), "told")))))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    response = rebuilt.where("record_type <> 'revisit'")
    again = rebuilt.where("record_type = 'revisit'").select("page_id", "refers_id", "record_type")
    answers = cut(response.select(F.col("id").alias("refers_id"), "payload_bytes", "payload_digest", F.col("page_id").alias("refers_to")).join(again.groupBy("refers_id").agg(F.count("*").alias("n")).hint("merge"), "refers_id"))
    return response.select(*out, F.lit(None).cast("long").alias("refers_to")).unionByName(join_counted(again, answers, ["refers_id"], "n").select(*out, "refers_to"))


def warc_digest(pages: DataFrame) -> DataFrame:
    """Write pages to an archive in a fresh folder beside the checkpoints, read it back, and delete it."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    found = cut(read_archive(*write_archive(pages, folder)))
    delete(pages.sparkSession, folder)
    return found
