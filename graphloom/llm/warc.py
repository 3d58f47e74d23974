"""WARC archives: writing, reading, and assembly of transactions.

A capture is a response (or a revisit of equal payload), its request and its metadata
record; the latter two name the former in WARC-Concurrent-To. Archives go through Spark's text
writer and reader alone, so that any file system that Spark knows will do.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import saved, scratch, small_batches, table

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
MARK = "WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, record_type string, target_uri string, date string, concurrent_to string, payload_digest string, fields map<string,string>, payload binary"


def written(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Writes ``pages`` (page_id, url, html) as gzipped archives: three records a row.

    Of equal payloads of at least ``least_bytes`` the one with the smallest page_id is a response (all rows
    that share it), others are revisits, which name its URI, date and digest (its record's id isn't known where they are written). Null html is an empty payload, a null page_id is never the smallest;
    line ends in urls become spaces. Other columns are ignored; an empty table gives no records.
    """
    p = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    again = p.where(F.col("n") >= least_bytes).groupBy(F.col("digest").alias("g_digest")).agg(F.min("page_id").alias("first"), F.min_by("url", F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first_url"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    p = p.join(again, F.col("digest") == F.col("g_digest"), "left").withColumn("serial", F.monotonically_increasing_id())
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))

    def urn(kind: str) -> Column:
        h = F.sha2(F.concat_ws("/", F.lit(kind), F.col("serial").cast("string"), F.col("digest")), 256)
        return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))

    def record(kind: Column, own: Column, more: list, content: str, block: Column) -> Column:
        lines = [F.lit(f"{MARK}1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), own), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), "url"), *more]
        head = F.concat_ws("\r\n", *lines, F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
        return F.concat(head, F.lit("\r\n\r\n"), block, F.lit("\r\n"))  # the writer's line end is the second one

    main = urn("capture")
    with_it = [F.concat(F.lit("WARC-Concurrent-To: "), main)]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    response = record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), main,
        [F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"), F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To-Target-URI: "), "first_url", F.lit(f"\r\nWARC-Refers-To-Date: {date}")))],
        "application/http; msgtype=response", F.when(revisit, http).otherwise(F.concat(http, "payload")),
    )
    request = record(F.lit("request"), urn("request"), with_it, "application/http; msgtype=request", F.concat(F.lit("GET "), F.regexp_replace("url", " ", "%20"), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = record(F.lit("metadata"), urn("metadata"), with_it, "application/warc-fields", F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")))
    rows = p.select(F.explode(F.array(response, request, metadata)).alias("value"))
    rows.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def length_of(raw: bytes) -> int | None:
    """The bytes of the record that ``raw`` begins (behind its ``MARK``), its block's included; None if its header hasn't ended."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    for line in raw[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return end + 4 + int(value)
    return end + 4


def parsed(raw: bytes) -> tuple:
    """A whole record from behind its ``MARK``."""
    end = raw.find(b"\r\n\r\n")
    fields, of = [], {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields.append((name.strip(), value.strip()))
        of.setdefault(name.strip().lower(), value.strip())
    n = int(of.get("content-length", "0"))
    block = raw[end + 4 : end + 4 + n]
    content = of.get("content-type", "")
    if content.startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    elif content == "application/warc-fields":
        for line in block.split(b"\r\n"):
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                fields.append((name.strip(), value.strip()))
    names = dict(reversed(fields))  # the first of a name stays
    return of.get("warc-record-id"), of.get("warc-type"), of.get("warc-target-uri"), of.get("warc-date"), of.get("warc-concurrent-to"), of.get("warc-payload-digest"), list(names.items()), block


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at ``path`` (gzipped by record or file; or plain, if a file is one split).

    Spark's reader cuts files before each ``MARK``; where a block or header holds it, the pieces are joined
    again until the record has its length. Records cut off at a file's end raise an error.
    """
    small_batches(spark, 256)
    pieces = spark.read.option("lineSep", MARK).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    types = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [x.strip().split(" ")[0] for x in RECORD.replace("<string,string>", "").split(",")]

    def run(batches):
        held, have, need, file = [], 0, None, None  # the pieces of the record at hand, their bytes, those of the whole if its header is there
        out, size = [], 0
        for b in batches:
            for v, f in zip(b.column(0), b.column(1).to_pylist()):
                v = v.as_py() or b""
                if f != file:
                    if b"".join(held).strip():
                        raise ValueError(f"a record is cut off in {file}")
                    file, held, have, need = f, [], 0, None
                if held:
                    held.append(MARK.encode())
                    have += len(MARK)
                held.append(v)
                have += len(v)
                if need is None:
                    whole = b"".join(held)
                    if not whole.strip():
                        held, have = [], 0
                        continue  # before the file's first record
                    held, need = [whole], length_of(whole)
                if need is not None and have >= need:
                    r = parsed(b"".join(held))
                    held, have, need = [], 0, None
                    out.append(r)
                    size += len(r[-1])
                if size > 4 << 20 or len(out) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out, size = [], 0
        if b"".join(held).strip():
            raise ValueError(f"a record is cut off in {file}")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return pieces.mapInArrow(run, RECORD)


def assembled(records: DataFrame) -> DataFrame:
    """One nested row a capture: ``capture`` (its response, revisit or resource record), ``requests`` and ``metadata`` (arrays of the records concurrent to it).

    Records of other kinds and those concurrent to none are left out; a capture without requests or metadata has empty arrays. Whatever columns ``records`` has stand in the structs.
    """
    cols = [F.col(f"`{c}`") for c in records.columns]
    main = records.where(F.col("record_type").isin("response", "revisit", "resource")).select(F.struct(*cols).alias("capture"))
    beside = records.where(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    beside = beside.groupBy(F.col("concurrent_to").alias("of")).agg(
        F.collect_list(F.when(F.col("record_type") == "request", F.struct(*cols))).alias("requests"),
        F.collect_list(F.when(F.col("record_type") == "metadata", F.struct(*cols))).alias("metadata"),
    )
    j = main.join(beside, F.col("capture.record_id") == F.col("of"), "left")
    return j.select("capture", F.coalesce("requests", F.array()).alias("requests"), F.coalesce("metadata", F.array()).alias("metadata"))


def resolved(captures: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of ``captures`` whose records have ``n_bytes`` and ``sha256`` of the payload; revisits take theirs from the response of their digest."""
    c = captures.select(
        F.col("metadata")[0]["fields"]["page-id"].alias("page"), F.col("capture.record_type").alias("record_type"),
        F.col("capture.n_bytes").alias("n_bytes"), F.col("capture.sha256").alias("sha256"), F.regexp_replace("capture.payload_digest", "^sha256:", "").alias("named"),
    ).withColumn("page_id", F.when(F.col("page") != "", F.col("page").cast("long")))
    first = c.where((F.col("record_type") == "response") & (F.col("n_bytes") >= least_bytes)).groupBy(F.col("sha256").alias("r_digest")).agg(F.min("page_id").alias("r_page"), F.max("n_bytes").alias("r_bytes"))
    j = c.join(first, (F.col("record_type") == "revisit") & (F.col("named") == F.col("r_digest")), "left")
    again = F.col("record_type") == "revisit"
    return j.select("page_id", F.when(again, F.col("r_bytes")).otherwise(F.col("n_bytes")).alias("payload_bytes"), F.when(again, F.col("r_digest")).otherwise(F.col("sha256")).alias("payload_digest"), "record_type", F.when(again, F.col("r_page")).alias("refers_to"))


def op4_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc") + "/records"
    written(table(spark, sf_dir, "pages"), path)
    records = read(spark, path).withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("sha256", F.sha2("payload", 256)).drop("payload")
    return resolved(assembled(saved(records, "warc_records")))


OP4_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p
), t AS (
  SELECT *, payload_bytes >= 100 AND first_page IS NOT NULL AND page_id IS DISTINCT FROM first_page AS again FROM f
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_page END AS refers_to FROM t
"""
