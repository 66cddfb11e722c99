"""WARC archives: writing captures as records, reading them back, assembling transactions.

A capture is three records: the request, the response (or a revisit of an earlier equal payload)
and a metadata record; request and metadata name the capture in WARC-Concurrent-To. Records are
written by Spark's text writer, whose line separator is the blank pair of lines that ends a record,
so archives are committed like any other table and can lie in any store Spark writes to. They are
read as binary files and parsed by Content-Length; ``assemble`` joins the records of a capture.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aislewise.llm.common import ship, text_or_empty
from aislewise.session import own_folder, stored

SMALLEST = 100        # bytes of a payload that may be revisited
FILE_RECORDS = 3000   # records of a file, at most
BATCH_BYTES = 4 << 20  # payload bytes handed on at a time
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
SCHEMA = ("record_id string, type string, concurrent_to string, refers_to string, uri string, "
          "digest string, payload_bytes long, fields string, payload binary")


def _record_id(kind: str, page: Column, digest: Column) -> Column:
    """A name that depends on the page's id and payload alone, so that others can refer to it."""
    text = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("-")), digest)
                 .cast("binary"))
    cut = [F.substring(text, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(fields: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """One record without the blank lines after it; null fields are left out."""
    lines = [F.lit("WARC/1.1")] + [
        F.concat(F.lit(name + ": "), F.lit(v) if isinstance(v, str) else v) for name, v in fields]
    head = F.concat_ws("\r\n", *lines, F.concat(F.lit("Content-Length: "),
                                                F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(END), block)


def write(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url",
          payload_column: str = "html", smallest: int = SMALLEST, date: str = DATE) -> None:
    """Write three records per row to gzip files under ``path``.

    Of equal payloads of at least ``smallest`` bytes the one with the smallest id is the response
    and the others revisit it; rows that repeat that id are responses too. A null payload is empty,
    a null url is left out, a null id is no page's reference. Control characters of a url are
    percent-encoded. Other columns are ignored; an empty table gives an archive without records.
    """
    payload = text_or_empty("payload")
    rows = pages.select(F.col(id_column).alias("page"), F.col(url_column).alias("url"),
                        F.col(payload_column).cast("string").alias("payload")).select(
        "page", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
        payload.alias("payload"), F.octet_length(payload).alias("size"),
        F.sha2(payload.cast("binary"), 256).alias("digest"))
    # Only payloads that repeat: written first, so the join can pick a plan by their size.
    first = stored(rows.where(F.col("size") >= smallest).groupBy("digest").agg(
        F.min("page").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").drop("copies"))
    marked = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    name = _record_id("capture", F.col("page"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Content-Length: "), F.col("size").cast("string"), F.lit(END))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _record_id(
            "request", F.col("page"), F.col("digest"))), ("WARC-Concurrent-To", name), *common,
         ("Content-Type", "application/http;msgtype=request")],
        F.concat(F.lit("GET "), text_or_empty("url"), F.lit(" HTTP/1.1\r\n\r\n")))
    capture = _record(
        [("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", name),
         *common, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
         ("WARC-Profile", F.when(revisit, PROFILE)),
         ("WARC-Refers-To", F.when(revisit, _record_id("capture", F.col("first"),
                                                       F.col("digest")))),
         ("Content-Type", "application/http;msgtype=response")],
        F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))))
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id(
            "metadata", F.col("page"), F.col("digest"))), ("WARC-Concurrent-To", name), *common,
         ("Content-Type", "application/warc-fields")],
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page").cast("string"), F.lit("\r\n")),
                   F.lit("")))
    (marked.select(F.explode(F.array(request, capture, metadata)).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def inflated(content: bytes) -> bytes:
    """The content of a gzip file of one or more members; other content as it is."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Header fields (names in lower case) and block of every record."""
    at, view = 0, memoryview(data)
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        begin, size = stop + 4, int(fields["content-length"])
        yield fields, view[begin:begin + size]
        at = begin + size + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``, by ``SCHEMA``.

    ``digest`` and ``payload_bytes`` of a response are taken from its payload; of a revisit, which
    has none, from its headers. ``fields`` is the block of a metadata record.
    """

    def rows(content: bytes) -> Iterator[tuple]:
        for head, block in parse(inflated(content)):
            kind, payload, size, digest, fields = head.get("warc-type"), None, None, None, None
            if kind in ("response", "revisit"):
                raw = bytes(block)
                stop = raw.index(b"\r\n\r\n")
                digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                if kind == "response":
                    payload = raw[stop + 4:]
                    size, digest = len(payload), sha256(payload).hexdigest()
                else:
                    http = dict(x.split(": ", 1) for x in raw[:stop].decode().split("\r\n")[1:])
                    size = int(http["Content-Length"])
            elif kind == "metadata":
                fields = bytes(block).decode()
            yield (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"),
                   head.get("warc-refers-to"), head.get("warc-target-uri"), digest, size, fields,
                   payload)

    types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held, size = [], 0
                for row in rows(batch.column(0)[k].as_py()):
                    held.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types,
                                                            strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types,
                                                        strict=True)], names=names)

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response, metadata (structs).

    The capture is the response or revisit record; the other two are joined to it by their
    WARC-Concurrent-To, and are null where absent. Captures that share a record id (repeated
    rows) each get one row. Records of other types are left aside.
    """
    capture = records.where(F.col("type").isin("response", "revisit"))
    kept = [c for c in ("record_id", "type", "uri", "refers_to", "digest", "payload_bytes",
                        "payload") if c in records.columns]
    out = capture.select(F.col("record_id").alias("key"), F.struct(*kept).alias("response"))
    for kind, columns in (("request", ["record_id", "uri"]), ("metadata", ["record_id", "fields"])):
        side = (records.where(F.col("type") == kind).dropDuplicates(["concurrent_to"])
                .select(F.col("concurrent_to").alias("key"), F.struct(*columns).alias(kind)))
        out = out.join(side, "key", "left")
    return out.select("request", "response", "metadata")


def captures(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
             payload_column: str = "html", smallest: int = SMALLEST) -> DataFrame:
    """Write the pages, read them back and describe each capture: page_id, payload_bytes,
    payload_digest, record_type, refers_to (the page whose response a revisit names)."""
    spark = pages.sparkSession
    path = f"{own_folder(spark)}/warc-{uuid4().hex}"
    write(pages, path, id_column, url_column, payload_column, smallest)
    kind = pages.schema[id_column].dataType.simpleString()
    records = stored(read(spark, path).drop("payload"))
    named = assemble(records).select(
        "response.*", F.regexp_extract("metadata.fields", "page-id: ([^\r]*)", 1).alias("found"))
    named = named.withColumn("page_id", F.when(F.col("found") != "", F.col("found")).cast(kind))
    firsts = (named.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to"))
              .agg(F.first("page_id").alias("first")))
    return named.join(firsts, "refers_to", "left").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("first").alias("refers_to"))
