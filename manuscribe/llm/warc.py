"""Content-addressed WARC archives.

Payload bytes are stored once under their SHA-256; exact record headers are kept
apart, one row per record. A join puts records together again, which are
written as WARC/1.1 archives: gzip files in the shared folder through Spark's
committing writer, whose line separator ends every record. Reading parses the
archives by their lengths, verifies every digest, and resolves each revisit
record by a join with the response it names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checked_broadcast

END = "\r\n\r\n"
RECORDS = "record_id string, record_type string, target_uri string, page_id long, refers_to_record string, payload_bytes long, payload_digest string, payload binary"
#: No date is in the table; records carry this one.
DATE = "1970-01-01T00:00:00Z"


def _record_id(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("null"))))
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in at]), F.lit(">"))


def store(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 100) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads): one header row per page, and every different payload once under its digest.

    Of pages with equal payloads of at least `least_bytes` bytes, that with the
    smallest id is a response and the others revisit it; smaller payloads are
    responses all. A null payload is empty. A null id is a response unless a page
    with an id has its payload; rows that repeat an id and its payload get equal
    records.
    """
    scratch = Scratch(pages.sparkSession, "warc-store")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"))
    p = p.withColumn("digest", F.sha2(F.encode("body", "UTF-8"), 256)).withColumn("bytes", F.octet_length("body").cast("long"))
    narrow = scratch.keep(p.select("page_id", "url", "digest", "bytes"), "pages")
    first = scratch.keep(narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "repeated")
    repeated = checked_broadcast(first)
    marked = narrow.join(repeated, "digest", "left")
    revisit = (F.col("bytes") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    uri = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))), r"[\x00-\x20]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    row = marked.select("page_id", "digest", "bytes", F.coalesce(revisit, F.lit(False)).alias("revisit"), uri.alias("uri"), http.alias("http"), _record_id(F.col("page_id")).alias("rid"), _record_id(F.col("first")).alias("ref"))
    length = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    again = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), F.col("ref"), F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), F.col("rid"), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.col("uri"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        F.when(F.col("revisit"), again).otherwise(F.lit("")), F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"), F.lit("\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(END), F.col("http"),
    )
    headers = scratch.keep(row.select("page_id", "revisit", "digest", head.alias("header")), "headers")
    single = p.join(repeated.select("digest", "first"), "digest", "left").filter(F.col("first").isNull() | (F.col("first") == F.col("page_id"))).select("digest", "body", "first")
    # repeats of the first page's own id, and payloads whose pages have no ids, are few: one of each stays
    odd = p.join(checked_broadcast(first.filter("first IS NULL")).select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("body").alias("body")).withColumn("first", F.lit(None).cast("long"))
    once = single.join(checked_broadcast(first.filter("first IS NULL")).select("digest"), "digest", "left_anti")
    many = once.filter("first IS NOT NULL").groupBy("digest").agg(F.min("body").alias("body"))
    payloads = once.filter("first IS NULL").select("digest", "body").unionByName(many).unionByName(odd.select("digest", "body"))
    return headers, scratch.keep(payloads, "payloads")


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """The records as text: exact header, then the payload unless it is a revisit."""
    full = headers.filter("NOT revisit").join(payloads, "digest").select(F.concat("header", "body").alias("value"))
    return full.unionByName(headers.filter("revisit").select(F.col("header").alias("value")))


def write(records: DataFrame, path: str, most_records: int = 20_000) -> None:
    """Archives of at most so many records, each record ended by two line ends."""
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most_records).text(path)


def _parse(feed: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of one archive."""
    buf = b""

    def until(n: int | None) -> bool:
        nonlocal buf
        while (n is None and END.encode() not in buf) or (n is not None and len(buf) < n):
            more = next(feed, None)
            if more is None:
                return False
            buf += more
        return True

    while until(None):
        head, _, buf = buf.partition(END.encode())
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record starts with {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        if not until(n + 4) or buf[n : n + 4] != END.encode():
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        block, buf = buf[:n], buf[n + 4 :]
        yield fields, block


def _inflated(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[i : i + step] for i in range(0, len(raw), step))
        return
    while raw:
        d = zlib.decompressobj(31)
        rest = raw
        while rest and not d.eof:
            yield d.decompress(rest, step)
            rest = d.unconsumed_tail
        yield d.flush()
        raw = d.unused_data


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """RECORDS of all archives below path; every response's payload is held against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "target_uri", "page_id", "refers_to_record", "payload_bytes", "payload_digest", "payload"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block in _parse(_inflated(content.as_py())):
                    http, _, payload = block.partition(END.encode())
                    digest = f["warc-payload-digest"].removeprefix("sha256:")
                    size = next(int(x[15:]) for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:"))
                    whole = f["warc-type"] == "response"
                    if whole and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {f['warc-record-id']} is not what its digest says")
                    page = f.get("x-page-id")
                    rows.append((f["warc-record-id"], f["warc-type"], f["warc-target-uri"], None if page is None else int(page), f.get("warc-refers-to"), size, digest, payload if whole and with_payload else None))
                    held += len(payload) if with_payload else 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 100, path: str | None = None) -> DataFrame:
    """Write the pages' archives, read them back, and resolve revisits.

    id_col, payload_bytes, payload_digest (both of the full payload), record_type,
    refers_to (the response's id for revisits), target_uri: a row per page.
    Null payloads are empty; a null url is named after the id; payloads of any length are
    stored and read whole; of equal payloads the smallest id answers. An empty
    table gives an empty result; further columns are ignored.
    """
    spark = pages.sparkSession
    path = path or Scratch(spark, "warc").path("archives")
    headers, payloads = store(pages, id_col, url_col, body_col, least_bytes)
    write(reconstruct(headers, payloads), path)
    back = read(spark, path, with_payload=False).drop("payload")
    back = Scratch(spark, "warc-read").keep(back, "records")
    named = back.filter("record_type = 'revisit'").select(F.col("refers_to_record").alias("record_id")).distinct()
    of = back.filter("record_type = 'response'").join(named, "record_id", "left_semi").groupBy("record_id").agg(F.min("page_id").alias("to"), F.min("payload_bytes").alias("b"), F.min("payload_digest").alias("d"))
    out = back.join(of.withColumnRenamed("record_id", "ref"), F.col("refers_to_record") == F.col("ref"), "left")
    return out.select(F.col("page_id").alias(id_col), F.coalesce("b", "payload_bytes").alias("payload_bytes"), F.coalesce("d", "payload_digest").alias("payload_digest"), "record_type", F.col("to").alias("refers_to"), "target_uri")
