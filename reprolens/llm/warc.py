"""WARC archives: written by Spark's text writer, read back by record, and joined into captures.

Each page becomes three records (request, response or revisit, metadata); the request
and the metadata name the response in WARC-Concurrent-To. Archives go through Spark's
own writers and readers, so they can be in any store that Spark reaches, and a task
that is run again replaces its file.

Reading walks the records by Content-Length. Captures are assembled by a join on the
concurrent-to identifiers: one nested row for each.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, remove, shared_dir, text_or_empty

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
#: Most captures in one archive file, and most bytes of their payloads unless a single one
#: is larger: pages beyond the share of one capture go to files with fewer of them.
CAPTURES_PER_FILE = 2000
FILE_BYTES = 64 << 20
#: Copies of the winners of repeated payloads, so that one payload's pages are spread.
SALTS = 16

_END = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def record_types(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, refers_to`` of the pages that revisit another's payload: of equal
    payloads of at least ``least`` bytes that with the largest page_id is the response.

    Repeats are counted by partial aggregation; the winners of repeated payloads are
    copied ``SALTS`` times, so the pages of one payload meet them in as many tasks.
    """
    narrow = pages.select("page_id", F.sha2("body", 256).alias("h"), F.octet_length("body").alias("n")).where(F.col("n") >= least)
    winners = narrow.groupBy("h", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("times")).where("times > 1")
    salted = winners.select("h", "n", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    narrow = narrow.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return narrow.join(salted, ["h", "n", "salt"]).where(F.col("page_id") != F.col("refers_to")).select("page_id", "refers_to")


def _record(kind: str, record_id: Column, page: Column, content_type: str, block: Column, *more: Column) -> Column:
    # a header that is null is left out
    heads = [
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), page),
        *more,
        F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *heads), F.lit(_END), block)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """``value``: three WARC records of each page, without the line ends that close them."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.regexp_replace(F.col(url_col), r"[\r\n\s]", "%20"), F.lit("")).alias("url"), text_or_empty(html_col).alias("body"))
    rows = rows.join(record_types(rows, least), "page_id", "left")
    name = lambda what: F.concat(F.lit(f"<urn:page:{what}:"), F.col("page_id").cast("string"), F.lit(">"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.sha1("body"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit(_END))
    host = F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1), F.lit(""))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), name("response"))
    response = _record("response", name("response"), F.col("url"), "application/http; msgtype=response", F.concat(head, F.col("body")), digest)
    revisit = _record(
        "revisit", name("response"), F.col("url"), "application/http; msgtype=response", head, digest,
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.concat(F.lit("WARC-Refers-To: <urn:page:response:"), F.col("refers_to").cast("string"), F.lit(">")),
    )
    asked = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/]*(/.*)$", 1), F.lit("")), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_END))
    request = _record("request", name("request"), F.col("url"), "application/http; msgtype=request", asked, concurrent)
    metadata = _record("metadata", name("metadata"), F.col("url"), "application/warc-fields", F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), concurrent)
    return rows.where("page_id is not null").select(F.explode(F.array(request, F.when(F.col("refers_to").isNull(), response).otherwise(revisit), metadata)).alias("value"))


def write(recs: DataFrame, path: str, captures_per_file: int = CAPTURES_PER_FILE, codec: str | None = None) -> None:
    """Add records to a folder as archive files; ``codec`` may be gzip."""
    out = recs.write.mode("append").option("lineSep", _END).option("maxRecordsPerFile", 3 * captures_per_file)
    (out.option("compression", codec) if codec else out).text(path)


def parse(data: bytes):
    """(headers, block) of each record of an archive; header names in lower case.

    Gzipped archives, whole or by record, are unpacked first. Damaged input raises
    ValueError."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, size, view = 0, len(data), memoryview(data)
    while at < size:
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        heads = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            heads[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
        start = end + 4
        stated = heads.get("content-length", "")
        if not stated.isdecimal():
            raise ValueError(f"no length of the record before byte {start}")
        at = start + int(stated)
        if at > size:
            raise ValueError("the last record is cut off")
        yield heads, view[start:at]


RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes long, payload_sha1 string, payload binary, block binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``. Payload size and SHA-1 are
    those of the bytes read; a revisit has those that its headers state. Without
    ``payloads`` the bytes themselves are left out."""

    def of(batches):
        kinds = (pa.string(),) * 6 + (pa.int64(), pa.string(), pa.binary(), pa.binary())
        names = [c.split()[0] for c in RECORD.split(", ")]
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for h, block in parse(content.as_buffer().to_pybytes()):
                    kind, body, size, sha1 = h.get("warc-type"), None, None, None
                    stated = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind in ("response", "revisit"):
                        raw = bytes(block)
                        head, _, body = raw.partition(b"\r\n\r\n")
                        if kind == "response":
                            size, sha1 = len(body), hashlib.sha1(body).hexdigest()
                        else:
                            low = head.lower()
                            i = low.find(b"content-length:")
                            size, sha1, body = (int(low[i + 15 :].split(b"\r\n")[0]) if i >= 0 else None), stated, None
                    keep = payloads and kind not in ("response", "revisit")
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), stated, size, sha1, body if payloads else None, bytes(block) if keep else None))
                    held += len(body or b"") if payloads else 0
                    if len(rows) >= 10_000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(of, RECORD)


def captures(recs: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id`` (the response's identifier) and the
    structs ``request``, ``response`` and ``metadata``, null where there is none.

    Requests and metadata join the response that they name as concurrent. Of several
    records of a kind for one capture the one with the least identifier is taken;
    records that name no response are left out. An empty table gives an empty result.
    """
    key = F.coalesce(F.when(F.col("type").isin("response", "revisit"), F.col("record_id")), F.col("concurrent_to"))
    one = F.struct(*(F.col(c.split()[0]) for c in RECORD.split(", ")))
    pick = lambda *kinds: F.min_by(one, F.when(F.col("type").isin(*kinds), F.col("record_id")))
    keyed = recs.withColumn("capture_id", key).where("capture_id is not null")
    made = keyed.groupBy("capture_id").agg(pick("request").alias("request"), pick("response", "revisit").alias("response"), pick("metadata").alias("metadata"))
    return made.where("response is not null")


def archive_and_read(pages: DataFrame, path: str | None = None, payloads: bool = False, codec: str | None = "gzip") -> DataFrame:
    """Write the pages' records under ``path`` (a new folder of the shared one by
    default), read the archives back and assemble their captures."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    # equal payloads are equally long, so revisits stay beside their responses
    size, share = F.octet_length(text_or_empty("html")), FILE_BYTES // CAPTURES_PER_FILE
    write(records(pages.where(size <= share)), path, codec=codec)
    biggest = pages.agg(F.max(size)).first()[0] or 0
    if biggest > share:
        write(records(pages.where(size > share)), path, max(1, FILE_BYTES // biggest), codec)
    return captures(read(pages.sparkSession, path, payloads))


def page_digests(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Per page, from the archives: page_id, payload_bytes, payload_digest,
    record_type and refers_to.

    Null html is an empty payload. Rows that repeat a page_id have the same record
    identifiers and come back as one capture; rows without a page_id have none. An
    empty table gives an empty result; other columns are ignored.
    """
    number = lambda c: F.regexp_extract(c, r"^<urn:page:response:(-?\d+)>$", 1).cast("long")
    at = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    made = archive_and_read(pages, at)
    result = cut(
        made.select(
            number(F.col("capture_id")).alias("page_id"),
            F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.payload_sha1").alias("payload_digest"),
            F.col("response.type").alias("record_type"),
            number(F.col("response.refers_to")).alias("refers_to"),
        )
    )
    if path is None:  # the digests are kept, the archives only where they were asked for
        remove(pages.sparkSession, at)
    return result
