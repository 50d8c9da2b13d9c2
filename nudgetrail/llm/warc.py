"""Web archives without repeated payloads: revisit records that point at the first response.

Headers (page, digest, length) are shuffled by payload digest, the smallest page_id of equal
payloads becomes the response and every other record a revisit of it; records are written with
fresh headers. Text output with CRLF as its line separator writes the records byte for byte, so
Spark's own writer and committer make the archives on any file system.

A null html is an empty payload. ``smallest`` is the length from which payloads are compared;
shorter ones are all responses. Rows that repeat page_id and payload are the same record: all have
the type that one of them has, and point at the same response. A null page_id comes last among its
equals and is written as an empty field. A null url is written as urn:unknown, and what may not
stand in a header is percent-encoded. An empty table gives an empty archive. Payloads of any length
are written whole. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgetrail.llm.common import Stages

CRLF = "\r\n"
WRITTEN = "2024-01-01T00:00:00Z"
#: Fixed value: the profile that WARC 1.1 names for payloads with the same digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SMALLEST = 0


def sha1_base32(data: Column) -> Column:
    """SHA-1 as bare upper-case base32: four times forty bits, each eight digits."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexed = F.sha1(data)
    forty = [F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32) for i in range(4)]
    return F.translate(F.concat(*[F.lpad(x, 8, "0") for x in forty]), *digits)


def headers_of(pages: DataFrame) -> DataFrame:
    """(page_id, digest, payload_bytes) of every page."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long"),
        sha1_base32(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )


def revisits(headers: DataFrame, stages: Stages, smallest: int = SMALLEST) -> DataFrame:
    """(page_id, digest, refers_to) of each record that revisits another.

    Repeats are combined before the shuffle. Digests with more than one record are written, so
    that the join that follows can be split where one payload has a large part of all records.
    """
    records = headers.where(F.col("payload_bytes") >= smallest).select("digest", "page_id")
    firsts = (
        records.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("digest", "refers_to")
    )
    found = records.join(stages.cut(firsts, "firsts"), "digest")
    return found.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def _record(lines: list[tuple[str, Column]], block: Column) -> Column:
    """One record but for the CRLF that ends it, which the writer adds."""
    size = F.octet_length(block).cast("string")
    head = [F.lit("WARC/1.1" + CRLF)]
    for name, value in [*lines, ("Content-Length", size)]:
        # A null value leaves its line out.
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*head, F.lit(CRLF), block, F.lit(CRLF))


#: What may not stand in a header line, and what stands for it.
_ENCODED = {chr(i): f"%{i:02X}" for i in (*range(33), 127)}


def _header_url(url: Column) -> Column:
    """The url with controls and spaces percent-encoded, and each % that begins no such code.

    So ``unquote`` gives an unencoded url back, and one that is well-formed stays as it is.
    """
    fit = F.regexp_replace(url, "%(?![0-9A-Fa-f]{2})", "%25")
    for char, code in _ENCODED.items():
        fit = F.replace(fit, F.lit(char), F.lit(code))
    odd = url.rlike(r"[\x00-\x20\x7F]|%(?![0-9A-Fa-f]{2})")
    return F.when(odd, fit).otherwise(url)


def _urn(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records_of(pages: DataFrame, resolved: DataFrame, written: str = WRITTEN) -> DataFrame:
    """(record) of every page, payloads written for responses only."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    full = pages.select(
        F.col("page_id").cast("long"),
        F.coalesce(F.col("url"), F.lit("urn:unknown")).alias("url"),
        payload.alias("payload"),
        sha1_base32(payload.cast("binary")).alias("digest"),
    )
    other = resolved.select(
        F.col("page_id").alias("other_page"), F.col("digest").alias("other"), "refers_to",
        F.lit(True).alias("again"),
    ).hint("shuffle_hash")
    joined = full.join(
        other,
        (F.col("digest") == F.col("other")) & F.col("page_id").eqNullSafe(F.col("other_page")),
        "left",
    )
    again = F.coalesce(F.col("again"), F.lit(False))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(CRLF + CRLF),
    )
    url = _header_url(F.col("url"))
    first = F.when(again, _urn(F.col("refers_to"), F.col("digest")))
    lines = [
        ("WARC-Type", F.when(again, "revisit").otherwise("response")),
        ("WARC-Record-ID", _urn(F.col("page_id"), F.col("digest"))),
        ("WARC-Date", F.lit(written)),
        ("WARC-Target-URI", url),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(again, PROFILE)),
        ("WARC-Refers-To", first),
        ("WARC-Refers-To-Page", F.when(again, F.col("refers_to").cast("string"))),
        ("WARC-Page", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
    ]
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    return joined.select(_record(lines, block).alias("record"))


def write_archives(pages: DataFrame, folder: str, smallest: int = SMALLEST) -> None:
    """Writes every page to gzipped archives in ``folder``."""
    stages = Stages(pages.sparkSession, "warc")
    resolved = stages.cut(revisits(headers_of(pages), stages, smallest), "revisits")
    records = records_of(pages, resolved)
    records.write.option("lineSep", CRLF).option("compression", "gzip").text(folder)
    stages.drop()


def _records_in(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by the length that it states, one at a time."""
    while first := file.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError("no record where one should begin")
        head = {}
        while (line := file.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError("a record ends within its headers")
            name, _, value = line[:-2].decode().partition(": ")
            head[name] = value
        size = int(head["Content-Length"])
        block = file.read(size)
        if len(block) != size or file.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {head['WARC-Record-ID']} has another length than it states")
        yield head, block


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record.

    A payload that does not have the length or digest that its headers state raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("content"):
                rows: list[tuple] = []
                held = 0
                file = gzip.GzipFile(fileobj=io.BytesIO(packed.as_py()))
                for head, block in _records_in(io.BufferedReader(file, 1 << 20)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind, page = head["WARC-Type"], head["WARC-Page"]
                    if kind == "response":
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if (len(payload), found) != (n, digest):
                            raise ValueError(f"the payload of page {page} is damaged")
                    refers = head.get("WARC-Refers-To-Page")
                    row = (int(page) if page else None, head["WARC-Target-URI"], n, digest, kind,
                           int(refers) if refers else None, payload if with_payload else b"")
                    rows.append(row)
                    held += len(row[-1])
                    if len(rows) == 10_000 or held > 4 << 20:
                        yield _arrow(rows, with_payload)
                        rows, held = [], 0
                if rows:
                    yield _arrow(rows, with_payload)

    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long"
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("content").mapInArrow(
        run, schema + ", payload binary" if with_payload else schema
    )


def _arrow(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    cols = list(zip(*rows, strict=True))
    out = {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)}
    if with_payload:
        out["payload"] = pa.array(cols[6], pa.binary())
    return pa.RecordBatch.from_pydict(out)
