"""A content-addressed web archive.

Two Parquet tables make an archive: ``payloads`` holds each distinct payload once (as a Zstandard frame) under its SHA-256; ``heads``
holds the exact header bytes of every record (WARC/1.1 fields and the HTTP head) with the digest of its payload. Original
records come back by a join of the two, and every payload is checked against its digest when it is read.

A record is ``response`` or, if an equal payload of ``min_payload`` bytes or more belongs to a smaller page_id
already, ``revisit``: its head then names that response, and its record in a WARC file has no payload. Null page_ids count as
larger than all others; of repeated rows one is the response.

Scale: pages are read twice: for their payloads, whose compressed bytes are shuffled once after equal ones in a task were merged, and
for slim rows (digests, sizes and a row number) that are written to the checkpoint folder and decide alone whether a record
revisits. Read back, compressed payloads are shuffled once more. Joins meet a digest's single row from the one side,
so a payload that a third of all pages share is a skewed join that adaptive execution splits. Both tables are written to the
folder that all executors share, where the archive stays.

A null html is an empty payload; a null url gives a head without target. Extra columns are not archived, whatever their names. An
empty table makes an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, shared_folder, slices, table

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
END = b"\r\n\r\n"


@cache
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def unpacked(digest: str, frame: bytes | None) -> bytes:
    """The payload of a frame; raises where it isn't what its digest says."""
    if frame is None:
        raise ValueError(f"no payload for {digest}")
    payload = _zstd()[1].decompress(frame)
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload {digest}")
    return payload


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parsed(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields of a WARC record, its HTTP head and its payload."""
    head, _, block = record.removesuffix(END).partition(END)
    http, _, payload = block.partition(END)
    lines = head.decode().split(CRLF)
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]}")
    return dict(x.split(": ", 1) for x in lines[1:]), http, payload


@dataclass(frozen=True)
class Archive:
    spark: SparkSession
    folder: str

    @property
    def stored(self) -> DataFrame:
        """digest, frame."""
        return self.spark.read.parquet(f"{self.folder}/payloads")

    @property
    def payloads(self) -> DataFrame:
        """digest, payload; raises on a payload that isn't what its digest says."""

        def run(batches):
            for batch in slices(batches, "frame", 1 << 20):
                digests = batch.column("digest")
                yield pa.RecordBatch.from_arrays([digests, pa.array(map(unpacked, digests.to_pylist(), batch.column("frame").to_pylist()), pa.binary())], ["digest", "payload"])

        return self.stored.select("digest", "frame").mapInArrow(run, "digest string, payload binary")

    @property
    def heads(self) -> DataFrame:
        """head (exact bytes), digest."""
        return self.spark.read.parquet(f"{self.folder}/heads")

    def _rebuilt(self, make, kind: str) -> DataFrame:
        """What make gives for the originals of a slice: (stored type, record with head and payload) of each."""
        names = [c.split()[0] for c in kind.split(", ")]

        def originals(batch) -> Iterator[tuple[str, bytes]]:
            for head, digest, frame in zip(*[batch.column(c).to_pylist() for c in ("head", "digest", "frame")]):
                what = re.search(rb"^WARC-Type: (\w+)", head, re.MULTILINE)
                yield what.group(1).decode(), head + unpacked(digest, frame) + END

        def run(batches):
            for batch in slices(batches, "frame", 1 << 20):
                columns = list(zip(*make(originals(batch))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in kind.split(", ")]
        joined = self.heads.join(self.stored, "digest", "left")
        return joined.select("head", "digest", "frame").mapInArrow(run, kind)

    def records(self) -> DataFrame:
        """record: every record as it stands in a WARC file, a revisit without its payload."""

        def make(originals):
            for what, record in originals:
                payload = parsed(record)[2]
                yield (record if what == "response" else record[: len(record) - len(END) - len(payload)] + END,)

        return self._rebuilt(make, "record binary")

    def originals(self) -> DataFrame:
        """record: every page's record with its whole payload."""
        return self._rebuilt(lambda originals: ((record,) for _, record in originals), "record binary")

    def index(self) -> DataFrame:
        """page_id, payload_bytes, payload_digest, record_type, refers_to of every original record, read from its own bytes."""

        def make(originals):
            for _, record in originals:
                fields, http, payload = parsed(record)
                said, is_ = fields["WARC-Payload-Digest"], base32_sha1(payload)
                if said != f"sha1:{is_}" or not http.endswith(f"Content-Length: {len(payload)}".encode()):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} isn't as its head says")
                number = lambda name: int(fields[name]) if name in fields else None  # noqa: B023, E731
                yield number("X-Page-Id"), len(payload), is_, fields["WARC-Type"], number("X-Refers-To-Page-Id")

        return self._rebuilt(make, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _bytes(html: str | None) -> bytes:
    return (html or "").encode("utf-8", "surrogatepass")


def _once(pages: DataFrame) -> DataFrame:
    """digest, frame: each distinct payload."""

    def run(batches):
        for batch in slices(batches, "html"):
            payloads = {hashlib.sha256(p).hexdigest(): p for p in map(_bytes, batch.column("html").to_pylist())}
            yield pa.RecordBatch.from_arrays([pa.array(list(payloads)), pa.array([_zstd()[0].compress(p) for p in payloads.values()], pa.binary())], ["digest", "frame"])

    return pages.select("html").mapInArrow(run, "digest string, frame binary").groupBy("digest").agg(F.first("frame").alias("frame"))


def _slim(pages: DataFrame) -> DataFrame:
    """page_id, url, size, digest, sha1, row."""

    def run(batches):
        for batch in slices(batches, "html"):
            payloads = [_bytes(h) for h in batch.column("html").to_pylist()]
            made = [[len(p) for p in payloads], [hashlib.sha256(p).hexdigest() for p in payloads], [base32_sha1(p) for p in payloads]]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *[pa.array(v, k) for v, k in zip(made, (pa.int64(), pa.string(), pa.string()))]], ["page_id", "url", "size", "digest", "sha1"])

    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, size long, digest string, sha1 string")
    return durable(seen.withColumn("row", F.monotonically_increasing_id()))


def _heads(slim: DataFrame, min_payload: int) -> DataFrame:
    slim = slim.select("page_id", "size", "digest", "sha1", "row", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"))
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("row").cast("string"), "url").cast("binary"))
    slim = slim.withColumn("record", F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">")))
    first = slim.where(F.col("size") >= min_payload).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "record")).alias("first"))
    found = slim.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row")) & (F.col("size") >= min_payload)

    def line(key: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit(CRLF)), F.lit(""))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.col("record")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.when(F.col("url") != "", F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, F.col("first.record"))),
        line("X-Refers-To-Page-Id", F.when(revisit, F.col("first.page_id").cast("string"))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))).cast("string")),
        F.lit(CRLF),
        http,
    )
    return found.select(head.cast("binary").alias("head"), "digest")


def write_archive(pages: DataFrame, folder: str | None = None, min_payload: int = 0) -> Archive:
    """pages: page_id, url, html. folder: by default a new one in the shared folder."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    _once(pages).write.parquet(f"{folder}/payloads")
    _heads(_slim(pages), min_payload).write.option("compression", "zstd").parquet(f"{folder}/heads")
    return Archive(spark, folder)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_archive(table(spark, sf_dir, "pages")).index()
