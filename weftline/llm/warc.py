r"""WARC archives written and read back as a table of record chunks.

Writing: payloads are compared by length and digest; of equal ones that with the largest
page_id becomes a response record, the others revisit it. Spark's text writer puts the
records out, CRLF CRLF being the end of a line to it, so that archives are written in
parallel, gzipped, committed by task and safe to retry on any file system that Spark
knows.

Reading: one task for each archive streams it and yields a row for each chunk of a
payload: record, chunk number, bytes, the SHA-1 of all bytes up to there. Neither side
of the table ever holds more than a chunk of a payload in Python; the last chunk has the
digest of the whole, which is held against the header's.

Defined results: null html is an empty payload; empty payloads have one chunk without
bytes. Of equal payloads that share the largest page_id (repeated rows), each of its rows
is a response; a null page_id comes after all others and refers_to is then null. With
min_bytes, smaller payloads are all responses. Other columns are not read. An empty
table gives archives without records."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import shared_dir, written

CHUNK_BYTES = 1 << 18
#: Records in one archive at most.
ARCHIVE_RECORDS = 50_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = b"\r\n\r\n"

CHUNKS = "record_id string, page_id long, record_type string, refers_to long, chunk int, data binary, sha1 string, bytes long, last boolean, payload_bytes long, payload_digest string, archive string"


def base32(sha1_hex: Column) -> Column:
    """Forty hexadecimal digits as thirty-two of base 32."""
    out = []
    for i in range(4):
        forty = F.conv(F.substring(sha1_hex, 10 * i + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(BASE32), (F.shiftright(forty, 35 - 5 * k).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*out)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and what the record of each page is."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    equal = base.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    equal = written(equal.filter("n > 1").select("digest", "bytes", "keep", F.lit(True).alias("many")), "equal")
    met = base.join(equal.hint("merge"), ["digest", "bytes"], "left")
    revisit = F.col("many").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return met.select("page_id", "url", "html", "bytes", revisit.alias("revisit"), "keep")


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def _record(r: DataFrame) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    length = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    url = F.regexp_replace("url", r"[\r\n]+", " ")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", _id(F.col("keep"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.sha1("html")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        body,
    )


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """The pages as archives in a folder."""
    rows = records(pages, min_bytes)
    rows.select(_record(rows).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


class Stream:
    """A file read forward: lines, and pieces of what follows."""

    def __init__(self, raw, size: int = CHUNK_BYTES):
        self.raw, self.size, self.held = raw, size, b""

    def line(self) -> bytes | None:
        """Without its CRLF; None at the end."""
        parts = self.held
        while (at := parts.find(b"\r\n")) < 0:
            more = self.raw.read(self.size)
            if not more:
                if parts:
                    raise ValueError("the archive ends within a line")
                return None
            parts += more
        self.held = parts[at + 2 :]
        return parts[:at]

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes, at most size at a time."""
        while n:
            if not self.held:
                self.held = self.raw.read(self.size)
                if not self.held:
                    raise ValueError("the archive ends within a record")
            piece = self.held[: min(n, self.size)]
            self.held = self.held[len(piece) :]
            n -= len(piece)
            yield piece


def _headers(stream: Stream) -> dict[str, str]:
    out = {}
    while line := stream.line():
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _page(record_id: str) -> int | None:
    value = record_id.strip("<>").rpartition(":")[2]
    return None if value == "null" else int(value)


def chunks(raw, name: str, size: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of CHUNKS of an open archive, whose payloads are only ever held in part."""
    stream = Stream(raw, size)
    while (version := stream.line()) is not None:
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {version[:40]!r}")
        head = _headers(stream)
        length, kind = int(head["content-length"]), head["warc-type"]
        status = stream.line()
        used = len(status) + 2
        http = {}
        while line := stream.line():
            used += len(line) + 2
            key, _, value = line.decode().partition(":")
            http[key.strip().lower()] = value.strip()
        left = length - used - 2
        refers = _page(head["warc-refers-to"]) if kind == "revisit" else None
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        fixed = head["warc-record-id"], _page(head["warc-record-id"]), kind, refers
        whole = int(http["content-length"])
        sha, done, number = hashlib.sha1(), 0, 0
        held = b""
        for piece in stream.pieces(left):
            held += piece
            while len(held) >= size and done + size < left:
                data, held = held[:size], held[size:]
                sha.update(data)
                done += size
                yield *fixed, number, data, base64.b32encode(sha.copy().digest()).decode(), done, False, whole, digest, name
                number += 1
        sha.update(held)
        done += len(held)
        if kind == "response" and (base64.b32encode(sha.digest()).decode() != digest or done != whole):
            raise ValueError(f"digest or length of {fixed[0]} is wrong")
        yield *fixed, number, held, base64.b32encode(sha.digest()).decode() if kind == "response" else digest, done, True, whole, digest, name
        if stream.line() != b"" or stream.line() != b"":
            raise ValueError("a record must end with two line ends")


def _read(size: int, keep_data: bool):
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary()), ("sha1", pa.string()), ("bytes", pa.int64()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(inner, compression="gzip" if path.endswith(".gz") else None) as raw:
                    for r in chunks(raw, path.rpartition("/")[2], size):
                        rows.append(r if keep_data else (*r[:5], None, *r[6:]))
                        held += len(r[5]) * keep_data + 300
                        if held > 4_000_000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return run


def read(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, keep_data: bool = True) -> DataFrame:
    """The chunk table of the archives in a folder (or one archive), a task for each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,gz,warc}").load(path).select("path", "length")
    n = max(1, files.count())
    dealt = files.repartitionByRange(n, "path").select("path")
    return dealt.mapInArrow(_read(chunk_bytes, keep_data), CHUNKS)


def round_trip(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, chunks of every
    page, from archives that are written to the shared folder first. The digests of
    responses are those of the chunks that were read."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write(pages, path, min_bytes)
    table = read(spark, path, chunk_bytes, keep_data=False)
    last = table.filter("last")
    return last.select("page_id", "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", "refers_to", (F.col("chunk") + 1).alias("chunks"))
