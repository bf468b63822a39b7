"""Line sources. Plain and well-named gzip files take Spark's own text reader
(splittable, streamed); only files whose name and magic bytes disagree are
decoded in Python. Those are streamed line by line from the stores that pyarrow
opens (STREAMED); from any other they come as Spark's binary rows, 2 GiB at most."""

from __future__ import annotations

import functools
import gzip
import io
import urllib.request
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b"
#: Names that Spark's reader inflates by itself.
GZIP_NAMES = (".gz", ".gzip")
BATCH_LINES = 8192
#: Schemes whose files executors open by themselves.
STREAMED = ("file", "hdfs", "s3", "gs", "abfs", "abfss")
#: Files whose first bytes are looked at together.
LOOKS = 32


def lines_of(stream: io.BufferedIOBase) -> Iterator[str]:
    r"""Decoded lines, ended by \n, \r\n or \r; gzip by its first two bytes."""
    raw = io.BufferedReader(stream) if not isinstance(stream, io.BufferedReader) else stream
    body = gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == MAGIC else raw
    for line in io.TextIOWrapper(body, encoding="utf-8", errors="replace", newline=None):
        yield line.removesuffix("\n")


def _batches(lines: Iterable[str]) -> Iterator[pa.RecordBatch]:
    block: list[str] = []
    for line in lines:
        block.append(line)
        if len(block) == BATCH_LINES:
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.string())], ["value"])
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.string())], ["value"])


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "value string")


def _look(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The qualified path, and whether the file begins as gzip does; a missing one raises."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    stream = fs.open(at)
    try:
        return fs.makeQualified(at).toString(), (stream.read(), stream.read()) == tuple(MAGIC)
    finally:
        stream.close()


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import PythonFile, fs

    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, name = fs.FileSystem.from_uri(path if not path.startswith("file:/") else "file://" + path.removeprefix("file:").removeprefix("//"))
            with store.open_input_stream(name, compression=None) as body:
                yield from _batches(lines_of(io.BufferedReader(PythonFile(body, mode="r"))))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            yield from _batches(lines_of(io.BytesIO(content.as_buffer())))


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of all files. Two magic bytes of each are looked at through the
    Hadoop file system, many files at a time, so any store that Spark reads will do."""
    if not paths:
        return _empty(spark)
    with ThreadPoolExecutor(LOOKS) as pool:
        found = list(pool.map(lambda p: _look(spark, p), paths))
    plain = [p for p, (_, zipped) in zip(paths, found, strict=True) if zipped == p.endswith(GZIP_NAMES)]
    # an empty .gz has no magic bytes: the odd lane gives it no rows
    odd = [q for p, (q, zipped) in zip(paths, found, strict=True) if zipped != p.endswith(GZIP_NAMES)]
    streamed = [q for q in odd if q.split(":")[0] in STREAMED]
    other = [q for q in odd if q.split(":")[0] not in STREAMED]
    parts = [spark.read.text(plain)] if plain else []
    if streamed:
        links = spark.createDataFrame(list(enumerate(streamed)), "i int, path string")
        parts.append(links.repartitionByRange(len(streamed), F.col("i")).select("path").mapInArrow(_stream, "value string"))
    if other:
        parts.append(spark.read.format("binaryFile").load(other).select("content").mapInArrow(_decode, "value string"))
    return functools.reduce(DataFrame.unionByName, parts)


def check_url(url: str) -> None:
    with urllib.request.urlopen(url, timeout=60):
        pass


def fetch_lines(spark: SparkSession, urls: list[str]) -> DataFrame:
    """Downloads on the executors, a task per URL, streamed."""
    if not urls:
        return _empty(spark)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                with urllib.request.urlopen(url, timeout=600) as body:
                    yield from _batches(lines_of(body))

    links = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    return links.repartitionByRange(len(urls), F.col("i")).select("url").mapInArrow(fetch, "value string")
