"""Session: the factory of datasets (sources S1-S7)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.dataset import Dataset
from weftline.sources import text


class Session:
    """Wraps a SparkSession; every source returns a lazy Dataset."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()

    def from_seq(self, data: Sequence[Any] | range, schema: str = "value long") -> Dataset:
        """In-memory collection. A range never leaves the JVM; other data travels in the plan."""
        if isinstance(data, range):
            ids = self.spark.range(data.start, data.stop, data.step).withColumnRenamed("id", "value")
            kind = schema.split()[-1]
            return Dataset(ids.select(F.col("value").cast(kind)))
        rows = [x if isinstance(x, (tuple, dict)) else (x,) for x in data]
        return Dataset(self.spark.createDataFrame(rows, schema))

    def from_df(self, df: DataFrame) -> Dataset:
        return Dataset(df)

    def table(self, sf_dir: str, name: str) -> Dataset:
        """A parquet table; filters and column lists reach the scan."""
        return Dataset(self.spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    def local_text_file(self, path: str) -> Dataset:
        """One text file, one row per line; gzip is recognised by its magic bytes. Missing: raises at once."""
        return self.multiple_local_text_files([path])

    def multiple_local_text_files(self, paths: Iterable[str]) -> Dataset:
        """As local_text_file for many files; each path is checked up front. An empty list is an empty dataset."""
        return Dataset(text.read_lines(self.spark, list(paths)))

    def url_text_file(self, url: str) -> Dataset:
        """A URL fetched by an executor; opened once here so that a wrong URL fails early."""
        text.check_url(url)
        return self.url_text_files([url])

    def url_text_files(self, urls: Iterable[str]) -> Dataset:
        """Many URLs, not checked up front, one task each."""
        return Dataset(text.fetch_lines(self.spark, list(urls)))

    def exit(self) -> None:
        self.spark.stop()
