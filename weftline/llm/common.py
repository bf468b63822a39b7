"""What the operators share: places to write, Arrow helpers, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.shared import forget, shared_path

#: A token in the sense of the contracts: no ASCII white space.
SPACE = r"[\x20\x09-\x0D]"


shared_dir = shared_path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, tag)
    # the writer looks at a page's size after so many rows: by default 100, which may be very long texts
    df.write.option("parquet.page.size.row.check.min", "2").option("parquet.page.size.row.check.max", "1000").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.weftline_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more; others go when Python ends."""
    for x in tables:
        forget(x.weftline_path)


def text_of(c: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def crc_mod(c: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % n


#: What workers remember from task to task, by the operator's name: how to forget it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def give_back(mine: str) -> None:
    """A worker that comes from another operator's tasks forgets what those remember, and
    memory that it has freed but still holds goes back to the machine."""
    for name, forget_it in REMEMBERED.items():
        if name != mine:
            forget_it()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


class Memo(dict):
    """fn's results. Up to bound of them are at hand and as many from before, so that
    memory does not follow the vocabulary and what is used often is not worked out anew."""

    def __init__(self, fn: Callable, bound: int = 200_000):
        self.fn, self.bound, self.before = fn, bound, {}

    def forget(self) -> None:
        self.clear()
        self.before = {}

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        if value is None:
            value = self.fn(key)
        self[key] = value
        return value


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The groups of equal leading columns of sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)], strict=True))
        start = 0
        for i, k in enumerate(keys):
            if k != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, key = [], i, k
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, tag: str, rounds: int = 40) -> DataFrame:
    """(node, root) of every node in edges (a, b), root being the least of its
    component. Large-star and small-star steps in turn until nothing changes; every
    round is written, as few rows as there are nodes, and no list of neighbours is
    ever gathered in one place."""
    cut = lambda df: written(df, tag)
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = cut(least)  # a table on one side lets a star of very many nodes be split in the join
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        small_least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(small_least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = cut(small.unionByName(small_least.select("a", F.col("m").alias("b"))).filter("a != b").distinct())
        dropped(now, least, large, small_least)
        mark = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        now = nxt
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
