"""Exact deduplication by deterministic block naming.

Each normalised text is cut into blocks of a fixed size. All blocks are sorted and
get integers by their content, equal ones the same: their names. Then adjacent pairs
of names are sorted and named, again and again, until each document has one name. Its
level and name identify the text without collisions: names change wherever content
does, a digest only orders the blocks.

Sorting is by range over (content, row), so that a block that a third of all rows
share is dealt over many tasks; the counts of the tasks are then added up.

Defined results: null text counts as empty. Of equal texts the smallest doc_id stays
(null ids come last); among repeated rows of one doc_id, the first. Other columns are
not read, whatever their names. A very long text is so many blocks and takes a level more for each
doubling. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import SPACE, give_back, written

BLOCK_BYTES = 16_384
#: Dropped rows up to which their ids are broadcast.
BROADCAST_IDS = 500_000
WHITE = b" \t\n\x0b\x0c\r"
_CARRIED = "row long, idx int, names int, doc_id long, text_sha256 string"
_MARKED = f"{_CARRIED}, part int, local long, first binary, last binary"


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    out = b" ".join(text.split())
    if not out:
        return b" " if text else b""
    return b" " * (text[:1] in WHITE and text[:1] != b"") + out + b" " * (text[-1:] in WHITE)


def _blocks(size: int):
    names = ["row", "idx", "names", "doc_id", "text_sha256", "h", "key"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back("blocks")
            rows, held = [], 0
            for row, doc_id, text in zip(*batch.columns, strict=True):
                row, doc_id, text = row.as_py(), doc_id.as_py(), normalised(text.as_py())
                sha = hashlib.sha256(text).hexdigest()
                n = max(1, -(-len(text) // size))
                for i in range(n):
                    block = text[i * size : (i + 1) * size]
                    rows.append((row, i, n, doc_id, sha if not i else None, hashlib.sha256(block).digest()[:16], block))
                    held += len(block)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return cut


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names within a sorted partition, from 0; then one row with the number of names and both ends."""
    part, last, first, name = TaskContext.get().partitionId(), None, None, -1
    schema = pa.schema([("row", pa.int64()), ("idx", pa.int32()), ("names", pa.int32()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("part", pa.int32()), ("local", pa.int64()), ("first", pa.binary()), ("last", pa.binary())])
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = batch.column(batch.schema.get_field_index("key"))
        fresh = np.empty(n, dtype=bool)
        fresh[0] = last is None or key[0].as_py() != last
        fresh[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        first = key[0].as_py() if first is None else first
        local = name + np.cumsum(fresh)
        name, last = int(local[-1]), key[n - 1].as_py()
        none = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(np.full(n, part, dtype=np.int32)), pa.array(local), none, none], schema=schema)
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, None, name + 1, None, None, part, -1, first, last), schema, strict=True)], schema=schema)


def _named(keyed: DataFrame, tag: str) -> DataFrame:
    """keyed (_CARRIED, h, key) with the name of each key: equal keys have equal names, others don't."""
    cols = ["row", "idx", "names", "doc_id", "text_sha256", "h", "key"]
    dealt = keyed.select(cols).repartitionByRange("h", "row", "idx").sortWithinPartitions("h", "key", "row", "idx")
    marked = written(dealt.mapInArrow(_mark, _MARKED), tag)
    ends = marked.filter("local < 0").select("part", F.col("names").cast("long").alias("n"), "first", "last")
    w = Window.orderBy("part")  # a row per task
    before = ends.withColumn("n", F.col("n") - F.coalesce((F.lag("last").over(w) == F.col("first")).cast("long"), F.lit(0)))
    # a partition that begins with the last key of the one before starts at that key's name
    ends = before.select("part", (F.sum("n").over(w) - F.col("n") - F.coalesce((F.lag("last").over(w) == F.col("first")).cast("long"), F.lit(0))).alias("base"))
    rows = marked.filter("local >= 0")
    return rows.join(F.broadcast(ends), "part").select("row", "idx", "names", "doc_id", "text_sha256", (F.col("base") + F.col("local")).alias("name"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row, doc_id, text_sha256, level, name of every row: equal texts have equal level and name."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    named = _named(rows.mapInArrow(_blocks(block_bytes), f"{_CARRIED}, h binary, key binary"), "blocks")
    done, level = [], 0
    while True:
        done.append(named.filter("names = 1").select("row", "doc_id", "text_sha256", F.lit(level).alias("level"), "name"))
        rest = named.filter("names > 1")
        if rest.isEmpty():
            break
        level += 1
        at = lambda odd: F.max(F.when(F.col("idx") % 2 == odd, F.col("name")))
        pairs = rest.groupBy("row", F.expr("idx div 2").cast("int").alias("_half")).agg(
            F.expr("cast((max(names) + 1) div 2 as int)").alias("names"), F.max("doc_id").alias("doc_id"), F.max("text_sha256").alias("text_sha256"), at(0).alias("l"), F.coalesce(at(1), F.lit(-1)).alias("r")
        )
        two = F.encode(F.concat_ws(":", "l", "r"), "UTF-8")
        named = _named(pairs.select("row", F.col("_half").alias("idx"), "names", "doc_id", "text_sha256", two.alias("h"), two.alias("key")), f"pairs{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    every = identities(docs, block_bytes)
    order = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "row")
    groups = every.groupBy("level", "name").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = written(groups.select("level", "name", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size", F.lit(True).alias("many")), "groups")
    met = every.join(groups, ["level", "name"], "left")
    alone = F.col("many").isNull()
    return met.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without all but one row of each group of equal texts, whole and with their own columns."""
    found = written(exact_duplicates(docs, block_bytes), "kept")
    went = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.min("kept").alias("all")).filter("not all")
    went = written(went.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("stays").alias("_stays")), "went")
    few = went.count() <= BROADCAST_IDS
    sent = lambda t: F.broadcast(t) if few else t.hint("merge")
    ids = went.select("_id").distinct()
    # in a struct, no column of docs can clash with one of these
    rows = docs.select(F.struct("*").alias("_row"))
    of = lambda t: F.col("_row.doc_id").eqNullSafe(t["_id"])
    # texts are hashed again only of ids of which a row goes
    sha = F.sha2(F.regexp_replace(F.coalesce("_row.text", F.lit("")), f"{SPACE}+", " "), 256)
    touched = rows.join(sent(ids), of(ids), "left_semi").withColumn("_text_sha", sha)
    met = touched.join(sent(went), of(went) & (F.col("_text_sha") == went["_sha"]), "left")
    single = rows.join(sent(ids), of(ids), "left_anti").unionByName(met.filter(F.col("_stays").isNull()).select("_row"))
    repeated = met.filter("_stays").withColumn("_id2", F.col("_row.doc_id")).dropDuplicates(["_id2", "_text_sha"]).select("_row")
    return single.unionByName(repeated).select("_row.*")
