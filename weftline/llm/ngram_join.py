"""N-gram Jaccard join with Bayesian candidate pruning.

Documents of the same words are one class. Each class has a set of shingles of five
words (hashed to 64 bits; fewer words make one shingle) and MinHash values. Classes that
agree on all the values of a band are candidates and meet: values are compared a few at a time,
and a pair is dropped as soon as the posterior probability (uniform prior) that its similarity
reaches the threshold, given the matches so far, is below the tolerance. Classes that the pairs left
connect meet once more, with their shingles, and what passes the same pruning is
verified exactly, in integers. So classes that merely share a band, as texts of one template do,
are told apart while they are 160 short numbers, and only likely pairs hold together what
is compared as a whole. Bands that the very same classes share are one meeting.

Bands: 32 of 5 values; a pair at the threshold of 0.8 shares none with a probability of
3e-6, and is dropped wrongly with one of about the tolerance (1e-9 at each look).

Class keys begin with the class id, so that the least key of a component names it and no
join meets at it. No pair is ever a row. A hot band is split into blocks. Each meets itself, which
connects near copies over all bands; then the classes that are not in the component which has most of the band meet
all others of it, block by block. So every two classes of a band have met or are connected already. A component
is split into blocks that meet two by two, as links are counted there, each meeting in a task of
its own; out of it come a count for each class and a
spanning forest of the links, at most one row per class. Components come from these.

Defined results: words are what ASCII white space separates, A-Z lower-cased. Null text
counts as empty; documents without words are one class and have no links. class_id is
the smallest doc_id of the class, cluster_id that of its component; n_links counts the
other classes at or above the threshold, n_linked_docs the documents in them and the
other documents of the class. Repeated rows are members of their class. A very long text is
hashed and compared whole, its shingles in pieces. Other columns are not read. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import REMEMBERED, Memo, components, give_back, runs, text_of, written

N_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
#: MinHash values compared at a time.
STEP = 20
TOLERANCE = 1e-9
#: Classes in a block; two blocks meet in a task.
BLOCK = 128
#: Components of more than a block up to which their sizes are broadcast.
BROADCAST_SIZES = 500_000
#: Shingles hashed at a time.
CHUNK = 65_536

_rng = np.random.default_rng(20_240_501)
MUL = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

_hashes = Memo(xxhash.xxh3_64_intdigest, 100_000)
REMEMBERED["shingles"] = _hashes.forget


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray, n: int = N_WORDS) -> np.ndarray:
    """The sorted distinct hashes of n consecutive words; fewer words: one hash of all."""
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for j in range(k):
        total += mixed(words[j : len(words) - k + 1 + j] + MIX[j % 8]) * MIX[(j + 3 + j // 8) % 8]
    if k < n:
        total += np.uint64(k)
    return np.unique(mixed(total))


def word_hashes(text: bytes) -> np.ndarray:
    found = text.lower().split()
    return np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, values) of non-empty sets; long sets go in pieces."""
    out = np.empty((len(sets), len(MUL)), dtype=np.uint64)
    i = 0
    while i < len(sets):
        j, held = i, 0
        while j < len(sets) and (j == i or held + len(sets[j]) <= CHUNK):
            held += len(sets[j])
            j += 1
        if j == i + 1 and held > CHUNK:
            best = None
            for at in range(0, held, CHUNK):
                part = sets[i][at : at + CHUNK]
                low = np.array([(part * m + a).min() for m, a in zip(MUL, ADD, strict=True)], dtype=np.uint64)
                best = low if best is None else np.minimum(best, low)
            out[i] = best
        else:
            x = np.concatenate(sets[i:j])
            starts = np.cumsum([0, *map(len, sets[i : j - 1])])
            y = np.empty_like(x)
            for k in range(len(MUL)):
                np.multiply(x, MUL[k], out=y)
                y += ADD[k]
                out[i:j, k] = np.minimum.reduceat(y, starts)
        i = j
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(mins), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        keys = mixed(keys + mins[:, r::ROWS] + MIX[r])
    return mixed(keys + np.arange(BANDS, dtype=np.uint64)[None, :] * MIX[5]).view(np.int64)


def _key(text: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def _sign(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back("shingles")
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [t.as_py().encode() for t in part.column(1)]
                sets = [shingles(word_hashes(t), n) for t in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                mins = minhashes([sets[i] for i in full])
                keys = band_keys(mins)
                sigs: list[bytes | None] = [None] * len(sets)
                for i, sig in zip(full, (mins >> np.uint64(48)).astype(np.uint16), strict=True):
                    sigs[i] = sig.tobytes()
                offsets = np.zeros(len(sets) + 1, dtype=np.int32)
                offsets[1:][full] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_key(t) for t in texts], pa.binary()), bands, pa.array(sigs, pa.binary()), pa.array([len(x) for x in sets], pa.int64())], schema=schema)

    return run


def _members(n: int):
    """comp, key, class_size and the sizes of the component's blocks, with values and shingles."""
    schema = pa.schema([("comp", pa.binary()), ("key", pa.binary()), ("class_size", pa.int64()), ("size", pa.int64()), ("sig", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back("shingles")
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                rows = []
                for comp, key, class_size, size, sig, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    text = text.encode()
                    if _key(text) == key[-16:]:  # else it is another row of that id
                        rows.append((comp, key, class_size, size, sig, shingles(word_hashes(text), n).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def least_matches(threshold: float, tolerance: float, values: int, step: int) -> list[tuple[int, int]]:
    """(values seen, matches needed): with fewer, P(similarity >= threshold) < tolerance.
    With a uniform prior that probability is P(Bin(seen + 1, threshold) <= matches)."""
    out = []
    for n in range(step, values + 1, step):
        total, m = 0.0, 0
        while True:
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
            if total >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def _likely(sa: np.ndarray, sb: np.ndarray, na: np.ndarray, nb: np.ndarray, same: bool, need: list[tuple[int, int]], ratio: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that sizes and MinHash values leave; sa, sb: values, na, nb: numbers of shingles."""
    p, q = ratio.numerator, ratio.denominator
    i, j = np.nonzero((np.minimum(na[:, None], nb[None, :]) * q >= np.maximum(na[:, None], nb[None, :]) * p) & (np.arange(len(na))[:, None] < np.arange(len(nb))[None, :] if same else True))
    match, before = np.zeros(len(i), dtype=np.int32), 0
    for n, least in need:
        match += (sa[i, before:n] == sb[j, before:n]).sum(1, dtype=np.int32)
        keep = match >= least
        i, j, match, before = i[keep], j[keep], match[keep], n
    return i, j


def _pairs(a: list, b: list, same: bool, need: list[tuple[int, int]], ratio: Fraction) -> np.ndarray:
    """Index pairs at or above the threshold; a, b: (values, shingles) of each class."""
    na, nb = np.array([len(x[1]) for x in a]), np.array([len(x[1]) for x in b])
    i, j = _likely(np.stack([x[0] for x in a]), np.stack([x[0] for x in b]), na, nb, same, need, ratio)
    p, q = ratio.numerator, ratio.denominator
    if not len(i):
        return np.empty((0, 2), dtype=np.int64)
    if len(i) <= 64:
        inter = np.array([len(np.intersect1d(a[x][1], b[y][1], assume_unique=True)) for x, y in zip(i, j, strict=True)])
    else:
        inter = _intersections([x[1] for x in a], [x[1] for x in b], i, j)
    keep = inter * (p + q) >= p * (na[i] + nb[j])
    return np.stack([i[keep], j[keep]], 1)


class Forest(dict):
    """Parents of what has been joined."""

    def find(self, x: int) -> int:
        while self.get(x, x) != x:
            self[x] = x = self.get(self[x], self[x])
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self[max(x, y)] = min(x, y)


def _near(threshold: float, tolerance: float):
    """A spanning forest of the likely pairs of each meeting."""
    ratio = Fraction(threshold).limit_denominator(1000)
    need = least_matches(threshold, tolerance, BANDS * ROWS, STEP)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for t in runs(batches, 3):
            lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            block, keys = t.column("block").to_numpy(), t.column("key")
            sigs = np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in t.column("sig")])
            sizes = t.column("n").to_numpy()
            first = np.flatnonzero(block == lo)
            second = np.flatnonzero(block == hi)
            if not len(first) or not len(second):
                continue
            i, j = _likely(sigs[first], sigs[second], sizes[first], sizes[second], lo == hi, need, ratio)
            forest = Forest()
            for x, y in zip(first[i].tolist(), second[j].tolist(), strict=True):
                forest.join(x, y)
            held += [(keys[u].as_py(), keys[v].as_py()) for u, v in forest.items()]
            if len(held) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return run


def _intersections(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections by products of 0/1 matrices, so many shingles at a time."""
    flat = [np.concatenate(x) for x in (a, b)]
    rows = [np.repeat(np.arange(len(x)), list(map(len, x))) for x in (a, b)]
    common = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    at = []
    for values, row in zip(flat, rows, strict=True):
        k = np.searchsorted(common, values)
        k[k == len(common)] = 0
        ok = common[k] == values if len(common) else np.zeros(len(values), dtype=bool)
        order = np.argsort(k[ok], kind="stable")
        at.append((k[ok][order], row[ok][order]))
    for start in range(0, len(common), width):
        left, right = [np.zeros((len(x), width), dtype=np.float32) for x in (a, b)]
        for dense, (k, row) in zip((left, right), at, strict=True):
            lo, hi = np.searchsorted(k, [start, start + width])
            dense[row[lo:hi], k[lo:hi] - start] = 1
        out += left @ right.T
    return np.rint(out[i, j]).astype(np.int64)


def _compare(threshold: float, tolerance: float):
    ratio = Fraction(threshold).limit_denominator(1000)
    need = least_matches(threshold, tolerance, BANDS * ROWS, STEP)
    schema = pa.schema([("key", pa.binary()), ("other", pa.binary()), ("links", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for t in runs(batches, 3):
            keys, sizes, block = t.column("key").to_pylist(), t.column("class_size").to_pylist(), t.column("block").to_pylist()
            rows = [(np.frombuffer(s.as_buffer(), np.uint16), np.frombuffer(x.as_buffer(), np.uint64)) for s, x in zip(t.column("sig"), t.column("shingles"), strict=True)]
            lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            first = list({keys[x]: x for x in range(len(keys)) if block[x] == lo}.values())
            second = first if lo == hi else list({keys[x]: x for x in range(len(keys)) if block[x] == hi}.values())
            if not first or not second:
                continue
            found = _pairs([rows[x] for x in first], [rows[x] for x in second], lo == hi, need, ratio)
            forest = Forest()
            counts: dict[int, list[int]] = {}
            for x, y in zip(np.array(first)[found[:, 0]].tolist(), np.array(second)[found[:, 1]].tolist(), strict=True):
                for u, v in ((x, y), (y, x)):
                    c = counts.setdefault(u, [0, 0])
                    c[0] += 1
                    c[1] += sizes[v]
                forest.join(x, y)
            held += [(keys[u], None, *c) for u, c in counts.items()]
            held += [(keys[u], keys[v], 0, 0) for u, v in forest.items()]
            if len(held) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return run


def _first(c: str) -> Column:
    """Nine bytes in the order of a number, null last."""
    digits = F.lpad(F.hex(F.coalesce(F.col(c), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.unhex(F.concat(F.when(F.col(c).isNull(), "01").otherwise("00"), digits))


def _class_of(c: str) -> Column:
    digits = F.hex(F.substring(c, 1, 9))
    number = F.conv(F.substring(digits, 3, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.substring(digits, 1, 2) == "00", number)


def _meetings(members: DataFrame, group: str, block: Column, others: Column, *cols: str) -> DataFrame:
    """Members of each group in their blocks, dealt to the meetings with the blocks in others: group, lo, hi, block and cols, sorted."""
    placed = members.withColumn("block", block).withColumn("_other", F.explode(others))
    return _dealt(placed.select(group, F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"), "block", *cols), group)


def _dealt(placed: DataFrame, group: str) -> DataFrame:
    return placed.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("key"), blocks).cast("int")


def _blocks(size: Column | str, block: int) -> Column:
    return F.ceil((F.col(size) if isinstance(size, str) else size) / block).cast("int")


def _likely_edges(met: DataFrame, classes: DataFrame, near, block: int) -> DataFrame:
    """Edges (a, b) that connect what the likely pairs of each band connect; met: key, band, g, classes: key, sig, n.

    Each block of a band meets itself, and its members are one row each. What that connects, over
    all bands, need not meet again: of a band of several blocks only the classes outside the component that has
    most of it, the rest, meet all others. So a group of near copies costs a row per class, and
    blocks meet two by two only among classes that are not connected yet."""
    cols = ["key", "sig", "n"]
    own = met.join(classes, "key").withColumn("block", _block(_blocks("g", block))).select("band", F.col("block").alias("lo"), F.col("block").alias("hi"), "block", *cols)
    edges = written(_dealt(own, "band").mapInArrow(near, "a binary, b binary"), "likely")
    hot = met.filter(F.col("g") > block)
    if hot.isEmpty():
        return edges
    known = written(components(edges, "blocks"), "connected")
    hot = hot.join(classes, "key").join(known.withColumnRenamed("node", "key"), "key", "left")
    hot = written(hot.select("band", "g", *cols, F.coalesce("root", "key").alias("root")), "hot")
    most = hot.groupBy("band", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("band").agg(F.max(F.struct("m", "root")).alias("most"))
    apart = hot.join(most, "band").filter(F.col("most.m") < F.col("g"))
    n_rest, n_most = _blocks(F.col("g") - F.col("most.m"), block), _blocks("most.m", block)
    apart = apart.select("band", *cols, (F.col("root") == F.col("most.root")).alias("_most"), n_rest.alias("_rest"), n_most.alias("_mosts"))
    at = F.when(F.col("_most"), F.col("_rest") + _block(F.col("_mosts"))).otherwise(_block(F.col("_rest")))
    others = F.sequence(F.lit(0), F.col("_rest") - 1 + F.when(F.col("_most"), 0).otherwise(F.col("_mosts")))
    more = written(_meetings(apart, "band", at, others, *cols).mapInArrow(near, "a binary, b binary"), "rest")
    return known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)


def similar(docs: DataFrame, n: int = N_WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, class_size, n_links, n_linked_docs, cluster_id of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    signed = written(rows.mapInArrow(_sign(n), "doc_id long, key binary, bands array<long>, sig binary, n long"), "signed")
    same = F.first(F.struct("bands", "sig", "n")).alias("same")
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), same)
    classes = written(classes.select(F.col("key").alias("words"), F.concat(_first("class_id"), "key").alias("key"), "class_id", "class_size", "same.*"), "classes")
    banded = classes.select("key", F.explode("bands").alias("band"))
    set_of = [F.bit_xor(F.xxhash64("key")).alias("s1"), F.sum(F.xxhash64("key", F.lit(1)).cast("decimal(38,0)")).alias("s2")]
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("g"), *set_of).filter("g > 1")
    shared = written(shared.groupBy("g", "s1", "s2").agg(F.min("band").alias("band")).select("band", "g"), "bands")
    met = written(banded.join(shared, "band"), "banded")
    edges = _likely_edges(met, classes.select("key", "sig", "n"), _near(threshold, tolerance), block)
    near = written(components(edges, "candidates"), "near")
    # what is smaller than a block is one block, whatever its size
    sizes = written(near.groupBy("root").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block), "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_SIZES else sizes
    who = near.join(sizes, "root", "left").select(F.col("node").alias("key"), F.col("root").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
    who = written(who.join(classes.select("key", "class_id", "class_size", "sig"), "key"), "members")
    # by shuffle at every size: who grows with the documents
    met = rows.join(who.hint("merge"), rows["doc_id"].eqNullSafe(who["class_id"])).select("comp", "key", "class_size", "size", "sig", "text")
    members = met.mapInArrow(_members(n), "comp binary, key binary, class_size long, size long, sig binary, shingles binary")
    blocks = _blocks("size", block)
    dealt = _meetings(members, "comp", _block(blocks), F.sequence(F.lit(0), blocks - 1), "key", "class_size", "sig", "shingles")
    found = written(dealt.mapInArrow(_compare(threshold, tolerance), "key binary, other binary, links long, docs long"), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    joined = components(found.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")), "clusters")
    # keys begin with the class id, so that a component's root is its least class
    clusters = joined.select(F.col("node").alias("key"), _class_of("root").alias("cluster_id"))
    known = classes.select("words", "key", "class_id", "class_size").join(links, "key", "left").join(clusters, "key", "left")
    known = written(
        known.select(F.col("words").alias("key"), "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("n_links"), (F.coalesce("docs", F.lit(0)) + F.col("class_size") - 1).alias("n_linked_docs"), F.coalesce("cluster_id", "class_id").alias("cluster_id")), "known"
    )
    return signed.select("doc_id", "key").join(known, "key").select("doc_id", "class_id", "class_size", "n_links", "n_linked_docs", "cluster_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group of near duplicates, that of the smallest
    doc_id; of repeated rows of that id and its words, one."""
    found = similar(docs, **how)
    keep = written(found.filter(F.col("doc_id").eqNullSafe(F.col("cluster_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")), "kept").withColumnRenamed("doc_id", "_id")
    # in a struct, no column of docs can clash with one of these
    rows = docs.select(F.struct("*").alias("_row"))
    met = rows.join(keep, F.col("_row.doc_id").eqNullSafe(F.col("_id")))
    words = F.filter(F.split(F.lower(text_of("_row.text")), r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    repeated = met.filter("_n > 1").withColumn("_words", words).dropDuplicates(["_id", "_words"])
    return met.filter("_n = 1").select("_row").unionByName(repeated.select("_row")).select("_row.*")
