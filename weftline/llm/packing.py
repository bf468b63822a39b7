"""Packing by mixture control: deficit round-robin over source queues.

Every source is a queue of its documents' tokens. In each window, one sequence by default, a queue
is owed its share of the window (by default its share of all tokens). It sends what it is
owed in whole quanta (an eighth of a sequence), and what is left is a deficit that it carries into the next
window: after w windows it has sent share * window * w tokens less a part of a quantum,
wherever its documents lie. The order of the rounds
being fixed, the place of each token follows from its place in its queue by arithmetic
alone, so that windows are filled in parallel, deficits carry over from partition to
partition, and no queue, however large, is gathered anywhere. The windows follow one
another without gaps and are cut into sequences; only the last has padding.

A first pass writes each document's ids; the queues' lengths per task (a row for each
task and source) are added up; a second pass cuts the pieces.

Every source is a queue of its own. Up to max_queues of them are known to all tasks. The
parts that more of them have in the windows are a table (as many rows as a packing has
pieces, at most), whose places are sums along its order by window and source, and which
documents meet by source and window; the pieces are the same.

Very long texts are encoded in bounded pieces and cut like others.

Defined results: null text is empty and has just the end id; a null source is a source
of its own; repeated rows are packed each; other columns are not read; an empty table
gives no pieces. Queues go in the order of their names, documents in that of the scan."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import REMEMBERED, Memo, give_back, text_of, written

SEQUENCE = 2048
#: Proportions hold in windows of so many sequences; in longer ones documents are cut less.
WINDOW = 1
#: Queues send in quanta, of which a sequence has so many: no piece is cut to a token or two.
QUANTA = 8
END_ID = 1
#: Queues up to which all tasks hold their totals and shares.
MAX_QUEUES = 256
#: Longer texts are split into so many words at a time.
BYTES_AT_ONCE = 1_000_000
LONG = re.compile(rb"(?:[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*){1,50000}")
MARKS = b".,;:!?*$%#&"
#: Letters of Latin-1 that stand alone in the tokenizer's patterns and have their lower case there.
PLAIN = "".join(c for c in map(chr, range(256)) if re.match("[A-Za-zÀ-ÖØ-öø-ÿ]", c)).encode("latin-1")
LOWER = bytes(range(256)).decode("latin-1").translate({b: chr(b).lower() for b in PLAIN}).encode("latin-1")
ID = attrgetter("id")
#: Letters, digits and white space, full stops and commas, and what else ASCII has.
KINDS = bytes(ord("a") if chr(b).isalnum() or b in b" \t\n\x0b\x0c\r" else ord(".") if b in b".," else ord("!") for b in range(128)) + b"!" * 128


def byte_level() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """The tokenizer's ids as packed 16-bit numbers. Its pre-tokens never span white
    space, so ids are remembered by word; letters and marks are looked up apart."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 65_536:
            raise ValueError("ids must fit in 16 bits")
        self.model, self.level = self.whole.model, byte_level()
        self.marked = all("<" in t.content for t in self.whole.get_added_tokens_decoder().values())
        self.units = Memo(self._unit, 200_000)
        self.words = Memo(self._word, 300_000)

    def _unit(self, unit: bytes) -> bytes:
        mapped = unit.decode() if unit.isascii() else "".join(map(self.level.__getitem__, unit))
        found = self.model.tokenize(mapped)
        return struct.pack(f"<{len(found)}H", *map(ID, found))

    def _word(self, raw: bytes) -> bytes:
        letters = raw.rstrip(MARKS)
        if letters.isalpha():  # of bytes: A-Z and a-z only
            ids = self.units[letters.lower()]
            return ids if len(letters) == len(raw) else ids + self.units[raw[len(letters) :]]
        latin = letters.decode().encode("latin-1", "replace")
        if latin and not latin.translate(None, PLAIN):
            ids = self.units[latin.translate(LOWER).decode("latin-1").encode()]
            return ids if len(letters) == len(raw) else ids + self.units[raw[len(letters) :]]
        ids = self.whole.encode(raw.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}H", *ids)

    def __call__(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text; bytes split at ASCII white space only."""
        if len(text) <= BYTES_AT_ONCE:
            if self.marked and text.isascii() and b"<" not in text:
                kinds = text.translate(KINDS)
                text = text.lower()
                if b".." not in kinds and b"!." not in kinds:  # each such mark is a pre-token: words are remembered without it
                    text = text.replace(b", ", b" , ").replace(b". ", b" . ")
            return b"".join(map(self.words.__getitem__, text.split()))
        return b"".join(b"".join(map(self.words.__getitem__, m[0].split())) for m in LONG.finditer(text))


_encoders: dict[str, Encoder] = {}
REMEMBERED["packing"] = _encoders.clear


def encoder(path: str) -> Encoder:
    """One for each worker: what it remembers is of use to later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _arrow(rows, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _encode(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), ("ids", pa.binary()), ("n", pa.int64()), ("part", pa.int32()), ("before", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, sent = encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([END_ID], dtype="<u2").tobytes()
        for batch in batches:
            give_back("packing")
            rows, held = [], 0
            for doc_id, queue, text in zip(*[batch.column(i) for i in range(3)], strict=True):
                ids = ids_of(text.as_buffer().to_pybytes()) + end
                q, n = queue.as_py(), len(ids) // 2
                rows.append((doc_id.as_py(), q, ids, n, part, sent.get(q, 0)))
                sent[q] = sent.get(q, 0) + n
                held += len(ids)
                if held > 8_000_000:
                    yield _arrow(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _arrow(rows, schema)

    return run


Share = tuple[int, int]


def _sent(share: Share, total: int, size: int, quantum: int, w: int) -> int:
    """What a queue has sent before window w: whole quanta, or all. A share is a fraction's two numbers."""
    owed = share[0] * size * w // share[1]
    return total if owed >= total else owed // quantum * quantum


def _window_of(share: Share, total: int, size: int, quantum: int, pos: int) -> int:
    """The window in which a queue sends its token at pos: that in which the quantum is owed."""
    need = min(total, (pos // quantum + 1) * quantum)
    return -(-need * share[1] // (share[0] * size)) - 1


def _cut(queues: list[str], shares: list[Fraction], totals: list[int], window: int, quantum: int, sequence: int):
    """Pieces of documents whose place in their queue is known."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string()), ("window", pa.int64())])
    at = {q: i for i, q in enumerate(queues)}
    each = [((s.numerator, s.denominator), n) for s, n in zip(shares, totals, strict=True)]

    def sent(i: int, w: int) -> int:
        """What queue i has sent before window w."""
        return _sent(*each[i], window, quantum, w)

    places: dict[int, tuple[list[int], list[int]]] = {}

    def place(w: int) -> tuple[list[int], list[int]]:
        """What each queue has sent before window w, and where its part of that window begins in the whole."""
        if w not in places:
            if len(places) > 4096:
                places.clear()
            now, then = [sent(i, w) for i in range(len(each))], [sent(i, w + 1) for i in range(len(each))]
            starts, x = [], sum(now)
            for a, b in zip(now, then, strict=True):
                starts.append(x)
                x += b - a
            places[w] = now, starts
        return places[w]

    def window_of(i: int, pos: int) -> int:
        return _window_of(*each[i], window, quantum, pos)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, queue, ids, n, pos in zip(*[batch.column(i) for i in range(5)], strict=True):
                doc_id, i, n, pos = doc_id.as_py(), at[queue.as_py()], n.as_py(), pos.as_py()
                wide = memoryview(np.frombuffer(ids.as_buffer(), dtype="<u2").astype("<u4").view(np.uint8))
                done, left = 0, 0
                while done < n:
                    if not left:  # what the queue sends in the next window in which it sends
                        w = window_of(i, pos)
                        now, starts = place(w)
                        left, whole = sent(i, w + 1) - pos, starts[i] + pos - now[i]
                    size = min(n - done, left, sequence - whole % sequence)
                    rows.append((doc_id, done, size, zlib.crc32(wide[4 * done : 4 * (done + size)]), n, whole // sequence, whole % sequence, queues[i], w))
                    done, pos, left, whole = done + size, pos + size, left - size, whole + size
                if len(rows) > 20_000:
                    yield _arrow(rows, schema)
                    rows = []
            if rows:
                yield _arrow(rows, schema)

    return run


def _parts(size: int, quantum: int):
    """What each queue sends in each window in which it sends anything."""
    schema = pa.schema([("queue", pa.string()), ("window", pa.int64()), ("sent", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for queue, total, num, den in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                share, pos = (int(num), int(den)), 0
                while pos < total:
                    w = _window_of(share, total, size, quantum, pos)
                    end = _sent(share, total, size, quantum, w + 1)
                    rows.append((queue, w, end - pos))
                    pos = end
                    if len(rows) > 20_000:
                        yield _arrow(rows, schema)
                        rows = []
            if rows:
                yield _arrow(rows, schema)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With what the rows before have sent, by range."""
    at, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        n = batch.column(2).to_numpy()
        before = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(before, pa.int64())], ["queue", "window", "sent", "range", "before"])


def _split(size: int, quantum: int):
    """Documents by the windows of their queue, each with its ids there."""
    schema = pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), ("window", pa.int64()), ("start", pa.int64()), ("skip", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, queue, ids, n, pos, total, num, den in zip(*batch.columns, strict=True):
                doc_id, queue, ids, n, pos, total = (x.as_py() for x in (doc_id, queue, ids, n, pos, total))
                share, done = (int(num.as_py()), int(den.as_py())), 0
                while done < n:
                    w = _window_of(share, total, size, quantum, pos)
                    k = min(n - done, _sent(share, total, size, quantum, w + 1) - pos)
                    rows.append((doc_id, queue, w, done, pos - _sent(share, total, size, quantum, w), ids[2 * done : 2 * (done + k)], n))
                    done, pos = done + k, pos + k
                held += len(ids)
                if len(rows) > 20_000 or held > 8_000_000:
                    yield _arrow(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _arrow(rows, schema)

    return run


def _cut_split(sequence: int):
    """Pieces of parts of documents whose place in the whole is known."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string()), ("window", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, queue, w, start, ids, n, whole in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                wide, done = np.frombuffer(ids, dtype="<u2").astype("<u4"), 0
                while done < len(wide):
                    size = min(len(wide) - done, sequence - whole % sequence)
                    rows.append((doc_id, start + done, size, zlib.crc32(wide[done : done + size]), n, whole // sequence, whole % sequence, queue, w))
                    done, whole = done + size, whole + size
            if rows:
                yield _arrow(rows, schema)

    return run


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window long"


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, window: int = WINDOW, shares: dict[str, float] | None = None, max_queues: int = MAX_QUEUES) -> DataFrame:
    """A row per piece. shares: wanted proportions by source (default: of the tokens
    that there are). A queue that is empty before the others leaves its part to them."""
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    spark = docs.sparkSession
    encoded = docs.select(F.col("doc_id").cast("long"), name.alias("queue"), text_of().alias("text")).mapInArrow(_encode(tokenizer), "doc_id long, queue string, ids binary, n long, part int, before long")
    table = written(encoded, "ids")
    sizes = written(table.groupBy("queue", "part").agg(F.sum("n").alias("n")), "queues")
    by_queue = written(sizes.groupBy("queue").agg(F.sum("n").alias("total")), "totals")
    totals = {r["queue"]: r["total"] for r in by_queue.limit(max_queues + 1).collect()}
    few, size, quantum = len(totals) <= max_queues, window * sequence, max(1, sequence // QUANTA)
    if not totals:
        return spark.createDataFrame([], PIECE)
    if shares is None:
        every = by_queue.agg(F.sum("total")).first()[0]
        wanted = by_queue.select("queue", "total", F.col("total").cast("string").alias("num"), F.lit(str(every)).alias("den"))
        share = {q: Fraction(n, every) for q, n in totals.items()} if few else None
    else:
        # the caller holds a share of every source
        queues = [r["queue"] for r in by_queue.select("queue").limit(len(shares) + 1).collect()]
        raw = {q: Fraction(shares.get(q.removeprefix("="), 0)).limit_denominator(10**6) for q in queues}
        if min(raw.values()) <= 0:
            raise ValueError("every source needs a positive share")
        all_shares = sum(raw.values())
        share = {q: x / all_shares for q, x in raw.items()}
        wanted = by_queue.join(spark.createDataFrame([(q, str(x.numerator), str(x.denominator)) for q, x in share.items()], "queue string, num string, den string"), "queue")
    w = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0))).select("queue", "part", "base")
    placed = table.join(bases, ["queue", "part"]).select("doc_id", "queue", "ids", "n", (F.col("base") + F.col("before")).alias("pos"))
    if few:
        queues = sorted(totals)
        return placed.mapInArrow(_cut(queues, [share[q] for q in queues], [totals[q] for q in queues], size, quantum, sequence), PIECE)
    wanted = written(wanted.select("queue", "total", "num", "den"), "shares")
    parts = written(wanted.mapInArrow(_parts(size, quantum), "queue string, window long, sent long"), "parts")
    ordered = parts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "window", "queue").sortWithinPartitions("window", "queue")
    summed = written(ordered.mapInArrow(_summed, "queue string, window long, sent long, range int, before long"), "places")
    at, ranges = 0, []
    for x in summed.groupBy("range").agg(F.sum("sent").alias("n")).orderBy("range").collect():  # a row per range
        ranges.append((x["range"], at))
        at += x["n"]
    first = F.broadcast(spark.createDataFrame(ranges, "range int, first long"))
    places = summed.join(first, "range").select("queue", "window", (F.col("first") + F.col("before")).alias("place"))
    split = placed.join(wanted, "queue").select("doc_id", "queue", "ids", "n", "pos", "total", "num", "den").mapInArrow(_split(size, quantum), "doc_id long, queue string, window long, start long, skip long, ids binary, doc_tokens long")
    met = split.join(places, ["queue", "window"]).select("doc_id", "queue", "window", "start", "ids", "doc_tokens", (F.col("place") + F.col("skip")).alias("whole"))
    return met.mapInArrow(_cut_split(sequence), PIECE)
