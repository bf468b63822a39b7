r"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding is the best path over a vocabulary's pieces, each with a score: a max-plus
problem. The public file at hand was made by merging and holds merge ranks, which no sum
of scores reproduces; its pieces are therefore scored by Zipf's law from their ranks and
encoded as a unigram model does (tests hold the ids against the library's own unigram
encoder with these scores). Scores are whole numbers (1024ths), so that sums are exact at
any length; of equal paths to a place the one with the longer last piece is taken.

No piece spans the place before a word mark that follows a word, nor either side of a
line end, so paths there fall into segments, whose ids are remembered. A giant document
is cut into chunks of a fixed size. A boundary's state is by how many characters a piece
reaches into the next chunk; a chunk gives the matrix of its best scores from each state
at its start to each at its end. Matrices are multiplied in the max-plus semiring, which
is associative: neighbours first, then pairs of pairs, then downward for each prefix;
one step back along the boundaries picks their states, and
then each chunk is traced back on its own. Of equal paths the same is taken as without
chunks: a chunk also tells, for each state at its end, which of the states at its start
come first if their scores are equal (reading from the end, a longer piece comes first,
and one that began in an earlier chunk before all). The ids of a text are the same for
every size of chunks.

Characters without a piece are spelled in bytes. Decoding joins pieces and bytes, turns
word marks into spaces and drops the leading one.

A document's matrices, in bytes about two thirds of its own, meet in one task, as its text did.

Defined results: null text counts as empty and has no ids. The word mark itself
(U+2581) decodes as a space, all other texts as they were. Repeated rows are encoded
each; a null doc_id is kept. Other columns are not read. An empty table gives an empty
result."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Memo, runs, text_of, written

MARK = "▁"
SCALE = 1024
#: Texts of more characters are cut into chunks.
GIANT, CHUNK = 65_536, 16_384
NEVER = -(1 << 60)


def zipf(rank: int, size: int) -> int:
    """log probability of the piece of a rank, in 1024ths."""
    return -round(SCALE * (math.log(rank + 2.7) + math.log(math.log(size) + 0.5772)))


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = {}
        self.scores: dict[str, tuple[int, int]] = {}
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
        for rank, i in enumerate(plain, 1):
            self.scores[sp.id_to_piece(i)] = zipf(rank, len(plain)), i
        if len(self.bytes) != 256 or n > 65_536:
            raise ValueError("a vocabulary with byte pieces and 16-bit ids is needed")
        if any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p in self.scores):
            raise ValueError("pieces must not span words or lines")
        self.unknown = min(s for s, _ in self.scores.values()) - 10 * SCALE
        self.longest = max(map(len, self.scores))
        # scores of pieces (negative); 0 for what only begins one
        self.table = {p[:k]: 0 for p in self.scores for k in range(1, len(p) + 1)} | {p: s for p, (s, _) in self.scores.items()}
        self.spelled = {i: bytes([b]) for b, i in self.bytes.items()} | {i: p.encode() for p, (_, i) in self.scores.items()}
        self.segments = Memo(self._segment, 250_000)
        self.parts = Memo(lambda s: self.ids(s, self.best(s)[1]), 100_000)
        self.values = Memo(lambda s: self.best(s)[0], 100_000)
        # letters that stand side by side in a piece: no piece spans any other place
        self.inner = {p[k : k + 2] for p in self.scores for k in range(len(p) - 1)}
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def _reached(self, s: str, first: int, until: int) -> tuple[list[int], list[int]]:
        """Of each place the best score of paths from first whose last piece begins before
        until, and where that piece begins (of equal ones the longest)."""
        n, get, unknown = len(s), self.table.get, self.unknown
        score, back = [NEVER] * (n + 1), [-1] * (n + 1)
        score[first] = 0
        for at in range(first, min(n, until)):
            here = score[at]
            if here == NEVER:
                continue
            stop = at + 1
            value = get(s[at:stop])
            if not value:  # no piece of its own: spelled in bytes
                if here + unknown > score[stop]:
                    score[stop], back[stop] = here + unknown, at
            while value is not None:
                if value and here + value > score[stop]:
                    score[stop], back[stop] = here + value, at
                stop += 1
                if stop > n:
                    break
                value = get(s[at:stop])
        return score, back

    @staticmethod
    def _path(back: list[int], first: int, end: int) -> list[tuple[int, int]]:
        path = []
        while end > first:
            path.append((back[end], end))
            end = back[end]
        return path[::-1]

    def best(self, s: str, first: int = 0, crossing: int | None = None) -> tuple[int, list[tuple[int, int]]]:
        """Score and (start, end)s of the best path from first to the end of s; with
        crossing, of those whose last piece begins before that place."""
        score, back = self._reached(s, first, len(s) if crossing is None else crossing)
        return score[-1], self._path(back, first, len(s)) if score[-1] > NEVER else []

    def ids(self, s: str, path: list[tuple[int, int]]) -> bytes:
        out = []
        for a, b in path:
            found = self.scores.get(s[a:b])
            out += [found[1]] if found else [self.bytes[x] for x in s[a:b].encode()]
        return np.array(out, dtype="<u2").tobytes()

    def _segment(self, s: str) -> bytes:
        out, start, inner = b"", 0, self.inner
        for k in range(1, len(s)):
            if s[k - 1 : k + 1] not in inner:
                out += self.parts[s[start:k]]
                start = k
        return out + self.parts[s[start:]] if start else self.ids(s, self.best(s)[1])

    def encode(self, marked: str) -> bytes:
        return b"".join(map(self.segments.__getitem__, self.cut.findall(marked)))

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode(errors="replace").replace(MARK, " ")
        return text.removeprefix(" ")

    # chunks
    def edges(self, s: str, size: int) -> tuple[int | None, int | None]:
        """The first and last places of a chunk's own part that no piece spans."""
        first = last = None
        for m in re.finditer(f"(?<=[^{MARK}])(?={MARK})|(?<=\n)|(?=\n)", s[:size]):
            if 0 < m.start() < size:
                first, last = m.start() if first is None else first, m.start()
        return first, last

    def _over(self, score: list[int], size: int) -> np.ndarray:
        """Scores by how far the last piece reaches over a chunk's end."""
        out = np.full(self.longest, NEVER, dtype=np.int64)
        found = score[size : size + self.longest]
        out[: len(found)] = found
        return out

    def matrix(self, s: str, size: int) -> np.ndarray:
        return self.matrix_and_ranks(s, size)[0]

    def matrix_and_ranks(self, s: str, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores from state to state of a chunk, and of each the rank among those of the
        same end if scores are equal: s is the chunk's own part and what follows it."""
        m = self.longest
        out, ranks = np.full((m, m), NEVER, dtype=np.int64), np.full((m, m), m, dtype=np.uint8)

        def rank(j, paths: dict[int, list[tuple[int, int]]]) -> None:
            keys = {i: [*(a - b for a, b in reversed(path)), -len(s) - m] for i, path in paths.items()}
            for k, i in enumerate(sorted(keys, key=keys.__getitem__)):
                ranks[i, j] = k

        first, last = self.edges(s, size)
        if first is None:
            found = {i: self._reached(s, i, size) for i in range(min(m, size))}
            for i, (score, _) in found.items():
                out[i] = self._over(score, size)
            for i in range(size, m):  # a piece that covers the whole chunk
                out[i, i - size] = 0
            for j in range(min(m, len(s) - size + 1)):
                rank(j, {i: self._path(back, i, size + j) for i, (score, back) in found.items() if score[size + j] > NEVER} | ({size + j: []} if size + j < m else {}))
            return out, ranks
        middle = sum(map(self.values.__getitem__, self.cut.findall(s[first:last])))
        rest = self._over(self._reached(s[last:], 0, size - last)[0], size - last)
        heads = {i: self.best(s[:first], i) for i in range(min(m, first + 1))}
        for i, (head, _) in heads.items():
            if head > NEVER:
                out[i] = np.where(rest > NEVER, head + middle + rest, NEVER)
        rank(slice(None), {i: path for i, (head, path) in heads.items() if head > NEVER})
        return out, ranks

    def trace(self, s: str, size: int, enter: int, leave: int) -> bytes:
        """The ids of the pieces that begin in a chunk, between two states."""
        if enter >= size:
            return b""
        first, last = self.edges(s, size)
        end = size + leave
        if first is None or enter > first:
            return self.ids(s[:end], self.best(s[:end], enter, size)[1])
        head, tail = s[:first], s[last:end]
        return self.ids(head, self.best(head, enter)[1]) + self.encode(s[first:last]) + self.ids(tail, self.best(tail, 0, size - last)[1])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of max-plus matrices, (..., m, m)."""
    return np.maximum((a[..., :, :, None] + b[..., None, :, :]).max(-2), NEVER)


def prefixes(ms: np.ndarray) -> np.ndarray:
    """The products of the first 0, 1, ... n matrices, by pairs upward and then downward."""
    n, m = len(ms), ms.shape[1]
    unit = np.full((m, m), NEVER, dtype=np.int64)
    np.fill_diagonal(unit, 0)
    if n == 1:
        return np.stack([unit, ms[0]])
    even = n - n % 2
    pairs = product(ms[0:even:2], ms[1:even:2])
    up = prefixes(pairs)  # after 0, 2, 4, ...
    out = np.empty((n + 1, m, m), dtype=np.int64)
    out[0 : even + 1 : 2] = up
    out[1 : even + 1 : 2] = product(up[:-1], ms[0:even:2])
    if n % 2:
        out[n] = product(up[-1], ms[n - 1])
    return out


def states(ms: np.ndarray, ranks: np.ndarray | None = None) -> list[int]:
    """The best path's states at all boundaries of a document, both ends included (without ranks: of equal ones the least)."""
    ranks = np.zeros(ms.shape, dtype=np.uint8) if ranks is None else ranks
    reach = prefixes(ms)[:, 0, :]
    out = [0]
    for k in range(len(ms) - 1, -1, -1):
        total = reach[k] + ms[k][:, out[-1]]
        out.append(int(np.argmin(np.where(total == total.max(), ranks[k][:, out[-1]], 255))))
    return out[::-1]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


ENCODED = "doc_id long, ids binary, chunks int, text_sha256 string"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("chunks", pa.int32()), ("text_sha256", pa.string())])


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(1).to_pylist()
                yield _batch([(i, own.encode(marked(t)), 1, hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(part.column(0).to_pylist(), texts, strict=True)], _ENCODED)

    return run


def _chunked(path: str, size: int):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("chunk", pa.int32()), ("size", pa.int32()), ("s", pa.string()), ("matrix", pa.binary()), ("ranks", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            for row, doc_id, text in zip(*[batch.column(i) for i in range(3)], strict=True):
                s = marked(text.as_py())
                sha = hashlib.sha256(text.as_py().encode()).hexdigest()
                for k, at in enumerate(range(0, len(s), size)):
                    part, n = s[at : at + size + own.longest - 1], min(size, len(s) - at)
                    yield _batch([(row.as_py(), doc_id.as_py(), sha, k, n, part, *(x.tobytes() for x in own.matrix_and_ranks(part, n)))], schema)

    return run


def _stated(longest: int):
    schema = pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("enter", pa.int32()), ("leave", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 1):
            ms = np.stack([np.frombuffer(x.as_buffer(), np.int64).reshape(longest, longest) for x in t.column("matrix")])
            ranks = np.stack([np.frombuffer(x.as_buffer(), np.uint8).reshape(longest, longest) for x in t.column("ranks")])
            found = states(ms, ranks)
            row = t.column("row")[0].as_py()
            yield _batch([(row, k, found[k], found[k + 1]) for k in range(len(ms))], schema)

    return run


def _traced(path: str):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("chunk", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            for r in batch.to_pylist():
                yield _batch([(r["row"], r["doc_id"], r["text_sha256"], r["chunk"], own.trace(r["s"], r["size"], r["enter"], r["leave"]))], schema)

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, parts, chunks, sha in zip(*batch.columns, strict=True):
            yield _batch([(doc_id.as_py(), b"".join(parts.as_py()), chunks.as_py(), sha.as_py())], _ENCODED)


def encode(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids (16-bit little-endian numbers), chunks, text_sha256 of every row. Chunks
    of giant documents are rows of their own, dealt out anew at each step."""
    base = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    longest = pieces(path).longest
    small = base.filter(F.length("text") <= giant).mapInArrow(_whole(path), ENCODED)
    large = base.filter(F.length("text") > giant).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cut = written(large.mapInArrow(_chunked(path, chunk), "row long, doc_id long, text_sha256 string, chunk int, size int, s string, matrix binary, ranks binary"), "chunks")
    by_row = cut.select("row", "chunk", "matrix", "ranks").repartition("row").sortWithinPartitions("row", "chunk")
    stated = written(by_row.mapInArrow(_stated(longest), "row long, chunk int, enter int, leave int"), "states")
    met = cut.drop("matrix", "ranks").join(stated, ["row", "chunk"])
    traced = met.mapInArrow(_traced(path), "row long, doc_id long, text_sha256 string, chunk int, ids binary")
    joined = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    whole = joined.select("doc_id", F.transform("parts", lambda p: p["ids"]).alias("parts"), F.size("parts").alias("chunks"), "text_sha256")
    return small.unionByName(whole.mapInArrow(_together, ENCODED))


def decode(encoded: DataFrame, path: str, keep_text: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, chunks, text_sha256 and what the ids decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("chunks", pa.int32()), ("text_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_chars", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            out, held = [], 0
            for doc_id, raw, n, sha in zip(*[batch.column(i) for i in range(4)], strict=True):
                ids = np.frombuffer(raw.as_buffer(), dtype="<u2")
                text = own.decode(ids)
                out.append((doc_id.as_py(), len(ids), zlib.crc32(ids.astype("<u4")), n.as_py(), sha.as_py(), hashlib.sha256(text.encode()).hexdigest(), len(text), text if keep_text else None))
                held += len(text)
                if held > 4_000_000:
                    yield _batch(out, schema)
                    out, held = [], 0
            if out:
                yield _batch(out, schema)

    return encoded.select("doc_id", "ids", "chunks", "text_sha256").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, chunks int, text_sha256 string, decoded_sha256 string, n_chars long, text string")


def round_trip(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_crc32, chunks, text_sha256, decoded_sha256, round_trip."""
    found = decode(encode(docs, path, giant, chunk), path, keep_text=False)
    return found.select("doc_id", "n_chars", "n_tokens", "ids_crc32", "chunks", "text_sha256", "decoded_sha256", (F.col("text_sha256") == F.col("decoded_sha256")).alias("round_trip"))
