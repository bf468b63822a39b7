"""Language-model scores by a hashed maximum-entropy model.

The probability of a token is that of its class, given the words before, times that of the
word in its class, given the word before.

Classes. Words are grouped by a hash of their ending, and groups that stand among the same
neighbours in the training documents are one class (k-means of the groups' neighbours).
The end of a text is a class of its own. The class is drawn by a softmax over weights of
hashed word features: the word before, the two words before (n-grams), the word before the
last and the one before that (skips), and a constant. Words that are not frequent go by
their group as features. Features share rows of one table of TABLE_ROWS rows, and the
training does not mind: in each round every task takes its part of a slice of the training
documents through gradient updates (steps shrink by what a row has seen), and the tasks'
rows are averaged by how many tokens each has seen of them. Documents held back from the
updates judge each round; one that makes them less likely is taken back, and goes on at
half the step. The slices together are all training documents.

Words in classes. For each word before (hashed together with the class, 64 bits) all
training documents' continuations are counted, in a table that is dealt by that hash and
grows with the training tokens. The word is drawn by a softmax over the continuations
seen there and an escape; the weight of a continuation is the logarithm of its count, that
of the escape follows from how many continuations were seen just once (regularised by
ESCAPE), which is where the likelihood of leaving one out is greatest. The escape draws by
the words' counts in the class (add-half smoothed, with room for an unknown one).
Continuations are counted of words of at least one in FREQUENT training tokens, at most
FREQUENT words whatever the size; the others are always drawn by the escape.

Word counts come from all training documents. The frequent words' go to all tasks; the
others' are met by a shuffle join on 64-bit word hashes. Documents are tokenized in bounded pieces
and scored in numpy batches; continuations travel as sorted arrays, and what comes back is
a number for each document of an array.

Defined results: tokens are what ASCII white space bounds, A-Z lower-cased, then one end.
Null text counts as empty: it has the end alone. A null doc_id has the remainder of the
empty text. Repeated rows are learned from and scored each. Without training documents
the counts are 0 and classes are drawn alike. A very long text is scored whole, its words
in pieces. Other columns are not read. An empty table gives an empty result."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Memo, crc_mod, runs, text_of, written

GROUPS = 512
CLASSES = 32
END = CLASSES - 1
#: Rows of the feature table.
TABLE_ROWS = 1 << 13
ROUNDS = 4
#: One in so many training documents is held back from the updates, to judge them.
HELD_BACK = 16
RATE = 0.3
#: Tokens in an update at most, and updates at least that a piece of a task is cut into.
BATCH, UPDATES = 2048, 32
#: Pseudo-counts of continuations that were seen just once, and of the others.
ESCAPE = (4.0, 0.2)
#: Tokens in training per word that all tasks know, and their number at most.
FREQUENT = 1 << 20
WORDS_HELD = 400_000
#: Tokens scored or learned from at a time, and documents.
TOKENS_AT_ONCE, DOCS_AT_ONCE = 1 << 18, 1 << 16
#: Tokens whose continuations travel in one array.
TOKENS_TO_DEAL = 1 << 20
BYTES_AT_ONCE = 1_000_000
LONG = re.compile(rb"(?:[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*){1,50000}")
BLOCK = 1024
END_HASH = 7
MARKS = b".,;:!?*$%#&\"'()"
RARE = FREQUENT
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _group_of_tail(tail: bytes) -> int:
    return xxhash.xxh3_64_intdigest(tail) % (GROUPS - 1)


def group_of(word: bytes) -> int:
    """By the last letters, punctuation left out."""
    return _group_of_tail(word.strip(MARKS)[-3:])


def feature_rows(third: np.ndarray, before: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """The rows of each feature of histories: word before, two before, and both skips."""
    shift = np.uint64(64 - TABLE_ROWS.bit_length() + 1)
    a, b, c = (x.astype(np.uint64) for x in (last, before, third))
    one = a * _MIX[0]
    both = (one ^ ((b * _MIX[1]) >> np.uint64(7))) * _MIX[4]
    rows = (one, both, (b + np.uint64(1)) * _MIX[2], (c + np.uint64(2)) * _MIX[3])
    return [((r ^ (r >> np.uint64(29))) * _MIX[1] >> shift).astype(np.int64) for r in rows]


#: The row of the constant feature.
CONSTANT = 0


def logits(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Bounded, so that their exponentials need no scaling."""
    out = weights.take(rows[0], 0)
    for r in rows[1:]:
        out += weights.take(r, 0)
    out += weights[CONSTANT]
    return np.clip(out, -60, 60, out=out)


def log_likely(weights: np.ndarray, rows: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    """The log probability of each token's class."""
    p = logits(weights, rows)
    mine = p[np.arange(len(p)), classes].astype(np.float64)
    return mine - np.log(np.exp(p, out=p).sum(1))


def probabilities(weights: np.ndarray, before: np.ndarray, last: np.ndarray, third: np.ndarray | None = None) -> np.ndarray:
    """(histories, classes)."""
    p = np.exp(logits(weights, feature_rows(np.zeros_like(before) if third is None else third, before, last)))
    return p / p.sum(1, keepdims=True)


class Words:
    """What a task knows of words, by a number that each gets when first seen; 0 is the end."""

    def __init__(self, classes: np.ndarray | None = None, frequent: tuple[np.ndarray, np.ndarray] | None = None, bound: int = WORDS_HELD):
        self.class_of, self.frequent, self.bound = classes, frequent, bound
        self.clear()

    def clear(self) -> None:
        self._numbers = defaultdict(count(1).__next__)
        self._number, self._groups, self.known = self._numbers.__getitem__, Memo(_group_of_tail), 0

    @property
    def full(self) -> bool:
        return len(self._numbers) >= self.bound

    def __call__(self, text: bytes) -> np.ndarray:
        """The numbers of a text's words, the end after them."""
        if len(text) <= BYTES_AT_ONCE:
            words = text.lower().split()
            out = np.zeros(len(words) + 1, np.int32)
            out[:-1] = np.fromiter(map(self._number, words), dtype=np.int32, count=len(words))
            return out
        parts = [np.fromiter(map(self._number, m[0].lower().split()), dtype=np.int32) for m in LONG.finditer(text)]
        return np.concatenate([*parts, np.zeros(1, np.int32)])

    def learn(self) -> None:
        """Bring the arrays by number up to date."""
        new = self.known
        if new == len(self._numbers) + 1:
            return
        # in the order of their numbers
        words = list(islice(self._numbers, max(0, new - 1), None))
        hashes = np.array([word_hash(w) for w in words], np.int64)
        groups = np.array([self._groups[w.strip(MARKS)[-3:]] for w in words], np.uint16)
        if not new:
            hashes, groups = np.append(END_HASH, hashes), np.append(np.uint16(GROUPS - 1), groups)
        found = {"hashes": hashes, "groups": groups}
        if self.class_of is not None:
            found["classes"] = self.class_of[groups]
            known, counts = self.frequent
            at = np.searchsorted(known, hashes)
            hit = known[np.minimum(at, len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), bool)
            found["index"] = np.where(hit, at, -1).astype(np.int32)
            found["counts"] = np.where(hit, counts[np.minimum(at, len(known) - 1)], -1) if len(known) else np.full(len(hashes), -1)
            # as a feature: a frequent word is itself, any other its group
            found["feature"] = np.where(hit, hashes.view(np.uint64), groups.astype(np.uint64) + np.uint64(1 << 20))
        for k, v in found.items():
            setattr(self, k, np.concatenate([getattr(self, k), v]) if new else v)
        self.known = len(self._numbers) + 1


def _gathered(words: Words, texts: Iterator, tokens: int = TOKENS_AT_ONCE, docs: int = DOCS_AT_ONCE) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(value, text) pairs in lots of about so many tokens; words forgets only between lots."""
    values, numbers, n = [], [], 0
    for value, text in texts:
        values.append(value)
        numbers.append(words(text))
        n += len(numbers[-1])
        if n >= tokens or len(values) >= docs or words.full:
            words.learn()
            yield values, numbers
            values, numbers, n = [], [], 0
            if words.full:
                words.clear()
    if values:
        words.learn()
        yield values, numbers


def _histories(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all tokens and of the three tokens before each; ends stand before a text."""
    lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
    now = np.concatenate(numbers)
    starts = np.cumsum(lengths) - lengths
    shifted = []
    for k in (1, 2, 3):
        x = np.zeros_like(now)
        x[k:] = now[:-k]
        for j in range(k):
            at = starts + j
            x[at[at < starts + lengths]] = 0
        shifted.append(x)
    return now, *shifted


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, group) of words; of pairs of groups (the pair, c, -1)."""
    words, near = Words(), np.zeros(GROUPS * GROUPS, np.int64)
    counts = np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        at = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(words.hashes[at]), pa.array(counts[at]), pa.array(words.groups[at].astype(np.int32))], ["h", "c", "group"])

    texts = ((None, t.as_py()) for batch in batches for t in batch.column(0))
    for _, numbers in _gathered(words, texts):
        now, before, _, _ = _histories(numbers)
        seen = np.bincount(now, minlength=words.known)
        seen[: len(counts)] += counts
        counts = seen
        g = words.groups.astype(np.int64)
        near += np.bincount(g[before] * GROUPS + g[now], minlength=GROUPS * GROUPS)
        if words.full:
            yield out()
            counts = np.zeros(0, np.int64)
    if len(counts):
        yield out()
    at = np.flatnonzero(near)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(near[at]), pa.array(np.full(len(at), -1, np.int32))], ["h", "c", "group"])


def classes_of(near: np.ndarray, turns: int = 12) -> np.ndarray:
    """The class of each group: k-means of the neighbours before and after, weighed by counts."""
    total = near.sum(1)
    side = lambda m: np.sqrt(m / np.maximum(m.sum(1, keepdims=True), 1))
    x = np.hstack([side(near), side(near.T)])[: GROUPS - 1]
    weight = total[: GROUPS - 1].astype(float)
    centres = x[np.argsort(-weight, kind="stable")[: CLASSES - 1]]
    for _ in range(turns):
        mine = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None]).argmin(1)
        for k in range(CLASSES - 1):
            w = weight * (mine == k)
            if w.sum():
                centres[k] = w @ x / w.sum()
    return np.append(mine, END).astype(np.uint8)


def _sgd(weights: np.ndarray, scale: np.ndarray, rows: list[np.ndarray], classes: np.ndarray, rate: float, turn: int) -> None:
    """One update in place, of the constant and of the family of features whose turn it is;
    scale holds squares of gradients."""
    p = np.exp(logits(weights, rows))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(p)), classes] -= 1
    mine = rows[turn % len(rows)].astype(np.uint16)
    order = np.argsort(mine, kind="stable")
    mine = mine[order]
    first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
    for r, d in ((mine[first], np.add.reduceat(p.take(order, 0), first, axis=0)), ([CONSTANT], p.sum(0, keepdims=True))):
        s = scale[r] + d * d
        scale[r] = s
        weights[r] -= rate * d / np.sqrt(s)


def _train(classes: np.ndarray, frequent, weights: np.ndarray, seen: np.ndarray, prior: np.ndarray, rate: float):
    """What a task makes of its part of a slice: of each block of rows the weights times the
    tokens seen, and those; and as block -1 the log likelihood of what is held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = Words(classes, frequent), weights.copy()
        scale = (seen[:, None] * (prior * (1 - prior))[None] + 0.1).astype(np.float32)
        mine, judged = np.zeros(TABLE_ROWS), np.zeros(2)
        texts = ((b.as_py(), t.as_py()) for batch in batches for b, t in zip(batch.column(0), batch.column(1), strict=True))
        for back, numbers in _gathered(words, texts):
            for held in (True, False):
                some = [x for x, b in zip(numbers, back, strict=True) if b == held]
                if not some:
                    continue
                now, *before = _histories(some)
                rows = feature_rows(*[words.feature[x] for x in reversed(before)])
                c = words.classes[now].astype(np.int64)
                size = min(BATCH, max(64, len(now) // UPDATES))
                for turn, i in enumerate(range(0, len(now), size)):
                    part, mine_of = [r[i : i + size] for r in rows], c[i : i + size]
                    if held:
                        judged += log_likely(weights, part, mine_of).sum(), len(mine_of)
                    else:
                        _sgd(w, scale, part, mine_of, rate, turn)
                if not held:
                    mine += np.bincount(np.concatenate(rows), minlength=TABLE_ROWS)
                    mine[CONSTANT] += len(now)
        blocks = [b for b in range(TABLE_ROWS // BLOCK) if mine[b * BLOCK : (b + 1) * BLOCK].any()]
        sums = [np.hstack([w[(s := slice(b * BLOCK, (b + 1) * BLOCK))] * mine[s, None], mine[s, None]]).astype(np.float32).tobytes() for b in blocks]
        yield pa.RecordBatch.from_arrays([pa.array([*blocks, -1], pa.int32()), pa.array([*sums, judged.tobytes()], pa.binary())], ["block", "values"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of binary arrays by block."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(values.as_buffer(), np.float32 if block >= 0 else np.float64).astype(np.float64)
            total[block] = total[block] + x if block in total else x
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "values"])


def train(learned: DataFrame, classes: np.ndarray, frequent, prior: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[np.ndarray, list[float]]:
    """The weights, and the log likelihood per token of the documents held back before the
    first round and after each, which never falls."""
    place = F.pmod(F.xxhash64("text"), F.lit(HELD_BACK * max(rounds, 1)))
    placed = learned.select((place < rounds).alias("back"), "text", (place % max(rounds, 1)).alias("slice"))
    weights = np.zeros((TABLE_ROWS, CLASSES), np.float32)
    weights[CONSTANT] = np.log(prior)
    best, seen, best_seen, trace = weights, np.zeros(TABLE_ROWS), np.zeros(TABLE_ROWS), []
    for turn in range(rounds + 1):
        part = placed.filter(F.col("back") | (F.col("slice") == turn)) if turn < rounds else placed.filter("back")
        made = part.select("back", "text").mapInArrow(_train(classes, frequent, weights, seen, prior, rate), "block int, values binary")
        found = {r["block"]: np.frombuffer(r["values"]) for r in made.repartition(TABLE_ROWS // BLOCK, "block").mapInArrow(_summed, "block int, values binary").collect()}  # a row per block
        likelihood = float(found[-1][0] / max(found[-1][1], 1)) if -1 in found else 0.0
        if trace and likelihood < trace[-1]:
            # taken back: go on from the best so far, at half the step
            weights, seen, rate = best, best_seen, rate / 2
            trace.append(trace[-1])
            continue
        best, best_seen = weights, seen
        trace.append(likelihood)
        weights, seen = weights.copy(), seen.copy()
        for block, values in found.items():
            if block >= 0:
                x, rows = values.reshape(BLOCK, CLASSES + 1), slice(block * BLOCK, (block + 1) * BLOCK)
                n = x[:, -1:]
                weights[rows] = np.where(n > 0, x[:, :-1] / np.maximum(n, 1), weights[rows])
                seen[rows] += n[:, 0]
    return best, trace


def _packed(keys: np.ndarray, events: np.ndarray, docs: np.ndarray) -> bytes:
    """Sorted keys as differences, in planes of bytes, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) for x in (steps, events.astype("<u4"), docs.astype("<u4"))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // 16
    whole = lambda a, b, kind: np.ascontiguousarray(raw[a * n : b * n].reshape(b - a, n).T).view(kind).ravel()
    return np.cumsum(whole(0, 8, np.uint64), dtype=np.uint64), whole(8, 12, np.uint32), whole(12, 16, np.uint32)


def continuation_keys(before: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Of the hash of the word before and the class of the word."""
    k = (before.view(np.uint64) ^ (classes.astype(np.uint64) + np.uint64(1)) * _MIX[2]) * _MIX[0]
    return (k ^ (k >> np.uint64(31))) * _MIX[1]


PART = "bucket int, row long, doc_id long, n_tokens long, known long, logs double, context double, rare array<long>, times array<long>, chunk long, data binary"


def _score(classes: np.ndarray, frequent, weights: np.ndarray, sizes: np.ndarray, buckets: int):
    """Of each document what needs no other; and arrays of its continuations, by bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("context", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("chunk", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunk = Words(classes, frequent), TaskContext.get().partitionId() << 24
        keys, events, docs, held, n_docs = [], [], [], 0, 0

        def dealt() -> pa.RecordBatch:
            k, e, d = np.concatenate(keys), np.concatenate(events), np.concatenate(docs)
            order = np.argsort(k)
            k, e, d = k[order], e[order], d[order]
            cuts = np.searchsorted(k, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64))
            rows = [(b, _packed(k[i:j], e[i:j], d[i:j])) for b, (i, j) in enumerate(zip(cuts, [*cuts[1:], len(k)], strict=True)) if j > i]
            n = len(rows)
            cols = {"bucket": [b for b, _ in rows], "chunk": [chunk] * n, "data": [x for _, x in rows]}
            return pa.RecordBatch.from_arrays([pa.array(cols.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

        texts = (((i.as_py(), bool(t.as_py())), x.as_py()) for batch in batches for i, t, x in zip(*batch.columns, strict=True))
        for values, numbers in _gathered(words, texts, docs=DOCS_AT_ONCE // 4):
            if keys and (held + sum(map(len, numbers)) > TOKENS_TO_DEAL or n_docs + len(values) > DOCS_AT_ONCE):
                yield dealt()
                keys, events, docs, held, n_docs, chunk = [], [], [], 0, 0, chunk + 1
            now, last, before, third = _histories(numbers)
            c, index = words.classes[now], words.index[now]
            context = np.empty(len(now))
            for i in range(0, len(now), 8192):
                s = slice(i, i + 8192)
                context[s] = log_likely(weights, feature_rows(words.feature[third[s]], words.feature[before[s]], words.feature[last[s]]), c[s])
            lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
            of = np.repeat(np.arange(len(numbers)), lengths)
            count = words.counts[now]
            common = count >= 0
            logs = np.bincount(of[common], np.log10(count[common] + 0.5), len(numbers))
            # a rare word is drawn by the escape: what its class takes is known here, its count is not
            inside = np.bincount(of[~common], sizes[c[~common]], len(numbers))
            context = np.bincount(of, context, len(numbers)) / np.log(10) - inside
            known = np.bincount(of[common], minlength=len(numbers))
            rows, start = [], 0
            for i, (doc_id, _) in enumerate(values):
                n = numbers[i]
                rare, times = np.unique(words.hashes[n[~common[start : start + len(n)]]], return_counts=True)
                start += len(n)
                row = (chunk << 16) + n_docs + i
                rows.append((row % buckets, row, doc_id, len(n), int(known[i]), logs[i], context[i], rare, times, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            taught = np.repeat(np.fromiter((t for _, t in values), bool, len(values)), lengths)
            keys.append(continuation_keys(words.hashes[last], c))
            events.append(np.where(index >= 0, index, RARE).astype(np.uint32))
            docs.append(((of + n_docs) * 2 + taught).astype(np.uint32))
            held, n_docs = held + len(now), n_docs + len(values)
        if keys:
            yield dealt()

    return run


def _continued(inside: np.ndarray):
    """Log probabilities of the words in their classes, from all continuations of a bucket;
    an array by document for each chunk. inside: of each frequent word the probability in its class."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("context", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("chunk", pa.int64()), ("data", pa.binary())])
    inside = np.append(inside, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 1):
            whole = table.filter(pa.compute.is_valid(table.column("row"))).select([f.name for f in schema])
            yield from whole.to_batches()
            sent = table.filter(pa.compute.is_null(table.column("row")))
            if not sent.num_rows:
                continue
            chunks, parts = sent.column("chunk").to_pylist(), [_unpacked(x.as_py()) for x in sent.column("data")]
            key, event, doc = (np.concatenate([p[i] for p in parts]) for i in range(3))
            ends = np.cumsum([len(p[0]) for p in parts])
            del parts, table, sent
            # sorted runs: by key, then by the key's number and the continuation
            order = np.argsort(key, kind="stable")
            at_key = np.empty(len(key), np.int64)
            at_key[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
            at_key <<= 21
            at_key |= event
            order = np.argsort(at_key)
            both = at_key[order]
            t = (doc[order] & 1).astype(np.float64)
            new_event = np.append(True, both[1:] != both[:-1])
            both = both[new_event]
            at_event, e, key_of = np.cumsum(new_event) - 1, both & (RARE * 2 - 1), both >> 21
            n_event = np.bincount(at_event, t)
            rare = e == RARE
            common = np.bincount(key_of, np.where(rare, 0, n_event))
            all_of = np.bincount(key_of, n_event)
            once = np.bincount(key_of, np.where(rare, n_event, n_event == 1))
            escape = np.where(common > 0, (once + ESCAPE[0]) / (all_of + sum(ESCAPE)), 1.0)
            left = np.where(common > 0, (1 - escape) / np.maximum(common, 1), 0)
            # of a rare word the escape alone; its probability in the class is added where its count is known
            p = escape[key_of] * inside[e] + np.where(rare, 0, n_event * left[key_of])
            log = np.empty(len(key), np.float32)
            log[order] = np.log10(p)[at_event]
            rows = [(chunk, np.bincount(doc[a:b] >> 1, log[a:b]).astype(np.float32).tobytes()) for chunk, a, b in zip(chunks, [0, *ends], ends)]
            cols = {"chunk": [c for c, _ in rows], "data": [x for _, x in rows]}
            yield pa.RecordBatch.from_arrays([pa.array(cols.get(f.name, [None] * len(rows)), f.type) for f in schema], schema=schema)

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in runs(batches, 1):
        parts = [np.frombuffer(x.as_py(), np.float32) for x in table.column("data")]
        total = np.zeros(max(map(len, parts)))
        for p in parts:
            total[: len(p)] += p
        rows = (table.column("chunk")[0].as_py() << 16) + np.arange(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(total)], ["row", "inside"])


def score(docs: DataFrame, rounds: int = ROUNDS, frequent_bound: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    if frequent_bound > FREQUENT:
        raise ValueError(f"at most {FREQUENT} words are known to all tasks")
    spark = docs.sparkSession
    text = text_of().cast("binary").alias("text")
    learned = docs.filter(crc_mod("doc_id", 5) != 1).select(text)
    counted = learned.mapInArrow(_count_words, "h long, c long, group int").groupBy("h", (F.col("group") < 0).alias("pair"))
    counted = written(counted.agg(F.sum("c").alias("c"), F.min("group").alias("group")), "vocabulary")
    vocabulary = counted.filter("not pair").select("h", "c", "group")
    near = np.zeros(GROUPS * GROUPS, np.int64)
    cells = counted.filter("pair").select("h", "c").toArrow()  # at most GROUPS squared
    near[cells.column("h").to_numpy()] = cells.column("c").to_numpy()
    classes = classes_of(near.reshape(GROUPS, GROUPS))
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in vocabulary.groupBy("group").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # at most GROUPS
        size[classes[r["group"]]] += r["n"]
        kinds[classes[r["group"]]] += r["v"]
    total, distinct = int(size.sum()), int(kinds.sum())
    common = vocabulary.filter(F.col("c") >= max(1, -(-total // frequent_bound))).toArrow()  # at most frequent_bound rows
    order = np.argsort(common.column("h").to_numpy())
    hashes, counts, groups = (common.column(c).to_numpy()[order] for c in ("h", "c", "group"))
    frequent = hashes, counts
    room = size + 0.5 * (kinds + 1)
    prior = (size + 0.5) / (size + 0.5).sum()
    weights, _ = train(learned, classes, frequent, prior, rounds)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = 2 * tasks
    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", 5) != 1).alias("taught"), text)
    parts = rows.mapInArrow(_score(classes, frequent, weights, np.log10(room), buckets), PART)
    inside = (counts + 0.5) / room[classes[groups]] if len(groups) else np.zeros(0)
    table = np.zeros(RARE) if not len(inside) else np.pad(inside, (0, RARE - len(inside)))
    passed = PART.replace("bucket int, ", "")
    scored = written(parts.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_continued(table), passed), "parts")
    parts = scored.filter("row is not null").drop("chunk", "data")
    continued = scored.filter("row is null").select("chunk", "data").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_by_document, "row long, inside double")
    pairs = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("row", F.col("p.rare").alias("h"), F.col("p.times").alias("k"))
    # each side by its own shuffle at every size: both grow with the documents
    met = pairs.join(vocabulary.select("h", "c").hint("merge"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = met.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    return parts.drop("rare", "times").join(rest, "row", "left").join(continued.hint("merge"), "row", "left").select(
        "doc_id",
        (crc_mod("doc_id", 5) == 1).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))).alias("base_score"),
        (F.col("context") + F.coalesce("inside", F.lit(0.0)) + more).alias("score"),
    )
