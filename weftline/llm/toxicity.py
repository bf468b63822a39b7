"""Toxicity by Levenshtein automata over a lexicon trie, with scores of the context.

The lexicon (words, and stems that any ending may follow) holds a few seeds and what
labelled rows teach: terms whose counts in toxic and clean documents differ by more than
chance among so many terms would give. It is a trie; the automata of all its words are
run on it at once, as sets of (node, edits) whose moves are determined when first
needed, so that a token costs one look-up for each letter. Words of five letters may
be one edit off, of nine two, the first letter included; so may the beginning that is held
against a stem.

Each hit is weighed by its window: inside quotation marks or near words of reporting it
is a quotation, near words of address it is abuse. A quotation runs from an opening mark to
the first closing mark of its kind in the same sentence; a mark without the other (an
apostrophe, an inch) opens nothing. A logistic regression over the
document's hits gives the score; its prior holds quotations at half the weight of plain
hits where the labels tell nothing about them.

Labels are read from at most FIT_ROWS ids, those of the least hashes; an id that repeats
counts as toxic if any of its labels does, and its least text stands for it. Rows held out are never
among them. All that is learned from these is bounded by them.

Defined results: null text counts as empty; an empty text has the score of no hits.
A very long text is scored whole, in one pass over its words. Repeated rows are scored alike. Without labels of both kinds the seeds and the prior
remain. A null id has the remainder of the empty text. Other columns are not read."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Memo, crc_mod, give_back, text_of, written

#: So many labelled rows are fitted at most.
FIT_ROWS = 20_000
WINDOW = 6
SEEDS = ("idiot", "moron", "stupid", "trash", "loser", "pathetic", "scum", "worthless", "clown", "disgusting")
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes word words term reported tweeted claimed dit dijo sagte schrieb palabra wort mot".split())
ADDRESS = frozenset("you your you're youre yourself u ur du dich dein tu te toi vous tú usted eres".split())
LEET = str.maketrans("013457@$", "oieastas")
#: Opening marks, and what closes each.
CLOSING = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "'": "'’", "‘": "’"}
MARKS = re.compile("[\"“”„«»'‘’]")
OPENS = re.compile("[(\\[{*]*([\"“„«»'‘])(?=[\\w@$*])")
CLOSES = re.compile("[\\w.,;:!?*%$@)-]([\"“”«»'’])[.,;:!?)\\]}*…-]*$")
SENTENCE = re.compile("[.!?…][\"“”«»'’)\\]}*]*$")
PIECES = re.compile(r"[^\W_]+")
#: From where letters begin, so that no long word takes more than linear time.
OBSCURED = re.compile(r"(?<![^\W\d_])[^\W\d_]*+[@$0-9][\w@$]*")
STEM_LENGTHS = (4, 5, 6, 7)
#: Nats by which a term must beat chance, by documents and by places.
MARGINS = (-1.0, 3.0)

FEATURES = ("plain", "inexact", "quoted", "addressed", "density")
PRIOR = np.array([6.0, 5.0, 2.0, 1.0, 0.0])
PRIOR_BIAS = -3.0


def edits_for(length: int) -> int:
    return 2 if length >= 9 else 1 if length >= 5 else 0


class Automaton:
    """The trie of a lexicon {(term, is_stem): weight}, met with the Levenshtein
    automata of its words; match(token) is (term, edits) or None."""

    def __init__(self, terms: list[tuple[str, bool]], bound: int = 50_000):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.allowed = [0]
        self.bound = bound
        for term, is_stem in terms:
            node, k = 0, edits_for(len(term))
            for ch in term:
                self.allowed[node] = max(self.allowed[node], k)
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.allowed.append(0)
                node = self.children[node][ch]
            self.allowed[node] = max(self.allowed[node], k)
            (self.stem if is_stem else self.word)[node] = term
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.ends: list[tuple[str, int] | None] = []
        self.stems: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, positions: set[tuple[int, int]]) -> int:
        closed, todo = set(), list(positions)
        while todo:  # a missing letter is a step down without reading one
            node, e = todo.pop()
            if (node, e) in closed or e > self.allowed[node]:
                continue
            closed.add((node, e))
            todo += [(c, e + 1) for c in self.children[node].values()]
        best: dict[int, int] = {}
        for node, e in closed:
            best[node] = min(e, best.get(node, e))
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = sorted((e, self.word[n]) for n, e in key if self.word[n] and e <= edits_for(len(self.word[n])))
            self.ends.append((ends[0][1], ends[0][0]) if ends else None)
            stems = sorted((e, -len(self.stem[n]), self.stem[n]) for n, e in key if self.stem[n] and e <= edits_for(len(self.stem[n])))
            self.stems.append((stems[0][2], stems[0][0]) if stems else None)
        return self.ids[key]

    def _move(self, state: int, ch: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            for c, child in self.children[node].items():
                out.add((child, e + (c != ch)))
            out.add((node, e + 1))
        return self._state(out)

    def match(self, token: str) -> tuple[str, int] | None:
        if len(self.sets) > self.bound:
            self._reset()
        state, stem = self.start, None
        for ch in token:
            moves = self.moves[state]
            if ch not in moves:
                moves[ch] = self._move(state, ch)
            state = moves[ch]
            met = self.stems[state]
            if met and (not stem or met[1] <= stem[1]):
                stem = met
            if not self.sets[state]:
                return stem
        end = self.ends[state]
        return end if end and (not stem or end[1] <= stem[1]) else stem


def quotations(words: list[str]) -> set[int]:
    """The places of the words inside quotations."""
    inside: set[int] = set()
    at, closing = None, ""
    for i, w in enumerate(words):
        if MARKS.search(w):
            opens, closes = OPENS.match(w), CLOSES.search(w)
            if closes and at is not None and closes[1] in closing:
                inside.update(range(at, i + 1))
                at = None
            elif opens:
                at, closing = i, CLOSING[opens[1]]
                if closes and closes[1] in closing:
                    inside.add(i)
                    at = None
        if SENTENCE.search(w):
            at = None
    return inside


class Scorer:
    """The features of texts under one lexicon."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.automaton = Automaton(terms)
        self.seen = Memo(self._hits, 100_000)

    def _hits(self, raw: bytes) -> tuple:
        """(edits, ...) of the hits in a token that white space bounds."""
        word = raw.decode().lower()
        found = [m for p in PIECES.findall(word) if (m := self.automaton.match(p))]
        if not found:
            found = [(m[0], max(1, m[1])) for p in OBSCURED.findall(word) if (m := self.automaton.match(p.translate(LEET)))]
        return tuple(e for _, e in found)

    def features(self, text: bytes) -> list[float] | None:
        """None: no hits."""
        words = text.lower().split()
        hits = list(map(self.seen.__getitem__, words))
        if not any(hits):
            return None
        plain = inexact = quoted = addressed = 0.0
        inside = quotations([w.decode() for w in words])
        for i, h in enumerate(hits):
            if not h:
                continue
            near = [w.decode().strip(".,;:!?()'\"“”„«»") for w in words[max(0, i - WINDOW) : i + WINDOW + 1]]
            told = i in inside or bool(REPORTING.intersection(near))
            for e in h:
                if told:
                    quoted += 1
                elif e:
                    inexact += 1
                else:
                    plain += 1
                addressed += bool(ADDRESS.intersection(near)) and not told
        total = plain + inexact + quoted
        return [math.log1p(plain), math.log1p(inexact), math.log1p(quoted), math.log1p(addressed), min(1.0, total / len(words) * 10)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that have a term, by task: words, and beginnings of words."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def out() -> pa.RecordBatch:
        terms = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array([t[0] for t in terms], pa.string()), pa.array([t[1] for t in terms], pa.bool_()), *[pa.array([counts[y][t] for t in terms], pa.int64()) for y in (1, 0)]], ["term", "is_stem", "pos", "neg"]
        )

    for batch in batches:
        give_back("toxicity")
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = {p for w in set(text.as_py().encode().lower().split()) for p in PIECES.findall(w.decode().lower())}
            counts[toxic].update((w, False) for w in words)
            counts[toxic].update({(w[:n], True) for w in words for n in STEM_LENGTHS if len(w) > n})
            if len(counts[0]) + len(counts[1]) > 100_000:
                yield out()
                counts = {0: Counter(), 1: Counter()}
    if counts[0] or counts[1]:
        yield out()


def _places(terms: list[tuple[str, bool]]):
    """Where the terms stand: label, and the words before and after as a hash."""
    known = set(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = [w.decode().lower() for w in text.as_py().encode().lower().split()]
                for i, w in enumerate(words):
                    for p in PIECES.findall(w):
                        for t in [(p, False), *[(p[:n], True) for n in STEM_LENGTHS if len(p) > n]]:
                            if t in known:
                                found.add((*t, toxic, xxhash.xxh3_64_intdigest(" ".join(words[max(0, i - 1) : i] + words[i + 1 : i + 2])) >> 1))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.bool_(), pa.int32(), pa.int64()), strict=True)], ["term", "is_stem", "toxic", "place"])

    return run


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With the least hash of five words in a row: near copies mostly have the same."""
    for batch in batches:
        out = []
        for text in batch.column(0):
            words = text.as_py().encode().lower().split()
            out.append(min((xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 5])) >> 1 for i in range(max(1, len(words) - 4))), default=0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], ["text", "toxic", "sketch"])


def telling(pos: float, neg: float, base: float) -> float:
    """Log-likelihood ratio of a term's counts against the share of toxic rows."""
    n = pos + neg
    return sum(x * math.log(x / (n * share)) for x, share in ((pos, base), (neg, 1 - base)) if x)


def lexicon(labelled: DataFrame) -> list[tuple[str, bool]]:
    """Seeds and learned terms of labelled (text, toxic). A term must tell more than the
    likeliest of all terms as frequent would by chance, both by documents (one of each
    group of copies) and by the places where it stands."""
    seeds = [(s, False) for s in SEEDS]
    single = written(labelled.mapInArrow(_sketched, "text string, toxic int, sketch long").dropDuplicates(["sketch", "toxic"]).select("text", "toxic"), "single")
    sizes = {r["toxic"]: r["n"] for r in single.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return seeds
    base = toxic / (toxic + clean)
    counts = single.mapInArrow(_count, "term string, is_stem boolean, pos long, neg long").groupBy("term", "is_stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = written(counts.filter("pos + neg > 1").withColumn("n", F.col("pos") + F.col("neg")), "terms")
    frequent = {r["n"]: r["terms"] for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("terms")).collect()}  # at most as many as rows
    above, at_least = 0, {}
    for n in sorted(frequent, reverse=True):
        above += frequent[n]
        at_least[n] = above
    llr = F.col("pos") * F.ln(F.col("pos") / (F.col("n") * base)) + F.when(F.col("neg") > 0, F.col("neg") * F.ln(F.col("neg") / (F.col("n") * (1 - base)))).otherwise(0.0)
    precise = F.col("pos") >= F.col("n") * max(0.5, 2 * base / (1 + base))
    chance = labelled.sparkSession.createDataFrame([(n, math.log(k) + MARGINS[0]) for n, k in at_least.items()], "n long, chance double")
    # no more of them than terms in the fitted rows
    likely = counts.filter((F.col("pos") > 2) & precise).withColumn("llr", llr).filter("llr > 4").join(F.broadcast(chance), "n").filter("llr >= chance").collect()
    told = {(r["term"], r["is_stem"]): r["n"] for r in likely}
    if not told:
        return seeds
    places = single.mapInArrow(_places(sorted(told)), "term string, is_stem boolean, toxic int, place long").distinct()
    at = places.groupBy("term", "is_stem").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).collect()
    found = [r for r in at if telling(r["pos"], r["neg"], base) >= math.log(at_least[told[r["term"], r["is_stem"]]]) + MARGINS[1]]
    words = {r["term"]: r["pos"] for r in found if not r["is_stem"]}
    stems: dict[str, int] = {}
    for r in sorted((r for r in found if r["is_stem"]), key=lambda r: (-len(r["term"]), r["term"])):
        stem, n = r["term"], r["pos"]
        # one word makes up most of it, or a longer stem does
        if any(w.startswith(stem) and p >= 0.8 * n for w, p in words.items()) or any(s.startswith(stem) and p >= 0.8 * n for s, p in stems.items()):
            continue
        for s in [s for s in stems if s.startswith(stem)]:
            del stems[s]
        stems[stem] = n
    # words stay beside the stems they begin with: they have edits of their own
    return sorted(set(seeds) | {(w, False) for w in words} | {(s, True) for s in stems})


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, held to the prior; the bias is last."""
    design = np.hstack([x, np.ones((len(x), 1))])
    mean, strength = np.append(PRIOR, PRIOR_BIAS), np.append(np.full(len(PRIOR), 1.0), 0.01)
    w = mean.copy()

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (strength * (w - mean) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + strength * (w - mean)
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag(strength), grad)
        size = 1.0
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w, before, now = w - size * step, now, loss(w - size * step)
        if before - now < 1e-9:
            break
    return w


def _features(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms)
        for batch in batches:
            rows = [scorer.features(t.as_py().encode()) or [0.0] * len(FEATURES) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    return run


def _score(terms, weights: list[float]):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("hits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, w = Scorer(terms), np.array(weights)
        for batch in batches:
            give_back("toxicity")
            found = [scorer.features(t.as_py().encode()) for t in batch.column(1)]
            x = np.array([f or [0.0] * len(FEATURES) for f in found]).reshape(len(found), len(FEATURES))
            scores = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array([int(f is not None) for f in found], pa.int64())], schema=schema)

    return run


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[tuple[str, bool]], list[float]]:
    """The lexicon and the weights, from labelled rows that are not held out."""
    known = labels.filter("toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = written(known.filter(crc_mod("_id", 5) != 0).orderBy(F.xxhash64(F.lit(5), "_id"), "_id").limit(fit_rows), "known")
    # at most fit_rows pairs of numbers go to all tasks, and one text of each comes back
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), text_of().alias("text"))
    met = texts.join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    labelled = written(met.groupBy("_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "labelled")
    terms = lexicon(labelled)
    rows = labelled.mapInArrow(_features(terms), "x array<double>, toxic int").collect()  # fit_rows at most
    if not rows:
        return terms, [*PRIOR.tolist(), PRIOR_BIAS]
    return terms, fit(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows])).tolist()


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    terms, weights = train(docs, labels, fit_rows)
    found = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_score(terms, weights), "doc_id long, score double, hits long")
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs without the rows that are scored toxic."""
    terms, weights = train(docs, labels, fit_rows)
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, w = Scorer(terms), np.array(weights)
        for batch in batches:
            give_back("toxicity")
            keep = [(f is None and w[-1] < 0) or float(np.array(f or [0.0] * len(FEATURES)) @ w[:-1] + w[-1]) < 0 for f in (scorer.features((t.as_py() or "").encode()) for t in batch.column(at))]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
