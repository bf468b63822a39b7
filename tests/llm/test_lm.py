import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import lm


def tokens(t):
    low = "".join(c.lower() if c.isascii() else c for c in t or "")
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w] + ["<end>"]


def brute(docs):
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    c = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for i, t in docs]


def made():
    r = random.Random(6)
    english, french = [f"{a}{b}ing" for a in "abcde" for b in "xyz"], [f"{a}{b}eux" for a in "fghij" for b in "uvw"]
    docs = [(i, " ".join(r.choice(english if i % 2 else french) for _ in range(r.randint(1, 60)))) for i in range(250)]
    return [*docs, (900, None), (901, ""), (902, "UNSEEN word É \x1f"), (902, "UNSEEN word É \x1f"), (None, "axing")]


def test_base_and_gain(spark):
    docs = made()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("x")).repartition(3)
    for bound in (1 << 20, 40):
        got = sorted((tuple(r) for r in lm.score(df, rounds=6, frequent_bound=bound).collect()), key=repr)
        want = sorted(brute(docs), key=repr)
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6, (g, w)
            assert math.isfinite(g[6]) and g[6] < 0
        held = [g for g in got if g[1]]
        assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_distribution_sums_to_one():
    r = np.random.default_rng(0)
    grid = np.arange(lm.CLASSES**2)
    p = lm.probabilities(r.normal(size=(lm.TABLE_ROWS, lm.CLASSES)), grid // lm.CLASSES, grid % lm.CLASSES)
    assert np.allclose(p.sum(1), 1)


def brute_score(docs, weights, classes):
    """log10 probabilities of texts by the definition, one token after the other."""
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    hashed = lambda w: lm.END_HASH if w == "<end>" else lm.word_hash(w.encode())
    class_of = lambda w: lm.END if w == "<end>" else int(classes[lm.group_of(w.encode())])
    texts = [(["<end>"] * 3 + tokens(t), held(i)) for i, t in docs]
    c = Counter(w for t, h in texts if not h for w in t[3:])
    size, kinds = Counter(), Counter()
    for w, n in c.items():
        size[class_of(w)] += n
        kinds[class_of(w)] += 1
    follow = {}
    for t, h in texts:
        for a, b in zip(t[2:], t[3:]):
            if not h:
                follow.setdefault((a, class_of(b)), Counter())[b] += 1
    feature = lambda w: np.array([hashed(w)]).view(np.uint64) if w in c else np.array([(lm.GROUPS - 1 if w == "<end>" else lm.group_of(w.encode())) + (1 << 20)], np.uint64)
    out = []
    for t, _ in texts:
        total = 0.0
        for x, y, z, w in zip(t, t[1:], t[2:], t[3:]):
            k = class_of(w)
            p = lm.probabilities(weights, feature(y), feature(z), feature(x))[0, k]
            q = (c[w] + 0.5) / (size[k] + 0.5 * (kinds[k] + 1))
            seen = follow.get((z, k), Counter())
            n, once = sum(seen.values()), sum(v == 1 for v in seen.values())
            escape = (once + lm.ESCAPE[0]) / (n + sum(lm.ESCAPE)) if n else 1.0
            total += math.log10(p) + math.log10(escape * q + (1 - escape) * (seen[w] / n if n else 0))
        out.append(total)
    return out


def test_score_against_brute_force(spark, monkeypatch):
    docs, kept = made(), {}
    train, cluster = lm.train, lm.classes_of
    monkeypatch.setattr(lm, "train", lambda *a, **k: kept.setdefault("train", train(*a, **k)))
    monkeypatch.setattr(lm, "classes_of", lambda *a, **k: kept.setdefault("classes", cluster(*a, **k)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.score(df, rounds=2).collect()}
    want = brute_score(docs, kept["train"][0], kept["classes"])
    for (i, t), w in zip(docs, want, strict=True):
        assert abs(got[i, len(tokens(t))] - w) < 1e-3 * max(1, abs(w)), (i, t)


def test_likelihood_never_falls_and_the_base_is_beaten(spark, monkeypatch):
    traces, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a, **k: traces.append(train(*a, **k)) or traces[-1])
    for d in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{d}/documents.parquet")
        got = {r.held_out: r for r in lm.score(df).groupBy("held_out").agg(F.sum("n_tokens").alias("n"), F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()}
        trace = traces.pop()[1]
        assert len(trace) == lm.ROUNDS + 1 and all(b >= a for a, b in zip(trace, trace[1:])) and trace[-1] > trace[0]
        assert all(r.s > r.b for r in got.values())
        assert (got[True].s - got[True].b) / got[True].n > 0.3


def test_long_text_clashing_names_and_few_words_at_once(spark, monkeypatch):
    long = "zork blim " * 300_000
    docs = [(0, long), (1, "zork blim zork"), (2, ""), (3, None), (7, long + "x")]
    plain = spark.createDataFrame(docs, "doc_id long, text string")
    clash = plain.select("*", *[F.lit("x").alias(c) for c in ("row", "h", "c", "block", "values", "chunk", "data", "taught", "score")])
    got = {r.doc_id: r for r in lm.score(clash, rounds=1).collect()}
    assert len(got) == 5
    for i, h, n, known, total, base in brute(docs):
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (h, n, known, total)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base))


def test_few_words_at_once():
    texts = [(i, (t or "").encode()) for i, t in made()]
    whole = {i: [w.hashes[x] for x in n] for w in [lm.Words()] for values, numbers in lm._gathered(w, iter(texts)) for i, n in zip(values, numbers)}
    w, lots = lm.Words(bound=20), 0
    for values, numbers in lm._gathered(w, iter(texts), tokens=50):
        lots += 1
        assert len(values) <= 50
        for i, n in zip(values, numbers, strict=True):
            assert w.hashes[n].tolist() == [int(x) for x in whole[i]] or i in (902, None)
    assert lots > 20


def test_continuations_travel_unchanged():
    r = np.random.default_rng(3)
    keys = np.sort(r.integers(0, 1 << 64, 1000, dtype=np.uint64))
    events, docs = r.integers(0, lm.RARE + 1, 1000).astype(np.uint32), r.integers(0, 1 << 17, 1000).astype(np.uint32)
    assert all((a == b).all() for a, b in zip(lm._unpacked(lm._packed(keys, events, docs)), (keys, events, docs), strict=True))


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), rounds=1).count() == 0
    only = lm.score(spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string"), rounds=1).collect()
    assert only and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in only)
