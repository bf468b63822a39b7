import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from weftline.llm import fingerprint


def nearness(a, b):
    words = lambda t: Counter(w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t.lower()).split(" ") if w)
    weight = lambda c: {w: n * min(31, len(w)) ** 2 for w, n in c.items()}
    x, y = weight(words(a)), weight(words(b))
    keys = x.keys() | y.keys()
    if not keys:
        return 1.0
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)


def made(n=120):
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeé𝒳") for _ in range(r.randint(1, 9))) for _ in range(60)]
    docs = [(i * 7 % 1009, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 80)))) for i in range(n)]
    return [*docs, (5000, None), (5001, ""), (5002, "same words here"), (5003, "same words here"), (None, "null id"), (-4, "x")]


def brute(docs):
    rows = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t in docs), reverse=True)
    out = {}
    for k, (_, t, i) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        out[i] = (len(t), t, t[: len(t) - third] + nxt[:third], nxt)
    return out


def test_against_brute_force(spark):
    docs = made()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_bucket", F.lit("x")).repartition(3)
    want = brute(docs)
    got = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    assert got.keys() == want.keys()
    errors, bias = [], []
    for i, (n, text, edited, nxt) in want.items():
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        for near, other in ((r.near_edited, edited), (r.near_next, nxt)):
            errors.append(abs(near - nearness(text, other)))
            bias.append(near - nearness(text, other))
    assert max(errors) < 0.45 and abs(sum(bias) / len(bias)) < 0.02 and sum(errors) / len(errors) < 0.08
    assert got[5002].fingerprint == got[5003].fingerprint and got[5000].fingerprint == got[5001].fingerprint
    plan = fingerprint.fingerprints(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_few_rows(spark):
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"a b c d a b").hexdigest()
    same = fingerprint.fingerprints(spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "doc_id long, text string")).collect()
    assert len(same) == 3
    assert fingerprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_an_id_that_repeats_is_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "HOT_LEAST", 20)
    docs = [(i, f"other {i} words") for i in range(40)] + [(17, f"many rows of one id {i % 150} {'x' * (i % 7)}") for i in range(300)] + [(None, f"null {i}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    buckets = {r[0]: r[1] for r in fingerprint._dealt(df).filter("not _guest and doc_id = 17").groupBy("_bucket").count().collect()}
    assert len(buckets) > 5 and sum(buckets.values()) == 301 and max(buckets.values()) < 100
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("m")).collect()
    rows.sort(key=lambda r: (-(1 << 63) if r.doc_id is None else r.doc_id, r.m), reverse=True)
    want = []
    for k, r in enumerate(rows):
        n, nxt = len(r.text), rows[(k + 1) % len(rows)].text
        want.append((r.doc_id is None, r.doc_id or 0, hashlib.sha256((r.text[: n - n // 3] + nxt[: n // 3]).encode()).hexdigest()))
    got = [(r.doc_id is None, r.doc_id or 0, r.edited_sha256) for r in fingerprint.fingerprints(df).collect()]
    assert sorted(got) == sorted(want)


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "some words " * 50_000), (2, "x" * 300_000), (3, "some words")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    assert got[1].n_chars == 550_000 and got[2].n_chars == 300_000 and len(got) == 3
