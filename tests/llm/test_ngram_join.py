import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import ngram_join


def grams(t):
    w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, threshold=0.8):
    sets = {}
    for i, t in docs:
        sets.setdefault(" ".join("".join(c.lower() if c.isascii() else c for c in t or "").split()), []).append(i)
    keys = sorted(sets)
    g = {k: grams(k) for k in keys}
    links = {k: [] for k in keys}
    for x in range(len(keys)):
        for y in range(x):
            a, b = g[keys[x]], g[keys[y]]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-12:
                links[keys[x]].append(keys[y])
                links[keys[y]].append(keys[x])
    cluster = {}
    for k in keys:
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        cluster[k] = min(min(sets[m]) for m in seen)
    return sorted((i, min(sets[k]), len(sets[k]), len(links[k]), sum(len(sets[m]) for m in links[k]) + len(sets[k]) - 1, cluster[k]) for k in keys for i in sets[k])


def made(n=140, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(30, 120))] for _ in range(8)]
    docs = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        docs.append((i, " ".join(words)))
    docs += [(n, None), (n + 1, ""), (n + 2, "One two"), (n + 3, "one  TWO"), (n + 4, "one two three"), (n + 5, docs[0][1].upper()), (n + 5, docs[0][1].upper())]
    return docs


@pytest.mark.parametrize("block", [256, 7])
def test_against_brute_force(spark, block):
    docs = made()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)).repartition(3)
    got = sorted(tuple(r) for r in ngram_join.similar(df, block=block).collect())
    assert got == brute(docs)


def test_pruning_bounds():
    for n, m in ngram_join.least_matches(0.8, 1e-9, 160, 20):
        assert 0 <= m < 0.8 * n


def test_one_of_each(spark):
    docs = made(40)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("comp", F.lit("x"))
    out = ngram_join.one_of_each(df)
    assert out.columns == ["doc_id", "text", "comp"]
    assert sorted(r.doc_id for r in out.collect()) == sorted({r[5] for r in brute(docs)})
    assert ngram_join.similar(df.limit(0)).count() == 0


def test_order_of_keys(spark):
    ids = [None, 0, 1, -1, 2**63 - 1, -(2**63), 255, 256, -256]
    df = spark.createDataFrame([(i,) for i in ids], "i long").select("i", ngram_join._first("i").alias("k")).select("i", "k", ngram_join._class_of("k").alias("j"))
    rows = sorted(df.collect(), key=lambda r: bytes(r.k))
    assert [r.i for r in rows] == [*sorted(i for i in ids if i is not None), None] and all(r.i == r.j and len(r.k) == 9 for r in rows)


def test_very_long_texts(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(10**6)}" for _ in range(ngram_join.CHUNK + 5000)]
    near = list(words)
    for i in range(0, len(near), 400):
        near[i] = "changed"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "x" * 400_000)], "doc_id long, text string")
    got = {x.doc_id: (x.n_links, x.cluster_id) for x in ngram_join.similar(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_rows_dealt_grow_with_a_group_of_near_copies(spark, monkeypatch):
    """Not with its square."""
    meetings, dealt = ngram_join._meetings, []

    def counted(members, group, *args):
        out = meetings(members, group, *args)
        if group == "band":
            dealt.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_meetings", counted)
    r, rows = random.Random(5), {}
    base = [f"w{r.randrange(300)}" for _ in range(150)]
    for n in (100, 400):
        docs = []
        for i in range(n):
            words = list(base)
            words[r.randrange(len(words))] = f"x{i}"
            docs.append((i, " ".join(words)))
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        dealt.clear()
        got = ngram_join.similar(df, block=10).collect()
        assert all((x.n_links, x.cluster_id) == (n - 1, 0) for x in got) and len(got) == n
        rows[n] = sum(dealt)
    assert rows[400] <= 32 * 2 * 400, rows


def test_hot_bands_of_several_clusters(spark):
    """Texts of one template, some of them near copies of each other."""
    r = random.Random(11)
    template = [f"t{i}" for i in range(60)]
    docs = []
    for c in range(40):
        own = [f"c{c}x{r.randrange(10**6)}" for _ in range(14 + c % 9)]
        for k in range(1 if c % 3 else 4):
            words = template[: 25 + c % 4] + own + template[25 + c % 4 :]
            if k:
                words[r.randrange(len(words))] = f"e{c}{k}"
            docs.append((len(docs), " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for block in (5, 30):
        assert sorted(tuple(x) for x in ngram_join.similar(df, block=block).collect()) == brute(docs)
