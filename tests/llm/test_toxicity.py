import random

from pyspark.sql import functions as F

from weftline.llm import toxicity


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    terms = ["idiot", "moron", "scum", "worthless", "disgusting", "idiom"]
    own = toxicity.Automaton([(t, False) for t in terms])
    r = random.Random(1)
    for _ in range(4000):
        t = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(1, len(t) + 1)
            t[i : i + r.randint(0, 1)] = r.choice(["", "x", "o", "t"])
        token = "".join(t)
        want = min(((edit(token, w), w) for w in terms if w[0] == token[:1] and edit(token[1:], w[1:]) <= toxicity.edits_for(len(w))), default=None)
        got = own.match(token)
        if want is None:
            assert got is None, token
        else:
            assert got is not None and got[1] == min(edit(token[1:], w[1:]) for w in terms if w[0] == token[:1]), token


def test_stems_quotes_and_context():
    s = toxicity.Scorer([("idiot", False), ("lowei", True)])
    f = lambda t: s.features(t.encode())
    assert f("nothing here") is None and f("") is None
    assert f("a loweischaft b")[0] > 0 and f("Idiot!")[0] > 0 and f("x,IDIOT,y")[0] > 0
    assert f("what an id10t")[1] > 0 and f("an idoit and an idiott")[1] > 0
    assert f('he was "such an idiot" to them')[:3][2] > 0 and f('he was "such an idiot" to them')[0] == 0
    assert f("you idiot")[3] > 0 and f("the idiot")[3] == 0


def test_learns_and_holds_out(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [word() for _ in range(30)]
        if bad:
            words[3] = "zork" + r.choice(["en", "ing", "est"]) if i % 8 else "blarg"
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(bad)))
    docs += [(1000, None, "x"), (1001, "", "x"), (1001, "", "x"), (None, "zorkest", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(d, y).collect()
    assert len(got) == len(docs)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    assert all(0 <= r.score < 0.5 for r in got if r.doc_id in (1000, 1001))
    kept = toxicity.keep_clean(d, y)
    assert kept.columns == d.columns and kept.count() == 303
    assert toxicity.score(d.limit(0), y.limit(0)).count() == 0
    assert toxicity.score(spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string"), y.limit(0)).orderBy("doc_id").select("predicted").collect() == [(1,), (0,)]
    assert d.filter(F.col("text").isNull()).count() == 1


def test_edits_of_first_letters_and_stems():
    terms = [("idiot", False), ("disgusting", False), ("zork", True), ("lowei", True)]
    own = toxicity.Automaton(terms)
    r = random.Random(3)
    for _ in range(4000):
        t = list(r.choice(terms)[0] + r.choice(["", "xen", "o"]))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(t) + 1)
            t[i : i + r.randint(0, 1)] = r.choice(["", "x", "o", "z"])
        token = "".join(t)
        far = {w: min(edit(token[:n], w) for n in range(len(token) + 1)) if stem else edit(token, w) for w, stem in terms}
        want = min((e for w, e in far.items() if e <= toxicity.edits_for(len(w))), default=None)
        got = own.match(token)
        assert (got and got[1]) == want and (got is None or far[got[0]] == want), token


def test_misspelt_words_of_learned_stems(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
        if i % 4 == 0:
            words[3] = "zork" + ["en", "ing", "est"][i // 4 % 3]
        rows.append((" ".join(words), int(i % 4 == 0)))
    terms = toxicity.lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    own = toxicity.Automaton(terms)
    assert ("zork", True) in terms
    assert all(own.match(w)[1] == 0 for w in ("zorken", "zorking", "zorkest", "zorkish"))
    assert all(own.match(w)[1] == 1 for w in ("zokest", "zirken", "xorking"))


def test_stray_marks_and_apostrophes():
    s = toxicity.Scorer([("idiot", False)])
    f = lambda t: s.features(t.encode())
    plain = f("ok fine good nice well then so you are an idiot")
    for stray in ('the 5" pipe burst ok. ', 'the 5" pipe burst ok ', "'tis ok fine ", "the dogs' bowl ", '"never closed ok. ', "don't rock 'n roll ", "« ok ", "it’s ‘ "):
        got = f(f"{stray}fine good nice well then so you are an idiot fine good")
        assert got[0] == plain[0] and got[2] == 0 and got[3] == plain[3], stray
    for quoted in ('"you are an idiot" ok', "“an idiot”, fine", "„ein idiot“ ja", "«un idiot» oui", "'an idiot.' ok", "(“idiot”) ok", '*"an idiot!"* ok', "‘such an idiot’ ok"):
        got = f(f"the man went home and {quoted}")
        assert got[0] == 0 and got[2] > 0, quoted
    assert f('"fine. you idiot. fine" ok')[0] > 0


def brute_features(text, terms):
    """Of one-word terms, by edit distances, word by word."""
    import math
    import re

    words = (text or "").encode().lower().split()
    words = [w.decode() for w in words]
    inside = toxicity.quotations(words)
    n = dict.fromkeys(("plain", "inexact", "quoted", "addressed"), 0)
    for i, w in enumerate(words):
        found = []
        for p in re.findall(r"[^\W_]+", w.lower()):
            e = min((edit(p, t) for t in terms if edit(p, t) <= toxicity.edits_for(len(t))), default=None)
            found += [] if e is None else [e]
        if not found:
            for p in re.findall(r"[^\W_]*[@$0-9][\w@$]*", w.lower()):
                p = p.translate(str.maketrans("013457@$", "oieastas"))
                e = min((edit(p, t) for t in terms if edit(p, t) <= toxicity.edits_for(len(t))), default=None)
                found += [] if e is None else [max(1, e)]
        near = {x.strip(".,;:!?()'\"“”„«»") for x in words[max(0, i - 6) : i + 7]}
        told = i in inside or bool(near & toxicity.REPORTING)
        for e in found:
            n["quoted" if told else "inexact" if e else "plain"] += 1
            n["addressed"] += bool(near & toxicity.ADDRESS) and not told
    total = n["plain"] + n["inexact"] + n["quoted"]
    return [math.log1p(n[k]) for k in ("plain", "inexact", "quoted", "addressed")] + [min(1.0, total / len(words) * 10)] if total else None


def test_features_of_whole_texts_against_brute_force():
    terms = ["idiot", "moron", "worthless", "scum"]
    s, r = toxicity.Scorer([(t, False) for t in terms]), random.Random(5)
    bits = ["idiot", "Idoit,", "m0ron", "worthles", "scum.", '"scum"', "you", "said", "fine", "day", "é", "'tis", '5"', '"so', 'yes"', "end.", "id10t!", "x_idiot_y", "WORTHLESS", "wortless"]
    for n in [*range(0, 40)] * 3 + [4000]:
        t = " ".join(r.choice(bits) if r.random() < 0.4 else r.choice(["fine", "day", "so", "then", "le"]) for _ in range(n))
        got, want = s.features(t.encode()), brute_features(t, terms)
        assert (got is None) == (want is None) and (got is None or all(abs(a - b) < 1e-12 for a, b in zip(got, want, strict=True))), t


def test_terms_of_any_length_are_learned(spark):
    r = random.Random(4)
    told = ["q", "zz", "longword" * 7]
    rows = []
    for i in range(600):
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(20)]
        if i % 4 == 0:
            words[r.randrange(20)] = told[i // 4 % 3]
        rows.append((" ".join(words), int(i % 4 == 0)))
    terms = toxicity.lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert {(t, False) for t in told} <= set(terms)


def test_repeated_ids_and_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "you idiot", "k")] * 50 + [(2, "fine", "k")] * 50, "doc_id long, text string, toxic string").selectExpr("*", "1 as _id", "2 as _doc", "3 as score", "4 as term")
    labels = spark.createDataFrame([(1, 1, 1)] * 60 + [(1, 1, 0), (2, 0, 0)] + [(2, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels, fit_rows=3).groupBy("doc_id", "predicted").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, 50), (2, 0, 50)]
    long = spark.createDataFrame([(1, "fine day " * 200_000 + "you idiot"), (2, "x" * 500_000)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(long, labels.limit(0)).collect()}
    assert 0 < scores[2] < scores[1] < 1
