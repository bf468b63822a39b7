import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from weftline.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts(n=150, seed=9):
    r = random.Random(seed)
    bits = ["the", " ", " ", "  ", "\n", "Straße", "été", "漢", "𝒳", "ing", "representations", "a", "1", ".", "....", "x" * 20, "\t", "ation", "Event", "́"]
    return ["", " ", "\n", " a", "a ", *["".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(n)], "nospaces" * 40, "x" * 300]


def library():
    """The library's unigram encoder with the same scores."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.trainer_spec.model_type = 1
    own = sp.pieces(PATH)
    for p in m.pieces:
        if p.piece in own.scores:
            p.score = own.scores[p.piece][0] / sp.SCALE
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_ids_are_the_librarys():
    own, lib = sp.Pieces(PATH), library()
    for t in texts():
        got = np.frombuffer(own.encode(sp.marked(t)), "<u2")
        assert got.tolist() == lib.encode(t), t
        assert own.decode(got) == t and lib.decode(got.tolist()) == t


def value(own, s, ids):
    by_id = {i: v for v, i in own.scores.values()}
    return sum(by_id.get(i, 0) for i in ids)


def test_chunks_and_states():
    own = sp.Pieces(PATH)
    for t in texts(60, 10):
        s = sp.marked(t)
        if not s:
            continue
        want, _ = own.best(s)
        for size in (1, 3, 7, 20, 1000):
            parts = [(s[a : a + size + own.longest - 1], min(size, len(s) - a)) for a in range(0, len(s), size)]
            ms = np.stack([own.matrix(*p) for p in parts])
            assert sp.prefixes(ms)[-1][0, 0] == want
            at = sp.states(ms)
            ids = b"".join(own.trace(*p, at[k], at[k + 1]) for k, p in enumerate(parts))
            assert at[0] == at[-1] == 0 and own.decode(np.frombuffer(ids, "<u2")) == t
            plain = np.frombuffer(own.encode(s), "<u2").tolist()
            assert value(own, s, np.frombuffer(ids, "<u2").tolist()) == value(own, s, plain)


def test_ids_are_the_same_for_every_size_of_chunks():
    own = sp.Pieces(PATH)
    r = random.Random(12)
    odd = ["".join(r.choice("aaabest.\U0001d4b3") for _ in range(r.randint(1, 90))) for _ in range(60)]
    for t in [*texts(60, 13), *odd]:
        s = sp.marked(t)
        for size in (1, 2, 3, 7, 20, 50, 301) if s else ():
            parts = [(s[a : a + size + own.longest - 1], min(size, len(s) - a)) for a in range(0, len(s), size)]
            ms, ranks = (np.stack(x) for x in zip(*(own.matrix_and_ranks(*p) for p in parts)))
            at = sp.states(ms, ranks)
            assert b"".join(own.trace(*p, at[k], at[k + 1]) for k, p in enumerate(parts)) == own.encode(s), (t, size)


def test_ids_of_the_tables_texts_do_not_depend_on_chunks(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = {r.doc_id: bytes(r.ids) for r in sp.encode(df, PATH).collect()}
    for chunk in (50, 301):
        assert {r.doc_id: bytes(r.ids) for r in sp.encode(df, PATH, giant=chunk, chunk=chunk).collect()} == plain


def test_round_trip(spark):
    docs = [(i, t) for i, t in enumerate(texts(40))] + [(900, None), (None, "null id"), (5, "again"), (5, "again"), (901, "word and " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(3)
    plain = sorted((tuple(r) for r in sp.round_trip(df, PATH).drop("chunks").collect()), key=repr)
    assert len(plain) == len(docs) and all(r[-1] for r in plain)
    small = sp.round_trip(df, PATH, giant=50, chunk=16).collect()
    assert all(r.round_trip for r in small) and max(r.chunks for r in small) > 1000
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in small) == sorted((r[0] is None, r[0] or 0, r[1]) for r in plain)
    assert sp.round_trip(df.limit(0), PATH).count() == 0
