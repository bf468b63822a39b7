import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, World!", "", None, "naïve café's 12 <|endoftext|>x", "ΣΑΣ ümlaut ÄÖ nb́ sp", "can't  \t\n we'll 3.14 ... ab,cd", "İstanbul ẞ ﬁ 漢字 \x1f\x85 é", "Straße,, x* y%"]


def test_ids_are_the_tokenizers():
    whole, own = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    for t in [x or "" for x in TEXTS] + ["the lazy dog " * 5000]:
        assert np.frombuffer(own(t.encode()), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_plain_words_are_told_without_patterns(monkeypatch):
    """And every Latin-1 character is as in the tokenizer."""
    whole, own = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    words = [w for c in map(chr, range(1, 256)) for w in (c, f"Ab{c}d", f"{c}É,", f"x{c}?!", f",{c}z", f"ñ{c}漢")]
    for t in [" ".join(words), *words]:
        assert np.frombuffer(own(t.encode()), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids, t
    for name in ("PLAIN", "PLAIN_ASCII"):
        if hasattr(getattr(packing, name, None), "fullmatch"):
            monkeypatch.setattr(packing, name, None)
    t = "Plain, words. naïve cafés?! Straße ÀÉÎ;"
    assert np.frombuffer(packing.Encoder(PATH)(t.encode()), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_words_are_remembered_without_capitals_and_single_marks():
    whole, own = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    for t in ["One, two. ONE two, one. Two", "It's, 3, a.b. c , . d", "x.. y, z", "x!, y. z", "(x). y", "A, <|ENDOFTEXT|> <|endoftext|>, b", "\x1f, a. \x00. b, ", "don'T, I'LL. 'S, "]:
        assert np.frombuffer(own(t.encode()), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids, t
    own = packing.Encoder(PATH)
    own(b"One, two. ONE two, one. Two")
    assert sorted(own.words) == [b",", b".", b"one", b"two"]


def check(rows, docs, sequence=2048):
    whole = Tokenizer.from_file(PATH)
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in docs}
    assert {r.doc_id for r in rows} == set(ids)
    for i in ids:
        pieces = sorted((r.start, r) for r in rows if r.doc_id == i)
        at = 0
        for start, r in pieces:
            assert start == at and r.doc_tokens == len(ids[i]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][start : start + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s, pieces in seqs.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= sequence and (at == sequence or s == max(seqs))
    assert sorted(seqs) == list(range(len(seqs)))


@pytest.mark.parametrize("sequence,window,queues", [(16, 1, 256), (8, 4, 2), (2048, 64, 256), (4, 2, 256)])
def test_pieces(spark, sequence, window, queues):
    docs = [(i, (TEXTS[i % len(TEXTS)] or "") * (1 + i % 5) if i != 2 else None, f"s{i % 7 % 3 if i % 3 else 0}" if i % 11 else None) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    check(packing.pack(df, PATH, sequence, window, None, queues).collect(), docs, sequence)


def test_shares_and_empty(spark):
    docs = [(i, "word " * 40, "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    rows = packing.pack(df, PATH, 32, 2, {"a": 3, "b": 1}).collect()
    check(rows, docs, 32)
    first = [r for r in rows if r.window < 10]
    assert abs(sum(r.length for r in first if r.source == "=a") - 480) <= 1
    assert packing.pack(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, PATH, 32, 2, {"a": 1})


@pytest.mark.parametrize("shares", [None, {f"s{i}": 1 + i % 3 / 7 for i in range(9)}])
def test_many_sources_are_queues_of_their_own(spark, shares):
    docs = [(i, "word " * (1 + i % 13), f"s{i * i % 31 % 9}") for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5, "doc_id")
    shares = shares and {s: shares[s] for _, _, s in docs}
    few, many = (sorted(map(tuple, packing.pack(df, PATH, 16, 2, shares, bound).collect())) for bound in (256, 2))
    assert many == few and {r[7] for r in many} == {f"={s}" for _, _, s in docs}


def test_very_long_text_and_names_that_clash(spark):
    docs = [(1, "the lazy dog's naïve 12 cafés " * 40_000, "a"), (2, "x" * 3000, "b")]
    assert len(docs[0][1].encode()) > packing.BYTES_AT_ONCE
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as queue", "2 as ids", "3 as n", "4 as part", "5 as pos", "6 as window")
    check(packing.pack(df, PATH).collect(), docs)


def test_every_sequence_has_the_mixture(spark):
    """Within a quantum of what is owed."""
    docs = [(i, "word and more " * (10 + i % 50), f"s{min(i % 9, 4)}") for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    rows = packing.pack(df, PATH).collect()
    check(rows, docs)
    total, by = sum(r.length for r in rows), {}
    for r in rows:
        by.setdefault(r.source, {}).setdefault(r.sequence_id, 0)
        by[r.source][r.sequence_id] += r.length
    last = max(r.sequence_id for r in rows)
    for found in by.values():
        share, sent = sum(found.values()) / total, 0
        for k in range(last):
            sent += found.get(k, 0)
            assert abs(sent - share * 2048 * (k + 1)) <= 2048 / 8 * len(by)
