import hashlib
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import exact_dedup

LONG = "x y" * 500


def brute(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in docs:
        groups.setdefault(norm(t), []).append(i)
    return sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in docs)


@pytest.mark.parametrize("size", [4, 16, 16_384])
def test_against_brute_force(spark, size):
    texts = ["a  b", "a b", "a\n\tb ", " a b", "", None, "   ", "\x1f", LONG, LONG + "z", LONG.replace("x", "q"), "y" + LONG, "é" * 40, "é" * 39 + "e", "ab" * 8, "ab" * 9]
    docs = [(i, texts[i * 7 % len(texts)]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("name", F.lit(1)).repartition(5)
    rows = exact_dedup.exact_duplicates(df, size).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == brute(docs)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_hot_group_and_repeats(spark):
    docs = [(i, "same text") for i in range(300)] + [(7, "same text"), (0, "same text"), (None, "same text"), (None, "own"), (400, "own two"), (400, "own three")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = exact_dedup.exact_duplicates(df, 4).collect()
    assert len(rows) == len(docs) and {r.group_size for r in rows} == {303, 1}
    assert sum(r.kept for r in rows if r.group_size > 1) == 1 and {r.keep_id for r in rows if r.group_size > 1} == {0}
    out = exact_dedup.drop_exact(df.withColumn("_sha", F.lit("x")), 4)
    assert out.columns == ["doc_id", "text", "_sha"]
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text) for r in out.collect()) == [((False, 0), "same text"), ((False, 400), "own three"), ((False, 400), "own two"), ((True, 0), "own")]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert exact_dedup.exact_duplicates(none).count() == 0 == exact_dedup.drop_exact(none).count()
