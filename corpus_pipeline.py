"""The corpus pipeline: documents that are clean, single, free of personal data, packed.

Each stage takes what its predecessor kept, whole, as written to Parquet and read again.
Nulls, empty texts, repeated rows and empty tables are as each operator defines them."""

import public_tokenizers

from weftline.llm import exact_dedup, ngram_join, packing, pii, toxicity
from weftline.llm.common import written

#: Packing and the near-duplicate search go beyond what SQL can say.
ORACLE_SQL = None


def clean(spark, docs, sf_dir):
    """Without documents scored toxic."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def single(spark, docs, sf_dir):
    """Without all but the first of equal texts."""
    return exact_dedup.drop_exact(docs)


def distinct(spark, docs, sf_dir):
    """Without all but the first of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def private(spark, docs, sf_dir):
    """Personal data and the terms that give it away replaced or removed."""
    return pii.sanitise(docs)


def packed(spark, docs, sf_dir):
    """Pieces of sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", clean), ("exact dedup", single), ("n-gram Jaccard join", distinct), ("PII", private), ("packing", packed)]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
