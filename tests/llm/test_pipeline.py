import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_ngram_join import brute as near


def fixture(path, spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    docs = []
    for i in range(60):
        docs.append([i, " ".join(word() for _ in range(60)), f"src{i % 3}"])
    docs += [[60 + i, docs[i][1].replace(" ", "  "), "src0"] for i in range(5)]
    docs += [[70 + i, docs[i][1] + " " + word(), "src1"] for i in range(4, 9)]
    docs += [[80, docs[20][1] + " you idiot", "src1"], [81, None, None], [82, "", "src0"], [83, "write to ann@x.org or +1 555 123 4567 now please", "src2"]]
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (80, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_against_brute_force(spark, tmp_path):
    docs = fixture(str(tmp_path), spark)
    kept = [d for d in docs if "idiot" not in (d[1] or "")]
    seen, single = set(), []
    for i, t, s in sorted(kept):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if key not in seen:
            seen.add(key)
            single.append((i, t, s))
    keep = {r[5] for r in near([(i, t) for i, t, _ in single])}
    final = {i: t for i, t, _ in single if i in keep}
    final[83] = "write to [EMAIL] or [PHONE] now please"
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in final.items()}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == want.keys()
    for i, ids in want.items():
        own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert sum(n for _, n, _ in own) == len(ids)
        assert all(c == zlib.crc32(np.array(ids[a : a + n], dtype="<u4").tobytes()) for a, n, c in own)


def test_stages_keep_columns(spark, tmp_path):
    fixture(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
