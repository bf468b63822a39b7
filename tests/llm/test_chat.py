import random

from pyspark.sql import functions as F

from weftline.llm import chat


def whole(rows, conv, who):
    """The rendering and its learned spans, put together from segments."""
    own = sorted((r for r in rows if r.conv_id == conv and r.participant == who), key=lambda r: r.segment_id)
    text, spans, turns = "", [], 0
    for i, r in enumerate(own):
        assert r.segment_id == i and r.char_start == len(text) and r.turn_start == turns
        assert r.mask_chars == sum(s["end"] - s["start"] for s in r.spans)
        spans += [(len(text) + s["start"], len(text) + s["end"]) for s in r.spans]
        text += r.text
        turns += r.n_turns
    return text, spans, turns


def brute(turns, who):
    text, spans = "", []
    for role, body in turns:
        body = (body or "").replace("<|", "< |")
        text += f"<|{role if role == 'system' else 'assistant' if role == who else 'user:' + role}|>\n"
        start = len(text)
        text += body + "<|end|>\n"
        if role == who:
            spans.append((start, len(text)))
    return text, spans


def test_rotation(spark):
    r = random.Random(8)
    data = {c: [(t, r.choice(["system", "ann", "bob", "cy"]), r.choice(["hi", "", None, "é𝒳 <|end|> x", "long " * 50])) for t in range(r.randint(1, 40))] for c in range(12)}
    rows = [(c, t, role, text) for c, ts in data.items() for t, role, text in ts]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit(1)).repartition(3)
    for segment in (64, 5):
        got = chat.rotate(df, segment=segment).collect()
        assert {(x.conv_id, x.participant) for x in got} == {(c, role) for c, _, role, _ in rows if role != "system"}
        for c, who in {(x.conv_id, x.participant) for x in got}:
            want = brute([(role, text) for _, role, text in data[c]], who)
            assert whole(got, c, who) == (*want, len(data[c]))
    plan = chat.rotate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_crowded_and_odd_rows(spark):
    rows = [(1, 0, "ann", f"t{i}") for i in range(500)] + [(1, 1, "bob", "end"), (1, None, "bob", "later"), (1, 1, "bob", "end"), (None, 3, None, "x"), (2, 0, "system", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.rotate(df, segment=16).collect()
    assert max(r.n_turns for r in got) <= 64
    text, spans, turns = whole(got, 1, "bob")
    assert turns == 502 and text.endswith("<|assistant|>\nend<|end|>\n<|assistant|>\nlater<|end|>\n") and len(spans) == 2
    assert sum(r.n_rows for r in got if r.participant == "bob") == 503
    assert whole(got, None, "unknown")[0] == "<|assistant|>\nx<|end|>\n"
    assert not [r for r in got if r.conv_id == 2]
    assert chat.rotate(df.limit(0)).count() == 0


def test_very_long_turns_and_names_that_clash(spark):
    long = "word <|end|> é" * 40_000
    rows = [(1, 0, "ann", long), (1, 1, "bob", "x" * 500_000), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as participant", "2 as bucket", "3 as spans", "4 as _c", "5 as parts", "6 as salt")
    got = chat.rotate(df).collect()
    for who in ("ann", "bob"):
        text, spans, _ = whole(got, 1, who)
        assert (text, spans) == brute([(r, t) for c, _, r, t in rows if c == 1], who)
    assert [r.participant for r in got if r.conv_id == 2] == ["unknown"]
