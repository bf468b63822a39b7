r"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker
as the assistant and the others as users under their names; turns of context roles
(system) are context to all. A mask marks what is learned: the participant's own turns.

A turn is rendered as <|role|> or <|user:name|>, a line end, the text and <|end|> with
another. Special marks within texts are broken up, so that no text can forge a turn. A
rendering is cut into segments of about so many turns, each a row with its place in the
whole (turns and characters before it): a conversation that holds a third of all rows is
never in one row or one task. Segments are ranges of turn numbers; a range with more
rows than that is cut by turn number, and a turn number with more by ranges of a hash.
Their places are sums over two numbers a segment.

Only DataFrame functions are used. Participants of a conversation are few next to its
turns; each turn is rendered as many times as it has participants, as the result asks.

Defined results: null text is empty, a null role the name "unknown"; null turns come
last. Turns of the same number go by a hash of role and text. Rows that repeat in every
value are one turn; n_rows counts them all. Conversations that have only context roles, and empty tables, give no rows. A
null conv_id is a conversation of its own. A very long turn is one turn. Other columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import written

CONTEXT = ("system",)
#: Turns in a segment: turn numbers that share a bucket.
SEGMENT = 64


def _safe(text: Column) -> Column:
    """Text in which no mark can be read."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def segments(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id and the turns of each segment, in order."""
    last = F.lit(1 << 62)
    base = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("rows"))
    base = base.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / segment), last)).withColumn("hash", F.shiftrightunsigned(F.xxhash64("role", "text"), 32))
    sizes = base.groupBy("conv_id", "bucket", "turn").agg(F.count(F.lit(1)).alias("n"))
    full = sizes.groupBy("conv_id", "bucket").agg(F.sum("n").alias("all")).filter(F.col("all") > 2 * segment).select(F.col("conv_id").alias("_c"), F.col("bucket").alias("_b"))
    cut = sizes.join(full, sizes["conv_id"].eqNullSafe(full["_c"]) & (sizes["bucket"] == full["_b"]))
    cut = written(cut.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.ceil(F.col("n") / segment).cast("long").alias("parts")), "cuts")
    met = base.join(cut.hint("merge"), base["conv_id"].eqNullSafe(cut["_c"]) & base["turn"].eqNullSafe(cut["_t"]), "left")
    whole = F.col("parts").isNull()
    at = F.when(~whole, F.coalesce("turn", last))
    salt = F.when(whole, -1).otherwise(F.floor(F.col("hash") * F.col("parts") / float(1 << 32))).cast("long")
    turn = F.struct(F.coalesce("turn", last).alias("turn"), "hash", "role", "text", "rows")
    return met.groupBy("conv_id", "bucket", at.alias("at"), salt.alias("salt")).agg(F.array_sort(F.collect_list(turn)).alias("turns")).select("conv_id", "turns")


def rotate(conversations: DataFrame, context: tuple[str, ...] = CONTEXT, segment: int = SEGMENT) -> DataFrame:
    """conv_id, participant, segment_id, first_turn, n_turns, n_rows, turn_start,
    char_start, text, spans (start and end in text of what is learned) and mask_chars."""
    roles = conversations.select(F.col("conv_id").alias("_c"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("participant"))
    people = written(roles.filter(~F.col("participant").isin(*context)).distinct(), "people")
    packed = segments(conversations, segment)
    met = packed.join(people.hint("merge"), packed["conv_id"].eqNullSafe(people["_c"])).drop("_c")

    def heading(t: Column) -> Column:
        name = F.when(t["role"].isin(*context), _safe(t["role"])).when(t["role"] == F.col("participant"), F.lit("assistant")).otherwise(F.concat(F.lit("user:"), _safe(t["role"])))
        return F.concat(F.lit("<|"), name, F.lit("|>\n"))

    body = lambda t: F.concat(_safe(t["text"]), F.lit("<|end|>\n"))
    drawn = met.withColumn("_drawn", F.transform("turns", lambda t: F.struct(heading(t).alias("h"), body(t).alias("b"), (t["role"] == F.col("participant")).alias("own"))))
    none = F.array().cast("array<struct<start:long,end:long>>")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["h"])
        end = start + F.length(t["b"])
        return F.struct(end.alias("at"), F.when(t["own"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("_drawn", F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda a: a["spans"])
    text = F.array_join(F.transform("_drawn", lambda t: F.concat(t["h"], t["b"])), "")
    first = F.element_at("turns", 1)
    out = drawn.select("conv_id", "participant", first["turn"].alias("_t"), first["hash"].alias("_h"), F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["rows"]).alias("n_rows"), text.alias("text"), spans.alias("spans"))
    out = written(out.withColumn("_n", F.length("text").cast("long")), "rendered")
    w = Window.partitionBy("conv_id", "participant").orderBy("_t", "_h")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    places = out.select(
        F.col("conv_id").alias("_c"), F.col("participant").alias("_p"), F.col("_t").alias("_t2"), F.col("_h").alias("_h2"),
        (F.row_number().over(w) - 1).cast("long").alias("segment_id"), F.coalesce(F.sum("n_turns").over(upto), F.lit(0)).alias("turn_start"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("char_start"),
    )
    met = out.join(places, out["conv_id"].eqNullSafe(places["_c"]) & (out["participant"] == places["_p"]) & (out["_t"] == places["_t2"]) & (out["_h"] == places["_h2"]))
    learned = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return met.select("conv_id", "participant", "segment_id", F.when(F.col("_t") < (1 << 62), F.col("_t")).alias("first_turn"), "n_turns", "n_rows", "turn_start", "char_start", "text", "spans", learned.alias("mask_chars"))
