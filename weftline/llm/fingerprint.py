"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words (between ASCII white space, lower-cased), a term's
weight S is how often it occurs times the square of its length (up to 31), so that
common short words count little. For each of K samples every term draws, from hashes of
itself, r and c from Gamma(2, 1) and b from U(0, 1); t = floor(ln S / r + b),
ln y = r (t - b), ln a = ln c - ln y - r, and the term of the least a is the sample,
together with its t. Two texts agree on a sample with a probability of the sum of their
terms' lesser weights over that of the greater ones: the generalised Jaccard similarity.

All of it is generated code over one row per document and different term: logarithms,
hashes and a minimum of 64-bit keys for each sample. The
documents are dealt out by ranges of doc_id once, those of an id that repeats very often by
ranges of their texts' hashes too; a copy of the first document of the
range below joins each range, so that the next document is there without a global sort.
The ranges' terms are summed where they are. With 32 samples a likeness has a standard
error of at most 0.09.

Defined results: null text counts as empty. Texts without words agree on every sample
with each other and on none with others. The next document is the one before in
descending doc_id; null ids come last, rows of one doc_id in descending order of the text's
64-bit hash; the last row's is the first; a single row is its own. A very long text is one row
like any other, its terms summed before they draw. Other columns are not read. An
empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import SPACE, text_of

SAMPLES = 32
#: Quantiles of doc_id that are looked up; each stretch is divided evenly.
KNOTS = 64
NONE = -1
#: Ranges that the rows of one id are dealt to at most.
SUBS = 1 << 20
#: Rows of one id from which on they may be dealt apart.
HOT_LEAST = 1000


def _terms(text: Column) -> Column:
    """The words as sorted hashes, their length in the low bits."""
    words = F.filter(F.split(F.lower(text), f"{SPACE}+", -1), lambda w: w != "")
    return F.array_sort(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(~31)).bitwiseOR(F.least(F.length(w), F.lit(31)).cast("long"))))


def _runs(hashed: str) -> Column:
    """Where the runs of equal values of a sorted array end (counted from 1)."""
    h = F.col(hashed)
    ends = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == F.size(h)) | (F.get(h, i) != F.get(h, i - 1)))
    ends = F.when(F.size(h) > 0, ends).otherwise(F.array().cast("array<int>"))
    return ends


def sample_key(h: Column, log_weight: Column, k: int) -> Column:
    """ln a in the upper 41 bits (it tells terms and t apart), bits of the term in the
    lower 23. Three uniform numbers come from each hash."""
    x1, x2 = F.xxhash64(h, F.lit(2 * k)), F.xxhash64(h, F.lit(2 * k + 1))
    part = lambda x, n: (F.shiftrightunsigned(x, n).bitwiseAND(F.lit(0x1FFFFF)).cast("double") + 0.5) / float(1 << 21)
    r = -F.ln(part(x1, 0) * part(x1, 21))
    ln_c = F.ln(-F.ln(part(x2, 0) * part(x2, 21)))
    b = part(x1, 42)
    t = F.floor(log_weight / r + b).cast("double")
    ln_a = ln_c - r * (t - b + 1.0)
    return F.shiftleft(F.floor((ln_a + 128.0) * float(1 << 32)), 23).bitwiseOR(F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(0x7FFFFF)))


def _dealt(docs: DataFrame) -> DataFrame:
    """_ord, _mix, doc_id, text, _bucket, _guest: rows dealt by ranges of doc_id, with guests."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, -(-4 * parts // KNOTS))
    seen = base.agg(F.percentile_approx(order, [i / KNOTS for i in range(KNOTS + 1)], 10_000).alias("q"), F.count(F.lit(1)).alias("n")).first()
    found = seen["q"] or [0]
    knots = sorted(set(found))
    low = F.lit(knots[0])
    at = F.size(F.filter(F.array(*[F.lit(k) for k in knots]), lambda k: k <= F.col("_ord")))
    bounds = F.array(*[F.lit(float(k)) for k in knots])
    start, end = F.coalesce(F.get(bounds, at - 1), low.cast("double")), F.get(bounds, at)
    share = F.coalesce((F.col("_ord").cast("double") - start) / (end - start), F.lit(0.0))
    bucket = at * each + F.least(F.floor(F.greatest(share, F.lit(0.0)) * each), F.lit(each - 1)).cast("int")
    base = base.withColumn("_ord", order).withColumn("_mix", F.xxhash64("text"))
    limit = max(HOT_LEAST, seen["n"] // (4 * parts))
    hot = base.groupBy("_ord").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).collect()  # at most 4 for each partition
    own = bucket.cast("long")
    if hot:
        split = spark.createDataFrame([(r["_ord"], min(SUBS, -(-r["n"] // limit))) for r in hot], "_ord long, _subs long")
        base = base.join(F.broadcast(split), "_ord", "left")
        # in a range: what is between two such ids, then the parts of the second, and so on
        below = F.size(F.filter(F.array(*[F.lit(r["_ord"]) for r in hot]), lambda h: h <= F.col("_ord")))
        apart = F.col("_subs").isNotNull()
        sub = F.least(F.floor((F.col("_mix").cast("double") / float(1 << 64) + 0.5) * F.col("_subs")), F.col("_subs") - 1)
        own = (own * (2 * len(hot) + 1) + 2 * below - F.when(apart, 1).otherwise(0)) * SUBS + F.when(apart, sub).otherwise(0)
    base = base.withColumn("_own", own)
    tops = base.groupBy("_own").agg(F.max(F.struct("_ord", "_mix")).alias("_top"))  # a row per range
    w = Window.orderBy("_own")
    hosts = tops.select("_top._ord", "_top._mix", F.coalesce(F.lead("_own").over(w), F.lit(None)).alias("_host"), F.min("_own").over(Window.partitionBy(F.lit(0))).alias("_least"))
    hosts = hosts.select("_ord", "_mix", F.coalesce("_host", "_least").alias("_host"))
    met = base.join(F.broadcast(hosts), ["_ord", "_mix"], "left")
    here = F.array(F.struct(F.col("_own").alias("b"), F.lit(False).alias("g")), F.struct(F.col("_host").alias("b"), F.lit(True).alias("g")))
    spread = met.select("_ord", "_mix", "doc_id", "text", F.explode(F.filter(here, lambda x: x["b"].isNotNull())).alias("x"))
    return spread.select("_ord", "_mix", "doc_id", "text", F.col("x.b").alias("_bucket"), F.col("x.g").alias("_guest"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """_bucket, _rn, _guest, doc_id, text, n_chars and edited of every row and guest."""
    w = Window.partitionBy("_bucket").orderBy("_guest", F.desc("_ord"), F.desc("_mix"))
    rows = _dealt(docs).withColumn("_next", F.lead("text").over(w)).withColumn("_rn", F.row_number().over(w))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("_next"), F.lit(1), third))
    return rows.select("_bucket", "_rn", "_guest", "doc_id", "text", n.cast("long").alias("n_chars"), F.when(~F.col("_guest"), edited).alias("edited"))


def _likeness(a: str, b: str, k: int) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(k))


def _words_of_digest(digest: Column) -> list[Column]:
    """A hexadecimal digest as four numbers, which sums and minima can carry."""
    return [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)]


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = edited_pairs(docs)
    sha = [x.alias(f"s{i}") for i, x in enumerate(_words_of_digest(F.col("sha")))]
    kept = rows.withColumn("sha", F.sha2("edited", 256)).select("_bucket", "_rn", F.col("_guest").cast("int").alias("guest"), "doc_id", "n_chars", *sha, "text", "edited")
    once = ["guest", "doc_id", "n_chars", "s0", "s1", "s2", "s3"]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t"))))
    both = kept.select("_bucket", "_rn", *once, sides.alias("s")).filter("s.t is not null")
    hashed = both.select("_bucket", "_rn", *once, F.col("s.side").alias("side"), _terms(F.col("s.t")).alias("h")).withColumn("_ends", _runs("h"))
    terms = F.transform("_ends", lambda e, j: F.struct(F.get("h", e - 1).alias("h"), (e - F.when(j > 0, F.get("_ends", j - 1)).otherwise(0)).alias("n")))
    flat = hashed.select("_bucket", "_rn", "side", *once, F.posexplode_outer(terms).alias("_j", "_t"))
    h = F.col("_t.h")
    weight = F.ln(F.col("_t.n").cast("double")) + 2 * F.ln(h.bitwiseAND(F.lit(31)).cast("double"))
    # what a document has once comes along with its first term
    first = F.coalesce("_j", F.lit(0)) == 0
    lean = flat.select("_bucket", "_rn", "side", h.alias("h"), weight.alias("lw"), *[F.when(first, F.col(c)).alias(c) for c in once])
    mins = lean.groupBy("_bucket", "_rn", "side").agg(*[F.min(sample_key(F.col("h"), F.col("lw"), k)).alias(f"m{k}") for k in range(samples)], *[F.max(c).alias(c) for c in once])
    signed = mins.select("_bucket", "_rn", "side", *once, F.array(*[F.coalesce(f"m{k}", F.lit(NONE).cast("long")) for k in range(samples)]).alias("sig"))
    of = lambda side: F.first(F.when(F.col("side") == side, F.col("sig")), ignorenulls=True)
    met = signed.groupBy("_bucket", "_rn").agg(of(0).alias("_own"), of(1).alias("_edited"), *[F.max(c).alias(c) for c in once])
    w = Window.partitionBy("_bucket").orderBy("_rn")
    done = met.withColumn("_following", F.lead("_own").over(w)).filter("guest = 0")
    code = lambda c: F.array_join(F.transform(c, lambda x: F.lower(F.hex(x))), "-")
    digest = F.concat(*[F.lower(F.lpad(F.hex(f"s{i}"), 16, "0")) for i in range(4)])
    return done.select(
        "doc_id", "n_chars", digest.alias("edited_sha256"), code("_own").alias("fingerprint"), code("_edited").alias("edited_fingerprint"), _likeness("_own", "_edited", samples).alias("near_edited"), _likeness("_own", "_following", samples).alias("near_next")
    )
