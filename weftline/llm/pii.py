r"""Personal data: patterns, and terms that give protected entities away.

Base spans are e-mail and IP addresses, card and phone numbers. Their distinct values
are the protected entities. How strongly a term reveals an entity is estimated from the
whole corpus: with n(t) of N different texts that have the term, n(e) that have the
entity and n(t, e) in which both stand, wherever that is, the pointwise mutual information
log2(n(t,e) N / (n(t) n(e))) over the entity's information log2(N / n(e)) is 1 for a term
that gives the entity away wholly, about 0 for one that tells nothing. Terms from the
first threshold on are generalised to a class, from the second on removed, wherever they
stand. Strings that carry too much information to be words, as keys, tokens and passwords do,
are removed as secrets wherever they stand: letters and digits in turns, 16 at least, of 8 different ones.
A term is a run of letters and digits of any length; what stands in base spans only
is none.

Everything is DataFrame expressions: a pattern's matches and the text between them
(extracting and splitting by the same pattern) give the places of the matches, in code
points, as running sums. Sums run in blocks, as many as each has members, and texts are cut by
blocks of code points, so that no array or string grows by one match after the other
and none is walked from its start for each.
Texts that repeat are found by their hashes, and only their first copies move.
Patterns are possessive and begin where a run begins, so that no long run of
letters or digits takes more than linear time; what they match is what the plain
patterns match. Terms of hot entities are counted by partial sums; a candidate list is broadcast only below a checked size, else joined by shuffle.

Defined results: null text counts as empty and has no spans (sanitise leaves it null).
Repeated rows get the same spans; a null doc_id is a row like any other. Copies of a
text count once in each of the four counts, so that copying alone makes no term telling
and hides none. Without entities no term is flagged; nor by an entity of one different
text, of which every word found nowhere else would be telling. A very long text is like any
other; with E entities that other texts share and T different terms it takes part in E T counts.
Of the other columns only n_chars is touched, and by sanitise alone, to
count the new text. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_of, written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match must have: cheap to look for.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.regexp_like(t, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda t: F.regexp_like(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){15}")),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?=[A-Za-z]*+[0-9]++[A-Za-z]++[0-9])[A-Za-z0-9]{16,}+)"
#: Different characters in a secret at least.
VARIETY = 8
TERM = r"[\p{L}\p{N}]++"
#: Code points that a text is cut into to find places in it.
CUT = 4096
#: Different texts that a term must share with an entity to be judged.
SUPPORT = 2
GENERALISE, REMOVE = 0.8, 0.95
#: Candidate terms up to which their list is broadcast (16 bytes each).
BROADCAST_TERMS = 500_000


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(v, r"\.", -1), lambda p: small(F.regexp_replace(p, "^0+", "")))
    if kind == "card":
        digits = F.translate(v, " -", "")
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, op, kind: str = "long") -> Column:
    """Of each element, op over those before it (0: none). Blocks of about as many
    elements as there are blocks: what grows is short."""
    zero = F.lit(0).cast(kind)

    def run(block: Column, of) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(block, start, lambda acc, x: F.struct(op(acc["at"], of(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def blocked(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / width).cast("int")), lambda i: F.slice(v, i * width + 1, width))
        inner = F.transform(blocks, lambda b: run(b, lambda x: x))
        return _let(inner, lambda found: F.flatten(F.zip_with(found, run(found, lambda x: x["at"])["out"], lambda x, first: F.transform(x["out"], lambda y: op(y, first)))))

    return _let(values, blocked)


_SPANS = "array<struct<kind:string,start:long,end:long,value:string>>"


def _placed(text: Column, pattern: str, kind: Column | str, keep=None) -> Column:
    """array<struct<kind,start,end,value>> of the matches that keep holds for."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def spans(hits: Column) -> Column:
        pieces = F.zip_with(hits, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda hit, gap: F.struct(hit.alias("hit"), F.length(gap).cast("long").alias("gap"), F.length(hit).cast("long").alias("n")))

        def placed(found: Column) -> Column:
            starts = _before(F.transform(found, lambda x: x["gap"] + x["n"]), lambda a, b: a + b)
            return F.zip_with(found, starts, lambda x, at: F.struct(kind.alias("kind"), (at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["hit"].alias("value")))

        out = _let(pieces, placed)
        return F.filter(out, lambda x: keep(x["value"])) if keep else out

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _replaced(text: Column, spans: Column, tag) -> Column:
    """text with tag(span) for each span; of spans that overlap the first gives it for all.
    spans: start, end and what tag reads, in order."""

    def rebuilt(blocks: Column, found: Column, seen: Column) -> Column:
        n = F.length(text).cast("long")
        block = lambda x: F.get(blocks, F.floor(x / CUT).cast("int"))
        within = lambda x: (x % CUT).cast("int")

        def cut(a: Column, b: Column) -> Column:
            first, last = F.floor(a / CUT).cast("int"), F.floor(b / CUT).cast("int")
            far = F.concat(F.substr(block(a), within(a) + 1), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.coalesce(F.substr(block(b), F.lit(1), within(b)), F.lit("")))
            return F.when(b <= a, "").when(first == last, F.substr(block(a), within(a) + 1, (b - a).cast("int"))).otherwise(far)

        parts = F.zip_with(found, seen, lambda x, at: F.when(x["start"] >= at, F.concat(cut(at, x["start"]), tag(x))).otherwise(""))
        end = F.coalesce(F.array_max(F.transform(found, lambda x: x["end"])), F.lit(0).cast("long"))
        return F.concat(F.array_join(parts, ""), cut(end, n))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return _let(blocks, lambda b: _let(spans, lambda x: _let(_before(F.transform(x, lambda y: y["end"]), lambda p, q: F.greatest(p, q)), lambda at: rebuilt(b, x, at))))


def base_spans(text: Column) -> Column:
    """All valid spans by kind, then start."""
    none = F.array().cast(_SPANS)
    return F.concat(*[F.when(HINTS[k](text), _placed(text, PATTERNS[k], k, lambda v, k=k: _valid(k, v))).otherwise(none) for k in KINDS])


def secret_spans(text: Column) -> Column:
    """Strings of much information, in order."""
    varied = lambda v: F.size(F.array_distinct(F.split(F.lower(v), "", -1))) >= VARIETY
    return F.when(F.regexp_like(text, F.lit(r"[0-9][A-Za-z]++[0-9]|AKIA")), _placed(text, SECRET, "secret", varied)).otherwise(F.array().cast(_SPANS))


def _entity(span: Column) -> Column:
    """A value as it is compared: lower case; of numbers the digits."""
    v = span["value"]
    digits = F.regexp_replace(v, "[^0-9.]", "")
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"] == "email", F.lower(v)).when(span["kind"] == "ip", v).otherwise(F.translate(digits, ".", "")))


def _outside(text: Column, base: Column) -> Column:
    """The text with a blank for each base span."""
    ordered = F.array_sort(F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return F.when(F.size(base) == 0, text).otherwise(_replaced(text, ordered, lambda x: F.lit(" ")))


def _terms(text: Column) -> Column:
    """The different terms."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def telling_terms(based: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """term and disclosure of the terms at or above the threshold. based: _text, _base of every document; each row counts."""
    total = based.count()
    some = written(based.filter(F.size("_base") > 0), "with-entities")
    has = some.select(F.explode(F.array_distinct(F.transform("_base", lambda x: F.xxhash64(_entity(x))))).alias("e"))
    ne = written(has.groupBy("e").agg(F.count(F.lit(1)).alias("ne")), "entities")
    # an entity of fewer documents than support shares no term in as many: exact, and most go here
    shared = ne.filter(F.col("ne") >= support).select("e")
    few = shared.count() <= BROADCAST_TERMS
    texts = some.groupBy(F.xxhash64("_text").alias("d")).agg(F.first("_text").alias("_text"), F.first("_base").alias("_base"))
    found = F.array_distinct(F.transform("_base", lambda x: F.xxhash64(_entity(x))))
    # ids alone are joined; then each text once, beside its shared entities
    each = some.select(F.xxhash64("_text").alias("d"), F.explode(found).alias("e")).distinct()
    mine = each.join(F.broadcast(shared) if few else shared, "e").groupBy("d").agg(F.collect_list("e").alias("es"))
    near = texts.join(mine, "d").select("es", _terms(_outside(F.col("_text"), F.col("_base"))).alias("ts"))
    seen = near.select("ts", F.explode("es").alias("e")).select("e", F.explode("ts").alias("term"))
    met = seen.groupBy("e", "term").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= support)
    met = written(met, "met")
    candidates = written(met.select("term").distinct(), "candidates")
    size = candidates.count()
    if not size:
        return met.select("term", F.lit(0.0).alias("disclosure"))
    # a document's different words, so that counts are partial sums and no (document, term) pairs move
    words = based.select(F.explode(_terms(_outside(F.col("_text"), F.col("_base")))).alias("term"))
    found = words.join(F.broadcast(candidates), "term") if size <= BROADCAST_TERMS else words.groupBy("term").agg(F.count(F.lit(1)).alias("part")).join(candidates, "term")
    df = found.groupBy("term").agg((F.count(F.lit(1)) if size <= BROADCAST_TERMS else F.sum("part")).alias("nt"))
    scored = met.join(df, "term").join(ne, "e")
    pmi = F.log2(F.col("both") * F.lit(total) / (F.col("nt") * F.col("ne")))
    information = F.log2(F.lit(total) / F.col("ne"))
    share = F.when(information > 0, F.least(pmi / information, F.lit(1.0))).otherwise(0.0)
    return written(scored.groupBy("term").agg(F.max(share).alias("disclosure")).filter(F.col("disclosure") >= generalise), "telling")


def different(based: DataFrame) -> DataFrame:
    """_text and _base, once for each different text."""
    rows = based.select(F.xxhash64("_text").alias("d"), "_text")
    copied = written(rows.groupBy("d").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("d"), "copied")
    first = lambda df: written(df.groupBy("d").agg(F.first("_text").alias("_text")).select("_text"), "first").withColumn("_base", base_spans(F.col("_text")))
    if copied.count() > BROADCAST_TERMS:
        return first(rows)
    known = F.broadcast(copied)
    single = based.select("_text", "_base", F.xxhash64("_text").alias("d")).join(known, "d", "left_anti").select("_text", "_base")
    return single.unionByName(first(rows.join(known, "d", "left_semi")))


def annotated(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """_row (the row of docs), _text, and _base, _secret and _more (terms), the spans of each sort."""
    # in a struct, no column of docs can clash with one of these
    based = docs.select(F.struct("*").alias("_row"), text_of().alias("_text"))
    based = based.withColumn("_base", base_spans(F.col("_text"))).withColumn("_id", F.xxhash64("_text", F.col("_row.doc_id").cast("string")))
    narrow = based.select("_id", "_text", "_base")
    telling = telling_terms(different(narrow), support, generalise)
    n = telling.count()
    none = F.array().cast(_SPANS)
    if not n:
        return based.withColumn("_secret", secret_spans(F.col("_text"))).withColumn("_more", none).drop("_id")
    words = narrow.select("_id", F.posexplode(F.regexp_extract_all("_text", F.lit(TERM), F.lit(0)))).select("_id", F.col("pos").alias("i"), F.lower("col").alias("term"))
    found = words.join(F.broadcast(telling) if n <= BROADCAST_TERMS else telling, "term")
    kind = F.when(F.col("disclosure") >= remove, "removed").otherwise("term").alias("kind")
    # a document's own list: at most its words
    per = found.groupBy("_id").agg(F.array_sort(F.collect_set(F.struct("i", kind))).alias("_told"))
    # by shuffle at every size: both sides grow with the documents
    per = written(per.withColumnRenamed("_id", "_key"), "told").hint("merge")
    met = based.join(per, based["_id"] == per["_key"], "left")
    graded = _let(
        _placed(F.col("_text"), TERM, "term"),
        lambda spans: F.transform("_told", lambda x: _let(F.get(spans, x["i"]), lambda s: F.struct(x["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))),
    )
    return met.withColumn("_secret", secret_spans(F.col("_text"))).withColumn("_more", F.when(F.col("_told").isNull(), none).otherwise(graded)).drop("_id", "_key", "_told")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, **how) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_secret and n_terms of every row."""
    got = annotated(docs.select("doc_id", "text"), **how)
    of = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    terms = F.transform("_more", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return got.select("_row.doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.concat("_base", "_secret", terms)).alias("spans"), F.size("_secret").cast("long").alias("n_secret"), F.size("_more").cast("long").alias("n_terms"))


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """docs with base spans and secrets as [KIND], telling terms as [TERM] or nothing; spans that overlap become one."""
    got = annotated(docs, **how)
    ordered = F.array_sort(F.transform(F.concat("_base", "_secret", "_more"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    tag = lambda s: F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    clean = _replaced(F.col("_text"), ordered, tag)
    changed = F.size("_base") + F.size("_secret") + F.size("_more") > 0
    cols = {"text": F.when(changed, clean).otherwise(F.col("_row.text"))}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(changed, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return got.select(*[cols[c].alias(c) if c in cols else F.col(f"_row.`{c}`") for c in docs.columns])
