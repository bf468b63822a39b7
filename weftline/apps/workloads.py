"""The six example workloads over any Dataset of lines or table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import compat
from weftline.operators.dataset import Dataset
from weftline.plans.shapes import count_by_key, parse_or_drop, top_counts

#: Fields of a covid-by-state line, in order: name, kind, required.
COVID = (
    ("date", "date", True),
    ("state", "string", True),
    ("totalCases", "int", True),
    ("confirmedCases", "int", False),
    ("probableCases", "int", False),
    ("newCases", "int", True),
    ("probableNewCases", "int", False),
    ("totalDeaths", "int", False),
    ("confirmedDeaths", "int", False),
    ("probableDeaths", "int", False),
    ("newDeaths", "int", False),
    ("probableNewDeaths", "int", False),
    ("createdAt", "datetime", True),
    ("consentCases", "agree", True),
    ("consentDeaths", "agree", True),
)
#: Fields of a person line.
PERSON = (("first", "string"), ("last", "string"), ("age", "int"), ("month", "string"), ("year", "int"), ("city", "string"), ("stateOrProvince", "string"))


def word_frequency(lines: Dataset, text: str = "value", top: int = 100) -> Dataset:
    """The most frequent lower-case words."""
    # one pass of generated code over the text; only texts with control characters are trimmed by word
    lower = F.lower(text)
    fields = F.split(lower, r"\s+", -1)
    trimmed = F.when(F.regexp_like(lower, F.lit(r"[\x00-\x08\x0E-\x1F]")), F.transform(fields, compat.java_trim)).otherwise(fields)
    return top_counts(lines.flat_map(trimmed, name="word").filter("word != ''"), top, "word")


def word_lengths(lines: Dataset, text: str = "value") -> Dataset:
    """How many words there are of each length, punctuation left out; words of nothing else go."""
    found = lines.flat_map(F.split(F.col(text), r"\s+", -1), name="w").map(F.length(compat.only_word_chars("w")).alias("len")).filter("len > 0")
    return count_by_key(found, "len")


def _kind(c, kind):
    return {"date": compat.option_date, "int": compat.option_int, "datetime": compat.option_datetime, "agree": lambda x: x == "Agree"}.get(kind, lambda x: x)(c)


def covid_rows(lines: Dataset) -> Dataset:
    """Lines of which any required field does not parse go, as do short ones."""
    f = Dataset(lines.df.select(compat.java_split("value", ",").alias("f")))
    cols = {name: _kind(F.get("f", F.lit(i)), kind) for i, (name, kind, _) in enumerate(COVID)}
    return parse_or_drop(f, cols, [n for n, _, need in COVID if need], F.size("f") >= len(COVID))


def covid_by_state(lines: Dataset) -> Dataset:
    return covid_rows(lines).group_by("state").reduce_groups("sum", "newCases", name="newCases")


def pixel_rows(lines: Dataset) -> Dataset:
    """time, user, color, posX, posY of the lines with five fields."""
    f = Dataset(lines.df.select(compat.java_split("value", ",").alias("f"))).filter(F.size("f") == 5)
    at = lambda i: F.get("f", F.lit(i))
    return f.map(at(0).alias("time"), at(1).alias("user"), at(2).alias("color"), *[compat.strict_int(compat.unquote(at(i))).alias(n) for i, n in ((3, "posX"), (4, "posY"))])


def top_users(rows: Dataset, user: str = "user", n: int = 50) -> Dataset:
    return top_counts(rows, n, user)


def squares(rows: Dataset, x: str = "posX", y: str = "posY", width: int = 50) -> Dataset:
    """Rows per square of the grid."""
    return count_by_key(rows.map(compat.bucket(x, width).alias("x"), compat.bucket(y, width).alias("y")), "x", "y")


def persons(lines: Dataset) -> Dataset:
    """Blank lines go; ages and years are strict."""
    f = Dataset(lines.filter("value != ''").df.select(compat.java_split("value", ",").alias("f")))
    return f.map(*[(compat.strict_int if kind == "int" else lambda c: c)(F.get("f", F.lit(i))).alias(n) for i, (n, kind) in enumerate(PERSON)])


def persons_of(lines: Dataset, state: str = "Texas") -> Dataset:
    return persons(lines).filter(F.col("stateOrProvince") == state)
