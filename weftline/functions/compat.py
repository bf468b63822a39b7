r"""Column forms of the JVM string and number methods that closures use."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def java_split(c: Column | str, delimiter: str) -> Column:
    """Split by a literal delimiter; trailing empty fields go, all-delimiter texts give no field."""
    d = re.escape(delimiter)
    kept = F.regexp_replace(_c(c), f"(?:{d})+$", "")
    return F.when(F.regexp_like(_c(c), F.lit(f"^(?:{d})+$")), F.array().cast("array<string>")).otherwise(F.split(kept, d, -1))


def words(c: Column | str) -> Column:
    r"""Fields between runs of white space, without empty ones."""
    return F.filter(F.split(_c(c), r"\s+", -1), lambda w: w != "")


def java_trim(c: Column | str) -> Column:
    r"""Strips every character up to U+0020 from both ends."""
    return F.regexp_replace(_c(c), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def strict_int(c: Column | str) -> Column:
    """Like a strict parse: raises on anything but an optional sign and digits."""
    v = _c(c)
    ok = F.regexp_like(v, F.lit("^[+-]?[0-9]+$"))
    bad = F.raise_error(F.concat(F.lit("not an integer: "), v)).cast("int")
    return F.when(v.isNull() | ok, v.cast("int")).otherwise(bad)


def option_int(c: Column | str) -> Column:
    """Null instead of an error."""
    v = _c(c)
    return F.when(F.regexp_like(v, F.lit("^[+-]?[0-9]+$")), v.try_cast("int"))


def bucket(c: Column | str, width: int) -> Column:
    """x / width * width in integers, truncating toward zero."""
    v = _c(c)
    return v - F.try_mod(v, F.lit(width))


def option_date(c: Column | str) -> Column:
    return F.try_to_timestamp(_c(c), F.lit("M/d/yyyy")).cast("date")


def option_datetime(c: Column | str) -> Column:
    return F.try_to_timestamp(_c(c), F.lit("M/d/yyyy h:mm:ss a"))


def unquote(c: Column | str) -> Column:
    return F.translate(_c(c), '"', "")


def only_word_chars(c: Column | str) -> Column:
    r"""Drops what \W matches (ASCII only)."""
    return F.regexp_replace(_c(c), r"\W", "")
