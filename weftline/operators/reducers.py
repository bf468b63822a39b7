"""Named reducers: built-in aggregates with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMED = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "and": F.bool_and,
    "or": F.bool_or,
    "avg": F.avg,
}


def reducer(name: str, value: Column) -> Column:
    if name not in NAMED:
        raise ValueError(f"unknown reducer {name!r}; one of {sorted(NAMED)}, or give a callable")
    return NAMED[name](value)
