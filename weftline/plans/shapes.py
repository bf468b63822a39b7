"""Composite shapes C1-C5 and a look at physical plans."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.dataset import Dataset, Expr, Schema


def map_reduce(ds: Dataset, mapper, key, reducer, schema: Schema | None = None, key_schema: Schema | None = None, mapped_schema: Schema | None = None) -> Dataset:
    """flat_map, group_by, map_groups."""
    return ds.flat_map(mapper, schema=mapped_schema).group_by(key, schema=key_schema).map_groups(reducer, schema=schema)


def count_by_key(ds: Dataset, *keys: Expr, name: str = "n") -> Dataset:
    return ds.group_by(*keys).agg(F.count(F.lit(1)).alias(name))


def top_counts(ds: Dataset, n: int, *keys: Expr, name: str = "n") -> Dataset:
    """Group, count, top n; equal counts by ascending key."""
    counted = count_by_key(ds, *keys, name=name)
    return counted.first_n(n, F.col(name).desc(), *[F.col(k).asc() for k in counted.df.columns if k != name])


def parse_or_drop(ds: Dataset, columns: dict[str, Column], required: list[str], valid: Column | None = None) -> Dataset:
    """Rows whose required columns parse; others go."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    # a generator, as a filter would be pushed below and parse everything again
    parsed = F.filter(F.array(row), lambda x: functools.reduce(Column.__and__, [x[n].isNotNull() for n in required], F.lit(True)))
    return Dataset(ds.df.select(F.inline(parsed if valid is None else F.when(valid, parsed))))


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
