"""Dataset: lazy transforms T1-T10 and actions A1-A2 over a DataFrame.

Arguments that are Columns or SQL strings stay in Catalyst (the column lane);
Python callables need an output schema and take the opaque lane. Functions given
to reduce must be associative and commutative; key expressions deterministic."""

from __future__ import annotations

import functools
from collections.abc import Callable
from itertools import islice
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.operators import opaque
from weftline.operators.reducers import reducer

if TYPE_CHECKING:
    from weftline.operators.grouped import GroupedDataset

Expr = Column | str
Schema = str | StructType


def column(e: Expr) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def fresh(stem: str, columns: list[str]) -> str:
    """A column name that none of columns begins with."""
    while any(c.lower().startswith(stem) for c in columns):
        stem = f"_{stem}"
    return stem


def is_opaque(f: Any) -> bool:
    return callable(f) and not isinstance(f, Column)


class Dataset:
    def __init__(self, df: DataFrame):
        self.df = df

    # narrow transforms
    def map(self, *exprs: Expr | Callable, schema: Schema | None = None) -> Dataset:
        """One row to one row: columns, or a function with a schema."""
        if is_opaque(exprs[0]):
            fn = exprs[0]
            return Dataset(opaque.per_partition(self.df, lambda rows: map(fn, rows), self._need(schema)))
        return Dataset(self.df.select(*[column(e) for e in exprs]))

    def flat_map(self, expr: Expr | Callable, schema: Schema | None = None, name: str = "value") -> Dataset:
        """One row to any number: an array column, or a function giving an iterable. Null and empty: no row."""
        if is_opaque(expr):
            return Dataset(opaque.per_partition(self.df, lambda rows: (y for x in rows for y in expr(x)), self._need(schema)))
        return Dataset(self.df.select(F.explode(column(expr)).alias(name)))

    def filter(self, cond: Expr | Callable) -> Dataset:
        if is_opaque(cond):
            return Dataset(opaque.per_partition(self.df, lambda rows: (x for x in rows if cond(x)), self.df.schema))
        return Dataset(self.df.filter(column(cond)))

    def repartition(self, n: int) -> Dataset:
        return Dataset(self.df.repartition(n))

    # global transforms
    def reduce(self, how: str | Callable, value: Expr | None = None, name: str = "value") -> Dataset:
        """A lazy one-row dataset; of nothing, an empty one. Empty partitions are skipped."""
        if is_opaque(how):

            def fold(rows):
                first = next(rows, fold)
                if first is not fold:
                    yield functools.reduce(how, rows, first)

            local = opaque.per_partition(self.df, fold, self.df.schema)
            return Dataset(opaque.per_partition(local.repartition(1), fold, self.df.schema))
        v = column(value) if value is not None else F.col(self.df.columns[0])
        rows = fresh("_rows", [name])
        found = self.df.agg(reducer(how, v).alias(name), F.count(F.lit(1)).alias(rows))
        return Dataset(found.filter(F.col(rows) > 0).select(F.col(f"`{name}`")))

    def first_n(self, n: int, *order: Expr | Callable) -> Dataset:
        """The first n rows of an order, sorted: order columns, or a strict less-than function."""
        n = max(0, n)
        if order and is_opaque(order[0]):
            less = order[0]

            def top(rows):
                key = functools.cmp_to_key(lambda a, b: -1 if less(a, b) else 1 if less(b, a) else 0)
                best: list = []
                while block := list(islice(rows, max(n, 4096))):
                    best = sorted(best + block, key=key)[:n]
                return best

            local = opaque.per_partition(self.df, top, self.df.schema)
            return Dataset(opaque.per_partition(local.repartition(1), top, self.df.schema))
        return Dataset(self.df.orderBy(*[column(e) for e in order]).limit(n))

    def first_n_by(self, n: int, *keys: Expr, descending: bool = False) -> Dataset:
        return self.first_n(n, *[column(k).desc() if descending else column(k).asc() for k in keys])

    def largest_n(self, n: int, *keys: Expr) -> Dataset:
        return self.first_n_by(n, *keys, descending=True)

    def smallest_n(self, n: int, *keys: Expr) -> Dataset:
        return self.first_n_by(n, *keys)

    def group_by(self, *keys: Expr | Callable, schema: Schema | None = None) -> GroupedDataset:
        """Key columns (none: all columns), or a key function with the key's schema."""
        from weftline.operators.grouped import GroupedDataset

        if keys and is_opaque(keys[0]):
            fn, kind = keys[0], opaque.as_schema(self._need(schema))
            names = self.df.columns
            both = StructType([*[f for f in kind if f.name not in names], *self.df.schema])
            if len(both) != len(kind) + len(names):
                raise ValueError(f"the key's columns {kind.names} clash with {names}")
            one = len(kind) == 1

            def keyed(rows):
                for x in rows:
                    k = fn(x)
                    yield (*((k,) if one else k), *((x,) if len(names) == 1 else x))

            return GroupedDataset(opaque.per_partition(self.df, keyed, both), [F.col(n) for n in kind.names], [F.col(n) for n in names])
        cols = [column(k) for k in keys] or [F.col(f"`{n}`") for n in self.df.columns]
        return GroupedDataset(self.df, cols, [F.col(f"`{n}`") for n in self.df.columns])

    # actions
    def collect(self, limit: int | None = None) -> list:
        df = self.df if limit is None else self.df.limit(max(0, limit))
        rows = df.collect()
        return [r[0] for r in rows] if len(df.columns) == 1 else rows

    def count(self) -> int:
        return self.df.count()

    def _need(self, schema: Schema | None) -> Schema:
        if schema is None:
            raise ValueError("a Python function needs schema=, the schema of what it returns")
        return schema
