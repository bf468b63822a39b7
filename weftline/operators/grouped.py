"""GroupedDataset: G1-G5 and A3-A4. Keys stay bound to the rows as they were
when grouped; mapped values are projected before the shuffle."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.operators import opaque
from weftline.operators.dataset import Dataset, Expr, Schema, column, fresh, is_opaque
from weftline.operators.reducers import reducer


class GroupedDataset:
    def __init__(self, df: DataFrame, keys: list[Column], values: list[Column]):
        self.df, self._keys, self._values = df, keys, values

    def _keyed(self) -> tuple[DataFrame, list[str], list[str]]:
        """Keys under names that no value has, values under their own."""
        values = self.df.select(*self._values).columns
        stem = fresh("_k", values)
        out = self.df.select(*[k.alias(f"{stem}{i}") for i, k in enumerate(self._keys)], *self._values)
        n = len(self._keys)
        return out, out.columns[:n], values

    def _key_names(self) -> list[str]:
        return self.df.select(*self._keys).columns

    def _named(self, df: DataFrame) -> DataFrame:
        """The first columns, the keys, back under their names; what else there is after them."""
        names = self._key_names()
        return df.toDF(*names, *df.columns[len(names) :])

    def keys(self) -> Dataset:
        return Dataset(self.df.select(*self._keys).distinct())

    def map_values(self, *exprs: Expr | Callable, schema: Schema | None = None) -> GroupedDataset:
        if is_opaque(exprs[0]):
            fn = exprs[0]
            keyed, ks, vs = self._keyed()
            kind = opaque.as_schema(schema)
            both = StructType([*[keyed.schema[k] for k in ks], *kind])
            n, one, names = len(ks), len(kind) == 1, vs

            def each(rows):
                make = Row(*names)
                for r in rows:
                    v = fn(r[n] if len(names) == 1 else make(*r[n:]))
                    yield (*r[:n], *((v,) if one else v))

            out = opaque.per_partition(keyed, each, both)
            keys = [F.col(k).alias(name) for k, name in zip(ks, self._key_names(), strict=True)]
            return GroupedDataset(out, keys, [F.col(x) for x in kind.names])
        # expressions see the values as they are now; keys stay on the row before
        seen, hidden, _ = self._keyed()
        mapped = seen.select(*hidden, *[column(e) for e in exprs])
        keys = [F.col(k).alias(name) for k, name in zip(hidden, self._key_names(), strict=True)]
        return GroupedDataset(mapped, keys, [F.col(f"`{x}`") for x in mapped.columns[len(hidden) :]])

    def agg(self, *aggs: Column) -> Dataset:
        """Known aggregates per group (partial and final)."""
        keyed, ks, _ = self._keyed()
        return Dataset(self._named(keyed.groupBy(*ks).agg(*aggs)))

    def map_groups(self, *how: Column | Callable, schema: Schema | None = None) -> Dataset:
        """One row per group: aggregates, or a function of key and rows (all of a group in one task)."""
        if is_opaque(how[0]):
            fn = how[0]
            return self._per_group(lambda k, rows: [fn(k, rows)], schema)
        return self.agg(*how)

    def flat_map_groups(self, fn: Callable[[Any, Any], Any], schema: Schema) -> Dataset:
        """Any number of rows per group from a function of key and rows."""
        return self._per_group(fn, schema)

    def top_n_per_group(self, n: int, *order: Expr) -> Dataset:
        """The first n rows of each group: the column-lane form of the common flat_map_groups."""
        keyed, ks, vs = self._keyed()
        w = Window.partitionBy(*ks).orderBy(*[column(e) for e in order])
        rank = fresh("_rn", keyed.columns)
        return Dataset(keyed.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= max(0, n)).select(*[F.col(f"`{v}`") for v in vs]))

    def reduce_groups(self, how: str | Callable, value: Expr | None = None, name: str = "value") -> Dataset:
        """Pairs of key and reduced value. Callables fold partially before the shuffle too."""
        keyed, ks, vs = self._keyed()
        if not is_opaque(how):
            v = column(value) if value is not None else F.col(f"`{vs[0]}`")
            return Dataset(self._named(keyed.groupBy(*ks).agg(reducer(how, v).alias(name))))
        n, one = len(ks), len(vs) == 1
        make = Row(*vs)

        def fold(rows, bound=50_000):
            seen: dict = {}
            for r in rows:
                k, v = tuple(r[:n]), r[n] if one else make(*r[n:])
                seen[k] = how(seen[k], v) if k in seen else v
                if len(seen) > bound:  # emitted early; the groups meet after the shuffle
                    yield from ((*k, *((v,) if one else v)) for k, v in seen.items())
                    seen = {}
            yield from ((*k, *((v,) if one else v)) for k, v in seen.items())

        def fold_runs(rows):
            for k, found in opaque.groups(rows, n):
                v = functools.reduce(how, (r[n] if one else make(*r[n:]) for r in found))
                yield (*k, *((v,) if one else v))

        local = opaque.per_partition(keyed, fold, keyed.schema)
        met = local.repartition(*ks).sortWithinPartitions(*ks)
        return Dataset(self._named(opaque.per_partition(met, fold_runs, keyed.schema)))

    def _per_group(self, fn, schema: Schema) -> Dataset:
        """fn gets an iterator over the group's rows, which stream by."""
        keyed, ks, vs = self._keyed()
        n, one = len(ks), len(vs) == 1
        make = Row(*vs)

        def run(rows):
            for k, found in opaque.groups(rows, n):
                yield from fn(k[0] if n == 1 else k, (r[n] if one else make(*r[n:]) for r in found))

        met = keyed.repartition(*ks).sortWithinPartitions(*ks)
        return Dataset(opaque.per_partition(met, run, schema))

    # actions
    def collect(self, limit: int | None = None) -> dict:
        """key -> list of values, of at most limit groups. Brings all values to the driver: that is the action."""
        keyed, ks, vs = self._keyed()
        value = F.col(f"`{vs[0]}`") if len(vs) == 1 else F.struct(*[F.col(f"`{v}`") for v in vs])
        boxed = F.collect_list(F.struct(value.alias("v")))  # boxed: nulls are kept
        lists = keyed.groupBy(*ks).agg(boxed.alias("values"))
        rows = (lists if limit is None else lists.limit(max(0, limit))).collect()
        n = len(ks)
        return {(r[0] if n == 1 else tuple(r[:n])): [x["v"] for x in r[n]] for r in rows}

    def count(self) -> int:
        """The number of groups."""
        return self.keys().df.count()
