"""The opaque lane: arbitrary Python functions with a declared schema, run over
Arrow batches. An element is the bare value of a one-column dataset, else a Row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby, islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

OUT_ROWS = 4096


def as_schema(schema: str | StructType) -> StructType:
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    return kind if isinstance(kind, StructType) else StructType().add("value", kind)


def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[Any]:
    for batch in batches:
        names = batch.schema.names
        columns = [c.to_pylist() for c in batch.columns]
        if len(names) == 1:
            yield from columns[0]
        else:
            make = Row(*names)
            for values in zip(*columns, strict=True):
                yield make(*values)


def _record(x: Any, names: list[str]) -> tuple:
    if len(names) == 1 and not (isinstance(x, tuple) and hasattr(x, "__fields__") and len(x) == 1):
        return (x,)
    return tuple(x[n] for n in names) if isinstance(x, dict) else tuple(x)


def batches_of(rows: Iterable[Any], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while block := list(islice(rows, OUT_ROWS)):
        records = [_record(x, schema.names) for x in block]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in records], f.type) for i, f in enumerate(schema)], schema=schema)


def groups(rows: Iterable[tuple], n: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """The runs of equal leading n values of sorted rows, each as it streams by."""
    # not-a-number is one key, as in Spark
    same = lambda r: tuple("nan" if isinstance(x, float) and x != x else (x,) for x in r[:n])
    for _, run in groupby(rows, same):
        first = next(run)
        yield tuple(first[:n]), chain((first,), run)


def per_partition(df: DataFrame, fn: Callable[[Iterator[Any]], Iterable[Any]], schema: str | StructType) -> DataFrame:
    """fn turns the elements of a partition into those of the result, lazily."""
    kind = as_schema(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(fn(elements(batches)), arrow)

    return df.mapInArrow(run, kind)
