"""Arrow-batched helpers: per-batch maps and groups that arrive sorted by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def struct(schema: str | StructType) -> StructType:
    return _parse_datatype_string(schema) if isinstance(schema, str) else schema


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """fn gets a batch and returns columns (lists or arrays) by name."""
    arrow = to_arrow_schema(struct(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = fn(b)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct(schema))


def merge(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the data: it is sorted and merged, whatever its files' size lets the planner believe."""
    return df.hint("merge")


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[list[dict]], list[tuple]], schema: str, order: list[str] = (), parts: int | None = None) -> DataFrame:
    """fn gets the rows of each group of equal keys and returns rows of the schema.

    One hash exchange and a sort within partitions; a group costs no more than its rows, so millions of small
    groups are cheap. Callers bound the size of a group."""
    arrow = to_arrow_schema(struct(schema))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        key, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                k = tuple(r[c] for c in keys)
                if k != key and held:
                    rows += fn(held)
                    held = []
                    if len(rows) >= 4096:
                        yield out(rows)
                        rows = []
                key = k
                held.append(r)
        if held:
            rows += fn(held)
        if rows:
            yield out(rows)

    spread = df.repartition(*([parts] if parts else []), *keys)
    return spread.sortWithinPartitions(*keys, *order).mapInArrow(run, struct(schema))
