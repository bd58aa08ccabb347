"""Rows in and out of mapInArrow: values are read one by one, results are handed on in batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vaultlens.functions.bytes import values

#: Rows, and bytes of binary values, that are handed on at once.
ROWS, BYTES = 4096, 16 << 20


def arrow_schema(ddl: str) -> pa.Schema:
    """Of a schema in Spark's words; needs a session, so workers are given the result."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(values(b.column(c)) for c in columns), strict=True)


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= ROWS or size >= BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()
