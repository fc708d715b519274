"""Arrow batches to flat byte buffers, in slices that bound the working memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between the six ASCII white-space bytes.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words of ASCII letters and digits and of all bytes over 0x7F.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of rows of about `size` bytes, one row at least."""
    data, offsets = flat(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; words never cross rows."""
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


def per_row(row: np.ndarray, n: int) -> np.ndarray:
    """First position of each row's run in a sorted row array, with the end appended."""
    return np.searchsorted(row, np.arange(n + 1))


def with_text_columns(docs, text_col: str, schema: str, make, keep_text: bool = True, extra=None):
    """`docs` with columns computed from one text column, batch by batch.

    make() gives, once per task, a function from an Arrow string column to a list of arrays for
    `schema` (DDL).  Columns of docs with those names are replaced; all others pass through.  With a
    column `extra` the function gets its array as a second argument.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructField, StructType

    from sparkloom.llm.store import bounded_batches

    bounded_batches(docs.sparkSession)
    added = StructType.fromDDL(schema)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added.names])
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row") if others else F.struct(F.lit(0).alias("_")).alias("_row"), F.col(f"`{text_col}`").alias("_text"), *([] if extra is None else [extra.alias("_extra")]))
    fields = [packed.schema["_row"]] + ([StructField("_text", packed.schema["_text"].dataType)] if keep_text else []) + added.fields

    extra = None if extra is None else True  # a Column cannot travel to the executors

    def go(batches):
        f = make()
        for batch in batches:
            columns = [batch.column(0)] + ([batch.column(1)] if keep_text else [])
            arrays = f(batch.column(1)) if extra is None else f(batch.column(1), batch.column(2))
            yield pa.record_batch(columns + arrays, names=[x.name for x in fields])

    done = packed.mapInArrow(go, StructType(fields))
    front = [F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != text_col or keep_text]
    return done.select(*front, *added.names)
