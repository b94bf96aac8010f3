"""Vector columns: which rows take part, and Arrow lists as numpy matrices in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block of vectors takes at most so many bytes, and so many rows.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 16_384


def finite(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True))


def commonest_length(rows: DataFrame, vector: str) -> tuple[int, int]:
    """The length that most vectors have, the smaller of two alike, and how many have it; zeros without rows."""
    found = rows.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return (int(found["dim"]), int(found["count"])) if found else (0, 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of dim numbers each as float64 rows."""
    return np.asarray(pc.list_flatten(column)).astype(np.float64).reshape(-1, dim)


def blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.Table]:
    """Batches put together to blocks, so that work on whole arrays pays."""
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dim, 1))))
    held, n = [], 0
    for batch in batches:
        for part in (batch.slice(i, most) for i in range(0, len(batch), most)):
            if n + len(part) > most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
            held.append(part)
            n += len(part)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of a table as one array."""
    held = table.column(name)
    return held.chunk(0) if held.num_chunks == 1 else pa.concat_arrays(held.chunks) if held.num_chunks else pa.array([], held.type)
