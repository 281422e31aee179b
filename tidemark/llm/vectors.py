"""Vectors of whole numbers from arrays of any numeric type, and their packing into chunks of rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a chunk: 65,536 vectors of 64 components.
CHUNK = 1 << 22


def finite(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def whole(vectors: DataFrame, vector: str, scale: int, limit: int, offset: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """(vec_id long, x array<long>) and the columns to ``keep``: finite vectors, each component c as
    floor(scale * c) + offset.

    A component of ``limit`` or more, either sign, before the offset is an error: sums of products
    would leave the range of whole numbers.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"), *keep)
    # Spark may evaluate each of these on rows that another drops
    inside = ~finite(F.col("x")) | F.forall("x", lambda c: F.abs(c) < float(limit) / scale)
    checked = F.assert_true(inside, f"a vector has a component of {limit / scale:g} or more").isNull()
    rows = rows.filter(finite(F.col("x"))).filter(checked)
    number = F.transform("x", lambda c: F.try_add(F.floor(c * F.lit(float(scale))), F.lit(offset).cast("long")))
    return rows.select("vec_id", number.alias("x"), *keep)


def common_length(rows: DataFrame, column: str = "x") -> int | None:
    """The length of most vectors (between equally many, the shorter); None without rows."""
    found = rows.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return found[0][0] if found else None


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def gathered(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, matrix) of a task's rows (vec_id, x), about ``CHUNK`` numbers at a time."""
    most, held, rows = max(1, CHUNK // max(width, 1)), [], 0

    def taken():
        ids = pa.concat_arrays([h.column("vec_id") for h in held])
        return ids, np.concatenate([matrix(h.column("x"), width) for h in held])

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            if held and rows + part.num_rows > most:
                yield taken()
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if rows:
        yield taken()
