"""Vectors as Spark and numpy see them: cleaning, whole blocks of rows, and sums over a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from aislewise.llm.common import give_back, ship

LARGEST = 1 << 25  # integer components are cut to this size, so that products stay exact


def usable(vector: str | Column) -> Column:
    """True for a vector without null or non-finite entries; false for a null vector."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                      & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def floored(vector: str | Column, scale: int = 1024, offset: int = 0,
            largest: int = LARGEST) -> Column:
    """floor(scale * component) + offset, as array of long; sizes above ``largest`` are cut."""
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(
        c.cast("double") * scale, F.lit(-float(largest))), F.lit(float(largest)))) + F.lit(offset))


def usual_length(df: DataFrame, column: str = "x") -> int:
    """The length that most vectors have, the larger one in a tie; 0 for an empty table."""
    found = (df.groupBy(F.size(column).alias("length")).count()
             .orderBy(F.desc("count"), F.desc("length")).first())
    return found["length"] if found else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(df: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray],
           kind: str = "double") -> np.ndarray | None:
    """The sum over all batches of the matrix ``values`` gives for each; None for an empty table.

    A task adds up its batches and sends one row per matrix row; Spark adds the tasks' rows. What
    is shuffled and reaches the driver has the size of the matrix, whatever the table's.
    """
    shape = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = values(batch)
                total = part if total is None else total + part
        if total is not None:
            total = np.atleast_2d(total).astype(shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.ListArray.from_arrays(
                    pa.array(np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]),
                    pa.array(total.ravel()))], names=["k", "v"])
        give_back()

    ship(df.sparkSession)
    rows = (df.mapInArrow(run, f"k int, v array<{kind}>")
            .select("k", F.posexplode("v").alias("j", "v"))
            .groupBy("k", "j").agg(F.sum("v").alias("v")).toPandas())
    if rows.empty:
        return None
    out = np.zeros((rows["k"].max() + 1, rows["j"].max() + 1), dtype=shape)
    out[rows["k"].to_numpy(), rows["j"].to_numpy()] = rows["v"].to_numpy()
    return out
