"""Helpers the operators share: words, whole-row wrapping, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aislewise.session import ship as send_package

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch between Spark and Python: texts are long, and both sides hold whole batches.
BATCH_ROWS = "1000"
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Make ready for Python tasks: send them this package, and keep their batches small."""
    send_package(spark)
    if int(spark.conf.get(_BATCHES)) > int(BATCH_ROWS):
        spark.conf.set(_BATCHES, BATCH_ROWS)


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and what it holds is
    missing to the executor's JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column) -> Column:
    """Number of words as long; null counts as no word."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def wrapped(df: DataFrame) -> DataFrame:
    """The rows as one struct column ``row``, so that no added column can clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unwrapped(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch],
                schema: str, rows: int = 512) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows, so that long texts stay few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield function(batch.slice(start, rows))
        give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def joined_batches(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``, where rows are short; none is empty."""
    held, count = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            yield pa.concat_batches(held)
            held, count = [], 0
    if held:
        yield pa.concat_batches(held)
