"""Reading, writing and describing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DateType, StructType, TimestampType


def load(spark: SparkSession, folder: str, name: str,
         schema: StructType | None = None) -> DataFrame:
    """Whole-table scan; a declared schema makes a missing column an error here."""
    df = spark.read.parquet(f"{folder}/{name}")
    if schema is None:
        return df
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise KeyError(f"{name}: missing columns {missing}")
    return normalise(df, schema)


def read_table(df: DataFrame, columns: Sequence[str] | None = None,
               where: str | Column | None = None,
               order_by: Sequence[str | Column] | None = None,
               limit: int | None = None) -> DataFrame:
    """Slice of a table. Filter and columns reach the scan; order + limit is a top-k."""
    if where is not None:
        df = df.where(where)
    if order_by:
        df = df.orderBy(*order_by)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df


def query(spark: SparkSession, text: str, tables: Mapping[str, DataFrame],
          params: Mapping[str, object] | None = None) -> DataFrame:
    """SQL with bound parameters over the given tables, named in the text as {table}."""
    return spark.sql(text, args=dict(params or {}), **tables)


def save(df: DataFrame, folder: str, name: str, partition_by: Sequence[str] = (),
         sort_by: Sequence[str] = ()) -> None:
    """Replace a table. Large logs are laid out by a low-cardinality column.

    The layout column is salted by the row's hash: a folder that holds a third of the
    rows is still written by every task. ``sort_by`` orders the rows of each file, so that the
    statistics of its row groups prune a filter on those columns.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(*partition_by, F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
        if sort_by:
            df = df.sortWithinPartitions(*partition_by, *sort_by)
        writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.parquet(f"{folder}/{name}")


def normalise(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast to the declared types; a value that does not convert becomes null."""
    out = []
    for field in schema:
        if isinstance(field.dataType, (TimestampType, DateType)):
            source = df.schema[field.name].dataType.simpleString()
            column = (F.try_to_timestamp(field.name) if source == "string"
                      else F.col(field.name))
            out.append(column.cast(field.dataType).alias(field.name))
        else:
            out.append(F.col(field.name).try_cast(field.dataType).alias(field.name))
    return df.select(*out)


def parse_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text dates to timestamps, unreadable text to null."""
    text = [c for c in columns if df.schema[c].dataType.simpleString() == "string"]
    return df.withColumns({c: F.try_to_timestamp(c) for c in text})


def table_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows"))
              .select(F.lit(name).alias("table_name"), "rows")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def key_profile(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Per column: rows, distinct values, nulls, and whether it is a unique key.

    ``approximate`` trades the exact distinct count for one pass without a shuffle
    of the values.
    """
    if approximate:
        distinct = [F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)]
        row = df.agg(F.count(F.lit(1)).alias("n"), *distinct,
                     *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)])
        parts = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("total_rows"),
                          F.col(f"d{i}").alias("distinct_values"),
                          (F.col("n") - F.col(f"c{i}")).alias("null_rows"))
                 for i, c in enumerate(columns)]
        long = row.select(F.inline(F.array(*parts)))
    else:
        # (column, value) pairs are counted first, so the distinct count is a plain
        # two-stage aggregate with no row expansion beyond the profiled columns.
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"))
            for c in columns])).alias("p")).select("p.*")
        long = (pairs.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
                .groupBy("column_name")
                .agg(F.sum("n").alias("total_rows"), F.count("v").alias("distinct_values"),
                     F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0))
                     .alias("null_rows")))
    return long.withColumn("is_unique_key", (F.col("distinct_values") == F.col("total_rows"))
                           & (F.col("null_rows") == 0))


def null_report(df: DataFrame) -> DataFrame:
    """Null count per column that has nulls, from one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rows"))
                      for c in df.columns])
    return row.select(F.inline(parts)).where("null_rows > 0")


def history(df: DataFrame, key: str, ids: DataFrame | None, order_by: Sequence[Column],
            n: int | None = None) -> DataFrame:
    """Rows of the requested ids, newest first, at most ``n`` each."""
    if ids is not None:
        df = df.join(ids.select(key).distinct(), key, "left_semi")
    if n is None:
        return df
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order_by))
    return df.withColumn("position", rank).where(F.col("position") <= n)


def filter_options(transactions: DataFrame, products: DataFrame,
                   customers: DataFrame) -> DataFrame:
    """Distinct values each dashboard filter can take, as (kind, value)."""
    def values(df: DataFrame, kind: str, column: Column) -> DataFrame:
        return (df.select(F.lit(kind).alias("kind"), column.cast("string").alias("value"))
                .where("value IS NOT NULL").distinct())

    parts = [values(products, "category", F.col("category")),
             values(transactions, "channel", F.col("channel")),
             values(customers, "region", F.col("region")),
             values(transactions, "year", F.year("transaction_date")),
             values(customers, "segment", F.col("segment"))]
    return reduce(DataFrame.unionByName, parts)


def listing(df: DataFrame, columns: Sequence[str], key: str,
            where: Column | None = None, n: int | None = None) -> DataFrame:
    """Columns of a table in key order, optionally filtered and cut to a page."""
    return read_table(df, columns, where, [key], n)
