"""Readable names beside ids."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F


def annotate_names(df: DataFrame, entities: Mapping[str, DataFrame]) -> DataFrame:
    """Add ``*_name`` beside each ``*_id``; a name already filled is never overwritten.

    ``entities`` maps an id column to a two-column frame (id, name). The joins carry no
    broadcast hint: the measured size of the name table decides.
    """
    for id_column, names in entities.items():
        name_column = next(c for c in names.columns if c != id_column)
        lookup = names.select(id_column, F.col(name_column).alias("_name"))
        df = df.join(lookup, id_column, "left")
        known = F.col(name_column) if name_column in df.columns else F.lit(None).cast("string")
        df = df.withColumn(name_column, F.coalesce(F.nullif(known, F.lit("")), "_name")).drop(
            "_name")
    return df


def location_label(df: DataFrame) -> DataFrame:
    """Store name, else warehouse name, else a dash."""
    return df.withColumn("location_name",
                         F.coalesce("store_name", "warehouse_name", F.lit("—")))
