"""Result columns in the plain types every engine shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Dates as ISO text, flags and integers as bigint, other numbers as double."""
    out = []
    for field in df.select(*columns).schema if columns else df.schema:
        c, kind = F.col(field.name), field.dataType.simpleString()
        if kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("boolean", "int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind.startswith(("decimal", "float")):
            c = c.cast("double")
        elif kind.startswith("array<string>"):
            c = F.array_join(c, "; ")
        out.append(c.alias(field.name))
    return df.select(*out)
