"""Exact deduplication that splits frequent texts from the rest.

Texts are equal when their SHA-256 digests are. A Misra-Gries summary (Spark's frequent-items
sketch) names the digests that may be frequent. Each is verified by an exact count; the verified
ones, at most ``TOP`` rows, are broadcast, so that the copies of a frequent text are decided where
they are read and never meet in one task. The other digests take an ordinary shuffle; none of
them can hold more than one row in ``TOP``, give or take the summary's error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aislewise.llm.common import text_or_empty, unwrapped, wrapped
from aislewise.session import stored

TOP = 1000       # frequent digests that are broadcast, at most
TRACKED = 8192   # counters of the summary
COPIES = 2       # a digest counts as frequent from this many rows


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256))


def frequent(digests: DataFrame, top: int = TOP, tracked: int = TRACKED) -> DataFrame:
    """(digest, keep_id, group_size) of the frequent digests of (id, digest): at most ``top`` rows
    or, were two digests to share their first 64 bits of hash, those with them."""
    candidates = (digests.agg(F.expr(f"approx_top_k(xxhash64(digest), {top}, {tracked})")
                              .alias("found"))
                  .select(F.explode("found.item").alias("candidate")))
    exact = (digests.join(F.broadcast(candidates),
                          F.xxhash64("digest") == F.col("candidate"), "left_semi")
             .groupBy("digest").agg(F.max("id").alias("keep_id"),
                                    F.count(F.lit(1)).alias("group_size")))
    return exact.where(F.col("group_size") >= COPIES)


def _best_first() -> Window:
    return Window.partitionBy("digest").orderBy(F.col("id").desc_nulls_last())


def duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               top: int = TOP, tracked: int = TRACKED) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest (binary SHA-256).

    Of equal texts the row with the largest id stays; a null id is smaller than any other. Of
    rows that repeat that id too, exactly one is kept. A null text equals an empty one. An empty
    table gives an empty result; other columns are ignored.
    """
    digests = stored(docs.select(F.col(id_column).alias("id"),
                                 _digest(F.col(text_column)).alias("digest")))
    winners = stored(frequent(digests, top, tracked))
    marked = digests.join(F.broadcast(winners), "digest", "left")
    hot, rest = marked.where("group_size IS NOT NULL"), marked.where("group_size IS NULL")
    won = F.col("id").eqNullSafe(F.col("keep_id"))
    everyone = Window.partitionBy("digest")
    first = F.row_number().over(_best_first()) == 1
    parts = [
        hot.where(~won).withColumn("kept", F.lit(False)),
        hot.where(won).withColumn("kept", first),
        rest.withColumn("keep_id", F.max("id").over(everyone))
        .withColumn("group_size", F.count(F.lit(1)).over(everyone)).withColumn("kept", first)]
    columns = ["id", "keep_id", "group_size", "kept", "digest"]
    return parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(
        parts[2].select(columns))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                top: int = TOP, tracked: int = TRACKED) -> DataFrame:
    """The rows that ``duplicates`` keeps, with all their columns.

    Copies of a frequent text leave before the shuffle; only the other rows are shuffled.
    """
    digests = stored(docs.select(F.col(id_column).alias("id"),
                                 _digest(F.col(text_column)).alias("digest")))
    winners = stored(frequent(digests, top, tracked))
    rows = wrapped(docs).select("row", F.col(f"row.`{id_column}`").alias("id"),
                                _digest(F.col(f"row.`{text_column}`")).alias("digest"))
    left = (rows.join(F.broadcast(winners), "digest", "left")
            .where(F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))))
    return unwrapped(left.withColumn("place", F.row_number().over(_best_first()))
                     .where("place = 1"), docs.columns)
