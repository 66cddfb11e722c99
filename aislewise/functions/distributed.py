"""Ordered aggregates that never gather a whole group in one task.

A running total or an exact quantile needs a global order. A plain window would
sort a group in a single task, which fails when one group holds a third of the
rows. Here the rows are cut into key ranges first; each range is summed, the few
range totals are accumulated, and every range then adds its own offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from aislewise.functions.scalars import half_up, pinned
from aislewise.session import stored

MIN_FAN, MAX_FAN = 8, 32   # ranges of one level of the search
ROWS = 1 << 20             # of a range, about; more rows take more ranges
PER_RANGE = 16             # keys looked at per range to choose the cut points


def _shape(df: DataFrame) -> tuple[int, int]:
    """Levels and fan: fan ** levels ranges occupy the cluster's shuffle partitions and hold about
    ``ROWS`` rows each. A third level is for more than ``MAX_FAN ** 2`` ranges."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(parts, -(-df.count() // ROWS))
    levels = 2 if wanted <= MAX_FAN ** 2 else 3
    fan = next((f for f in range(MIN_FAN, MAX_FAN) if f ** levels > wanted), MAX_FAN)
    return levels, fan


def _with_range(df: DataFrame, key: Column) -> DataFrame:
    """Add ``_range``, the number of the key range a row falls in. ``df`` should be stored: it is
    counted and read for its keys first.

    The cut points come from the keys with the smallest hash: a bounded top-k that any re-run
    repeats exactly. They only balance the work; the result does not depend on them.
    """
    levels, fan = _shape(df)
    ranges = fan ** levels
    picked = (df.select(key.alias("key"))
              .orderBy(F.xxhash64("key"), "key").limit(ranges * PER_RANGE)
              .agg(F.sort_array(F.collect_list("key")).alias("keys")))
    cuts = picked.select(F.slice(F.filter(
        "keys", lambda k, i: i % PER_RANGE == PER_RANGE - 1), 1, ranges - 1)
        .alias("cuts")).scalar()

    searched = pinned(df, _cuts=cuts, _key=key, _level0=F.lit(0))
    for level in range(levels):
        step = fan ** (levels - 1 - level)
        # How many of fan - 1 cuts the key has reached; past the end ``get`` is null.
        passed = reduce(lambda a, b: a + b, [
            F.when(F.get("_cuts", F.col(f"_level{level}") + step * (n + 1) - 1) <= F.col("_key"),
                   step).otherwise(0) for n in range(fan - 1)])
        searched = pinned(searched, **{f"_level{level + 1}": F.col(f"_level{level}") + passed})
    return searched.withColumnRenamed(f"_level{levels}", "_range").drop(
        "_cuts", "_key", *[f"_level{k}" for k in range(levels)])


def running_total(df: DataFrame, order: list[Column], value: str,
                  group: tuple[str, ...] = ()) -> DataFrame:
    """Add ``running`` (inclusive) and ``total`` of ``value`` per group.

    ``order`` must make every row of a group distinct. Group columns must not be
    null. The rows are read three times below, so they are written out first.
    """
    key = F.struct(*[F.col(g) for g in group],
                   *[o.alias(f"o{i}") for i, o in enumerate(order)])
    ranged = _with_range(stored(df), key)
    by_range = Window.partitionBy(*group).orderBy("_range")
    offsets = (ranged.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
               .withColumn("_offset", F.coalesce(
                   F.sum("_sum").over(by_range.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)))
               .withColumn("total", F.sum("_sum").over(Window.partitionBy(*group)))
               .drop("_sum"))
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    return (ranged.join(offsets, [*group, "_range"])
            .withColumn("running", F.col("_offset") + F.sum(value).over(
                inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .drop("_range", "_offset"))


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float],
                    group: tuple[str, ...] = ()) -> DataFrame:
    """Linearly interpolated quantiles, one column per entry of ``probs``.

    Rounded to six decimals, so that a value equal to an edge compares as equal.
    """
    keep = F.col(value).isNotNull()
    for g in group:
        keep = keep & F.col(g).isNotNull()
    counted = (df.where(keep)
               .groupBy(*group, F.col(value).cast("double").alias("_v"))
               .agg(F.count(F.lit(1)).alias("_n")))
    ranked = (running_total(counted, [F.col("_v")], "_n", group)
              .withColumn("_start", F.col("running") - F.col("_n")))

    def at(position: Column) -> Column:
        here = (F.col("_start") <= position) & (position < F.col("running"))
        return F.max(F.when(here, F.col("_v")))

    aggregates = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("total") - 1)
        low = F.floor(position)
        high = F.least(low + 1, F.col("total") - 1)
        aggregates += [at(low).alias(f"{name}_lo"), at(high).alias(f"{name}_hi"),
                       F.max(position - low).alias(f"{name}_f")]
    found = ranked.groupBy(*group).agg(*aggregates)
    return found.select(*group, *[
        half_up(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_f"), 6)
        .alias(n) for n in probs])
