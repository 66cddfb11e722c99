"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``CAP``, the rate closest to 1 in (bounded) entropy
among those that give each source its target number of words. The dual is convex, with one
multiplier a source: rate = CAP * sigmoid(base + multiplier * size / mean size), an exponential
tilt of the odds. Newton steps for all sources run together, each one aggregation over the table
of (source, size, documents); a bracket around each root keeps a step from leaving it. Rates are
then rounded into whole copies: source by source, from the largest size to the smallest, the
words still owed go into the next size, so a source ends within half a small document of its
target. Which documents of one size take the extra copy is decided by a hash of the id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from aislewise.llm.common import ship, unwrapped, word_count
from aislewise.session import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5          # words of the mix, as a share of all words
CAP = 2              # copies of a document, and of a source, at most
ROUNDS = 60          # Newton steps, at most
TOLERANCE = 1e-9     # of a source's target
STEEPEST = 60.0      # |multiplier * size / mean| above which a rate is 0 or CAP
BUCKET = 4096        # documents of one size ranked in one window, about


def source_targets(cells: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
                   cap: int = CAP) -> DataFrame:
    """(source, size, n) to (source, source_size, weight, target).

    Sources by code point, null last, take the weights in turn. A target stops at ``cap`` times
    the source's size and the excess goes to the others by weight, until none is above.
    """
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source, in one task
    place = F.row_number().over(order) - 1
    sources = stored(sources.withColumn(
        "weight", F.get(F.array(*[F.lit(w) for w in weights]),
                        F.pmod(place, F.lit(len(weights)))).cast("long")))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, capped = 0.0, -1
    while True:  # the level at which the weights share what the capped sources leave
        full = F.col("weight") * F.lit(level) > F.col("source_size") * cap
        spent, weight, count = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
            F.count(F.when(full, 1))).first()
        if count == capped or not weight:
            break
        capped, level = count, (total - spent) / weight
    return sources.withColumn("target", F.least(
        F.col("weight") * F.lit(float(level)), F.col("source_size").cast("double") * cap))


def _rate(tilt, cap: int):
    base = -math.log(cap - 1) if cap > 1 else 30.0
    tilt = F.least(F.greatest(tilt, F.lit(-STEEPEST)), F.lit(STEEPEST))
    return F.lit(float(cap)) / (1 + F.exp(-(tilt + F.lit(base))))


def multipliers(cells: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, multiplier, mean): the dual's solution.

    Sums are taken over decimals, so their order does not change a digit and reruns agree.
    """
    mean = cells.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    same = F.col("c.source").eqNullSafe(F.col("s.source"))
    state = targets.alias("c").join(mean.alias("s"), same).select(
        "c.source", "target", "source_size", "mean")
    # A target of 0 or of cap times the source is met by every rate at its end.
    state = stored(state.withColumn("done", (F.col("mean") <= 0) | (F.col("target") <= 0) | (
        F.col("target") >= F.col("source_size") * cap))
        .withColumn("multiplier", F.when(F.col("target") <= 0, -math.inf)
                    .when(F.col("done"), math.inf).otherwise(0.0))
        .withColumn("low", F.lit(-math.inf)).withColumn("high", F.lit(math.inf)))
    for _ in range(ROUNDS):
        scaled = F.col("size") / F.col("mean")
        rate = _rate(F.col("multiplier") * scaled, cap)
        joined = cells.alias("c").join(state.where("NOT done").alias("s"), same)
        words = F.sum((F.col("n") * F.col("size") * rate).cast("decimal(38,12)"))
        slope = F.sum((F.col("n") * F.col("size") * scaled * rate * (1 - rate / cap))
                      .cast("decimal(38,12)"))
        step = joined.groupBy("c.source").agg(words.cast("double").alias("words"),
                                              slope.cast("double").alias("slope"))
        over = F.col("words") > F.col("target")
        moved = state.alias("c").join(step.alias("s"), same, "left").select(
            "c.*", "s.words", "s.slope")
        moved = moved.withColumn("high", F.when(over, F.col("multiplier")).otherwise(F.col("high"))) \
            .withColumn("low", F.when(~over, F.col("multiplier")).otherwise(F.col("low")))
        newton = F.col("multiplier") + F.try_divide(F.col("target") - F.col("words"), F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high")) & (F.col("slope") > 0)
        middle = (F.when(F.col("low") == -math.inf, F.col("high") * 2 - 1)
                  .when(F.col("high") == math.inf, F.col("low") * 2 + 1)
                  .otherwise((F.col("low") + F.col("high")) / 2))
        good = F.abs(F.col("words") - F.col("target")) <= F.col("target") * TOLERANCE
        still = F.col("words").isNotNull() & ~good
        state = stored(moved.select(
            "source", "target", "source_size", "mean",
            (F.col("done") | ~still).alias("done"),
            F.when(still, F.when(inside, newton).otherwise(middle))
            .otherwise(F.col("multiplier")).alias("multiplier"), "low", "high"))
        if state.where("NOT done").isEmpty():
            break
    return state.select("source", "multiplier", "mean")


def _rounded(cap: int):
    """Whole copies for the cells of one source: a row per distinct size, however many documents."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False, kind="stable")
        size, n = cells["size"].to_numpy(), cells["n"].to_numpy()
        owed, copies = 0.0, np.zeros(len(cells), dtype=np.int64)
        for k, (s, m, rate) in enumerate(zip(size.tolist(), n.tolist(), cells["rate"].tolist(),
                                             strict=True)):
            owed += s * m * rate
            want = owed / s if s else m * rate
            copies[k] = min(cap * m, max(0, math.floor(want + 0.5)))
            owed -= s * float(copies[k])
        return pd.DataFrame({"source": cells["source"], "size": size, "copies": copies})

    return run

def _mixed(rows: DataFrame, narrow: DataFrame, weights: tuple, share: float,
           cap: int) -> DataFrame:
    """(row, source, size, draw) and its last three columns alone, to row, source, size,
    source_size, target and copies."""
    cells = stored(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = stored(source_targets(cells, weights, share, cap))
    solved = multipliers(cells, targets, cap)
    same = F.col("c.source").eqNullSafe(F.col("s.source"))
    rated = cells.alias("c").join(solved.alias("s"), same).select(
        "c.source", "size", "n", F.when(F.col("multiplier") == math.inf, float(cap))
        .when(F.col("multiplier") == -math.inf, 0.0)
        .otherwise(_rate(F.col("multiplier") * F.col("size") / F.col("mean"), cap)).alias("rate"))
    ship(rows.sparkSession)
    kind = cells.schema["source"].dataType.simpleString()
    copies = rated.groupBy("source").applyInPandas(  # a source's distinct sizes in one task
        _rounded(cap), f"source {kind}, size long, copies long")
    # A cell's copies are dealt over its buckets, then within a bucket by hash order.
    plan = stored(cells.alias("c").join(copies.alias("p"), F.col("c.source").eqNullSafe(
        F.col("p.source")) & (F.col("c.size") == F.col("p.size")))
        .join(targets.alias("s"), same)
        .select("c.source", "c.size", "n", "copies", "source_size", "target",
                F.ceil(F.col("n") / BUCKET).alias("buckets")))
    cell = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))

    def bucketed(some: DataFrame, cells_of: DataFrame) -> DataFrame:
        return some.alias("d").join(cells_of.alias("p"), cell).select(
            "d.*", "n", "copies", "source_size", "target",
            F.pmod(F.xxhash64("draw"), F.col("buckets")).alias("bucket"))

    counts = (bucketed(narrow, plan.where("buckets > 1"))
              .groupBy("source", "size", "bucket", "copies", "n")
              .agg(F.count(F.lit(1)).alias("in_bucket")))
    # One row per bucket of a cell, about n / BUCKET of them.
    upto = F.sum("in_bucket").over(Window.partitionBy("source", "size").orderBy("bucket"))
    part = "CAST({0} AS DECIMAL(19,0)) * CAST(copies AS DECIMAL(19,0)) div CAST(n AS DECIMAL(19,0))"
    quota = stored(counts.withColumn("upto", upto).withColumn(
        "before", F.col("upto") - F.col("in_bucket")).select(
        "source", "size", "bucket", "in_bucket",
        (F.expr(part.format("upto")) - F.expr(part.format("before"))).alias("quota")))
    joined = bucketed(rows, plan).alias("d").join(quota.alias("p"), cell & (
        F.col("d.bucket") == F.col("p.bucket")), "left").select(
        "row", "d.source", "d.size", "d.bucket", "draw", "source_size", "target",
        F.coalesce("in_bucket", "n").alias("n"), F.coalesce("quota", "copies").alias("quota"))
    place = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw"))
    whole = F.floor(F.col("quota") / F.col("n"))
    return joined.withColumn("place", place).select(
        "row", "source", "size", "source_size", "target",
        (whole + F.when(F.col("place") <= F.col("quota") - whole * F.col("n"), 1).otherwise(0))
        .cast("long").alias("copies"))


def _drawn(docs: DataFrame, row: Column, id_column: str, text_column: str,
           source_column: str) -> DataFrame:
    """(row, source, size, draw): rows that share a draw have equal ids, texts and sources."""
    columns = [F.col(f"`{c}`") for c in (id_column, text_column, source_column)]
    return docs.select(row.alias("row"), columns[2].alias("source"),
                       word_count(columns[1]).alias("size"), F.xxhash64(*columns).alias("draw"))


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            source_column: str = "source", weights: tuple = WEIGHTS, share: float = SHARE,
            cap: int = CAP) -> DataFrame:
    """As ``mix``, with the id alone in ``row``: texts are read once and never shuffled."""
    only = F.struct(F.col(f"`{id_column}`").alias(id_column))
    rows = stored(_drawn(docs, only, id_column, text_column, source_column))
    return _mixed(rows, rows.select("source", "size", "draw"), weights, share, cap)


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        source_column: str = "source", weights: tuple = WEIGHTS, share: float = SHARE,
        cap: int = CAP) -> DataFrame:
    """The rows as struct ``row`` with source, size, source_size, target and copies (0 to cap).

    Null texts have no word. A null source is a source of its own, last in the order; sources may
    be of any ordered type. Documents without words are taken by their rate too, though they add
    nothing. Repeated rows may get different numbers of copies, the same in every run. If no
    document has a word, every target is zero.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = _drawn(docs, whole, id_column, text_column, source_column)
    narrow = stored(rows.select("source", "size", "draw"))
    return _mixed(rows, narrow, weights, share, cap)


def materialise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every row as often as its copies say."""
    taken = mixed.where("copies > 0").select("row", F.explode(
        F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return unwrapped(taken, columns)
