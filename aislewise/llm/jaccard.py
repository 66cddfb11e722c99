"""Exact Jaccard links among the members of candidate buckets."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aislewise.llm.common import ship
from aislewise.llm.shingles import key_runs
from aislewise.session import stored

LIMIT = 20_000   # nodes of a bucket compared in one task; of a larger one, pairs of blocks are


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[place] == a).sum())
    return both / (len(a) + len(b) - both)


def _prefixes(sets: list[np.ndarray], similarity: float) -> list[np.ndarray]:
    """Of each set the items one of which any set of the similarity must share, too: all but
    similarity times its size, rarest in the bucket first."""
    sizes = np.array([len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), dtype=np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    return [np.sort(part)[:len(part) - math.ceil(similarity * len(part) - 1e-9) + 1]
            for part in np.split(rank[place], np.cumsum(sizes)[:-1])]


def _run_links(nodes: np.ndarray, sets: list[np.ndarray], similarity: float,
               near: np.ndarray | None, radius: int) -> Iterator[tuple[int, int]]:
    """Links that span the components of one bucket.

    Equal sets are linked at once. Of the others, a pair is compared if its sizes, fingerprints
    and prefixes allow the similarity and it is not in one component yet; none is left out.
    """
    first: dict[bytes, int] = {}
    kept: list[int] = []
    for k, s in enumerate(sets):
        same = first.setdefault(s.tobytes(), k)
        if same == k:
            kept.append(k)
        else:
            yield int(nodes[same]), int(nodes[k])
    sets = [sets[k] for k in kept]
    nodes = nodes[kept]
    near = None if near is None else near[kept]
    label, size = np.arange(len(sets)), np.array([len(s) for s in sets])
    holders: dict[int, array] = {}
    for i, prefix in enumerate(_prefixes(sets, similarity)):
        found = [np.frombuffer(holders[r], dtype=np.int64) for r in prefix.tolist() if r in holders]
        if found:
            others = np.concatenate(found)
            others = others[label[others] != label[i]]
            fits = (np.minimum(size[others], size[i])
                    >= similarity * np.maximum(size[others], size[i]) - 1e-9)
            if near is not None:
                fits &= np.bitwise_count(near[others] ^ near[i]) <= radius
            others = np.unique(others[fits])
            while len(others):
                j, others = int(others[0]), others[1:]
                if jaccard(sets[j], sets[i]) >= similarity:
                    low, high = sorted((int(label[j]), int(label[i])))
                    label[:i + 1][label[:i + 1] == high] = low
                    others = others[label[others] != label[i]]
        del found
        for r in prefix.tolist():
            holders.setdefault(r, array("q")).append(i)
    for i in np.nonzero(label != np.arange(len(label)))[0]:
        yield int(nodes[label[i]]), int(nodes[i])


def paired(rows: DataFrame, large: DataFrame, limit: int) -> DataFrame:
    """Rows of ``large`` buckets (place, bucket, n), with ``linked`` and a node, to one row for each
    pair of blocks they are in: ``pair`` is added. Every two rows of a bucket meet in some pair,
    unless both are ``linked``; a pair holds about ``limit`` rows.

    A bucket of n rows is n / limit * 2 blocks, so its rows come as often as there are blocks of
    rows that are not linked (or, for those, of all rows).
    """
    # Blocks are numbered from 0, those of the unlinked rows first.
    sizes = (rows.groupBy("place", "bucket").agg(
        F.count_if(~F.col("linked")).alias("free"), F.count_if("linked").alias("held")))
    half = max(limit // 2, 1)
    counted = rows.join(large.select("place", "bucket"), ["place", "bucket"]).join(
        sizes.select("place", "bucket", F.ceil(F.col("free") / half).alias("free"),
                     F.ceil(F.col("held") / half).alias("held")), ["place", "bucket"])
    own = F.when(F.col("linked"), F.col("free") + F.pmod(F.xxhash64("node"), F.col("held"))
                 ).otherwise(F.pmod(F.xxhash64("node"), F.col("free")))
    # A linked row meets the unlinked blocks only.
    last = F.when(F.col("linked"), F.col("free")).otherwise(F.col("free") + F.col("held"))
    met = counted.withColumn("own", own).where(last > 0).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)))
    total = F.col("free") + F.col("held")
    return met.withColumn("pair", F.least("own", "other") * total + F.greatest("own", "other")
                          ).drop("own", "other", "free", "held")


def verified_links(met: DataFrame, sets: DataFrame, similarity: float, radius: int = 64,
                   limit: int = LIMIT) -> DataFrame:
    """(place, bucket, node[, fp]) and (node, items) to links (a, b) of nodes of Jaccard
    ``similarity``. ``met`` should be stored: it is read more than once.

    ``items`` are hashes, sorted and without repeats; a node may come more than once in a bucket.
    With ``fp``, pairs whose fingerprints differ in more than ``radius`` bits are passed over.

    A bucket above ``limit`` nodes is never in one task. Each of its nodes is first compared with
    the smallest one, by a join; then pairs of blocks are compared, but for pairs of nodes that are
    both linked to the smallest. Nothing else is left out.
    """
    fingerprinted = "fp" in met.columns
    columns = ["place", "bucket", "node", *(["fp"] if fingerprinted else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in key_runs(batches, 3):
            node = table.column("node").to_numpy()
            fps = table.column("fp").to_numpy().view(np.uint64) if fingerprinted else None
            items = table.column("items").combine_chunks()
            offsets, values = items.offsets.to_numpy(), items.values.to_numpy()
            links: list[tuple[int, int]] = []
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if high - low < 2:
                    continue
                _, first = np.unique(node[low:high], return_index=True)
                if len(first) > 1:
                    at = low + first
                    links += _run_links(node[at], [values[offsets[k]:offsets[k + 1]] for k in at],
                                        similarity, fps[at] if fingerprinted else None, radius)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                                 names=["a", "b"])

    def compared(rows: DataFrame) -> DataFrame:
        ordered = (rows.select("place", "bucket", "pair", *columns[2:], "items")
                   .repartition("place", "bucket", "pair")
                   .sortWithinPartitions("place", "bucket", "pair"))
        return ordered.mapInArrow(run, "a long, b long")

    ship(met.sparkSession)
    # At most one bucket for every ``limit`` rows, so these tables are small.
    large = stored(met.groupBy("place", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where(F.col("n") > limit))
    zero = F.lit(0).cast("long").alias("pair")
    if large.isEmpty():
        return compared(met.join(sets, "node").select(*columns, "items", zero))
    sets = stored(sets)
    small = met.join(large, ["place", "bucket"], "left_anti")
    pivots = large.join(sets, large.pivot == sets.node).select(
        "place", "bucket", "pivot", F.col("items").alias("pivot_items"))
    if fingerprinted:
        pivots = pivots.join(met.select("node", "fp").distinct(),
                             F.col("pivot") == F.col("node")).select(
            "place", "bucket", "pivot", "pivot_items", F.col("fp").alias("pivot_fp"))
    both = F.size(F.array_intersect("items", "pivot_items"))
    # The same floating-point division as in ``jaccard``; two empty sets are equal.
    every = F.size("items") + F.size("pivot_items") - both
    like = F.when(every == 0, F.lit(True)).otherwise(both / every >= similarity)
    if fingerprinted:
        like &= F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot_fp"))) <= radius
    star = stored(met.select(columns).distinct().join(pivots, ["place", "bucket"])
                  .join(sets, "node").select(*columns, "pivot", like.alias("linked")))
    rows = paired(star, large, limit).select(*columns, "pair").join(sets, "node")
    return (compared(small.select(*columns, zero).join(sets, "node")).unionByName(compared(rows))
            .unionByName(star.where("linked AND node <> pivot").select(
                F.col("pivot").alias("a"), F.col("node").alias("b"))))
