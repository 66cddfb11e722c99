"""Toxicity scores: the network of ``recurrent`` over all overlapping windows of whole texts.

Learning reads a bounded sample: at most ``POSITIVES`` and ``NEGATIVES`` labelled documents, in the
order of a hash of their id, and at most ``BAG`` windows of each, evenly spread. It is collected
(some 10 MB) and the network, a few hundred kilobytes, is trained in numpy on the driver. A fifth of
the sample is left out of the fit; the largest window logits of those documents fix the two numbers
of a logistic calibration. Scoring reads every window of every document, in Spark tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from aislewise.llm import recurrent
from aislewise.llm.common import map_batches, text_or_empty
from aislewise.session import stored

POSITIVES, NEGATIVES = 1200, 2400   # labelled documents of the sample, at most
BAG = 16                            # windows of a document in the sample, at most
THRESHOLD = 0.7
FOLDS = 3                           # crc32 of the id, modulo; 1 is held out of all learning
HELD_OUT = 1
CALIBRATING = 5                     # every so many-th document of the sample calibrates


def fold(id_column: str | Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; a null id counts as empty text."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")),
                  F.lit(FOLDS))


def windows(raw: bytes, limit: int) -> list[bytes]:
    """At most ``limit`` windows of a text, evenly spread: lower-case tokens joined by a space."""
    raw = raw.lower()
    starts, ends = recurrent.token_spans(raw)
    first = recurrent.window_starts(len(starts))
    if len(first) > limit:
        first = first[np.linspace(0, len(first) - 1, limit).astype(np.int64)]
    return [b" ".join(raw[a:b] for a, b in zip(starts[k:k + recurrent.WIDTH],
                                               ends[k:k + recurrent.WIDTH], strict=True))
            for k in first.tolist()]


def sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES,
           negatives: int = NEGATIVES, bag: int = BAG) -> DataFrame:
    """(id, text) and (id, y) to the documents that are learned from: y, share (labelled documents
    that each stands for), part, windows. Held-out ids and null labels are never read."""
    usable = labels.where(F.col("y").isNotNull() & F.col("id").isNotNull()
                          & (fold("id") != HELD_OUT)).select("id", (F.col("y") > 0).alias("y"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = [usable.where(which).orderBy(*order).limit(most)
              for which, most in ((F.col("y"), positives), (~F.col("y"), negatives))]
    both = stored(chosen[0].unionByName(chosen[1]))
    sizes = usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).join(
        both.groupBy("y").agg(F.count(F.lit(1)).alias("taken")), "y").select(
        "y", (F.col("n") / F.col("taken")).alias("share"))
    rows = docs.join(F.broadcast(both.join(sizes, "y")), "id")  # at most positives + negatives

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [windows(raw, bag) for raw in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(found, pa.list_(pa.binary()))],
            names=["y", "share", "part", "windows"])

    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(CALIBRATING)).cast("int").alias("part")
    return map_batches(
        rows.select("y", "share", part, text_or_empty("text").cast("binary").alias("text")), run,
        "y boolean, share double, part int, windows array<binary>", 64)


@dataclass
class Model:
    """What a score needs; a few hundred kilobytes."""

    network: recurrent.Network | None   # None: nothing to learn from
    slope: float = 1.0
    offset: float = 0.0

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1; 0.5 where there was nothing to learn from."""
        if self.network is None:
            return np.full(len(texts), 0.5)
        value = self.slope * recurrent.logits(self.network, texts) + self.offset
        return 0.5 * (1 + np.tanh(0.5 * value))


def calibrate(logit: np.ndarray, y: np.ndarray, weight: np.ndarray,
              ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps; held near (1, 0) by ``ridge``.

    Logits are cut to (-20, 20). The slope is not negative, so a larger logit never scores lower.
    """
    x = np.stack([np.clip(logit, -20, 20), np.ones(len(logit))])
    at, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    weight = weight / max(weight.sum(), 1e-12) * len(weight)

    def loss(v: np.ndarray) -> float:
        z = v @ x
        return float((weight * (np.logaddexp(0, z) - y * z)).sum()
                     + ridge * ((v - start) ** 2).sum() / 2)

    for _ in range(50):
        p = 0.5 * (1 + np.tanh(0.5 * (at @ x)))
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + ridge * np.eye(2),
                               x @ (weight * (p - y)) + ridge * (at - start))
        size = 1.0
        while loss(at - size * step) > loss(at) and size > 1e-6:
            size /= 2
        at = at - size * step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(at[0]), 0.0), float(at[1])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES,
          negatives: int = NEGATIVES, bag: int = BAG) -> Model:
    """(id, text) and (id, y) to a model. Without a document of each label every score is 0.5."""
    # Ordered, so that the same sample gives the same network whatever the partitions were.
    rows = sorted(sample(docs, labels, positives, negatives, bag).collect(),
                  key=lambda r: (r["part"], r["y"], r["windows"]))
    fitting = [r for r in rows if r["part"] > 0]
    if len({r["y"] for r in fitting}) < 2:
        return Model(None)
    bags = recurrent.Bags.of([r["windows"] for r in fitting],
                             np.array([r["y"] for r in fitting], dtype=float))
    model = Model(recurrent.fit(bags))
    rest = [r for r in rows if r["part"] == 0]
    if len({r["y"] for r in rest}) == 2:
        y = np.array([r["y"] for r in rest], dtype=float)
        found = recurrent.Bags.of([r["windows"] for r in rest], y).best(model.network)
        model.slope, model.offset = calibrate(found, y, np.array([r["share"] for r in rest]))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(id, text) to (id, score); texts stay in their partitions."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(model.score(batch.column(1).to_pylist()))],
            names=["id", "score"])

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs.select("id", text_or_empty("text").cast("binary").alias("text")), run,
                       f"id {kind}, score double", 256)


def assess(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
           text_column: str = "text", label_column: str = "toxic",
           threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Only the text enters a score. Null and empty texts are scored as one empty window; repeated
    rows all stay; a label above 0 is toxic; a document without an id is never learned from. An
    empty table gives an empty result; other columns are ignored.
    """
    named = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    model = train(named, labels.select(F.col(id_column).alias("id"),
                                       F.col(label_column).alias("y")))
    return scored(named, model).select(
        "id", (fold("id") == HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
