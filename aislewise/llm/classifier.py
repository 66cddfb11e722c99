"""Quality classifier: random Fourier features, ridge by partition sums, isotonic calibration.

A document is described by ``STATISTICS`` of its whole text. ``FEATURES`` cosine features
approximate a Gaussian kernel over the standardised statistics. Every partition adds up its part
of the normal equations; Spark adds the parts, and only the sums, whose size depends on
``FEATURES`` alone, reach the driver. Part of the training rows is left out of the fit; its ridge
scores, counted in ``BINS`` bins, give the isotonic curve that turns a score into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from aislewise.llm.common import give_back, map_batches, ship, text_or_empty
from aislewise.session import stored

STATISTICS = [
    "log_bytes", "log_words", "log_lines", "word_bytes", "upper", "digits", "symbols",
    "exclamations", "stops", "bars", "word_variety", "window_variety", "top_word", "same_next",
    "line_variety", "words_a_line", "marked_words", "capital_words", "long_words"]
FEATURES = 256
WIDTH = 1.0          # of the kernel, in units of the root of the number of statistics
RIDGE = 1e-3         # times the number of rows
SEED = 17
BINS, LOW, HIGH = 1024, -0.5, 1.5
THRESHOLD = 0.3
FOLDS = 5            # crc32 of the id, modulo; 0 is held out of all learning, the last calibrates
_SYMBOLS, _MARKS = b"#*$%&|<>", b"#*$%&|<>!"


def statistics(raw: bytes) -> list[float]:
    """The statistics of one UTF-8 text; an empty text has all zero."""
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, n = len(raw), len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counted = Counter(words)
    windows = len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2)
    of = lambda letters: float(codes[list(letters)].sum()) / size
    marked = sum(c for w, c in counted.items() if w[-1] in _MARKS) / n
    capital = sum(c for w, c in counted.items() if w.isupper() and len(w) > 1) / n
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    return [
        np.log1p(size), np.log1p(n), np.log1p(len(lines)), (size - n) / n,
        float(codes[65:91].sum()) / size, float(codes[48:58].sum()) / size, of(_SYMBOLS),
        of(b"!"), of(b"."), of(b"|"), len(counted) / n, min(1.0, windows),
        max(counted.values()) / n, same, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        marked, capital, sum(c for w, c in counted.items() if len(w) > 12) / n]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(id, text) to (id, x); null texts count as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(raw) for raw in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs.select("id", text_or_empty("text").cast("binary").alias("text")), run,
                       f"id {kind}, x array<double>")


@dataclass
class Model:
    """What a score needs; a few hundred numbers."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None   # None: no label to learn from
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Cosine features and a constant."""
        rng = np.random.default_rng(SEED)
        size = x.shape[1]
        turn = rng.normal(size=(size, FEATURES)) / (WIDTH * np.sqrt(size))
        shift = rng.uniform(0, 2 * np.pi, FEATURES)
        scaled = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.cos(scaled @ turn + shift) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; 0.5 where there was nothing to learn from."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = self.ridge(x)
        return np.clip(raw if self.curve is None else np.interp(raw, *self.curve), 0.0, 1.0)


def fold(id_column: str | Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; a null id counts as empty text."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")),
                  F.lit(FOLDS))


def _standard(rows: DataFrame) -> Model:
    size = len(STATISTICS)
    sums = rows.agg(*[F.avg(F.get("x", F.lit(k))) for k in range(size)],
                    *[F.stddev_pop(F.get("x", F.lit(k))) for k in range(size)]).first()
    values = np.array([v if v is not None else 0.0 for v in sums])
    return Model(values[:size], np.where(values[size:] > 1e-9, values[size:], 1.0))


def _fit(rows: DataFrame, model: Model) -> np.ndarray | None:
    """Ridge weights from the summed normal equations of (x, y)."""
    size = FEATURES + 1
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, right, count = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column(0).to_pylist(), dtype=float))
                square += z.T @ z
                right += z.T @ batch.column(1).to_numpy()
                count += batch.num_rows
        if count:
            values = np.r_[square[upper], right, count]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)],
                names=["k", "value"])

    ship(rows.sparkSession)
    parts = rows.select("x", F.col("y").cast("double").alias("y")).mapInArrow(
        run, "k int, value double")
    summed = parts.groupBy("k").agg(F.sum("value").alias("value")).toPandas()  # one row per k
    if summed.empty:
        return None
    values = summed.sort_values("k")["value"].to_numpy()
    square = np.zeros((size, size))
    square[upper] = values[:len(upper[0])]
    square = square + square.T - np.diag(np.diag(square))
    right, count = values[len(upper[0]):-1], values[-1]
    return np.linalg.solve(square + RIDGE * count * np.eye(size), right)


def pool_adjacent(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic regression of values in order."""
    blocks: list[list[float]] = []
    for value, w in zip(y, weight, strict=True):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            total = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _curve(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray] | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.ridge(np.array(batch.column(0).to_pylist(), dtype=float))
                yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column(1)],
                                                 names=["raw", "y"])

    ship(rows.sparkSession)
    scored = rows.select("x", F.col("y").cast("double").alias("y")).mapInArrow(
        run, "raw double, y double")
    place = F.floor((F.col("raw") - LOW) / (HIGH - LOW) * BINS)
    bins = (scored.groupBy(F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)).alias("bin"))
            .agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("y").alias("n"))
            .toPandas().sort_values("bin"))  # at most BINS rows
    if bins.empty:
        return None
    return bins["raw"].to_numpy(), pool_adjacent(bins["y"].to_numpy(), bins["n"].to_numpy(float))


def train(described: DataFrame, labels: DataFrame) -> Model:
    """(id, x) and (id, y) to a model. Labels of fold 0 and null labels are never read.

    Without a training label every score is 0.5; without one in the calibrating fold the ridge
    score is only clipped. A repeated id counts as often as it comes.
    """
    usable = labels.where(F.col("y").isNotNull() & (fold("id") != 0))
    rows = stored(described.join(usable, "id").select("x", "y", fold("id").alias("fold")))
    fitting, calibrating = rows.where(F.col("fold") != FOLDS - 1), rows.where(
        F.col("fold") == FOLDS - 1)
    model = _standard(fitting)
    model.weights = _fit(fitting, model)
    if model.weights is not None:
        model.curve = _curve(calibrating, model)
    return model


def scored(described: DataFrame, model: Model) -> DataFrame:
    """(id, x) to (id, score)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))],
                                          names=["id", "score"])

    kind = described.schema["id"].dataType.simpleString()
    return map_batches(described.select("id", "x"), run, f"id {kind}, score double", 8192)


def score_column(text: Column, model: Model) -> Column:
    """The score of a text column, computed where the rows are."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd
        rows = np.array([statistics(raw) for raw in texts], dtype=float)
        scores = pd.Series(model.score(rows.reshape(-1, len(STATISTICS))))
        give_back()
        return scores

    return score(text_or_empty(text).cast("binary"))


def assess(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
           text_column: str = "text", label_column: str = "quality",
           threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Only the text enters a score. Null and empty texts are scored like any other; repeated rows
    all stay; an empty table gives an empty result; other columns are ignored.
    """
    named = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    described = stored(document_statistics(named))
    model = train(described, labels.select(F.col(id_column).alias("id"),
                                           F.col(label_column).alias("y")))
    return scored(described, model).select(
        "id", (fold("id") == 0).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
              text_column: str = "text", label_column: str = "quality",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows that ``assess`` predicts as 1, with all their columns; texts are not shuffled."""
    ship(docs.sparkSession)
    named = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    labelled = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("y"))
    model = train(document_statistics(named), labelled)
    return docs.where(score_column(F.col(text_column), model) >= threshold)
