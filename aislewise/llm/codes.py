"""Vector code compression: a product quantiser trained by active-entry Lloyd rounds.

Vectors of integers are cut into ``parts`` equal consecutive parts, each with a codebook of
``entries`` integer entries. After an update only some entries have moved. A part whose assigned
entry stayed fixed keeps its stored distance, which is exact, and its entry is still the nearest of
all that stayed; so it is compared with the moved entries alone. A part whose entry moved is
compared with all. Distances are integers, ties go to the lower index, and the result equals that
of plain Lloyd rounds.

The state (vector, codes, distances) is a table in the shared folder, written anew by each round;
entries, at most ``parts * entries`` of them, are all that the driver and the tasks hold besides.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aislewise.llm.common import map_batches
from aislewise.llm.vectors import floored, matrix, summed, usable, usual_length
from aislewise.session import released, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
_EXACT = 1 << 52


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two integer matrices, exact."""
    if not x.size or not c.size:
        return np.zeros((len(x), len(c)), dtype=np.int64)
    bound = int(np.abs(x).max()) * int(np.abs(c).max()) * x.shape[1]
    if bound < _EXACT:  # every partial sum is an integer that a double holds
        cross = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        cross = x @ c.T
    return (x * x).sum(1)[:, None] - 2 * cross + (c * c).sum(1)[None, :]


def assign(x: np.ndarray, entries: np.ndarray, code: np.ndarray | None = None,
           stored_distance: np.ndarray | None = None, moved: np.ndarray | None = None
           ) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of every row, its distance, and how many distances were computed.

    With ``code`` and ``stored_distance`` from before and the mask of the entries that have
    ``moved`` since, only what can change is compared.
    """
    if code is None:
        full = distances(x, entries)
        best = full.argmin(1)
        return best, full[np.arange(len(x)), best], full.size
    code, kept = code.copy(), stored_distance.copy()
    again = np.nonzero(moved[code])[0]
    compared = 0
    active = np.nonzero(moved)[0]
    if len(active):
        fixed = np.nonzero(~moved[code])[0]
        some = distances(x[fixed], entries[active])
        compared += some.size
        nearest = some.argmin(1)
        value, index = some[np.arange(len(fixed)), nearest], active[nearest]
        better = (value < kept[fixed]) | ((value == kept[fixed]) & (index < code[fixed]))
        code[fixed[better]], kept[fixed[better]] = index[better], value[better]
        full = distances(x[again], entries)
        compared += full.size
        best = full.argmin(1)
        code[again], kept[again] = best, full[np.arange(len(again)), best]
    return code, kept, compared


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """(id, label, x[, codes, distances]) with codes and distances for the given entries."""
    parts, _, width = books.shape

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch.column(2), parts * width)
        before = None if moved is None else (matrix(batch.column(3), parts),
                                             matrix(batch.column(4), parts))
        codes, far = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
        for p in range(parts):
            part = x[:, p * width:(p + 1) * width]
            old = () if before is None else (before[0][:, p], before[1][:, p], moved[p])
            codes[:, p], far[:, p], _ = assign(part, books[p], *old)
        ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.ListArray.from_arrays(ends, pa.array(codes.ravel())),
             pa.ListArray.from_arrays(ends, pa.array(far.ravel()))],
            names=["id", "label", "x", "codes", "distances"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return map_batches(rows, run, f"id {kinds['id']}, label {kinds['label']}, x array<long>, "
                                  "codes array<long>, distances array<long>", 4096)


def updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the componentwise floor of its parts' mean; unused entries as they were."""
    parts, entries, width = books.shape

    def values(batch: pa.RecordBatch) -> np.ndarray:
        x, codes = matrix(batch.column(0), parts * width), matrix(batch.column(1), parts)
        out = np.zeros((parts * entries, width + 1), dtype=np.int64)
        for p in range(parts):
            place = p * entries + codes[:, p]
            np.add.at(out, (place, slice(0, width)), x[:, p * width:(p + 1) * width])
            out[:, width] += np.bincount(place, minlength=len(out))
        return out

    sums = summed(state.select("x", "codes"), values, "long").reshape(parts, entries, width + 1)
    counts = sums[:, :, width:]
    return np.where(counts > 0, sums[:, :, :width] // np.maximum(counts, 1), books)


def first_entries(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """The parts of the rows with the smallest ids; fewer where there are fewer rows."""
    first = (rows.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries)
             .collect())  # at most ``entries`` rows
    x = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), parts, width)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers."""
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(rows: DataFrame, parts: int, entries: int, rounds: int, width: int
          ) -> tuple[DataFrame, np.ndarray]:
    """(id, label, x) to the state after the last assignment, and the codebooks."""
    books = first_entries(rows, parts, entries, width)
    state = stored(_assigned(rows, books, None))
    for _ in range(rounds):
        new = updated(state, books)
        moved = (new != books).any(2)
        if moved.any():
            before, state = state, stored(_assigned(state, new, moved))
            released(before)
        books = new
    return state, books


def encode(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
           label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES,
           rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per usable vector: id, label, codes (array of long, by part), error, label_error,
    codebooks_sha256.

    Vectors that are null or hold a null or non-finite component are left out, and so are vectors
    whose length is not the usual one. A length that ``parts`` does not divide is filled up with
    zeros. Components count as integers floor(scale * x), cut to 2**25. Repeated rows all stay;
    equal ids are ordered by their vectors and a null id is last among the first entries. With
    fewer rows than ``entries`` a codebook is as small. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = stored(vectors.where(usable(F.col(vector_column))).select(
        F.col(id_column).alias("id"), F.col(label_column).alias("label"),
        floored(F.col(vector_column), scale).alias("x")))
    length = usual_length(rows)
    width = -(-length // parts)
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), parts * width - length))
    rows = rows.where(F.size("x") == length).withColumn("x", filled if length % parts else F.col("x"))
    if length:
        state, books = train(rows, parts, entries, rounds, width)
        digest = books_digest(books)
    else:  # no vector, or none with a component
        zeros = F.array_repeat(F.lit(0).cast("long"), parts)
        state = rows.withColumn("codes", zeros).withColumn("distances", zeros)
        digest = sha256(b"").hexdigest()
    error = F.aggregate("distances", F.lit(0).cast("long"), lambda a, d: a + d)
    each = state.select("id", "label", "codes", error.alias("error"))
    # One row per label: summed before the shuffle, and as wide as the labels differ.
    labels = each.groupBy("label").agg(F.sum("error").alias("label_error"))
    return each.alias("e").join(labels.alias("l"), F.col("e.label").eqNullSafe(F.col("l.label"))
                                ).select("e.id", "e.label", "codes", "error", "label_error",
                                         F.lit(digest).alias("codebooks_sha256"))


def code_string(codes: Column) -> Column:
    """Codes below 256 as two lower-case hex digits each."""
    return F.lower(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 2, "0")), ""))
