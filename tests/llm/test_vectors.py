"""Vector codes and whitening against plain numpy, and on awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislewise.llm import codes, vectors, whitening
from aislewise.llm.common import table

FOLDER = "/root/testdata/sf0.001"
SCHEMA = ("vec_id long, embedding array<double>, label int, x string, id string, codes string, "
          "n string, error string")
NAN, INF = float("nan"), float("inf")


def plain_lloyd(x, parts, entries, rounds):
    """Rounds of whole rescans; x is (rows, parts, width)."""
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = code[:, p] == e
                if mine.any():
                    books[p, e] = x[mine, p].sum(0) // mine.sum()
    return (*assign(), books)


@pytest.mark.parametrize("parts, entries, rounds", [(4, 256, 4), (2, 7, 6), (4, 1, 2)])
def test_codes_equal_plain_lloyd(spark, parts, entries, rounds):
    df = table(spark, FOLDER, "embeddings")
    rows = df.orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows], float)).astype(np.int64)
    code, far, books = plain_lloyd(x.reshape(len(x), parts, -1), parts, entries, rounds)
    found = {r.id: r for r in codes.encode(df, parts=parts, entries=entries, rounds=rounds).collect()}
    assert [found[r.vec_id].codes for r in rows] == code.tolist()
    assert [found[r.vec_id].error for r in rows] == far.sum(1).tolist()
    assert {r.codebooks_sha256 for r in found.values()} == {codes.books_digest(books)}
    by = {}
    for r, e in zip(rows, far.sum(1).tolist(), strict=True):
        by[r.label] = by.get(r.label, 0) + e
    assert all(r.label_error == by[r.label] for r in found.values())


@pytest.mark.parametrize("seed", range(20))
def test_active_entries_give_what_a_rescan_gives(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (300, 2))            # few values: many ties
    entries = rng.integers(-3, 4, (12, 2))
    code, far, compared = codes.assign(x, entries)
    assert compared == 300 * 12
    for _ in range(4):
        moved = rng.random(12) < 0.3
        entries = np.where(moved[:, None], rng.integers(-3, 4, (12, 2)), entries)
        fresh, distance, _ = codes.assign(x, entries)
        again = int(moved[code].sum())
        code, far, compared = codes.assign(x, entries, code, far, moved)
        assert (code == fresh).all() and (far == distance).all()
        assert compared == (300 - again) * moved.sum() + again * 12 * bool(moved.any())


def test_distances_beyond_doubles_are_exact():
    x = np.array([[1 << 25, -(1 << 25), 3], [5, 7, 1 << 25]])
    wanted = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in x] for r in x]
    assert codes.distances(x, x).tolist() == wanted


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, [0.1, 0.2, -0.3, 0.4], 1), (2, None, 1), (3, [0.1, None, 0.3, 0.4], 1),
            (4, [NAN, 1.0, 2.0, 3.0], 2), (5, [INF, 1.0, 2.0, 3.0], 2), (6, [1.0, 2.0], 2),
            (7, [], None), (8, [0.5, -0.5, 0.25, -0.0001], None), (8, [0.5, -0.5, 0.25, -0.0001], None),
            (None, [0.1, 0.1, 0.1, 0.1], None), (9, [1e30, -1e30, 0.0, 1.0], 3)]
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA).repartition(3)


def test_codes_on_awkward_rows(awkward):
    found = codes.encode(awkward).collect()
    assert sorted(r.id or 0 for r in found) == [0, 1, 8, 8, 9]
    assert all(r.error == 0 and r.label_error == 0 for r in found)  # every row is an entry
    assert {tuple(r.codes) for r in found if r.id == 8} == {(1, 1, 1, 1)}
    assert next(r.codes for r in found if r.id is None) == [0, 4, 4, 4]  # 0.1 comes first in row 1
    few = codes.encode(awkward, entries=2)
    total = {r.label_error for r in few.where("label IS NULL").collect()}
    assert total == {few.where("label IS NULL").agg(F.sum("error")).first()[0]}
    assert codes.encode(awkward, parts=3).select(F.size("codes")).distinct().collect() == [(3,)]


def test_vectors_on_empty_tables(awkward):
    none = awkward.where("vec_id = -1")
    assert codes.encode(none).count() == 0 and whitening.whiten(none).count() == 0
    assert codes.encode(none).columns == codes.encode(awkward).columns
    hollow = awkward.where("vec_id = 7")
    assert [r.error for r in codes.encode(hollow).collect()] == [0]
    assert whitening.whiten(hollow).count() == 0
    assert vectors.usual_length(awkward.select(F.col("embedding").alias("x"))) == 4


def plain_whitening(x):
    n, sums = len(x), x.sum(0)
    z = x - sums / n
    value, vector = np.linalg.eigh(z.T @ z / n)
    value, vector = value[::-1], vector[:, ::-1]
    far = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return z, value, vector, far


def test_whitening_equals_a_dense_solver(spark):
    df = table(spark, FOLDER, "embeddings")
    rows = df.orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows], float)).astype(np.int64) + 100_000
    z, value, vector, far = plain_whitening(x)
    found = {(r.id, r.component): r for r in whitening.whiten(df).collect()}
    assert len(found) == 8 * len(rows)
    for c in range(1, 9):
        mine = [found[r.vec_id, c] for r in rows]
        wanted = z @ vector[:, c - 1] / np.sqrt(value[c - 1])
        got = np.array([r.whitened for r in mine])
        assert min(np.abs(got - wanted).max(), np.abs(got + wanted).max()) < 1e-10
        assert abs(mine[0].explained / (value[c - 1] / value.sum()) - 1) < 1e-12
        assert mine[0].identity_error < 1e-12 and mine[0].n == len(rows)
        assert [r.deviation for r in mine] == far


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal", "low rank", "tiny"])
def test_jacobi_davidson_reaches_double_precision(kind):
    rng = np.random.default_rng(4)
    size = 5 if kind == "tiny" else 200
    values = {"spread": 1.1 ** -np.arange(size), "clustered": 1 + 1e-3 * rng.random(size),
              "equal": np.r_[np.full(5, 3.0), np.linspace(1, 0, size - 5)] if size > 5 else None,
              "low rank": np.r_[[4.0, 2.0, 1.0], np.zeros(size - 3)] if size > 5 else None,
              "tiny": np.array([5.0, 4, 3, 2, 1])[:size]}[kind]
    turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
    a = turn * values @ turn.T
    passes = []

    def product(u):
        passes.append(u.shape[1])
        return a @ u

    value, vector, residual = whitening.jacobi_davidson(product, size, 8)
    wanted = np.sort(values)[::-1][:len(value)]
    assert len(value) == min(8, size)
    assert np.allclose(value, wanted, rtol=0, atol=1e-12 * abs(wanted[0]))
    assert residual.max() <= 200 * np.finfo(float).eps * abs(wanted[0])
    assert np.allclose(vector.T @ vector, np.eye(len(value)), atol=1e-12)
    assert max(passes) <= 40 and len(passes) < 400


def test_whitening_on_awkward_rows(spark, awkward):
    found = whitening.whiten(awkward.where("vec_id IS NULL OR vec_id <> 9")).collect()
    assert {r.n for r in found} == {4}
    assert max(r.component for r in found) == 2       # three distinct vectors span two directions
    assert max(r.identity_error for r in found) < 1e-9
    twice = {r.whitened for r in found if r.id == 8 and r.component == 1}
    assert len(twice) == 1
    equal = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)],
                                  "vec_id long, embedding array<double>")
    assert whitening.whiten(equal).count() == 0
    far = whitening.whiten(awkward.where("vec_id IN (1, 9)")).collect()
    assert far and all(r.deviation is None for r in far)
    small = np.array([[1, 2], [3, 5]])
    assert whitening.deviation(small, 2, small.sum(0)) == [4 + 9, 4 + 9]
