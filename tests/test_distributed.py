"""Ordered aggregates and neighbour search against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from aislewise.functions import distributed, similarity
from aislewise.functions.distributed import exact_quantiles, running_total
from aislewise.functions.scalars import (clip, cut, half_up, haversine_km, normal_quantile,
                                         quantile_bin, rate_mean)
from aislewise.operators import customers as K


def test_running_total_with_one_hot_group(spark, frame):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, rng.randint(0, 4)) for i in range(3000)]
    got = running_total(frame("g string, id long, v long", *rows),
                        [-F.col("v"), F.col("id")], "v", ("g",)).collect()
    expected = {}
    for g, members in itertools.groupby(sorted(rows, key=lambda r: (r[0], -r[2], r[1])),
                                        key=lambda r: r[0]):
        members, acc = list(members), 0
        for _, i, v in members:
            acc += v
            expected[i] = (acc, sum(m[2] for m in members))
    assert {r["id"]: (r["running"], r["total"]) for r in got} == expected


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    known = [v for v in values if v is not None]
    got = exact_quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.85}).first()
    if not known:
        assert got is None or got["a"] is None
        return
    assert [got[c] for c in "abc"] == pytest.approx(np.quantile(known, [0.1, 0.5, 0.85]), abs=1e-6)


def test_quantile_of_a_single_row_and_of_ties(frame):
    one = exact_quantiles(frame("v double", (7.25,)), "v", {"q": 0.8}).first()
    assert one["q"] == 7.25
    ties = frame("v double", *[(1.0,)] * 50, (2.0,))
    assert exact_quantiles(ties, "v", {"q": 0.5}).first()["q"] == 1.0


def test_bins_are_right_closed(frame):
    df = frame("v double", (0.0,), (30.0,), (30.1,), (100.0,), (None,))
    got = [r[0] for r in df.select(cut("v", [0, 30, 60, 100], ["a", "b", "c"])).collect()]
    assert got == [None, "a", "b", "c", None]
    edges = [F.lit(10.0), F.lit(20.0)]
    bins = frame("v double", (10.0,), (10.5,), (20.0,), (21.0,)).select(quantile_bin("v", edges))
    assert [r[0] for r in bins.collect()] == [1, 2, 2, 3]


def test_clip_keeps_null(frame):
    got = frame("v double", (None,), (-1.0,), (5.0,), (11.0,)).select(clip("v", 0.0, 10.0))
    assert [r[0] for r in got.collect()] == [None, 0.0, 5.0, 10.0]


def test_half_up_and_haversine_and_normal(frame):
    row = frame("x double", (2.5,)).select(
        half_up("x"), haversine_km(F.lit(19.076), F.lit(72.8777), F.lit(28.7041), F.lit(77.1025)),
        *[normal_quantile(F.lit(p)) for p in (0.8, 0.95, 0.99)]).first()
    assert row[0] == 3.0
    assert row[1] == pytest.approx(1153, abs=3)
    assert [row[2], row[3], row[4]] == pytest.approx([0.841621, 1.644854, 2.326348], abs=1e-6)


def brute_neighbours(signal, k):
    vectors = {}
    for c, p, w in signal:
        vectors.setdefault(c, {})[p] = w
    norm = {c: math.sqrt(sum(w * w for w in v.values())) for c, v in vectors.items()}
    out = {}
    for a in vectors:
        scored = []
        for b in vectors:
            dot = sum(w * vectors[b].get(p, 0.0) for p, w in vectors[a].items())
            if a != b and dot > 0:
                scored.append((-dot / (norm[a] * norm[b]), b))
        out[a] = [b for _, b in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("budget", [0, 10, 40, 20_000])
def test_neighbours_with_a_product_everyone_holds(spark, monkeypatch, budget):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "CHUNK", 3)
    rng = random.Random(11)
    signal = {(c, rng.randint(1, 25)): float(rng.randint(1, 9)) for c in range(70)
              for _ in range(4)}
    for c in range(0, 70, 2):
        signal[(c, 0)] = 3.0  # held by half of all customers
    for c in range(60, 70):
        for p in range(1, 26):
            signal.pop((c, p), None)
        signal[(c, 0)] = 6.0  # only the hot product: all equal, ties by id
    rows = [(c, p, w) for (c, p), w in signal.items()]
    df = spark.createDataFrame(rows, "customer_id long, product_id long, signal double")
    got = {}
    for r in K.similar_customers(df, 5, budget).orderBy("customer_id", "rank").collect():
        got.setdefault(r["customer_id"], []).append(r["neighbour_id"])
    expected = {c: n for c, n in brute_neighbours(rows, 5).items() if n}
    assert got == expected


def zipf_rows(seed, rows, per_row=8):
    """(row, feature, weight) of unit rows; a feature's weight falls with its frequency, as idf's."""
    rng = random.Random(seed)
    out = []
    for row in range(rows):
        features = {min(int(rng.paretovariate(0.6)), 40 * rows) for _ in range(per_row)}
        weights = {f: 1.0 if f > 3 else 0.05 * f for f in features}
        norm = sum(w * w for w in weights.values()) ** 0.5
        out += [(row, f, w / norm, 1.0) for f, w in weights.items()]
    return out


@pytest.mark.parametrize("budget, digits", [(0, 9), (30, 9), (30, None), (20_000, 9)])
def test_index_finds_what_all_pairs_find(spark, budget, digits):
    schema = "row long, feature long, weight double, norm double"
    asked, known = zipf_rows(1, 60), zipf_rows(2, 150)
    found = {}
    for r in similarity.top_k(spark.createDataFrame(asked, schema), spark.createDataFrame(
            known, schema), 4, False, digits, budget).collect():
        found.setdefault(r["query"], []).append((-r["similarity"], r["match"]))
    a, b = {}, {}
    for rows, out in ((asked, a), (known, b)):
        for row, f, w, _ in rows:
            out.setdefault(row, {})[f] = w
    for q, mine in a.items():
        scored = []
        for m, theirs in b.items():
            dot = sum(w * theirs.get(f, 0.0) for f, w in mine.items())
            if dot > 0:
                scored.append((-(math.floor(dot * 1e9 + 0.5) / 1e9 if digits else dot), m))
        got, best = sorted(found.get(q, [])), sorted(scored)[:4]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in best], abs=1e-12)
        if digits:
            assert got == best


@pytest.mark.parametrize("cell, budget", [(64, 0), (64, 40), (1 << 20, 0)])
def test_frequent_features_meet_in_cells(spark, monkeypatch, cell, budget):
    """Of 120 x 150 pairs that share a feature none is listed, whatever the cells and the budget."""
    monkeypatch.setattr(similarity, "CELL", cell)
    schema = "row long, feature long, weight double, norm double"
    hot = [(row, 99_999, 2.0, 1.0) for row in range(150)]
    asked = spark.createDataFrame(zipf_rows(1, 120) + hot[:120], schema)
    known = spark.createDataFrame(zipf_rows(2, 150) + hot, schema)
    cells, blocks = similarity._cells(asked, known)
    entries, features = known.count(), known.select("feature").distinct().count()
    assert blocks == -(-entries // cell)
    assert cells.count() <= features * blocks * -(-asked.count() // cell)
    got = [tuple(r)[:2] + (r["similarity"],) for r in similarity.top_k(
        asked, known, 3, False, 9, budget).orderBy("query", F.desc("similarity"), "match").collect()]
    every = [tuple(r)[:2] + (r["similarity"],) for r in similarity.top_k(
        asked, known, 3, False, 9, 1 << 40).orderBy("query", F.desc("similarity"), "match").collect()]
    assert got == every and len(got) == 360


@pytest.mark.parametrize("budget, passes", [(0, 3), (20_000, 4)])
def test_queries_are_taken_in_slices(spark, monkeypatch, budget, passes):
    """A slice holds no more products or cells than it may; together they find what one pass finds."""
    schema = "row long, feature long, weight double, norm double"
    asked = spark.createDataFrame(zipf_rows(1, 120), schema)
    known = spark.createDataFrame(zipf_rows(2, 150), schema)

    def found() -> list:
        return sorted(similarity.top_k(asked, known, 3, False, 9, budget).select(
            "query", "match", "similarity").collect())

    whole, seen, once = found(), [], similarity.stored
    for name, value in (("BLOCK", 4096), ("SLICE", 3 * 4096), ("CELL", 256), ("CELLS", 3)):
        monkeypatch.setattr(similarity, name, value)
    monkeypatch.setattr(similarity, "stored", lambda df: seen.append(df.columns) or once(df))
    assert found() == whole and whole
    # 37186 products of 3 blocks a slice; 3 blocks of queries, each beside 4 of the index.
    assert len([c for c in seen if "similarity" in c]) == passes + (not budget)


def test_bounds_spare_the_frequent_features(spark):
    """Four times the rows: the products before the bound grow with the postings, not their square."""
    schema = "row long, feature long, weight double, norm double"
    pairs = []
    for rows in (500, 2000):
        df = spark.createDataFrame(zipf_rows(3, rows), schema)
        r = similarity.work(df, df, budget=200).first()
        pairs.append(r["pairs"] / r["postings"])
    assert pairs[1] < 1.5 * pairs[0]


def test_index_of_empty_tables(spark):
    schema = "row long, feature long, weight double, norm double"
    some, none = spark.createDataFrame(zipf_rows(1, 5), schema), spark.createDataFrame([], schema)
    assert similarity.top_k(some, none, 3, False).count() == 0
    assert similarity.top_k(none, some, 3, False).count() == 0


def test_ranges_do_not_change_the_result(frame, monkeypatch):
    rows = [("g", i, (i * 37) % 101) for i in range(400)]
    df = frame("g string, id long, v long", *rows)
    few = {r["id"]: r["running"] for r in
           running_total(df, [F.col("v"), F.col("id")], "v", ("g",)).collect()}
    monkeypatch.setattr(distributed, "PER_RANGE", 1)
    monkeypatch.setattr(distributed, "MIN_FAN", 20)
    more = {r["id"]: r["running"] for r in
            running_total(df, [F.col("v"), F.col("id")], "v", ("g",)).collect()}
    assert few == more
    # Ten rows a range: a third level of the search.
    monkeypatch.setattr(distributed, "MIN_FAN", 2)
    monkeypatch.setattr(distributed, "MAX_FAN", 4)
    monkeypatch.setattr(distributed, "ROWS", 10)
    stored = distributed.stored(df)
    assert distributed._shape(stored) == (3, 4)
    ranged = distributed._with_range(stored, F.struct("v", "id"))
    assert ranged.groupBy("_range").count().agg({"count": "max"}).first()[0] <= 40
    third = {r["id"]: r["running"] for r in
             running_total(df, [F.col("v"), F.col("id")], "v", ("g",)).collect()}
    assert third == few


def test_mean_of_rates_keeps_their_decimals(frame):
    rates = frame("r double", (0.125,), (0.125,), (None,))
    assert rates.agg(rate_mean("r")).first()[0] == 0.125
