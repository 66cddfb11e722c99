"""Properties of the learned operators on small frames."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aislewise.operators import features as X, merchandising as M, models as L


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(p, dt.date(2024, 1, 1) + dt.timedelta(days=d), 5 + 10 * p + (8 if d % 7 > 4 else 0))
            for p in range(4) for d in range(120)]
    daily = spark.createDataFrame(rows, "product_id int, transaction_date date, daily_qty long")
    days = daily.select(F.col("transaction_date").alias("date")).distinct()
    flags = X.calendar_columns(days, X.HOLIDAYS).withColumnRenamed("date", "transaction_date")
    products = spark.createDataFrame([(p, "c") for p in range(5)],
                                     "product_id int, category string")
    return daily.join(flags.drop("month", "year"), "transaction_date"), products


def test_forecast_beats_the_mean_and_covers_unsold(spark, sales):
    daily, products = sales
    training = L.forecast_training(X.daily_sales_lags(daily), products)
    split = training.groupBy("is_train").agg(F.max("transaction_date").alias("hi"),
                                             F.min("transaction_date").alias("lo")).collect()
    bounds = {r["is_train"]: r for r in split}
    assert bounds[True]["hi"] < bounds[False]["lo"]
    model = L.fit_forecast_model(training, trees=10, rate=0.3)
    errors = L.forecast_errors(training, model)
    overall = errors.where("product_id IS NULL").first()
    mean = training.where("is_train").agg(F.avg("daily_qty")).first()[0]
    naive = training.where("NOT is_train").agg(F.avg(F.abs(F.col("daily_qty") - mean))).first()[0]
    assert overall["mae"] < naive / 2
    assert errors.where("product_id IS NOT NULL").count() == 4
    forecast = L.demand_forecast(daily, products, model, errors, horizon=5,
                                 checkpoint_every=2).collect()
    assert len(forecast) == 25 and all(r["forecast_qty"] >= 0 for r in forecast)
    unsold = [r for r in forecast if r["product_id"] == 4]
    assert {r["model"] for r in unsold} == {"Category Baseline (no sales history)"}
    assert len({r["forecast_qty"] for r in unsold}) == 1


def test_forecast_queries_fit_the_operators_defaults(spark, monkeypatch):
    from aislewise.plans import models as P
    fits = []
    monkeypatch.setattr(P, "_training", lambda *_: None)
    monkeypatch.setattr(P, "_daily", lambda *_: None)
    monkeypatch.setattr(P, "stored", lambda x: x)
    monkeypatch.setattr(P, "plain", lambda x, *_: x)
    for name in ("forecast_errors", "demand_forecast"):
        monkeypatch.setattr(P.L, name, lambda *_, **__: None)
    monkeypatch.setattr(P.L, "saved_forecast_model", lambda *a, **k: fits.append((a[1:], k)))
    P.forecast_model(None)
    P.demand_forecast(type("T", (), {"products": None}))
    assert fits == [((), {})] * 2


def test_one_fit_serves_every_reader_of_the_same_rows(spark, sales, tmp_path, monkeypatch):
    daily, products = sales
    training = L.forecast_training(X.daily_sales_lags(daily), products).cache()
    fits, fit = [], L.fit_forecast_model
    monkeypatch.setattr(L, "fit_forecast_model",
                        lambda rows, **k: fits.append(k) or fit(rows, **k))
    few = {"trees": 2, "rate": 0.5}
    first = L.saved_forecast_model(training, str(tmp_path), **few)
    again = L.saved_forecast_model(training.repartition(5), str(tmp_path), **few)
    assert fits == [few] and again.toDebugString == first.toDebugString
    L.saved_forecast_model(training, str(tmp_path), trees=3, rate=0.5)
    L.saved_forecast_model(training.where("product_id <> 1"), str(tmp_path), **few)
    assert len(fits) == 3
    assert len([f for f in tmp_path.iterdir() if f.is_dir()]) == 3  # nothing half-written stays


def test_trainer_gets_no_more_partitions_than_its_rows_ask_for(spark, sales, monkeypatch):
    daily, products = sales
    training = L.forecast_training(X.daily_sales_lags(daily), products).cache()
    n, seen = training.where("is_train").count(), []
    monkeypatch.setattr(L.GBTRegressor, "fit", lambda self, rows: seen.append(
        (rows.rdd.getNumPartitions(), rows.count())))
    for size in (n, -(-n // 2), 1):  # session: 4 shuffle partitions, no more than those
        monkeypatch.setattr(L, "ROWS_A_TASK", size)
        L.fit_forecast_model(training)
    assert seen == [(1, n), (2, n), (4, n)]


def test_trainer_gets_a_partition_a_core_until_those_are_large(spark, sales, monkeypatch):
    daily, products = sales
    training = L.forecast_training(X.daily_sales_lags(daily), products).cache()
    n, seen = training.where("is_train").count(), []
    monkeypatch.setattr(L.GBTRegressor, "fit", lambda self, rows: seen.append(
        (rows.rdd.getNumPartitions(), rows.count())))
    monkeypatch.setattr(L, "ROWS_A_TASK", 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        for most in (n, -(-n // 16)):
            monkeypatch.setattr(L, "MOST_ROWS", most)
            L.fit_forecast_model(training)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [(spark.sparkContext.defaultParallelism, n), (16, n)]


def test_band_of_the_fitted_forecast(spark, sales):
    daily, products = sales
    training = L.forecast_training(X.daily_sales_lags(daily), products)
    model = L.fit_forecast_model(training, trees=3, rate=0.5)
    forecast = L.demand_forecast(daily, products, model, L.forecast_errors(training, model),
                                 horizon=3).cache()
    bands = M.forecast_band(forecast).collect()
    assert len(bands) == 3 * products.count()
    for r in bands:
        error = max(r["mape"] / 100 * r["forecast_qty"], 0.5)
        assert r["lower_bound"] == pytest.approx(max(0, r["forecast_qty"] - 1.96 * error), abs=0.051)
        assert r["upper_bound"] == pytest.approx(r["forecast_qty"] + 1.96 * error, abs=0.051)
    sums = {}
    for r in forecast.collect():
        sums.setdefault(r["product_id"], []).append(r["forecast_qty"])
    for r in M.forecast_totals(forecast).collect():
        own = sums.pop(r["product_id"])
        assert (r["days"], r["total_forecast"]) == (3, pytest.approx(sum(own), abs=0.051))
        assert r["avg_daily_demand"] == pytest.approx(sum(own) / 3, abs=0.0051)
    assert not sums


def test_elbow_takes_the_first_small_drop():
    assert L._elbow([(3, 100.0), (4, 50.0), (5, 49.0), (6, 10.0)]) == 5
    assert L._elbow([(3, 100.0)]) == 8


def test_audience_cost_falls_with_k(spark):
    rows = [(i, *[float((i * (j + 3)) % 17) for j in range(7)]) for i in range(120)]
    frame = spark.createDataFrame(rows, "customer_id int, " + ", ".join(
        f"{c} double" for c in L.AUDIENCE_COLUMNS))
    table, k = L.audience_k(frame, max_k=6)
    costs = [r["cost"] for r in table.orderBy("k").collect()]
    assert costs[-1] < costs[0] and 3 <= k <= 8
    clusters = L.audience_clusters(frame, 3)
    assert clusters.select("cluster_id").distinct().count() == 3
    labels = [r["label"] for r in L.cluster_labels(L.cluster_means(clusters)).collect()]
    assert len(set(labels)) == 3


def _audience_rows(n):
    rows = [(i, *[float((i * (j + 3)) % 17 + 40 * (i % 4 == j)) for j in range(6)], 5.0)
            for i in range(n)]
    return rows, "customer_id int, " + ", ".join(f"{c} double" for c in L.AUDIENCE_COLUMNS)


def test_audience_fits_equal_a_plain_lloyd(spark):
    """Same centres, cost and steps as one loop over whole numbers; a constant column counts as 0;
    the result does not depend on the partitions."""
    rows, schema = _audience_rows(90)
    x = [[int(v * 100) for v in r[1:]] for r in rows]
    n = len(x)
    z = [[0] * 7 for _ in x]
    for j in range(6):
        total, squares = sum(r[j] for r in x), sum(r[j] ** 2 for r in x)
        sd = math.sqrt(float(n * squares - total * total) / n / (n - 1))
        for i, r in enumerate(x):
            z[i][j] = math.floor((r[j] - total / n) / sd * 1000.0 + 0.5)
    order = sorted(range(n), key=lambda i: (sum(z[i]), i))

    def mean(members):
        return [sum(z[i][j] for i in members) // len(members) for j in range(7)]

    for parts in (1, 7):
        frame = spark.createDataFrame(rows, schema).repartition(parts)
        model = L.AudienceModel(frame, [3, 5])
        for k in (3, 5):
            centres = [mean([i for p, i in enumerate(order) if p * k // n == c])
                       for c in range(k)]
            steps = 0
            while True:
                steps += 1
                near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), c_no)
                            for c_no, c in enumerate(centres)) for v in z]
                new = [mean(m) if (m := [i for i in range(n) if near[i][1] == c]) else centres[c]
                       for c in range(k)]
                if new == centres:
                    break
                centres = new
            assert model.centres[k].tolist() == centres
            assert (model.steps[k], model.converged[k]) == (steps, True)
            assert model.cost[k] == sum(d for d, _ in near) / 1e6
            got = {r["customer_id"]: r["cluster_id"] for r in model.clusters(k).collect()}
            assert got == {i: near[i][1] for i in range(n)}


def test_audience_of_repeated_null_and_no_rows(spark):
    _, schema = _audience_rows(0)
    alike = spark.createDataFrame([(i, *[None] * 7) for i in range(6)], schema)
    model = L.AudienceModel(alike, [3, 4])
    assert model.cost == {3: 0.0, 4: 0.0} and model.clusters(3).count() == 6
    none = L.AudienceModel(spark.createDataFrame([], schema), [3])
    assert none.centres == {} and none.clusters(3).count() == 0
    assert L.audience_table(none, [3])[1] == 8


def test_audience_step_sums_each_centre_once():
    """A centre's rows are added up together, exactly, also for no rows and for equal centres."""
    rng = np.random.default_rng(5)
    rows = rng.integers(-3000, 3000, (5_000, 7))
    rows[:4] = 750_000_000
    fits = {k: rng.integers(-3000, 3000, (k, 7)) for k in (1, 3, 12, 300)}
    fits[12][4] = fits[12][2]  # equal centres: the lower one has the rows
    names = ["k", "centre", "n", "squares", *[f"_z{i}" for i in range(7)]]
    batches = [pd.DataFrame(rows[i:i + 999]) for i in (*range(0, len(rows), 999), len(rows))]
    for table, (k, centres) in zip(L._group_sums(fits, names)(iter(batches)), fits.items(),
                                   strict=True):
        nearest, squares = L._nearest(rows, centres)
        every = [[(nearest == c).sum(), squares[nearest == c].sum(),
                  *rows[nearest == c].sum(axis=0)] for c in range(k)]
        assert L._by_centre(rows, nearest, squares, k).tolist() == every
        assert table.to_numpy().tolist() == [[k, c, *row] for c, row in enumerate(every)]
    assert not L._by_centre(rows[:0], nearest[:0], squares[:0], 300).any()


def test_audience_step_limit_is_reported(spark):
    rows, schema = _audience_rows(90)
    model = L.AudienceModel(spark.createDataFrame(rows, schema), [5], steps=1)
    assert (model.steps[5], model.converged[5]) == (1, False)


def test_small_audiences_try_the_same_k(spark):
    rows = [(i, *[float((i * (j + 3)) % 17) for j in range(7)]) for i in range(6)]
    frame = spark.createDataFrame(rows, "customer_id int, " + ", ".join(
        f"{c} double" for c in L.AUDIENCE_COLUMNS))
    table, _ = L.audience_k(frame, max_k=8)
    assert {r["k"]: r["fitted"] for r in table.collect()} == {k: k <= 6 for k in range(3, 9)}
    assert table.where("fitted AND cost IS NULL OR NOT fitted AND cost IS NOT NULL").count() == 0


def test_ticket_features_have_a_fixed_width_and_lose_no_term(spark):
    rows = [(i, " ".join(f"term{i}x{j}" for j in range(10)), "ab"[i % 2], "High")
            for i in range(80)]
    tickets = spark.createDataFrame(rows, "ticket_id int, description string, category string, "
                                          "priority string")
    model = L.TicketModel(tickets, buckets=256, iterations=1)
    assert model.models["category"].numFeatures == 256
    vectors = model.vectors(tickets).select("features").collect()
    assert all(r["features"].size == 256 and 0 < r["features"].numNonzeros() <= 10 for r in vectors)


def test_hashed_terms_are_as_right_as_all_terms(spark):
    """Within a point of a width at which no two terms meet."""
    import random
    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    def text(label):
        own = [f"{label}{rng.randint(0, 40)}" for _ in range(3)]
        return " ".join(rng.sample(words, 12) + own)
    labels = [("ab", "High"), ("cd", "Low"), ("ef", "Low")]
    rows = [(i, text(label), label, priority) for i in range(600) for label, priority in
            [labels[i % 3]]]
    tickets = spark.createDataFrame(rows, "ticket_id int, description string, category string, "
                                          "priority string")
    right = [L.TicketModel(tickets, buckets=b, iterations=60, stop_words=[]).accuracy(tickets).where(
        "target = 'category'").first()["accuracy"] for b in (L.TERM_BUCKETS, 1 << 20)]
    assert abs(right[0] - right[1]) <= 0.011 and right[1] > 0.9


def test_newton_steps_reach_the_logistic_optimum(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = (rng.random(60) < 1 / (1 + np.exp(-(x @ [1.0, -2.0] - 0.5)))).astype(float)
    w = rng.integers(1, 50, 60).astype(float)
    cells = spark.createDataFrame([(*map(float, r),) for r in np.c_[y, w, x]],
                                  "label double, weight double, x1 double, x2 double")
    b = np.array(L.logistic_fit(cells))
    p = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
    gradient = np.r_[(w * (y - p)).sum(), x.T @ (w * (y - p)) - b[1:]]
    assert np.abs(gradient).max() < 1e-8


def test_offer_weights_fall_back_and_learn(spark):
    people = spark.createDataFrame([(i, "s", "Online" if i % 2 else "Email") for i in range(40)],
                                   "customer_id int, segment string, preferred_channel string")
    promos = spark.createDataFrame(
        [(1, "p", 0.1, "Online", "s", dt.date(2024, 1, 1), dt.date(2024, 1, 31)),
         (2, "q", 0.4, "Both", "All", dt.date(2024, 1, 1), dt.date(2024, 3, 31))],
        "promo_id int, product_id string, discount_pct double, channel string, "
        "target_segment string, start_date date, end_date date")
    none = spark.createDataFrame([], "product_id string, customer_id int, transaction_date date")
    assert L.nbo_weights(promos, people, none).first()[:3] == (50.0, 15.0, 10.0)
    bought = spark.createDataFrame(
        [("q", i, dt.date(2024, 2, 1)) for i in range(30)]
        + [("p", 1, dt.date(2024, 1, 5)), ("p", 2, dt.date(2024, 2, 5))],
        "product_id string, customer_id int, transaction_date date")
    cells = {(r["discount_pct"], r["ch_match"], r["label"]): r["weight"]
             for r in L.offer_conversions(promos, people, bought).collect()}
    assert cells == {(0.1, 0, 0.0): 20.0, (0.1, 1, 0.0): 19.0, (0.1, 1, 1.0): 1.0,
                     (0.4, 0, 1.0): 30.0, (0.4, 0, 0.0): 10.0}  # a promotion for both is no match
    learned = L.nbo_weights(promos, people, bought).first()
    assert learned["learned"] and learned["discount_w"] + learned["channel_w"] == pytest.approx(
        65, abs=0.01)


def test_health_weights_sum_to_one(spark):
    rows = [(i, i % 2, (i // 2) % 2, i) for i in range(20)]
    features = spark.createDataFrame(rows, "inventory_id int, stockout_risk int, "
                                           "overstock_flag int, product_id int")
    products = spark.createDataFrame([(i, i % 3) for i in range(20)],
                                     "product_id int, supplier_id int")
    suppliers = spark.createDataFrame([(0, 0.5), (1, 0.9)],
                                      "supplier_id int, reliability_score double")
    assert sum(L.health_weights(features, products, suppliers).first()) == pytest.approx(1.0)


def test_triage_learns_and_phrases_win(spark):
    words = {"Delivery Delay": "courier hub parcel", "Account Issue": "screen browser access"}
    rows = [(i, f"{words[c]} number{i % 3}", c, "High" if i % 2 else "Low")
            for i in range(60) for c in [list(words)[i % 2]]]
    tickets = spark.createDataFrame(rows, "ticket_id int, description string, category string, "
                                          "priority string")
    model = L.TicketModel(tickets, buckets=1 << 12, iterations=50)
    assert model.accuracy(tickets).where("target = 'category'").first()["accuracy"] > 0.9
    asked = spark.createDataFrame([(900, "courier hub parcel", None, None),
                                   (901, "courier hub parcel PASSWORD", None, None)],
                                  tickets.schema)
    got = {r["ticket_id"]: r for r in model.triage(asked).collect()}
    assert got[900]["predicted_category"] == "Delivery Delay"
    assert got[900]["recommended_team"] == "Logistics & Shipping Team"
    assert got[901]["predicted_category"] == "Account Issue"
    assert got[901]["category_confidence"] < 0.5


def test_ticket_trainer_keeps_no_text_and_no_rows_in_memory(spark, monkeypatch):
    tickets = spark.createDataFrame(
        [(i, f"{'late parcel' if i % 2 else 'card payment'} {i}", "ab"[i % 2], "xy"[i % 2])
         for i in range(40)], "ticket_id long, description string, category string, priority string")
    kind, seen = type(tickets), []
    once = kind.persist
    monkeypatch.setattr(kind, "persist", lambda self, level: seen.append(
        (sorted(self.columns), level)) or once(self, level))
    model = L.TicketModel(tickets, iterations=5)
    assert seen == [(["category", "features", "is_train", "priority"], L.StorageLevel.DISK_ONLY)]
    assert {r.predicted_category == r.category for r in model.predict(tickets).collect()} == {True}
