"""Plans whose joins must not broadcast a side that grows with the rows."""

import math
import tempfile
import time
from datetime import date
from pathlib import Path

from pyspark.sql import functions as F

from aislewise.operators import (customers as K, merchandising as M, models as L, offers as P,
                                 overview as V, text as T)
from aislewise.session import setting, stored


def broadcast_parts(df, operator="BroadcastExchange"):
    """The text of every broadcast's (or another operator's) subtree in the plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    parts = []
    for i, line in enumerate(lines):
        if operator in line:
            end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)),
                       len(lines))
            parts.append("\n".join(lines[i + 1:end]))
    return parts


def test_no_message_is_broadcast(spark):
    messages = spark.createDataFrame([(1, "a red Fox"), (2, None), (3, "the blue fox den")],
                                     "message_id long, message string")
    names = spark.createDataFrame([("brand", "fox"), ("brand", "fox den"), ("category", "red")],
                                  "kind string, name string")
    found = T.names_in(messages, names, ("category", "brand"))
    assert not any("message" in part for part in broadcast_parts(found))
    assert sorted((r.message_id, r.category, r.brand) for r in found.collect()) == [
        (1, "red", "fox"), (2, None, None), (3, None, "fox den")]


def _offer_tables(spark):
    day = lambda n: date(2024, 1, n)
    promotions = spark.createDataFrame(
        [(k, k, "Bundle", "Both", "All", 0.1 * k, day(10), day(20), True) for k in (1, 2)],
        "promo_id long, product_id long, promo_type string, channel string, target_segment string, "
        "discount_pct double, start_date date, end_date date, is_active boolean")
    customers = spark.createDataFrame(
        [(1, "A", "x", "Email", "Gold"), (2, "B", None, "Both", "Bronze")],
        "customer_id long, segment string, preferred_category string, preferred_channel string, "
        "loyalty_tier string")
    products = spark.createDataFrame([(1, "x"), (2, None)], "product_id long, category string")
    sales = spark.createDataFrame(
        [(1, 1, day(12), 5.0), (2, 1, day(3), 4.0), (1, 2, day(15), 2.0)],
        "customer_id long, product_id long, transaction_date date, total_amount double")
    # Files, whose sizes Spark goes by.
    return tuple(stored(df) for df in (promotions, customers, products, sales))


def test_promotion_spans_are_not_broadcast(spark):
    promotions, _, _, sales = _offer_tables(spark)
    found = P.promo_uplift(promotions, sales)
    assert not any("_bin" in part for part in broadcast_parts(found))
    assert sorted((r.promo_id, r.treated_revenue, r.control_revenue) for r in found.collect()) == [
        (1, 5.0, 4.0), (2, 2.0, 0.0)]


def test_buyers_are_not_broadcast(spark):
    promotions, customers, _, sales = _offer_tables(spark)
    found = L.offer_conversions(promotions, customers, sales)
    assert not any("_bin" in part for part in broadcast_parts(found))
    assert sum(r.weight for r in found.collect() if r.label == 1.0) == 2


def test_best_offers_are_described_before_customers_meet_them(spark):
    promotions, customers, products, sales = _offer_tables(spark)
    found = P.next_best_offer(customers, promotions, products, sales)
    assert found.columns == ["promo_id", "customer_id", "score", "confidence", "promo_type",
                             "product_id", "discount", "uplift_pct"]
    assert sorted((r.customer_id, r.promo_id) for r in found.collect()) == [(1, 2), (2, 2)]
    # The promotions come from the stored winners: none of their figures is computed beside them.
    assert "control_revenue" not in found._jdf.queryExecution().executedPlan().toString()


def test_catalogue_is_not_broadcast_to_segment_offers(spark):
    promotions, customers, products, _ = _offer_tables(spark)
    found = P.segment_offers(customers, promotions, products)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("segment = 'A'").count() == 2


def test_model_rows_are_not_dealt_by_category(spark):
    daily = stored(spark.createDataFrame(
        [(k, date(2024, 1, d), 10 * k + d) for k in (1, 2, 3) for d in range(1, 21)],
        "product_id long, transaction_date date, daily_qty long").selectExpr(
        "*", "daily_qty - 7 AS lag_7", "daily_qty - 14 AS lag_14", "1.0D AS rolling_7_mean",
        "2.0D AS rolling_30_mean", "1 AS month", "1 AS day_of_month", "1 AS week_number",
        "1 AS quarter", "false AS is_holiday", "false AS is_weekend", "false AS is_sale_season"))
    products = stored(spark.createDataFrame([(1, "x"), (2, "x"), (3, None)],
                                            "product_id long, category string"))
    found = L.forecast_training(daily, products)
    assert not any("lag_7" in part for part in broadcast_parts(found, "Join [category"))
    rows = found.collect()
    assert {r.product_id for r in rows} == {1, 2}  # without a category there is no level
    assert {r.category_avg_qty for r in rows} == {25.5} and len(rows) == 40


def test_candidates_are_listed_after_one_shuffle(spark):
    """Products meet the signal, not the pairs: nothing joins or deals the pairs by product."""
    signal = stored(spark.createDataFrame(
        [(1, 10, 3.0, 1), (1, 11, None, 1), (2, 10, 6.0, 1), (2, 12, 2.0, 0), (2, 13, 4.0, 1),
         (2, 14, None, 0), (3, 10, 1.0, 0), (3, 13, 1.0, 0)],
        "customer_id long, product_id long, signal double, bought int"))
    similar = stored(spark.createDataFrame(
        [(1, 2, 0.5), (1, 3, 0.25), (2, 1, 0.5)],
        "customer_id long, neighbour_id long, similarity double"))
    levels = stored(spark.createDataFrame([(k, 2.0) for k in (10, 11, 12, 14)] + [(13, 5.0)],
                                          "product_id long, level double"))
    found = K.cf_candidates(signal, similar, levels)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("similarity" in line and "product_id" in line.split("hashpartitioning")[-1]
                   for line in plan.split("\n") if "hashpartitioning" in line)
    assert plan.count("Join") == 1  # the lists beside the neighbours
    got = {(r.customer_id, r.product_id): (r.raw_score, r.bought_by_similar, r.level)
           for r in found.collect()}
    assert got == {(1, 12): (1.333333, 0, 2.0), (1, 13): (3.0, 1, 5.0)}


def test_customers_are_taken_in_slices(spark, monkeypatch):
    signal = stored(spark.createDataFrame(
        [(c, (c * 7 + i * i) % 40, float(1 + i % 3), i % 2) for c in range(30) for i in range(6)],
        "customer_id long, product_id long, signal double, bought int").dropDuplicates(
        ["customer_id", "product_id"]))
    similar = stored(spark.createDataFrame(
        [(c, (c + d) % 30, 1.0 / d) for c in range(30) for d in (1, 4, 9)] + [(None, 1, 0.5)],
        "customer_id long, neighbour_id long, similarity double"))
    levels = stored(spark.createDataFrame([(k, float(k % 3)) for k in range(40)],
                                          "product_id long, level double"))

    def found() -> list:
        return sorted(K.best_candidates(signal, similar, levels, 3, F.desc("raw_score")).collect())

    whole, seen, once = found(), [], K.stored
    monkeypatch.setattr(K, "PAIRS_AT_ONCE", 150)
    monkeypatch.setattr(K, "stored", lambda df: seen.append(df.columns) or once(df))
    assert found() == whole and len(whole) == 90
    assert len([c for c in seen if "raw_score" in c]) == 4  # of about 500 pairs


def test_a_product_that_comes_twice_is_two_recommendations(spark):
    signal = spark.createDataFrame(
        [(1, 10, 1.0, 1)] + [(2, k, 1.0, 1) for k in (10, 20, 21, 22)],
        "customer_id long, product_id long, signal double, bought int")
    similar = spark.createDataFrame([(1, 2, 0.5)],
                                    "customer_id long, neighbour_id long, similarity double")
    products = spark.createDataFrame(
        [(10, "a", "x", 1.0), (20, "b", "x", 1.0), (21, "c", "x", 1.0), (21, "c", "y", 1.0),
         (22, "d", "x", 1.0)],
        "product_id long, product_name string, category string, price double")
    customers = spark.createDataFrame([(1, "x")], "customer_id long, preferred_category string")
    boost = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "category string, boost double")
    got = K.cf_recommendations(signal, similar, products, customers, boost, 3).collect()
    assert sorted((r.position, r.product_id, r.category, r.score) for r in got) == [
        (1, 21, "y", 2.0), (2, 20, "x", 1.0), (3, 21, "x", 1.0)]



def test_top_movers_deals_texts_of_products_once(spark):
    """Products meet the sales last: no text goes by customer, and the grouping needs no shuffle."""
    sales = spark.createDataFrame([(1, 1, 2, 10.0, None, "x"), (1, 2, 1, 4.0, None, "x"),
                                   (2, 1, 1, 5.0, None, "x"), (3, 9, 1, 1.0, None, "x")],
                                  "product_id long, customer_id long, quantity long, "
                                  "total_amount double, transaction_date date, channel string")
    products = spark.createDataFrame([(k, f"p{k}", "c", "b", 1.0, 1.0, 7) for k in (1, 2, 3)],
                                     "product_id long, product_name string, category string, "
                                     "brand string, cost_price double, price double, "
                                     "supplier_id long")
    customers = spark.createDataFrame([(1, "r", "s"), (2, "r", "s")],
                                      "customer_id long, region string, segment string")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        found = V.top_movers(*map(stored, (sales, products, customers)))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 4
        assert [(r.product_id, r.revenue, r.units, r.margin_pct) for r in found.collect()] == [
            (1, 14.0, 3, 78.6), (2, 5.0, 1, 80.0)]



def test_what_was_shuffled_for_a_stored_result_is_deleted(spark):
    folder = Path(spark.conf.get("spark.local.dir", None) or tempfile.gettempdir())
    files = lambda: set(folder.glob("blockmgr-*/*/shuffle_*.data"))
    before = files()
    kept = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and kept.count() == 7



def test_tfidf_deals_no_count_of_a_row(spark, monkeypatch):
    """Texts are dealt by block, and pairs of block and term; ids may repeat or be null."""
    plans = []
    monkeypatch.setattr(T, "stored", lambda df: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    docs = spark.createDataFrame([(1, "aa bb aa the"), (2, "cc aa"), (1, "bb dd"), (None, "aa ee"),
                                  (None, None), (3, "")], "id long, text string")
    got = {(r.row, r.term): r.weight for r in T.tfidf(docs, "id", "text", ["the"]).collect()}
    dealt = [line.split("hashpartitioning")[1] for line in plans[-1].split("\n")
             if "Exchange hashpartitioning" in line]
    assert dealt and not any("row#" in line for line in dealt)
    counts = {1: {"aa": 2, "bb": 2, "dd": 1}, 2: {"cc": 1, "aa": 1}, None: {"aa": 1, "ee": 1}}
    df = {t: sum(t in c for c in counts.values()) for c in counts.values() for t in c}
    expected = {}
    for row, terms in counts.items():
        w = {t: n * (math.log(7 / (df[t] + 1)) + 1) for t, n in terms.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        expected |= {(row, t): x / length for t, x in w.items()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - v) < 1e-12 for k, v in expected.items())



def test_elasticity_has_as_many_tasks_as_asked_for(spark):
    prices = spark.createDataFrame([(1, "2024-01-01", 10.0), (1, "2024-02-01", 12.0)],
                                   "product_id long, effective_date string, price double")
    sales = spark.createDataFrame([(1, "2024-01-05", 3)],
                                  "product_id long, transaction_date string, quantity long")
    prices, sales = (df.withColumn(c, F.col(c).cast("date")) for df, c in (
        (prices, "effective_date"), (sales, "transaction_date")))
    plan = M.price_elasticity(prices, sales)._jdf.queryExecution().executedPlan().toString()
    assert any("product_id" in line and "REPARTITION_BY_NUM" in line for line in plan.split("\n"))
