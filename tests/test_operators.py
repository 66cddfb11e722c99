"""Operator rules on small retail frames with the awkward rows spelled out."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from aislewise.operators import (cleaning, customers as K, features as X, merchandising as M,
                                 offers as P, operations as O, overview as V, text as T)
from aislewise.operators.naming import annotate_names, location_label
from aislewise.sources import tables as S
from aislewise.sources.schemas import SCHEMAS


def day(text):
    return dt.date.fromisoformat(text)


def test_clean_products_orders_the_three_prices(frame):
    raw = frame("product_id string, seq int, price string, mrp string, cost_price string, "
                "launch_date string, is_active boolean, style_tag string, season string",
                ("a", 0, "n/a", None, None, "bad", None, None, None),
                ("b", 0, "0.5", "0.2", "9", "2024-01-02", False, "x", "y"),
                ("b", 1, "700", "800", "1", "2024-01-02", True, "x", "y"))
    a, b = cleaning.clean_products(raw, ["seq"]).orderBy("product_id").collect()
    assert (a["price"], a["mrp"], a["cost_price"]) == (499.0, pytest.approx(648.7), 224.55)
    assert a["launch_date"] is None and a["is_active"] and a["season"] == "All Season"
    assert (b["price"], b["mrp"], b["cost_price"], b["margin_pct"]) == (1.0, 1.0, 1.0, 0.0)


def test_clean_campaigns_guards_divisors(frame):
    raw = frame("campaign_id string, budget string, amount_spent string, impressions string, "
                "clicks string, conversions string, start_date string, end_date string",
                ("a", "1", "0", "0", "0", "5", None, None),
                ("b", "-1", "100", "200", "10", "2", None, None))
    a, b = cleaning.clean_campaigns(raw, ["campaign_id"]).orderBy("campaign_id").collect()
    assert (a["ctr"], a["cvr"], a["roas"]) == (0, 0, 0)
    assert (b["budget"], b["ctr"], b["cvr"], b["roas"]) == (0.0, 5.0, 20.0, 10.0)


def test_clean_reviews_drops_blank_text(frame):
    raw = frame("review_id int, rating string, review_text string, review_date string, "
                "sentiment_label string, helpful_votes string, is_verified boolean",
                (1, "9", " ok ", "2024-01-01", None, "-3", None),
                (2, "x", "   ", None, None, None, None), (3, None, None, None, None, None, None))
    rows = cleaning.clean_reviews(raw, ["review_id"]).collect()
    assert [(r["review_id"], r["rating"], r["review_text"], r["helpful_votes"]) for r in rows] == [
        (1, 5.0, "ok", 0.0)]


def test_cleaners_and_schemas_cover_every_table():
    assert len(SCHEMAS) == 25
    assert set(cleaning.CLEANERS) | set(cleaning.PASS_THROUGH) == set(SCHEMAS)


def test_rfm_ignores_null_customers(frame):
    tx = frame("customer_id string, transaction_date date, total_amount double",
               ("a", day("2024-01-01"), 10.0), ("a", day("2024-01-05"), 5.5),
               (None, day("2024-01-09"), 1.0))
    row, = X.rfm(tx).collect()
    assert (row["recency_days"], row["frequency"], row["monetary"],
            row["customer_lifetime_days"]) == (5, 2, 15.5, 4)


def test_lags_count_selling_days_not_calendar_days(frame):
    rows = [("p", day("2024-01-01") + dt.timedelta(days=3 * i), i + 1) for i in range(31)]
    daily = frame("product_id string, transaction_date date, daily_qty long", *rows)
    got = X.daily_sales_lags(daily).orderBy("transaction_date").collect()
    assert got[0]["rolling_7_mean"] is None and got[6]["lag_7"] is None
    assert (got[7]["lag_7"], got[7]["rolling_7_mean"]) == (1, 4.0)
    assert (got[30]["lag_14"], got[30]["rolling_30_mean"]) == (17, 15.5)


def test_repeated_carts_do_not_multiply_intent_rows(frame):
    ts = dt.datetime(2024, 1, 1)
    got = X.buying_intent(
        frame("customer_id string, product_id string, page_views int, dwell_seconds int, "
              "timestamp timestamp", ("c", "p", 30, 150, ts), ("c", "p", 1, 400, ts)),
        frame("customer_id string, product_id string, status string", ("c", "p", "Active"),
              ("c", "p", "Abandoned"), ("c", "q", "Active")),
        frame("customer_id string, product_id string", ("c", "p"), ("c", "p")),
        frame("customer_id string, product_id string", ("x", "p"))).collect()
    assert len(got) == 1
    assert (got[0]["intent_score"], got[0]["intent_label"], got[0]["purchased_label"]) == (
        100.0, "High", 0)


def test_slice_filter_treats_all_as_unset(frame):
    df = frame("category string, channel string, region string, transaction_date date",
               ("a", "x", "n", day("2023-05-05")), ("b", "x", "n", day("2024-05-05")))
    assert df.where(V.slice_filter(category="All", channel="", region=None)).count() == 2
    assert df.where(V.slice_filter(category="a", year="2023")).count() == 1
    assert df.where(V.slice_filter(category="a", year=2024)).count() == 0


def test_promotion_without_control_or_sales(frame):
    promos = frame("promo_id int, product_id string, discount_pct double, start_date date, "
                   "end_date date",
                   (1, "p", 0.1, day("2024-03-01"), day("2024-03-01")),
                   (2, "q", 0.2, day("2024-03-01"), day("2024-03-10")))
    tx = frame("product_id string, transaction_date date, total_amount double",
               ("p", day("2024-02-23"), 40.0), ("p", day("2024-03-01"), 60.0),
               ("p", day("2024-02-22"), 999.0))
    one, two = P.promo_uplift(promos, tx).orderBy("promo_id").collect()
    assert (one["treated_revenue"], one["control_revenue"], one["uplift_pct"]) == (60, 40, 50)
    assert (two["treated_revenue"], two["uplift_pct"]) == (0.0, None)
    assert P.uplift_trend(P.promo_uplift(promos, tx)).first()["slope"] == 80.0  # too few


def test_elasticity_fallbacks_and_value(frame):
    prices = frame("product_id string, effective_date date, price double",
                   ("one", day("2024-01-01"), 5.0),
                   ("flat", day("2024-01-01"), 5.0), ("flat", day("2024-01-11"), 5.0),
                   ("flat", day("2024-01-21"), 5.0),
                   ("real", day("2024-01-01"), 10.0), ("real", day("2024-01-11"), 20.0),
                   ("real", day("2024-01-21"), 20.0))
    tx = frame("product_id string, transaction_date date, quantity int",
               ("real", day("2024-01-05"), 10), ("real", day("2024-01-11"), 4),
               ("real", day("2023-12-31"), 500), ("flat", day("2024-01-05"), 3))
    got = {r["product_id"]: r["elasticity"] for r in M.price_elasticity(prices, tx).collect()}
    assert got == {"one": -1.2, "flat": -1.2, "real": pytest.approx(-0.6)}


def test_cold_customers_get_preferred_category_first(frame):
    products = frame("product_id string, product_name string, category string, price double",
                     *[(f"p{i}", f"n{i}", "x" if i % 2 else "y", 1.0) for i in range(8)])
    tx = frame("product_id string, quantity int", *[(f"p{i}", i + 1) for i in range(8)])
    people = frame("customer_id string, preferred_category string", ("cold", "x"), ("warm", "y"))
    got = K.bestseller_fallback(tx, products, people, frame("customer_id string", ("warm",)),
                                1).collect()
    assert [(r["customer_id"], r["product_id"], r["reason"]) for r in got] == [
        ("cold", "p7", "Popular in x")]  # the most units of the category


def test_slotting_boundaries(frame):
    inventory = frame("inventory_id int, warehouse_id string, product_id string",
                      (1, "w", "a"), (2, "w", "b"), (3, "w", "c"), (4, "w", "z"), (5, "v", "a"))
    moves = frame("inventory_id int, quantity int", (1, 80), (2, 15), (3, 5))
    got = {(r["warehouse_id"], r["product_id"]): (r["abc_class"], r["cum_pct"])
           for r in O.abc_slotting(inventory, moves).collect()}
    assert got == {("w", "a"): ("A", 80.0), ("w", "b"): ("B", 95.0), ("w", "c"): ("C", 100.0),
                   ("w", "z"): ("C", 100.0), ("v", "a"): ("C", 100.0)}


def test_tours_are_never_longer_than_id_order(frame):
    stores = frame("store_id int, latitude double, longitude double",
                   (1, 10.0, 70.0), (2, 20.0, 80.0), (3, 11.0, 71.0), (4, 21.0, 81.0))
    depots = frame("warehouse_id string, latitude double, longitude double",
                   ("w", 9.0, 69.0), ("idle", 15.0, 75.0))
    ships = frame("order_id int, warehouse_id string", *[(i, "w") for i in range(1, 5)])
    orders = frame("order_id int, store_id int", *[(i, i) for i in range(1, 5)])
    lanes = O.warehouse_lanes(ships, orders, depots, stores)
    got = {r["warehouse_id"]: r for r in O.delivery_tours(lanes, depots, stores).collect()}
    assert got["w"]["distance_km"] < got["w"]["baseline_distance_km"]
    # The best of all orders, by a distance computed here with the chord formula.
    place = {0: (9.0, 69.0), 1: (10.0, 70.0), 2: (20.0, 80.0), 3: (11.0, 71.0), 4: (21.0, 81.0)}

    def km(a, b):
        (p, q), (r, s) = [tuple(map(math.radians, place[x])) for x in (a, b)]
        x = [math.cos(p) * math.cos(q) - math.cos(r) * math.cos(s),
             math.cos(p) * math.sin(q) - math.cos(r) * math.sin(s), math.sin(p) - math.sin(r)]
        return 2 * 6371 * math.asin(math.sqrt(sum(v * v for v in x)) / 2)

    best = min(sum(km(a, b) for a, b in zip((0, *order), (*order, 0)))
               for order in itertools.permutations([1, 2, 3, 4]))
    assert got["w"]["distance_km"] == pytest.approx(best, abs=0.01)
    assert got["idle"]["total_orders"] == 75 and got["idle"]["stops_count"] == 4


@pytest.mark.parametrize("stops", [7, 8, 14])
def test_no_warehouse_is_lost_whatever_its_stops(frame, stops):
    stores = frame("store_id int, latitude double, longitude double",
                   *[(i, 10.0 + (i * 37 % 11), 70.0 + (i * 53 % 13)) for i in range(1, stops + 1)])
    depots = frame("warehouse_id string, latitude double, longitude double", ("w", 9.0, 69.0))
    ships = frame("order_id int, warehouse_id string", *[(i, "w") for i in range(1, stops + 1)])
    orders = frame("order_id int, store_id int", *[(i, i) for i in range(1, stops + 1)])
    lanes = O.warehouse_lanes(ships, orders, depots, stores, stops)
    (tour,) = O.delivery_tours(lanes, depots, stores).collect()
    assert tour["stops_count"] == stops
    assert sorted(map(int, tour["route_order"].split(" > "))) == list(range(1, stops + 1))
    assert tour["distance_km"] <= tour["baseline_distance_km"]
    assert tour["distance_km"] <= tour["nearest_neighbour_distance_km"]
    assert tour["exact"] == (stops <= O.EXACT_STOPS)


def test_tour_is_the_best_of_all_orders():
    table = [[abs(a * a % 7 - b * b % 7) + abs(a - b) * 1.5 for b in range(8)] for a in range(8)]
    length = lambda o: round(sum(table[a][b] for a, b in zip((0, *o), (*o, 0))), 6)
    assert O.visiting_order(table) == list(min(
        (length(o), o) for o in itertools.permutations(range(1, 8)))[1])


def test_demand_series_fills_quiet_days(frame):
    tx = frame("product_id string, transaction_date date, quantity int",
               ("p", day("2024-01-10"), 7), ("p", day("2024-01-08"), 3))
    rows = O.demand_timeseries(tx, 4).orderBy("date").collect()
    assert [r["qty"] for r in rows] == [0, 3, 0, 7]
    assert rows[-1]["rolling_7_mean"] == 2.5


def test_routes_first_rule_wins_and_ids(frame):
    messages = frame("message_id int, message string",
                     (1, "Recommend from stock for CUST-0042 and P-77"),
                     (2, "hello"), (3, "customer sentiment in reviews of stock"))
    one, two, three = T.keyword_route(messages).orderBy("message_id").collect()
    assert (one["action"], one["customer_ref"], one["product_ref"]) == (
        "recommendations", "CUST-0042", "P-0077")
    assert (two["action"], two["most_hits_action"]) == ("general_chat", None)
    assert (three["action"], three["most_hits_action"]) == ("inventory_health",
                                                            "voice_of_customer")


def test_support_answers(frame):
    messages = frame("message_id int, customer_id string, message string",
                     (1, "a", "where is my order"), (2, "a", "refund please, a complaint"),
                     (3, "b", "hi"), (4, "b", "my delivery?"))
    orders = frame("order_id int, customer_id string, status string, total_amount double, "
                   "order_date date", *[(i, "a", "Shipped", 5.0, day(f"2024-01-0{i}"))
                                        for i in range(1, 6)])
    returns = frame("return_id int, customer_id string, product_id string, status string, "
                    "reason string, return_date date", (9, "a", "p", "Approved", "Other",
                                                        day("2024-02-01")))
    people = frame("customer_id string, name string", ("a", "Asha Rao"))
    got = {r["message_id"]: r for r in
           T.support_context(messages, orders, returns, people).collect()}
    assert got[1]["orders_context"].startswith("Order 5: Shipped, placed 05 Jan 2024, total 5.0; ")
    assert got[1]["orders_context"].count("Order") == 3
    assert got[1]["response"].startswith("Hi Asha, your recent order 5 is currently 'Shipped'")
    assert (got[2]["intent"], got[2]["escalate"]) == ("complaint", True)
    assert "return request 9" in got[2]["response"]
    assert got[3]["response"].startswith("Hi there!") and got[3]["intent"] == "general"
    assert "couldn't find any recent orders" in got[4]["response"]


def test_request_extraction_and_search(frame):
    products = frame("product_id string, product_name string, category string, brand string, "
                     "price double, is_active boolean",
                     ("p1", "n", "Shirts", "Acme", 400.0, True),
                     ("p2", "n", "Shirts", "Acme Gold", 900.0, True),
                     ("p3", "n", "Shoes", "Zed", 1500.0, True),
                     ("p4", "n", "Shoes", "Zed", 100.0, False))
    messages = frame("message_id int, message string", (1, "buy acme gold shirts"),
                     (2, "shoes 1000-3000"), (3, "something under ₹500"), (4, "compare zed"))
    asked = T.query_extraction(messages, products)
    got = {r["message_id"]: r for r in asked.collect()}
    assert (got[1]["intent"], got[1]["category"], got[1]["brand"]) == ("buy", "Shirts",
                                                                      "Acme Gold")
    assert (got[2]["min_price"], got[2]["max_price"]) == (1000, 3000)
    assert (got[3]["intent"], got[3]["min_price"], got[3]["max_price"]) == ("budget", None, 500)
    found = {}
    for r in T.catalogue_search(asked, products).orderBy("message_id", "position").collect():
        found.setdefault(r["message_id"], []).append(r["product_id"])
    assert found == {1: ["p2"], 2: ["p3"], 3: ["p1"], 4: ["p3"]}


def test_names_are_found_by_their_grams_as_by_containment(spark):
    rng = random.Random(4)
    letters = "abcé -#1"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    names = [(k, word(rng.randint(1, 7))) for k in ("category", "brand") for _ in range(60)]
    names += [("brand", "A.B*"), ("brand", "a.b*"), ("brand", None), ("category", "")]
    texts = [word(rng.randint(0, 60)) for _ in range(80)] + [None, "", "xA.B*y", "line\nacb c"]
    messages = spark.createDataFrame(list(enumerate(texts)), "message_id long, message string")
    found = T.names_in(messages, spark.createDataFrame(names, "kind string, name string"),
                       ("category", "brand")).collect()
    assert len(found) == len(texts)
    for r in found:
        for kind in ("category", "brand"):
            held = [n for k, n in names if k == kind and n
                    and n.lower() in (r["message"] or "").lower()]
            assert r[kind] == min(held, key=lambda n: (-len(n), n), default=None)


def test_a_hundred_thousand_brands_are_no_burden_to_a_message(spark):
    products = spark.range(100_000).selectExpr(
        "concat('Brand#', id) AS brand", "concat('Category ', id % 7) AS category")
    messages = spark.createDataFrame([(1, "a brand#77777 please"), (2, "brand#"), (3, "category 3")],
                                     "message_id long, message string")
    asked = T.query_extraction(messages, products)
    got = {r["message_id"]: (r["category"], r["brand"]) for r in asked.collect()}
    assert got == {1: (None, "Brand#77777"), 2: (None, None), 3: ("Category 3", None)}
    keys = T.name_index(products.select(F.lit("brand").alias("kind"), F.col("brand").alias("name")))
    assert keys.groupBy("gram").count().agg({"count": "max"}).first()[0] < 1000


def test_search_equals_a_scan_of_the_catalogue(spark):
    rng = random.Random(9)
    products = [(k, f"n{k}", rng.choice(["A", "B", None]), rng.choice(["x", "y|z", None]),
                 float(rng.randint(0, 30)), rng.random() < 0.8) for k in range(300)]
    products[5] = (5, "n5", "A", "x", None, True)
    requests = [(k, rng.choice(["A", "B", "C", None]), rng.choice(["x", "y|z", None]),
                 rng.choice([None, 0, 5, 12, 29, 40]), rng.choice([None, 0, 6, 20, 29]))
                for k in range(150)]
    found = {}
    for r in T.catalogue_search(
            spark.createDataFrame(requests, "message_id long, category string, brand string, "
                                            "min_price long, max_price long"),
            spark.createDataFrame(products, "product_id long, product_name string, category string,"
                                            " brand string, price double, is_active boolean"),
            4).orderBy("message_id", "position").collect():
        found.setdefault(r["message_id"], []).append(r["product_id"])
    for key, category, brand, low, high in requests:
        fits = [(p[4], p[0]) for p in products if p[5] and p[4] is not None
                and category in (None, p[2]) and brand in (None, p[3])
                and (not low or p[4] >= low) and (not high or p[4] <= high)]
        assert found.get(key, []) == [i for _, i in sorted(fits)[:4]]


def test_review_aspect_order_and_sentiment(frame):
    reviews = frame("review_id int, product_id int, review_date date, review_text string, "
                    "rating int", (1, 1, day("2024-01-01"), "Late but good QUALITY", 4),
                    (2, 1, day("2024-01-02"), "cheap", 2), (3, 2, None, "fine", 3))
    mined = T.review_aspects(reviews)
    assert [(r["aspect"], r["sentiment"]) for r in mined.orderBy("review_id").collect()] == [
        ("quality", "Positive"), ("price", "Negative"), ("General", "Neutral")]
    assert T.review_aspects(reviews, product_id=1, date_from="2024-01-02").count() == 1
    summary = {(r["breakdown"], r["label"]): r for r in T.review_summary(mined).collect()}
    assert summary[("total", "all")]["reviews"] == 3 and summary[("total", "all")]["alert"]
    assert ("month", "all") not in summary and summary[("month", "2024-01")]["reviews"] == 2


def test_similar_tickets_rank_shared_words(frame):
    resolved = frame("ticket_id int, description string, category string",
                     (1, "parcel delayed at the hub", "Delivery Delay"),
                     (2, "refund money back", "Return & Refund"),
                     (3, "parcel delayed at the hub", "Delivery Delay"))
    queries = frame("ticket_id int, description string", (10, "my parcel is delayed"))
    got = T.similar_tickets(queries, resolved, 3, ["the", "is", "at", "my"]).orderBy(
        "rank").collect()
    assert [r["ticket_id"] for r in got] == [1, 3]
    assert got[0]["similarity"] == got[1]["similarity"]
    assert got[0]["suggested_reply"].startswith("Query warehouse shipments")


def test_names_are_not_overwritten(frame):
    stock = frame("store_id string, warehouse_id string, store_name string",
                  ("s1", None, "Own label"), ("s1", None, None), (None, "w1", None),
                  (None, None, None))
    named = annotate_names(stock, {
        "store_id": frame("store_id string, store_name string", ("s1", "Mall")),
        "warehouse_id": frame("warehouse_id string, warehouse_name string", ("w1", "Depot"))})
    got = sorted(r["location_name"] for r in location_label(named).collect())
    assert got == ["Depot", "Mall", "Own label", "—"]


def test_known_and_unknown_cities_are_located(frame):
    got = O.locate(frame("city string", ("Pune",), ("Atlantis",))).collect()
    assert [(r["latitude"], r["longitude"]) for r in got] == [(18.5204, 73.8567),
                                                             (22.9734, 78.6569)]


def test_tables_round_trip_and_missing_columns(spark, frame, tmp_path):
    raw = frame("wishlist_id string, customer_id string, product_id string, added_date string, "
                "is_purchased string", ("w", "c", "p", "2024-01-01", "true"))
    S.save(raw, str(tmp_path), "wishlist")
    row = S.load(spark, str(tmp_path), "wishlist", SCHEMAS["wishlist"]).first()
    assert (row["added_date"], row["is_purchased"]) == (day("2024-01-01"), True)
    with pytest.raises(KeyError):
        S.load(spark, str(tmp_path), "wishlist", SCHEMAS["stores"])


def test_key_profile_exact_and_approximate(frame):
    df = frame("a int, b string", (1, "x"), (2, "x"), (3, None))
    for approximate in (False, True):
        got = {r["column_name"]: r for r in S.key_profile(df, ["a", "b"], approximate).collect()}
        assert got["a"]["is_unique_key"] and not got["b"]["is_unique_key"]
        assert got["b"]["null_rows"] == 1


def test_date_dim_marks_sales_and_holidays(spark):
    rows = {r["date"]: r for r in X.date_dim(spark, "2024-01-01", "2024-12-31").collect()}
    assert len(rows) == 366
    assert rows[day("2024-01-26")]["holiday_name"] == "Republic Day"
    assert rows[day("2024-01-10")]["is_sale_season"] and not rows[day("2024-01-11")][
        "is_sale_season"]
    assert rows[day("2024-08-31")]["is_long_weekend"]


def test_competitor_gap_of_latest_price(frame):
    history = frame("product_id string, effective_date date, price double",
                    ("p", day("2024-01-01"), 1.0), ("p", day("2024-02-01"), 12.0))
    comp = frame("product_id string, price double", ("p", 10.0), ("p", 8.0))
    row = M.gap_stats_latest(comp, history).first()
    assert (row["mean_gap"], row["std_gap"]) == (35.0, pytest.approx(21.2132, abs=1e-4))


def test_band_has_a_floor(frame):
    got = M.forecast_band(frame("product_id string, day int, forecast_qty double, mape double",
                                ("p", 1, 0.5, 10.0))).first()
    assert (got["lower_bound"], got["upper_bound"]) == (0.0, 1.5)


def test_segment_aov_has_a_global_row(frame):
    tx = frame("customer_id string, total_amount double", ("a", 10.0), ("b", 20.0), ("x", 30.0))
    people = frame("customer_id string, segment string", ("a", "s"), ("b", "s"))
    got = {r["segment"]: r["aov"] for r in V.segment_aov(tx, people).collect()}
    assert got == {"s": 15.0, "_global": 20.0}


def test_modal_hour_and_opt_in(frame):
    people = frame("customer_id string, preferred_channel string, email_opt_in boolean, "
                   "sms_opt_in boolean, app_installed boolean, shopping_frequency double",
                   ("a", "Email", False, True, True, 24.0), ("b", "Store", False, False, False,
                                                             0.0))
    browse = frame("customer_id string, timestamp timestamp",
                   *[("a", dt.datetime(2024, 1, 1, h)) for h in (9, 9, 21)])
    camps = frame("clicks int, impressions int", (1, 4), (5, 0))
    got = {r["customer_id"]: r for r in K.send_time(people, browse, camps).collect()}
    assert (got["a"]["best_hour"], got["a"]["best_day"], got["a"]["opted_in"]) == (9, "Monday",
                                                                                  False)
    assert got["a"]["open_rate"] == pytest.approx(0.0375)
    assert (got["b"]["best_hour"], got["b"]["best_day"], got["b"]["events"]) == (9, "Saturday", 0)
    assert got["b"]["open_rate"] == pytest.approx(0.1375)
