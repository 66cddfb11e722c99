"""Inventory health, replenishment, slotting, markdowns and delivery planning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from aislewise.functions.distributed import exact_quantiles, running_total
from aislewise.functions.scalars import (clip, half_up, haversine_km, normal_quantile, not_null,
                                         one_row, pinned, ratio, spread)
from aislewise.operators.features import recent_demand
from aislewise.session import ship

DEFAULT_WEIGHTS = (0.5, 0.3, 0.2)  # stockout, overstock, supplier reliability
DEFAULT_Z = 1.645
STOPS = 6  # stores of a warehouse's lanes, unless a caller asks for more


# ── inventory ───────────────────────────────────────────────────────────────

def sales_velocity(transactions: DataFrame) -> DataFrame:
    """Units per day over the trailing 30 days of the data."""
    return recent_demand(transactions).select(
        "product_id", F.col("recent_units").alias("quantity"),
        (F.col("recent_units") / 30.0).alias("daily_velocity"))


def inventory_health(inventory: DataFrame, transactions: DataFrame, products: DataFrame,
                     suppliers: DataFrame,
                     weights: tuple[float | Column, ...] = DEFAULT_WEIGHTS) -> DataFrame:
    """Cover, stockout risk and a 0-1 composite score for every stock position.

    ``weights`` of stockout, overstock and reliability: numbers or scalar columns.
    """
    typical = exact_quantiles(suppliers, "reliability_score", {"m": 0.5}).scalar()
    maker = products.select("product_id", "supplier_id").join(
        suppliers.select("supplier_id", "reliability_score"), "supplier_id", "left").drop(
        "supplier_id")
    rows = (inventory.drop("stockout_risk")
            .join(sales_velocity(transactions).drop("quantity"), "product_id", "left")
            .join(maker, "product_id", "left")
            .withColumn("_typical", typical)
            .withColumns({f"_w{k}": w if isinstance(w, Column) else F.lit(w)
                          for k, w in enumerate(weights)})
            .withColumn("reliability", F.coalesce("reliability_score", "_typical"))
            .withColumn("cover", F.col("stock_qty") / F.coalesce("daily_velocity", F.lit(0.1))))
    rows = rows.withColumns({
        "risk": F.lit(1.0) / (F.exp((F.col("cover") - F.col("reorder_point")) * 0.2) + 1.0),
        "overstock_flag": (F.col("stock_qty") > F.coalesce("max_stock", F.lit(9999.0)))
        .cast("int")})
    stockout, overstock, reliability = (F.col(f"_w{k}") for k in range(3))
    rows = rows.withColumn("score", clip(
        (F.lit(1.0) - F.col("risk")) * stockout + (1 - F.col("overstock_flag")) * overstock
        + F.col("reliability") * reliability, 0.0, 1.0))
    return rows.select(
        "inventory_id", "product_id", "store_id", "warehouse_id", "location_type",
        F.col("stock_qty").alias("stock_level"), half_up("cover", 1).alias("days_cover"),
        half_up("risk", 3).alias("stockout_risk"),
        half_up("reliability", 3).alias("supplier_reliability"),
        half_up("score", 2).alias("health_score"),
        F.when(F.col("score") < 0.4, "Critical").when(F.col("score") < 0.7, "At Risk")
        .otherwise("Healthy").alias("risk_label"), "overstock_flag")


def inventory_kpis(health: DataFrame) -> DataFrame:
    """Risk mix by kind of location."""
    return health.groupBy(F.initcap(F.coalesce("location_type", F.lit("—")))
                          .alias("location"), "risk_label").agg(
        F.count(F.lit(1)).alias("positions"),
        F.sum("overstock_flag").cast("long").alias("overstocked"),
        half_up(F.sum(F.floor(F.col("health_score") * 100 + 0.5)) / F.count(F.lit(1)) / 100.0, 4)
        .alias("avg_health"))


def inventory_weakest(health: DataFrame, n: int = 8) -> DataFrame:
    """The n positions with the lowest score, riskiest first."""
    return health.orderBy("health_score", F.desc("stockout_risk"), "inventory_id").limit(n)


def service_level(features: DataFrame) -> DataFrame:
    """z-score of the service level implied by the share of positions at risk."""
    share = features.agg(
        (F.count_if(F.col("stockout_risk") > 0.7) / F.count(F.lit(1))).alias("at_risk"))
    target = clip(F.lit(1.0) - F.col("at_risk"), 0.80, 0.99)
    return share.select("at_risk", target.alias("target"),
                        half_up(normal_quantile(target), 3).alias("z"))


def abc_cutoffs(features: DataFrame) -> DataFrame:
    """Shares of positions covering 80 % and 95 % of demand, clipped."""
    rows = features.select("inventory_id", F.floor(
        F.coalesce("avg_daily_demand", F.lit(0.0)) * 100 + 0.5).alias("demand"))
    ranked = running_total(rows, [-F.col("demand"), F.col("inventory_id")], "demand")
    counted = ranked.agg(
        F.count(F.lit(1)).alias("n"), F.max("total").alias("total"),
        F.count_if(F.col("running") < F.col("total") * 0.80).alias("a"),
        F.count_if(F.col("running") < F.col("total") * 0.95).alias("b"))
    usable = (F.col("n") > 0) & (F.col("total") > 0)
    a = clip(ratio(F.col("a"), F.col("n")), 0.10, 0.40)
    with_a = counted.withColumn("_a", a)
    b = clip(ratio(F.col("b"), F.col("n")), F.col("_a") + 0.05, 0.70)
    return with_a.select(F.when(usable, F.col("_a")).otherwise(0.20).alias("a_fraction"),
                         F.when(usable, b).otherwise(0.50).alias("b_fraction"))


def stock_percentiles(inventory: DataFrame) -> DataFrame:
    """Scarcity (p10) and overstock (p90) thresholds of stock per product."""
    stock = not_null(inventory, "product_id").groupBy("product_id").agg(
        F.sum("stock_qty").alias("stock"))
    return exact_quantiles(stock, "stock", {"p10": 0.10, "p90": 0.90}).select(
        F.greatest("p10", F.lit(1.0)).alias("p10"),
        F.greatest("p90", F.col("p10") + 10).alias("p90"))


def markdown_candidates(features: DataFrame, products: DataFrame, stores: DataFrame,
                        warehouses: DataFrame, n: int = 8) -> DataFrame:
    """The n overstocked positions tying up most capital, plus totals over all of them."""
    rows = (features.where("stock_qty > 0 AND stockout_risk <= 0.10 AND overstock_flag = 1")
            .join(products.select("product_id", "product_name", "category", "price"),
                  "product_id")
            .withColumn("_value", half_up(F.col("stock_qty") * F.col("price"), 2)))
    totals = one_row(rows.agg(
        F.count(F.lit(1)).alias("skus"),
        (F.sum(F.floor(F.col("_value") * 100.0 + 0.5)) / 100.0).alias("capital")))
    top = rows.orderBy(F.desc("_value"), "inventory_id").limit(n)
    cover = F.col("days_cover")
    tier = (F.when(cover >= 365, 40).when(cover >= 180, 30).when(cover >= 90, 20).otherwise(10))
    named = (top.join(stores.select("store_id", "store_name"), "store_id", "left")
             .join(warehouses.select("warehouse_id", "warehouse_name"), "warehouse_id", "left")
             .withColumn("_totals", totals).withColumn("pct", tier))
    cost = half_up(F.col("_value") * F.col("pct") / 100.0, 2)
    return named.select(
        "inventory_id", "product_id", "product_name", "category",
        F.coalesce("store_name", "warehouse_name", F.lit("—")).alias("location_name"),
        F.col("stock_qty").alias("stock"), half_up(cover, 1).alias("days_cover"),
        half_up(F.col("stockout_risk") * 100.0, 1).alias("stockout_risk_pct"),
        F.col("_value").alias("stock_value"), F.col("pct").alias("suggested_markdown_pct"),
        cost.alias("markdown_cost"), half_up(F.col("_value") - cost, 2).alias("freed"),
        F.col("_totals")["skus"].alias("overstocked_skus"),
        F.col("_totals")["capital"].alias("capital_tied_up"))


def demand_timeseries(transactions: DataFrame, days: int = 120) -> DataFrame:
    """Daily units of every product over its last ``days`` days, quiet days as zero."""
    daily = transactions.groupBy("product_id", F.col("transaction_date").alias("date")).agg(
        F.sum("quantity").alias("qty"))
    last = daily.groupBy("product_id").agg(F.max("date").alias("_last"))
    calendar = last.select("product_id", F.explode(F.sequence(
        F.date_sub("_last", days - 1), F.col("_last"))).alias("date"))
    filled = calendar.join(daily, ["product_id", "date"], "left").fillna(0, subset=["qty"])
    week = Window.partitionBy("product_id").orderBy("date").rowsBetween(-6, 0)
    return filled.withColumn("rolling_7_mean", half_up(F.avg("qty").over(week), 2))


def demand_cover(series: DataFrame, inventory: DataFrame) -> DataFrame:
    """Mean daily demand over the window and the cover it gives the stock on hand."""
    stock = inventory.groupBy("product_id").agg(F.sum("stock_qty").alias("current_stock"))
    pace = series.groupBy("product_id").agg(
        (F.sum("qty") / F.count(F.lit(1))).alias("avg"), F.min("date").alias("period_start"),
        F.max("date").alias("period_end"), F.count(F.lit(1)).alias("window_days"))
    joined = pace.join(stock, "product_id", "left").fillna(0, subset=["current_stock"])
    return joined.select(
        "product_id", "current_stock", half_up("avg", 2).alias("avg_daily_qty"),
        half_up(ratio("current_stock", "avg", 0.0), 1).alias("days_cover"), "window_days",
        "period_start", "period_end")


# ── replenishment ───────────────────────────────────────────────────────────

def replenishment(transactions: DataFrame, products: DataFrame, suppliers: DataFrame,
                  z: float | Column = DEFAULT_Z) -> DataFrame:
    """EOQ, safety stock and reorder point per product."""
    z = z if isinstance(z, Column) else F.lit(z)
    span = transactions.agg(F.greatest(F.datediff(
        F.max("transaction_date"), F.min("transaction_date")), F.lit(1)).alias("d")).scalar()
    daily = not_null(transactions, "product_id").groupBy("product_id", "transaction_date").agg(
        F.sum("quantity").alias("q"))
    per = daily.groupBy("product_id").agg(F.sum("q").alias("quantity"),
                                          F.stddev_samp("q").alias("std"))
    typical = exact_quantiles(suppliers, "lead_time_days", {"m": 0.5}).scalar()
    rows = (per.join(products.select("product_id", "price", "supplier_id"), "product_id", "left")
            .join(suppliers.select("supplier_id", "lead_time_days"), "supplier_id", "left")
            .withColumn("_span", span).withColumn("_typical", typical).withColumns({
                "demand": F.greatest(F.lit(1.0),
                                     F.col("quantity") * (F.lit(365.0) / F.col("_span"))),
                "lead": F.coalesce(F.col("lead_time_days").cast("double"), "_typical"),
                "std": F.coalesce("std", F.lit(1.0)),
                "holding": F.greatest(F.lit(1.0), half_up(
                    F.coalesce("price", F.lit(100.0)) * 0.18, 2))}))
    eoq = F.sqrt(F.col("demand") * 2 * 150.0 / F.col("holding"))
    safety = F.col("std") * F.sqrt("lead") * z
    return rows.select(
        "product_id", F.col("demand").cast("long").alias("annual_demand"),
        safety.cast("long").alias("safety_stock"),
        (F.col("demand") / 365 * F.col("lead") + safety).cast("long").alias("reorder_point"),
        eoq.cast("long").alias("recommended_order_quantity"),
        half_up("lead", 1).alias("lead_time_days"))


def replenishment_orders(plan: DataFrame, inventory: DataFrame, products: DataFrame,
                         suppliers: DataFrame) -> DataFrame:
    """The plan scaled to each stock location by its share of the product's capacity."""
    place = F.when(F.col("store_id").isNotNull(), F.concat(F.lit("store "), "store_id")).otherwise(
        F.concat(F.lit("warehouse "), "warehouse_id"))
    local = inventory.withColumn("location", place).groupBy("product_id", "location").agg(
        F.sum("stock_qty").alias("current_stock"), F.sum("max_stock").alias("max_stock"))
    total = local.groupBy("product_id").agg(F.sum("max_stock").alias("total_max"))
    rows = (local.join(total, "product_id").join(plan, "product_id")
            .join(products.select("product_id", "product_name", "cost_price", "supplier_id"),
                  "product_id")
            .join(suppliers.select("supplier_id", F.col("name").alias("supplier_name"),
                                   "reliability_score"), "supplier_id", "left"))
    share = F.when(F.col("total_max") > 0, F.col("max_stock") / F.col("total_max")).otherwise(1.0)

    def scaled(c: str) -> Column:
        return F.greatest(F.lit(1.0), half_up(F.col(c) * share)).cast("long")

    rows = rows.withColumns({"_rop": scaled("reorder_point"),
                             "_qty": scaled("recommended_order_quantity"),
                             "_safety": scaled("safety_stock")})
    return rows.select(
        "product_id", "product_name", "location", "current_stock", "max_stock",
        F.col("_qty").alias("reorder_qty"), F.col("_safety").alias("safety_stock"),
        F.col("_rop").alias("reorder_point"),
        half_up(F.col("_qty") * F.col("cost_price"), 2).alias("estimated_cost"),
        (F.col("current_stock") < F.col("_rop")).alias("urgency_flag"), "supplier_id",
        F.coalesce("supplier_name", F.lit("Unknown Supplier")).alias("supplier_name"),
        F.coalesce("reliability_score", F.lit(0.92)).alias("supplier_reliability"),
        "lead_time_days")


# ── warehouse slotting ──────────────────────────────────────────────────────

def abc_slotting(inventory: DataFrame, movements: DataFrame) -> DataFrame:
    """ABC class and zone of every product in every warehouse by movement volume."""
    moved = movements.groupBy("inventory_id").agg(F.sum("quantity").alias("moved"))
    volumes = (not_null(inventory, "warehouse_id").join(moved, "inventory_id", "left")
               .groupBy("warehouse_id", "product_id")
               .agg(F.coalesce(F.sum("moved"), F.lit(0)).alias("total_movements")))
    ranked = running_total(volumes, [-F.col("total_movements"), F.col("product_id")],
                           "total_movements", ("warehouse_id",))
    pct = F.when(F.col("total") > 0, F.col("running") / F.col("total") * 100).otherwise(100.0)
    cls = (F.when(F.col("total_movements") == 0, "C").when(pct <= 80.0, "A")
           .when(pct <= 95.0, "B").otherwise("C"))
    # The zone names.
    zone = (F.when(F.col("abc_class") == "A", "Zone 1 (Golden Fast Pick)")
            .when(F.col("abc_class") == "B", "Zone 2 (Mid Distance)")
            .otherwise("Zone 3 (Far Bulk Storage)"))
    return ranked.withColumn("abc_class", cls).select(
        "warehouse_id", "product_id", "total_movements", half_up(pct, 2).alias("cum_pct"),
        "abc_class", zone.alias("assigned_zone"))


def slotting_summary(slotting: DataFrame) -> DataFrame:
    """Class counts, shares and daily demand per warehouse, with the pick-time saving."""
    saving = (F.when(F.col("abc_class") == "A", 25.0).when(F.col("abc_class") == "B", 15.0)
              .otherwise(5.0))
    classes = slotting.groupBy("warehouse_id", "abc_class").agg(
        F.count(F.lit(1)).alias("products"), F.sum("total_movements").alias("moved"),
        F.sum(F.col("total_movements") * saving).alias("_saved"))
    whole = Window.partitionBy("warehouse_id")  # three rows per warehouse
    return classes.select(
        "warehouse_id", "abc_class", "products",
        half_up(F.col("products") / F.sum("products").over(whole) * 100, 1).alias("share_pct"),
        half_up(F.col("moved") / 90.0, 1).alias("daily_demand"),
        half_up(ratio(F.sum("_saved").over(whole), F.sum("moved").over(whole), 5.0), 1)
        .alias("pick_time_reduction_pct"))


# ── delivery ────────────────────────────────────────────────────────────────

def warehouse_lanes(shipments: DataFrame, orders: DataFrame, warehouses: DataFrame,
                    stores: DataFrame, stops: int = STOPS) -> DataFrame:
    """The busiest stores per warehouse, ties by store id; a warehouse that ships
    nowhere gets the first stores of the table."""
    counts = (shipments.select("order_id", "warehouse_id")
              .join(orders.select("order_id", "store_id").where("store_id IS NOT NULL"),
                    "order_id")
              .groupBy("warehouse_id", "store_id").agg(F.count(F.lit(1)).alias("shipments")))
    rank = F.row_number().over(Window.partitionBy("warehouse_id").orderBy(
        F.desc("shipments"), "store_id"))
    lanes = counts.withColumn("_n", rank).where(F.col("_n") <= stops).drop("_n")
    first = stores.select("store_id").orderBy("store_id").limit(stops).agg(
        F.collect_list("store_id").alias("s")).scalar()
    idle = (warehouses.select("warehouse_id")
            .join(lanes.select("warehouse_id").distinct(), "warehouse_id", "left_anti")
            .withColumn("_s", first)
            .select("warehouse_id", F.explode("_s").alias("store_id"),
                    F.lit(0).cast("long").alias("shipments")))
    return lanes.unionByName(idle)


def _located(lanes: DataFrame, warehouses: DataFrame, stores: DataFrame) -> DataFrame:
    depot = warehouses.select("warehouse_id", F.col("latitude").alias("wlat"),
                              F.col("longitude").alias("wlon"))
    shop = stores.select("store_id", F.col("latitude").alias("slat"),
                         F.col("longitude").alias("slon"))
    return lanes.join(depot, "warehouse_id").join(shop, "store_id")


def route_baseline(lanes: DataFrame, warehouses: DataFrame, stores: DataFrame) -> DataFrame:
    """Length of the tour that visits a warehouse's stores in id order."""
    order = Window.partitionBy("warehouse_id").orderBy("store_id")  # a warehouse's lanes
    legs = _located(lanes, warehouses, stores).select(
        "warehouse_id",
        haversine_km(F.coalesce(F.lag("slat").over(order), "wlat"),
                     F.coalesce(F.lag("slon").over(order), "wlon"), "slat", "slon").alias("leg"),
        F.when(F.lead("store_id").over(order).isNull(),
               haversine_km("slat", "slon", "wlat", "wlon")).alias("home"))
    return legs.groupBy("warehouse_id").agg(half_up(
        F.sum("leg") + F.sum("home"), 2).alias("baseline_distance_km"),
        F.count(F.lit(1)).alias("stops"))


EXACT_STOPS = 12


def nearest_order(table: np.ndarray) -> list[int]:
    """Stops 1..n by the nearest one not yet visited, from place 0; ties go to the smaller stop."""
    order, left = [0], set(range(1, len(table)))
    while left:
        order.append(min(left, key=lambda stop: (table[order[-1], stop], stop)))
        left.remove(order[-1])
    return order[1:]


def visiting_order(km: list[list[float]], exact_stops: int = EXACT_STOPS) -> list[int]:
    """Order of the stops 1..n of the shortest round trip from place 0 over a distance table.

    Up to ``exact_stops`` by dynamic programming over sets of stops, which is exact; ties, to
    half a millimetre, go to the smallest order. Beyond, the nearest unvisited stop each time,
    then reversals of a stretch while one shortens the trip.
    """
    table = np.array([list(row) for row in km], dtype=float)
    n = len(table) - 1
    if n < 2:
        return list(range(1, n + 1))
    if n > exact_stops:
        order, better = [0, *nearest_order(table), 0], True
        while better:
            better = False
            for i in range(1, n):
                for j in range(i + 1, n + 1):
                    before = table[order[i - 1], order[i]] + table[order[j], order[j + 1]]
                    after = table[order[i - 1], order[j]] + table[order[i], order[j + 1]]
                    if after < before - 1e-9:
                        order[i:j + 1] = order[i:j + 1][::-1]
                        better = True
        return order[1:-1]
    # home[left][at]: shortest way from ``at`` through all of ``left`` back to place 0.
    home = np.full((1 << n, n + 1), np.inf)
    home[0] = table[:, 0]
    for left in range(1, 1 << n):
        stops = [k for k in range(n) if left >> k & 1]
        ways = [table[:, k + 1] + home[left & ~(1 << k), k + 1] for k in stops]
        home[left] = np.min(ways, axis=0)
    order, at, left = [], 0, (1 << n) - 1
    slack = home[left, 0] + 5e-7
    while left:
        for k in range(n):
            way = table[at, k + 1] + home[left & ~(1 << k), k + 1] if left >> k & 1 else np.inf
            if way <= slack:
                order.append(k + 1)
                slack -= table[at, k + 1]
                at, left = k + 1, left & ~(1 << k)
                break
    return order


def delivery_tours(lanes: DataFrame, warehouses: DataFrame, stores: DataFrame,
                   exact_stops: int = EXACT_STOPS) -> DataFrame:
    """Short round trip of every warehouse over all its stores, however many.

    One row per warehouse holds its distance table, and its order is found inside the row; see
    ``visiting_order``. ``exact`` says whether the order is the best of all; beyond ``exact_stops``
    it need not be. A warehouse with one store goes there and back. The nearest-neighbour tour's
    length is given beside that of the stores in the order of their ids.
    """
    ship(lanes.sparkSession)

    def search(tables):
        import pandas as pd
        return pd.DataFrame({
            "best": [visiting_order(t, exact_stops) for t in tables],
            "nearest": [nearest_order(np.array([list(r) for r in t], dtype=float))
                        for t in tables]})

    per = _located(lanes, warehouses, stores).groupBy("warehouse_id", "wlat", "wlon").agg(
        F.array_sort(F.collect_list(F.struct("store_id", F.col("slat").alias("lat"),
                                             F.col("slon").alias("lon"), "shipments")))
        .alias("stops"))
    per = spread(per.withColumn("n", F.size("stops")), "warehouse_id")
    points = F.concat(F.array(F.struct(F.col("wlat").alias("lat"), F.col("wlon").alias("lon"))),
                      F.transform("stops", lambda s: F.struct(s["lat"].alias("lat"),
                                                              s["lon"].alias("lon"))))
    per = pinned(per.withColumn("points", points), km=F.transform(
        "points", lambda a: F.transform("points", lambda b: haversine_km(
            a["lat"], a["lon"], b["lat"], b["lon"]))))
    per = per.withColumn("order", F.pandas_udf(
        search, "best array<int>, nearest array<int>")("km"))

    def length(order: Column) -> Column:
        trip = F.aggregate(
            order, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at")),
            lambda acc, stop: F.struct(
                (acc["sum"] + F.get(F.get("km", acc["at"]), stop)).alias("sum"),
                stop.alias("at")))
        return half_up(trip["sum"] + F.get(F.get("km", trip["at"]), F.lit(0)), 6)

    best = F.struct(length(F.col("order.best")).alias("km"), F.col("order.best").alias("order"),
                    length(F.col("order.nearest")).alias("nearest"))
    names = F.array_join(F.transform("best.order", lambda i: F.get(
        "stops", i - 1)["store_id"].cast("string")), " > ")
    items = F.aggregate("stops", F.lit(0).cast("long"), lambda n, s: n + s["shipments"])
    tours = pinned(per, best=best).select(
        "warehouse_id", F.col("n").alias("stops_count"), names.alias("route_order"),
        half_up("best.km", 2).alias("distance_km"), (F.col("n") <= exact_stops).alias("exact"),
        half_up("best.nearest", 2).alias("nearest_neighbour_distance_km"),
        half_up(F.col("best.km") / 50.0, 1).alias("estimated_time_hrs"),
        F.when(items == 0, 75).otherwise(items).alias("total_orders"))
    base = route_baseline(lanes, warehouses, stores).drop("stops")
    saved = half_up(F.greatest(F.lit(0.0), F.col("baseline_distance_km") - F.col("distance_km")),
                    2)
    return tours.join(base, "warehouse_id").withColumn("distance_saved_km", saved).withColumn(
        "saving_pct", half_up(ratio("distance_saved_km", "baseline_distance_km", 0.0) * 100, 1))


def delivery_speed(shipments: DataFrame, warehouses: DataFrame, stores: DataFrame) -> DataFrame:
    """Median km per hour of plausible deliveries; 40 when there are too few."""
    timed = shipments.where("store_id IS NOT NULL AND hours > 0 AND hours < 240")
    speeds = (_located(timed, warehouses, stores)
              .select(half_up(haversine_km("wlat", "wlon", "slat", "slon") / F.col("hours"), 4)
                      .alias("speed")).where("speed > 1 AND speed < 200"))
    valid = speeds.agg(F.count(F.lit(1)).alias("n"))
    median = exact_quantiles(speeds, "speed", {"m": 0.5}).scalar()
    return valid.select(F.col("n").alias("deliveries"),
                        F.when(F.col("n") > 10, median).otherwise(40.0).alias("speed_kmh"))


# City coordinates (latitude, longitude), and the default for any other city.
CITY_COORDINATES = {
    "Mumbai": (19.0760, 72.8777), "Delhi": (28.7041, 77.1025), "Bengaluru": (12.9716, 77.5946),
    "Hyderabad": (17.3850, 78.4867), "Chennai": (13.0827, 80.2707),
    "Kolkata": (22.5726, 88.3639), "Pune": (18.5204, 73.8567), "Ahmedabad": (23.0225, 72.5714),
    "Jaipur": (26.9124, 75.7873), "Lucknow": (26.8467, 80.9462), "Surat": (21.1702, 72.8311),
    "Kochi": (9.9312, 76.2673), "Chandigarh": (30.7333, 76.7794), "Bhopal": (23.2599, 77.4126),
    "Indore": (22.7196, 75.8577), "Nagpur": (21.1458, 79.0882), "Patna": (25.5941, 85.1376),
    "Vadodara": (22.3072, 73.1812), "Ludhiana": (30.9010, 75.8573), "Agra": (27.1767, 78.0081)}
DEFAULT_COORDINATES = (22.9734, 78.6569)


def locate(places: DataFrame, city: str = "city") -> DataFrame:
    """Add latitude and longitude by city name."""
    table = F.create_map(*[x for name, (lat, lon) in CITY_COORDINATES.items()
                           for x in (F.lit(name), F.array(F.lit(lat), F.lit(lon)))])
    found = F.coalesce(F.try_element_at(table, F.col(city)),
                       F.array(*[F.lit(x) for x in DEFAULT_COORDINATES]))
    return places.withColumns({"latitude": found[0], "longitude": found[1]})
