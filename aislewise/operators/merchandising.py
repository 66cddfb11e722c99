"""Elasticity, pricing, promotion analysis, competitor gaps and assortment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aislewise.functions.distributed import exact_quantiles, running_total
from aislewise.functions.scalars import (clip, half_up, money_mean, money_sum, not_null, one_row,
                                         pinned, ratio, spread)
from aislewise.operators.offers import daily_revenue, window_sums, with_length
from aislewise.session import stored

DEFAULT_ELASTICITY = -1.2


# ── prices ──────────────────────────────────────────────────────────────────

def price_elasticity(pricing_history: DataFrame, transactions: DataFrame) -> DataFrame:
    """Mean of quantity change over price change between consecutive price periods.

    Sales find their period by a sorted pass over the two logs stacked (prices first on
    a day), not by a range join. Both are per product and day before they are stacked,
    several prices of one day as their mean, so a product's pass is bounded by its days.
    """
    order = Window.partitionBy("product_id").orderBy("effective_date")
    # Several sorts and windows share a task's memory: tasks are as many as asked for, not as few as
    # the narrow rows would fit.
    prices = spread(not_null(pricing_history, "product_id", "effective_date", "price").select(
        "product_id", "effective_date", "price"), "product_id").groupBy(
        "product_id", "effective_date").agg(money_mean("price").alias("price")).select(
        "product_id", "effective_date", "price",
        F.row_number().over(order).alias("period"),
        F.lead("effective_date").over(order).alias("until"))
    daily = not_null(transactions, "product_id").groupBy(
        "product_id", F.col("transaction_date").alias("day")).agg(F.sum("quantity").alias("units"))
    stacked = prices.select("product_id", F.col("effective_date").alias("day"), F.lit(0).alias("k"),
                            "period", F.lit(0).cast("long").alias("units")).unionByName(
        daily.select("product_id", "day", F.lit(1).alias("k"),
                     F.lit(None).cast("int").alias("period"), "units"))
    so_far = Window.partitionBy("product_id").orderBy("day", "k").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    units = (spread(stacked, "product_id").withColumn("period", F.max("period").over(so_far))
             .where("period IS NOT NULL").groupBy("product_id", "period")
             .agg(F.sum("units").alias("units")))
    by_period = Window.partitionBy("product_id").orderBy("period")
    rates = (prices.where("until IS NOT NULL").join(units, ["product_id", "period"], "left")
             .withColumn("rate", F.coalesce("units", F.lit(0))
                         / F.greatest(F.datediff("until", "effective_date"), F.lit(1))))

    def change(c: str) -> Column:
        return F.try_divide(F.col(c) - F.lag(c).over(by_period), F.lag(c).over(by_period))

    changes = rates.select("product_id", change("price").alias("dp"), change("rate").alias("dq"))
    found = changes.groupBy("product_id").agg(
        F.avg(F.try_divide("dq", "dp")).alias("e"), F.sum(F.abs("dp")).alias("moved"))
    usable = F.when(F.col("moved") >= 1e-6, clip("e", -3.0, -0.1))
    return pricing_history.select("product_id").distinct().join(found, "product_id", "left").select(
        "product_id", F.coalesce(usable, F.lit(DEFAULT_ELASTICITY)).alias("elasticity"))


def dynamic_price(products: DataFrame, competitor_pricing: DataFrame, inventory: DataFrame,
                  inventory_features: DataFrame, elasticity: DataFrame) -> DataFrame:
    """Recommended price per product from the market, stock, risk, velocity and elasticity."""
    market = competitor_pricing.groupBy("product_id").agg(
        F.min("price").alias("comp_min"), money_mean("price").alias("comp_avg"))
    stock = inventory.groupBy("product_id").agg(
        F.sum("stock_qty").alias("stock"), F.sum("max_stock").alias("max_stock"),
        F.max("stockout_risk").alias("risk"))
    pace = inventory_features.groupBy("product_id").agg(
        money_mean("avg_daily_demand").alias("velocity"))
    typical_ratio = exact_quantiles(
        stock.where("max_stock > 0").select((F.col("stock") / F.col("max_stock")).alias("r")),
        "r", {"m": 0.5}).scalar()
    typical_demand = exact_quantiles(inventory_features, "avg_daily_demand", {"m": 0.5}).scalar()

    wide = products
    for part in (market, stock, pace, elasticity):
        wide = wide.join(part, "product_id", "left")
    now = F.col("price")
    wide = (pinned(wide, _ratio0=typical_ratio, _demand0=typical_demand)
            .withColumns({
                "_cost": F.coalesce(F.nullif(F.col("cost_price"), F.lit(0.0)), now * 0.6),
                "_market": F.coalesce(F.col("comp_avg"), now),
                "_stock": F.coalesce(F.col("stock"), F.lit(0)),
                "_ratio": F.coalesce(F.col("stock"), F.lit(0)) / F.when(
                    F.col("max_stock") > 0, F.col("max_stock").cast("double")).otherwise(500.0),
                "_velocity": F.coalesce("velocity", "_demand0"),
                "elasticity": F.coalesce("elasticity", F.lit(DEFAULT_ELASTICITY))}))
    pace_factor = clip((F.log1p("_velocity") - F.log1p(F.greatest("_demand0", F.lit(0.1)))) * 0.04,
                       -0.06, 0.06)
    adjust = ((F.col("_ratio0") - F.col("_ratio")) * 0.14
              + F.coalesce(F.col("risk"), F.lit(0)) * 0.08 + pace_factor)
    banded = F.greatest(now * 0.75, F.least(F.col("_market") * (adjust + 1.0), now * 1.25))
    wide = wide.withColumn("_target", F.greatest(F.col("_cost") * 1.05, banded))
    wide = wide.withColumn("_delta", (F.col("_target") - now) / now * 100.0)
    wide = wide.withColumn("_volume", F.col("elasticity") * F.col("_delta"))
    lift = half_up(F.col("_delta") + F.col("_volume")
                   + F.col("_delta") * F.col("_volume") / 100.0, 2)

    def percent(c: str) -> Column:
        return F.concat(half_up(F.col(c) * 100, 1).cast("string"), F.lit("%"))

    # The sentences of the rationale.
    against = F.concat(F.lit(" (ratio "), percent("_ratio"), F.lit(" vs. population median "),
                       percent("_ratio0"), F.lit("). "))
    rationale = (
        F.when(F.col("_ratio") > 0.8, F.concat(
            F.lit("Surplus stock"), against,
            F.lit("Applied markdown to accelerate inventory velocity.")))
        .when(F.col("_ratio") < 0.25, F.concat(
            F.lit("Low stock alert"), against,
            F.lit("Applied premium markup for margin optimization.")))
        .otherwise("Stock level stable. Pricing optimized against competitor average."))
    recommended, current = half_up("_target", 2), half_up(now, 2)
    return wide.select(
        "product_id", "product_name", "category", current.alias("current_price"),
        recommended.alias("recommended_price"),
        half_up((recommended - current) / current * 100.0, 2).alias("price_delta_pct"),
        half_up(current * 0.75, 2).alias("floor_price"),
        F.greatest(F.lit(0.5), lift).alias("expected_revenue_lift_pct"),
        rationale.alias("rationale"), half_up("_market", 2).alias("avg_competitor_price"),
        half_up(F.coalesce("comp_min", half_up("_market", 2) * 0.92), 2)
        .alias("min_competitor_price"),
        F.col("_stock").alias("stock_level"), half_up("elasticity", 2).alias("price_elasticity"),
        half_up("_cost", 2).alias("cost_price"))


def price_scenarios(priced: DataFrame,
                    multipliers: Sequence[float] = (0.8, 0.9, 1.0, 1.1, 1.2)) -> DataFrame:
    """What each candidate price would do to volume, revenue and margin."""
    rows = priced.withColumn("multiplier", F.explode(F.array(*[F.lit(m) for m in multipliers])))
    rows = rows.withColumn("candidate_price",
                           half_up(F.col("recommended_price") * F.col("multiplier"), 2))
    p, current, cost = F.col("candidate_price"), F.col("current_price"), F.col("cost_price")
    rows = rows.withColumn("_delta", (p - current) / current * 100)
    rows = rows.withColumn("_volume", F.col("price_elasticity") * F.col("_delta"))
    floor = F.col("floor_price")
    market, lowest = F.col("avg_competitor_price"), F.col("min_competitor_price")
    return rows.select(
        "product_id", "multiplier", "candidate_price", half_up("_delta", 4).alias("delta_pct"),
        half_up("_volume", 4).alias("volume_pct"),
        half_up(F.col("_delta") + F.col("_volume") + F.col("_delta") * F.col("_volume") / 100, 4)
        .alias("revenue_pct"),
        half_up((p - cost) / p * 100, 4).alias("margin_pct"),
        half_up((current - cost) / current * 100, 4).alias("margin_now_pct"),
        F.when(p < cost, "below cost").when(p < floor, "below floor").otherwise("ok")
        .alias("margin_flag"),
        F.when(p <= lowest, "undercuts every competitor").when(
            p <= market, "at or under market average").otherwise("above market average")
        .alias("market_flag"),
        half_up((p - market) / market * 100, 4).alias("vs_market_pct"))


# ── promotions ──────────────────────────────────────────────────────────────

def promo_did(promotions: DataFrame, transactions: DataFrame, products: DataFrame) -> DataFrame:
    """Each promotion against its own 90-day baseline and its category's other products."""
    promos = (with_length(promotions).withColumn("history_start", F.date_sub("start_date", 90))
              .join(not_null(products, "category").select("product_id", "category"),
                    "product_id"))
    per_product = daily_revenue(transactions, "product_id")
    per_category = (per_product.join(products.select("product_id", "category"), "product_id")
                    .where("category IS NOT NULL").groupBy("category", "day")
                    .agg(F.sum("cents").alias("cents"), F.sum("sales").alias("sales")))
    day = F.col("day")
    before = (day >= F.col("history_start")) & (day < F.col("start_date"))
    during = day.between(F.col("start_date"), F.col("end_date"))

    def windows(df: DataFrame, daily: DataFrame, key: str, prefix: str) -> DataFrame:
        return window_sums(df, daily, key, "promo_id", F.col("history_start"), F.col("end_date"), {
            f"{prefix}_before": F.when(before, F.col("cents")),
            f"{prefix}_during": F.when(during, F.col("cents")),
            f"{prefix}_sales": F.when(before, F.col("sales"))})

    both = windows(windows(promos, per_product, "product_id", "own"),
                   per_category, "category", "all")
    sisters = products.groupBy("category").agg((F.count(F.lit(1)) - 1).alias("sisters"))
    scale = F.col("days") / 90.0
    shaped = both.join(sisters, "category", "left").withColumns({
        "own_history": F.col("own_before") / 100.0,
        "treated": F.col("own_during") / 100.0,
        "sister_history": (F.col("all_before") - F.col("own_before")) / 100.0,
        "sister_during": (F.col("all_during") - F.col("own_during")) / 100.0,
        "history_sales": F.col("all_sales")})
    shaped = shaped.withColumns({"baseline": F.col("own_history") * scale,
                                 "sister_baseline": F.col("sister_history") * scale})
    gain = F.greatest(F.lit(0.0), F.col("treated") - F.col("baseline"))
    drop = F.greatest(F.lit(0.0), F.col("sister_baseline") - F.col("sister_during"))
    usable = (F.col("baseline") > 0) & (F.col("sister_baseline") > 0)
    return shaped.withColumns({
        "uplift_frac": F.when(usable, (F.col("treated") - F.col("baseline")) / F.col("baseline")),
        "cannibal_rate": F.when(usable & (gain > 0),
                                F.least(F.lit(0.60), ratio(drop, gain)))}).select(
        *promotions.columns, "category", "days", "sisters", "own_history", "treated",
        "sister_history", "sister_during", "history_sales", "uplift_frac", "cannibal_rate")


def promo_curve(did: DataFrame) -> DataFrame:
    """Discount-to-uplift line and the mean cannibalisation rate, over every promotion."""
    y = F.when(F.col("uplift_frac").between(-1, 5), F.col("uplift_frac"))
    fit = did.agg(F.count(y).alias("n_uplift"), F.regr_slope(y, "discount_pct").alias("s"),
                  F.regr_intercept(y, "discount_pct").alias("i"),
                  F.count("cannibal_rate").alias("n_cannibal"),
                  F.avg("cannibal_rate").alias("c"))
    enough = F.col("n_uplift") >= 10
    return fit.select("n_uplift", "n_cannibal",
                      F.when(enough, F.col("s")).otherwise(2.2).alias("slope"),
                      F.when(enough, F.col("i")).otherwise(0.05).alias("intercept"),
                      F.when(F.col("n_cannibal") >= 10, F.col("c")).otherwise(0.14)
                      .alias("cannibal_rate"))


def promo_performance(did: DataFrame, products: DataFrame) -> DataFrame:
    """Blended revenue, incremental value, cannibalisation and confidence per promotion."""
    curve = one_row(promo_curve(did), "slope", "intercept", "cannibal_rate")
    d = (pinned(did.drop("cannibal_rate"), _curve=curve)
         .join(products.select("product_id", "product_name"), "product_id", "left"))
    days, sisters = F.col("days"), F.col("sisters")
    per_sister = F.when(F.col("sister_history") > 0, F.col("sister_history")
                        / (F.greatest(sisters, F.lit(1)) * 90.0)).otherwise(50.0)
    d = d.withColumn("_daily", per_sister).withColumn("_baseline", F.when(
        F.col("own_history") > 0, F.col("own_history") / 90.0).otherwise(F.col("_daily")) * days)
    depth = F.when(F.col("discount_pct") <= 1.0, F.col("discount_pct")).otherwise(
        F.col("discount_pct") / 100.0)
    line = F.col("_curve")
    expected = clip(line["slope"] * depth + line["intercept"], 0.02, 4.0)
    d = d.withColumn("_model", F.col("_baseline") * (expected + 1.0))
    d = d.withColumn("_promo", F.when(F.col("treated") > 0, F.col("treated") * 0.40
                                      + F.col("_model") * 0.60).otherwise(F.col("_model")))
    d = d.withColumn("_sister_pre", F.when(sisters > 0, F.col("_daily") * sisters * days)
                     .otherwise(F.col("_daily") * 5 * days))
    gain = F.greatest(F.lit(0.0), F.col("_promo") - F.col("_baseline"))
    d = d.withColumn("_smoothed", F.col("_sister_pre") - line["cannibal_rate"] * gain)
    d = d.withColumn("_sister", F.when(F.col("sister_during") > 0, F.col("sister_during") * 0.3
                                       + F.col("_smoothed") * 0.7).otherwise(F.col("_smoothed")))
    incremental = F.greatest(F.col("_baseline") * 0.08,
                             (F.col("_promo") - F.col("_baseline"))
                             - (F.col("_sister") - F.col("_sister_pre")))
    expected_rate = line["cannibal_rate"] * (depth / 0.20)
    measured = F.greatest(F.lit(0.0), (F.col("_sister_pre") - F.col("_sister"))
                          / F.greatest(F.lit(1.0), F.col("_promo") - F.col("_baseline")))
    both = (F.col("sister_during") > 0) & (F.col("treated") > 0)
    rate = clip(F.when(both, (expected_rate * 0.5 + measured * 0.5) * 100.0)
                .otherwise(expected_rate * 100.0), 1.5, 35.0)
    confidence = clip(
        F.least(F.lit(1.0), F.log1p("history_sales") / 8.0) * 0.15 + 0.70
        + F.least(days, F.lit(14)) / 14.0 * 0.08, 0.65, 0.98)
    control, treated = half_up("_baseline", 2), half_up("_promo", 2)
    label = F.concat(F.col("promo_type"), F.lit(" · "),
                     half_up(F.col("discount_pct") * 100).cast("long").cast("string"),
                     F.lit("% off · "), F.col("target_segment"))
    return d.select(
        "promo_id", label.alias("promo_name"), "product_id", "product_name",
        control.alias("control_revenue"), treated.alias("treated_revenue"),
        half_up(incremental, 2).alias("incremental_revenue"),
        half_up(F.when(control > 0, (treated - control) / control * 100.0).otherwise(0.0), 2)
        .alias("uplift_pct"),
        half_up(half_up(rate, 2) / 100.0, 4).alias("cannibalization_rate"),
        half_up(confidence, 2).alias("confidence"))


# ── competitors ─────────────────────────────────────────────────────────────

def competitor_gaps(products: DataFrame, competitor_pricing: DataFrame) -> DataFrame:
    """Gap to the mean competitor price as a z-score, with status and suggested price."""
    market = competitor_pricing.groupBy("product_id").agg(money_mean("price").alias("market"))
    gaps = stored(products.select("product_id", "product_name", "category", "price")
                  .join(market, "product_id").withColumn(
                      "_gap", (F.col("price") - F.col("market")) / F.col("market") * 100))
    spread = one_row(gaps.agg(F.avg("_gap").alias("mean"), F.stddev_samp("_gap").alias("std")))
    z = F.col("_z")
    gaps = gaps.withColumn("_s", spread).withColumn(
        "_z", (F.col("_gap") - F.col("_s")["mean"]) / F.when(
            F.col("_s")["std"] > 0, F.col("_s")["std"]).otherwise(1.0))
    return gaps.select(
        "product_id", "product_name", "category", F.col("price").alias("our_price"),
        half_up("market", 6).alias("avg_competitor_price"),
        half_up("_gap", 2).alias("price_gap_pct"), half_up(z, 2).alias("z_score"),
        F.when(z > 1.5, "Overpriced").when(z < -1.5, "Underpriced").otherwise("Optimal")
        .alias("status"),
        F.when(z > 1.5, "Reduce price to align with competition")
        .when(z < -1.5, "Opportunity to raise price and gain margin")
        .otherwise("Maintain current pricing").alias("recommended_action"),
        half_up(F.when(z > 1.5, F.col("market") * 1.02).when(z < -1.5, F.col("market") * 0.98)
                .otherwise(F.col("price")), 2).alias("suggested_price"),
        (F.abs(z) > 1.5).alias("alert_flag"))


def competitor_kpis(gaps: DataFrame) -> DataFrame:
    """Size of the sweep, alerts, and the shares above and below the market."""
    above = F.count_if(F.col("price_gap_pct") > 0)
    total = F.count(F.lit(1))
    return gaps.agg(
        total.alias("skus_monitored"), F.count_if("alert_flag").alias("alerts"),
        half_up(ratio(F.count_if("alert_flag"), total, 0.0) * 100, 1).alias("alert_pct"),
        half_up(ratio(above, total, 0.0) * 100, 1).alias("above_pct"),
        half_up(ratio(total - above, total, 0.0) * 100, 1).alias("below_pct"))


def competitor_breaches(gaps: DataFrame, n: int = 8) -> DataFrame:
    """The n alerts furthest from the market."""
    return (gaps.where("alert_flag").orderBy(F.desc(F.abs("price_gap_pct")), "product_id")
            .limit(n))


def gap_stats_latest(competitor_pricing: DataFrame, pricing_history: DataFrame,
                     price_id: Sequence[str] = ()) -> DataFrame:
    """Mean and deviation of the gap of the latest own price to every competitor price."""
    latest = pricing_history.groupBy("product_id").agg(
        F.max_by("price", F.struct("effective_date", *price_id)).alias("ours"))
    gap = (F.col("ours") - F.col("price")) / F.col("price") * 100
    stats = competitor_pricing.join(latest, "product_id").agg(
        F.avg(gap).alias("mean_gap"), F.stddev_samp(gap).alias("s"))
    return stats.select("mean_gap", F.when(F.col("s").isNull() | (F.col("s") < 0.1), 5.0)
                        .otherwise(F.col("s")).alias("std_gap"))


# ── assortment ──────────────────────────────────────────────────────────────

def regional_revenue(orders: DataFrame, stores: DataFrame) -> DataFrame:
    """Revenue in cents and order lines per (region, product); region is null online."""
    sold = orders.where(~F.coalesce(F.col("status"), F.lit("")).isin("Cancelled", "Returned"))
    return (sold.groupBy("store_id", "product_id")
            .agg(F.sum(F.floor(F.coalesce("total_amount", F.lit(0.0)) * 100.0 + 0.5))
                 .alias("cents"), F.count(F.lit(1)).alias("lines"))
            .join(stores.select("store_id", "region"), "store_id", "left")
            .groupBy("region", "product_id")
            .agg(F.sum("cents").alias("cents"), F.sum("lines").alias("lines")))


def assortment_pareto(orders: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """How few products earn the first 80 % of revenue, per region and overall."""
    regional = stored(regional_revenue(orders, stores))
    overall = (regional.groupBy("product_id")
               .agg(F.sum("cents").alias("cents"), F.sum("lines").alias("lines"))
               .select(F.lit("All").alias("region"), "product_id", "cents", "lines"))
    stacked = regional.where("region IS NOT NULL").unionByName(overall)
    ranked = running_total(stacked, [-F.col("cents"), F.col("product_id")], "cents", ("region",))
    catalogue = products.agg(F.count_distinct("product_id").alias("n")).scalar()
    return ranked.groupBy("region").agg(
        F.count(F.lit(1)).alias("skus_selling"), (F.sum("cents") / 100.0).alias("revenue"),
        F.sum("lines").alias("orders_analysed"),
        F.count_if(F.col("running") <= F.col("total") * 0.80).alias("pareto_skus")).select(
        "region", catalogue.alias("catalogue_skus"), "skus_selling", "revenue",
        "orders_analysed", "pareto_skus",
        half_up(F.col("pareto_skus") / F.col("skus_selling") * 100, 1).alias("pareto_sku_pct"))


def assortment_candidates(orders: DataFrame, stores: DataFrame, products: DataFrame,
                          inventory: DataFrame) -> DataFrame:
    """Per region: all products to add (strong elsewhere, absent here) and to drop, with their
    value; a caller ranks and limits."""
    regional = stored(regional_revenue(orders, stores))
    here = regional.where("region IS NOT NULL")
    # regions are an enumeration: each product meets every region once
    regions = here.agg(F.array_sort(F.collect_set("region")).alias("r")).scalar()
    total = regional.groupBy("product_id").agg(F.sum("cents").alias("all_cents"),
                                               F.sum("lines").alias("all_lines"))
    every = (total.withColumn("_r", regions).withColumn("region", F.explode("_r")).drop("_r")
             .join(here, ["region", "product_id"], "left"))
    elsewhere = every.where("all_lines > coalesce(lines, 0)").select(
        "region", "product_id", F.col("cents").isNotNull().alias("sold_here"),
        (F.col("all_cents") - F.coalesce("cents", F.lit(0))).alias("other_cents"))
    peer = exact_quantiles(elsewhere, "other_cents", {"median": 0.5}, ("region",))
    missing = (elsewhere.where("NOT sold_here").join(peer, "region")
               .where(F.col("other_cents") > F.col("median")))
    adds = missing.select(
        "region", "product_id", F.lit("add").alias("kind"),  # fixed values: kinds and statuses
        half_up(F.col("other_cents") / 100.0 * 0.15, 2).alias("value"),
        F.lit("Not stocked in target region").alias("status"))
    median = exact_quantiles(here, "cents", {"median": 0.5}, ("region",))
    held = inventory.groupBy("product_id").agg(F.sum("stock_qty").alias("stock"))
    drops = (here.join(median, "region").where(F.col("cents") < F.col("median") * 0.25)
             .join(held, "product_id", "left")
             .join(products.select("product_id", "price"), "product_id", "left")
             .select("region", "product_id", F.lit("drop").alias("kind"),
                     half_up(F.coalesce("stock", F.lit(0)) * F.coalesce("price", F.lit(0.0)), 2)
                     .alias("value"),
                     F.lit("Below 25% of median SKU revenue").alias("status")))
    return adds.unionByName(drops).join(
        products.select("product_id", "product_name", "category"), "product_id", "left")


# ── forecast shaping ────────────────────────────────────────────────────────

def forecast_band(forecast: DataFrame) -> DataFrame:
    """95 % band around each predicted day from the model's own error (percent ``mape``)."""
    qty = F.col("forecast_qty")
    error = F.greatest(F.col("mape") / 100.0 * qty, F.lit(0.5))
    return forecast.withColumns({
        "lower_bound": half_up(F.greatest(F.lit(0.0), qty - error * 1.96), 1),
        "upper_bound": half_up(qty + error * 1.96, 1)})


def forecast_totals(forecast: DataFrame) -> DataFrame:
    """Total and mean per day of the horizon, per product."""
    return forecast.groupBy("product_id").agg(
        half_up(money_sum("forecast_qty"), 1).alias("total_forecast"),
        half_up(money_mean("forecast_qty"), 2).alias("avg_daily_demand"),
        F.count(F.lit(1)).alias("days"))
