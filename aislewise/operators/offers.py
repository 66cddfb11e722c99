"""Promotion windows, uplift, and the offers built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aislewise.functions.scalars import clip, half_up, one_row
from aislewise.session import stored

BIN_DAYS = 32


def month_bin(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BIN_DAYS)


def daily_revenue(transactions: DataFrame, key: str) -> DataFrame:
    """(key, day) revenue in whole cents, plus the number of sales."""
    return (transactions.where(F.col(key).isNotNull())
            .groupBy(key, F.col("transaction_date").alias("day"))
            .agg(F.sum(F.floor(F.col("total_amount") * 100.0 + 0.5)).alias("cents"),
                 F.count(F.lit(1)).alias("sales")))


def window_sums(windows: DataFrame, daily: DataFrame, key: str, row_id: str,
                first: Column, last: Column, measures: dict[str, Column]) -> DataFrame:
    """Sum daily figures over each row's date windows: a range join on (key, 32-day bin).

    A row meets only the bins its span touches, so the join stays an equi-join whose
    keys spread one product over many tasks. It is a merge: Spark takes the exploded spans
    for as small as their file and would broadcast them. ``measures`` are expressions of ``day``,
    ``cents``, ``sales`` and the row's own columns, summed per row; 0 without sales.
    """
    spread = windows.withColumn("_bin", F.explode(F.sequence(month_bin(first), month_bin(last))))
    binned = daily.withColumn("_bin", month_bin(F.col("day")))
    sums = (spread.join(binned.hint("merge"), [key, "_bin"]).groupBy(row_id)
            .agg(*[F.sum(m).alias(n) for n, m in measures.items()]))
    return windows.join(sums.hint("merge"), row_id, "left").fillna(0, subset=list(measures))


def with_length(promotions: DataFrame) -> DataFrame:
    """Length in days; a zero-day promotion counts as a week."""
    days = F.datediff("end_date", "start_date")
    return promotions.withColumn("days", F.when(days == 0, 7).otherwise(days))


def promo_uplift(promotions: DataFrame, transactions: DataFrame) -> DataFrame:
    """Revenue during the promotion against the equally long window before it."""
    promos = with_length(promotions).withColumn(
        "control_start", F.expr("date_sub(start_date, days)"))
    day, cents = F.col("day"), F.col("cents")
    summed = window_sums(
        promos, daily_revenue(transactions, "product_id"), "product_id", "promo_id",
        F.col("control_start"), F.col("end_date"), {
            "treated_cents": F.when(day.between(F.col("start_date"), F.col("end_date")), cents),
            "control_cents": F.when((day >= F.col("control_start"))
                                    & (day < F.col("start_date")), cents)})
    treated, control = F.col("treated_cents") / 100.0, F.col("control_cents") / 100.0
    return summed.select(
        *promotions.columns, treated.alias("treated_revenue"), control.alias("control_revenue"),
        F.when(control > 0, (treated - control) / control * 100).alias("uplift_pct"))


def uplift_trend(uplift: DataFrame) -> DataFrame:
    """Least-squares line of uplift over discount, on every usable promotion."""
    usable = F.when(F.col("uplift_pct").between(-100, 300), F.col("uplift_pct"))
    fit = uplift.agg(F.count(usable).alias("n"), F.regr_slope(usable, "discount_pct").alias("s"),
                     F.regr_intercept(usable, "discount_pct").alias("i"))
    enough = F.col("n") >= 10
    return fit.select("n", F.when(enough, F.col("s")).otherwise(80.0).alias("slope"),
                      F.when(enough, F.col("i")).otherwise(5.0).alias("intercept"))


def next_best_offer(customers: DataFrame, promotions: DataFrame, products: DataFrame,
                    transactions: DataFrame,
                    weights: tuple[float, float, float] = (50.0, 15.0, 10.0)) -> DataFrame:
    """The best active promotion of every customer, with confidence and uplift.

    Within one (category, segment, channel) cell of the offers the score grows with the
    discount alone, so only a cell's deepest offer can win; and customers with the same
    category, segment and channel share the winner. Both sides are cells of three
    enumerations: each profile is scored against the array of offer cells, and the
    customers then join their profile. Customers never meet promotions.
    """
    discount_w, channel_w, recency_w = weights
    active = (promotions.where("is_active")
              .join(products.select("product_id", "category").hint("merge"), "product_id", "left"))
    depth = F.col("discount_pct") if discount_w > 0 else F.lit(0.0)
    per_depth = (active.groupBy("category", "target_segment", "channel", depth.alias("depth"))
                 .agg(F.min("promo_id").alias("promo_id"), F.count(F.lit(1)).alias("offers")))
    cells = (per_depth.groupBy("category", "target_segment", "channel")
             .agg(F.max_by(F.struct("depth", "promo_id", "offers"), "depth").alias("best"))
             .select("category", "target_segment", "channel", "best.*"))
    grid = cells.agg(F.collect_list(F.struct(
        "category", "target_segment", "channel", "depth", "promo_id", "offers"))
        .alias("cells")).scalar()
    offers = active.agg(F.count(F.lit(1)).alias("n")).scalar()

    profile = ["preferred_category", "segment", "preferred_channel"]
    people = customers.select("customer_id", "loyalty_tier", *[
        F.coalesce(c, F.lit("")).alias(c) for c in profile])
    met = (people.select(*profile).distinct().withColumn("_cells", grid)
           .select(*profile, F.inline("_cells")))
    match = (F.col("channel") == "Both") | (F.col("channel") == F.col("preferred_channel"))
    score = half_up(
        F.when(F.col("category") == F.col("preferred_category"), 2.0).otherwise(0.0)
        + F.when(F.col("target_segment") == F.col("segment"), 1.5)
        .when(F.col("target_segment") == "All", 0.5).otherwise(0.0)
        + F.col("depth") * discount_w + F.when(match, channel_w).otherwise(0.0), 9)
    winners = (met.groupBy(*profile, score.alias("top"))
               .agg(F.min("promo_id").alias("promo_id"), F.sum("offers").alias("ties"))
               .groupBy(*profile)
               .agg(F.max(F.struct("top", "promo_id", "ties")).alias("w"))
               .select(*profile, "w.*").withColumn("_offers", offers))
    uplift = stored(promo_uplift(promotions, transactions))  # read by the line and the lookup
    line = one_row(uplift_trend(uplift), "slope", "intercept")
    described = uplift.withColumn("_line", line).select(
        "promo_id", "promo_type", "product_id",
        F.concat((F.col("discount_pct") * 100).cast("long").cast("string"), F.lit("%"))
        .alias("discount"),
        half_up(F.when(F.col("control_revenue") > 0, clip("uplift_pct", 5.0, 95.0)).otherwise(
            clip(F.col("_line")["intercept"] + F.col("_line")["slope"] * F.col("discount_pct"),
                 5.0, 95.0)), 1).alias("uplift_pct"))
    # One row per profile: the customers, most of them at a few promotions, never meet the others.
    won = stored(winners.join(described, "promo_id"))

    last = transactions.groupBy("customer_id").agg(F.max("transaction_date").alias("last_seen"))
    newest = transactions.agg(F.max("transaction_date").alias("d")).scalar()
    scored = (people.join(last, "customer_id", "left").join(won, profile)
              .withColumn("_newest", newest))
    idle = F.coalesce(F.datediff("_newest", "last_seen"), F.lit(90))
    loyalty = (F.when(F.col("loyalty_tier") == "Bronze", 0.0)
               .when(F.col("loyalty_tier") == "Gold", 0.67)
               .when(F.col("loyalty_tier") == "Platinum", 1.0).otherwise(0.33))
    recency = F.lit(1.0) / (F.greatest(idle, F.lit(0)) / 30.0 + 1.0)
    return scored.select(
        "promo_id", "customer_id",
        half_up(F.col("top") + recency * recency_w + loyalty * 0.5, 4).alias("score"),
        half_up(clip((F.col("_offers") - F.col("ties")) / F.col("_offers") * 0.40 + 0.55,
                     0.55, 0.95), 2).alias("confidence"),
        "promo_type", "product_id", "discount", "uplift_pct")


def segment_offers(customers: DataFrame, promotions: DataFrame, products: DataFrame,
                   n: int = 6) -> DataFrame:
    """The n offers with the highest modelled uplift for every customer segment."""
    counted = (customers.where("segment IS NOT NULL")
               .groupingSets([["segment"], ["segment", "preferred_category"],
                              ["segment", "preferred_channel"]],
                             "segment", "preferred_category", "preferred_channel")
               .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")))

    def mode(level: int, column: str) -> Column:
        """Most frequent value, the alphabetically first of equals."""
        here = (F.col("g") == level) & F.col(column).isNotNull()
        return F.min(F.when(here, F.struct((-F.col("n")).alias("n"), F.col(column)
                                           .alias("v"))))["v"].alias(f"modal_{column}")

    profile = counted.groupBy("segment").agg(
        F.max(F.when(F.col("g") == 3, F.col("n"))).alias("segment_size"),
        mode(1, "preferred_category"), mode(2, "preferred_channel"))
    # One array entry per segment, an enumeration: each promotion is scored for each.
    profiles = profile.agg(F.collect_list(F.struct(*profile.columns)).alias("p")).scalar()
    active = (promotions.where("is_active")
              .join(products.select("product_id", "category").hint("merge"), "product_id", "left")
              .withColumn("_profiles", profiles).withColumn("_p", F.explode("_profiles"))
              .select("*", "_p.*").drop("_profiles", "_p"))
    percent = F.col("discount_pct") * 100
    days = F.datediff("end_date", "start_date")
    urgency = F.least(F.lit(14.0) / F.greatest(days, F.lit(1)), F.lit(1.5))
    on_target = F.col("target_segment") == F.col("segment")
    in_category = F.coalesce(F.col("category") == F.col("modal_preferred_category"), F.lit(False))
    lift = F.least(half_up(percent * 0.35 * urgency + F.when(on_target, 6.0).otherwise(0.0)
                           + F.when(in_category, 3.0).otherwise(0.0), 1), percent * 0.75)
    scored = active.withColumn("_lift", half_up(lift, 6)).withColumn("on_target", on_target)
    rank = F.row_number().over(Window.partitionBy("segment").orderBy(
        F.desc("_lift"), "promo_id"))
    return scored.withColumn("position", rank).where(F.col("position") <= n).select(
        "segment", "segment_size", F.col("modal_preferred_category").alias("preferred_category"),
        F.col("modal_preferred_channel").alias("preferred_channel"), "position", "promo_id",
        "promo_type", "category", half_up(percent, 1).alias("discount_pct"), "target_segment",
        "on_target", half_up("_lift", 1).alias("predicted_uplift_pct"))
