"""Feature tables: RFM, products, daily sales, inventory, buying intent, tickets, calendar."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from aislewise.functions.distributed import exact_quantiles
from aislewise.functions.scalars import (clip, cut, half_up, money_mean, money_sum, not_null,
                                         one_row, pinned, quantile_bin, rate_mean, ratio)


def rfm(transactions: DataFrame) -> DataFrame:
    """Recency, frequency and money per customer; one map-combined aggregate."""
    snapshot = transactions.agg(F.date_add(F.max("transaction_date"), 1).alias("d")).scalar()
    per_customer = not_null(transactions, "customer_id").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("frequency"), money_sum("total_amount").alias("monetary"),
        money_mean("total_amount").alias("avg_order_val"),
        F.min("transaction_date").alias("first_purchase"),
        F.max("transaction_date").alias("last_purchase"))
    return per_customer.withColumns({
        "recency_days": F.datediff(snapshot, F.col("last_purchase")),
        "customer_lifetime_days": F.datediff("last_purchase", "first_purchase")})


def rfm_scores(rfm_table: DataFrame) -> DataFrame:
    """Quintile scores 1-5 (recency reversed) and their sum.

    The three measures go through one quantile job as (measure, value) rows.
    """
    measures = ["recency_days", "frequency", "monetary"]
    long = rfm_table.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
        for m in measures])).alias("r")).select("r.*")
    names = ["q20", "q40", "q60", "q80"]
    edges = exact_quantiles(long, "value", dict(zip(names, (0.2, 0.4, 0.6, 0.8))), ("measure",))
    wide = edges.agg(*[F.max(F.when(F.col("measure") == m, F.array(*names))).alias(m)
                       for m in measures])
    scored = pinned(rfm_table, _edges=one_row(wide))

    def score(measure: str) -> Column:
        return quantile_bin(measure, [F.col("_edges")[measure][i] for i in range(4)])

    return (scored.withColumns({"recency_score": F.lit(6) - score("recency_days"),
                                "frequency_score": score("frequency"),
                                "monetary_score": score("monetary")})
            .withColumn("rfm_score", F.expr("recency_score + frequency_score + monetary_score"))
            .drop("_edges"))


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Integer codes by sorted text for category-like columns; null counts as 'nan'.

    The vocabulary travels as one sorted array, so this is for enumerations, not ids.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("nan"))

    vocabulary = one_row(df.select(*[text(c).alias(c) for c in columns]).agg(
        *[F.sort_array(F.collect_set(c)).alias(c) for c in columns],
        F.lit(0).alias("_unused")))
    return (pinned(df, _vocabulary=vocabulary)
            .withColumns({f"{c}_enc": F.array_position(F.col("_vocabulary")[c], text(c)) - 1
                          for c in columns}).drop("_vocabulary"))


def customer_features(customers: DataFrame, transactions: DataFrame, browsing: DataFrame,
                      wishlist: DataFrame, carts: DataFrame, reviews: DataFrame,
                      encode: Sequence[str] = ("gender", "income_bracket", "segment",
                                               "preferred_category", "loyalty_tier")) -> DataFrame:
    """One wide row per customer; every aggregate is keyed by customer before the joins."""
    browse = not_null(browsing, "customer_id").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_browses"),
        F.avg("dwell_seconds").alias("avg_dwell_secs"),
        F.sum(F.col("added_to_cart").cast("long")).alias("cart_adds"),
        F.avg(F.col("purchased").cast("long")).alias("browse_to_buy"))
    wishes = not_null(wishlist, "customer_id").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("wishlist_count"),
        F.sum(F.col("is_purchased").cast("long")).alias("wishlist_bought"))
    baskets = not_null(carts, "customer_id").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("cart_count"),
        F.count_if(F.col("status") == "Abandoned").alias("cart_abandoned"))
    ratings = not_null(reviews, "customer_id").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("review_count"), F.avg("rating").alias("avg_rating_given"))
    wide = customers
    for part in (rfm_scores(rfm(transactions)), browse, wishes, baskets, ratings):
        wide = wide.join(part, "customer_id", "left")
    wide = wide.fillna(0, subset=["recency_days", "frequency", "monetary", "avg_order_val",
                                  "total_browses", "avg_dwell_secs", "browse_to_buy",
                                  "wishlist_count", "cart_count"])
    present = [c for c in encode if c in customers.columns]
    if not present:
        return wide
    codes = label_encode(customers, present).select("customer_id", *[f"{c}_enc" for c in present])
    return wide.join(codes, "customer_id", "left")


def product_features(products: DataFrame, transactions: DataFrame, reviews: DataFrame,
                     returns: DataFrame, inventory: DataFrame,
                     online: str = "Online") -> DataFrame:
    """Sales, review, return and stock measures per product with guarded rates."""
    sales = not_null(transactions, "product_id").groupBy("product_id").agg(
        F.sum("quantity").alias("total_qty_sold"), money_sum("total_amount").alias("total_revenue"),
        money_mean("unit_price").alias("avg_sale_price"),
        rate_mean("discount_pct").alias("avg_discount"),
        F.count(F.lit(1)).alias("n_transactions"),
        (F.count_if(F.col("channel") == online) / F.count(F.lit(1))).alias("online_share"))
    ratings = not_null(reviews, "product_id").groupBy("product_id").agg(
        F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("review_count"),
        (F.count_if(F.col("sentiment_label") == "Positive") * 100 / F.count(F.lit(1)))
        .alias("pct_positive"),
        (F.count_if(F.col("sentiment_label") == "Negative") * 100 / F.count(F.lit(1)))
        .alias("pct_negative"))
    returned = not_null(returns, "product_id").groupBy("product_id").agg(
        F.count(F.lit(1)).alias("return_count"))
    stock = not_null(inventory, "product_id").groupBy("product_id").agg(
        F.sum("stock_qty").alias("total_stock"), F.avg("days_on_hand").alias("avg_days_on_hand"),
        F.sum("stockout_risk").alias("stockout_locations"))
    wide = products
    for part in (sales, ratings, returned, stock):
        wide = wide.join(part, "product_id", "left")
    wide = wide.fillna(0, subset=["total_qty_sold", "total_revenue", "return_count"])
    sold, held = F.col("total_qty_sold"), F.col("total_stock")
    return wide.withColumns({
        "return_rate": half_up(ratio("return_count", sold, 0.0), 4),
        "sell_through_rate": half_up(F.when(held.isNotNull(), ratio(sold, held + sold, 0.0))
                                     .otherwise(0.0), 4)})


def velocity_class(features: DataFrame, column: str = "total_qty_sold") -> DataFrame:
    """A / B / C by the median and the 80th percentile of units sold."""
    edges = one_row(exact_quantiles(features, column, {"half": 0.5, "top": 0.8}))
    return (pinned(features, _edges=edges)
            .withColumn("velocity_class",
                        F.when(F.col(column) > F.col("_edges")["top"], "A")
                        .when(F.col(column) > F.col("_edges")["half"], "B").otherwise("C"))
            .drop("_edges"))


def date_dim(spark: SparkSession, start: str, end: str,
             holidays: Sequence[tuple[int, int, str]] | None = None) -> DataFrame:
    """Calendar table between two dates, holidays given as (month, day, name)."""
    holidays = HOLIDAYS if holidays is None else holidays
    days = spark.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return calendar_columns(days, holidays)


# Fixed values: (month, day, name).
HOLIDAYS = [
    (1, 26, "Republic Day"), (3, 1, "Holi"), (4, 14, "Baisakhi"), (8, 15, "Independence Day"),
    (10, 2, "Gandhi Jayanti"), (10, 20, "Dussehra"), (11, 1, "Diwali"), (11, 5, "Bhai Dooj"),
    (12, 25, "Christmas"), (1, 14, "Makar Sankranti"), (8, 31, "Raksha Bandhan"),
    (9, 7, "Ganesh Chaturthi"), (11, 20, "Guru Nanak Jayanti")]


def holiday_name(date: str, holidays: Sequence[tuple[int, int, str]]) -> Column:
    name = F.lit(None).cast("string")
    for m, d, label in reversed(holidays):
        name = F.when((F.month(date) == m) & (F.dayofmonth(date) == d), label).otherwise(name)
    return name


def sale_season(date: str) -> Column:
    month, dom = F.month(date), F.dayofmonth(date)
    return (((month == 1) & (dom <= 10)) | ((month == 7) & dom.between(10, 20))
            | ((month == 10) & dom.between(15, 31)) | ((month == 12) & dom.between(20, 31)))


def calendar_columns(days: DataFrame, holidays: Sequence[tuple[int, int, str]]) -> DataFrame:
    """The calendar attributes of every value of ``date``."""
    month = F.month("date")
    name, sale = holiday_name("date", holidays), sale_season("date")
    weekend = F.weekday("date") >= 5
    season = (F.when(month.between(3, 5), "Summer").when(month.between(6, 8), "Monsoon")
              .when(month.between(9, 11), "Festive").otherwise("Winter"))
    return days.select(
        "date", F.year("date").alias("year"), month.alias("month"),
        F.date_format("date", "EEEE").alias("day_of_week"), weekend.alias("is_weekend"),
        name.isNotNull().alias("is_holiday"), name.alias("holiday_name"),
        sale.alias("is_sale_season"), season.alias("season"),
        (weekend & name.isNotNull()).alias("is_long_weekend"))


def daily_sales(transactions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Units, revenue and orders per product and day, with the calendar flags."""
    daily = not_null(transactions, "product_id", "transaction_date").groupBy(
        "product_id", "transaction_date").agg(
        F.sum("quantity").alias("daily_qty"), money_sum("total_amount").alias("daily_revenue"),
        F.count(F.lit(1)).alias("n_orders"))
    flags = calendar.select(F.col("date").alias("transaction_date"), "is_holiday",
                            "is_sale_season", "season", "day_of_week", "is_weekend")
    return daily.join(flags, "transaction_date", "left")


def daily_sales_lags(daily: DataFrame) -> DataFrame:
    """Lags and shifted rolling means over selling days (rows, not calendar days)."""
    by_day = Window.partitionBy("product_id").orderBy("transaction_date")
    return daily.withColumns({
        "lag_7": F.lag("daily_qty", 7).over(by_day),
        "lag_14": F.lag("daily_qty", 14).over(by_day),
        "rolling_7_mean": F.avg("daily_qty").over(by_day.rowsBetween(-7, -1)),
        "rolling_30_mean": F.avg("daily_qty").over(by_day.rowsBetween(-30, -1)),
        "month": F.month("transaction_date"), "day_of_month": F.dayofmonth("transaction_date"),
        "week_number": F.weekofyear("transaction_date"), "quarter": F.quarter("transaction_date")})


def recent_demand(transactions: DataFrame, days: int = 30) -> DataFrame:
    """Units per product since ``days`` days before the last date in the data.

    Of a log laid out by ``sales_year`` only the folders of those days are read.
    """
    if "sales_year" in transactions.columns:
        newest = transactions.agg(F.max("sales_year").alias("y")).scalar()
        last = transactions.where(F.col("sales_year") == newest).agg(
            F.max("transaction_date").alias("d")).scalar()
        transactions = transactions.where(
            F.col("sales_year") >= F.year(F.date_sub(last, days)))
    else:
        last = transactions.agg(F.max("transaction_date").alias("d")).scalar()
    return (transactions.where(F.col("transaction_date") >= F.date_sub(last, days))
            .groupBy("product_id").agg(F.sum("quantity").alias("recent_units")))


def inventory_features(inventory: DataFrame, transactions: DataFrame) -> DataFrame:
    """Cover, urgency, overstock and a 0-100 health score per stock row."""
    demand = recent_demand(transactions).select(
        "product_id", F.col("recent_units").alias("demand_30d"),
        half_up(F.col("recent_units") / 30, 2).alias("avg_daily_demand"))
    feat = inventory.join(demand, "product_id", "left").withColumns({
        "demand_30d": F.coalesce("demand_30d", F.lit(1)),
        "avg_daily_demand": F.coalesce("avg_daily_demand", F.lit(0.1))})
    feat = feat.withColumns({
        "days_cover": half_up(F.col("stock_qty") / clip("avg_daily_demand", low=0.01), 1),
        "reorder_urgency": (F.col("stock_qty") <= F.col("reorder_point")).cast("int"),
        "overstock_flag": (F.col("stock_qty") > F.col("max_stock")).cast("int")})
    feat = feat.withColumn("health_score", half_up(
        clip(F.col("days_cover") / 30 * 60, 0.0, 60.0)
        + (1 - F.col("reorder_urgency")) * 25 + (1 - F.col("overstock_flag")) * 15, 1))
    return feat.withColumn("risk_label", cut("health_score", [0, 30, 60, 100],
                                             ["High Risk", "Medium", "Healthy"]))


def buying_intent(browsing: DataFrame, carts: DataFrame, wishlist: DataFrame,
                  transactions: DataFrame) -> DataFrame:
    """Intent score per browsed (customer, product).

    The four sources are stacked and aggregated once: one shuffle instead of three
    joins, and repeated carts or wishes cannot multiply rows.
    """
    pair = ["customer_id", "product_id"]
    nothing = {"views": 0, "dwell": 0, "visit": 0, "cart": 0, "wish": 0, "bought": 0}

    def part(df: DataFrame, when: Column | None = None, **values) -> DataFrame:
        filled = {**{k: F.lit(v) for k, v in nothing.items()}, **values}
        seen = F.lit(None).cast("timestamp") if when is None else when
        return not_null(df, *pair).select(*pair, seen.alias("seen"), *[
            v.cast("double").alias(k) for k, v in filled.items()])

    stacked = reduce(DataFrame.unionByName, [
        part(browsing, F.col("timestamp"), views=F.col("page_views"),
             dwell=F.col("dwell_seconds"), visit=F.lit(1)),
        part(carts.where(F.col("status").isin("Active", "Abandoned")), cart=F.lit(1)),
        part(wishlist, wish=F.lit(1)), part(transactions, bought=F.lit(1))])
    agg = stacked.groupBy(*pair).agg(
        F.sum("views").alias("total_views"), F.sum("dwell").alias("total_dwell"),
        F.sum("visit").cast("long").alias("sessions"), F.max("seen").alias("last_browse"),
        F.max("cart").cast("int").alias("cart_flag"),
        F.max("wish").cast("int").alias("wishlist_flag"),
        F.max("bought").cast("int").alias("purchased_label")).where("sessions > 0")
    score = half_up(clip("total_views", 0.0, 20.0) / 20 * 30 + F.col("cart_flag") * 35
                    + F.col("wishlist_flag") * 20 + clip("total_dwell", 0.0, 300.0) / 300 * 15, 2)
    return agg.withColumn("intent_score", score).withColumn(
        "intent_label", cut("intent_score", [0, 30, 60, 100], ["Low", "Medium", "High"]))


def intent_thresholds(intent: DataFrame) -> DataFrame:
    """High and medium cut-offs from the scores (0-1) of purchased pairs."""
    bought = intent.where("purchased_label = 1").select(
        (F.col("intent_score") / 100).alias("p"))
    found = exact_quantiles(bought, "p", {"p60": 0.60, "p25": 0.25})
    pairs = bought.agg(F.count(F.lit(1)).alias("n")).scalar()
    high = clip("p60", 0.15, 0.90)
    shaped = found.select(high.alias("high"), "p25", pairs.alias("positives"))
    enough = F.col("positives") >= 4
    return shaped.select(
        F.when(enough, F.col("high")).otherwise(0.60).alias("high_threshold"),
        F.when(enough, clip("p25", F.lit(0.05), F.col("high") - 0.02)).otherwise(0.35)
        .alias("medium_threshold"))


def ticket_features(tickets: DataFrame, customers: DataFrame) -> DataFrame:
    """Text size, encoded category and priority, and the customer's attributes."""
    text = F.coalesce("description", F.lit(""))
    priority = (F.when(F.col("priority") == "Low", 0).when(F.col("priority") == "Medium", 1)
                .when(F.col("priority") == "High", 2).when(F.col("priority") == "Critical", 3)
                .otherwise(1))
    sized = tickets.withColumns({
        "text_length": F.length(text), "word_count": F.regexp_count(text, F.lit(r"\S+")),
        "priority_enc": priority})
    wanted = [c for c in ("customer_id", "loyalty_tier", "segment", "age")
              if c in customers.columns]
    return label_encode(sized, ["category"]).join(customers.select(*wanted), "customer_id", "left")
