"""Cleaning rules, one function per raw table.

Each keeps the first row of a repeated key (``order`` says which comes first),
coerces numbers and dates so that unreadable text becomes null, clamps, and fills
the defaults.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aislewise.functions.scalars import clip, half_up, ratio


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``row_number = 1`` is cut per map task before the shuffle, so a hot key is safe."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def number(c: str) -> Column:
    return F.col(c).try_cast("double")


def moment(df: DataFrame, c: str) -> Column:
    """Text or date to timestamp; unreadable text to null."""
    kind = df.schema[c].dataType.simpleString()
    return F.try_to_timestamp(c) if kind == "string" else F.col(c).cast("timestamp")


def day(df: DataFrame, c: str) -> Column:
    return moment(df, c).cast("date")


def filled(c, default) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(default))


def clean_customers(df: DataFrame, order: Sequence[str]) -> DataFrame:
    df = first_per_key(df, "customer_id", order)
    return df.withColumns({
        "age": clip(number("age"), 16.0, 90.0),
        "shopping_frequency": filled(clip(number("shopping_frequency"), low=0.0), 2.0),
        "gender": filled("gender", "Unknown"),
        "income_bracket": filled("income_bracket", "<2L"),
        "registration_date": F.coalesce(day(df, "registration_date"),
                                        F.lit("2020-01-01").cast("date")),
        "email_opt_in": filled("email_opt_in", False),
        "sms_opt_in": filled("sms_opt_in", False),
        "app_installed": filled("app_installed", False),
        "is_active": filled("is_active", True)})


def clean_products(df: DataFrame, order: Sequence[str]) -> DataFrame:
    df = first_per_key(df, "product_id", order)
    raw_price = filled(number("price"), 499.0)
    df = df.withColumns({
        "mrp": F.coalesce(number("mrp"), raw_price * 1.3),
        "cost_price": F.coalesce(number("cost_price"), raw_price * 0.45),
        "price": clip(raw_price, low=1.0)})
    df = df.withColumns({"mrp": F.greatest("mrp", "price"),
                         "cost_price": F.least("cost_price", "price")})
    return df.withColumns({
        "margin_pct": half_up((F.col("price") - F.col("cost_price")) / F.col("price") * 100, 2),
        "launch_date": day(df, "launch_date"), "is_active": filled("is_active", True),
        "style_tag": filled("style_tag", "casual"), "season": filled("season", "All Season")})


def clean_transactions(df: DataFrame, order: Sequence[str]) -> DataFrame:
    df = first_per_key(df, "transaction_id", order)
    df = (df.withColumn("transaction_date", day(df, "transaction_date"))
          .dropna(subset=["transaction_date", "customer_id", "product_id"])
          .withColumns({
              "quantity": clip(filled(number("quantity"), 1.0), low=1.0),
              "unit_price": clip(number("unit_price"), low=0.0),
              "discount_pct": filled(clip(number("discount_pct"), 0.0, 0.9), 0.0),
              "final_price": clip(number("final_price"), low=0.0)}))
    when = F.col("transaction_date")
    return df.withColumns({
        "total_amount": half_up(F.col("final_price") * F.col("quantity"), 2),
        "channel": filled("channel", "Online"), "payment_method": filled("payment_method", "UPI"),
        "is_returned": filled("is_returned", False),
        "year": F.year(when), "month": F.month(when), "day_of_week": F.date_format(when, "EEEE"),
        "week_number": F.weekofyear(when), "quarter": F.quarter(when)})


def clean_browsing(df: DataFrame, order: Sequence[str]) -> DataFrame:
    df = first_per_key(df, "browse_id", order)
    return (df.withColumns({
        "dwell_seconds": filled(clip(number("dwell_seconds"), 0.0, 3600.0), 30.0),
        "page_views": filled(clip(number("page_views"), 1.0, 100.0), 1.0),
        "timestamp": moment(df, "timestamp"),
        "added_to_cart": filled("added_to_cart", False),
        "purchased": filled("purchased", False)})
        .dropna(subset=["customer_id", "product_id"]))


def clean_orders(df: DataFrame, order: Sequence[str]) -> DataFrame:
    df = first_per_key(df, "order_id", order)
    df = (df.withColumns({c: day(df, c) for c in
                          ("order_date", "estimated_delivery", "actual_delivery")})
          .dropna(subset=["order_date", "customer_id", "product_id"]))
    return df.withColumns({
        "quantity": clip(filled(number("quantity"), 1.0), low=1.0),
        "total_amount": clip(number("total_amount"), low=0.0),
        "shipping_fee": filled(number("shipping_fee"), 0.0),
        "status": filled("status", "Placed"),
        "delivery_delay_days": filled(F.datediff("actual_delivery", "estimated_delivery"), 0)})


def clean_inventory(df: DataFrame, order: Sequence[str]) -> DataFrame:
    df = first_per_key(df, "inventory_id", order)
    df = df.withColumns({c: filled(clip(number(c), low=0.0), default) for c, default in (
        ("stock_qty", 0.0), ("reorder_point", 20.0), ("max_stock", 200.0),
        ("days_on_hand", 0.0))})
    return df.withColumns({
        "stockout_risk": (F.col("stock_qty") <= F.col("reorder_point")).cast("int"),
        "last_updated": day(df, "last_updated")})


def clean_tickets(df: DataFrame, order: Sequence[str]) -> DataFrame:
    df = first_per_key(df, "ticket_id", order)
    df = df.withColumns({c: moment(df, c) for c in ("created_at", "resolved_at")})
    hours = (F.unix_timestamp("resolved_at") - F.unix_timestamp("created_at")) / 3600
    return df.withColumns({
        "resolution_hrs": half_up(filled(clip(hours, low=0.0), 0.0), 1),
        "csat_score": number("csat_score"), "status": filled("status", "Open"),
        "priority": filled("priority", "Medium"), "category": filled("category", "Order Issue"),
        "description": F.trim(filled("description", ""))})


def clean_pricing_history(df: DataFrame, order: Sequence[str]) -> DataFrame:
    df = first_per_key(df, "price_id", order)
    return (df.withColumns({"price": clip(number("price"), low=1.0),
                            "effective_date": day(df, "effective_date")})
            .dropna(subset=["product_id", "effective_date"]))


def clean_competitor_pricing(df: DataFrame, order: Sequence[str]) -> DataFrame:
    df = first_per_key(df, "comp_price_id", order)
    return df.withColumns({"price": clip(number("price"), low=1.0),
                           "scraped_date": day(df, "scraped_date"),
                           "in_stock": filled("in_stock", True)})


def clean_reviews(df: DataFrame, order: Sequence[str]) -> DataFrame:
    df = first_per_key(df, "review_id", order)
    return df.withColumns({
        "rating": filled(clip(number("rating"), 1.0, 5.0), 3.0),
        "review_text": F.trim(filled("review_text", "")),
        "review_date": day(df, "review_date"),
        "sentiment_label": filled("sentiment_label", "Neutral"),
        "helpful_votes": filled(clip(number("helpful_votes"), low=0.0), 0.0),
        "is_verified": filled("is_verified", False)}).where(F.length("review_text") > 0)


def clean_returns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    df = first_per_key(df, "return_id", order)
    return df.withColumns({
        "return_date": day(df, "return_date"),
        "refund_amount": filled(clip(number("refund_amount"), low=0.0), 0.0),
        "reason": filled("reason", "Other"), "status": filled("status", "Requested")})


def clean_promotions(df: DataFrame, order: Sequence[str]) -> DataFrame:
    df = first_per_key(df, "promo_id", order)
    df = df.withColumns({c: day(df, c) for c in ("start_date", "end_date")})
    return df.withColumns({
        "discount_pct": filled(clip(number("discount_pct"), 0.0, 0.9), 0.1),
        "budget": filled(clip(number("budget"), low=0.0), 10000.0),
        "is_active": filled("is_active", False),
        "duration_days": filled(clip(F.datediff("end_date", "start_date"), low=0), 7)})


def clean_campaigns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    df = first_per_key(df, "campaign_id", order)
    df = df.withColumns({c: filled(clip(number(c), low=0.0), 0.0) for c in (
        "budget", "amount_spent", "impressions", "clicks", "conversions")})

    def per(numerator: Column, denominator: str, digits: int) -> Column:
        return filled(half_up(F.when(F.col(denominator) > 0,
                                     ratio(numerator, denominator)), digits), 0.0)

    return df.withColumns({
        "ctr": per(F.col("clicks") * 100, "impressions", 4),
        "cvr": per(F.col("conversions") * 100, "clicks", 4),
        "roas": per(F.col("conversions") * 500, "amount_spent", 2),
        "start_date": day(df, "start_date"), "end_date": day(df, "end_date")})


def clean_shipments(df: DataFrame, order: Sequence[str]) -> DataFrame:
    df = first_per_key(df, "shipment_id", order)
    df = df.withColumns({c: day(df, c) for c in
                         ("ship_date", "expected_arrival", "actual_arrival")})
    return df.withColumns({
        "freight_cost": filled(clip(number("freight_cost"), low=0.0), 0.0),
        "quantity": filled(clip(number("quantity"), low=1.0), 1.0),
        "delay_days": filled(F.datediff("actual_arrival", "expected_arrival"), 0)})


def clean_pass_through(df: DataFrame) -> DataFrame:
    """Whole-row dedup, then dates and times parsed by column name."""
    dated = [c for c in df.columns if ("date" in c.lower() or "time" in c.lower())
             and "days" not in c.lower()]
    df = df.dropDuplicates()
    return df.withColumns({c: moment(df, c) for c in dated})


# Which cleaner serves which table, and the tables only deduplicated.
CLEANERS = {
    "customers": clean_customers, "products": clean_products,
    "transactions": clean_transactions, "browsing_history": clean_browsing,
    "orders": clean_orders, "inventory": clean_inventory, "support_tickets": clean_tickets,
    "pricing_history": clean_pricing_history, "competitor_pricing": clean_competitor_pricing,
    "customer_reviews": clean_reviews, "returns": clean_returns,
    "promotions": clean_promotions, "marketing_campaigns": clean_campaigns,
    "shipments": clean_shipments}
PASS_THROUGH = ["stores", "warehouses", "suppliers", "employees", "holiday_calendar", "weather",
                "customer_sessions", "wishlist", "shopping_cart", "search_history",
                "inventory_movements"]
