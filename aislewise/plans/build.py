"""The batch build: raw tables in, cleaned tables and the six feature tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislewise.operators import cleaning, features as X
from aislewise.sources import tables as S
from aislewise.sources.schemas import SCHEMAS

# The key each raw table is deduplicated by.
KEYS = {
    "customers": "customer_id", "products": "product_id", "transactions": "transaction_id",
    "browsing_history": "browse_id", "orders": "order_id", "inventory": "inventory_id",
    "support_tickets": "ticket_id", "pricing_history": "price_id",
    "competitor_pricing": "comp_price_id", "customer_reviews": "review_id",
    "returns": "return_id", "promotions": "promo_id", "marketing_campaigns": "campaign_id",
    "shipments": "shipment_id"}
# Event logs are laid out by year and sorted by date: a filter on the year prunes folders, one on
# the date row groups.
YEARLY = {"transactions": "transaction_date", "browsing_history": "timestamp",
          "orders": "order_date"}


def clean_table(raw: DataFrame, name: str) -> DataFrame:
    """One cleaned table. The first row of a repeated key is the first by all its columns."""
    if name in cleaning.PASS_THROUGH:
        return cleaning.clean_pass_through(raw)
    order = [c for c in raw.columns if c != KEYS[name]]
    return cleaning.CLEANERS[name](raw, order)


def build(spark: SparkSession, raw_folder: str, folder: str) -> list[str]:
    """Clean all 25 tables, then build the features from the written results."""
    for name in SCHEMAS:
        cleaned = clean_table(S.load(spark, raw_folder, name), name)
        if name in YEARLY:
            cleaned = cleaned.withColumn("sales_year", F.year(YEARLY[name]))
            S.save(cleaned, folder, name, ["sales_year"], [YEARLY[name]])
        else:
            S.save(cleaned, folder, name)

    def table(name: str) -> DataFrame:
        return S.load(spark, folder, name)

    tx, products, customers = table("transactions"), table("products"), table("customers")
    browsing, carts, wishes = table("browsing_history"), table("shopping_cart"), table("wishlist")
    reviews, inventory = table("customer_reviews"), table("inventory")
    product_features = X.velocity_class(X.product_features(
        products, tx, reviews, table("returns"), inventory))
    codes = [c for c in ("category", "sub_category", "brand", "season", "style_tag", "color")
             if c in products.columns]
    built = {
        "feature_customers": X.customer_features(customers, tx, browsing, wishes, carts, reviews),
        "feature_products": X.label_encode(product_features, codes),
        "feature_daily_sales": X.daily_sales_lags(
            X.daily_sales(tx, table("holiday_calendar"))),
        "feature_inventory_health": X.inventory_features(inventory, tx),
        "feature_buying_intent": X.buying_intent(browsing, carts, wishes, tx),
        "feature_tickets": X.ticket_features(table("support_tickets"), customers)}
    for name, df in built.items():
        S.save(df, folder, name)
    return [*SCHEMAS, *built]
