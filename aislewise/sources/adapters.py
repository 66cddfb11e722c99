"""The given star-schema and event tables in the roles of the retail tables.

Ids stay integers. Amounts are rounded to cents where they are derived, so every
later sum is exact.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aislewise.functions.scalars import half_up

# The enumerations given to derived columns, picked by key modulo length.
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "All"]
CUSTOMER_CHANNELS = ["Email", "SMS", "Push Notification", "Online"]
PROMO_CHANNELS = ["Online", "Offline", "Both"]
PROMO_TYPES = ["Flat Discount", "Bundle", "Clearance"]
TICKET_CATEGORIES = {"en": "Delivery Delay", "fr": "Return & Refund",
                     "de": "Product Quality", "es": "Payment Problem"}


def pick(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def day_after(start: str, days: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), days.cast("int"))


class DriverTables:
    """Retail views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _rows(self, name: str) -> Column:
        return self.raw(name).agg(F.count(F.lit(1)).alias("n")).scalar()

    @cached_property
    def sales_lines(self) -> DataFrame:
        """Every line item with the order it belongs to."""
        lines = self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("supplier_id"), F.col("l_linenumber").alias("line_number"),
            F.col("l_quantity").cast("long").alias("quantity"),
            half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("unit_price"),
            F.col("l_discount").alias("discount_pct"),
            half_up(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")), 2)
            .alias("total_amount"),
            F.col("l_returnflag").alias("return_flag"),
            F.col("l_shipdate").cast("date").alias("ship_date"))
        orders = self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderpriority").alias("channel"),
            F.col("o_orderdate").cast("date").alias("transaction_date"))
        return lines.join(orders, "order_id")

    @cached_property
    def transactions(self) -> DataFrame:
        return self.sales_lines.select(
            (F.col("order_id") * 10 + F.col("line_number")).alias("transaction_id"),
            "order_id", "customer_id", "product_id",
            F.when(F.pmod("order_id", F.lit(4)) != 0, F.pmod("order_id", F.lit(25)))
            .alias("store_id"),
            "channel", "quantity", "unit_price", "discount_pct", "total_amount",
            "transaction_date", (F.col("return_flag") == "R").alias("is_returned"))

    @cached_property
    def orders(self) -> DataFrame:
        """Order lines with a store (null when online) and a delivery status."""
        return self.sales_lines.select(
            "order_id", "customer_id", "product_id",
            F.when(F.pmod("order_id", F.lit(4)) != 0, F.pmod("order_id", F.lit(25)))
            .alias("store_id"),
            F.when(F.col("order_status") == "F", "Delivered")
            .when(F.col("order_status") == "O", "Placed").otherwise("Cancelled").alias("status"),
            "quantity", "total_amount", F.col("transaction_date").alias("order_date"))

    @cached_property
    def order_headers(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total_amount"),
            F.col("o_orderdate").cast("date").alias("order_date"))

    @cached_property
    def order_stores(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.when(F.pmod("o_orderkey", F.lit(4)) != 0, F.pmod("o_orderkey", F.lit(25)))
            .alias("store_id"))

    @cached_property
    def returns(self) -> DataFrame:
        return (self.sales_lines.where("return_flag = 'R'").select(
            (F.col("order_id") * 10 + F.col("line_number")).alias("return_id"),
            "order_id", "customer_id", "product_id",
            pick(["Damaged", "Wrong Item", "Too Small"], F.col("line_number")).alias("reason"),
            pick(["Requested", "Approved"], F.col("order_id")).alias("status"),
            F.col("ship_date").alias("return_date"),
            F.col("total_amount").alias("refund_amount")))

    @cached_property
    def products(self) -> DataFrame:
        suppliers = self._rows("supplier")
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"), F.col("p_brand").alias("sub_category"),
            F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"),
            half_up(F.col("p_retailprice") * 0.6, 2).alias("cost_price"),
            F.pmod("p_partkey", suppliers).alias("supplier_id"),
            (F.pmod("p_partkey", F.lit(7)) != 0).alias("is_active"))

    @cached_property
    def customers(self) -> DataFrame:
        key = F.col("c_custkey")
        places = (self.raw("nation")
                  .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                  .select(F.col("n_nationkey").alias("c_nationkey"),
                          F.col("n_name").alias("city"), F.col("r_name").alias("region")))
        return self.raw("customer").join(places, "c_nationkey").select(
            key.alias("customer_id"), F.col("c_name").alias("name"), "city", "region",
            F.col("c_mktsegment").alias("segment"),
            pick(CATEGORIES, key).alias("preferred_category"),
            pick(CUSTOMER_CHANNELS, key).alias("preferred_channel"),
            F.when(F.col("c_acctbal") < 0, "Bronze").when(F.col("c_acctbal") < 3000, "Silver")
            .when(F.col("c_acctbal") < 7000, "Gold").otherwise("Platinum").alias("loyalty_tier"),
            pick(["F", "M", "Other"], key).alias("gender"),
            pick(["<2L", "2-5L", "5-10L"], key).alias("income_bracket"),
            (F.lit(18) + F.pmod(key, F.lit(60))).alias("age"),
            F.pmod(key, F.lit(13)).cast("double").alias("shopping_frequency"),
            (F.pmod(key, F.lit(3)) != 0).alias("email_opt_in"),
            (F.pmod(key, F.lit(2)) == 0).alias("sms_opt_in"),
            (F.pmod(key, F.lit(5)) != 0).alias("app_installed"))

    @cached_property
    def stores(self) -> DataFrame:
        key = F.col("n_nationkey").cast("long")
        return (self.raw("nation")
                .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                .select(key.alias("store_id"),
                        F.concat(F.lit("Store "), "n_name").alias("store_name"),
                        F.col("n_name").alias("city"), F.col("r_name").alias("region"),
                        (F.lit(8) + F.pmod(key * 7919, F.lit(2800)) / 100.0).alias("latitude"),
                        (F.lit(68) + F.pmod(key * 104729, F.lit(2900)) / 100.0)
                        .alias("longitude")))

    @cached_property
    def warehouses(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.alias("warehouse_id"), F.concat(F.lit("DC "), "s_name").alias("warehouse_name"),
            (F.lit(8) + F.pmod(key * 6367, F.lit(2800)) / 100.0).alias("latitude"),
            (F.lit(68) + F.pmod(key * 7919, F.lit(2900)) / 100.0).alias("longitude"))

    @cached_property
    def suppliers(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.alias("supplier_id"), F.col("s_name").alias("name"),
            ((F.pmod(key, F.lit(40)) + 60) / 100.0).alias("reliability_score"),
            (F.pmod(key, F.lit(13)) + 2).alias("lead_time_days"))

    def _events(self, *types: str) -> DataFrame:
        products = self._rows("part")
        return (self.raw("events").where(F.col("event_type").isin(*types)).select(
            "event_id", F.col("user_id").alias("customer_id"),
            F.pmod("event_id", products).alias("product_id"),
            F.col("ts").cast("timestamp").alias("timestamp"), "event_type", "value"))

    @cached_property
    def browsing(self) -> DataFrame:
        return self._events("view", "click").select(
            F.col("event_id").alias("browse_id"), "customer_id", "product_id", "timestamp",
            (F.lit(1) + F.pmod("event_id", F.lit(5))).alias("page_views"),
            F.floor("value").alias("dwell_seconds"),
            (F.col("event_type") == "click").alias("added_to_cart"),
            (F.pmod("event_id", F.lit(10)) == 0).alias("purchased"))

    @cached_property
    def carts(self) -> DataFrame:
        return self._events("error").select(
            F.col("event_id").alias("cart_id"), "customer_id", "product_id",
            pick(["Abandoned", "Active", "Purchased"], F.col("event_id")).alias("status"),
            F.col("timestamp").alias("added_at"))

    @cached_property
    def wishlist(self) -> DataFrame:
        return self._events("signup").select(
            F.col("event_id").alias("wishlist_id"), "customer_id", "product_id",
            (F.pmod("event_id", F.lit(4)) == 0).alias("is_purchased"))

    @cached_property
    def inventory(self) -> DataFrame:
        """One stock row per product, and a second warehouse row for every fourth."""
        suppliers = self._rows("supplier")
        key = F.col("p_partkey")
        part = self.raw("part").select("p_partkey")
        in_store = F.pmod(key, F.lit(3)) == 0
        first = part.select(
            (key * 2).alias("inventory_id"), key.alias("product_id"),
            F.when(in_store, F.pmod(key, F.lit(25))).alias("store_id"),
            F.when(~in_store, F.pmod(key, suppliers)).alias("warehouse_id"),
            F.when(in_store, "store").otherwise("warehouse").alias("location_type"),
            F.pmod(key * 37, F.lit(500)).alias("stock_qty"),
            (F.lit(20) + F.pmod(key * 13, F.lit(80))).alias("reorder_point"))
        second = part.where(F.pmod(key, F.lit(4)) == 0).select(
            (key * 2 + 1).alias("inventory_id"), key.alias("product_id"),
            F.lit(None).cast("long").alias("store_id"),
            F.pmod(key + 7, suppliers).alias("warehouse_id"),
            F.lit("warehouse").alias("location_type"),
            F.pmod(key * 53, F.lit(400)).alias("stock_qty"),
            (F.lit(20) + F.pmod(key * 11, F.lit(60))).alias("reorder_point"))
        return (first.unionByName(second)
                .withColumn("max_stock", F.col("reorder_point") * 5)
                .withColumn("days_on_hand", F.pmod("inventory_id", F.lit(90)))
                .withColumn("stockout_risk",
                            (F.col("stock_qty") <= F.col("reorder_point")).cast("long")))

    @cached_property
    def movements(self) -> DataFrame:
        return self.raw("lineitem").select(
            (F.col("l_partkey") * 2).alias("inventory_id"),
            F.col("l_quantity").cast("long").alias("quantity"))

    @cached_property
    def shipments(self) -> DataFrame:
        hours = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(300))
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("warehouse_id"),
            F.col("l_partkey").alias("product_id"),
            F.when(F.pmod("l_orderkey", F.lit(4)) != 0, F.pmod("l_orderkey", F.lit(25)))
            .alias("store_id"),
            F.col("l_quantity").cast("long").alias("quantity"), hours.alias("hours"))

    @cached_property
    def pricing_history(self) -> DataFrame:
        """Mean unit price per product and month, in whole cents."""
        cents = F.floor(F.col("unit_price") * 100.0 + 0.5)
        return (self.sales_lines
                .groupBy("product_id", F.trunc("transaction_date", "month")
                         .alias("effective_date"))
                .agg((F.floor(F.sum(cents) / F.count(F.lit(1)) + 0.5) / 100.0).alias("price")))

    @cached_property
    def competitor_pricing(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("competitor"),
            half_up(F.col("l_extendedprice") / F.col("l_quantity") , 2).alias("price"))

    @cached_property
    def promotions(self) -> DataFrame:
        """Every part is promoted once."""
        key = nth = F.col("p_partkey")
        start = day_after("1996-01-01", F.pmod(key * 17, F.lit(1500)))
        return self.raw("part").select(
            key.alias("promo_id"), key.alias("product_id"),
            pick(PROMO_TYPES, nth).alias("promo_type"),
            pick(PROMO_CHANNELS, nth).alias("channel"),
            pick(SEGMENTS, nth).alias("target_segment"),
            ((F.pmod(nth, F.lit(50)) + 5) / 100.0).alias("discount_pct"),
            start.alias("start_date"),
            F.date_add(start, (F.pmod(nth, F.lit(120)) + 30).cast("int")).alias("end_date"),
            (F.pmod(nth, F.lit(5)) != 0).alias("is_active"))

    @cached_property
    def campaigns(self) -> DataFrame:
        """One campaign per user: views are impressions, clicks clicks, purchases conversions."""
        kind = F.col("event_type")
        return (self.raw("events").groupBy(F.col("user_id").alias("campaign_id")).agg(
            F.count_if(kind.isin("view", "click")).alias("impressions"),
            F.count_if(kind == "click").alias("clicks"),
            F.count_if(kind == "purchase").alias("conversions"))
            .withColumn("amount_spent", F.col("impressions") * 2.5))

    @cached_property
    def documents(self) -> DataFrame:
        labels = self.raw("labels").select("doc_id", "quality", "toxic")
        return self.raw("documents").join(labels, "doc_id", "left")

    @cached_property
    def reviews(self) -> DataFrame:
        products, customers = self._rows("part"), self._rows("customer")
        key = F.col("doc_id")
        rating = (F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 5)
                  .when(F.col("quality") == 0, 2).otherwise(3))
        return self.documents.select(
            key.alias("review_id"), F.pmod(key, products).alias("product_id"),
            F.pmod(key * 7, customers).alias("customer_id"), F.col("text").alias("review_text"),
            rating.alias("rating"),
            F.when(rating >= 4, "Positive").when(rating <= 2, "Negative").otherwise("Neutral")
            .alias("sentiment_label"),
            day_after("2022-01-01", F.pmod(key, F.lit(730))).alias("review_date"))

    @cached_property
    def tickets(self) -> DataFrame:
        customers = self._rows("customer")
        key, size = F.col("doc_id"), F.col("n_chars")
        names = F.create_map(*[F.lit(x) for kv in TICKET_CATEGORIES.items() for x in kv])
        created = F.timestamp_seconds(
            F.lit(1704067200) + F.pmod(key, F.lit(365)) * 86400 + F.pmod(key, F.lit(24)) * 3600)
        return self.raw("documents").select(
            key.alias("ticket_id"), F.pmod(key * 7, customers).alias("customer_id"),
            F.try_element_at(names, F.col("lang")).alias("category"),
            F.when(size < 500, "Low").when(size < 1500, "Medium").when(size < 4000, "High")
            .otherwise("Critical").alias("priority"),
            F.col("text").alias("description"),
            F.when(F.pmod(key, F.lit(4)) == 0, "Open").otherwise("Resolved").alias("status"),
            created.alias("created_at"),
            F.when(F.pmod(key, F.lit(4)) != 0, F.timestamp_seconds(
                F.unix_timestamp(created) + F.pmod(key, F.lit(97)) * 1800))
            .alias("resolved_at"))

    @cached_property
    def messages(self) -> DataFrame:
        """Every turn of a conversation, whoever wrote it."""
        customers = self._rows("customer")
        return self.raw("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
            F.pmod("conv_id", customers).alias("customer_id"), F.col("text").alias("message"))
