"""Scans, profiles, listings and look-ups."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DoubleType, LongType, StringType, StructField,
                               StructType)

from aislewise.functions.scalars import half_up, haversine_km
from aislewise.operators import features
from aislewise.operators.naming import annotate_names, location_label
from aislewise.plans.oracle_tables import with_tables
from aislewise.plans.shape import plain
from aislewise.session import own_folder
from aislewise.sources import tables as S

_RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "labels", "pages", "benchmark", "conversations", "embeddings"]


def scan_table(t):
    return plain(t.raw("orders"))


def table_slice(t):
    return S.read_table(t.order_headers, ["order_id", "customer_id", "total_amount"],
                        where=F.col("status") == "F", order_by=[F.desc("total_amount"), "order_id"],
                        limit=100)


def sql_params(t):
    text = ("SELECT status, COUNT(*) AS n_orders, MAX(total_amount) AS largest FROM {oh} "
            "WHERE order_date >= CAST(:start AS DATE) AND total_amount > :floor GROUP BY status")
    return S.query(t.spark, text, {"oh": t.order_headers},
                   {"start": "1998-01-01", "floor": 100000.0})


def normalise_types(t):
    schema = StructType([StructField("order_id", LongType()), StructField("status", StringType()),
                         StructField("amount", DoubleType()), StructField("placed", DateType()),
                         StructField("units", LongType())])
    text = t.raw("orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.pmod("o_orderkey", F.lit(9)) == 0, "n/a")
        .otherwise(F.col("o_orderkey").cast("string")).alias("amount"),
        F.when(F.pmod("o_orderkey", F.lit(7)) == 0, "soon").otherwise("1999-03-04")
        .alias("placed"),
        F.when(F.pmod("o_orderkey", F.lit(5)) == 0, "").otherwise("12").alias("units"))
    return plain(S.normalise(text, schema))


def parse_dates(t):
    text = t.raw("orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.pmod("o_orderkey", F.lit(7)) == 0, "soon")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"))
    return plain(S.parse_dates(text, ["order_date"]))


def table_summary(t):
    return S.table_summary({n: t.raw(n) for n in _RAW})


def key_profile(t):
    return plain(S.key_profile(t.transactions, ["transaction_id", "customer_id", "store_id"])
                 .unionByName(S.key_profile(t.order_headers, ["order_id"])))


def null_report(t):
    return S.null_report(t.transactions)


def entity_history(t):
    wanted = t.customers.where("region = 'ASIA'")
    return plain(S.history(t.order_headers, "customer_id", wanted,
                           [F.desc("order_date"), F.asc("order_id")], 3))


def filter_options(t):
    return S.filter_options(t.transactions, t.products, t.customers)


def listings(t):
    parts = [
        S.listing(t.customers, ["customer_id", "name", "segment"], "customer_id", n=50)
        .toDF("id", "name", "attribute").withColumn("kind", F.lit("customer")),
        S.listing(t.products, ["product_id", "product_name", "brand"], "product_id",
                  F.col("category") == "PROMO", 20)
        .toDF("id", "name", "attribute").withColumn("kind", F.lit("product")),
        S.listing(t.promotions, ["promo_id", "promo_type", "target_segment"], "promo_id", n=50)
        .toDF("id", "name", "attribute").withColumn("kind", F.lit("promotion")),
        S.listing(t.stores, ["store_id", "store_name", "region"], "store_id", n=20)
        .toDF("id", "name", "attribute").withColumn("kind", F.lit("store"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_table(t):
    """Write the monthly sales log partitioned by year, then read it back."""
    folder = f"{own_folder(t.spark)}/{uuid4().hex}"
    log = (t.transactions.groupBy(F.year("transaction_date").alias("year"),
                                  F.month("transaction_date").alias("month"))
           .agg(F.sum("quantity").alias("units")))
    S.save(log, folder, "aislewise_sales_log", ["year"])
    return plain(S.load(t.spark, folder, "aislewise_sales_log"))


def date_dim(t):
    """Calendar of every order date in the data."""
    days = t.order_headers.select(F.col("order_date").alias("date")).distinct()
    return plain(features.calendar_columns(days, features.HOLIDAYS))


def annotate(t):
    named = annotate_names(t.inventory, {
        "product_id": t.products.select("product_id", "product_name"),
        "store_id": t.stores.select("store_id", "store_name"),
        "warehouse_id": t.warehouses.select("warehouse_id", "warehouse_name")})
    return plain(location_label(named), "inventory_id", "product_id", "product_name",
                 "store_name", "warehouse_name", "location_name")


def haversine_pairs(t):
    lanes = t.shipments.where("store_id IS NOT NULL").select("warehouse_id", "store_id").distinct()
    w = t.warehouses.select("warehouse_id", F.col("latitude").alias("wlat"),
                            F.col("longitude").alias("wlon"))
    s = t.stores.select("store_id", F.col("latitude").alias("slat"),
                        F.col("longitude").alias("slon"))
    return lanes.join(w, "warehouse_id").join(s, "store_id").select(
        "warehouse_id", "store_id",
        half_up(haversine_km("wlat", "wlon", "slat", "slon"), 4).alias("km"))


QUERIES = {
    "scan_table": scan_table, "table_slice": table_slice, "sql_params": sql_params,
    "save_table": save_table, "normalise_types": normalise_types, "parse_dates": parse_dates,
    "table_summary": table_summary, "key_profile": key_profile, "null_report": null_report,
    "entity_history": entity_history, "filter_options": filter_options, "listings": listings,
    "date_dim": date_dim, "annotate_names": annotate, "haversine_pairs": haversine_pairs}


def _profile(table: str, column: str) -> str:
    return (f"SELECT '{column}' AS column_name, COUNT(*) AS total_rows, "
            f"COUNT(DISTINCT {column}) AS distinct_values, "
            f"COUNT(*) - COUNT({column}) AS null_rows, "
            f"CAST(COUNT(DISTINCT {column}) = COUNT(*) AND COUNT(*) = COUNT({column}) AS BIGINT)"
            f" AS is_unique_key FROM {table}")


def haversine_sql(lat1, lon1, lat2, lon2) -> str:
    a = (f"(sin(radians({lat2}-{lat1})/2)*sin(radians({lat2}-{lat1})/2)"
         f"+cos(radians({lat1}))*cos(radians({lat2}))"
         f"*sin(radians({lon2}-{lon1})/2)*sin(radians({lon2}-{lon1})/2))")
    return f"(12742.0::DOUBLE*atan2(sqrt({a}),sqrt(1.0::DOUBLE-{a})))"


_ORDER_DAY = "SELECT DISTINCT order_date AS d FROM oh"
_HOLIDAY_CASE = "CASE " + " ".join(
    f"WHEN month(d)={m} AND day(d)={k} THEN '{n}'" for m, k, n in features.HOLIDAYS) + " END"
CALENDAR_SQL = f"""
  SELECT d AS date, year(d) AS year, month(d) AS month, dayname(d) AS day_of_week,
         CAST(isodow(d) >= 6 AS BIGINT) AS is_weekend,
         CAST(({_HOLIDAY_CASE}) IS NOT NULL AS BIGINT) AS is_holiday,
         {_HOLIDAY_CASE} AS holiday_name,
         CAST((month(d)=1 AND day(d)<=10) OR (month(d)=7 AND day(d) BETWEEN 10 AND 20)
              OR (month(d)=10 AND day(d) BETWEEN 15 AND 31)
              OR (month(d)=12 AND day(d) BETWEEN 20 AND 31) AS BIGINT) AS is_sale_season,
         CASE WHEN month(d) BETWEEN 3 AND 5 THEN 'Summer' WHEN month(d) BETWEEN 6 AND 8
              THEN 'Monsoon' WHEN month(d) BETWEEN 9 AND 11 THEN 'Festive' ELSE 'Winter' END
           AS season,
         CAST(isodow(d) >= 6 AND ({_HOLIDAY_CASE}) IS NOT NULL AS BIGINT) AS is_long_weekend
  FROM ({_ORDER_DAY})"""

ORACLES = {
    "scan_table": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
                  "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority "
                  "FROM orders",
    "table_slice": with_tables("SELECT order_id, customer_id, total_amount FROM oh "
                               "WHERE status = 'F' ORDER BY total_amount DESC, order_id LIMIT 100"),
    "sql_params": with_tables("SELECT status, COUNT(*) AS n_orders, MAX(total_amount) AS largest "
                              "FROM oh WHERE order_date >= DATE '1998-01-01' "
                              "AND total_amount > 100000 GROUP BY status"),
    "save_table": with_tables("SELECT year(transaction_date) AS year, month(transaction_date) AS "
                              "month, CAST(SUM(quantity) AS BIGINT) AS units FROM txn "
                              "GROUP BY 1, 2"),
    "normalise_types": """
        SELECT o_orderkey AS order_id, o_orderstatus AS status,
               CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey AS DOUBLE) END AS amount,
               CASE WHEN o_orderkey % 7 <> 0 THEN '1999-03-04' END AS placed,
               CASE WHEN o_orderkey % 5 <> 0 THEN 12 END AS units FROM orders""",
    "parse_dates": """
        SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 7 <> 0
               THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS order_date FROM orders""",
    "table_summary": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, COUNT(*) AS rows FROM {n}" for n in _RAW),
    "key_profile": with_tables(" UNION ALL ".join(
        [_profile("txn", c) for c in ("transaction_id", "customer_id", "store_id")]
        + [_profile("oh", "order_id")])),
    "null_report": with_tables("SELECT * FROM (SELECT 'store_id' AS column_name, "
                               "COUNT(*) - COUNT(store_id) AS null_rows FROM txn) "
                               "WHERE null_rows > 0"),
    "entity_history": with_tables("""
        SELECT order_id, customer_id, status, total_amount,
               strftime(order_date, '%Y-%m-%d') AS order_date, position FROM (
          SELECT *, row_number() OVER (PARTITION BY customer_id
                                       ORDER BY order_date DESC, order_id) AS position
          FROM oh WHERE customer_id IN (SELECT customer_id FROM cust WHERE region = 'ASIA'))
        WHERE position <= 3"""),
    "filter_options": with_tables("""
        SELECT DISTINCT 'category' AS kind, category AS value FROM prod
        UNION ALL SELECT DISTINCT 'channel', channel FROM txn
        UNION ALL SELECT DISTINCT 'region', region FROM cust
        UNION ALL SELECT DISTINCT 'year', CAST(year(transaction_date) AS VARCHAR) FROM txn
        UNION ALL SELECT DISTINCT 'segment', segment FROM cust"""),
    "listings": with_tables("""
        SELECT * FROM (SELECT 'customer' AS kind, customer_id AS id, name, segment AS attribute
                       FROM cust ORDER BY customer_id LIMIT 50)
        UNION ALL SELECT * FROM (SELECT 'product', product_id, product_name, brand FROM prod
                                 WHERE category = 'PROMO' ORDER BY product_id LIMIT 20)
        UNION ALL SELECT * FROM (SELECT 'promotion', promo_id, promo_type, target_segment
                                 FROM promo ORDER BY promo_id LIMIT 50)
        UNION ALL SELECT * FROM (SELECT 'store', store_id, store_name, region FROM store
                                 ORDER BY store_id LIMIT 20)"""),
    "date_dim": with_tables(f"SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) "
                            f"FROM ({CALENDAR_SQL})"),
    "annotate_names": with_tables("""
        SELECT i.inventory_id, i.product_id, p.product_name, s.store_name, w.warehouse_name,
               COALESCE(s.store_name, w.warehouse_name, '—') AS location_name
        FROM inv i LEFT JOIN prod p ON i.product_id = p.product_id
        LEFT JOIN store s ON i.store_id = s.store_id
        LEFT JOIN wh w ON i.warehouse_id = w.warehouse_id"""),
    "haversine_pairs": with_tables(f"""
        SELECT l.warehouse_id, l.store_id,
               floor({haversine_sql('w.latitude', 'w.longitude', 's.latitude', 's.longitude')}
                     *10000::DOUBLE+0.5::DOUBLE)/10000::DOUBLE AS km
        FROM (SELECT DISTINCT warehouse_id, store_id FROM ship WHERE store_id IS NOT NULL) l
        JOIN wh w ON l.warehouse_id = w.warehouse_id JOIN store s ON l.store_id = s.store_id"""),
}
