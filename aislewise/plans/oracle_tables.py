"""The retail views of ``sources.adapters`` again, as DuckDB common table expressions."""

from __future__ import annotations

import re


def R(x: str, n: int = 2) -> str:
    """Half-up rounding with the same double arithmetic as the Spark helper."""
    s = 10 ** n
    return f"(floor(({x})*{s}::DOUBLE+0.5::DOUBLE)/{s}::DOUBLE)"


def MSUM(x: str) -> str:
    return f"(CAST(SUM(floor(({x})*100::DOUBLE+0.5::DOUBLE)) AS DOUBLE)/100::DOUBLE)"


def MAVG(x: str) -> str:
    return f"({MSUM(x)}/COUNT({x}))"


def DIV(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE)/NULLIF(CAST({b} AS DOUBLE),0))"


def pick(values: list[str], key: str) -> str:
    items = ",".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[CAST(({key}) % {len(values)} AS INT)+1]"


CATS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "All"]
CHANS = ["Email", "SMS", "Push Notification", "Online"]

TABLES: dict[str, str] = {
    "sales": f"""
      SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS supplier_id,
             l_linenumber AS line_number, CAST(l_quantity AS BIGINT) AS quantity,
             {R('l_extendedprice/l_quantity')} AS unit_price, l_discount AS discount_pct,
             {R('l_extendedprice*(1.0::DOUBLE-l_discount)')} AS total_amount,
             l_returnflag AS return_flag, CAST(l_shipdate AS DATE) AS ship_date,
             o_custkey AS customer_id, o_orderstatus AS order_status,
             o_orderpriority AS channel, CAST(o_orderdate AS DATE) AS transaction_date
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "txn": """
      SELECT order_id*10+line_number AS transaction_id, order_id, customer_id, product_id,
             CASE WHEN order_id % 4 <> 0 THEN order_id % 25 END AS store_id, channel, quantity,
             unit_price, discount_pct, total_amount, transaction_date,
             return_flag = 'R' AS is_returned FROM sales""",
    "ord": """
      SELECT order_id, customer_id, product_id,
             CASE WHEN order_id % 4 <> 0 THEN order_id % 25 END AS store_id,
             CASE order_status WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Placed'
                  ELSE 'Cancelled' END AS status,
             quantity, total_amount, transaction_date AS order_date FROM sales""",
    "oh": """
      SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
             o_totalprice AS total_amount, CAST(o_orderdate AS DATE) AS order_date FROM orders""",
    "ret": f"""
      SELECT order_id*10+line_number AS return_id, order_id, customer_id, product_id,
             {pick(['Damaged', 'Wrong Item', 'Too Small'], 'line_number')} AS reason,
             {pick(['Requested', 'Approved'], 'order_id')} AS status,
             ship_date AS return_date, total_amount AS refund_amount
      FROM sales WHERE return_flag = 'R'""",
    "prod": f"""
      SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
             p_brand AS sub_category, p_brand AS brand, p_retailprice AS price,
             {R('p_retailprice*0.6::DOUBLE')} AS cost_price,
             p_partkey % (SELECT COUNT(*) FROM supplier) AS supplier_id,
             p_partkey % 7 <> 0 AS is_active FROM part""",
    "cust": f"""
      SELECT c_custkey AS customer_id, c_name AS name, n_name AS city, r_name AS region,
             c_mktsegment AS segment, {pick(CATS, 'c_custkey')} AS preferred_category,
             {pick(CHANS, 'c_custkey')} AS preferred_channel,
             CASE WHEN c_acctbal < 0 THEN 'Bronze' WHEN c_acctbal < 3000 THEN 'Silver'
                  WHEN c_acctbal < 7000 THEN 'Gold' ELSE 'Platinum' END AS loyalty_tier,
             {pick(['F', 'M', 'Other'], 'c_custkey')} AS gender,
             {pick(['<2L', '2-5L', '5-10L'], 'c_custkey')} AS income_bracket,
             18 + c_custkey % 60 AS age, CAST(c_custkey % 13 AS DOUBLE) AS shopping_frequency,
             c_custkey % 3 <> 0 AS email_opt_in, c_custkey % 2 = 0 AS sms_opt_in,
             c_custkey % 5 <> 0 AS app_installed
      FROM customer JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey""",
    "store": """
      SELECT CAST(n_nationkey AS BIGINT) AS store_id, 'Store ' || n_name AS store_name,
             n_name AS city, r_name AS region,
             8 + (CAST(n_nationkey AS BIGINT)*7919 % 2800)/100::DOUBLE AS latitude,
             68 + (CAST(n_nationkey AS BIGINT)*104729 % 2900)/100::DOUBLE AS longitude
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "wh": """
      SELECT s_suppkey AS warehouse_id, 'DC ' || s_name AS warehouse_name,
             8 + (s_suppkey*6367 % 2800)/100::DOUBLE AS latitude,
             68 + (s_suppkey*7919 % 2900)/100::DOUBLE AS longitude FROM supplier""",
    "sup": """
      SELECT s_suppkey AS supplier_id, s_name AS name,
             (s_suppkey % 40 + 60)/100::DOUBLE AS reliability_score,
             s_suppkey % 13 + 2 AS lead_time_days FROM supplier""",
    "ev": """
      SELECT event_id, user_id AS customer_id,
             event_id % (SELECT COUNT(*) FROM part) AS product_id, ts AS timestamp,
             event_type, value FROM events""",
    "browse": """
      SELECT event_id AS browse_id, customer_id, product_id, timestamp,
             1 + event_id % 5 AS page_views, CAST(floor(value) AS BIGINT) AS dwell_seconds,
             event_type = 'click' AS added_to_cart, event_id % 10 = 0 AS purchased
      FROM ev WHERE event_type IN ('view','click')""",
    "cart": f"""
      SELECT event_id AS cart_id, customer_id, product_id,
             {pick(['Abandoned', 'Active', 'Purchased'], 'event_id')} AS status
      FROM ev WHERE event_type = 'error'""",
    "wish": """
      SELECT event_id AS wishlist_id, customer_id, product_id, event_id % 4 = 0 AS is_purchased
      FROM ev WHERE event_type = 'signup'""",
    "inv": """
      SELECT *, reorder_point*5 AS max_stock, inventory_id % 90 AS days_on_hand,
             CASE WHEN stock_qty <= reorder_point THEN 1 ELSE 0 END AS stockout_risk
      FROM (
        SELECT p_partkey*2 AS inventory_id, p_partkey AS product_id,
               CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 25 END AS store_id,
               CASE WHEN p_partkey % 3 <> 0
                    THEN p_partkey % (SELECT COUNT(*) FROM supplier) END AS warehouse_id,
               CASE WHEN p_partkey % 3 = 0 THEN 'store' ELSE 'warehouse' END AS location_type,
               p_partkey*37 % 500 AS stock_qty, 20 + p_partkey*13 % 80 AS reorder_point
        FROM part
        UNION ALL
        SELECT p_partkey*2+1, p_partkey, NULL,
               (p_partkey+7) % (SELECT COUNT(*) FROM supplier), 'warehouse',
               p_partkey*53 % 400, 20 + p_partkey*11 % 60
        FROM part WHERE p_partkey % 4 = 0)""",
    "mov": """
      SELECT l_partkey*2 AS inventory_id, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem""",
    "ship": """
      SELECT l_orderkey AS order_id, l_suppkey AS warehouse_id, l_partkey AS product_id,
             CASE WHEN l_orderkey % 4 <> 0 THEN l_orderkey % 25 END AS store_id,
             CAST(l_quantity AS BIGINT) AS quantity, (l_orderkey*7+l_linenumber) % 300 AS hours
      FROM lineitem""",
    "price": """
      SELECT product_id, CAST(date_trunc('month', transaction_date) AS DATE) AS effective_date,
             floor(CAST(SUM(floor(unit_price*100::DOUBLE+0.5::DOUBLE)) AS DOUBLE)/COUNT(*)
                   +0.5::DOUBLE)/100::DOUBLE AS price
      FROM sales GROUP BY 1, 2""",
    "comp": f"""
      SELECT l_partkey AS product_id, l_suppkey AS competitor,
             {R('l_extendedprice/l_quantity')} AS price FROM lineitem""",
    "promo": f"""
      SELECT p_partkey AS promo_id, p_partkey AS product_id,
             {pick(['Flat Discount', 'Bundle', 'Clearance'], 'p_partkey')} AS promo_type,
             {pick(['Online', 'Offline', 'Both'], 'p_partkey')} AS channel,
             {pick(SEGS, 'p_partkey')} AS target_segment,
             (p_partkey % 50 + 5)/100::DOUBLE AS discount_pct,
             DATE '1996-01-01' + CAST(p_partkey*17 % 1500 AS INT) AS start_date,
             DATE '1996-01-01' + CAST(p_partkey*17 % 1500 + p_partkey % 120 + 30 AS INT)
               AS end_date,
             p_partkey % 5 <> 0 AS is_active
      FROM part""",
    "camp": """
      SELECT user_id AS campaign_id,
             COUNT(*) FILTER (WHERE event_type IN ('view','click')) AS impressions,
             COUNT(*) FILTER (WHERE event_type = 'click') AS clicks,
             COUNT(*) FILTER (WHERE event_type = 'purchase') AS conversions,
             COUNT(*) FILTER (WHERE event_type IN ('view','click'))*2.5::DOUBLE AS amount_spent
      FROM events GROUP BY 1""",
    "rev": """
      SELECT review_id, product_id, customer_id, review_text, rating,
             CASE WHEN rating >= 4 THEN 'Positive' WHEN rating <= 2 THEN 'Negative'
                  ELSE 'Neutral' END AS sentiment_label, review_date
      FROM (SELECT d.doc_id AS review_id, d.doc_id % (SELECT COUNT(*) FROM part) AS product_id,
                   d.doc_id*7 % (SELECT COUNT(*) FROM customer) AS customer_id,
                   d.text AS review_text,
                   CASE WHEN l.toxic = 1 THEN 1 WHEN l.quality = 1 THEN 5
                        WHEN l.quality = 0 THEN 2 ELSE 3 END AS rating,
                   DATE '2022-01-01' + CAST(d.doc_id % 730 AS INT) AS review_date
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "tick": """
      SELECT doc_id AS ticket_id, doc_id*7 % (SELECT COUNT(*) FROM customer) AS customer_id,
             CASE lang WHEN 'en' THEN 'Delivery Delay' WHEN 'fr' THEN 'Return & Refund'
                  WHEN 'de' THEN 'Product Quality' WHEN 'es' THEN 'Payment Problem' END
               AS category,
             CASE WHEN n_chars < 500 THEN 'Low' WHEN n_chars < 1500 THEN 'Medium'
                  WHEN n_chars < 4000 THEN 'High' ELSE 'Critical' END AS priority,
             text AS description,
             CASE WHEN doc_id % 4 = 0 THEN 'Open' ELSE 'Resolved' END AS status,
             1704067200 + doc_id % 365 * 86400 + doc_id % 24 * 3600 AS created_s,
             CASE WHEN doc_id % 4 <> 0 THEN 1704067200 + doc_id % 365 * 86400
                  + doc_id % 24 * 3600 + doc_id % 97 * 1800 END AS resolved_s
      FROM documents""",
    "msg": """
      SELECT conv_id*1000 + turn AS message_id,
             conv_id % (SELECT COUNT(*) FROM customer) AS customer_id, text AS message
      FROM conversations""",
}


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it names, in dependency order."""
    known = {**TABLES, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in ordered and re.search(
                    rf"\b(?:FROM|JOIN)\s+{name}\b", text, flags=re.I):
                visit(known[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({known[n]})" for n in ordered)
    return f"WITH {ctes}\n{body}"
