"""Feature tables over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions.scalars import half_up
from aislewise.operators import features as X
from aislewise.plans.catalogue import CALENDAR_SQL
from aislewise.plans.oracle_tables import MAVG, MSUM, R, with_tables
from aislewise.plans.shape import plain

ONLINE = "1-URGENT"


def calendar(t):
    days = t.order_headers.select(F.col("order_date").alias("date")).distinct()
    return X.calendar_columns(days, X.HOLIDAYS)


def rfm(t):
    return plain(X.rfm(t.transactions).withColumn("avg_order_val", half_up("avg_order_val", 6)))


def rfm_scores(t):
    return plain(X.rfm_scores(X.rfm(t.transactions)), "customer_id", "recency_score",
                 "frequency_score", "monetary_score", "rfm_score")


def customer_features(t):
    wide = X.customer_features(t.customers, t.transactions, t.browsing, t.wishlist, t.carts,
                               t.reviews)
    return plain(wide.withColumns({c: half_up(c, 6) for c in (
        "avg_order_val", "avg_dwell_secs", "browse_to_buy", "avg_rating_given")}),
        "customer_id", "recency_days", "frequency", "monetary", "avg_order_val", "rfm_score",
        "total_browses", "avg_dwell_secs", "cart_adds", "browse_to_buy", "wishlist_count",
        "wishlist_bought", "cart_count", "cart_abandoned", "review_count", "avg_rating_given",
        "gender_enc", "income_bracket_enc", "segment_enc", "preferred_category_enc",
        "loyalty_tier_enc")


def product_features(t):
    wide = X.product_features(t.products, t.transactions, t.reviews, t.returns, t.inventory,
                              ONLINE)
    return plain(wide.withColumns({c: half_up(c, 6) for c in (
        "avg_sale_price", "avg_discount", "online_share", "avg_rating", "pct_positive",
        "pct_negative", "avg_days_on_hand")}),
        "product_id", "total_qty_sold", "total_revenue", "avg_sale_price", "avg_discount",
        "n_transactions", "online_share", "avg_rating", "review_count", "pct_positive",
        "pct_negative", "return_count", "total_stock", "avg_days_on_hand", "stockout_locations",
        "return_rate", "sell_through_rate")


def velocity_class(t):
    units = t.transactions.groupBy("product_id").agg(F.sum("quantity").alias("units"))
    wide = t.products.join(units, "product_id", "left").select(
        "product_id", F.coalesce("units", F.lit(0)).alias("total_qty_sold"))
    return plain(X.velocity_class(wide))


def daily_sales(t):
    return plain(X.daily_sales(t.transactions, calendar(t)))


def daily_sales_lags(t):
    daily = X.daily_sales(t.transactions, calendar(t)).select(
        "product_id", "transaction_date", "daily_qty")
    return plain(X.daily_sales_lags(daily).withColumns({
        c: half_up(c, 6) for c in ("rolling_7_mean", "rolling_30_mean")}))


def inventory_features(t):
    return plain(X.inventory_features(t.inventory, t.transactions), "inventory_id", "product_id",
                 "demand_30d", "avg_daily_demand", "days_cover", "reorder_urgency",
                 "overstock_flag", "health_score", "risk_label")


def buying_intent(t):
    return plain(X.buying_intent(t.browsing, t.carts, t.wishlist, t.transactions))


def ticket_features(t):
    return plain(X.ticket_features(t.tickets, t.customers), "ticket_id", "text_length",
                 "word_count", "category_enc", "priority_enc", "loyalty_tier", "segment", "age")


def label_encode(t):
    return plain(X.label_encode(t.products, ["category", "brand"]), "product_id", "category",
                 "category_enc", "brand", "brand_enc")


def intent_thresholds(t):
    intent = X.buying_intent(t.browsing, t.carts, t.wishlist, t.transactions)
    return X.intent_thresholds(intent)


QUERIES = {
    "rfm": rfm, "rfm_scores": rfm_scores, "customer_features": customer_features,
    "product_features": product_features, "velocity_class": velocity_class,
    "daily_sales": daily_sales, "daily_sales_lags": daily_sales_lags,
    "inventory_features": inventory_features, "buying_intent": buying_intent,
    "ticket_features": ticket_features, "label_encode": label_encode,
    "intent_thresholds": intent_thresholds}


# ── SQL twins ───────────────────────────────────────────────────────────────

def _enc(column: str, table: str, key: str) -> str:
    return (f"(SELECT {key}, dense_rank() OVER (ORDER BY CAST({column} AS VARCHAR)) - 1 AS e "
            f"FROM {table})")


EXTRA = {
    "x_rfm": f"""
      SELECT customer_id, date_diff('day', last_purchase,
               (SELECT MAX(transaction_date) FROM txn) + 1) AS recency_days,
             frequency, monetary, avg_order_val, first_purchase, last_purchase,
             date_diff('day', first_purchase, last_purchase) AS customer_lifetime_days
      FROM (SELECT customer_id, COUNT(*) AS frequency, {MSUM('total_amount')} AS monetary,
                   {MAVG('total_amount')} AS avg_order_val,
                   MIN(transaction_date) AS first_purchase,
                   MAX(transaction_date) AS last_purchase FROM txn GROUP BY 1)""",
    "x_edges": "SELECT " + ", ".join(
        R(f"quantile_cont(CAST({c} AS DOUBLE), {p})", 6) + f" AS {c[0]}{i}"
        for c in ("recency_days", "frequency", "monetary")
        for i, p in enumerate((0.2, 0.4, 0.6, 0.8))) + " FROM x_rfm",
    "x_scores": """
      SELECT *, recency_score + frequency_score + monetary_score AS rfm_score FROM (
        SELECT customer_id, """ + ", ".join(
        ("6 - " if c == "recency_days" else "") + "(1" + "".join(
            f" + CASE WHEN {c} > {c[0]}{i} THEN 1 ELSE 0 END" for i in range(4))
        + f") AS {c.split('_')[0]}_score" for c in ("recency_days", "frequency", "monetary"))
    + " FROM x_rfm CROSS JOIN x_edges)",
    "x_daily": f"""
      SELECT product_id, transaction_date, CAST(SUM(quantity) AS BIGINT) AS daily_qty,
             {MSUM('total_amount')} AS daily_revenue, COUNT(*) AS n_orders
      FROM txn GROUP BY 1, 2""",
    "x_calendar": CALENDAR_SQL,
    "x_demand": """
      SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS units FROM txn
      WHERE transaction_date >= (SELECT MAX(transaction_date) FROM txn) - 30 GROUP BY 1""",
    "x_invfeat": f"""
      SELECT *, CASE WHEN health_score > 0 AND health_score <= 30 THEN 'High Risk'
                     WHEN health_score > 30 AND health_score <= 60 THEN 'Medium'
                     WHEN health_score > 60 AND health_score <= 100 THEN 'Healthy' END AS risk_label
      FROM (SELECT *, {R('''CASE WHEN days_cover/30*60 > 60 THEN 60.0::DOUBLE
                              ELSE days_cover/30*60 END
                         + (1-reorder_urgency)*25 + (1-overstock_flag)*15''', 1)} AS health_score
        FROM (SELECT *, {R('''stock_qty/CASE WHEN avg_daily_demand < 0.01 THEN 0.01::DOUBLE
                                ELSE avg_daily_demand END''', 1)} AS days_cover,
               CASE WHEN stock_qty <= reorder_point THEN 1 ELSE 0 END AS reorder_urgency,
               CASE WHEN stock_qty > max_stock THEN 1 ELSE 0 END AS overstock_flag
          FROM (SELECT i.*, COALESCE(d.units, 1) AS demand_30d,
                       COALESCE({R('d.units/30::DOUBLE')}, 0.1::DOUBLE) AS avg_daily_demand
                FROM inv i LEFT JOIN x_demand d ON i.product_id = d.product_id)))""",
    "x_intent": f"""
      SELECT *, CASE WHEN intent_score > 0 AND intent_score <= 30 THEN 'Low'
                     WHEN intent_score > 30 AND intent_score <= 60 THEN 'Medium'
                     WHEN intent_score > 60 AND intent_score <= 100 THEN 'High' END AS intent_label
      FROM (SELECT *, {R('''least(total_views,20.0::DOUBLE)/20*30 + cart_flag*35
                 + wishlist_flag*20 + least(total_dwell,300.0::DOUBLE)/300*15''')} AS intent_score
        FROM (SELECT b.*, CASE WHEN c.product_id IS NULL THEN 0 ELSE 1 END AS cart_flag,
                     CASE WHEN w.product_id IS NULL THEN 0 ELSE 1 END AS wishlist_flag,
                     CASE WHEN p.product_id IS NULL THEN 0 ELSE 1 END AS purchased_label
          FROM (SELECT customer_id, product_id, CAST(SUM(page_views) AS DOUBLE) AS total_views,
                       CAST(SUM(dwell_seconds) AS DOUBLE) AS total_dwell, COUNT(*) AS sessions,
                       MAX(timestamp) AS last_browse FROM browse GROUP BY 1, 2) b
          LEFT JOIN (SELECT DISTINCT customer_id, product_id FROM cart
                     WHERE status IN ('Active','Abandoned')) c
            ON b.customer_id=c.customer_id AND b.product_id=c.product_id
          LEFT JOIN (SELECT DISTINCT customer_id, product_id FROM wish) w
            ON b.customer_id=w.customer_id AND b.product_id=w.product_id
          LEFT JOIN (SELECT DISTINCT customer_id, product_id FROM txn) p
            ON b.customer_id=p.customer_id AND b.product_id=p.product_id))""",
    "x_units": "SELECT p.product_id, COALESCE(CAST(SUM(t.quantity) AS BIGINT), 0) AS "
               "total_qty_sold FROM prod p LEFT JOIN txn t ON p.product_id = t.product_id "
               "GROUP BY 1",
}


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    return with_tables(body, {**EXTRA, **(extra or {})})


ORACLES = {
    "rfm": sql(f"""SELECT customer_id, recency_days, frequency, monetary,
        {R('avg_order_val', 6)} AS avg_order_val,
        strftime(first_purchase,'%Y-%m-%d') AS first_purchase,
        strftime(last_purchase,'%Y-%m-%d') AS last_purchase, customer_lifetime_days FROM x_rfm"""),
    "rfm_scores": sql("SELECT * FROM x_scores"),
    "customer_features": sql(f"""
        SELECT c.customer_id, COALESCE(r.recency_days,0) AS recency_days,
          COALESCE(r.frequency,0) AS frequency, COALESCE(r.monetary,0) AS monetary,
          {R('COALESCE(r.avg_order_val,0)', 6)} AS avg_order_val, s.rfm_score,
          COALESCE(b.n,0) AS total_browses, {R('COALESCE(b.dwell,0)', 6)} AS avg_dwell_secs,
          b.adds AS cart_adds, {R('COALESCE(b.buy,0)', 6)} AS browse_to_buy,
          COALESCE(w.n,0) AS wishlist_count, w.bought AS wishlist_bought,
          COALESCE(k.n,0) AS cart_count, k.abandoned AS cart_abandoned,
          v.n AS review_count, {R('v.rating', 6)} AS avg_rating_given,
          e1.e AS gender_enc, e2.e AS income_bracket_enc, e3.e AS segment_enc,
          e4.e AS preferred_category_enc, e5.e AS loyalty_tier_enc
        FROM cust c LEFT JOIN x_rfm r ON c.customer_id=r.customer_id
        LEFT JOIN x_scores s ON c.customer_id=s.customer_id
        LEFT JOIN (SELECT customer_id, COUNT(*) AS n, AVG(dwell_seconds) AS dwell,
                     CAST(SUM(CAST(added_to_cart AS INT)) AS BIGINT) AS adds, AVG(CAST(purchased AS INT)) AS buy
                   FROM browse GROUP BY 1) b ON c.customer_id=b.customer_id
        LEFT JOIN (SELECT customer_id, COUNT(*) AS n, CAST(SUM(CAST(is_purchased AS INT)) AS BIGINT) AS bought
                   FROM wish GROUP BY 1) w ON c.customer_id=w.customer_id
        LEFT JOIN (SELECT customer_id, COUNT(*) AS n,
                     COUNT(*) FILTER (WHERE status='Abandoned') AS abandoned
                   FROM cart GROUP BY 1) k ON c.customer_id=k.customer_id
        LEFT JOIN (SELECT customer_id, COUNT(*) AS n, AVG(rating) AS rating
                   FROM rev GROUP BY 1) v ON c.customer_id=v.customer_id
        """ + "".join(f"JOIN {_enc(col, 'cust', 'customer_id')} e{i} "
                      f"ON c.customer_id=e{i}.customer_id\n" for i, col in enumerate(
                          ("gender", "income_bracket", "segment", "preferred_category",
                           "loyalty_tier"), 1))),
    "product_features": sql(f"""
        SELECT p.product_id, COALESCE(s.q,0) AS total_qty_sold,
          COALESCE(s.rev,0) AS total_revenue, {R('s.price', 6)} AS avg_sale_price,
          {R('s.disc', 6)} AS avg_discount, s.n AS n_transactions,
          {R('s.online', 6)} AS online_share, {R('v.rating', 6)} AS avg_rating,
          v.n AS review_count, {R('v.pos', 6)} AS pct_positive, {R('v.neg', 6)} AS pct_negative,
          COALESCE(r.n,0) AS return_count, i.stock AS total_stock,
          {R('i.days', 6)} AS avg_days_on_hand, i.risky AS stockout_locations,
          {R('COALESCE(CAST(COALESCE(r.n,0) AS DOUBLE)/NULLIF(COALESCE(s.q,0),0),0)', 4)}
            AS return_rate,
          {R('''COALESCE(CAST(COALESCE(s.q,0) AS DOUBLE)/NULLIF(i.stock+COALESCE(s.q,0),0),0)''',
             4)} AS sell_through_rate
        FROM prod p
        LEFT JOIN (SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS q,
                     {MSUM('total_amount')} AS rev, {MAVG('unit_price')} AS price,
                     {MAVG('discount_pct')} AS disc, COUNT(*) AS n,
                     CAST(COUNT(*) FILTER (WHERE channel='{ONLINE}') AS DOUBLE)/COUNT(*) AS online
                   FROM txn GROUP BY 1) s ON p.product_id=s.product_id
        LEFT JOIN (SELECT product_id, AVG(rating) AS rating, COUNT(*) AS n,
                     CAST(COUNT(*) FILTER (WHERE sentiment_label='Positive')*100 AS DOUBLE)
                       /COUNT(*) AS pos,
                     CAST(COUNT(*) FILTER (WHERE sentiment_label='Negative')*100 AS DOUBLE)
                       /COUNT(*) AS neg
                   FROM rev GROUP BY 1) v ON p.product_id=v.product_id
        LEFT JOIN (SELECT product_id, COUNT(*) AS n FROM ret GROUP BY 1) r
          ON p.product_id=r.product_id
        LEFT JOIN (SELECT product_id, CAST(SUM(stock_qty) AS BIGINT) AS stock,
                     AVG(days_on_hand) AS days, CAST(SUM(stockout_risk) AS BIGINT) AS risky
                   FROM inv GROUP BY 1) i ON p.product_id=i.product_id"""),
    "velocity_class": sql("""
        SELECT product_id, total_qty_sold,
               CASE WHEN total_qty_sold > t THEN 'A' WHEN total_qty_sold > h THEN 'B'
                    ELSE 'C' END AS velocity_class
        FROM x_units CROSS JOIN (SELECT """
        + R("quantile_cont(CAST(total_qty_sold AS DOUBLE), 0.5)", 6) + " AS h, "
        + R("quantile_cont(CAST(total_qty_sold AS DOUBLE), 0.8)", 6) + " AS t FROM x_units)"),
    "daily_sales": sql("""
        SELECT d.product_id, strftime(d.transaction_date,'%Y-%m-%d') AS transaction_date,
               d.daily_qty, d.daily_revenue, d.n_orders, c.is_holiday, c.is_sale_season,
               c.season, c.day_of_week, c.is_weekend
        FROM x_daily d LEFT JOIN x_calendar c ON d.transaction_date = c.date"""),
    "daily_sales_lags": sql(f"""
        SELECT product_id, strftime(transaction_date,'%Y-%m-%d') AS transaction_date, daily_qty,
          lag(daily_qty,7) OVER w AS lag_7, lag(daily_qty,14) OVER w AS lag_14,
          {R('AVG(daily_qty) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)', 6)}
            AS rolling_7_mean,
          {R('AVG(daily_qty) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)', 6)}
            AS rolling_30_mean,
          month(transaction_date) AS month, day(transaction_date) AS day_of_month,
          week(transaction_date) AS week_number, quarter(transaction_date) AS quarter
        FROM x_daily WINDOW w AS (PARTITION BY product_id ORDER BY transaction_date)"""),
    "inventory_features": sql("""SELECT inventory_id, product_id, demand_30d, avg_daily_demand,
        days_cover, reorder_urgency, overstock_flag, health_score, risk_label FROM x_invfeat"""),
    "buying_intent": sql("SELECT * REPLACE (strftime(last_browse, '%Y-%m-%d %H:%M:%S') AS "
                         "last_browse) FROM x_intent"),
    "ticket_features": sql(f"""
        SELECT t.ticket_id, length(t.description) AS text_length,
               len(regexp_extract_all(t.description, '\\S+')) AS word_count,
               e.e AS category_enc,
               CASE t.priority WHEN 'Low' THEN 0 WHEN 'High' THEN 2 WHEN 'Critical' THEN 3
                    ELSE 1 END AS priority_enc, c.loyalty_tier, c.segment, c.age
        FROM tick t JOIN {_enc('category', 'tick', 'ticket_id')} e ON t.ticket_id=e.ticket_id
        LEFT JOIN cust c ON t.customer_id=c.customer_id"""),
    "label_encode": sql("""
        SELECT product_id, category, dense_rank() OVER (ORDER BY category)-1 AS category_enc,
               brand, dense_rank() OVER (ORDER BY brand)-1 AS brand_enc FROM prod"""),
    "intent_thresholds": sql(f"""
        SELECT h AS high_threshold,
               CASE WHEN p25 < 0.05 THEN 0.05::DOUBLE WHEN p25 > h-0.02::DOUBLE
                    THEN h-0.02::DOUBLE ELSE p25 END AS medium_threshold
        FROM (SELECT CASE WHEN p60 < 0.15 THEN 0.15::DOUBLE WHEN p60 > 0.9 THEN 0.9::DOUBLE
                          ELSE p60 END AS h, p25
              FROM (SELECT {R('quantile_cont(intent_score/100, 0.6)', 6)} AS p60,
                           {R('quantile_cont(intent_score/100, 0.25)', 6)} AS p25
                    FROM x_intent WHERE purchased_label = 1))"""),
}
