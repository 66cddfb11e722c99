"""Executive rollups over the given tables."""

from __future__ import annotations

from aislewise.operators import overview as V
from aislewise.plans.oracle_tables import DIV, MAVG, MSUM, R, with_tables
from aislewise.plans.shape import plain


def _base(t):
    return t.transactions, t.products, t.customers


def estate(t):
    return plain(V.estate(*_base(t), t.stores, t.warehouses, t.suppliers))


def slice_filter(t):
    return plain(V.estate(*_base(t), t.stores, t.warehouses, t.suppliers, category="PROMO",
                          channel="2-HIGH", region="ASIA", year=1998))


def revenue_trend(t):
    return plain(V.revenue_trend(*_base(t), months=36))


def channel_mix(t):
    return plain(V.channel_mix(*_base(t)))


def category_performance(t):
    return plain(V.category_performance(*_base(t)))


def category_drilldown(t):
    return plain(V.category_performance(*_base(t), category="PROMO"))


def seasonality(t):
    return plain(V.seasonality(*_base(t)))


def top_movers(t):
    return plain(V.top_movers(*_base(t), limit=25))


def segment_aov(t):
    return plain(V.segment_aov(t.transactions, t.customers))


QUERIES = {
    "estate": estate, "slice_filter": slice_filter, "revenue_trend": revenue_trend,
    "channel_mix": channel_mix, "category_performance": category_performance,
    "category_drilldown": category_drilldown, "seasonality": seasonality,
    "top_movers": top_movers, "segment_aov": segment_aov}

_MARGIN = "t.total_amount - t.quantity*p.cost_price"
_FROM = ("FROM txn t JOIN prod p ON t.product_id = p.product_id "
         "JOIN cust c ON t.customer_id = c.customer_id")


def _estate(where: str) -> str:
    return with_tables(f"""
      SELECT {R('revenue')} AS revenue, {R('margin')} AS margin,
        {R('COALESCE(' + DIV('margin', 'revenue') + ',0)*100', 1)} AS margin_pct, units,
        transactions, {R('basket')} AS avg_basket, {R('discount*100', 1)} AS avg_discount_pct,
        buyers, skus_sold,
        {R('COALESCE(' + DIV('returned', 'revenue') + ',0)*100', 1)} AS return_rate_pct,
        period_start, period_end, (SELECT COUNT(*) FROM cust) AS customers,
        (SELECT COUNT(*) FROM prod) AS products, (SELECT COUNT(*) FROM store) AS stores,
        (SELECT COUNT(*) FROM wh) AS warehouses, (SELECT COUNT(*) FROM sup) AS suppliers
      FROM (SELECT COUNT(*) AS transactions, {MSUM('t.total_amount')} AS revenue,
              CAST(SUM(t.quantity) AS BIGINT) AS units, {MSUM(_MARGIN)} AS margin,
              COUNT(DISTINCT t.customer_id) AS buyers, COUNT(DISTINCT t.product_id) AS skus_sold,
              strftime(MIN(t.transaction_date),'%Y-%m-%d') AS period_start,
              strftime(MAX(t.transaction_date),'%Y-%m-%d') AS period_end,
              {MAVG('t.total_amount')} AS basket, {MAVG('t.discount_pct')} AS discount,
              {MSUM('CASE WHEN t.is_returned THEN t.total_amount END')} AS returned
            {_FROM} WHERE {where})""")


def _category(label: str, where: str) -> str:
    return with_tables(f"""
      SELECT label, revenue, {R('revenue/SUM(revenue) OVER ()*100', 1)} AS revenue_share_pct,
        units, margin, {R('margin/revenue*100', 1)} AS margin_pct, buyers, skus,
        growth_pct, {R('median(revenue) OVER ()')} AS median_revenue,
        {R('median(growth_pct) OVER ()', 1)} AS median_growth_pct
      FROM (SELECT *, {R('COALESCE(' + DIV('latest-prior', 'prior') + ',0)*100', 1)} AS growth_pct
        FROM (SELECT p.{label} AS label, {MSUM('t.total_amount')} AS revenue,
          CAST(SUM(t.quantity) AS BIGINT) AS units, {MSUM(_MARGIN)} AS margin,
          COUNT(DISTINCT t.customer_id) AS buyers, COUNT(DISTINCT t.product_id) AS skus,
          COALESCE({MSUM('CASE WHEN year(t.transaction_date)=y.a THEN t.total_amount END')},0)
            AS latest,
          COALESCE({MSUM('CASE WHEN year(t.transaction_date)=y.b THEN t.total_amount END')},0)
            AS prior
        {_FROM} CROSS JOIN (SELECT list_sort(list(y),'DESC')[1] AS a, list_sort(list(y),'DESC')[2]
          AS b FROM (SELECT DISTINCT year(transaction_date) AS y FROM txn)) y
        WHERE {where} GROUP BY 1))""")


ORACLES = {
    "estate": _estate("TRUE"),
    "slice_filter": _estate("p.category='PROMO' AND t.channel='2-HIGH' AND c.region='ASIA' "
                            "AND year(t.transaction_date)=1998"),
    "revenue_trend": with_tables(f"""
      SELECT *, CAST(month = first_value(month) OVER (ORDER BY revenue DESC, month) AS BIGINT)
          AS is_peak,
        CAST(month = first_value(month) OVER (ORDER BY revenue, month) AS BIGINT) AS is_trough
      FROM (SELECT strftime(t.transaction_date,'%Y-%m') AS month,
          {MSUM('t.total_amount')} AS revenue, {MSUM(_MARGIN)} AS margin,
          CAST(SUM(t.quantity) AS BIGINT) AS units, COUNT(*) AS transactions,
          COUNT(DISTINCT t.customer_id) AS buyers
        {_FROM} GROUP BY 1 ORDER BY 1 DESC LIMIT 36)"""),
    "channel_mix": with_tables(f"""
      SELECT channel, revenue, transactions,
             {R('revenue/SUM(revenue) OVER ()*100', 1)} AS share_pct
      FROM (SELECT t.channel, {MSUM('t.total_amount')} AS revenue, COUNT(*) AS transactions
            {_FROM} GROUP BY 1)"""),
    "category_performance": _category("category", "TRUE"),
    "category_drilldown": _category("sub_category", "p.category='PROMO'"),
    "seasonality": with_tables(f"""
      SELECT *, CAST(row_number() OVER (ORDER BY revenue_per_day DESC, month, weekday) = 1
                     AS BIGINT) AS is_peak
      FROM (SELECT *, {R('revenue/days')} AS revenue_per_day
        FROM (SELECT month(t.transaction_date) AS month, dayofweek(t.transaction_date) AS weekday,
                {MSUM('t.total_amount')} AS revenue,
                COUNT(DISTINCT t.transaction_date) AS days {_FROM} GROUP BY 1, 2))"""),
    "top_movers": with_tables(f"""
      SELECT product_id, product_name, category, brand, revenue, units,
             {R('margin/revenue*100', 1)} AS margin_pct
      FROM (SELECT p.product_id, p.product_name, p.category, p.brand,
              {MSUM('t.total_amount')} AS revenue, CAST(SUM(t.quantity) AS BIGINT) AS units,
              {MSUM(_MARGIN)} AS margin {_FROM} GROUP BY 1,2,3,4
            ORDER BY revenue DESC, product_id LIMIT 25)"""),
    "segment_aov": with_tables(f"""
      SELECT COALESCE(segment, '_global') AS segment, {R('aov')} AS aov
      FROM (SELECT c.segment, {MAVG('t.total_amount')} AS aov FROM txn t
            LEFT JOIN cust c ON t.customer_id=c.customer_id
            GROUP BY GROUPING SETS ((c.segment), ()))"""),
}
