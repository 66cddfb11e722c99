"""Pricing, promotions, competitors and assortment over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions.scalars import half_up
from aislewise.operators import features as X, merchandising as M
from aislewise.plans.features import sql
from aislewise.plans.oracle_tables import MAVG, MSUM, R
from aislewise.plans.shape import plain
from aislewise.session import stored


def _elasticity(t):
    return M.price_elasticity(t.pricing_history, t.transactions)


def _dynamic(t):
    features = stored(X.inventory_features(t.inventory, t.transactions))
    return M.dynamic_price(t.products, t.competitor_pricing, t.inventory, features,
                           _elasticity(t))


def _did(t):
    return M.promo_did(t.promotions, t.transactions, t.products)


def _forecast(t):
    """A flat forecast from each product's mean selling day, rising 10 % a day."""
    daily = t.transactions.groupBy("product_id", "transaction_date").agg(
        F.sum("quantity").alias("q"))
    mean = daily.groupBy("product_id").agg((F.sum("q") / F.count(F.lit(1))).alias("m"))
    return mean.select(
        "product_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("day"), "m",
        (F.pmod("product_id", F.lit(20)) + 10).cast("double").alias("mape")).select(
        "product_id", "day",
        half_up(F.col("m") * (F.col("day") * 0.1 + 1.0), 1).alias("forecast_qty"), "mape")


def price_elasticity(t):
    return _elasticity(t).select("product_id", half_up("elasticity", 6).alias("elasticity"))


def dynamic_price(t):
    return plain(_dynamic(t))


def price_scenarios(t):
    return plain(M.price_scenarios(_dynamic(t)))


def promo_did(t):
    return plain(_did(t).withColumns({c: half_up(c, 6) for c in ("uplift_frac",
                                                                 "cannibal_rate")}),
                 "promo_id", "product_id", "category", "days", "sisters", "own_history",
                 "treated", "sister_history", "sister_during", "history_sales", "uplift_frac",
                 "cannibal_rate")


def promo_curve(t):
    return M.promo_curve(_did(t)).select(
        "n_uplift", "n_cannibal", *[half_up(c, 4).alias(c) for c in (
            "slope", "intercept", "cannibal_rate")])


def promo_performance(t):
    return plain(M.promo_performance(stored(_did(t)), t.products))


def competitor_gaps(t):
    return plain(M.competitor_gaps(t.products, t.competitor_pricing))


def competitor_kpis(t):
    return plain(M.competitor_kpis(M.competitor_gaps(t.products, t.competitor_pricing)))


def competitor_breaches(t):
    return plain(M.competitor_breaches(M.competitor_gaps(t.products, t.competitor_pricing), 8))


def gap_stats_latest(t):
    return M.gap_stats_latest(t.competitor_pricing, t.pricing_history).select(
        half_up("mean_gap", 6).alias("mean_gap"), half_up("std_gap", 6).alias("std_gap"))


def assortment_pareto(t):
    return plain(M.assortment_pareto(t.orders, t.stores, t.products))


def assortment_candidates(t):
    return plain(M.assortment_candidates(t.orders, t.stores, t.products, t.inventory))


def forecast_band(t):
    return plain(M.forecast_band(_forecast(t)))


def forecast_totals(t):
    return plain(M.forecast_totals(_forecast(t)))


QUERIES = {
    "price_elasticity": price_elasticity, "dynamic_price": dynamic_price,
    "price_scenarios": price_scenarios, "promo_did": promo_did, "promo_curve": promo_curve,
    "promo_performance": promo_performance, "competitor_gaps": competitor_gaps,
    "competitor_kpis": competitor_kpis, "competitor_breaches": competitor_breaches,
    "gap_stats_latest": gap_stats_latest, "assortment_pareto": assortment_pareto,
    "assortment_candidates": assortment_candidates, "forecast_band": forecast_band,
    "forecast_totals": forecast_totals}


def _window(key_filter: str, bounds: str, value: str) -> str:
    return f"COALESCE((SELECT {value} FROM m_daily d WHERE {key_filter} AND {bounds}), 0)"


_BEFORE = "d.day >= q.start_date - 90 AND d.day < q.start_date"
_DURING = "d.day BETWEEN q.start_date AND q.end_date"
_OWN, _SISTER = "d.product_id=q.product_id", "d.category=q.category AND d.product_id<>q.product_id"
_CENTS = "CAST(SUM(d.cents) AS DOUBLE)/100"

EXTRA = {
    "m_periods": """
      SELECT p.*, lead(effective_date) OVER w AS until FROM price p
      WINDOW w AS (PARTITION BY product_id ORDER BY effective_date)""",
    "m_rates": """
      SELECT p.product_id, p.effective_date, p.price,
        CAST(COALESCE((SELECT SUM(quantity) FROM txn t WHERE t.product_id=p.product_id
          AND t.transaction_date >= p.effective_date AND t.transaction_date < p.until), 0)
          AS DOUBLE)/greatest(p.until-p.effective_date, 1) AS rate
      FROM m_periods p WHERE until IS NOT NULL""",
    "m_changes": """
      SELECT product_id, (price-lag(price) OVER w)/NULLIF(lag(price) OVER w,0) AS dp,
             (rate-lag(rate) OVER w)/NULLIF(lag(rate) OVER w,0) AS dq FROM m_rates
      WINDOW w AS (PARTITION BY product_id ORDER BY effective_date)""",
    "m_elasticity": """
      SELECT p.product_id, COALESCE(CASE WHEN moved >= 1e-6 AND e IS NOT NULL THEN
        least(-0.1::DOUBLE, greatest(-3.0::DOUBLE, e)) END, -1.2::DOUBLE) AS elasticity
      FROM (SELECT DISTINCT product_id FROM price) p LEFT JOIN (
        SELECT product_id, AVG(dq/NULLIF(dp,0)) AS e, SUM(abs(dp)) AS moved FROM m_changes
        GROUP BY 1) c ON p.product_id=c.product_id""",
    "m_stock": """
      SELECT product_id, CAST(SUM(stock_qty) AS BIGINT) AS stock,
             CAST(SUM(max_stock) AS BIGINT) AS max_stock, MAX(stockout_risk) AS risk
      FROM inv GROUP BY 1""",
    "m_typical": f"""
      SELECT (SELECT {R('quantile_cont(CAST(stock AS DOUBLE)/max_stock, 0.5)', 6)} FROM m_stock
              WHERE max_stock > 0) AS ratio0,
             (SELECT {R('quantile_cont(avg_daily_demand, 0.5)', 6)} FROM x_invfeat) AS demand0""",
    "m_wide": f"""
      SELECT p.*, c.comp_min, COALESCE(c.comp_avg, p.price) AS market,
        CASE WHEN p.cost_price=0 THEN p.price*0.6::DOUBLE ELSE p.cost_price END AS cost,
        COALESCE(s.stock, 0) AS stock, s.risk,
        CAST(COALESCE(s.stock,0) AS DOUBLE)/CASE WHEN s.max_stock > 0 THEN s.max_stock ELSE 500
          END AS ratio,
        COALESCE(v.velocity, y.demand0) AS velocity, y.ratio0, y.demand0,
        COALESCE(e.elasticity, -1.2::DOUBLE) AS elasticity
      FROM prod p LEFT JOIN (SELECT product_id, MIN(price) AS comp_min,
                               {MAVG('price')} AS comp_avg FROM comp GROUP BY 1) c
          ON p.product_id=c.product_id
      LEFT JOIN m_stock s ON p.product_id=s.product_id
      LEFT JOIN (SELECT product_id, {MAVG('avg_daily_demand')} AS velocity FROM x_invfeat
                 GROUP BY 1) v ON p.product_id=v.product_id
      LEFT JOIN m_elasticity e ON p.product_id=e.product_id CROSS JOIN m_typical y""",
    "m_target": """
      SELECT *, greatest(cost*1.05::DOUBLE, price*0.75::DOUBLE, least(market*(
        ((ratio0-ratio)*0.14::DOUBLE + COALESCE(risk,0)*0.08::DOUBLE
         + least(0.06::DOUBLE, greatest(-0.06::DOUBLE,
             (ln(1+velocity)-ln(1+greatest(demand0,0.1::DOUBLE)))*0.04::DOUBLE))) + 1),
        price*1.25::DOUBLE)) AS target FROM m_wide""",
    "m_dynamic": f"""
      SELECT product_id, product_name, category, {R('price')} AS current_price,
        {R('target')} AS recommended_price,
        {R(f"({R('target')}-{R('price')})/{R('price')}*100")} AS price_delta_pct,
        {R(R('price') + '*0.75::DOUBLE')} AS floor_price,
        greatest(0.5::DOUBLE, {R('delta+volume+delta*volume/100')}) AS expected_revenue_lift_pct,
        CASE WHEN ratio > 0.8 THEN 'Surplus stock (ratio ' || {R('ratio*100', 1)}
             || '% vs. population median ' || {R('ratio0*100', 1)}
             || '%). Applied markdown to accelerate inventory velocity.'
             WHEN ratio < 0.25 THEN 'Low stock alert (ratio ' || {R('ratio*100', 1)}
             || '% vs. population median ' || {R('ratio0*100', 1)}
             || '%). Applied premium markup for margin optimization.'
             ELSE 'Stock level stable. Pricing optimized against competitor average.' END
          AS rationale,
        {R('market')} AS avg_competitor_price,
        {R(f"COALESCE(comp_min, {R('market')}*0.92::DOUBLE)")} AS min_competitor_price,
        stock AS stock_level, {R('elasticity')} AS price_elasticity, {R('cost')} AS cost_price
      FROM (SELECT *, (target-price)/price*100 AS delta,
                   elasticity*((target-price)/price*100) AS volume FROM m_target)""",
    "m_daily": """
      SELECT t.product_id, p.category, t.transaction_date AS day,
             SUM(floor(t.total_amount*100::DOUBLE+0.5::DOUBLE)) AS cents, COUNT(*) AS sales
      FROM txn t JOIN prod p ON t.product_id=p.product_id GROUP BY 1,2,3""",
    "m_sums": f"""
      SELECT q.*, {_window(_OWN, _BEFORE, _CENTS)} AS own_history,
        {_window(_OWN, _DURING, _CENTS)} AS treated,
        {_window(_SISTER, _BEFORE, _CENTS)} AS sister_history,
        {_window(_SISTER, _DURING, _CENTS)} AS sister_during,
        CAST({_window('d.category=q.category', _BEFORE, 'SUM(d.sales)')} AS BIGINT)
          AS history_sales
      FROM (SELECT m.*, p.category, s.n-1 AS sisters, p.product_name,
              CASE WHEN m.end_date=m.start_date THEN 7 ELSE m.end_date-m.start_date END AS days
            FROM promo m JOIN prod p ON m.product_id=p.product_id
            JOIN (SELECT category, COUNT(*) AS n FROM prod GROUP BY 1) s
              ON p.category=s.category) q""",
    "m_did": """
      SELECT *, CASE WHEN b > 0 AND sb > 0 THEN (treated-b)/b END AS uplift_frac,
        CASE WHEN b > 0 AND sb > 0 AND treated > b THEN
          least(0.60::DOUBLE, greatest(0, sb-sister_during)/(treated-b)) END AS cannibal_rate
      FROM (SELECT *, own_history*(days/90::DOUBLE) AS b, sister_history*(days/90::DOUBLE) AS sb
            FROM m_sums)""",
    "m_curve": """
      SELECT *, CASE WHEN n_uplift >= 10 THEN s ELSE 2.2 END AS slope,
        CASE WHEN n_uplift >= 10 THEN i ELSE 0.05 END AS intercept,
        CASE WHEN n_cannibal >= 10 THEN c ELSE 0.14 END AS cannibal_rate
      FROM (SELECT COUNT(y) AS n_uplift, regr_slope(y, discount_pct) AS s,
              regr_intercept(y, discount_pct) AS i, COUNT(cannibal_rate) AS n_cannibal,
              AVG(cannibal_rate) AS c
            FROM (SELECT *, CASE WHEN uplift_frac BETWEEN -1 AND 5 THEN uplift_frac END AS y
                  FROM m_did))""",
    "m_perf1": """
      SELECT d.* EXCLUDE (cannibal_rate), v.slope, v.intercept, v.cannibal_rate AS rate0,
        CASE WHEN sister_history > 0 THEN sister_history/(greatest(sisters,1)*90.0::DOUBLE)
             ELSE 50 END AS daily
      FROM m_did d CROSS JOIN m_curve v""",
    "m_perf2": """
      SELECT *, CASE WHEN own_history > 0 THEN own_history/90 ELSE daily END*days AS base,
        CASE WHEN sisters > 0 THEN daily*sisters*days ELSE daily*5*days END AS spre FROM m_perf1""",
    "m_perf3": """
      SELECT *, CASE WHEN treated > 0 THEN treated*0.40::DOUBLE + model*0.60::DOUBLE ELSE model
        END AS pr FROM (SELECT *, base*(least(4.0::DOUBLE, greatest(0.02::DOUBLE,
          slope*discount_pct+intercept))+1) AS model FROM m_perf2)""",
    "m_perf4": """
      SELECT *, CASE WHEN sister_during > 0 THEN sister_during*0.3::DOUBLE + sm*0.7::DOUBLE
        ELSE sm END AS sdur
      FROM (SELECT *, spre - rate0*greatest(0, pr-base) AS sm FROM m_perf3)""",
    "m_gap": """
      SELECT *, (gap-AVG(gap) OVER ())/stddev_samp(gap) OVER () AS z
      FROM (SELECT p.product_id, p.product_name, p.category, p.price, c.market,
              (p.price-c.market)/c.market*100 AS gap
            FROM prod p JOIN (SELECT product_id, """ + MAVG("price") + """ AS market FROM comp
                              GROUP BY 1) c ON p.product_id=c.product_id)""",
    "m_gaps": f"""
      SELECT product_id, product_name, category, price AS our_price,
        {R('market', 6)} AS avg_competitor_price, {R('gap')} AS price_gap_pct,
        {R('z')} AS z_score,
        CASE WHEN z > 1.5 THEN 'Overpriced' WHEN z < -1.5 THEN 'Underpriced' ELSE 'Optimal' END
          AS status,
        CASE WHEN z > 1.5 THEN 'Reduce price to align with competition'
             WHEN z < -1.5 THEN 'Opportunity to raise price and gain margin'
             ELSE 'Maintain current pricing' END AS recommended_action,
        {R('''CASE WHEN z > 1.5 THEN market*1.02::DOUBLE WHEN z < -1.5 THEN market*0.98::DOUBLE
              ELSE price END''')} AS suggested_price,
        CAST(abs(z) > 1.5 AS BIGINT) AS alert_flag FROM m_gap""",
    "m_regional": """
      SELECT s.region, o.product_id,
             CAST(SUM(floor(total_amount*100::DOUBLE+0.5::DOUBLE)) AS DOUBLE) AS cents,
             COUNT(*) AS lines
      FROM ord o LEFT JOIN store s ON o.store_id=s.store_id
      WHERE o.status NOT IN ('Cancelled','Returned') GROUP BY 1,2""",
    "m_else": """
      SELECT r.region, t.product_id, h.cents IS NOT NULL AS sold_here,
             t.cents-COALESCE(h.cents,0) AS other_cents
      FROM (SELECT DISTINCT region FROM m_regional WHERE region IS NOT NULL) r
      CROSS JOIN (SELECT product_id, SUM(cents) AS cents, SUM(lines) AS lines FROM m_regional
                  GROUP BY 1) t
      LEFT JOIN m_regional h ON h.region=r.region AND h.product_id=t.product_id
      WHERE t.lines > COALESCE(h.lines,0)""",
    "m_forecast": f"""
      SELECT product_id, day, {R('m*(day*0.1::DOUBLE+1)', 1)} AS forecast_qty,
             CAST(product_id % 20 + 10 AS DOUBLE) AS mape
      FROM (SELECT product_id, CAST(SUM(q) AS DOUBLE)/COUNT(*) AS m FROM (
              SELECT product_id, SUM(quantity) AS q FROM txn GROUP BY product_id,
              transaction_date) GROUP BY 1) CROSS JOIN (SELECT unnest(range(1,8)) AS day)""",
}


def msql(body: str) -> str:
    return sql(body, EXTRA)


ORACLES = {
    "price_elasticity": msql(f"SELECT product_id, {R('elasticity', 6)} AS elasticity "
                             "FROM m_elasticity"),
    "dynamic_price": msql("SELECT * FROM m_dynamic"),
    "price_scenarios": msql(f"""
      SELECT product_id, multiplier, candidate_price, {R('delta', 4)} AS delta_pct,
        {R('volume', 4)} AS volume_pct, {R('delta+volume+delta*volume/100', 4)} AS revenue_pct,
        {R('(candidate_price-cost_price)/candidate_price*100', 4)} AS margin_pct,
        {R('(current_price-cost_price)/current_price*100', 4)} AS margin_now_pct,
        CASE WHEN candidate_price < cost_price THEN 'below cost'
             WHEN candidate_price < floor_price THEN 'below floor' ELSE 'ok' END AS margin_flag,
        CASE WHEN candidate_price <= min_competitor_price THEN 'undercuts every competitor'
             WHEN candidate_price <= avg_competitor_price THEN 'at or under market average'
             ELSE 'above market average' END AS market_flag,
        {R('(candidate_price-avg_competitor_price)/avg_competitor_price*100', 4)} AS vs_market_pct
      FROM (SELECT *, price_elasticity*delta AS volume FROM (
        SELECT *, (candidate_price-current_price)/current_price*100 AS delta FROM (
          SELECT d.*, multiplier, {R('recommended_price*multiplier')} AS candidate_price
          FROM m_dynamic d CROSS JOIN (SELECT unnest([0.8::DOUBLE,0.9::DOUBLE,1.0::DOUBLE,
            1.1::DOUBLE,1.2::DOUBLE]) AS multiplier))))"""),
    "promo_did": msql(f"""SELECT promo_id, product_id, category, days, sisters, own_history,
        treated, {R('sister_history')} AS sister_history, {R('sister_during')} AS sister_during,
        history_sales, {R('uplift_frac', 6)} AS uplift_frac,
        {R('cannibal_rate', 6)} AS cannibal_rate FROM m_did"""),
    "promo_curve": msql(f"""SELECT n_uplift, n_cannibal, {R('slope', 4)} AS slope,
        {R('intercept', 4)} AS intercept, {R('cannibal_rate', 4)} AS cannibal_rate
        FROM m_curve"""),
    "promo_performance": msql(f"""
      SELECT promo_id, promo_type || ' · ' || CAST(CAST({R('discount_pct*100', 0)} AS BIGINT)
          AS VARCHAR) || '% off · ' || target_segment AS promo_name, product_id, product_name,
        {R('base')} AS control_revenue, {R('pr')} AS treated_revenue,
        {R('greatest(base*0.08::DOUBLE, (pr-base)-(sdur-spre))')} AS incremental_revenue,
        {R(f"({R('pr')}-{R('base')})/{R('base')}*100")} AS uplift_pct,
        {R(R('''least(35.0::DOUBLE, greatest(1.5::DOUBLE, CASE WHEN sister_during > 0
              AND treated > 0 THEN (rate0*(discount_pct/0.20::DOUBLE)*0.5::DOUBLE
              + greatest(0, (spre-sdur)/greatest(1.0::DOUBLE, pr-base))*0.5::DOUBLE)*100
              ELSE rate0*(discount_pct/0.20::DOUBLE)*100 END))''') + '/100', 4)}
          AS cannibalization_rate,
        {R('''least(0.98::DOUBLE, greatest(0.65::DOUBLE, least(1.0::DOUBLE,
              ln(1+history_sales::DOUBLE)/8)*0.15::DOUBLE + 0.70::DOUBLE
              + least(days,14)/14.0::DOUBLE*0.08::DOUBLE))''')} AS confidence
      FROM m_perf4"""),
    "competitor_gaps": msql("SELECT * FROM m_gaps"),
    "competitor_kpis": msql(f"""
      SELECT COUNT(*) AS skus_monitored, COUNT(*) FILTER (WHERE alert_flag=1) AS alerts,
        {R('CAST(COUNT(*) FILTER (WHERE alert_flag=1) AS DOUBLE)/COUNT(*)*100', 1)} AS alert_pct,
        {R('CAST(COUNT(*) FILTER (WHERE price_gap_pct>0) AS DOUBLE)/COUNT(*)*100', 1)}
          AS above_pct,
        {R('CAST(COUNT(*) FILTER (WHERE price_gap_pct<=0) AS DOUBLE)/COUNT(*)*100', 1)}
          AS below_pct FROM m_gaps"""),
    "competitor_breaches": msql("SELECT * FROM m_gaps WHERE alert_flag=1 "
                                "ORDER BY abs(price_gap_pct) DESC, product_id LIMIT 8"),
    "gap_stats_latest": msql(f"""
      SELECT {R('AVG((l.ours-c.price)/c.price*100)', 6)} AS mean_gap,
             {R('stddev_samp((l.ours-c.price)/c.price*100)', 6)} AS std_gap
      FROM comp c JOIN (SELECT product_id, arg_max(price, effective_date) AS ours FROM price
                        GROUP BY 1) l ON c.product_id=l.product_id"""),
    "assortment_pareto": msql(f"""
      SELECT region, (SELECT COUNT(*) FROM prod) AS catalogue_skus, COUNT(*) AS skus_selling,
        SUM(cents)/100 AS revenue, CAST(SUM(lines) AS BIGINT) AS orders_analysed,
        COUNT(*) FILTER (WHERE running <= total*0.80::DOUBLE) AS pareto_skus,
        {R('CAST(COUNT(*) FILTER (WHERE running <= total*0.80::DOUBLE) AS DOUBLE)/COUNT(*)*100',
           1)} AS pareto_sku_pct
      FROM (SELECT *, SUM(cents) OVER (PARTITION BY region ORDER BY cents DESC, product_id
                ROWS UNBOUNDED PRECEDING) AS running,
              SUM(cents) OVER (PARTITION BY region) AS total
            FROM (SELECT * FROM m_regional WHERE region IS NOT NULL UNION ALL
                  SELECT 'All', product_id, SUM(cents), SUM(lines) FROM m_regional GROUP BY 2))
      GROUP BY 1"""),
    "assortment_candidates": msql(f"""
      SELECT c.*, p.product_name, p.category FROM (
        SELECT region, product_id, 'add' AS kind, {R('other_cents/100*0.15::DOUBLE')} AS value,
               'Not stocked in target region' AS status
        FROM (SELECT e.* FROM m_else e JOIN (
                SELECT region, {R('quantile_cont(other_cents,0.5)', 6)} AS m
                FROM m_else GROUP BY 1) k ON e.region=k.region
              WHERE NOT sold_here AND other_cents > m)
        UNION ALL
        SELECT h.region, h.product_id, 'drop',
               {R('COALESCE(i.stock,0)*COALESCE(q.price,0)')}, 'Below 25% of median SKU revenue'
        FROM m_regional h JOIN (SELECT region, {R('quantile_cont(cents,0.5)', 6)} AS m
                                FROM m_regional GROUP BY 1) k ON h.region=k.region
        LEFT JOIN m_stock i ON h.product_id=i.product_id
        LEFT JOIN prod q ON h.product_id=q.product_id WHERE h.cents < k.m*0.25::DOUBLE) c
      LEFT JOIN prod p ON c.product_id=p.product_id"""),
    "forecast_band": msql(f"""
      SELECT *, {R('greatest(0, forecast_qty-e*1.96::DOUBLE)', 1)} AS lower_bound,
             {R('forecast_qty+e*1.96::DOUBLE', 1)} AS upper_bound
      FROM (SELECT *, greatest(mape/100*forecast_qty, 0.5::DOUBLE) AS e FROM m_forecast)"""
                          ).replace("SELECT *, (floor((greatest(0",
                                    "SELECT product_id, day, forecast_qty, mape, "
                                    "(floor((greatest(0"),
    "forecast_totals": msql(f"""
      SELECT product_id, {R(MSUM('forecast_qty'), 1)} AS total_forecast,
             {R(MAVG('forecast_qty'))} AS avg_daily_demand, COUNT(*) AS days
      FROM m_forecast GROUP BY 1"""),
}
