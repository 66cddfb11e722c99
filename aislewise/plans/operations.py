"""Inventory, replenishment, slotting and delivery over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions.scalars import half_up
from aislewise.operators import features as X, models, operations as O
from aislewise.plans.catalogue import haversine_sql
from aislewise.plans.features import sql
from aislewise.plans.oracle_tables import MSUM, R
from aislewise.plans.shape import plain
from aislewise.session import stored


def _health(t):
    """Scored with the weights learnt from the positions themselves."""
    learnt = models.health_weights(_features(t), t.products, t.suppliers)  # one row, fitted once
    return O.inventory_health(t.inventory, t.transactions, t.products, t.suppliers,
                              tuple(learnt.first()))


def _features(t):
    return X.inventory_features(t.inventory, t.transactions)


def _lanes(t):
    return O.warehouse_lanes(t.shipments, t.order_stores, t.warehouses, t.stores)


def _plan(t):
    """With the z-score that the stock at risk implies."""
    z = O.service_level(t.inventory).select("z").scalar()
    return O.replenishment(t.transactions, t.products, t.suppliers, z)


def sales_velocity(t):
    return O.sales_velocity(t.transactions).withColumn(
        "daily_velocity", half_up("daily_velocity", 6))


def inventory_health(t):
    return plain(_health(t))


def inventory_kpis(t):
    return plain(O.inventory_kpis(_health(t)))


def inventory_weakest(t):
    return plain(O.inventory_weakest(_health(t), 8))


def service_level(t):
    return O.service_level(t.inventory).select(
        half_up("at_risk", 6).alias("at_risk"), half_up("target", 6).alias("target"), "z")


def abc_cutoffs(t):
    return O.abc_cutoffs(_features(t)).select(
        half_up("a_fraction", 6).alias("a_fraction"), half_up("b_fraction", 6).alias("b_fraction"))


def stock_percentiles(t):
    return O.stock_percentiles(t.inventory)


def markdown_candidates(t):
    return plain(O.markdown_candidates(_features(t), t.products, t.stores, t.warehouses, 8))


def demand_timeseries(t):
    return plain(O.demand_timeseries(t.transactions, 120))


def demand_cover(t):
    return plain(O.demand_cover(O.demand_timeseries(t.transactions, 120), t.inventory))


def replenishment(t):
    return plain(_plan(t))


def replenishment_orders(t):
    return plain(O.replenishment_orders(_plan(t), t.inventory, t.products, t.suppliers))


def abc_slotting(t):
    return plain(O.abc_slotting(t.inventory, t.movements))


def slotting_summary(t):
    return plain(O.slotting_summary(O.abc_slotting(t.inventory, t.movements)))


def warehouse_lanes(t):
    return _lanes(t)


def route_baseline(t):
    return plain(O.route_baseline(_lanes(t), t.warehouses, t.stores))


def delivery_tours(t):
    return plain(O.delivery_tours(stored(_lanes(t)), t.warehouses, t.stores))


def delivery_speed(t):
    return O.delivery_speed(t.shipments, t.warehouses, t.stores)


QUERIES = {
    "sales_velocity": sales_velocity, "inventory_health": inventory_health,
    "inventory_kpis": inventory_kpis, "inventory_weakest": inventory_weakest,
    "service_level": service_level, "abc_cutoffs": abc_cutoffs,
    "stock_percentiles": stock_percentiles, "markdown_candidates": markdown_candidates,
    "demand_timeseries": demand_timeseries, "demand_cover": demand_cover,
    "replenishment": replenishment, "replenishment_orders": replenishment_orders,
    "abc_slotting": abc_slotting, "slotting_summary": slotting_summary,
    "warehouse_lanes": warehouse_lanes, "route_baseline": route_baseline,
    "delivery_tours": delivery_tours, "delivery_speed": delivery_speed}

_KM = haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")
_SALE_KM = haversine_sql("w.latitude", "w.longitude", "s.latitude", "s.longitude")

def _squared(table: str) -> str:
    """The square of a symmetric 3 x 3 matrix, over its trace so that it stays in range."""
    cells = {f"{i}{j}": "+".join(f"{min(i, k)}{max(i, k)}*{min(k, j)}{max(k, j)}" for k in "abc")
             for i, j in ("aa", "ab", "ac", "bb", "bc", "cc")}
    return (f"SELECT {', '.join(f'{c}/(aa+bb+cc) AS {c}' for c in cells)} FROM (SELECT "
            f"{', '.join(f'{v} AS {c}' for c, v in cells.items())} FROM {table})")


#: First principal component: the covariance matrix squared ten times is its projection.
WEIGHTS = {
    "h_rows": """
      SELECT COALESCE(i.stockout_risk, 0)::DOUBLE AS a, COALESCE(i.overstock_flag, 0)::DOUBLE AS b,
             COALESCE(s.reliability_score, 0.5::DOUBLE) AS c
      FROM x_invfeat i LEFT JOIN prod p ON i.product_id=p.product_id
      LEFT JOIN sup s ON p.supplier_id=s.supplier_id""",
    "h_0": "SELECT " + ", ".join(f"covar_samp({x}, {y}) AS {x}{y}"
                                 for x, y in ("aa", "ab", "ac", "bb", "bc", "cc")) + " FROM h_rows",
    **{f"h_{k + 1}": _squared(f"h_{k}") for k in range(10)},
    "h_weights": """
      SELECT a/(a+b+c) AS w_stockout, b/(a+b+c) AS w_overstock, c/(a+b+c) AS w_reliability
      FROM (SELECT sqrt(aa) AS a, sqrt(bb) AS b, sqrt(cc) AS c FROM h_10)""",
}

EXTRA = {
    "o_health": f"""
      SELECT inventory_id, product_id, store_id, warehouse_id, location_type,
        stock_qty AS stock_level, {R('cover', 1)} AS days_cover, {R('risk', 3)} AS stockout_risk,
        {R('reliability', 3)} AS supplier_reliability, {R('score')} AS health_score,
        CASE WHEN score < 0.4 THEN 'Critical' WHEN score < 0.7 THEN 'At Risk' ELSE 'Healthy' END
          AS risk_label, over_flag AS overstock_flag
      FROM (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (1-risk)*(SELECT w_stockout FROM h_weights)
          + (1-over_flag)*(SELECT w_overstock FROM h_weights)
          + reliability*(SELECT w_reliability FROM h_weights))) AS score
        FROM (SELECT *, 1.0::DOUBLE/(exp(least(700.0::DOUBLE,(cover-reorder_point)*0.2::DOUBLE))+1)
                AS risk,
              CASE WHEN stock_qty > COALESCE(max_stock, 9999) THEN 1 ELSE 0 END AS over_flag
          FROM (SELECT i.* EXCLUDE (stockout_risk),
                  stock_qty/COALESCE(d.units/30.0::DOUBLE, 0.1::DOUBLE) AS cover,
                  COALESCE(s.reliability_score, (SELECT median(reliability_score) FROM sup))
                    AS reliability
                FROM inv i LEFT JOIN x_demand d ON i.product_id=d.product_id
                LEFT JOIN prod p ON i.product_id=p.product_id
                LEFT JOIN sup s ON p.supplier_id=s.supplier_id)))""",
    "o_series": f"""
      SELECT c.product_id, c.date, COALESCE(d.daily_qty, 0) AS qty,
        {R('''AVG(COALESCE(d.daily_qty,0)) OVER (PARTITION BY c.product_id ORDER BY c.date
              ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)''')} AS rolling_7_mean
      FROM (SELECT product_id, CAST(unnest(generate_series(l-119, l, INTERVAL 1 DAY)) AS DATE)
              AS date
            FROM (SELECT product_id, MAX(transaction_date) AS l FROM x_daily GROUP BY 1)) c
      LEFT JOIN x_daily d ON c.product_id=d.product_id AND c.date=d.transaction_date""",
    "o_plan": f"""
      SELECT product_id, CAST(trunc(demand) AS BIGINT) AS annual_demand,
        CAST(trunc(safety) AS BIGINT) AS safety_stock,
        CAST(trunc(demand/365*lead + safety) AS BIGINT) AS reorder_point,
        CAST(trunc(sqrt(demand*2*150.0::DOUBLE/holding)) AS BIGINT)
          AS recommended_order_quantity, {R('lead', 1)} AS lead_time_days
      FROM (SELECT *, std*sqrt(lead)*(SELECT z FROM o_service) AS safety FROM (
        SELECT v.product_id, greatest(1.0::DOUBLE, v.q*(365.0::DOUBLE/(SELECT
            MAX(transaction_date)-MIN(transaction_date) FROM txn))) AS demand,
          COALESCE(v.std, 1) AS std, CAST(s.lead_time_days AS DOUBLE) AS lead,
          greatest(1.0::DOUBLE, {R('p.price*0.18::DOUBLE')}) AS holding
        FROM (SELECT product_id, SUM(daily_qty) AS q, stddev_samp(daily_qty) AS std
              FROM x_daily GROUP BY 1) v
        JOIN prod p ON v.product_id=p.product_id JOIN sup s ON p.supplier_id=s.supplier_id))""",
    "o_slots": f"""
      SELECT warehouse_id, product_id, q AS total_movements, {R('pct')} AS cum_pct,
        CASE WHEN q=0 THEN 'C' WHEN pct <= 80 THEN 'A' WHEN pct <= 95 THEN 'B' ELSE 'C' END
          AS abc_class
      FROM (SELECT *, CASE WHEN SUM(q) OVER (PARTITION BY warehouse_id) > 0 THEN
              CAST(SUM(q) OVER (PARTITION BY warehouse_id ORDER BY q DESC, product_id
                   ROWS UNBOUNDED PRECEDING) AS DOUBLE)
              /CAST(SUM(q) OVER (PARTITION BY warehouse_id) AS DOUBLE)*100 ELSE 100 END AS pct
        FROM (SELECT i.warehouse_id, i.product_id, CAST(COALESCE(SUM(m.q),0) AS BIGINT) AS q
              FROM inv i LEFT JOIN (SELECT inventory_id, SUM(quantity) AS q FROM mov GROUP BY 1) m
                ON i.inventory_id=m.inventory_id
              WHERE i.warehouse_id IS NOT NULL GROUP BY 1,2))""",
    "o_busy": """
      SELECT warehouse_id, store_id, shipments FROM (
        SELECT warehouse_id, store_id, COUNT(*) AS shipments, row_number() OVER (
          PARTITION BY warehouse_id ORDER BY COUNT(*) DESC, store_id) AS n
        FROM ship WHERE store_id IS NOT NULL GROUP BY 1,2) WHERE n <= 6""",
    "o_lanes": """
      SELECT * FROM o_busy UNION ALL
      SELECT w.warehouse_id, s.store_id, 0 FROM wh w CROSS JOIN
        (SELECT store_id FROM store ORDER BY store_id LIMIT 6) s
      WHERE NOT EXISTS (SELECT 1 FROM o_busy b WHERE b.warehouse_id=w.warehouse_id)""",
    "o_points": """
      SELECT l.warehouse_id, row_number() OVER (PARTITION BY l.warehouse_id ORDER BY l.store_id)
               AS i, l.store_id, s.latitude AS lat, s.longitude AS lon
      FROM o_lanes l JOIN store s ON l.store_id=s.store_id
      UNION ALL SELECT warehouse_id, 0, NULL, latitude, longitude FROM wh""",
    "o_km": f"""
      SELECT a.warehouse_id, a.i AS f, b.i AS t, {_KM} AS km
      FROM o_points a JOIN o_points b ON a.warehouse_id=b.warehouse_id""",
    "o_base": f"""
      SELECT warehouse_id, {R('SUM(km)')} AS baseline_distance_km, COUNT(*)-1 AS stops
      FROM (SELECT k.* FROM o_km k JOIN (SELECT warehouse_id, MAX(i) AS n FROM o_points
              GROUP BY 1) m ON k.warehouse_id=m.warehouse_id
            WHERE t = CASE WHEN f=n THEN 0 ELSE f+1 END) GROUP BY 1""",
    "o_tours": f"""
      SELECT p.warehouse_id, p.path, {R('p.len + k.km', 6)} AS km,
             row_number() OVER (PARTITION BY p.warehouse_id ORDER BY {R('p.len + k.km', 6)},
                                p.path) AS r,
             row_number() OVER (PARTITION BY p.warehouse_id ORDER BY p.steps) AS nearest
      FROM (SELECT a.warehouse_id, a.n, """ + """
              [x1.t] || COALESCE(list_filter([x2.t,x3.t,x4.t,x5.t,x6.t], lambda v: v IS NOT NULL), [])
                AS path,
              list_filter([x1.km,x1.t,x2.km,x2.t,x3.km,x3.t,x4.km,x4.t,x5.km,x5.t,x6.km,x6.t],
                lambda v: v IS NOT NULL) AS steps,
              ((((x1.km + COALESCE(x2.km,0)) + COALESCE(x3.km,0)) + COALESCE(x4.km,0))
                + COALESCE(x5.km,0)) + COALESCE(x6.km,0) AS len,
              COALESCE(x6.t,x5.t,x4.t,x3.t,x2.t,x1.t) AS last
            FROM (SELECT warehouse_id, MAX(i) AS n FROM o_points GROUP BY 1) a
            JOIN o_km x1 ON x1.warehouse_id=a.warehouse_id AND x1.f=0 AND x1.t>0
            LEFT JOIN o_km x2 ON a.n>=2 AND x2.warehouse_id=a.warehouse_id AND x2.f=x1.t
              AND x2.t>0 AND x2.t<>x1.t
            LEFT JOIN o_km x3 ON a.n>=3 AND x3.warehouse_id=a.warehouse_id AND x3.f=x2.t
              AND x3.t>0 AND x3.t NOT IN (x1.t,x2.t)
            LEFT JOIN o_km x4 ON a.n>=4 AND x4.warehouse_id=a.warehouse_id AND x4.f=x3.t
              AND x4.t>0 AND x4.t NOT IN (x1.t,x2.t,x3.t)
            LEFT JOIN o_km x5 ON a.n>=5 AND x5.warehouse_id=a.warehouse_id AND x5.f=x4.t
              AND x5.t>0 AND x5.t NOT IN (x1.t,x2.t,x3.t,x4.t)
            LEFT JOIN o_km x6 ON a.n>=6 AND x6.warehouse_id=a.warehouse_id AND x6.f=x5.t
              AND x6.t>0 AND x6.t NOT IN (x1.t,x2.t,x3.t,x4.t,x5.t)) p
      JOIN o_km k ON k.warehouse_id=p.warehouse_id AND k.f=p.last AND k.t=0""",
    "o_speed": f"""
      SELECT floor({_SALE_KM}/h.hours*10000::DOUBLE+0.5::DOUBLE)/10000::DOUBLE AS speed
      FROM ship h JOIN wh w ON h.warehouse_id=w.warehouse_id JOIN store s ON h.store_id=s.store_id
      WHERE h.hours > 0 AND h.hours < 240""",
    "o_marked": """
      SELECT i.*, p.product_name, p.category, """ + R("i.stock_qty*p.price") + """ AS value
      FROM x_invfeat i JOIN prod p ON i.product_id=p.product_id
      WHERE i.stock_qty > 0 AND i.stockout_risk <= 0.10 AND i.overstock_flag=1""",
}


def osql(body: str) -> str:
    return sql(body, {**EXTRA, **WEIGHTS})


_Q = "(p - 0.5::DOUBLE)"
_CENTRE = (f"({_Q}*((((((-3.969683028665376e+01*r+2.209460984245205e+02)*r-2.759285104469687e+02)"
           "*r+1.383577518672690e+02)*r-3.066479806614716e+01)*r+2.506628277459239e+00))"
           "/(((((-5.447609879822406e+01*r+1.615858368580409e+02)*r-1.556989798598866e+02)"
           "*r+6.680131188771972e+01)*r-1.328068155288572e+01)*r+1))")
_UPPER = ("(-(((((-7.784894002430293e-03*t-3.223964580411365e-01)*t-2.400758277161838e+00)"
          "*t-2.549732539343734e+00)*t+4.374664141464968e+00)*t+2.938163982698783e+00)"
          "/((((7.784695709041462e-03*t+3.224671290700398e-01)*t+2.445134137142996e+00)"
          "*t+3.754408661907416e+00)*t+1))")

EXTRA["o_service"] = f"""
      SELECT {R('at_risk', 6)} AS at_risk, {R('p', 6)} AS target,
             {R(f'CASE WHEN p <= 0.97575 THEN {_CENTRE} ELSE {_UPPER} END', 3)} AS z
      FROM (SELECT *, {_Q}*{_Q} AS r, sqrt(-2.0::DOUBLE*ln(1.0::DOUBLE-p)) AS t FROM (
        SELECT at_risk, least(0.99::DOUBLE, greatest(0.80::DOUBLE, 1.0::DOUBLE-at_risk)) AS p
        FROM (SELECT CAST(COUNT(*) FILTER (WHERE stockout_risk > 0.7) AS DOUBLE)/COUNT(*)
                AS at_risk FROM inv)))"""

ORACLES = {
    "sales_velocity": osql(f"SELECT product_id, units AS quantity, {R('units/30.0::DOUBLE', 6)} "
                           "AS daily_velocity FROM x_demand"),
    "inventory_health": osql("SELECT * FROM o_health"),
    "inventory_kpis": osql(f"""
      SELECT CASE location_type WHEN 'store' THEN 'Store' ELSE 'Warehouse' END AS location,
        risk_label, COUNT(*) AS positions, CAST(SUM(overstock_flag) AS BIGINT) AS overstocked,
        {R('SUM(floor(health_score*100+0.5))/COUNT(*)/100', 4)} AS avg_health
      FROM o_health GROUP BY 1,2"""),
    "inventory_weakest": osql("SELECT * FROM o_health ORDER BY health_score, stockout_risk DESC, "
                              "inventory_id LIMIT 8"),
    "service_level": osql("SELECT * FROM o_service"),
    "abc_cutoffs": osql(f"""
      SELECT {R('a', 6)} AS a_fraction,
             {R('CASE WHEN b < a+0.05::DOUBLE THEN a+0.05::DOUBLE WHEN b > 0.7 THEN 0.7::DOUBLE ELSE b END', 6)}
               AS b_fraction
      FROM (SELECT least(0.40::DOUBLE, greatest(0.10::DOUBLE, CAST(COUNT(*) FILTER
                     (WHERE running < total*0.80::DOUBLE) AS DOUBLE)/COUNT(*))) AS a,
                   CAST(COUNT(*) FILTER (WHERE running < total*0.95::DOUBLE) AS DOUBLE)/COUNT(*)
                     AS b
        FROM (SELECT SUM(d) OVER (ORDER BY d DESC, inventory_id ROWS UNBOUNDED PRECEDING)
                AS running, SUM(d) OVER () AS total
              FROM (SELECT inventory_id, floor(avg_daily_demand*100+0.5) AS d FROM x_invfeat)))"""),
    "stock_percentiles": osql(f"""
      SELECT greatest(p10, 1) AS p10, greatest(p90, p10+10) AS p90 FROM (
        SELECT {R('quantile_cont(stock, 0.10)', 6)} AS p10,
               {R('quantile_cont(stock, 0.90)', 6)} AS p90
        FROM (SELECT CAST(SUM(stock_qty) AS DOUBLE) AS stock FROM inv GROUP BY product_id))"""),
    "markdown_candidates": osql(f"""
      SELECT inventory_id, product_id, product_name, category, location_name, stock, days_cover,
        stockout_risk_pct, stock_value, suggested_markdown_pct, {R('cost')} AS markdown_cost,
        {R(f"stock_value-{R('cost')}")} AS freed, overstocked_skus, capital_tied_up
      FROM (SELECT *, stock_value*suggested_markdown_pct/100 AS cost FROM (
        SELECT m.inventory_id, m.product_id, m.product_name, m.category,
          COALESCE(s.store_name, w.warehouse_name, '—') AS location_name, m.stock_qty AS stock,
          m.days_cover, m.stockout_risk*100.0::DOUBLE AS stockout_risk_pct,
          m.value AS stock_value,
          CASE WHEN days_cover >= 365 THEN 40 WHEN days_cover >= 180 THEN 30
               WHEN days_cover >= 90 THEN 20 ELSE 10 END AS suggested_markdown_pct,
          (SELECT COUNT(*) FROM o_marked) AS overstocked_skus,
          (SELECT {MSUM('value')} FROM o_marked) AS capital_tied_up
        FROM o_marked m LEFT JOIN store s ON m.store_id=s.store_id
        LEFT JOIN wh w ON m.warehouse_id=w.warehouse_id
        ORDER BY m.value DESC, m.inventory_id LIMIT 8))"""),
    "demand_timeseries": osql("SELECT product_id, strftime(date,'%Y-%m-%d') AS date, qty, "
                              "rolling_7_mean FROM o_series"),
    "demand_cover": osql(f"""
      SELECT v.product_id, COALESCE(i.stock, 0) AS current_stock, {R('v.a')} AS avg_daily_qty,
        {R('COALESCE(COALESCE(i.stock,0)/NULLIF(v.a,0), 0)', 1)} AS days_cover, v.window_days,
        v.period_start, v.period_end
      FROM (SELECT product_id, CAST(SUM(qty) AS DOUBLE)/COUNT(*) AS a, COUNT(*) AS window_days,
              strftime(MIN(date),'%Y-%m-%d') AS period_start,
              strftime(MAX(date),'%Y-%m-%d') AS period_end FROM o_series GROUP BY 1) v
      LEFT JOIN (SELECT product_id, CAST(SUM(stock_qty) AS BIGINT) AS stock FROM inv GROUP BY 1) i
        ON v.product_id=i.product_id"""),
    "replenishment": osql("SELECT * FROM o_plan"),
    "replenishment_orders": osql(f"""
      SELECT product_id, product_name, location, current_stock, max_stock, reorder_qty,
        safety_stock, rop AS reorder_point, {R('reorder_qty*cost_price')} AS estimated_cost,
        CAST(current_stock < rop AS BIGINT) AS urgency_flag, supplier_id, supplier_name,
        supplier_reliability, lead_time_days
      FROM (SELECT l.product_id, p.product_name, l.location, l.current_stock, l.max_stock,
          CAST(greatest(1, {R('o.recommended_order_quantity*share', 0)}) AS BIGINT) AS reorder_qty,
          CAST(greatest(1, {R('o.safety_stock*share', 0)}) AS BIGINT) AS safety_stock,
          CAST(greatest(1, {R('o.reorder_point*share', 0)}) AS BIGINT) AS rop, p.cost_price,
          p.supplier_id, s.name AS supplier_name, s.reliability_score AS supplier_reliability,
          o.lead_time_days
        FROM (SELECT *, CAST(max_stock AS DOUBLE)/SUM(max_stock) OVER (PARTITION BY product_id)
                AS share
              FROM (SELECT product_id, CASE WHEN store_id IS NOT NULL THEN 'store ' || store_id
                      ELSE 'warehouse ' || warehouse_id END AS location,
                      CAST(SUM(stock_qty) AS BIGINT) AS current_stock,
                      CAST(SUM(max_stock) AS BIGINT) AS max_stock FROM inv GROUP BY 1,2)) l
        JOIN o_plan o ON l.product_id=o.product_id JOIN prod p ON l.product_id=p.product_id
        LEFT JOIN sup s ON p.supplier_id=s.supplier_id)"""),
    "abc_slotting": osql("""
      SELECT *, CASE abc_class WHEN 'A' THEN 'Zone 1 (Golden Fast Pick)'
        WHEN 'B' THEN 'Zone 2 (Mid Distance)' ELSE 'Zone 3 (Far Bulk Storage)' END
        AS assigned_zone FROM o_slots"""),
    "slotting_summary": osql(f"""
      SELECT warehouse_id, abc_class, products,
        {R('CAST(products AS DOUBLE)/SUM(products) OVER w*100', 1)} AS share_pct,
        {R('moved/90.0::DOUBLE', 1)} AS daily_demand,
        {R('COALESCE(SUM(saved) OVER w/NULLIF(SUM(moved) OVER w,0), 5)', 1)}
          AS pick_time_reduction_pct
      FROM (SELECT warehouse_id, abc_class, COUNT(*) AS products,
              CAST(SUM(total_movements) AS DOUBLE) AS moved,
              SUM(total_movements*CASE abc_class WHEN 'A' THEN 25.0::DOUBLE WHEN 'B'
                  THEN 15.0::DOUBLE ELSE 5.0::DOUBLE END) AS saved FROM o_slots GROUP BY 1,2)
      WINDOW w AS (PARTITION BY warehouse_id)"""),
    "warehouse_lanes": osql("SELECT * FROM o_lanes"),
    "route_baseline": osql("SELECT * FROM o_base"),
    "delivery_tours": osql(f"""
      SELECT *, {R('greatest(0, baseline_distance_km-distance_km)')} AS distance_saved_km,
        {R(f"COALESCE({R('greatest(0, baseline_distance_km-distance_km)')}/NULLIF(baseline_distance_km,0),0)*100", 1)}
          AS saving_pct
      FROM (SELECT t.warehouse_id, len(t.path) AS stops_count,
          array_to_string(list_transform(t.path, lambda i: l.stores[i]), ' > ') AS route_order,
          {R('t.km')} AS distance_km, CAST(len(t.path) <= 12 AS BIGINT) AS exact,
          {R('q.km')} AS nearest_neighbour_distance_km, {R('t.km/50', 1)} AS estimated_time_hrs,
          CASE WHEN l.items=0 THEN 75 ELSE l.items END AS total_orders, b.baseline_distance_km
        FROM o_tours t JOIN (SELECT warehouse_id, list(store_id ORDER BY store_id) AS stores,
                               CAST(SUM(shipments) AS BIGINT) AS items FROM o_lanes GROUP BY 1) l
          ON t.warehouse_id=l.warehouse_id
        JOIN o_tours q ON t.warehouse_id=q.warehouse_id AND q.nearest=1
        JOIN o_base b ON t.warehouse_id=b.warehouse_id WHERE t.r=1)"""),
    "delivery_speed": osql(f"""
      SELECT COUNT(*) AS deliveries, CASE WHEN COUNT(*) > 10
             THEN {R('quantile_cont(speed, 0.5)', 6)} ELSE 40 END AS speed_kmh
      FROM o_speed WHERE speed > 1 AND speed < 200"""),
}
