"""Learned operators over the given tables, at the operators' own settings."""

from __future__ import annotations

from aislewise.operators import features as X, merchandising as M, models as L
from aislewise.plans.customers import csql, label_sql
from aislewise.plans.features import calendar, sql
from aislewise.plans.operations import WEIGHTS
from aislewise.plans.oracle_tables import MAVG, R
from aislewise.plans.shape import plain
from aislewise.session import stored
from aislewise.functions.scalars import half_up

STOP = ["the", "and", "of", "is", "in", "it", "on", "le", "la", "de", "und", "der", "die"]
AUDIENCE_KS = range(3, 13)


def _daily(t):
    return X.daily_sales(t.transactions, calendar(t))


def _training(t, daily=None):
    """Written once: the trainer, the error table and the split all read it."""
    return stored(L.forecast_training(X.daily_sales_lags(daily or _daily(t)), t.products))


def _audience(t):
    return X.customer_features(t.customers, t.transactions, t.browsing, t.wishlist, t.carts,
                               t.reviews, encode=())


def forecast_training(t):
    return plain(_training(t).withColumns({c: half_up(c, 6) for c in (
        "rolling_7_mean", "rolling_30_mean", "product_avg_qty", "category_avg_qty")}),
        "product_id", "transaction_date", "daily_qty", *L.FEATURES, "is_train")


def forecast_model(t):
    training = _training(t)
    return L.forecast_errors(training, L.saved_forecast_model(training))


def _demand(t):
    daily = stored(_daily(t))
    training = _training(t, daily)
    model = L.saved_forecast_model(training)
    return L.demand_forecast(daily, t.products, model, L.forecast_errors(training, model),
                             horizon=7)


def demand_forecast(t):
    return plain(_demand(t))


def demand_band(t):
    """The band around the fitted forecast, from the model's own held-out error."""
    return plain(M.forecast_band(_demand(t)))


def demand_totals(t):
    return plain(M.forecast_totals(_demand(t)))


def nbo_weights(t):
    return plain(L.nbo_weights(t.promotions, t.customers, t.transactions))


def offer_conversions(t):
    return plain(L.offer_conversions(t.promotions, t.customers, t.transactions))


def audience_k(t):
    return plain(L.audience_k(_audience(t))[0])


def _clusters(t):
    """One fit of every k, cut at the elbow."""
    model = L.AudienceModel(_audience(t), AUDIENCE_KS)
    return model.clusters(L.audience_table(model, AUDIENCE_KS)[1])


def audience_clusters(t):
    labelled = L.cluster_labels(L.cluster_means(_clusters(t)))
    return plain(labelled.withColumns({c: half_up(c, 6) for c in (
        "avg_recency_days", "avg_frequency", "avg_monetary", "avg_browse_count")}))


def audience_members(t):
    return plain(_clusters(t), "customer_id", "cluster_id")


def health_weights(t):
    learnt = L.health_weights(X.inventory_features(t.inventory, t.transactions), t.products,
                              t.suppliers)
    return learnt.select(*[half_up(c, 6).alias(c) for c in learnt.columns])


def ticket_model(t):
    return L.TicketModel(t.tickets, stop_words=STOP).accuracy(t.tickets)


def ticket_triage(t):
    return L.TicketModel(t.tickets, stop_words=STOP).triage(t.tickets)


QUERIES = {
    "forecast_training": forecast_training, "forecast_model": forecast_model,
    "demand_forecast": demand_forecast, "demand_band": demand_band,
    "demand_totals": demand_totals, "offer_conversions": offer_conversions,
    "nbo_weights": nbo_weights, "audience_k": audience_k, "audience_clusters": audience_clusters,
    "audience_members": audience_members,
    "health_weights": health_weights, "ticket_model": ticket_model,
    "ticket_triage": ticket_triage}

EXTRA = {
    "l_train": """
      SELECT d.product_id, d.transaction_date, d.daily_qty, d.lag_7, d.lag_14, d.r7, d.r30,
        isodow(d.transaction_date)-1 AS dow_num, month(d.transaction_date) AS month,
        day(d.transaction_date) AS day_of_month, week(d.transaction_date) AS week_number,
        quarter(d.transaction_date) AS quarter, COALESCE(c.is_holiday,0) AS is_holiday,
        COALESCE(c.is_weekend,0) AS is_weekend, COALESCE(c.is_sale_season,0) AS is_sale_season,
        a.m AS pavg, b.m AS cavg
      FROM (SELECT *, lag(daily_qty,7) OVER w AS lag_7, lag(daily_qty,14) OVER w AS lag_14,
              AVG(daily_qty) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS r7,
              AVG(daily_qty) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS r30
            FROM x_daily WINDOW w AS (PARTITION BY product_id ORDER BY transaction_date)) d
      JOIN prod p ON d.product_id=p.product_id
      JOIN (SELECT product_id, AVG(daily_qty) AS m FROM x_daily GROUP BY 1) a
        ON d.product_id=a.product_id
      JOIN (SELECT p.category, AVG(daily_qty) AS m FROM x_daily x JOIN prod p
              ON x.product_id=p.product_id GROUP BY 1) b ON p.category=b.category
      LEFT JOIN x_calendar c ON d.transaction_date=c.date WHERE d.lag_14 IS NOT NULL""",
    "l_people": """
      SELECT m.promo_id, m.discount_pct, c.customer_id,
        CASE WHEN m.channel=c.preferred_channel OR c.preferred_channel='Both'
             THEN 1 ELSE 0 END AS ch_match,
        EXISTS (SELECT 1 FROM txn t WHERE t.product_id=m.product_id
                AND t.customer_id=c.customer_id
                AND t.transaction_date BETWEEN m.start_date AND m.end_date) AS hit
      FROM promo m JOIN cust c ON m.target_segment='All' OR m.target_segment=c.segment""",
}


def _lloyd() -> dict[str, str]:
    """The audience fits: whole-number coordinates, rank parts as seeds, steps by recursion."""
    raw = ["COALESCE(r.recency_days,0)", "COALESCE(r.frequency,0)", "COALESCE(r.monetary,0)",
           "COALESCE(r.avg_order_val,0)", "COALESCE(b.n,0)", "COALESCE(w.n,0)",
           "COALESCE(k.n,0)"]
    axes = range(len(raw))

    def each(pattern: str, glue: str = ", ") -> str:
        return glue.join(pattern.replace("#", str(i)) for i in axes)

    def floored(total: str, n: str) -> str:
        return f"CAST(({total} - (({total} % {n}) + {n}) % {n}) // {n} AS BIGINT)"

    live = "(SELECT * FROM lloyd WHERE NOT done AND step < 100)"
    counted = "(SELECT customer_id, COUNT(*) AS n FROM {} GROUP BY 1)"
    return {
        "a_x": f"""
      SELECT c.customer_id, {", ".join(
          f"CAST(floor(({x})*100::DOUBLE+0.5::DOUBLE) AS BIGINT) AS x{i}"
          for i, x in enumerate(raw))},
        {raw[0]} AS recency_days, {raw[1]} AS frequency, {raw[2]} AS monetary, {raw[4]} AS browses
      FROM cust c LEFT JOIN x_rfm r ON c.customer_id=r.customer_id
      LEFT JOIN {counted.format("browse")} b ON c.customer_id=b.customer_id
      LEFT JOIN {counted.format("wish")} w ON c.customer_id=w.customer_id
      LEFT JOIN {counted.format("cart")} k ON c.customer_id=k.customer_id""",
        "a_m": "SELECT COUNT(*) AS n, " + each(
            "CAST(SUM(x#) AS DOUBLE) AS s#, CAST(COUNT(*)*SUM(CAST(x# AS HUGEINT)*x#)"
            "-SUM(x#)*SUM(x#) AS DOUBLE) AS v#") + " FROM a_x",
        "a_z": "SELECT x.*, n, " + each(
            "CASE WHEN v#<=0 THEN 0::BIGINT ELSE CAST(floor((x#-s#/n)/sqrt(v#/n/(n-1))"
            "*1000::DOUBLE+0.5::DOUBLE) AS BIGINT) END AS z#")
            + " FROM a_x x CROSS JOIN a_m",
        "a_seed": f"""
      SELECT k, part AS i, {each(floored("SUM(z#)", "COUNT(*)") + " AS c#")}
      FROM (SELECT k.k, z.*, (place-1)*k.k//n AS part
            FROM (SELECT *, row_number() OVER (ORDER BY {each("z#", "+")}, customer_id) AS place
                  FROM a_z) z
            JOIN (SELECT unnest(range(3, 13)) AS k) k ON k.k <= z.n) GROUP BY 1, 2""",
        "a_fit": f"""
      WITH RECURSIVE lloyd(step, k, centres, cost, done) AS (
        SELECT 0, k, list({{'i': CAST(i AS BIGINT), {each("'c#': c#")}}} ORDER BY i), 0::BIGINT, false
        FROM a_seed GROUP BY k
        UNION ALL
        SELECT f.step+1, f.k, g.centres, g.cost, g.centres = f.centres
        FROM {live} f JOIN (
          SELECT k, list({{'i': i, {each("'c#': c#")}}} ORDER BY i) AS centres,
                 CAST(SUM(cost) AS BIGINT) AS cost
          FROM (SELECT o.k, o.c.i AS i, COALESCE(a.cost, 0) AS cost, {each(
              "COALESCE(" + floored("a.s#", "a.n") + ", o.c.c#) AS c#")}
            FROM (SELECT k, unnest(centres) AS c FROM {live}) o
            LEFT JOIN (
              SELECT k, best.i AS i, COUNT(*) AS n, SUM(best.d) AS cost, {each("SUM(z#) AS s#")}
              FROM (SELECT o.k, p.customer_id, {each("any_value(p.z#) AS z#")},
                      min({{'d': {each("(p.z#-o.c.c#)*(p.z#-o.c.c#)", "+")}, 'i': o.c.i}}) AS best
                    FROM (SELECT k, unnest(centres) AS c FROM {live}) o CROSS JOIN a_z p
                    GROUP BY 1, 2) GROUP BY 1, 2) a ON a.k = o.k AND a.i = o.c.i)
          GROUP BY k) g ON f.k = g.k)
      SELECT k, arg_max(centres, step) AS centres, max(step) AS steps, bool_or(done) AS converged,
             CAST(arg_max(cost, step) AS DOUBLE)/1000000::DOUBLE AS cost
      FROM lloyd WHERE step > 0 GROUP BY k""",
        "a_chosen": """
      SELECT CASE WHEN COUNT(*) < 2 OR max(spread) < 1e-6::DOUBLE THEN 8
                  ELSE COALESCE(MIN(k) FILTER (WHERE drop_/spread < 0.05::DOUBLE), MAX(k)) END AS k
      FROM (SELECT k, lag(cost) OVER (ORDER BY k)-cost AS drop_,
                   first(cost) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING
                                     AND UNBOUNDED FOLLOWING)
                   - last(cost) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING
                                      AND UNBOUNDED FOLLOWING) AS spread FROM a_fit)""",
        "a_member": f"""
      SELECT p.customer_id, any_value(p.recency_days) AS recency_days,
             any_value(p.frequency) AS frequency, any_value(p.monetary) AS monetary,
             any_value(p.browses) AS browses,
             min({{'d': {each("(p.z#-o.c.c#)*(p.z#-o.c.c#)", "+")}, 'i': o.c.i}}).i AS cluster_id
      FROM (SELECT unnest(centres) AS c FROM a_fit WHERE k = (SELECT k FROM a_chosen)) o
      CROSS JOIN a_z p GROUP BY 1""",
        "a_means": f"""
      SELECT cluster_id, COUNT(*) AS customers, AVG(recency_days) AS rec, AVG(frequency) AS freq,
             {MAVG("monetary")} AS mon, AVG(browses) AS br,
             {R("AVG(recency_days)", 6)} AS avg_recency_days, {R("AVG(frequency)", 6)}
               AS avg_frequency, {R(MAVG("monetary"), 6)} AS avg_monetary,
             {R("AVG(browses)", 6)} AS avg_browse_count
      FROM a_member GROUP BY 1"""}


EXTRA.update(_lloyd())

ORACLES = {
    "audience_k": sql("""
      SELECT CAST(g.k AS BIGINT) AS k, f.cost, CAST(f.steps AS BIGINT) AS steps,
             CAST(f.converged AS BIGINT) AS converged, CAST(g.k = c.k AS BIGINT) AS is_chosen,
             CAST(f.k IS NOT NULL AS BIGINT) AS fitted
      FROM (SELECT unnest(range(3, 13)) AS k) g CROSS JOIN a_chosen c
      LEFT JOIN a_fit f ON f.k = g.k""", EXTRA),
    "audience_clusters": sql(label_sql(
        "a_means", "customers, avg_recency_days, avg_frequency, avg_monetary, avg_browse_count,"),
        EXTRA),
    "audience_members": sql("SELECT customer_id, cluster_id FROM a_member", EXTRA),
    "nbo_weights": csql("SELECT * FROM n_weights"),
    "health_weights": sql("SELECT " + ", ".join(f"{R(c, 6)} AS {c}" for c in (
        "w_stockout", "w_overstock", "w_reliability")) + " FROM h_weights", WEIGHTS),
    "forecast_training": sql(f"""
      SELECT product_id, strftime(transaction_date,'%Y-%m-%d') AS transaction_date, daily_qty,
        lag_7, lag_14, {R('r7', 6)} AS rolling_7_mean, {R('r30', 6)} AS rolling_30_mean, dow_num,
        month, day_of_month, week_number, quarter, is_holiday, is_weekend, is_sale_season,
        {R('pavg', 6)} AS product_avg_qty, {R('cavg', 6)} AS category_avg_qty,
        CAST(transaction_date - DATE '1970-01-01' <= (SELECT {R('''quantile_cont(CAST(
          transaction_date - DATE '1970-01-01' AS DOUBLE), 0.85)''', 6)} FROM l_train) AS BIGINT)
          AS is_train FROM l_train""", EXTRA),
    "offer_conversions": sql("""
      SELECT discount_pct, ch_match, CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
             CAST(COUNT(*) AS DOUBLE) AS weight FROM l_people GROUP BY 1,2,3""", EXTRA),
}
