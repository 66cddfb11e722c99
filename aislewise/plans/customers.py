"""Recommendations, offers and contact timing over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions.scalars import half_up
from aislewise.operators import customers as K, models, offers as P
from aislewise.plans.features import sql
from aislewise.plans.oracle_tables import MSUM, R
from aislewise.plans.shape import plain
from aislewise.session import stored


def _signal(t):
    """Two jobs, each written once and read by the next: signal, neighbours."""
    return stored(K.implicit_feedback(t.transactions, t.carts, t.wishlist))


def _similar(t):
    return K.similar_customers(_signal(t))


def _neighbours(t):
    signal = _signal(t)
    return signal, stored(K.similar_customers(signal))


def implicit_feedback(t):
    return plain(K.implicit_feedback(t.transactions, t.carts, t.wishlist))


def similar_customers(t):
    return plain(_similar(t).withColumn("similarity", half_up("similarity", 9)))


def category_boost(t):
    return K.category_boost(t.transactions, t.browsing, t.products).select(
        "category", half_up("rate", 6).alias("rate"), half_up("boost", 6).alias("boost"))


def cf_recommendations(t):
    boost = K.category_boost(t.transactions, t.browsing, t.products)
    return plain(K.recommendations(*_neighbours(t), t.products, t.customers, boost,
                                   t.transactions, 5))


def bestseller_fallback(t):
    """The list that each customer would fall back to; ``cf_recommendations`` uses it where it must."""
    nobody = t.customers.where("false")
    return plain(K.bestseller_fallback(t.transactions, t.products, t.customers, nobody, 5))


def recommendation_reasons(t):
    return plain(K.recommendation_reasons(*_neighbours(t), t.products, t.customers, t.reviews,
                                          t.transactions, 10))


def category_affinity(t):
    return plain(K.category_affinity(t.transactions, t.products))


def hourly_activity(t):
    return plain(K.hourly_activity(t.browsing))


def fallback_hour(t):
    return plain(K.fallback_hour(t.browsing, t.campaigns))


def send_time(t):
    return plain(K.send_time(t.customers, t.browsing, t.campaigns))


def promo_uplift(t):
    return plain(P.promo_uplift(t.promotions, t.transactions).withColumn(
        "uplift_pct", half_up("uplift_pct", 6)), "promo_id", "product_id", "treated_revenue",
        "control_revenue", "uplift_pct")


def uplift_trend(t):
    return P.uplift_trend(P.promo_uplift(t.promotions, t.transactions)).select(
        "n", half_up("slope", 4).alias("slope"), half_up("intercept", 4).alias("intercept"))


def next_best_offer(t):
    """Scored with the weights learnt from the promotions' own conversions."""
    learnt = models.nbo_weights(t.promotions, t.customers, t.transactions).first()  # one row
    return plain(P.next_best_offer(t.customers, t.promotions, t.products, t.transactions,
                                   (learnt["discount_w"], learnt["channel_w"],
                                    learnt["recency_w"])))


def segment_offers(t):
    return plain(P.segment_offers(t.customers, t.promotions, t.products, 6))


def cluster_labels(t):
    """Labels for segments in the place of clusters: the same rules on group means."""
    from aislewise.operators import features
    browses = t.browsing.where("customer_id IS NOT NULL").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("browses"))
    means = (features.rfm(t.transactions)
             .join(t.customers.select("customer_id", "segment", "region"), "customer_id")
             .join(browses, "customer_id", "left").fillna(0, ["browses"])
             .groupBy(F.concat_ws("/", "segment", "region").alias("cluster_id"))
             .agg(half_up(F.avg("recency_days"), 6).alias("avg_recency_days"),
                  half_up(F.avg("frequency"), 6).alias("avg_frequency"),
                  half_up(F.sum("monetary") / F.count(F.lit(1)), 2).alias("avg_monetary"),
                  half_up(F.sum("browses") / F.count(F.lit(1)), 6).alias("avg_browse_count")))
    return models.cluster_labels(means).select("cluster_id", "label")


QUERIES = {
    "implicit_feedback": implicit_feedback, "similar_customers": similar_customers,
    "category_boost": category_boost, "cf_recommendations": cf_recommendations,
    "bestseller_fallback": bestseller_fallback,
    "recommendation_reasons": recommendation_reasons, "category_affinity": category_affinity,
    "hourly_activity": hourly_activity, "fallback_hour": fallback_hour, "send_time": send_time,
    "promo_uplift": promo_uplift, "uplift_trend": uplift_trend,
    "next_best_offer": next_best_offer, "segment_offers": segment_offers,
    "cluster_labels": cluster_labels}

_CTR = "CAST(clicks AS DOUBLE)/NULLIF(CAST(impressions AS DOUBLE),0)"

def _newton(steps: int = models.NEWTON_STEPS) -> dict[str, str]:
    """The offer weights: Newton steps of a penalised logistic regression, one CTE a step."""
    code = {
        "n_people": """
          SELECT m.discount_pct AS d, CASE WHEN m.channel=c.preferred_channel
                   OR c.preferred_channel='Both' THEN 1 ELSE 0 END AS c,
            EXISTS (SELECT 1 FROM txn t WHERE t.product_id=m.product_id
                    AND t.customer_id=c.customer_id
                    AND t.transaction_date BETWEEN m.start_date AND m.end_date) AS hit
          FROM promo m JOIN cust c ON m.target_segment='All' OR m.target_segment=c.segment""",
        "n_cells": """
          SELECT d, c, CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y,
                 CAST(COUNT(*) AS DOUBLE) AS w FROM n_people GROUP BY ALL""",
        "n_mean": """
          SELECT SUM(w) AS n, SUM(w*y) AS yes, SUM(w*d)/SUM(w) AS dm, SUM(w*c)/SUM(w) AS cm,
            sqrt(greatest(SUM(w*d*d)/SUM(w) - (SUM(w*d)/SUM(w))**2, 0)) AS ds,
            sqrt(greatest(SUM(w*c*c)/SUM(w) - (SUM(w*c)/SUM(w))**2, 0)) AS cs FROM n_cells""",
        "n_unit": """
          SELECT y, w, (d-dm)/CASE WHEN ds=0 THEN 1 ELSE ds END AS x1,
                 (c-cm)/CASE WHEN cs=0 THEN 1 ELSE cs END AS x2 FROM n_cells CROSS JOIN n_mean""",
        "n_b0": "SELECT ln(yes/(n-yes)) AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM n_mean"}
    for k in range(steps):
        code[f"n_h{k}"] = f"""
          SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, SUM(e) AS g0,
            SUM(e*x1) - any_value(b1) AS g1, SUM(e*x2) - any_value(b2) AS g2, SUM(q) AS h00,
            SUM(q*x1) AS h01, SUM(q*x2) AS h02, SUM(q*x1*x1) + 1 AS h11, SUM(q*x1*x2) AS h12,
            SUM(q*x2*x2) + 1 AS h22
          FROM (SELECT *, w*(y-p) AS e, w*p*(1-p) AS q FROM (
            SELECT *, 1/(exp(-(b0+b1*x1+b2*x2))+1) AS p FROM n_unit CROSS JOIN n_b{k}))"""
        code[f"n_b{k + 1}"] = f"""
          SELECT b0 + (g0*(h11*h22-h12*h12) - h01*(g1*h22-h12*g2) + h02*(g1*h12-h11*g2))/det AS b0,
            b1 + (h00*(g1*h22-h12*g2) - g0*(h01*h22-h12*h02) + h02*(h01*g2-g1*h02))/det AS b1,
            b2 + (h00*(h11*g2-g1*h12) - h01*(h01*g2-g1*h02) + g0*(h01*h12-h11*h02))/det AS b2
          FROM (SELECT *, h00*(h11*h22-h12*h12) - h01*(h01*h22-h12*h02) + h02*(h01*h12-h11*h02)
                  AS det FROM n_h{k})"""
    code["n_weights"] = f"""
      SELECT CASE WHEN few THEN 50.0::DOUBLE ELSE {R(f'abs(b1)*65/(abs(b1)+abs(b2)+1e-6)', 6)} END
               AS discount_w,
             CASE WHEN few THEN 15.0::DOUBLE ELSE {R(f'abs(b2)*65/(abs(b1)+abs(b2)+1e-6)', 6)} END
               AS channel_w, 10.0::DOUBLE AS recency_w, CAST(NOT few AS BIGINT) AS learned
      FROM n_b{steps} CROSS JOIN (SELECT n < 20 OR yes < 3 OR n-yes < 3 AS few FROM n_mean)"""
    return code


EXTRA = {
    **_newton(),
    "c_signal": """
      SELECT customer_id, product_id, SUM(w) AS signal, MAX(b) AS bought FROM (
        SELECT customer_id, product_id, quantity*3.0::DOUBLE AS w, 1 AS b FROM txn
        UNION ALL SELECT customer_id, product_id, 2.0, 0 FROM cart
          WHERE status IN ('Active','Abandoned')
        UNION ALL SELECT customer_id, product_id, 1.0, 0 FROM wish) GROUP BY 1, 2""",
    "c_norm": "SELECT customer_id, sqrt(SUM(signal*signal)) AS norm FROM c_signal GROUP BY 1",
    "c_similar": """
      SELECT customer_id, neighbour_id, similarity, rank FROM (
        SELECT d.u AS customer_id, d.v AS neighbour_id, d.dot/(a.norm*b.norm) AS similarity,
               row_number() OVER (PARTITION BY d.u ORDER BY d.dot/(a.norm*b.norm) DESC, d.v)
                 AS rank
        FROM (SELECT x.customer_id AS u, y.customer_id AS v, SUM(x.signal*y.signal) AS dot
              FROM c_signal x JOIN c_signal y
                ON x.product_id=y.product_id AND x.customer_id<>y.customer_id GROUP BY 1,2) d
        JOIN c_norm a ON d.u=a.customer_id JOIN c_norm b ON d.v=b.customer_id)
      WHERE rank <= 20""",
    "c_boost": f"""
      SELECT category, rate, CASE WHEN rate/m < 0.8 THEN 0.8::DOUBLE WHEN rate/m > 2
             THEN 2.0::DOUBLE ELSE rate/m END AS boost
      FROM (SELECT category, rate, greatest(AVG(rate) OVER (), 1e-6) AS m FROM (
        SELECT COALESCE(a.category,b.category) AS category,
               CAST(COALESCE(a.n,0) AS DOUBLE)/COALESCE(b.n,1) AS rate
        FROM (SELECT p.category, COUNT(*) AS n FROM txn t JOIN prod p
              ON t.product_id=p.product_id GROUP BY 1) a
        FULL JOIN (SELECT p.category, COUNT(*) AS n FROM browse t JOIN prod p
              ON t.product_id=p.product_id GROUP BY 1) b ON a.category=b.category))""",
    "c_raw": f"""
      SELECT g.customer_id, g.product_id, {R('g.w/t.total', 6)} AS raw_score,
             g.bought_by_similar
      FROM (SELECT s.customer_id, f.product_id, SUM(s.similarity*f.signal) AS w,
                   CAST(SUM(f.bought) AS BIGINT) AS bought_by_similar
            FROM c_similar s JOIN c_signal f ON s.neighbour_id=f.customer_id GROUP BY 1,2) g
      JOIN (SELECT customer_id, SUM(similarity) AS total FROM c_similar GROUP BY 1) t
        ON g.customer_id=t.customer_id
      WHERE NOT EXISTS (SELECT 1 FROM c_signal o WHERE o.customer_id=g.customer_id
                        AND o.product_id=g.product_id)""",
    "c_ranked": "SELECT * FROM c_raw WHERE raw_score > 0",
    "c_cf": f"""
      SELECT customer_id, product_id, product_name, category, price, score, position,
        CASE WHEN category=preferred_category
             THEN 'Top choice matching your preferred style: ' || category
             ELSE printf('Trending among similar shoppers (%s converts %.2fx avg)', category,
                         boost) END AS reason
      FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id)
              AS position
        FROM (SELECT r.customer_id, r.product_id, p.product_name, p.category, p.price,
                {R('r.raw_score*COALESCE(b.boost,1)', 4)} AS score, b.boost,
                c.preferred_category
              FROM c_ranked r JOIN prod p ON r.product_id=p.product_id
              LEFT JOIN c_boost b ON p.category=b.category
              LEFT JOIN cust c ON r.customer_id=c.customer_id))
      WHERE position <= 5""",
    "c_wish": """
      SELECT w.wish, p.product_id, p.product_name, p.category, p.brand, p.price, u.units,
             row_number() OVER (PARTITION BY w.wish
               ORDER BY CASE WHEN p.category=w.wish THEN 0 ELSE 1 END, u.units DESC,
                        p.product_id) AS position
      FROM prod p JOIN (SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS units
                        FROM txn GROUP BY 1) u ON p.product_id=u.product_id
      CROSS JOIN (SELECT DISTINCT COALESCE(preferred_category,'') AS wish FROM cust) w""",
    "c_rest": """
      SELECT * FROM c_list k WHERE NOT EXISTS (
        SELECT 1 FROM c_cf f WHERE f.customer_id=k.customer_id)""",
    "c_list": """
      SELECT k.customer_id, l.product_id, l.product_name, l.category, l.price,
        CAST(l.units AS DOUBLE) AS score, l.position,
        CASE WHEN l.category=l.wish THEN 'Popular in ' || l.wish ELSE 'Trending bestseller' END
          AS reason
      FROM cust k JOIN c_wish l ON COALESCE(k.preferred_category,'')=l.wish
      WHERE l.position <= 5""",
    "c_rating": f"""
      SELECT product_id, {R('AVG(rating)', 1)} AS a, COUNT(rating) AS n FROM rev GROUP BY 1""",
    "c_seen": f"""
      SELECT *, TRUE AS personal, '{K.PERSONAL}' AS algorithm FROM (
        SELECT *, row_number() OVER (PARTITION BY customer_id
                ORDER BY bought_by_similar DESC, avg_rating DESC, product_id) AS position
        FROM (SELECT r.customer_id, r.product_id, p.product_name, p.category, p.brand, p.price,
                COALESCE(v.a,0) AS avg_rating, COALESCE(v.n,0) AS review_count,
                r.bought_by_similar
              FROM c_ranked r JOIN prod p ON r.product_id=p.product_id
              LEFT JOIN c_rating v ON r.product_id=v.product_id))
      WHERE position <= 10""",
    "c_fallback": f"""
      SELECT (SELECT CAST(trunc(median(hour(timestamp))) AS BIGINT) FROM browse) AS fallback_hour,
             (SELECT CASE WHEN m < 0.05 THEN 0.05::DOUBLE WHEN m > 0.8 THEN 0.8::DOUBLE ELSE m END
              FROM (SELECT {R(f'quantile_cont({_CTR}, 0.5)', 6)} AS m FROM camp))
               AS base_open_rate""",
    "c_uplift": f"""
      SELECT *, CASE WHEN control_revenue > 0 THEN
        (treated_revenue-control_revenue)/control_revenue*100 END AS uplift_pct
      FROM (SELECT p.*,
        COALESCE((SELECT {MSUM('total_amount')} FROM txn t WHERE t.product_id=p.product_id
          AND transaction_date BETWEEN p.start_date AND p.end_date), 0) AS treated_revenue,
        COALESCE((SELECT {MSUM('total_amount')} FROM txn t WHERE t.product_id=p.product_id
          AND transaction_date >= p.start_date - CAST(p.days AS INT)
          AND transaction_date < p.start_date), 0) AS control_revenue
        FROM (SELECT *, CASE WHEN end_date=start_date THEN 7 ELSE end_date-start_date END AS days
              FROM promo) p)""",
    "c_line": """
      SELECT COUNT(*) AS n, CASE WHEN COUNT(*) >= 10 THEN regr_slope(uplift_pct, discount_pct)
               ELSE 80 END AS slope,
             CASE WHEN COUNT(*) >= 10 THEN regr_intercept(uplift_pct, discount_pct) ELSE 5 END
               AS intercept
      FROM c_uplift WHERE uplift_pct BETWEEN -100 AND 300""",
    "c_active": """
      SELECT m.*, p.category FROM promo m LEFT JOIN prod p ON m.product_id=p.product_id
      WHERE m.is_active""",
    "c_profile": """
      SELECT DISTINCT segment, preferred_category, preferred_channel FROM cust""",
    "c_scored": f"""
      SELECT f.segment, f.preferred_category, f.preferred_channel, a.promo_id,
        floor((CASE WHEN a.category=f.preferred_category THEN 2.0::DOUBLE ELSE 0 END
          + CASE WHEN a.target_segment=f.segment THEN 1.5::DOUBLE
                 WHEN a.target_segment='All' THEN 0.5::DOUBLE ELSE 0 END
          + a.discount_pct*(SELECT discount_w FROM n_weights)
          + CASE WHEN a.channel='Both' OR a.channel=f.preferred_channel
                 THEN (SELECT channel_w FROM n_weights)
                 ELSE 0 END)*1e9::DOUBLE+0.5::DOUBLE)/1e9::DOUBLE AS score
      FROM c_profile f CROSS JOIN c_active a""",
    "c_best": """
      SELECT segment, preferred_category, preferred_channel, m AS score,
             MIN(promo_id) FILTER (WHERE score=m) AS promo_id,
             COUNT(*) FILTER (WHERE score<m)/CAST(COUNT(*) AS DOUBLE) AS below
      FROM (SELECT *, MAX(score) OVER (PARTITION BY segment, preferred_category,
                                       preferred_channel) AS m FROM c_scored)
      GROUP BY 1,2,3,4""",
    "c_means": f"""
      SELECT c.segment || '/' || c.region AS cluster_id,
             {R('AVG(recency_days)', 6)} AS rec, {R('AVG(frequency)', 6)} AS freq,
             {R('SUM(monetary)/COUNT(*)', 2)} AS mon,
             {R('CAST(SUM(COALESCE(b.n, 0)) AS DOUBLE)/COUNT(*)', 6)} AS br
      FROM x_rfm r JOIN cust c ON r.customer_id=c.customer_id
      LEFT JOIN (SELECT customer_id, COUNT(*) AS n FROM browse GROUP BY 1) b
        ON r.customer_id=b.customer_id GROUP BY 1""",
}


def csql(body: str) -> str:
    return sql(body, EXTRA)


def label_sql(means: str, more: str = "") -> str:
    """Names of clusters from a table of their means; ``more`` columns of it are kept."""
    return f"""
      SELECT cluster_id, {more} CASE WHEN n=1 THEN base
               ELSE base || ' ' || CAST(n-1 AS VARCHAR) END AS label
      FROM (SELECT cluster_id, {more} base,
                   row_number() OVER (PARTITION BY base ORDER BY cluster_id) AS n
        FROM (SELECT cluster_id, {more} CASE
            WHEN rec < 30 AND freq > mf AND mon > mm THEN 'Champions'
            WHEN rec < 30 AND freq > mf THEN 'Loyal Customers'
            WHEN rec < 30 AND mon > mm THEN 'Recent High-Value'
            WHEN rec > 90 THEN 'Lapsed' WHEN rec > 60 THEN 'At Risk'
            WHEN freq <= 1 THEN 'First-Time Buyers'
            WHEN br > mb AND mon < mm THEN 'Window Shoppers'
            WHEN mon > mm THEN 'Big Spenders' WHEN freq > mf THEN 'Frequent Buyers'
            ELSE 'Occasional Buyers' END AS base
          FROM {means} CROSS JOIN (SELECT median(freq) AS mf, median(mon) AS mm,
                                          median(br) AS mb FROM {means})))"""


def _mode(column: str) -> str:
    return (f"(SELECT segment, {column} FROM (SELECT segment, {column}, row_number() OVER "
            f"(PARTITION BY segment ORDER BY COUNT(*) DESC, {column}) AS r FROM cust "
            f"GROUP BY 1,2) WHERE r=1)")


_PCT = "(p.discount_pct*100)"
_LIFT = (f"least({R(_PCT + '''*0.35::DOUBLE*least(14.0::DOUBLE/greatest(p.end_date-p.start_date,1),
         1.5::DOUBLE) + CASE WHEN p.target_segment=s.segment THEN 6.0::DOUBLE ELSE 0 END
         + CASE WHEN p.category=c.preferred_category THEN 3.0::DOUBLE ELSE 0 END''', 1)},"
         f"{_PCT}*0.75::DOUBLE)")

ORACLES = {
    "implicit_feedback": csql("SELECT * FROM c_signal"),
    "similar_customers": csql(f"SELECT customer_id, neighbour_id, {R('similarity', 9)} AS "
                              "similarity, rank FROM c_similar"),
    "category_boost": csql(f"SELECT category, {R('rate', 6)} AS rate, {R('boost', 6)} AS boost "
                           "FROM c_boost"),
    "cf_recommendations": csql("""
      SELECT * FROM c_cf UNION ALL SELECT * FROM c_rest"""),
    "bestseller_fallback": csql("SELECT * FROM c_list"),
    "recommendation_reasons": csql(f"""
      SELECT customer_id, product_id, product_name, category, brand, price, avg_rating,
        review_count, bought_by_similar, position, CAST(personal AS BIGINT) AS is_personalized,
        algorithm, concat_ws('; ', CASE WHEN personal THEN '{K.SIMILAR_TAG}' END,
          CASE WHEN bought THEN '{K.HISTORY_TAG}' WHEN category=preferred_category
               THEN '{K.PREFERRED_TAG}' || category || ')' END,
          CASE WHEN avg_rating >= 4 AND review_count >= 5
               THEN printf('{K.RATED_TAG}', avg_rating, review_count) END,
          CASE WHEN NOT personal AND NOT bought AND category IS DISTINCT FROM preferred_category
               AND NOT (avg_rating >= 4 AND review_count >= 5) THEN '{K.POPULAR_TAG}' END)
          AS reasons
      FROM (SELECT e.*, c.preferred_category, EXISTS (SELECT 1 FROM txn t
              WHERE t.customer_id=e.customer_id AND t.product_id=e.product_id) AS bought
            FROM (SELECT * FROM c_seen UNION ALL
              SELECT k.customer_id, l.product_id, l.product_name, l.category, l.brand, l.price,
                COALESCE(v.a,0) AS avg_rating, COALESCE(v.n,0) AS review_count,
                0 AS bought_by_similar, l.position, FALSE AS personal,
                CASE WHEN NOT EXISTS (SELECT 1 FROM c_signal s WHERE s.customer_id=k.customer_id)
                     THEN '{K.COLD_START}'
                     WHEN NOT EXISTS (SELECT 1 FROM c_similar s WHERE s.customer_id=k.customer_id)
                     THEN '{K.NO_NEIGHBOUR}' ELSE '{K.NO_CANDIDATE}' END AS algorithm
              FROM cust k JOIN c_wish l ON COALESCE(k.preferred_category,'')=l.wish
              LEFT JOIN c_rating v ON l.product_id=v.product_id
              WHERE l.position <= 10 AND NOT EXISTS (
                SELECT 1 FROM c_seen s WHERE s.customer_id=k.customer_id)) e
            LEFT JOIN cust c ON e.customer_id=c.customer_id)"""),
    "category_affinity": csql(f"""
      SELECT customer_id, category, units_purchased,
        {R('units_purchased/SUM(units_purchased) OVER (PARTITION BY customer_id)*100', 1)}
          AS purchase_pct
      FROM (SELECT t.customer_id, p.category, CAST(SUM(t.quantity) AS BIGINT) AS units_purchased
            FROM txn t JOIN prod p ON t.product_id=p.product_id GROUP BY 1,2)"""),
    "hourly_activity": csql(f"""
      SELECT customer_id, hour, events,
        {R('CAST(events AS DOUBLE)/SUM(events) OVER (PARTITION BY customer_id)', 6)} AS share
      FROM (SELECT customer_id, hour(timestamp) AS hour, COUNT(*) AS events
            FROM browse GROUP BY 1,2)"""),
    "fallback_hour": csql("SELECT * FROM c_fallback"),
    "send_time": csql(f"""
      SELECT customer_id, channel, best_day, best_hour, events, CAST(opted AS BIGINT) AS opted_in,
        {R('CASE WHEN rate < 0.03 THEN 0.03::DOUBLE WHEN rate > 0.85 THEN 0.85::DOUBLE ELSE rate END', 4)}
          AS open_rate
      FROM (SELECT *, CASE WHEN opted THEN base ELSE base*0.15::DOUBLE END AS rate
        FROM (SELECT c.customer_id, c.preferred_channel AS channel,
            COALESCE(d.day, 'Saturday') AS best_day, COALESCE(h.hour, f.fallback_hour) AS best_hour,
            COALESCE(e.n, 0) AS events,
            CASE c.preferred_channel WHEN 'Email' THEN c.email_opt_in WHEN 'SMS'
              THEN c.sms_opt_in WHEN 'Push Notification' THEN c.app_installed ELSE TRUE END
              AS opted,
            f.base_open_rate*(0.55::DOUBLE + COALESCE(e.pct,0)*0.30::DOUBLE
              + CASE WHEN c.shopping_frequency/12 > 1 THEN 1.0::DOUBLE
                     ELSE c.shopping_frequency/12 END*0.15::DOUBLE) AS base
          FROM cust c CROSS JOIN c_fallback f
          LEFT JOIN (SELECT customer_id, n, cume_dist() OVER (ORDER BY n) AS pct FROM
                     (SELECT customer_id, COUNT(*) AS n FROM browse GROUP BY 1)) e
            ON c.customer_id=e.customer_id
          LEFT JOIN (SELECT customer_id, hour FROM (SELECT customer_id, hour(timestamp) AS hour,
                       row_number() OVER (PARTITION BY customer_id
                         ORDER BY COUNT(*) DESC, hour(timestamp)) AS r
                     FROM browse GROUP BY 1,2) WHERE r=1) h ON c.customer_id=h.customer_id
          LEFT JOIN (SELECT customer_id, day FROM (SELECT customer_id, dayname(timestamp) AS day,
                       row_number() OVER (PARTITION BY customer_id
                         ORDER BY COUNT(*) DESC, isodow(timestamp)) AS r
                     FROM browse GROUP BY customer_id, dayname(timestamp), isodow(timestamp))
                     WHERE r=1) d ON c.customer_id=d.customer_id))"""),
    "promo_uplift": csql(f"SELECT promo_id, product_id, treated_revenue, control_revenue, "
                         f"{R('uplift_pct', 6)} AS uplift_pct FROM c_uplift"),
    "uplift_trend": csql(f"SELECT n, {R('slope', 4)} AS slope, {R('intercept', 4)} AS intercept "
                         "FROM c_line"),
    "next_best_offer": csql(f"""
      SELECT c.customer_id, b.promo_id, u.promo_type, u.product_id,
        CAST(CAST(trunc(u.discount_pct*100) AS BIGINT) AS VARCHAR) || '%' AS discount,
        {R('''b.score + 1.0::DOUBLE/(greatest(COALESCE((SELECT MAX(transaction_date) FROM txn)
              - l.last, 90), 0)/30.0::DOUBLE + 1)*10
            + CASE c.loyalty_tier WHEN 'Bronze' THEN 0 WHEN 'Gold' THEN 0.67::DOUBLE
                   WHEN 'Platinum' THEN 1 ELSE 0.33::DOUBLE END*0.5::DOUBLE''', 4)} AS score,
        {R('''CASE WHEN b.below*0.40::DOUBLE+0.55::DOUBLE > 0.95 THEN 0.95::DOUBLE
              ELSE b.below*0.40::DOUBLE+0.55::DOUBLE END''')} AS confidence,
        {R('''CASE WHEN u.control_revenue > 0 THEN least(95.0::DOUBLE, greatest(5.0::DOUBLE,
              u.uplift_pct)) ELSE least(95.0::DOUBLE, greatest(5.0::DOUBLE,
              n.intercept + n.slope*u.discount_pct)) END''', 1)} AS uplift_pct
      FROM cust c JOIN c_best b ON c.segment=b.segment
        AND c.preferred_category=b.preferred_category
        AND c.preferred_channel=b.preferred_channel
      LEFT JOIN (SELECT customer_id, MAX(transaction_date) AS last FROM txn GROUP BY 1) l
        ON c.customer_id=l.customer_id
      JOIN c_uplift u ON b.promo_id=u.promo_id CROSS JOIN c_line n"""),
    "segment_offers": csql(f"""
      SELECT segment, segment_size, preferred_category, preferred_channel, position, promo_id,
        promo_type, category, discount_pct, target_segment, on_target, predicted_uplift_pct
      FROM (SELECT s.segment, s.n AS segment_size, c.preferred_category, h.preferred_channel,
          p.promo_id, p.promo_type, p.category, {R(_PCT, 1)} AS discount_pct, p.target_segment,
          CAST(p.target_segment=s.segment AS BIGINT) AS on_target,
          {R(R(_LIFT, 6), 1)} AS predicted_uplift_pct,
          row_number() OVER (PARTITION BY s.segment ORDER BY {R(_LIFT, 6)} DESC, p.promo_id)
            AS position
        FROM (SELECT segment, COUNT(*) AS n FROM cust GROUP BY 1) s
        JOIN {_mode('preferred_category')} c ON s.segment=c.segment
        JOIN {_mode('preferred_channel')} h ON s.segment=h.segment
        CROSS JOIN c_active p) WHERE position <= 6"""),
    "cluster_labels": csql(label_sql("c_means")),
}
