"""Learned operators, trained with the distributed ML library.

Only model coefficients and one-row aggregates come to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import reduce
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (IDF, ElementwiseProduct, HashingTF, Normalizer, RegexTokenizer,
                                StopWordsRemover, StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from aislewise.functions.distributed import exact_quantiles, running_total
from aislewise.functions.scalars import contains_any, half_up, money_mean
from aislewise.operators.features import HOLIDAYS, holiday_name, sale_season
from aislewise.operators.offers import month_bin
from aislewise.operators.text import TOKEN, default_stop_words
from aislewise.session import (ensure_checkpoint_dir, move_path, own_folder, path_exists, ship,
                               stored)

# ── demand forecasting ──────────────────────────────────────────────────────

# The names of the model's columns.
FEATURES = ["lag_7", "lag_14", "rolling_7_mean", "rolling_30_mean", "dow_num", "month",
            "day_of_month", "week_number", "quarter", "is_holiday", "is_weekend",
            "is_sale_season", "product_avg_qty", "category_avg_qty"]


def forecast_training(daily_lags: DataFrame, products: DataFrame,
                      train_share: float = 0.85) -> DataFrame:
    """Model rows with both mean levels, split at a date: earlier days train.

    A category's level reaches the rows through its products, so the rows, of which a category
    holds a large share, are dealt by product alone.
    """
    kinds = products.select("product_id", "category")
    rows = daily_lags.join(kinds.hint("merge"), "product_id", "left")

    def flag(c: str) -> Column:
        return F.coalesce(F.col(c).cast("int"), F.lit(0))

    per_product = rows.groupBy("product_id").agg(
        F.sum("daily_qty").alias("_q"), F.count(F.lit(1)).alias("_n"),
        F.first("category").alias("category"))
    per_category = per_product.groupBy("category").agg(
        (F.sum("_q") / F.sum("_n")).alias("category_avg_qty"))
    levelled = kinds.join(per_category, "category", "left").select(
        "product_id", "category", "category_avg_qty")
    rows = (daily_lags.join(levelled.hint("merge"), "product_id", "left")
            .join(per_product.select("product_id", (F.col("_q") / F.col("_n"))
                                     .alias("product_avg_qty")).hint("merge"), "product_id")
            .select("category", "product_id", *[c for c in daily_lags.columns if c != "product_id"],
                    "product_avg_qty", "category_avg_qty")
            .withColumns({"dow_num": F.weekday("transaction_date"),
                          **{c: flag(c) for c in ("is_holiday", "is_weekend", "is_sale_season")}})
            .dropna(subset=[*FEATURES, "daily_qty"]))
    cut = exact_quantiles(rows.select(F.unix_date("transaction_date").alias("d")), "d",
                          {"cut": train_share}).scalar()
    return rows.withColumn("is_train", F.unix_date("transaction_date") <= cut)


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


ROWS_A_TASK = 25_000   # of a trainer's pass, a few milliseconds
MOST_ROWS = 250_000    # of a task where there are more tasks than cores


def fit_forecast_model(training: DataFrame, trees: int = 250, depth: int = 5,
                       rate: float = 0.06, subsample: float = 0.8, columns: float = 0.8,
                       seed: int = 42) -> GBTRegressionModel:
    """One boosted-tree model over all products, on the training days only.

    Rows are dealt by product and sorted, so that the sampled rows are the same at every run with
    the same number of partitions. A tree is a dozen short jobs, each with two tasks a partition, so
    there are no more partitions than ``ROWS_A_TASK`` asks for, and one a core unless they got more
    than ``MOST_ROWS`` then. ``columns`` is the share of features tried at a split.
    """
    ensure_checkpoint_dir(training.sparkSession)  # the trainer cuts its lineage there
    booster = GBTRegressor(featuresCol="features", labelCol="daily_qty", maxIter=trees,
                           maxDepth=depth, stepSize=rate, subsamplingRate=subsample,
                           featureSubsetStrategy=str(columns), seed=seed)
    train, spark = training.where("is_train"), training.sparkSession
    size = train.count()
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                max(1, -(-size // MOST_ROWS), min(-(-size // ROWS_A_TASK),
                                                  spark.sparkContext.defaultParallelism)))
    rows = (_assembled(train).repartition(parts, "product_id")
            .sortWithinPartitions("product_id", "transaction_date").select("features", "daily_qty")
            .persist(StorageLevel.MEMORY_AND_DISK))  # the trainer passes over it several times
    try:
        return booster.fit(rows)
    finally:
        rows.unpersist()


def content_key(df: DataFrame) -> str:
    """Key of a table's rows, whatever their order and partitions: their number and the exact sum
    of their hashes, with the schema."""
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    text = f"{df.schema.json()}|{row['n']}|{row['h']}"
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def saved_forecast_model(training: DataFrame, folder: str | None = None,
                         **settings) -> GBTRegressionModel:
    """The model of these rows and settings: read where it was written before, else fitted and
    written, so that every caller shares one fit.

    Models lie in ``folder``; unset, in the application's own folder, which goes when it ends. Other
    rows or settings have another key. A model is renamed into place once whole.
    """
    spark = training.sparkSession
    named = hashlib.sha256(repr(sorted(settings.items())).encode()).hexdigest()[:8]
    path = f"{folder or own_folder(spark)}/forecast-{content_key(training)}-{named}"
    if not path_exists(spark, path):
        part = f"{path}-{uuid4().hex}"
        fit_forecast_model(training, **settings).write().save(part)
        move_path(spark, part, path)
    return GBTRegressionModel.load(path)


def forecast_errors(training: DataFrame, model: GBTRegressionModel,
                    min_rows: int = 5) -> DataFrame:
    """MAE and MAPE on the held-out days: overall (null id), and per product with enough rows."""
    tested = model.transform(_assembled(training.where("NOT is_train"))).select(
        "product_id", F.abs(F.col("daily_qty") - F.greatest("prediction", F.lit(0.0)))
        .alias("miss"), F.greatest("daily_qty", F.lit(1)).alias("scale"))
    return (tested.groupingSets([["product_id"], []], "product_id")
            .agg(F.count(F.lit(1)).alias("test_rows"), F.avg("miss").alias("mae"),
                 (F.avg(F.col("miss") / F.col("scale")) * 100).alias("mape"),
                 F.grouping("product_id").alias("_all"))
            .where((F.col("_all") == 1) | (F.col("test_rows") >= min_rows)).drop("_all"))


def demand_forecast(daily: DataFrame, products: DataFrame,
                    model: GBTRegressionModel, errors: DataFrame, horizon: int = 7,
                    holidays: Sequence[tuple[int, int, str]] = HOLIDAYS,
                    checkpoint_every: int = 10) -> DataFrame:
    """Recursive forecast of every product: each predicted day feeds the next day's lags.

    A product's last 30 selling days ride in its row as an array, so a step is one map
    over the products. Products that never sold get their category's mean.
    """
    newest = Window.partitionBy("product_id").orderBy(F.desc("transaction_date"))
    recent = (daily.select("product_id", "transaction_date", "daily_qty")
              .withColumn("_n", F.row_number().over(newest)).where("_n <= 30")
              .groupBy("product_id")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct(
                  "transaction_date", F.col("daily_qty").cast("double").alias("q")))),
                  lambda e: e["q"]).alias("recent"),
                  F.max("transaction_date").alias("last_date")))
    levels = daily.groupBy("product_id").agg(F.sum("daily_qty").alias("_q"),
                                             F.count(F.lit(1)).alias("_n"))
    described = products.select("product_id", "category").join(levels, "product_id", "left")
    per_category = described.groupBy("category").agg(
        (F.sum("_q") / F.sum("_n")).alias("category_avg_qty"))
    overall = daily.agg(F.avg("daily_qty").alias("m")).scalar()
    state = (described.join(per_category, "category", "left").join(recent, "product_id", "left")
             .withColumn("_overall", overall)
             .select("product_id", "last_date", "recent",
                     (F.col("_q") / F.col("_n")).alias("product_avg_qty"),
                     F.coalesce("category_avg_qty", "_overall").alias("category_avg_qty"),
                     F.array().cast("array<double>").alias("forecast")))
    sold = state.where("last_date IS NOT NULL")
    size = F.size("recent")

    def back(k: int) -> Column:
        return F.when(size >= k, F.element_at("recent", -k)).otherwise(F.element_at("recent", -1))

    def mean_of_last(k: int) -> Column:
        tail = F.slice("recent", F.greatest(size - (k - 1), F.lit(1)), F.lit(k))
        return F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.least(size, F.lit(k))

    kept = sold.columns
    for step in range(1, horizon + 1):
        rows = sold.withColumn("_day", F.date_add("last_date", step)).withColumns({
            "lag_7": back(7), "lag_14": back(14), "rolling_7_mean": mean_of_last(7),
            "rolling_30_mean": mean_of_last(30), "dow_num": F.weekday("_day"),
            "month": F.month("_day"), "day_of_month": F.dayofmonth("_day"),
            "week_number": F.weekofyear("_day"), "quarter": F.quarter("_day"),
            "is_holiday": holiday_name("_day", holidays).isNotNull().cast("int"),
            "is_weekend": (F.weekday("_day") >= 5).cast("int"),
            "is_sale_season": sale_season("_day").cast("int")})
        predicted = model.transform(_assembled(rows)).withColumn(
            "_p", F.greatest("prediction", F.lit(0.0)))
        sold = predicted.withColumns({
            "recent": F.concat(F.slice("recent", F.greatest(size - 28, F.lit(1)), F.lit(29)),
                               F.array("_p")),
            "forecast": F.concat("forecast", F.array("_p"))}).select(*kept)
        if step % checkpoint_every == 0 and step < horizon:
            ensure_checkpoint_dir(sold.sparkSession)
            sold = sold.checkpoint()
    unsold = state.where("last_date IS NULL").withColumn(
        "forecast", F.array_repeat("category_avg_qty", horizon))
    own = errors.where("product_id IS NOT NULL").select("product_id", F.col("mape").alias("own"))
    general = errors.where("product_id IS NULL").select("mape").scalar()
    days = sold.unionByName(unsold).select(
        "product_id", "last_date", F.posexplode("forecast").alias("_i", "_q"))
    return (days.join(own, "product_id", "left").withColumn("_general", general).select(
        "product_id", (F.col("_i") + 1).alias("day"),
        F.expr("date_add(last_date, _i + 1)").alias("date"),
        half_up("_q", 1).alias("forecast_qty"),
        half_up(F.when(F.col("last_date").isNull(), F.col("_general"))
                .otherwise(F.coalesce("own", "_general")), 2).alias("mape"),
        F.when(F.col("last_date").isNull(), "Category Baseline (no sales history)")
        .otherwise("Boosted Trees (Global Multi-Product Regressor)").alias("model")))


# ── offer weights ───────────────────────────────────────────────────────────

DEFAULT_OFFER_WEIGHTS = (50.0, 15.0, 10.0)


def offer_conversions(promotions: DataFrame, customers: DataFrame,
                      transactions: DataFrame) -> DataFrame:
    """(discount, ch_match, label, weight): every targeted customer of every promotion,
    counted rather than listed. Buyers come from a range join on (product, 32-day bin), a merge:
    the exploded bins, which Spark takes for as small as their file, must not be broadcast."""
    match = ((F.col("channel") == F.col("preferred_channel"))
             | (F.col("preferred_channel") == "Both")).cast("int")
    people = customers.select("customer_id", "segment", "preferred_channel")
    cells = people.groupBy("segment", "preferred_channel").agg(F.count(F.lit(1)).alias("n"))
    everyone = cells.groupBy("preferred_channel").agg(F.sum("n").alias("n")).select(
        F.lit("All").alias("segment"), "preferred_channel", "n")
    promos = promotions.select("promo_id", "product_id", "discount_pct", "channel",
                               "target_segment", "start_date", "end_date")
    targeted = (promos.join(cells.unionByName(everyone), F.col("target_segment")
                            == F.col("segment"))
                .groupBy("discount_pct", match.alias("ch_match")).agg(F.sum("n").alias("people")))
    bought = transactions.select("product_id", "customer_id",
                                 F.col("transaction_date").alias("day")).distinct().withColumn(
        "_bin", month_bin(F.col("day")))
    spread = promos.withColumn("_bin", F.explode(F.sequence(
        month_bin(F.col("start_date")), month_bin(F.col("end_date")))))
    buyers = (spread.join(bought.hint("merge"), ["product_id", "_bin"])
              .where(F.col("day").between(F.col("start_date"), F.col("end_date")))
              .select("promo_id", "discount_pct", "channel", "target_segment", "customer_id")
              .distinct().join(people.hint("merge"), "customer_id")
              .where((F.col("target_segment") == F.col("segment"))
                     | (F.col("target_segment") == "All"))
              .groupBy("discount_pct", match.alias("ch_match"))
              .agg(F.count(F.lit(1)).alias("buyers")))
    both = targeted.join(buyers, ["discount_pct", "ch_match"], "left").fillna(0, ["buyers"])
    return both.select("discount_pct", "ch_match", F.inline(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("buyers").cast("double").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("people") - F.col("buyers")).cast("double")
                 .alias("weight"))))).where("weight > 0")


NEWTON_STEPS = 25  # far more than a logistic fit of two features takes


def logistic_fit(cells: DataFrame, steps: int = NEWTON_STEPS) -> tuple[float, float, float]:
    """Intercept and coefficients of a logistic regression of (label, weight, x1, x2), with half
    the squared coefficients as penalty, by Newton steps.

    Each step is one aggregate over the cells; nine sums reach the driver. It starts from the
    plain rate, so the labels must not be all alike.
    """
    w, x1, x2 = F.col("weight"), F.col("x1"), F.col("x2")
    n, yes = cells.agg(F.sum(w), F.sum(w * F.col("label"))).first()
    b = np.array([math.log(yes / (n - yes)), 0.0, 0.0])
    for _ in range(steps):
        p = F.lit(1.0) / (F.exp(-(F.lit(float(b[0])) + x1 * float(b[1]) + x2 * float(b[2]))) + 1.0)
        e, q = w * (F.col("label") - p), w * p * (F.lit(1.0) - p)
        g0, g1, g2, h00, h01, h02, h11, h12, h22 = cells.agg(*[F.sum(c).alias(f"s{k}") for k, c in
            enumerate((e, e * x1, e * x2, q, q * x1, q * x2, q * x1 * x1, q * x1 * x2,
                       q * x2 * x2))]).first()
        step = np.linalg.solve([[h00, h01, h02], [h01, h11 + 1, h12], [h02, h12, h22 + 1]],
                               [g0, g1 - b[1], g2 - b[2]])
        b = b + step
        if np.abs(step).max() < 1e-13:
            break
    return tuple(b.tolist())


def nbo_weights(promotions: DataFrame, customers: DataFrame,
                transactions: DataFrame) -> DataFrame:
    """Offer-score weights from a logistic regression of conversion; one row, six decimals.

    Where fewer than three people bought or did not, or 20 were asked, ``learned`` is false and the
    weights are the default ones.
    """
    spark = promotions.sparkSession
    schema = "discount_w double, channel_w double, recency_w double, learned boolean"
    # One row per discount depth, match and label.
    cells = stored(offer_conversions(promotions, customers, transactions))
    w, d, c = F.col("weight"), F.col("discount_pct"), F.col("ch_match")
    s = cells.agg(F.sum(w).alias("n"), F.sum(w * F.col("label")).alias("yes"),
                  (F.sum(w * d) / F.sum(w)).alias("dm"), (F.sum(w * c) / F.sum(w)).alias("cm"),
                  (F.sum(w * d * d) / F.sum(w)).alias("dd"),
                  (F.sum(w * c * c) / F.sum(w)).alias("cc")).first()
    if not s["n"] or s["n"] < 20 or s["yes"] < 3 or s["n"] - s["yes"] < 3:
        return spark.createDataFrame([(*DEFAULT_OFFER_WEIGHTS, False)], schema)

    def unit(square: float, mean: float) -> float:
        return max(square - mean * mean, 0.0) ** 0.5 or 1.0

    scaled = cells.select(
        "label", "weight", ((d - s["dm"]) / unit(s["dd"], s["dm"])).alias("x1"),
        ((c - s["cm"]) / unit(s["cc"], s["cm"])).alias("x2"))
    _, first, second = (abs(x) for x in logistic_fit(scaled))
    scale = 65.0 / (first + second + 1e-6)
    return spark.createDataFrame([(first * scale, second * scale, 10.0, True)], schema).select(
        half_up("discount_w", 6).alias("discount_w"), half_up("channel_w", 6).alias("channel_w"),
        "recency_w", "learned")


# ── audience clusters ───────────────────────────────────────────────────────

# The names of the columns that are clustered.
AUDIENCE_COLUMNS = ["recency_days", "frequency", "monetary", "avg_order_val", "total_browses",
                    "wishlist_count", "cart_count"]


AUDIENCE_UNITS = 1000  # of a standard deviation: coordinates are whole numbers of them
AUDIENCE_STEPS = 100   # at most; a fit ends when no centre moves


def _scaled_audience(features: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Every customer in whole thousandths of a standard deviation from the mean, stored.

    Whole numbers make every later sum exact, so that a run repeats whatever the task order. Values
    count in hundredths, null as 0; a column without spread is 0 throughout.
    """
    values = features.select("customer_id", *columns, *[
        F.floor(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * 100.0 + 0.5).alias(f"_x{i}")
        for i, c in enumerate(columns)])
    values = stored(values)
    moments = [F.count(F.lit(1))]
    for i in range(len(columns)):
        x = F.col(f"_x{i}").cast("decimal(19,0)")
        moments += [F.sum(x), F.sum(x * x)]
    n, *sums = values.agg(*moments).first()  # one row, two numbers a column
    units = []
    for i in range(len(columns)):
        total, squares = (int(v or 0) for v in sums[2 * i:2 * i + 2])
        spread = n * squares - total * total  # n (n - 1) times the variance
        if spread <= 0:
            units.append(F.lit(0).cast("long").alias(f"_z{i}"))
            continue
        deviation = math.sqrt(float(spread) / n / (n - 1))
        units.append(F.floor((F.col(f"_x{i}") - total / n) / deviation * float(AUDIENCE_UNITS)
                             + 0.5).alias(f"_z{i}"))
    return (values.select("customer_id", *columns, *units),
            [f"_z{i}" for i in range(len(columns))])


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row (the lower one of equals) and its squared distance."""
    squares = np.stack([((rows - c) ** 2).sum(axis=1) for c in centres], axis=1)
    nearest = squares.argmin(axis=1)
    return nearest, squares[np.arange(len(rows)), nearest]


def _by_centre(rows: np.ndarray, nearest: np.ndarray, squares: np.ndarray,
               centres: int) -> np.ndarray:
    """Rows, squared distances and coordinates of each centre. Short numbers are sorted by counting;
    a centre's rows are then added up in one go."""
    sums = np.zeros((centres, rows.shape[1] + 2), dtype=np.int64)
    order = np.argsort(nearest.astype(np.min_scalar_type(centres)), kind="stable")
    own, first, count = np.unique(nearest[order], return_index=True, return_counts=True)
    if len(own):
        sums[own, 0], sums[own, 1] = count, np.add.reduceat(squares[order], first)
        sums[own, 2:] = np.add.reduceat(rows[order], first)
    return sums


def _group_sums(fits: dict[int, np.ndarray], schema: list[str]):
    """One Lloyd step inside a task: rows, coordinates and squared distances of each centre, summed
    over the whole task, so that a task hands on one row a centre."""
    def run(batches):
        held = {k: np.zeros((len(c), c.shape[1] + 2), dtype=np.int64) for k, c in fits.items()}
        for batch in batches:
            rows = batch.to_numpy(dtype=np.int64)
            for k, centres in fits.items():
                nearest, squares = _nearest(rows, centres)
                held[k] += _by_centre(rows, nearest, squares, len(centres))
        for k, sums in held.items():
            yield pd.DataFrame(np.column_stack(
                [np.full(len(sums), k), np.arange(len(sums)), sums]), columns=schema)
    return run


class AudienceModel:
    """Lloyd fits of the audience for several numbers of clusters at once.

    Customers are ranked by the sum of their coordinates (then by id) and cut into k equal parts,
    whose means are the first centres. A step is one pass over the customers for all open k: each
    joins its nearest centre (the lower one of equals), and a centre becomes the floor of its
    members' mean; one without members stays. Only centres reach the driver, k rows a fit.
    A k above the number of customers is not fitted.
    """

    def __init__(self, features: DataFrame, ks: Sequence[int],
                 columns: Sequence[str] = AUDIENCE_COLUMNS, steps: int = AUDIENCE_STEPS):
        self.columns = list(columns)
        scaled, self._axes = _scaled_audience(features, columns)
        score = reduce(lambda a, b: a + b, [F.col(z) for z in self._axes])
        self._people = stored(running_total(
            scaled.withColumns({"_score": score, "_one": F.lit(1)}),
            [F.col("_score"), F.col("customer_id")], "_one"))
        self.centres: dict[int, np.ndarray] = {}
        self.cost: dict[int, float] = {}
        self.steps: dict[int, int] = {}
        self.converged: dict[int, bool] = {}
        self._fit(ks, steps)

    def _seeds(self, ks: Sequence[int]) -> dict[int, np.ndarray]:
        parts = (self._people.withColumn("k", F.explode(F.lit(list(ks))))
                 .where("k <= total")
                 .groupBy("k", F.expr("(running - 1) * k div total").alias("part"))
                 .agg(F.count(F.lit(1)).alias("n"), *[F.sum(z).alias(z) for z in self._axes]))
        rows = parts.orderBy("k", "part").collect()  # k rows for each k
        return {k: np.array([[r[z] // r["n"] for z in self._axes] for r in rows if r["k"] == k],
                            dtype=np.int64) for k in {r["k"] for r in rows}}

    def _fit(self, ks: Sequence[int], steps: int) -> None:
        spark = self._people.sparkSession
        ship(spark)
        self.centres = self._seeds(ks)
        coordinates = self._people.select(*self._axes)
        names = ["k", "centre", "n", "squares", *self._axes]
        schema = ", ".join(f"{c} long" for c in names)
        open_fits = dict(self.centres)
        for step in range(1, steps + 1):
            if not open_fits:
                break
            sums = (coordinates.mapInPandas(_group_sums(open_fits, names), schema)
                    .groupBy("k", "centre").agg(*[F.sum(c).alias(c) for c in names[2:]])
                    .collect())  # one row a centre
            for k, old in list(open_fits.items()):
                new = old.copy()
                own = [r for r in sums if r["k"] == k]
                for r in own:
                    if r["n"]:
                        new[r["centre"]] = [r[z] // r["n"] for z in self._axes]
                self.centres[k], self.steps[k] = new, step
                self.cost[k] = sum(r["squares"] for r in own) / AUDIENCE_UNITS ** 2
                self.converged[k] = bool((new == old).all())
                if self.converged[k]:
                    del open_fits[k]
                else:
                    open_fits[k] = new

    def clusters(self, k: int) -> DataFrame:
        """Cluster of every customer, 0 to k - 1; null where k was not fitted."""
        offered = [F.struct(reduce(lambda a, b: a + b, [
            (F.col(z) - F.lit(int(v))) * (F.col(z) - F.lit(int(v)))
            for z, v in zip(self._axes, centre)]).alias("d"), F.lit(i).alias("i"))
            for i, centre in enumerate(self.centres.get(k, []))]
        cluster = F.array_min(F.array(*offered))["i"] if offered else F.lit(None).cast("int")
        return self._people.select("customer_id", cluster.alias("cluster_id"), *self.columns)


def _elbow(costs: list[tuple[int, float]]) -> int:
    """First k whose drop in cost is under 5 % of the whole range."""
    spread = costs[0][1] - costs[-1][1]
    if len(costs) < 2 or spread < 1e-6:
        return 8
    for (_, before), (k, after) in zip(costs, costs[1:]):
        if (before - after) / spread < 0.05:
            return k
    return costs[-1][0]


def audience_table(model: AudienceModel, ks: Sequence[int]) -> tuple[DataFrame, int]:
    """Cost of each k of ``ks`` with its steps, and the elbow. Where k is not fitted they are null;
    with none fitted the choice is 8."""
    costs = [(k, model.cost[k]) for k in ks if k in model.cost]
    chosen = _elbow(costs) if costs else 8
    table = model._people.sparkSession.createDataFrame(
        [(k, model.cost.get(k), model.steps.get(k), model.converged.get(k), k == chosen,
          k in model.cost) for k in ks],
        "k int, cost double, steps int, converged boolean, is_chosen boolean, fitted boolean")
    return table, chosen


def audience_k(features: DataFrame, columns: Sequence[str] = AUDIENCE_COLUMNS,
               max_k: int = 12) -> tuple[DataFrame, int]:
    """Clustering cost for k = 3..max_k, and the elbow."""
    ks = range(3, max_k + 1)
    return audience_table(AudienceModel(features, ks, columns), ks)


def audience_clusters(features: DataFrame, k: int,
                      columns: Sequence[str] = AUDIENCE_COLUMNS) -> DataFrame:
    """Cluster of every customer for a given k."""
    return AudienceModel(features, [k], columns).clusters(k)


def cluster_means(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("recency_days").alias("avg_recency_days"),
        F.avg("frequency").alias("avg_frequency"), money_mean("monetary").alias("avg_monetary"),
        F.avg("total_browses").alias("avg_browse_count"))


def cluster_labels(means: DataFrame) -> DataFrame:
    """Name each cluster from its means by ordered rules; a repeated name gets a suffix.

    ``means`` has one row per cluster (a dozen), so plain windows are enough.
    """
    every = Window.partitionBy()
    recency, frequency = F.col("avg_recency_days"), F.col("avg_frequency")
    money, browse = F.col("avg_monetary"), F.col("avg_browse_count")
    often = frequency > F.median(frequency).over(every)
    rich = money > F.median(money).over(every)
    poor = money < F.median(money).over(every)
    browsy = browse > F.median(browse).over(every)
    # The label texts, in the order the rules are tried.
    rules: list[tuple[Column, str]] = [
        ((recency < 30) & often & rich, "Champions"),
        ((recency < 30) & often, "Loyal Customers"),
        ((recency < 30) & rich, "Recent High-Value"),
        (recency > 90, "Lapsed"),
        (recency > 60, "At Risk"),
        (frequency <= 1, "First-Time Buyers"),
        (browsy & poor, "Window Shoppers"),
        (rich, "Big Spenders"),
        (often, "Frequent Buyers")]
    label = F.lit("Occasional Buyers")
    for condition, text in reversed(rules):
        label = F.when(condition, F.lit(text)).otherwise(label)
    named = means.withColumn("_base", label)
    nth = F.row_number().over(Window.partitionBy("_base").orderBy("cluster_id"))
    return named.withColumn("_nth", nth).withColumn(
        "label", F.when(F.col("_nth") == 1, F.col("_base"))
        .otherwise(F.concat_ws(" ", "_base", (F.col("_nth") - 1).cast("string")))).drop(
        "_base", "_nth")


# ── inventory weights ───────────────────────────────────────────────────────

def health_weights(features: DataFrame, products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Composite weights: absolute loadings of the first principal component, one row."""
    maker = products.select("product_id", "supplier_id").join(
        suppliers.select("supplier_id", "reliability_score"), "supplier_id", "left")
    columns = ["stockout_risk", "overstock_flag", "reliability_score"]
    rows = features.join(maker, "product_id", "left").select(
        F.coalesce(F.col(columns[0]).cast("double"), F.lit(0.0)).alias(columns[0]),
        F.coalesce(F.col(columns[1]).cast("double"), F.lit(0.0)).alias(columns[1]),
        F.coalesce(columns[2], F.lit(0.5)).alias(columns[2]))
    # The covariance of three columns is one aggregate; its six numbers reach the driver.
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    found = rows.agg(*[F.coalesce(F.covar_pop(columns[i], columns[j]), F.lit(0.0)).alias(f"c{i}{j}")
                       for i, j in pairs]).first()
    covariance = np.zeros((3, 3))
    for (i, j), value in zip(pairs, found, strict=True):
        covariance[i, j] = covariance[j, i] = value
    loadings = np.abs(np.linalg.eigh(covariance)[1][:, -1]).tolist()
    total = sum(loadings)
    return features.sparkSession.createDataFrame(
        [tuple(x / total for x in loadings)],
        "w_stockout double, w_overstock double, w_reliability double")


# ── ticket triage ───────────────────────────────────────────────────────────

# Responsible team by category, and for any other category.
TEAMS = {
    "Size Exchange": "Billing & Exchanges Team", "Wrong Item": "Order Fulfilment Team",
    "Payment Problem": "Accounts & Billing Team", "Delivery Delay": "Logistics & Shipping Team",
    "Product Quality": "Quality Assurance Team", "Return & Refund": "Returns Department",
    "Account Issue": "IT Support Team", "Order Issue": "Customer Relations Team"}
DEFAULT_TEAM = "Customer Relations Team"
# Phrases that settle the category, tried in this order.
CATEGORY_PHRASES = [
    ("Wrong Item", ["wrong item", "different item", "package had someone else", "another order",
                    "someone else's order"]),
    ("Size Exchange", ["too small", "too large", "doesn't fit", "wrong size", "exchange"]),
    ("Product Quality", ["damaged", "broken", "poor quality", "defect", "torn"]),
    ("Delivery Delay", ["not arrived", "tracking", "stuck", "delay", "late"]),
    ("Payment Problem", ["double charge", "payment failed", "deducted", "card declined",
                         "charged"]),
    ("Account Issue", ["login", "password", "account locked", "profile"])]


TERM_BUCKETS = 1 << 15  # of the hashed terms; coefficients are classes times this many


class TicketModel:
    """Category and priority classifiers over one TF-IDF representation of all terms.

    Terms are hashed into ``buckets``, so idf, coefficients and each step's gradient, which Spark
    sums over the partitions, have that width whatever the vocabulary is. No term is left out; two
    terms that share a bucket count as one.
    """

    def __init__(self, tickets: DataFrame, buckets: int = TERM_BUCKETS, iterations: int = 300,
                 stop_words: Sequence[str] | None = None):
        stop_words = default_stop_words() if stop_words is None else list(stop_words)
        self._tokenize = RegexTokenizer(inputCol="description", outputCol="_words",
                                        pattern=TOKEN, gaps=False, toLowercase=True)
        self._stop = StopWordsRemover(inputCol="_words", outputCol="_terms", stopWords=stop_words)
        words = self._stop.transform(self._tokenize.transform(self._text(tickets)))
        self._count = HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=buckets)
        counted = self._count.transform(words)
        idf = IDF(inputCol="_tf", outputCol="_idf").fit(counted)
        # The library's idf lacks the + 1 of the smoothed form.
        self._weigh = ElementwiseProduct(inputCol="_tf", outputCol="_tfidf", scalingVec=
                                         Vectors.dense([float(x) + 1.0 for x in
                                                        idf.idf.toArray()]))
        self._unit = Normalizer(inputCol="_tfidf", outputCol="features")
        self.labels: dict[str, list[str]] = {}
        self.models: dict[str, LogisticRegressionModel] = {}
        # The trainer's own blocks fill the executors' memory; rows for it, without texts, lie on disk.
        rows = self.vectors(tickets).select("features", "is_train", "category", "priority").persist(
            StorageLevel.DISK_ONLY)
        try:
            train = rows.where("is_train")
            n = max(train.count(), 1)
            for target in ("category", "priority"):
                indexer = StringIndexer(inputCol=target, outputCol="label",
                                        stringOrderType="alphabetAsc").fit(rows)
                self.labels[target] = list(indexer.labels)
                self.models[target] = LogisticRegression(
                    family="multinomial", maxIter=iterations, regParam=1.0 / n,
                    standardization=False).fit(indexer.transform(train))
        finally:
            rows.unpersist()

    @staticmethod
    def _text(tickets: DataFrame) -> DataFrame:
        return tickets.withColumns({
            "description": F.coalesce("description", F.lit("No description")),
            "is_train": F.pmod(F.xxhash64("ticket_id"), F.lit(100)) < 85})

    def vectors(self, tickets: DataFrame) -> DataFrame:
        words = self._stop.transform(self._tokenize.transform(self._text(tickets)))
        return self._unit.transform(self._weigh.transform(self._count.transform(words))).drop(
            "_words", "_terms", "_tf", "_tfidf")

    def predict(self, tickets: DataFrame) -> DataFrame:
        """Add predicted label and its probabilities for both targets."""
        rows = self.vectors(tickets)
        for target, model in self.models.items():
            names = F.array(*[F.lit(x) for x in self.labels[target]])
            rows = model.transform(rows).withColumns({
                f"predicted_{target}": F.get(names, F.col("prediction").cast("int")),
                f"_{target}_p": vector_to_array("probability")}).drop(
                "prediction", "probability", "rawPrediction")
        return rows.drop("features")

    def accuracy(self, tickets: DataFrame) -> DataFrame:
        """Share of held-out tickets labelled right, per target."""
        held_out = self.predict(tickets).where("NOT is_train")
        row = held_out.agg(F.count(F.lit(1)).alias("n"), *[
            F.avg((F.col(f"predicted_{x}") == F.col(x)).cast("double")).alias(x)
            for x in self.models])
        return row.select(F.inline(F.array(*[
            F.struct(F.lit(x).alias("target"), F.col("n").alias("test_rows"),
                     F.col(x).alias("accuracy")) for x in self.models])))

    def triage(self, tickets: DataFrame,
               phrases: Sequence[tuple[str, list[str]]] = CATEGORY_PHRASES) -> DataFrame:
        """Category (settled by a phrase when one occurs), priority, team and confidence.

        A settled category keeps the model's own probability of that class.
        """
        rows = self.predict(tickets)
        low, known = F.lower("description"), self.labels["category"]
        settled = F.lit(None).cast("string")
        for label, words in reversed(list(phrases)):
            if label in known:
                settled = F.when(contains_any(low, words), F.lit(label)).otherwise(settled)
        names = F.array(*[F.lit(x) for x in known])
        team = F.lit(DEFAULT_TEAM)
        for label, name in TEAMS.items():
            team = F.when(F.col("_label") == label, name).otherwise(team)
        rows = rows.withColumn("_label", F.coalesce(settled, "predicted_category"))
        category_p = F.get("_category_p", (F.array_position(names, F.col("_label")) - 1)
                           .cast("int"))
        priority_p = F.array_max("_priority_p")
        return rows.select(
            "ticket_id", F.col("_label").alias("predicted_category"), "predicted_priority",
            team.alias("recommended_team"), half_up(category_p, 3).alias("category_confidence"),
            half_up(priority_p, 3).alias("priority_confidence"),
            half_up((category_p + priority_p) / 2, 3).alias("overall_confidence"))
