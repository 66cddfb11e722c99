"""Executive rollups over transactions joined to products and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aislewise.functions.scalars import half_up, money_mean, money_sum, rate_mean, ratio


def margin() -> Column:
    """Amount charged less what the goods cost."""
    return F.col("total_amount") - F.col("quantity") * F.col("cost_price")


def slice_filter(category: str | None = None, channel: str | None = None,
                 region: str | None = None, year: int | str | None = None) -> Column:
    """Conjunction of the filters that are set; 'all' or empty means unfiltered."""
    condition = F.lit(True)
    for column, value in ((F.col("category"), category), (F.col("channel"), channel),
                          (F.col("region"), region)):
        if value and value.lower() != "all":
            condition = condition & (column == value)
    if year and str(year).lower() != "all":
        # A date range, not year(date) = y, so that it reaches the scan.
        condition = condition & F.col("transaction_date").between(
            F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date"))
    return condition


def joined_sales(transactions: DataFrame, products: DataFrame, customers: DataFrame,
                 **filters) -> DataFrame:
    """The shared FROM clause: inner joins, then the slice (pushed below the joins).

    Products come last: their texts are never dealt by customer, and a grouping by product finds
    the rows where the join left them."""
    return (transactions.join(customers.select("customer_id", "region", "segment"), "customer_id")
            .join(products.drop("price", "supplier_id"), "product_id")
            .where(slice_filter(**filters)))


def estate(transactions: DataFrame, products: DataFrame, customers: DataFrame,
           stores: DataFrame, warehouses: DataFrame, suppliers: DataFrame,
           **filters) -> DataFrame:
    """Headline position: one row for the slice, plus the size of the estate."""
    head = joined_sales(transactions, products, customers, **filters).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.coalesce(money_sum("total_amount"), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("units"),
        F.coalesce(money_sum(margin()), F.lit(0.0)).alias("margin"),
        F.count_distinct("customer_id").alias("buyers"),
        F.count_distinct("product_id").alias("skus_sold"),
        F.min("transaction_date").alias("period_start"),
        F.max("transaction_date").alias("period_end"),
        F.coalesce(money_mean("total_amount"), F.lit(0.0)).alias("_basket"),
        F.coalesce(rate_mean("discount_pct"), F.lit(0.0)).alias("_discount"),
        F.coalesce(money_sum(F.when(F.col("is_returned"), F.col("total_amount"))), F.lit(0.0))
        .alias("_returned"))

    def rows(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    return head.select(
        half_up("revenue", 2).alias("revenue"), half_up("margin", 2).alias("margin"),
        half_up(ratio("margin", "revenue", 0.0) * 100, 1).alias("margin_pct"),
        "units", "transactions", half_up("_basket", 2).alias("avg_basket"),
        half_up(F.col("_discount") * 100, 1).alias("avg_discount_pct"), "buyers", "skus_sold",
        half_up(ratio("_returned", "revenue", 0.0) * 100, 1).alias("return_rate_pct"),
        "period_start", "period_end",
        rows(customers).alias("customers"), rows(products).alias("products"),
        rows(stores).alias("stores"), rows(warehouses).alias("warehouses"),
        rows(suppliers).alias("suppliers"))


def revenue_trend(transactions: DataFrame, products: DataFrame, customers: DataFrame,
                  months: int = 36, **filters) -> DataFrame:
    """Monthly series of the last ``months`` months, with peak and trough marked."""
    monthly = (joined_sales(transactions, products, customers, **filters)
               .where("transaction_date IS NOT NULL")
               .groupBy(F.date_format("transaction_date", "yyyy-MM").alias("month"))
               .agg(money_sum("total_amount").alias("revenue"),
                    money_sum(margin()).alias("margin"), F.sum("quantity").alias("units"),
                    F.count(F.lit(1)).alias("transactions"),
                    F.count_distinct("customer_id").alias("buyers"))
               .orderBy(F.desc("month")).limit(months))
    # At most ``months`` rows reach this window.
    every = Window.partitionBy()
    first_peak = F.first("month").over(
        every.orderBy(F.desc("revenue"), "month"))
    first_trough = F.first("month").over(every.orderBy("revenue", "month"))
    return monthly.select(
        "*", (F.col("month") == first_peak).alias("is_peak"),
        (F.col("month") == first_trough).alias("is_trough"))


def channel_mix(transactions: DataFrame, products: DataFrame, customers: DataFrame,
                category=None, region=None, year=None) -> DataFrame:
    """Revenue per channel with its share; the channel filter never applies here."""
    by_channel = (joined_sales(transactions, products, customers, category=category,
                               region=region, year=year)
                  .where("channel IS NOT NULL").groupBy("channel")
                  .agg(money_sum("total_amount").alias("revenue"),
                       F.count(F.lit(1)).alias("transactions")))
    total = F.sum("revenue").over(Window.partitionBy())
    return by_channel.withColumn("share_pct",
                                 half_up(ratio(F.col("revenue"), total, 0.0) * 100, 1))


def category_performance(transactions: DataFrame, products: DataFrame, customers: DataFrame,
                         category: str | None = None, channel=None, region=None) -> DataFrame:
    """Revenue, share, margin and growth per category (or sub-category when drilled)."""
    label = "sub_category" if category and category.lower() != "all" else "category"
    years = (transactions.where("transaction_date IS NOT NULL")
             .select(F.year("transaction_date").alias("y")).distinct()
             .agg(F.sort_array(F.collect_set("y"), asc=False).alias("years")).scalar())
    sales = (joined_sales(transactions, products, customers, category=category,
                          channel=channel, region=region)
             .where(F.col(label).isNotNull())
             .withColumn("_years", years).withColumn("_year", F.year("transaction_date")))
    amount = F.col("total_amount")
    rows = (sales.groupBy(F.col(label).alias("label")).agg(
        money_sum(amount).alias("revenue"), F.sum("quantity").alias("units"),
        money_sum(margin()).alias("margin"), F.count_distinct("customer_id").alias("buyers"),
        F.count_distinct("product_id").alias("skus"),
        F.coalesce(money_sum(F.when(F.col("_year") == F.get("_years", F.lit(0)), amount)),
                   F.lit(0.0)).alias("_latest"),
        F.coalesce(money_sum(F.when(F.col("_year") == F.get("_years", F.lit(1)), amount)),
                   F.lit(0.0)).alias("_prior")))
    every = Window.partitionBy()  # one row per category from here on
    shaped = rows.select(
        "label", "revenue",
        half_up(ratio(F.col("revenue"), F.sum("revenue").over(every), 0.0) * 100, 1)
        .alias("revenue_share_pct"),
        "units", "margin", half_up(ratio("margin", "revenue", 0.0) * 100, 1).alias("margin_pct"),
        "buyers", "skus",
        half_up(ratio(F.col("_latest") - F.col("_prior"), "_prior", 0.0) * 100, 1)
        .alias("growth_pct"))
    return shaped.select(
        "*", half_up(F.median("revenue").over(every), 2).alias("median_revenue"),
        half_up(F.median("growth_pct").over(every), 1).alias("median_growth_pct"))


def seasonality(transactions: DataFrame, products: DataFrame, customers: DataFrame,
                **filters) -> DataFrame:
    """Revenue per trading day by calendar month and weekday (Sunday = 0)."""
    cells = (joined_sales(transactions, products, customers, **filters)
             .where("transaction_date IS NOT NULL")
             .groupBy(F.month("transaction_date").alias("month"),
                      (F.dayofweek("transaction_date") - 1).alias("weekday"))
             .agg(money_sum("total_amount").alias("revenue"),
                  F.count_distinct("transaction_date").alias("days"))
             .withColumn("revenue_per_day",
                         half_up(F.col("revenue") / F.greatest("days", F.lit(1)), 2)))
    best = Window.partitionBy().orderBy(F.desc("revenue_per_day"), "month", "weekday")
    return cells.withColumn("is_peak", F.row_number().over(best) == 1)  # 84 cells at most


def top_movers(transactions: DataFrame, products: DataFrame, customers: DataFrame,
               limit: int = 6, **filters) -> DataFrame:
    """Products carrying the most revenue in the slice."""
    sales = joined_sales(transactions, products, customers, **filters)
    return (sales.groupBy("product_id", "product_name", "category", "brand")
            .agg(money_sum("total_amount").alias("revenue"), F.sum("quantity").alias("units"),
                 money_sum(margin()).alias("margin"))
            .orderBy(F.desc("revenue"), "product_id").limit(limit)
            .select("product_id", "product_name", "category", "brand", "revenue", "units",
                    half_up(ratio("margin", "revenue", 0.0) * 100, 1).alias("margin_pct")))


def segment_aov(transactions: DataFrame, customers: DataFrame) -> DataFrame:
    """Average order value per segment and over everything, in one grouping-sets pass."""
    sales = transactions.select("customer_id", "total_amount").join(
        customers.select("customer_id", "segment"), "customer_id", "left")
    return (sales.groupingSets([["segment"], []], "segment")
            .agg(money_mean("total_amount").alias("aov"), F.grouping("segment").alias("_all"))
            .where("_all = 1 OR segment IS NOT NULL")
            .select(F.when(F.col("_all") == 1, "_global").otherwise(F.col("segment"))
                    .alias("segment"), half_up("aov", 2).alias("aov")))
