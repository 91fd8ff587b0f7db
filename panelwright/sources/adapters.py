"""The test tables as the logical tables of the analytics operators: bars, levels, currencies, portfolios, fundamentals.

Prices are decimal sums divided once, so that they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.functions.scalars import week_end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _decimal_ratio(top: str, bottom: str) -> Column:
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return total(top) / total(bottom)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: ``symbol, dt, unit, seq`` and the price and quantity it is made of."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"), F.col("p_type").alias("kind"))
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_returnflag", F.to_date("l_shipdate").alias("dt"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return line.join(part, line["l_partkey"] == part["p_partkey"]).withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily ``symbol, dt, open, high, low, close, adj_close, dividends, splits``."""
    df = sales(spark, sf_dir).groupBy("symbol", "dt").agg(F.min_by("unit", "seq").alias("open"), F.max("unit").alias("high"), F.min("unit").alias("low"), _decimal_ratio("l_extendedprice", "l_quantity").alias("close"))
    dividends = F.when(F.dayofmonth("dt") == 15, 0.01 * F.col("close")).otherwise(0.0)
    splits = F.when((F.dayofmonth("dt") == 28) & (F.month("dt") == 6), 2.0).otherwise(0.0)
    return df.select("symbol", "dt", "open", "high", "low", "close", F.col("close").alias("adj_close"), dividends.alias("dividends"), splits.alias("splits"))


def daily_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).groupBy("symbol", "dt").agg(_decimal_ratio("l_extendedprice", "l_quantity").alias("value"))


def monthly_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).groupBy("symbol", F.last_day("dt").alias("dt")).agg(_decimal_ratio("l_extendedprice", "l_quantity").alias("value"))


def weekly_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).groupBy("symbol", week_end(F.col("dt")).alias("dt")).agg(_decimal_ratio("l_extendedprice", "l_quantity").alias("value"))


def kind_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly levels of the part types: the factors' proxies."""
    return sales(spark, sf_dir).groupBy(F.col("kind").alias("symbol"), F.last_day("dt").alias("dt")).agg(_decimal_ratio("l_extendedprice", "l_quantity").alias("value"))


def benchmark_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("dt")).agg(_decimal_ratio("l_extendedprice", "l_quantity").alias("value"))


def benchmark_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.last_day(F.to_date("l_shipdate")).alias("dt")).agg(_decimal_ratio("l_extendedprice", "l_quantity").alias("value"))


def brand_number(symbol: Column) -> Column:
    return F.regexp_extract(symbol, r"(\d+)$", 1).cast("int")


def fx_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``currency, dt, level``: average order value of a region by day, in units of 100,000; region 0 is the base currency."""
    o, c, n, r = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    df = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).where("r_regionkey <> 0")
    average = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) / 100000
    return df.groupBy(F.col("r_name").alias("currency"), F.to_date("o_orderdate").alias("dt")).agg(average.alias("level"))


def quote_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, currency, scale``: brand number modulo five is the region; region 1 quotes in hundredths."""
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    r = table(spark, sf_dir, "region")
    df = s.join(r, brand_number(F.col("symbol")) % 5 == F.col("r_regionkey"))
    return df.select("symbol", F.col("r_name").alias("currency"), (F.col("r_regionkey") == 0).alias("is_base"), F.when(F.col("r_regionkey") == 1, 0.01).otherwise(1.0).alias("scale"))


def portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``portfolio_id, symbol, weight``: P0-P4 equal weights, Q0-Q4 weights by total part size."""
    s = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.sum("p_size").alias("size"))
    s = s.withColumn("g", (brand_number(F.col("symbol")) % 5).cast("string"))
    total = s.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    s = s.join(F.broadcast(total), "g")
    equal = s.select(F.concat(F.lit("P"), "g").alias("portfolio_id"), "symbol", (1.0 / F.col("n")).alias("weight"))
    return equal.union(s.select(F.concat(F.lit("Q"), "g"), "symbol", F.col("size") / F.col("total")))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, first_trade_date``: 30 days after the first price for even brand numbers."""
    first = daily_levels(spark, sf_dir).groupBy("symbol").agg(F.min("dt").alias("first"))
    late = F.when(brand_number(F.col("symbol")) % 2 == 0, F.date_add("first", 30)).otherwise(F.col("first"))
    return first.select("symbol", late.alias("first_trade_date"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("sector"),
        F.col("p_brand").alias("industry"),
        F.col("p_retailprice").alias("market_cap"),
        size.alias("trailing_pe"),
        (F.col("p_size") / 100.0).alias("dividend_yield"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``universe_id, source_as_of, fetched_date, is_proxy, member``: nations of a month's orders by priority."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    df = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    month = F.trunc(F.to_date("o_orderdate"), "MONTH")
    df = df.select(F.col("o_orderpriority").alias("universe_id"), month.alias("source_as_of"), F.col("n_name").alias("member")).distinct()
    return df.withColumn("fetched_date", F.date_add("source_as_of", F.month("source_as_of") % 4)).withColumn("is_proxy", F.col("universe_id") == "5-LOW")
