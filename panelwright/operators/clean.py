"""Cleaning, guards and validation: each gives rows or a table of violations, never an exception about data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from panelwright.functions.scalars import finite


def clean_levels(rows: DataFrame) -> DataFrame:
    """Finite positive levels, one per symbol and date: the latest arrival (``arrival``) wins. Text values are tried as numbers."""
    v = finite(F.col("value").try_cast("double"))
    w = Window.partitionBy("symbol", "dt").orderBy(F.desc("arrival"))
    good = rows.select("symbol", F.to_date("dt").alias("dt"), v.alias("value"), "arrival").where("value > 0 AND dt IS NOT NULL")
    return good.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("symbol", "dt", "value")


def clean_events(rows: DataFrame, columns: tuple[str, ...], *, clip: bool = False) -> DataFrame:
    """Nulls and infinities of event columns are 0; with ``clip`` negatives as well."""
    value = lambda c: F.coalesce(finite(F.col(c)), F.lit(0.0))
    return rows.withColumns({c: F.greatest(value(c), F.lit(0.0)) if clip else value(c) for c in columns})


def strict_levels(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Levels of symbols without any finite value at or below zero, and the failures ``(symbol, n_bad)`` of the others."""
    v = rows.withColumn("value", finite(F.col("value"))).where("value is not null")
    bad = v.groupBy("symbol").agg(F.count_if(F.col("value") <= 0).alias("n_bad")).where("n_bad > 0")
    return v.join(bad, "symbol", "left_anti"), bad


def dedupe_keep_order(rows: DataFrame, key: str = "symbol", position: str = "pos") -> DataFrame:
    """First position of each distinct key."""
    return rows.groupBy(key).agg(F.min(position).alias(position))


def period_bounds(rows: DataFrame) -> DataFrame:
    """``start, end_exclusive`` of ``(start_text, end_text)``: inclusive ISO dates or year-months; null where either is no date."""
    day = r"^\d{4}-\d{2}-\d{2}$"
    month = r"^\d{4}-\d{2}$"
    as_date = lambda c: F.try_to_timestamp(F.when(c.rlike(day), c).when(c.rlike(month), F.concat(c, F.lit("-01"))), F.lit("yyyy-MM-dd")).cast("date")
    s, e = F.col("start_text"), F.col("end_text")
    return rows.withColumns({"start": as_date(s), "end_exclusive": F.when(e.rlike(month), F.add_months(as_date(e), 1)).otherwise(F.date_add(as_date(e), 1))})


def complete_period_guard(rows: DataFrame, as_of: Column) -> DataFrame:
    """``ok``: the period ends at the last complete day before ``as_of`` at the latest."""
    return rows.withColumn("ok", F.coalesce(F.col("end_exclusive") <= as_of, F.lit(False)))


def effective_end(rows: DataFrame, as_of: Column, *, year_to_date: bool) -> DataFrame:
    """``effective_end``: without the running year the end is the last complete year's; null where nothing is left."""
    end = F.col("end") if year_to_date else F.least("end", F.make_date(F.year(as_of) - 1, F.lit(12), F.lit(31)))
    return rows.withColumn("effective_end", F.when(end >= F.col("start"), end))


def pit_window_violations(scans: DataFrame) -> DataFrame:
    """Scans that end after the date of the membership they were built on."""
    return scans.where("end > selection_as_of")


def lifecycle_clip(levels: DataFrame, instruments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Levels from the first trade date on, and ``(symbol, removed, status)``. An unknown first date removes nothing."""
    df = levels.join(instruments, "symbol", "left")
    early = F.coalesce(F.col("dt") < F.col("first_trade_date"), F.lit(False))
    report = df.groupBy("symbol").agg(F.count_if(early).alias("removed"), F.max("first_trade_date").alias("_f"))
    status = F.when(F.col("_f").isNull(), "unknown").when(F.col("removed") > 0, "clipped").otherwise("ok")
    return df.where(~early).select(levels.columns), report.select("symbol", "removed", status.alias("status"))


def window_guard(levels: DataFrame, start: Column, end: Column) -> DataFrame:
    """Symbols with an observation outside ``[start, end]``."""
    g = levels.groupBy("symbol").agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    return g.where((F.col("first_dt") < start) | (F.col("last_dt") > end))


def late_starts(levels: DataFrame, start: Column, *, days: int = 5) -> DataFrame:
    """Symbols whose first observation comes more than ``days`` weekdays after ``start``: ``first_dt, n_weekdays``."""
    g = levels.groupBy("symbol").agg(F.min("dt").alias("first_dt"))
    n = F.size(F.filter(F.sequence(F.date_add(start, 1), F.col("first_dt")), lambda d: F.weekday(d) < 5))
    return g.where(F.col("first_dt") > start).withColumn("n_weekdays", n.cast("bigint")).where(F.col("n_weekdays") > days)


def complete_case(panel: DataFrame, value: str = "value") -> DataFrame:
    """Rows of dates on which every symbol of the panel has a value."""
    n = panel.agg(F.countDistinct("symbol").alias("_n"))
    full = panel.where(F.col(value).isNotNull()).groupBy("dt").agg(F.countDistinct("symbol").alias("_c")).join(F.broadcast(n), F.col("_c") == F.col("_n"), "left_semi")
    return panel.join(full.select("dt"), "dt", "left_semi").select(panel.columns)


def weight_violations(portfolios: DataFrame, *, most: int = 50, total: float = 1.0, tolerance: float = 1e-4) -> DataFrame:
    """``portfolio_id, reason`` of weights that are too many, repeated, not in (0, total], or do not sum to ``total``."""
    g = portfolios.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("d"), F.count_if((F.col("weight") <= 0) | (F.col("weight") > total) | F.col("weight").isNull()).alias("out"), F.sum("weight").alias("s"))
    reasons = F.array_compact(
        F.array(F.when(F.col("n") > most, "too_many"), F.when(F.col("d") < F.col("n"), "duplicate"), F.when(F.col("out") > 0, "weight_range"), F.when(F.coalesce(F.abs(F.col("s") - total) > tolerance, F.lit(True)), "weight_sum"))
    )
    return g.select("portfolio_id", F.explode(reasons).alias("reason"))


def source_freshness(rows: DataFrame, as_of: Column, *, future_days: int = 2, stale_days: int = 14) -> DataFrame:
    """``reason``: ``future`` or ``stale`` for source dates beyond the bounds, else null."""
    age = F.datediff(as_of, F.col("source_as_of"))
    return rows.withColumn("reason", F.when(age < -future_days, "future").when(age > stale_days, "stale"))
