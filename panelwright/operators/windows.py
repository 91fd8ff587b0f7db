"""Window operators over long panels ``(symbol, dt, value)``. Every window is partitioned, by symbol unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from panelwright.functions.scalars import EPSILON, week_end


def by_symbol(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("dt")


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def daily_returns(levels: DataFrame, *keys: str) -> DataFrame:
    """``ret``: the level over the one before, less one; null on a key's first date. Nothing is filled."""
    return levels.withColumn("ret", F.col("value") / F.lag("value").over(by_symbol(*keys)) - 1)


def drawdown_series(levels: DataFrame, *keys: str) -> DataFrame:
    return levels.withColumn("drawdown", F.col("value") / F.max("value").over(running(by_symbol(*keys))) - 1)


def return_index(returns: DataFrame, *keys: str) -> DataFrame:
    """``index``: running product of ``1 + ret`` with a null as 1; zero from a return of -1 on."""
    w = running(by_symbol(*keys))
    lost = F.max(F.coalesce(F.col("ret") <= -1, F.lit(False)).cast("int")).over(w)
    log = F.sum(F.when(F.col("ret") > -1, F.log1p("ret")).otherwise(0.0)).over(w)
    return returns.withColumn("index", F.when(lost == 1, 0.0).otherwise(F.exp(log)))


def last_of_period(levels: DataFrame, period: Column, *keys: str) -> DataFrame:
    """The last real row of each period, with its own date."""
    keys = keys or ("symbol",)
    w = Window.partitionBy(*keys, "_period").orderBy(F.desc("dt"))
    return levels.withColumn("_period", period).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_period")


def weekly_last_actual(levels: DataFrame) -> DataFrame:
    return last_of_period(levels, week_end(F.col("dt")))


def sample_output(levels: DataFrame, period: Column) -> DataFrame:
    """Last rows of the periods and the first and last row of all."""
    w = Window.partitionBy("symbol")
    ends = levels.withColumn("_a", F.min("dt").over(w)).where(F.col("dt") == F.col("_a")).drop("_a")
    return last_of_period(levels, period).union(ends).distinct()


def first_of_period(dates: DataFrame, unit: str, *keys: str) -> DataFrame:
    """First date of each month, quarter or year, but for the key's first period."""
    w = Window.partitionBy(*keys).orderBy("dt") if keys else Window.partitionBy(F.lit(0)).orderBy("dt")
    return dates.withColumn("_p", F.trunc("dt", unit)).withColumn("_q", F.lag("_p").over(w)).where("_q <> _p").drop("_p", "_q")


def period_event_dates(dates: DataFrame, unit: str, *, at_end: bool, keys: tuple[str, ...] = ("portfolio_id",)) -> DataFrame:
    """``event_dt, dt`` of each period: its first or last date, moved to the nearest eligible one inside the period, or dropped.

    ``dates``: keys, ``dt``, ``eligible``. The first period has no beginning event, the last date of all is no end event.
    """
    p = dates.withColumn("period", F.trunc("dt", unit))
    edge = F.max("dt") if at_end else F.min("dt")
    eligible = F.when(F.col("eligible"), F.col("dt"))
    g = p.groupBy(*keys, "period").agg(edge.alias("event_dt"), (F.max(eligible) if at_end else F.min(eligible)).alias("dt"))
    w = Window.partitionBy(*keys)
    bound = F.max("period").over(w) if at_end else F.min("period").over(w)
    return g.withColumn("_b", bound).where((F.col("period") != F.col("_b")) & F.col("dt").isNotNull()).drop("_b")


def period_returns(levels: DataFrame, unit: str, *, grace_days: int) -> DataFrame:
    """``period, ret, is_partial``: the period's last level over the previous period's last (the first over its own first).

    Partial: the first period if its first date is more than ``grace_days`` after its start, the last if it ends as early.
    """
    g = levels.groupBy("symbol", F.trunc("dt", unit).alias("period")).agg(F.max_by("value", "dt").alias("last"), F.min_by("value", "dt").alias("first"), F.min("dt").alias("a"), F.max("dt").alias("b"))
    w = Window.partitionBy("symbol").orderBy("period")
    months = {"YEAR": 12, "QUARTER": 3, "MONTH": 1}[unit.upper()]
    stop = F.date_sub(F.add_months("period", months), 1)
    every = Window.partitionBy("symbol")
    late = (F.col("period") == F.min("period").over(every)) & (F.datediff("a", "period") > grace_days)
    early = (F.col("period") == F.max("period").over(every)) & (F.datediff(stop, "b") > grace_days)
    return g.select("symbol", "period", (F.col("last") / F.coalesce(F.lag("last").over(w), F.col("first")) - 1).alias("ret"), (late | early).alias("is_partial"))


def boundary_safe_monthly(monthly: DataFrame) -> DataFrame:
    """Without the first and the last month of each symbol."""
    w = Window.partitionBy("symbol")
    return monthly.withColumns({"_a": F.min("dt").over(w), "_b": F.max("dt").over(w)}).where("dt > _a AND dt < _b").drop("_a", "_b")


def trailing_window(panel: DataFrame, n: int, *keys: str) -> DataFrame:
    """The last ``n`` dates of each key."""
    w = Window.partitionBy(*(keys or ("symbol",))).orderBy(F.desc("dt"))
    return panel.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= n).drop("_r")


def top_drawdowns(levels: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` deepest drawdowns: ``peak_dt, trough_dt, recovery_dt, depth, days``; of equal depth the longer first.

    A value within 1e-12 of the running peak ends an event, and the peak's date moves to the latest equal one.
    """
    w = by_symbol()
    prior = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = levels.withColumn("top", F.coalesce(F.col("value") >= prior - EPSILON, F.lit(True)))
    df = df.withColumn("island", F.sum(F.col("top").cast("int")).over(running(w)))
    peak = df.where("top").select("symbol", "island", F.col("dt").alias("peak_dt"), F.col("value").alias("peak"), F.lead("dt").over(w).alias("recovery_dt"), F.max("dt").over(Window.partitionBy("symbol")).alias("_last"))
    low = df.where("NOT top").groupBy("symbol", "island").agg(F.min_by("dt", F.struct("value", "dt")).alias("trough_dt"), F.min("value").alias("trough"), F.max("dt").alias("last_dt"))
    events = peak.join(low, ["symbol", "island"]).withColumn("depth", F.col("trough") / F.col("peak") - 1)
    events = events.withColumn("days", F.datediff(F.coalesce("recovery_dt", "last_dt"), F.col("peak_dt")))
    order = Window.partitionBy("symbol").orderBy("depth", F.desc("days"), "peak_dt")
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("symbol", F.col("rank").cast("bigint").alias("rank"), "peak_dt", "trough_dt", "recovery_dt", "depth", F.col("days").cast("bigint").alias("days"))


def moving_average_regime(levels: DataFrame, *, months: int = 10, least: int = 6) -> DataFrame:
    """``regime``: bull at or above the moving average of the last months, bear below; null until enough months."""
    w = by_symbol().rowsBetween(1 - months, 0)
    df = levels.withColumns({"average": F.avg("value").over(w), "_n": F.count("value").over(w)})
    return df.withColumn("regime", F.when(F.col("_n") >= least, F.when(F.col("value") >= F.col("average"), "bull").otherwise("bear"))).drop("_n")


def rolling_vol_regime(returns: DataFrame, *, months: int = 12, least: int = 6) -> DataFrame:
    """``regime``: high or low against the symbol's own median of the rolling annualised deviation."""
    w = by_symbol().rowsBetween(1 - months, 0)
    df = returns.withColumn("vol", F.when(F.count("ret").over(w) >= least, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(12.0))))
    middle = df.groupBy("symbol").agg(F.percentile("vol", 0.5).alias("median"))
    return df.join(middle, "symbol").withColumn("regime", F.when(F.col("vol") >= F.col("median"), "high").when(F.col("vol").isNotNull(), "low"))


def material_transitions(levels: DataFrame, *keys: str, ratio: float = 1.8) -> DataFrame:
    """``n``: steps by which a level changes to more than ``ratio`` times or less than one in ``ratio``."""
    keys = keys or ("symbol",)
    step = F.col("value") / F.lag("value").over(by_symbol(*keys))
    return levels.withColumn("_s", step).groupBy(*keys).agg(F.count_if((F.col("_s") > ratio) | (F.col("_s") < 1 / ratio)).alias("n"))


def direction_regime(series: DataFrame, low: str, high: str, *, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """``yoy, regime``: year-on-year change against its own median and its direction: ``high rising``, ``high falling``, ``low ...``."""
    w = by_symbol(*keys)
    df = series.withColumn("yoy", F.col("value") / F.lag("value", 12).over(w) - 1)
    df = df.withColumn("_d", F.col("yoy") - F.lag("yoy").over(w))
    middle = df.groupBy(*keys).agg(F.percentile("yoy", 0.5).alias("_m"))
    level = F.when(F.col("yoy") >= F.col("_m"), high).otherwise(low)
    way = F.when(F.col("_d") >= 0, "rising").otherwise("falling")
    return df.join(middle, list(keys)).withColumn("regime", F.when(F.col("_d").isNotNull(), F.concat_ws(" ", level, way))).drop("_d", "_m")


def delayed_flags(flags: DataFrame, delay: int) -> DataFrame:
    """A signal at a date trades ``delay`` dates later."""
    w = Window.partitionBy(F.lit(0)).orderBy("dt")
    return flags.select("dt", F.coalesce(F.lag("flag", delay).over(w), F.lit(False)).alias("flag"))


def inflation_adjusted(nav: DataFrame, prices: DataFrame) -> DataFrame:
    """``real``: value over the price index (last known), in units of the first date."""
    j = nav.join(prices.select("dt", F.col("value").alias("_p")), "dt", "left")
    w = by_symbol("portfolio_id")
    j = j.withColumn("_p", F.last("_p", ignorenulls=True).over(running(w)))
    return j.withColumn("real", F.col("nav") / (F.col("_p") / F.first("_p", ignorenulls=True).over(w))).drop("_p")
