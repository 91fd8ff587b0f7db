"""Return and risk measures of long panels, any number of symbols in one grouped aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from panelwright.functions.scalars import compound, safe_ratio
from panelwright.operators.windows import by_symbol, daily_returns, drawdown_series

TRADING_DAYS = 252


def period_rate(rf: float, periods: int = TRADING_DAYS) -> float:
    return (1 + rf) ** (1 / periods) - 1


def total_return(levels: DataFrame) -> DataFrame:
    return levels.groupBy("symbol").agg((F.max_by("value", "dt") / F.min_by("value", "dt") - 1).alias("total_return"))


def cagr(levels: DataFrame, days_per_year: float = 365.25) -> DataFrame:
    """Null for a single date."""
    g = levels.groupBy("symbol").agg((F.max_by("value", "dt") / F.min_by("value", "dt")).alias("growth"), (F.datediff(F.max("dt"), F.min("dt")) / days_per_year).alias("years"))
    return g.select("symbol", F.when(F.col("years") > 0, F.pow("growth", 1 / F.when(F.col("years") > 0, F.col("years"))) - 1).alias("cagr"))


def max_drawdown(levels: DataFrame) -> DataFrame:
    return drawdown_series(levels).groupBy("symbol").agg(F.min("drawdown").alias("max_drawdown"))


def _vol(periods: int) -> Column:
    return F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))


def volatility(levels: DataFrame, periods: int = TRADING_DAYS) -> DataFrame:
    return daily_returns(levels).groupBy("symbol").agg(_vol(periods).alias("volatility"))


def sharpe(levels: DataFrame, rf: float = 0.0, periods: int = TRADING_DAYS) -> DataFrame:
    """Annualised mean excess return over volatility; null where there is none."""
    return daily_returns(levels).groupBy("symbol").agg(safe_ratio(F.avg(F.col("ret") - period_rate(rf, periods)) * periods, _vol(periods)).alias("sharpe"))


def sortino(levels: DataFrame, rf: float = 0.0, periods: int = TRADING_DAYS) -> DataFrame:
    """As Sharpe, over the root of the mean squared shortfall of *all* days."""
    excess = F.col("ret") - period_rate(rf, periods)
    down = F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), F.lit(2)))) * F.sqrt(F.lit(float(periods)))
    return daily_returns(levels).where("ret is not null").groupBy("symbol").agg(safe_ratio(F.avg(excess) * periods, down).alias("sortino"))


def with_previous(benchmark: DataFrame) -> DataFrame:
    """The benchmark's calendar with the date and level before; one short table, so one partition does."""
    w = Window.partitionBy(F.lit(0)).orderBy("dt")
    return benchmark.select("dt", F.col("value").alias("bvalue"), F.lag("dt").over(w).alias("prev_dt"), (F.col("value") / F.lag("value").over(w) - 1).alias("bret"))


def benchmark_calendar_returns(levels: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``ret, bret`` on the benchmark's calendar: a day the asset lacks kills the pair before and the pair after it."""
    joined = levels.join(with_previous(benchmark), "dt")
    w = by_symbol()
    df = joined.withColumns({"_p": F.lag("dt").over(w), "ret": F.col("value") / F.lag("value").over(w) - 1})
    return df.where("_p = prev_dt AND ret IS NOT NULL AND bret IS NOT NULL").select("symbol", "dt", "ret", "bret")


def _beta() -> Column:
    return safe_ratio(F.covar_samp("ret", "bret"), F.var_samp("bret"))


def beta_alpha(pairs: DataFrame, rf: float = 0.0, periods: int = TRADING_DAYS) -> DataFrame:
    r = period_rate(rf, periods)
    g = pairs.groupBy("symbol").agg(_beta().alias("beta"), F.avg("ret").alias("a"), F.avg("bret").alias("b"), F.count(F.lit(1)).alias("n"))
    return g.select("symbol", F.col("n").alias("n_pairs"), "beta", ((F.col("a") - r - F.col("beta") * (F.col("b") - r)) * periods).alias("alpha"))


def benchmark_corr(pairs: DataFrame, least: int = 3) -> DataFrame:
    """Correlation of at least so many pairs; null where either side does not vary."""
    spread = F.stddev_samp("ret") * F.stddev_samp("bret")
    return pairs.groupBy("symbol").agg(F.when(F.count(F.lit(1)) >= least, safe_ratio(F.covar_samp("ret", "bret"), F.when(spread > 1e-15, spread))).alias("correlation"))


def metrics_report(levels: DataFrame, benchmark: DataFrame, *, rf: float = 0.0, periods: int = TRADING_DAYS) -> DataFrame:
    """All measures of each symbol in one windowed pass and one aggregate, with the benchmark's pairs joined on."""
    r = period_rate(rf, periods)
    excess = F.col("ret") - r
    down = F.sqrt(F.avg(F.when(F.col("ret").isNotNull(), F.pow(F.least(excess, F.lit(0.0)), F.lit(2))))) * F.sqrt(F.lit(float(periods)))
    panel = drawdown_series(daily_returns(levels))
    years = F.datediff(F.max("dt"), F.min("dt")) / 365.25
    growth = F.max_by("value", "dt") / F.min_by("value", "dt")
    own = panel.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_obs"),
        (growth - 1).alias("total_return"),
        F.when(years > 0, F.pow(growth, 1 / F.when(years > 0, years)) - 1).alias("cagr"),
        F.min("drawdown").alias("max_drawdown"),
        _vol(periods).alias("volatility"),
        safe_ratio(F.avg(excess) * periods, _vol(periods)).alias("sharpe"),
        safe_ratio(F.avg(excess) * periods, down).alias("sortino"),
    )
    return own.join(beta_alpha(benchmark_calendar_returns(levels, benchmark), rf, periods), "symbol", "left")


def benchmark_coverage(levels: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Share of the benchmark's dates that the asset has, at most 1."""
    total = benchmark.agg(F.countDistinct("dt").alias("_n"))
    own = levels.join(benchmark.select("dt"), "dt", "left_semi").groupBy("symbol").agg(F.countDistinct("dt").alias("n_common"))
    return own.join(F.broadcast(total)).select("symbol", "n_common", F.least(F.lit(1.0), F.col("n_common") / F.col("_n")).alias("coverage"))


def relative_coverage(rows: DataFrame) -> DataFrame:
    """``coverage``: a row's trading days over the most of all rows."""
    most = rows.agg(F.max("trading_days").alias("_m"))
    return rows.join(F.broadcast(most)).withColumn("coverage", F.least(F.lit(1.0), F.col("trading_days") / F.col("_m"))).drop("_m")


def business_day_coverage(levels: DataFrame, start: str, end: str) -> DataFrame:
    """Trading days in ``[start, end]`` over its weekdays, at most 1."""
    weekdays = F.size(F.filter(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")), lambda d: F.weekday(d) < 5))
    g = levels.where(F.col("dt").between(start, end)).groupBy("symbol").agg(F.countDistinct("dt").alias("trading_days"))
    return g.select("symbol", "trading_days", F.least(F.lit(1.0), F.col("trading_days") / weekdays).alias("coverage"))


def var_cvar(returns: DataFrame, q: float = 0.05) -> DataFrame:
    """The exact linear ``q`` quantile of returns and the mean of those at or below it."""
    cut = returns.groupBy("symbol").agg(F.percentile("ret", q).alias("var"))
    return returns.join(cut, "symbol").where("ret <= var").groupBy("symbol", "var").agg(F.avg("ret").alias("cvar"))


def calmar(levels: DataFrame) -> DataFrame:
    return cagr(levels).join(max_drawdown(levels), "symbol").select("symbol", safe_ratio(F.col("cagr"), F.abs("max_drawdown")).alias("calmar"))


def best_worst(periods: DataFrame) -> DataFrame:
    return periods.groupBy("symbol").agg(F.max("ret").alias("best"), F.min("ret").alias("worst"), (F.count_if(F.col("ret") > 0) / F.count("ret")).alias("positive_ratio"))


def monthly_compound(returns: DataFrame) -> DataFrame:
    return returns.where("ret is not null").groupBy("symbol", F.last_day("dt").alias("month_end")).agg(compound(F.col("ret")).alias("ret"))


def flow_summary(flows: DataFrame, profit_of: DataFrame) -> DataFrame:
    """``contributions, withdrawals, net`` by portfolio and ``profit``: the change of equity less the net flow."""
    amount = F.coalesce(F.col("begin_flow"), F.lit(0.0)) + F.coalesce(F.col("end_flow"), F.lit(0.0))
    pos = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    neg = lambda c: F.greatest(-F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    g = flows.groupBy("portfolio_id").agg(F.sum(pos("begin_flow") + pos("end_flow")).alias("contributions"), F.sum(neg("begin_flow") + neg("end_flow")).alias("withdrawals"), F.sum(amount).alias("net"))
    ends = profit_of.groupBy("portfolio_id").agg((F.max_by("value", "dt") - F.min_by("value", "dt")).alias("_change"))
    return g.join(ends, "portfolio_id", "left").withColumn("profit", F.col("_change") - F.col("net")).drop("_change")


def regime_stats(labelled: DataFrame, *, few: int = 12) -> DataFrame:
    """By symbol and regime: months, annualised return and deviation, best, worst, and whether the months are too few."""
    n = F.count("ret")
    g = labelled.where("regime is not null and ret is not null").groupBy("symbol", "regime").agg(
        n.alias("months"), (F.pow(1 + compound(F.col("ret")), 12 / n) - 1).alias("annual_return"), (F.stddev_samp("ret") * F.sqrt(F.lit(12.0))).alias("annual_vol"), F.max("ret").alias("best"), F.min("ret").alias("worst")
    )
    return g.withColumn("warning", F.col("months") < few)
