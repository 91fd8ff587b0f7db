"""Portfolio values without a day loop: between rebalances holdings are constant, so a segment's growth is a weighted sum.

``NAV_t = NAV_segment * sum(w_i * P_i(t) / P_i(segment start))``, and segments multiply. Batches of portfolios are one windowed
query keyed by ``portfolio_id``; prices come as a filled panel ``(symbol, dt, value)`` that has every member on every date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from panelwright.functions.scalars import EPSILON, safe_ratio

CASH = "CASH"


def member_prices(panel: DataFrame, portfolios: DataFrame) -> DataFrame:
    """``portfolio_id, symbol, weight, dt, value``; the members are the small side and go to the panel."""
    return panel.join(F.broadcast(portfolios), "symbol").select("portfolio_id", "symbol", "weight", "dt", "value")


def with_cash(portfolios: DataFrame, panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Portfolios whose weights sum below 1 get a cash leg of constant price for the rest."""
    rest = portfolios.groupBy("portfolio_id").agg((1 - F.sum("weight")).alias("weight")).where(F.col("weight") > 1e-9)
    cash = panel.select("dt").distinct().select(F.lit(CASH).alias("symbol"), "dt", F.lit(1.0).alias("value"))
    return portfolios.select("portfolio_id", "symbol", "weight").union(rest.select("portfolio_id", F.lit(CASH), "weight")), panel.select("symbol", "dt", "value").union(cash)


def nav_buy_hold(panel: DataFrame, portfolios: DataFrame, initial: float = 1.0) -> DataFrame:
    """``portfolio_id, dt, nav``: shares fixed at each member's first price."""
    m = member_prices(panel, portfolios)
    first = F.first("value").over(Window.partitionBy("portfolio_id", "symbol").orderBy("dt"))
    return m.withColumn("_g", F.col("weight") * F.col("value") / first).groupBy("portfolio_id", "dt").agg((initial * F.sum("_g")).alias("nav"))


def rebalance_flags(dates: DataFrame, unit: str, timing: str) -> DataFrame:
    """``dt, flag``: where a new segment starts, on the panel's calendar.

    ``first``: the first date of a period, at that close. ``prior``: the date before it. ``last``: the last date of a period,
    never the last of all. (``prior`` and ``last`` name the same closes on a gapless calendar.)
    """
    w = Window.partitionBy(F.lit(0)).orderBy("dt")
    key = F.trunc("dt", unit)
    flag = key != F.lag(key).over(w) if timing == "first" else key != F.lead(key).over(w)
    return dates.select("dt").distinct().select("dt", F.coalesce(flag, F.lit(False)).alias("flag"))


def _segments(panel: DataFrame, portfolios: DataFrame, flags: DataFrame) -> DataFrame:
    """Member rows with the segment a date's value belongs to and the price at that segment's start.

    A flagged date ends the segment before it and starts the next, so its value is counted in the one it ends.
    """
    w = Window.partitionBy("portfolio_id", "symbol").orderBy("dt")
    m = member_prices(panel, portfolios).join(F.broadcast(flags), "dt")
    m = m.withColumn("segment", F.coalesce(F.sum(F.col("flag").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = F.when(F.col("flag") | F.lag("value").over(w).isNull(), F.col("value"))
    return m.withColumn("base", F.coalesce(F.last(base, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("value")))


def nav_periodic(panel: DataFrame, portfolios: DataFrame, flags: DataFrame, *, initial: float = 1.0, cost_bps: float = 0.0) -> DataFrame:
    """``portfolio_id, dt, nav, rebalanced, turnover, cost``: back to target weights at each flag.

    ``turnover`` is the sum of absolute changes of weights at a rebalance; its cost, ``cost_bps`` of it, is taken from equity on
    that date. Growth within a segment multiplies the value at its start, after cost.
    """
    rate = cost_bps / 10_000
    g = _segments(panel, portfolios, flags).withColumn("_v", F.col("weight") * F.col("value") / F.col("base"))
    total = F.sum("_v").over(Window.partitionBy("portfolio_id", "dt"))
    g = g.withColumn("_t", total).groupBy("portfolio_id", "dt", "segment").agg(F.max("_t").alias("growth"), F.max("flag").alias("rebalanced"), F.sum(F.abs(F.col("weight") - F.col("_v") / F.col("_t"))).alias("_d"))
    g = g.withColumn("turnover", F.when(F.col("rebalanced"), F.col("_d")).otherwise(0.0))
    w = Window.partitionBy("portfolio_id").orderBy("dt")
    ended = F.when(F.col("rebalanced"), F.log("growth") + F.log1p(-rate * F.col("turnover"))).otherwise(0.0)
    before = F.exp(F.coalesce(F.sum(ended).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    gross = initial * before * F.col("growth")
    cost = gross * rate * F.col("turnover")
    return g.select("portfolio_id", "dt", (gross - cost).alias("nav"), "rebalanced", "turnover", cost.alias("cost"))


def allocation_drift(panel: DataFrame, portfolios: DataFrame, flags: DataFrame) -> DataFrame:
    """``portfolio_id, dt, symbol, weight, mix, segment``: each date's share before any rebalance of that date."""
    g = _segments(panel, portfolios, flags).withColumn("_v", F.col("weight") * F.col("value") / F.col("base"))
    return g.select("portfolio_id", "dt", "symbol", "weight", (F.col("_v") / F.sum("_v").over(Window.partitionBy("portfolio_id", "dt"))).alias("mix"), "segment")


def target_vs_final(drift: DataFrame) -> DataFrame:
    g = drift.groupBy("portfolio_id", "symbol").agg(F.max("weight").alias("target"), F.max_by("mix", "dt").alias("final"))
    return g.withColumn("change", F.col("final") - F.col("target"))


def drift_signal(drift: DataFrame, threshold: float) -> DataFrame:
    """``portfolio_id, segment, dt, drift``: the first date of a segment on which some share is ``threshold`` off its target."""
    d = drift.groupBy("portfolio_id", "segment", "dt").agg(F.max(F.abs(F.col("mix") - F.col("weight"))).alias("drift")).where(F.col("drift") >= threshold - EPSILON)
    return d.groupBy("portfolio_id", "segment").agg(F.min("dt").alias("dt"), F.min_by("drift", "dt").alias("drift"))


def turnover_summary(nav: DataFrame) -> DataFrame:
    """``gross, costs, n_rebalances, annual_one_way``: traded over twice the mean NAV and the years."""
    years = F.datediff(F.max("dt"), F.min("dt")) / 365.25
    traded = F.sum(F.col("turnover") * (F.col("nav") + F.col("cost")))
    g = nav.groupBy("portfolio_id").agg(traded.alias("gross"), F.sum("cost").alias("costs"), F.count_if("rebalanced").alias("n_rebalances"), F.avg("nav").alias("_m"), years.alias("_y"))
    return g.select("portfolio_id", "gross", "costs", "n_rebalances", safe_ratio(F.col("gross"), 2 * F.col("_m") * F.col("_y")).alias("annual_one_way"))


def rebalance_events(nav: DataFrame) -> DataFrame:
    """One row per rebalance: ``signal_dt`` (the date before), ``dt``, ``traded``, ``cost``, ``nav_before``, ``nav_after``."""
    w = Window.partitionBy("portfolio_id").orderBy("dt")
    df = nav.withColumn("signal_dt", F.lag("dt").over(w)).where("rebalanced")
    before = F.col("nav") + F.col("cost")
    return df.select("portfolio_id", "signal_dt", "dt", (F.col("turnover") * before).alias("traded"), "cost", before.alias("nav_before"), F.col("nav").alias("nav_after"))


def exposure_ratios(positions: DataFrame) -> DataFrame:
    """``gross, net`` of ``(portfolio_id, dt, value)`` positions, and both over ``equity``."""
    g = positions.groupBy("portfolio_id", "dt").agg(F.sum(F.abs("value")).alias("gross"), F.sum("value").alias("net"), F.max("equity").alias("equity"))
    return g.withColumns({"gross_ratio": safe_ratio(F.col("gross"), F.col("equity")), "net_ratio": safe_ratio(F.col("net"), F.col("equity"))})


def exposure_class(portfolios: DataFrame) -> DataFrame:
    """``total, exposure, residual``: inactive, cash, fully_invested or leveraged, with the share in cash or financed."""
    g = portfolios.groupBy("portfolio_id").agg(F.sum("weight").alias("total"))
    t = F.col("total")
    kind = F.when(t <= 1e-9, "inactive").when(t < 1 - 1e-4, "cash").when(t <= 1 + 1e-4, "fully_invested").otherwise("leveraged")
    return g.select("portfolio_id", "total", kind.alias("exposure"), F.when(kind.isin("cash", "leveraged"), F.abs(1 - t)).otherwise(0.0).alias("residual"))


def financed_buy_hold(nav: DataFrame, gross: float, rate: float, *, days_per_year: float = 365.2425) -> DataFrame:
    """``assets, debt, equity`` of a book held at ``gross`` times its equity: fixed debt that compounds by the days between dates."""
    w = Window.partitionBy("portfolio_id").orderBy("dt")
    step = F.coalesce(F.datediff("dt", F.lag("dt").over(w)), F.lit(0))
    first = F.first("nav").over(w)
    debt = (gross - 1) * first * F.exp(F.sum(F.log1p(rate * F.col("_step") / days_per_year)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = nav.withColumn("_step", step).withColumn("assets", gross * F.col("nav")).withColumn("debt", debt)
    return df.withColumn("equity", F.col("assets") - F.col("debt")).drop("_step")


def margin_breach(book: DataFrame, maintenance: float) -> DataFrame:
    """``portfolio_id, dt, equity, breached``: from the first date below the maintenance ratio on the equity stays in cash."""
    bad = (F.col("equity") <= 0) | (F.col("equity") / F.col("assets") < maintenance)
    w = Window.partitionBy("portfolio_id")
    at = F.min(F.when(bad, F.col("dt"))).over(w)
    df = book.withColumn("_at", at)
    stuck = F.max(F.when(F.col("dt") == F.col("_at"), F.greatest("equity", F.lit(0.0)))).over(w)
    over = F.coalesce(F.col("dt") >= F.col("_at"), F.lit(False))
    return df.select("portfolio_id", "dt", F.when(over, stuck).otherwise(F.col("equity")).alias("equity"), over.alias("breached"))


def income_split(components: DataFrame, portfolios: DataFrame) -> DataFrame:
    """``portfolio_id, dt, reinvested, cashed_out, income``: never rebalanced; total returns against price returns and a cash pile.

    ``components``: ``symbol, dt, total_ret, price_ret, dist_ret`` with zeros on each symbol's first date.
    """
    w = Window.partitionBy("portfolio_id", "symbol").orderBy("dt")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    m = components.join(F.broadcast(portfolios), "symbol")
    m = m.withColumns({"_t": F.col("weight") * F.exp(F.sum(F.log1p("total_ret")).over(run)), "_p": F.col("weight") * F.exp(F.sum(F.log1p("price_ret")).over(run))})
    m = m.withColumn("_i", F.coalesce(F.lag("_p").over(w), F.lit(0.0)) * F.col("dist_ret"))
    g = m.groupBy("portfolio_id", "dt").agg(F.sum("_t").alias("reinvested"), F.sum("_p").alias("_price"), F.sum("_i").alias("_i"))
    income = F.sum("_i").over(Window.partitionBy("portfolio_id").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0))
    return g.select("portfolio_id", "dt", "reinvested", (F.col("_price") + income).alias("cashed_out"), income.alias("income"))


def cashflow_schedule(events: DataFrame, amount: float, growth: float, *, days_per_year: float = 365.2425) -> DataFrame:
    """``amount`` at each event date, grown once for every full year since the first date (``start_dt``)."""
    years = F.floor(F.datediff("dt", "start_dt") / days_per_year)
    return events.withColumn("flow", amount * F.pow(F.lit(1 + growth), years))


def twr_from_flows(equity: DataFrame) -> DataFrame:
    """``ret, index`` of daily ``equity, begin_flow, end_flow``: flow-free growth, not below -1."""
    w = Window.partitionBy("portfolio_id").orderBy("dt")
    prior = F.lag("equity").over(w) + F.coalesce("begin_flow", F.lit(0.0))
    ret = F.greatest(F.lit(-1.0), (F.col("equity") - F.coalesce("end_flow", F.lit(0.0))) / F.when(prior > 0, prior) - 1)
    df = equity.withColumn("ret", F.coalesce(ret, F.lit(0.0)))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    lost = F.max((F.col("ret") <= -1).cast("int")).over(run)
    return df.withColumn("index", F.when(lost == 1, 0.0).otherwise(F.exp(F.sum(F.when(F.col("ret") > -1, F.log1p("ret")).otherwise(0.0)).over(run))))


def benchmark_nav(benchmark: DataFrame, initial: float, key: Column | None = None) -> DataFrame:
    w = Window.partitionBy(key if key is not None else F.lit(0)).orderBy("dt")
    return benchmark.withColumn("nav", initial * F.col("value") / F.first("value").over(w))


def effective_period_check(nav: DataFrame) -> DataFrame:
    """``n_periods, aligned``: whether all results share one start and end."""
    g = nav.groupBy("portfolio_id").agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    n = F.countDistinct(F.struct("a", "b"))
    return g.agg(n.alias("n_periods"), (n <= 1).alias("aligned"))


def equal_weights(members: DataFrame) -> DataFrame:
    return members.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("portfolio_id")))


def normalize_weights(portfolios: DataFrame) -> DataFrame:
    """``percent`` that sums to 100: rounded down to 0.01, the last symbol takes the rest."""
    w = Window.partitionBy("portfolio_id")
    low = F.floor(F.round(F.col("weight") / F.sum("weight").over(w) * 10_000, 6)).cast("bigint")
    df = portfolios.withColumn("_low", low).withColumn("_last", F.col("symbol") == F.max("symbol").over(w))
    rest = 10_000 - F.sum("_low").over(w)
    return df.withColumn("percent", (F.col("_low") + F.when(F.col("_last"), rest).otherwise(0)) / 100).drop("_low", "_last")


def post_cost_target(value: Column, legs: Column, rate: float, rounds: int = 5) -> Column:
    """Value after cost ``N = V - c * sum(|N w_i - v_i|)`` of ``legs`` (``array<struct<w, v>>``): a contraction by ``c``, unrolled.

    Five rounds do up to 100 basis points, twelve up to 1000.
    """
    step = lambda n: value - rate * F.aggregate(legs, F.lit(0.0), lambda a, x: a + F.abs(n * x["w"] - x["v"]))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), value.cast("double"), lambda n, _: step(n))
