"""Queries of portfolio operators on filled monthly prices of ten portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.operators import align as L, nav as N, windows as W
from panelwright.plans.registry import CTES, query
from panelwright.sources import adapters as A

CTES["x_fill"] = "SELECT * FROM (SELECT s.symbol, c.dt, last_value(d.value IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY c.dt) AS value FROM (SELECT DISTINCT symbol FROM x_monthly) s CROSS JOIN (SELECT DISTINCT dt FROM x_monthly) c LEFT JOIN x_monthly d ON d.symbol = s.symbol AND d.dt = c.dt) WHERE dt >= (SELECT max(f) FROM (SELECT min(dt) AS f FROM x_monthly GROUP BY symbol))"
CTES["x_hold"] = "SELECT portfolio_id, dt, 10000 * sum(weight * value / first) AS nav FROM (SELECT p.portfolio_id, p.weight, f.dt, f.value, first_value(f.value) OVER (PARTITION BY p.portfolio_id, f.symbol ORDER BY f.dt) AS first FROM x_fill f JOIN x_port p ON p.symbol = f.symbol) GROUP BY 1, 2"
CTES["x_flag"] = "SELECT dt, coalesce(date_trunc('year', dt) <> date_trunc('year', lag(dt) OVER (ORDER BY dt)), false) AS flag FROM (SELECT DISTINCT dt FROM x_fill)"
CTES["x_seg"] = "SELECT *, coalesce(last_value(CASE WHEN flag OR prior IS NULL THEN value END IGNORE NULLS) OVER (PARTITION BY portfolio_id, symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), value) AS base FROM (SELECT p.portfolio_id, p.symbol, p.weight, f.dt, f.value, g.flag, lag(f.value) OVER w AS prior, coalesce(sum(CAST(flag AS INTEGER)) OVER (PARTITION BY p.portfolio_id, p.symbol ORDER BY f.dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM x_fill f JOIN x_port p ON p.symbol = f.symbol JOIN x_flag g ON g.dt = f.dt WINDOW w AS (PARTITION BY p.portfolio_id, p.symbol ORDER BY f.dt))"
CTES["x_mix"] = "SELECT portfolio_id, dt, symbol, weight, flag, segment, weight * value / base AS v, sum(weight * value / base) OVER (PARTITION BY portfolio_id, dt) AS growth FROM x_seg"
_STEP = "SELECT portfolio_id, dt, max(growth) AS growth, bool_or(flag) AS rebalanced, CASE WHEN bool_or(flag) THEN sum(abs(weight - v / growth)) ELSE 0 END AS turnover FROM x_mix GROUP BY 1, 2"


def _nav_sql(rate: float) -> str:
    return f"SELECT portfolio_id, dt, rebalanced, turnover, gross * (1 - {rate} * turnover) AS nav, gross * {rate} * turnover AS cost FROM (SELECT *, 10000 * growth * exp(coalesce(sum(CASE WHEN rebalanced THEN ln(growth) + ln(1 - {rate} * turnover) ELSE 0 END) OVER (PARTITION BY portfolio_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gross FROM ({_STEP}))"


CTES["x_navc"] = _nav_sql(0.001)


def filled(spark, sf):
    return L.union_calendar_ffill(A.monthly_levels(spark, sf))


def flags(spark, sf):
    return N.rebalance_flags(filled(spark, sf), "YEAR", "first")


def nav_cost(spark, sf):
    return N.nav_periodic(filled(spark, sf), A.portfolios(spark, sf), flags(spark, sf), initial=10_000, cost_bps=10)


def hold(spark, sf):
    return N.nav_buy_hold(filled(spark, sf), A.portfolios(spark, sf), 10_000)


@query("portfolio_id dt", "nav", sql="SELECT * FROM x_hold")
def nav_buy_hold(spark, sf):
    return hold(spark, sf)


@query("portfolio_id dt rebalanced", "nav", sql=_nav_sql(0.0))
def nav_periodic(spark, sf):
    return N.nav_periodic(filled(spark, sf), A.portfolios(spark, sf), flags(spark, sf), initial=10_000)


@query("portfolio_id dt rebalanced", "nav turnover cost", sql="SELECT * FROM x_navc")
def nav_periodic_cost(spark, sf):
    return nav_cost(spark, sf)


@query("portfolio_id dt", "nav", sql="SELECT portfolio_id, dt, 4000 + nav * 0.6 AS nav FROM x_hold")
def nav_with_cash(spark, sf):
    p, panel = N.with_cash(A.portfolios(spark, sf).withColumn("weight", F.col("weight") * 0.6), filled(spark, sf))
    return N.nav_buy_hold(panel, p, 10_000)


@query("portfolio_id dt symbol", "mix", sql="SELECT portfolio_id, dt, symbol, v / growth AS mix FROM x_mix")
def allocation_drift(spark, sf):
    return N.allocation_drift(filled(spark, sf), A.portfolios(spark, sf), flags(spark, sf))


@query("portfolio_id symbol", "target final change", sql="SELECT portfolio_id, symbol, max(weight) AS target, arg_max(v / growth, dt) AS final, arg_max(v / growth, dt) - max(weight) AS change FROM x_mix GROUP BY 1, 2")
def target_vs_final_allocation(spark, sf):
    return N.target_vs_final(N.allocation_drift(filled(spark, sf), A.portfolios(spark, sf), flags(spark, sf)))


@query("portfolio_id segment dt", "drift", sql="SELECT portfolio_id, segment, min(dt) AS dt, arg_min(drift, dt) AS drift FROM (SELECT portfolio_id, CAST(segment AS BIGINT) AS segment, dt, max(abs(v / growth - weight)) AS drift FROM x_mix GROUP BY 1, 2, 3) WHERE drift >= 0.05 - 1e-12 GROUP BY 1, 2")
def drift_signal(spark, sf):
    return N.drift_signal(N.allocation_drift(filled(spark, sf), A.portfolios(spark, sf), flags(spark, sf)), 0.05)


@query("portfolio_id n_rebalances", "gross costs annual_one_way", sql="SELECT *, gross / (2 * m * y) AS annual_one_way FROM (SELECT portfolio_id, sum(turnover * (nav + cost)) AS gross, sum(cost) AS costs, count(*) FILTER (rebalanced) AS n_rebalances, avg(nav) AS m, date_diff('day', min(dt), max(dt)) / 365.25 AS y FROM x_navc GROUP BY 1)")
def turnover(spark, sf):
    return N.turnover_summary(nav_cost(spark, sf))


@query("portfolio_id signal_dt dt", "traded cost nav_before nav_after", sql="SELECT portfolio_id, signal_dt, dt, turnover * (nav + cost) AS traded, cost, nav + cost AS nav_before, nav AS nav_after FROM (SELECT *, lag(dt) OVER (PARTITION BY portfolio_id ORDER BY dt) AS signal_dt FROM x_navc) WHERE rebalanced")
def rebalance_events(spark, sf):
    return N.rebalance_events(nav_cost(spark, sf))


@query("portfolio_id dt", "gross net gross_ratio net_ratio", sql="SELECT *, gross / equity AS gross_ratio, net / equity AS net_ratio FROM (SELECT portfolio_id, dt, sum(abs(x)) AS gross, sum(x) AS net, max(growth) AS equity FROM (SELECT *, CASE WHEN symbol LIKE '%1' THEN -v ELSE v END AS x FROM x_mix) GROUP BY 1, 2)")
def exposure_ratios(spark, sf):
    d = N._segments(filled(spark, sf), A.portfolios(spark, sf), flags(spark, sf)).withColumn("v", F.col("weight") * F.col("value") / F.col("base"))
    d = d.withColumn("equity", F.sum("v").over(Window.partitionBy("portfolio_id", "dt")))
    return N.exposure_ratios(d.withColumn("value", F.when(F.col("symbol").endswith("1"), -F.col("v")).otherwise(F.col("v"))))


@query("portfolio_id exposure", "total residual", sql="SELECT portfolio_id, total, CASE WHEN total < 1 - 1e-4 THEN 'cash' WHEN total <= 1 + 1e-4 THEN 'fully_invested' ELSE 'leveraged' END AS exposure, CASE WHEN abs(total - 1) > 1e-4 THEN abs(1 - total) ELSE 0 END AS residual FROM (SELECT portfolio_id, sum(weight * CASE WHEN portfolio_id LIKE 'P%' THEN 1 WHEN portfolio_id < 'Q3' THEN 0.5 ELSE 1.7 END) AS total FROM x_port GROUP BY 1)")
def exposure_class(spark, sf):
    p = A.portfolios(spark, sf)
    k = F.when(F.col("portfolio_id").startswith("P"), 1.0).when(F.col("portfolio_id") < "Q3", 0.5).otherwise(1.7)
    return N.exposure_class(p.withColumn("weight", F.col("weight") * k))


_BOOK = "SELECT *, assets - debt AS equity FROM (SELECT portfolio_id, dt, 1.5 * nav AS assets, 0.5 * first_value(nav) OVER w * exp(sum(ln(1 + 0.05 * step / 365.2425)) OVER w) AS debt FROM (SELECT *, coalesce(date_diff('day', lag(dt) OVER (PARTITION BY portfolio_id ORDER BY dt), dt), 0) AS step FROM x_hold) WINDOW w AS (PARTITION BY portfolio_id ORDER BY dt))"


@query("portfolio_id dt", "assets debt equity", sql=_BOOK)
def financed_buy_hold(spark, sf):
    return N.financed_buy_hold(hold(spark, sf), 1.5, 0.05)


@query("portfolio_id dt breached", "equity", sql=f"WITH b AS ({_BOOK}), t AS (SELECT portfolio_id, min(dt) FILTER (equity <= 0 OR equity / assets < 0.6) AS at FROM b GROUP BY 1) SELECT b.portfolio_id, b.dt, coalesce(b.dt >= t.at, false) AS breached, CASE WHEN b.dt >= t.at THEN (SELECT greatest(c.equity, 0) FROM b c WHERE c.portfolio_id = t.portfolio_id AND c.dt = t.at) ELSE b.equity END AS equity FROM b JOIN t ON b.portfolio_id = t.portfolio_id")
def margin_breach(spark, sf):
    return N.margin_breach(N.financed_buy_hold(hold(spark, sf), 1.5, 0.05), 0.6)


_COMP = "SELECT symbol, dt, coalesce(value / lag(value) OVER w - 1, 0) AS price_ret, CASE WHEN lag(value) OVER w IS NOT NULL AND month(dt) % 3 = 0 THEN 0.01 ELSE 0 END AS dist_ret FROM x_fill WINDOW w AS (PARTITION BY symbol ORDER BY dt)"


def components(spark, sf):
    """Price returns of the filled panel and one per cent of distributions each quarter's last month."""
    r = W.daily_returns(filled(spark, sf))
    price = F.coalesce("ret", F.lit(0.0))
    dist = F.when(F.col("ret").isNotNull() & (F.month("dt") % 3 == 0), 0.01).otherwise(0.0)
    return r.select("symbol", "dt", (price + dist).alias("total_ret"), price.alias("price_ret"), dist.alias("dist_ret"))


_INC = f"SELECT portfolio_id, dt, sum(t) AS reinvested, sum(p) AS price, sum(coalesce(prior, 0) * dist_ret) AS i FROM (SELECT *, lag(p) OVER (PARTITION BY portfolio_id, symbol ORDER BY dt) AS prior FROM (SELECT q.portfolio_id, c.symbol, c.dt, dist_ret, q.weight * exp(sum(ln(1 + price_ret + dist_ret)) OVER w) AS t, q.weight * exp(sum(ln(1 + price_ret)) OVER w) AS p FROM ({_COMP}) c JOIN x_port q ON q.symbol = c.symbol WINDOW w AS (PARTITION BY q.portfolio_id, c.symbol ORDER BY c.dt))) GROUP BY 1, 2"


@query("portfolio_id dt", "reinvested cashed_out income", sql=f"SELECT *, price + income AS cashed_out FROM (SELECT *, sum(i) OVER (PARTITION BY portfolio_id ORDER BY dt) AS income FROM ({_INC}))")
def income_split(spark, sf):
    return N.income_split(components(spark, sf), A.portfolios(spark, sf))


@query("symbol dt", "total_ret price_ret dist_ret", sql=f"SELECT symbol, dt, price_ret + dist_ret AS total_ret, price_ret, dist_ret FROM ({_COMP})")
def align_components(spark, sf):
    return L.align_components(components(spark, sf))


@query("portfolio_id dt", "flow", sql="SELECT portfolio_id, dt, 100 * pow(1.03, floor(date_diff('day', start_dt, dt) / 365.2425)) AS flow FROM (SELECT portfolio_id, min(dt) AS dt, min(min(dt)) OVER (PARTITION BY portfolio_id) AS start_dt FROM x_hold GROUP BY portfolio_id, date_trunc('quarter', dt)) WHERE dt > start_dt")
def cashflow_schedule(spark, sf):
    h = hold(spark, sf)
    first = h.groupBy("portfolio_id").agg(F.min("dt").alias("start_dt"))
    return N.cashflow_schedule(W.first_of_period(h.select("portfolio_id", "dt"), "QUARTER", "portfolio_id").join(first, "portfolio_id"), 100.0, 0.03)


_FLOWS = "SELECT portfolio_id, dt, nav AS equity, CASE WHEN month(dt) % 3 = 1 THEN 100.0 END AS begin_flow, CASE WHEN month(dt) = 12 THEN -50.0 END AS end_flow FROM x_hold"


def flows(spark, sf):
    return hold(spark, sf).select("portfolio_id", "dt", F.col("nav").alias("equity"), F.when(F.month("dt") % 3 == 1, 100.0).alias("begin_flow"), F.when(F.month("dt") == 12, -50.0).alias("end_flow"))


@query("portfolio_id dt", "ret index", sql=f"SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY portfolio_id ORDER BY dt)) AS index FROM (SELECT *, coalesce(greatest(-1, (equity - coalesce(end_flow, 0)) / (lag(equity) OVER (PARTITION BY portfolio_id ORDER BY dt) + coalesce(begin_flow, 0)) - 1), 0) AS ret FROM ({_FLOWS}))")
def twr_from_flows(spark, sf):
    return N.twr_from_flows(flows(spark, sf))


@query("portfolio_id", "contributions withdrawals net profit", sql=f"SELECT portfolio_id, sum(coalesce(begin_flow, 0)) AS contributions, -sum(coalesce(end_flow, 0)) AS withdrawals, sum(coalesce(begin_flow, 0) + coalesce(end_flow, 0)) AS net, arg_max(equity, dt) - arg_min(equity, dt) - sum(coalesce(begin_flow, 0) + coalesce(end_flow, 0)) AS profit FROM ({_FLOWS}) GROUP BY 1")
def flow_summary(spark, sf):
    from panelwright.operators.metrics import flow_summary as summary

    f = flows(spark, sf)
    return summary(f, f.select("portfolio_id", "dt", F.col("equity").alias("value")))


@query("dt", "nav", sql="SELECT dt, 10000 * value / first_value(value) OVER (ORDER BY dt) AS nav FROM x_bd")
def benchmark_nav(spark, sf):
    return N.benchmark_nav(A.benchmark_daily(spark, sf), 10_000)


@query("n_periods aligned", sql="SELECT count(DISTINCT (a, b)) AS n_periods, count(DISTINCT (a, b)) <= 1 AS aligned FROM (SELECT symbol, min(dt) AS a, max(dt) AS b FROM x_daily GROUP BY 1)")
def effective_period_check(spark, sf):
    return N.effective_period_check(A.daily_levels(spark, sf).withColumnRenamed("symbol", "portfolio_id"))


@query("portfolio_id symbol", "weight", sql="SELECT portfolio_id, symbol, 1.0 / count(*) OVER (PARTITION BY portfolio_id) AS weight FROM x_port")
def equal_weight(spark, sf):
    return N.equal_weights(A.portfolios(spark, sf).select("portfolio_id", "symbol"))


@query("portfolio_id symbol", "percent", sql="SELECT portfolio_id, symbol, (low + CASE WHEN symbol = max(symbol) OVER (PARTITION BY portfolio_id) THEN 10000 - sum(low) OVER (PARTITION BY portfolio_id) ELSE 0 END) / 100 AS percent FROM (SELECT portfolio_id, symbol, CAST(floor(round(weight / sum(weight) OVER (PARTITION BY portfolio_id) * 10000, 6)) AS BIGINT) AS low FROM x_port)")
def normalize_weights(spark, sf):
    return N.normalize_weights(A.portfolios(spark, sf))


@query("portfolio_id n_symbols start_dt end_dt n_obs", sql="SELECT portfolio_id, count(DISTINCT p.symbol) AS n_symbols, min(dt) AS start_dt, max(dt) AS end_dt, count(*) AS n_obs FROM x_port p JOIN x_daily d ON p.symbol = d.symbol GROUP BY 1")
def portfolio_preflight(spark, sf):
    j = A.portfolios(spark, sf).join(A.daily_levels(spark, sf), "symbol")
    return j.groupBy("portfolio_id").agg(F.countDistinct("symbol").alias("n_symbols"), F.min("dt").alias("start_dt"), F.max("dt").alias("end_dt"), F.count(F.lit(1)).alias("n_obs"))
