"""Queries of return, risk and window operators: monthly panels of 25 symbols where density matters, daily ones elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import metrics as M, windows as W
from panelwright.plans.registry import query
from panelwright.sources import adapters as A

_DD = "SELECT symbol, dt, value / max(value) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS drawdown FROM x_monthly"


@query("symbol", "total_return", sql="SELECT symbol, arg_max(value, dt) / arg_min(value, dt) - 1 AS total_return FROM x_monthly GROUP BY symbol")
def total_return(spark, sf):
    return M.total_return(A.monthly_levels(spark, sf))


@query("symbol", "cagr", sql="SELECT symbol, pow(arg_max(value, dt) / arg_min(value, dt), 365.25 / date_diff('day', min(dt), max(dt))) - 1 AS cagr FROM x_monthly GROUP BY symbol")
def cagr(spark, sf):
    return M.cagr(A.monthly_levels(spark, sf))


@query("symbol", "max_drawdown", sql=f"SELECT symbol, min(drawdown) AS max_drawdown FROM ({_DD}) GROUP BY symbol")
def max_drawdown(spark, sf):
    return M.max_drawdown(A.monthly_levels(spark, sf))


@query("symbol", "volatility", sql="SELECT symbol, stddev_samp(ret) * sqrt(252) AS volatility FROM x_ret GROUP BY symbol")
def volatility(spark, sf):
    return M.volatility(A.monthly_levels(spark, sf))


@query("symbol", "sharpe", sql="SELECT symbol, avg(ret - (pow(1.02, 1.0 / 252) - 1)) * 252 / (stddev_samp(ret) * sqrt(252)) AS sharpe FROM x_ret GROUP BY symbol")
def sharpe(spark, sf):
    return M.sharpe(A.monthly_levels(spark, sf), rf=0.02)


@query("symbol", "sortino", sql="SELECT symbol, avg(e) * 252 / (sqrt(avg(pow(least(e, 0), 2))) * sqrt(252)) AS sortino FROM (SELECT symbol, ret - (pow(1.02, 1.0 / 252) - 1) AS e FROM x_ret WHERE ret IS NOT NULL) GROUP BY symbol")
def sortino(spark, sf):
    return M.sortino(A.monthly_levels(spark, sf), rf=0.02)


@query("symbol dt", "ret bret", sql="SELECT * FROM x_pair")
def benchmark_calendar_returns(spark, sf):
    return M.benchmark_calendar_returns(A.monthly_levels(spark, sf), A.benchmark_monthly(spark, sf))


_BETA = "SELECT symbol, count(*) AS n_pairs, covar_samp(ret, bret) / var_samp(bret) AS beta, avg(ret) AS a, avg(bret) AS b FROM x_pair GROUP BY symbol"


@query("symbol n_pairs", "beta alpha", sql=f"SELECT *, (a - r - beta * (b - r)) * 252 AS alpha FROM ({_BETA}), (SELECT pow(1.02, 1.0 / 252) - 1 AS r)")
def beta_alpha(spark, sf):
    return M.beta_alpha(M.benchmark_calendar_returns(A.monthly_levels(spark, sf), A.benchmark_monthly(spark, sf)), rf=0.02)


@query("symbol", "correlation", sql="SELECT symbol, CASE WHEN count(*) >= 3 THEN corr(ret, bret) END AS correlation FROM x_pair GROUP BY symbol")
def benchmark_corr(spark, sf):
    return M.benchmark_corr(M.benchmark_calendar_returns(A.monthly_levels(spark, sf), A.benchmark_monthly(spark, sf)))


_REPORT = f"""
SELECT o.*, n_pairs, beta, (a - r - beta * (b - r)) * 252 AS alpha FROM (
  SELECT symbol, count(*) AS n_obs, arg_max(value, dt) / arg_min(value, dt) - 1 AS total_return,
         pow(arg_max(value, dt) / arg_min(value, dt), 365.25 / nullif(date_diff('day', min(dt), max(dt)), 0)) - 1 AS cagr,
         min(drawdown) AS max_drawdown, stddev_samp(ret) * sqrt(252) AS volatility, avg(ret - r) * 252 / (stddev_samp(ret) * sqrt(252)) AS sharpe,
         avg(ret - r) * 252 / (sqrt(avg(CASE WHEN ret IS NOT NULL THEN pow(least(ret - r, 0), 2) END)) * sqrt(252)) AS sortino, any_value(r) AS r
  FROM (SELECT *, value / max(value) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS drawdown, pow(1.02, 1.0 / 252) - 1 AS r FROM x_ret) GROUP BY symbol) o
LEFT JOIN ({_BETA}) p ON o.symbol = p.symbol
"""


@query("symbol n_obs n_pairs", "total_return cagr max_drawdown volatility sharpe sortino beta alpha", sql=f"SELECT * EXCLUDE (symbol_1) FROM (SELECT * FROM ({_REPORT.replace('o.*', 'o.*, p.symbol AS symbol_1')}))")
def metrics_report(spark, sf):
    return M.metrics_report(A.monthly_levels(spark, sf), A.benchmark_monthly(spark, sf), rf=0.02)


@query("symbol n_common", "coverage", sql="SELECT symbol, count(*) AS n_common, least(1.0, count(*) * 1.0 / (SELECT count(*) FROM x_bd)) AS coverage FROM x_daily WHERE dt IN (SELECT dt FROM x_bd) GROUP BY symbol")
def benchmark_coverage(spark, sf):
    return M.benchmark_coverage(A.daily_levels(spark, sf), A.benchmark_daily(spark, sf))


@query("symbol trading_days", "coverage", sql="SELECT symbol, n AS trading_days, least(1.0, n * 1.0 / max(n) OVER ()) AS coverage FROM (SELECT symbol, count(*) AS n FROM x_daily GROUP BY symbol)")
def relative_coverage(spark, sf):
    return M.relative_coverage(A.daily_levels(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("trading_days")))


@query(
    "symbol trading_days",
    "coverage",
    sql="SELECT symbol, count(*) AS trading_days, least(1.0, count(*) * 1.0 / (SELECT count(*) FROM (SELECT unnest(generate_series(DATE '1997-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) BETWEEN 1 AND 5)) AS coverage FROM x_daily WHERE dt BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY symbol",
)
def business_day_coverage(spark, sf):
    return M.business_day_coverage(A.daily_levels(spark, sf), "1997-01-01", "1998-12-31")


@query("symbol", "var cvar", sql="SELECT r.symbol, v AS var, avg(ret) AS cvar FROM x_ret r JOIN (SELECT symbol, quantile_cont(ret, 0.05) AS v FROM x_ret GROUP BY symbol) q ON r.symbol = q.symbol WHERE ret <= v GROUP BY ALL")
def var_cvar(spark, sf):
    return M.var_cvar(W.daily_returns(A.monthly_levels(spark, sf)))


@query(
    "symbol",
    "calmar",
    sql=f"SELECT c.symbol, cagr / abs(mdd) AS calmar FROM (SELECT symbol, pow(arg_max(value, dt) / arg_min(value, dt), 365.25 / date_diff('day', min(dt), max(dt))) - 1 AS cagr FROM x_monthly GROUP BY symbol) c JOIN (SELECT symbol, min(drawdown) AS mdd FROM ({_DD}) GROUP BY symbol) d ON c.symbol = d.symbol",
)
def calmar(spark, sf):
    return M.calmar(A.monthly_levels(spark, sf))


_YEARS = "SELECT symbol, CAST(date_trunc('year', dt) AS DATE) AS period, arg_max(value, dt) AS last, arg_min(value, dt) AS first, min(dt) AS a, max(dt) AS b FROM x_daily GROUP BY 1, 2"
_YEAR_RET = f"SELECT symbol, period, last / coalesce(lag(last) OVER w, first) - 1 AS ret, (period = min(period) OVER (PARTITION BY symbol) AND date_diff('day', period, a) > 7) OR (period = max(period) OVER (PARTITION BY symbol) AND date_diff('day', b, CAST(period + INTERVAL 1 YEAR AS DATE) - 1) > 7) AS is_partial FROM ({_YEARS}) WINDOW w AS (PARTITION BY symbol ORDER BY period)"


@query("symbol period is_partial", "ret", sql=_YEAR_RET)
def period_returns(spark, sf):
    return W.period_returns(A.daily_levels(spark, sf), "YEAR", grace_days=7)


@query("symbol", "best worst positive_ratio", sql=f"SELECT symbol, max(ret) AS best, min(ret) AS worst, count(*) FILTER (ret > 0) * 1.0 / count(ret) AS positive_ratio FROM ({_YEAR_RET}) GROUP BY symbol")
def best_worst_year(spark, sf):
    return M.best_worst(W.period_returns(A.daily_levels(spark, sf), "YEAR", grace_days=7))


@query("symbol", "positive_ratio", sql="SELECT symbol, count(*) FILTER (ret > 0) * 1.0 / count(ret) AS positive_ratio FROM x_ret GROUP BY symbol")
def positive_month_ratio(spark, sf):
    return M.best_worst(W.daily_returns(A.monthly_levels(spark, sf)))


@query("symbol dt", "ret", sql="SELECT symbol, dt, value / lag(value) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS ret FROM x_daily")
def daily_returns(spark, sf):
    return W.daily_returns(A.daily_levels(spark, sf))


@query("symbol dt", "drawdown", sql="SELECT symbol, dt, value / max(value) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS drawdown FROM x_daily")
def drawdown_series(spark, sf):
    return W.drawdown_series(A.daily_levels(spark, sf))


@query("symbol dt", "index", sql="SELECT symbol, dt, exp(sum(coalesce(ln(1 + ret), 0)) OVER (PARTITION BY symbol ORDER BY dt)) AS index FROM x_ret")
def return_index(spark, sf):
    return W.return_index(W.daily_returns(A.monthly_levels(spark, sf)))


@query("symbol dt", "value", sql="SELECT symbol, dt, value FROM (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(dt + CAST((5 - dayofweek(dt) + 7) % 7 AS INTEGER) AS DATE) ORDER BY dt DESC) AS n FROM x_daily) WHERE n = 1")
def weekly_last_actual(spark, sf):
    return W.weekly_last_actual(A.daily_levels(spark, sf))


@query("symbol dt", "value", sql="SELECT symbol, dt, value FROM (SELECT *, row_number() OVER (PARTITION BY symbol, last_day(dt) ORDER BY dt DESC) AS n, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS f FROM x_daily) WHERE n = 1 OR f = 1")
def sample_output(spark, sf):
    return W.sample_output(A.daily_levels(spark, sf), F.last_day("dt"))


@query("dt", sql="SELECT min(dt) AS dt FROM x_bd GROUP BY date_trunc('quarter', dt) QUALIFY min(dt) > min(min(dt)) OVER ()")
def first_of_period(spark, sf):
    return W.first_of_period(A.benchmark_daily(spark, sf).select("dt"), "QUARTER")


@query(
    "symbol period event_dt dt",
    sql="SELECT symbol, CAST(date_trunc('month', dt) AS DATE) AS period, max(dt) AS event_dt, max(CASE WHEN day(dt) % 2 = 0 THEN dt END) AS dt FROM x_daily GROUP BY symbol, date_trunc('month', dt) QUALIFY date_trunc('month', max(x_daily.dt)) < max(date_trunc('month', max(x_daily.dt))) OVER (PARTITION BY symbol) AND max(CASE WHEN day(x_daily.dt) % 2 = 0 THEN x_daily.dt END) IS NOT NULL",
)
def period_event_dates(spark, sf):
    return W.period_event_dates(A.daily_levels(spark, sf).withColumn("eligible", F.dayofmonth("dt") % 2 == 0), "MONTH", at_end=True, keys=("symbol",))


@query("symbol month_end", "ret", sql="SELECT symbol, last_day(dt) AS month_end, exp(sum(ln(1 + ret))) - 1 AS ret FROM (SELECT symbol, dt, value / lag(value) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS ret FROM x_weekly) WHERE ret IS NOT NULL GROUP BY 1, 2")
def monthly_compound(spark, sf):
    return M.monthly_compound(W.daily_returns(A.weekly_levels(spark, sf)))


@query("symbol dt", "ret", sql="SELECT symbol, dt, ret FROM x_ret QUALIFY dt > min(dt) OVER (PARTITION BY symbol) AND dt < max(dt) OVER (PARTITION BY symbol)")
def boundary_safe_monthly(spark, sf):
    return W.boundary_safe_monthly(W.daily_returns(A.monthly_levels(spark, sf)))


@query("symbol dt", "ret", sql="SELECT symbol, dt, ret FROM x_ret QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) <= 24")
def trailing_window(spark, sf):
    return W.trailing_window(W.daily_returns(A.monthly_levels(spark, sf)), 24)


_TOPS = """
SELECT *, sum(CAST(top AS INTEGER)) OVER (PARTITION BY symbol ORDER BY dt) AS island, max(dt) OVER (PARTITION BY symbol) AS last FROM (
  SELECT *, coalesce(value >= max(value) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1e-12, true) AS top FROM x_monthly)
"""


@query(
    "symbol rank peak_dt trough_dt recovery_dt days",
    "depth",
    sql=f"""
SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY depth, days DESC, peak_dt) AS rank, peak_dt, trough_dt, recovery_dt, depth, days FROM (
  SELECT p.symbol, p.dt AS peak_dt, trough_dt, recovery_dt, trough / value - 1 AS depth, date_diff('day', p.dt, coalesce(recovery_dt, last_dt)) AS days
  FROM (SELECT *, lead(dt) OVER (PARTITION BY symbol ORDER BY dt) AS recovery_dt FROM ({_TOPS}) WHERE top) p
  JOIN (SELECT symbol, island, arg_min(dt, (value, dt)) AS trough_dt, min(value) AS trough, max(dt) AS last_dt FROM ({_TOPS}) WHERE NOT top GROUP BY 1, 2) l ON p.symbol = l.symbol AND p.island = l.island)
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY depth, days DESC, peak_dt) <= 5""",
)
def top_drawdowns(spark, sf):
    return W.top_drawdowns(A.monthly_levels(spark, sf))


_MA = "SELECT *, avg(value) OVER w AS average, CASE WHEN count(*) OVER w >= 6 THEN CASE WHEN value >= avg(value) OVER w THEN 'bull' ELSE 'bear' END END AS regime FROM x_ret WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query("symbol dt regime", "average", sql=_MA)
def moving_average_regime(spark, sf):
    return W.moving_average_regime(A.monthly_levels(spark, sf))


@query(
    "symbol dt regime",
    "vol",
    sql="SELECT *, CASE WHEN vol >= quantile_cont(vol, 0.5) OVER (PARTITION BY symbol) THEN 'high' WHEN vol IS NOT NULL THEN 'low' END AS regime FROM (SELECT *, CASE WHEN count(ret) OVER w >= 6 THEN stddev_samp(ret) OVER w * sqrt(12) END AS vol FROM x_ret WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))",
)
def rolling_vol_regime(spark, sf):
    return W.rolling_vol_regime(W.daily_returns(A.monthly_levels(spark, sf)))


@query("symbol n", sql="SELECT symbol, count(*) FILTER (s > 1.8 OR s < 1 / 1.8) AS n FROM (SELECT symbol, value / lag(value) OVER (PARTITION BY symbol ORDER BY dt) AS s FROM x_weekly) GROUP BY symbol")
def material_transitions(spark, sf):
    return W.material_transitions(A.weekly_levels(spark, sf))


@query(
    "symbol regime months warning",
    "annual_return annual_vol best worst",
    sql=f"SELECT symbol, regime, count(ret) AS months, exp(sum(ln(1 + ret)) * 12 / count(ret)) - 1 AS annual_return, stddev_samp(ret) * sqrt(12) AS annual_vol, max(ret) AS best, min(ret) AS worst, count(ret) < 12 AS warning FROM ({_MA}) WHERE regime IS NOT NULL AND ret IS NOT NULL GROUP BY 1, 2",
)
def regime_stats(spark, sf):
    return M.regime_stats(W.moving_average_regime(W.daily_returns(A.monthly_levels(spark, sf))))


@query(
    "symbol year month",
    "ret",
    sql="SELECT symbol, CAST(year(dt) AS INTEGER) AS year, CAST(month(dt) AS INTEGER) AS month, ret FROM x_ret WHERE ret IS NOT NULL",
)
def month_returns_long(spark, sf):
    return W.daily_returns(A.monthly_levels(spark, sf)).where("ret is not null").select("symbol", F.year("dt").alias("year"), F.month("dt").alias("month"), "ret")


_MONTHS = " ".join(f"m{i}" for i in range(1, 13))


@query("symbol year", _MONTHS, sql=f"SELECT symbol, CAST(year(dt) AS INTEGER) AS year, {', '.join(f'max(CASE WHEN month(dt) = {i} THEN ret END) AS m{i}' for i in range(1, 13))} FROM x_ret GROUP BY 1, 2")
def month_heatmap(spark, sf):
    r = W.daily_returns(A.monthly_levels(spark, sf)).select("symbol", F.year("dt").alias("year"), F.month("dt").alias("m"), "ret")
    return r.groupBy("symbol", "year").pivot("m", list(range(1, 13))).agg(F.first("ret")).toDF("symbol", "year", *_MONTHS.split())
