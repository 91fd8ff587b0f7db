"""Queries of screening, universe and audit operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import audit as U, metrics as M, scan, screen as S, universe as V, windows as W
from panelwright.plans import q_metrics
from panelwright.plans.registry import query
from panelwright.sources import adapters as A

_IN = "coalesce(trailing_pe >= 5, false) AND coalesce(trailing_pe <= 30, false) AND market_cap >= 950"


@query("ticker", "market_cap trailing_pe", sql=f"SELECT * FROM x_fund WHERE {_IN}")
def screen_range_filter(spark, sf):
    return S.screen_range_filter(A.fundamentals(spark, sf), {"trailing_pe": (5, 30), "market_cap": (950, None)})


@query("field n_missing", sql="SELECT 'trailing_pe' AS field, count(*) - count(trailing_pe) AS n_missing FROM x_fund UNION ALL SELECT 'market_cap', count(*) - count(market_cap) FROM x_fund")
def screen_missing_fields(spark, sf):
    return S.missing_fields(A.fundamentals(spark, sf), ("trailing_pe", "market_cap"))


_MEMBERS = "SELECT DISTINCT 'P' || l_partkey AS ticker FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-05-01' AND DATE '1997-05-31' UNION SELECT 'X' || r_regionkey FROM region"


def members(spark, sf):
    line = A.table(spark, sf, "lineitem").where(F.to_date("l_shipdate").between("1997-05-01", "1997-05-31"))
    return line.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ticker")).distinct().union(A.table(spark, sf, "region").select(F.concat(F.lit("X"), F.col("r_regionkey").cast("string"))))


def _screened(spark, sf):
    return S.screen_universe(members(spark, sf), A.fundamentals(spark, sf), {"trailing_pe": (5, 30), "market_cap": (950, None)}, ("ECONOMY", "SMALL"))


@query("ticker sector", "market_cap trailing_pe", sql=f"SELECT f.* FROM ({_MEMBERS}) m JOIN x_fund f ON m.ticker = f.ticker WHERE sector IN ('ECONOMY', 'SMALL') AND {_IN}")
def membership_screen(spark, sf):
    return _screened(spark, sf)[0]


@query("members matched in_sector passed", sql=f"SELECT count(*) AS members, count(f.ticker) AS matched, count(*) FILTER (sector IN ('ECONOMY', 'SMALL')) AS in_sector, count(*) FILTER (sector IN ('ECONOMY', 'SMALL') AND {_IN}) AS passed FROM ({_MEMBERS}) m LEFT JOIN x_fund f ON m.ticker = f.ticker")
def screen_universe(spark, sf):
    return _screened(spark, sf)[1]


@query("ticker", sql=_MEMBERS)
def all_tickers(spark, sf):
    return members(spark, sf).distinct()


@query("ticker truncated", "trailing_pe", sql="SELECT ticker, trailing_pe, true AS truncated FROM x_fund ORDER BY trailing_pe ASC NULLS LAST, ticker LIMIT 50")
def screen_sort(spark, sf):
    return S.screen_sort(A.fundamentals(spark, sf), "trailing_pe", limit=50)


@query("ticker name sector", "market_cap trailing_pe", sql="SELECT ticker, name, sector, CASE WHEN market_cap < 1000 THEN market_cap * 2 ELSE market_cap END AS market_cap, trailing_pe FROM x_fund")
def merge_fundamentals(spark, sf):
    f = A.fundamentals(spark, sf)
    return S.merge_fundamentals(f, f.select("ticker", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("sector"), "industry", F.when(F.col("market_cap") < 1000, F.col("market_cap") * 2).alias("market_cap"), F.lit(None).cast("double").alias("trailing_pe"), "dividend_yield"))


def report(spark, sf):
    return M.metrics_report(A.monthly_levels(spark, sf), A.benchmark_monthly(spark, sf), rf=0.02)


_REPORT = q_metrics._REPORT
_SCORED = f"SELECT *, score_b / CASE WHEN beta > 0 THEN beta END AS score_c FROM (SELECT *, CASE WHEN status = 'ok' AND max_drawdown < 0 THEN score_a / abs(max_drawdown) END AS score_b FROM (SELECT *, CASE WHEN status = 'ok' THEN sortino * cagr END AS score_a FROM (SELECT *, CASE WHEN sortino IS NULL OR cagr IS NULL OR beta IS NULL OR max_drawdown IS NULL THEN 'missing_metrics' WHEN cagr <= -1 THEN 'invalid_cagr_domain' WHEN beta <= 0 THEN 'invalid_beta_domain' ELSE 'ok' END AS status FROM ({_REPORT}))))"


@query("symbol status", "score_a score_b score_c", sql=_SCORED)
def scan_scores(spark, sf):
    return S.scan_scores(report(spark, sf))


@query("symbol rank delta", "score_b", sql=f"SELECT symbol, score_b, rank() OVER (ORDER BY round(score_b, 12) DESC NULLS LAST) AS rank, rank() OVER (ORDER BY round(score_a, 12) DESC NULLS LAST) - rank() OVER (ORDER BY round(score_b, 12) DESC NULLS LAST) AS delta FROM ({_SCORED})")
def score_rank(spark, sf):
    return S.score_rank(S.scan_scores(report(spark, sf)), "score_b", "score_a")


@query("settled failed", "median_cagr mean_cagr median_sortino", sql=f"SELECT count(*) FILTER (status = 'ok') AS settled, count(*) FILTER (status <> 'ok') AS failed, quantile_cont(cagr, 0.5) AS median_cagr, avg(cagr) AS mean_cagr, quantile_cont(sortino, 0.5) AS median_sortino FROM ({_SCORED})")
def scan_summary(spark, sf):
    return S.scan_summary(S.scan_scores(report(spark, sf)))


@query("settled successful failed unfinished", sql=f"SELECT count(*) AS settled, count(*) FILTER (status = 'ok') AS successful, count(*) FILTER (status <> 'ok') AS failed, (SELECT count(DISTINCT symbol) FROM x_daily) - count(*) AS unfinished FROM ({_SCORED})")
def scan_settlement(spark, sf):
    every = A.daily_levels(spark, sf).select("symbol").distinct().join(S.scan_scores(report(spark, sf)).select("symbol", "status"), "symbol", "left")
    return every.agg(F.count("status").alias("settled"), F.count_if(F.col("status") == "ok").alias("successful"), F.count_if(F.col("status") != "ok").alias("failed"), F.count_if(F.col("status").isNull()).alias("unfinished"))


@query("symbol position", "max_drawdown", sql=f"SELECT * FROM (SELECT symbol, max_drawdown, row_number() OVER (ORDER BY abs(max_drawdown) DESC NULLS LAST, symbol) AS position FROM ({_REPORT.replace('o.*', 'o.symbol, o.max_drawdown')})) WHERE position BETWEEN 11 AND 20")
def scan_sort_page(spark, sf):
    return S.sort_page(report(spark, sf), F.abs("max_drawdown"), 1, 10)


_DAYS = "SELECT symbol, n * 1.0 / max(n) OVER () AS coverage FROM (SELECT symbol, count(*) AS n FROM x_daily GROUP BY symbol)"


def _covered(spark, sf):
    return S.coverage_filter(M.relative_coverage(A.daily_levels(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("trading_days"))), 0.985)


@query("symbol", "coverage", sql=f"SELECT * FROM ({_DAYS}) WHERE coverage + 1e-12 >= 0.985")
def coverage_filter(spark, sf):
    return _covered(spark, sf)[0]


@query("hidden", sql=f"SELECT count(*) FILTER (coverage + 1e-12 < 0.985) AS hidden FROM ({_DAYS})")
def coverage_hidden(spark, sf):
    return _covered(spark, sf)[1]


_LISTS = "SELECT universe_id, source_as_of, fetched_date, is_proxy, list_sort(list(member)) AS members, count(*) AS member_count FROM x_snap GROUP BY 1, 2, 3, 4"


def lists(spark, sf):
    return V.member_lists(A.snapshots(spark, sf))


@query("universe_id source_as_of member_count checksum", sql=f"SELECT universe_id, source_as_of, member_count, sha256(array_to_string(members, chr(10))) AS checksum FROM ({_LISTS})")
def member_checksum(spark, sf):
    return lists(spark, sf)


_CHURN = f"SELECT universe_id, source_as_of, len(members) AS n, len(b) AS previous, abs(len(members) - len(b)) * 1.0 / len(b) AS count_change, 1 - len(list_intersect(members, b)) * 1.0 / len(b) AS turnover, members, b FROM (SELECT *, lag(members) OVER (PARTITION BY universe_id ORDER BY source_as_of) AS b FROM ({_LISTS})) WHERE b IS NOT NULL"


@query("universe_id source_as_of n previous", "count_change turnover", sql=_CHURN)
def membership_churn(spark, sf):
    return V.churn(lists(spark, sf))


@query(
    "universe_id source_as_of added removed",
    sql=f"SELECT universe_id, source_as_of, coalesce((SELECT string_agg(m, '|' ORDER BY m) FROM (SELECT unnest(members) AS m) WHERE NOT list_contains(b, m)), '') AS added, coalesce((SELECT string_agg(m, '|' ORDER BY m) FROM (SELECT unnest(b) AS m) WHERE NOT list_contains(members, m)), '') AS removed FROM ({_CHURN})",
)
def members_added_removed(spark, sf):
    return V.churn(lists(spark, sf)).withColumns({"added": F.array_join("added", "|"), "removed": F.array_join("removed", "|")})


@query("universe_id source_as_of member", sql="SELECT universe_id, source_as_of, member FROM x_snap")
def member_dedupe(spark, sf):
    return A.snapshots(spark, sf).union(A.snapshots(spark, sf)).select("universe_id", "source_as_of", "member").dropDuplicates()


_PIT = f"SELECT u.universe_id, u.decision_date, s.source_as_of, s.member_count, CASE WHEN s.source_as_of IS NULL THEN 'missing' WHEN date_diff('day', s.source_as_of, u.decision_date) > 10 THEN 'stale' END AS reason, s.members FROM (SELECT DISTINCT universe_id, decision_date FROM x_snap, (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(month(o_orderdate) * 2 AS INTEGER) AS decision_date FROM orders)) u LEFT JOIN ({_LISTS}) s ON s.universe_id = u.universe_id AND s.source_as_of <= u.decision_date AND s.fetched_date <= u.decision_date QUALIFY row_number() OVER (PARTITION BY u.universe_id, u.decision_date ORDER BY s.source_as_of DESC NULLS LAST, s.fetched_date DESC) = 1"


def served(spark, sf):
    month = F.trunc(F.to_date("o_orderdate"), "MONTH")
    decisions = A.table(spark, sf, "orders").select(F.date_add(month, F.month(month) * 2).alias("decision_date")).distinct()
    return V.pit_snapshot_asof(decisions, lists(spark, sf))


@query("universe_id decision_date source_as_of member_count reason", sql=_PIT)
def pit_snapshot_asof(spark, sf):
    return served(spark, sf)


@query("universe_id decision_date ticker", sql=f"SELECT universe_id, decision_date, unnest(members[1:5]) AS ticker FROM ({_PIT}) WHERE reason IS NULL")
def pit_membership_screen(spark, sf):
    return V.pit_membership_screen(served(spark, sf), 5)


@query("universe_id source_as_of member_count is_stale", sql=f"SELECT universe_id, source_as_of, member_count, date_diff('day', source_as_of, DATE '2001-08-20') > 10 AS is_stale FROM ({_LISTS}) QUALIFY row_number() OVER (PARTITION BY universe_id ORDER BY source_as_of DESC) = 1")
def current_universe(spark, sf):
    return V.current_universe(lists(spark, sf), F.lit("2001-08-20").cast("date"))


@query("universe_id source_as_of", sql=f"SELECT universe_id, source_as_of FROM ({_LISTS}) QUALIFY row_number() OVER (PARTITION BY universe_id ORDER BY fetched_date DESC, source_as_of DESC) <= 12")
def retain_latest_versions(spark, sf):
    return V.retain_latest_versions(lists(spark, sf))


@query("universe_id source_as_of opens closes reason", sql=f"SELECT *, CASE WHEN is_proxy THEN 'proxy' WHEN member_count > 24 THEN 'too_many' WHEN opens > closes THEN 'closed' END AS reason FROM (SELECT *, greatest(source_as_of, fetched_date) AS opens, least(CAST(source_as_of + 10 AS DATE), DATE '2001-06-05') AS closes FROM ({_LISTS}))")
def admission_windows(spark, sf):
    return V.admission_windows(lists(spark, sf), F.lit("2001-06-05").cast("date"), most=24)


@query("universe_id source_as_of accepted reason", sql=f"SELECT universe_id, source_as_of, reason IS NULL AS accepted, reason FROM (SELECT l.universe_id, l.source_as_of, CASE WHEN date_diff('day', l.source_as_of, DATE '2001-05-01') < -2 THEN 'future' WHEN member_count NOT BETWEEN 20 AND 1000 THEN 'count' WHEN coalesce(turnover > 0.1, false) THEN 'churn' END AS reason FROM ({_LISTS}) l LEFT JOIN ({_CHURN}) c ON l.universe_id = c.universe_id AND l.source_as_of = c.source_as_of)")
def ingest_decisions(spark, sf):
    return V.ingest_decision(lists(spark, sf), F.lit("2001-05-01").cast("date"), low=20, most_turnover=0.1)


_RATIOS = ", ".join(f"abs(r / {x!r} - 1)" for x in U.SPLIT_RATIOS)
_EVENTS = f"""
SELECT symbol, dt, dividends, splits, coalesce(abs(change) > 5e-4 AND NOT near, false) AS factor_jump,
  coalesce(dividends > 0 AND abs(change - implied) > greatest(2.5e-3, abs(implied) * 0.25), false) AS distribution_gap,
  coalesce(least({_RATIOS}) <= 0.03 AND splits = 0, false) AS split_like, coalesce(abs(r - 1) > 0.75, false) AS large_move
FROM (SELECT *, f / lag(f) OVER w - 1 AS change, e OR coalesce(lag(e) OVER w, false) OR coalesce(lead(e) OVER w, false) AS near, close / lag(close) OVER w AS r, 1 / (1 - dividends / lag(close) OVER w) - 1 AS implied
  FROM (SELECT *, adj_close / close AS f, dividends > 0 OR splits > 0 AS e FROM (SELECT symbol, dt, close, dividends, splits, CASE WHEN year(dt) < 1998 THEN close * 0.9 ELSE close END AS adj_close FROM x_bars)) WINDOW w AS (PARTITION BY symbol ORDER BY dt))
"""


def adjusted_bars(spark, sf):
    return A.bars(spark, sf).withColumn("adj_close", F.when(F.year("dt") < 1998, F.col("close") * 0.9).otherwise(F.col("close")))


@query("symbol dt factor_jump distribution_gap split_like large_move", sql=_EVENTS)
def adjustment_factor_audit(spark, sf):
    return U.event_columns(adjusted_bars(spark, sf))


@query("symbol dt", sql=f"SELECT symbol, dt FROM ({_EVENTS}) WHERE split_like OR large_move")
def split_like_moves(spark, sf):
    return U.event_columns(adjusted_bars(spark, sf)).where("split_like OR large_move")


@query("symbol dt", sql=f"SELECT symbol, dt FROM ({_EVENTS}) WHERE distribution_gap")
def distribution_mismatch(spark, sf):
    return U.event_columns(adjusted_bars(spark, sf)).where("distribution_gap")


_WARN = "(factor_jump OR distribution_gap OR split_like OR large_move)"
_AUDIT = f"SELECT symbol, count(*) FILTER (dividends > 0) AS n_dividends, count(*) FILTER (splits > 0) AS n_splits, count(*) FILTER (factor_jump) AS n_factor_jump, count(*) FILTER (distribution_gap) AS n_distribution_gap, count(*) FILTER (split_like) AS n_split_like, count(*) FILTER (large_move) AS n_large_move, min(dt) FILTER ({_WARN}) AS first_warning, CASE WHEN count(*) FILTER ({_WARN}) > 0 THEN 'review' WHEN count(*) FILTER (dividends > 0 OR splits > 0) > 0 THEN 'events' ELSE 'clean' END AS status FROM ({_EVENTS}) GROUP BY symbol"


@query("symbol n_dividends n_splits n_factor_jump n_distribution_gap n_split_like n_large_move first_warning status", sql=_AUDIT)
def corporate_action_audit(spark, sf):
    return U.corporate_action_audit(adjusted_bars(spark, sf)).withColumn("first_warning", F.get("warning_dates", F.lit(0)))


@query("portfolio_id status review", sql=f"SELECT portfolio_id, CASE WHEN bool_or(status = 'review') THEN 'review' WHEN bool_or(status = 'events') THEN 'events' ELSE 'clean' END AS status, coalesce(string_agg(CASE WHEN status = 'review' THEN p.symbol END, '|' ORDER BY p.symbol), '') AS review FROM x_port p LEFT JOIN ({_AUDIT}) a ON p.symbol = a.symbol GROUP BY 1")
def portfolio_action_status(spark, sf):
    return U.portfolio_action_status(A.portfolios(spark, sf), U.corporate_action_audit(adjusted_bars(spark, sf))).withColumn("review", F.array_join("review", "|"))


_NATIVE = "SELECT symbol, dt, total_ret, total_ret - dist_ret AS price_ret, dist_ret FROM (SELECT symbol, dt, coalesce(adj_close / lag(adj_close) OVER w - 1, 0) AS total_ret, coalesce(dividends / lag(close) OVER w, 0) AS dist_ret FROM x_bars WINDOW w AS (PARTITION BY symbol ORDER BY dt))"


@query("symbol dt", "total_ret price_ret dist_ret", sql=_NATIVE)
def native_components(spark, sf):
    return U.native_components(A.bars(spark, sf))


_FXR = "SELECT d.symbol, d.dt, x.level / lag(x.level) OVER (PARTITION BY d.symbol ORDER BY d.dt) - 1 AS fx_ret FROM x_daily d JOIN x_conv c ON c.symbol = d.symbol AND NOT c.is_base JOIN x_fx x ON x.currency = c.currency AND x.dt = d.dt"


@query("symbol dt", "total_ret price_ret dist_ret total_index price_index", sql=f"SELECT *, exp(sum(ln(1 + total_ret)) OVER w) AS total_index, exp(sum(ln(1 + price_ret)) OVER w) AS price_index FROM (SELECT symbol, dt, t AS total_ret, t - d AS price_ret, d AS dist_ret FROM (SELECT n.symbol, n.dt, (1 + total_ret) * (1 + coalesce(fx_ret, 0)) - 1 AS t, dist_ret * (1 + coalesce(fx_ret, 0)) AS d FROM ({_NATIVE}) n LEFT JOIN ({_FXR}) f ON n.symbol = f.symbol AND n.dt = f.dt)) WINDOW w AS (PARTITION BY symbol ORDER BY dt)")
def base_ccy_components(spark, sf):
    conv = A.quote_conventions(spark, sf).where("NOT is_base")
    fx = A.daily_levels(spark, sf).join(F.broadcast(conv), "symbol").join(A.fx_levels(spark, sf), ["currency", "dt"])
    fx = fx.select("symbol", "dt", (F.col("level") / F.lag("level").over(W.by_symbol()) - 1).alias("fx_ret"))
    return U.base_ccy_components(U.native_components(A.bars(spark, sf)), fx)


@query("symbol dt", "total_ret price_ret dist_ret", sql="SELECT symbol, dt, ret AS total_ret, ret AS price_ret, 0.0 AS dist_ret FROM x_ret")
def total_only_components(spark, sf):
    return U.total_only_components(W.daily_returns(A.monthly_levels(spark, sf)))


_BROKEN = "SELECT symbol, dt, open, high, low, CASE WHEN day(dt) IN (20, 21, 22) THEN close * 10 ELSE close END AS close FROM x_bars"


@query(
    "symbol dt repaired future_assisted unresolved",
    "close",
    sql=f"""
SELECT symbol, dt, close, repaired, future_assisted, valid AND NOT close BETWEEN low / 1.005 AND high * 1.005 AS unresolved FROM (
WITH RECURSIVE bars AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS n, valid AND close BETWEEN low / 1.005 AND high * 1.005 AS ok
  FROM (SELECT *, least(open, high, low) > 0 AND low <= high AND open BETWEEN low / 1.005 AND high * 1.005 AS valid FROM ({_BROKEN}))),
marked AS MATERIALIZED (
  SELECT *, first_value(CASE WHEN ok THEN dt END IGNORE NULLS) OVER q AS b_dt, first_value(CASE WHEN ok THEN close END IGNORE NULLS) OVER q AS b_close
  FROM bars WINDOW q AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
walked AS (
  SELECT symbol, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS dt, CAST(NULL AS DATE) AS a_dt, CAST(NULL AS DOUBLE) AS a_close, CAST(NULL AS DOUBLE) AS v, false AS repaired, false AS ahead FROM (SELECT DISTINCT symbol FROM x_bars)
  UNION ALL
  SELECT symbol, n, dt, CASE WHEN valid THEN dt ELSE a_dt END, CASE WHEN valid THEN v ELSE a_close END, v, valid AND NOT ok, valid AND NOT ok AND a_dt IS NOT NULL AND b_dt IS NOT NULL
  FROM (SELECT m.symbol, m.n, m.dt, valid, ok, a_dt, a_close, b_dt,
      CASE WHEN ok OR NOT valid THEN close ELSE greatest(least(coalesce(exp(ln(a_close) * (1 - date_diff('day', a_dt, m.dt) * 1.0 / date_diff('day', a_dt, b_dt)) + ln(b_close) * (date_diff('day', a_dt, m.dt) * 1.0 / date_diff('day', a_dt, b_dt))), open), high), low) END AS v
    FROM walked w JOIN marked m ON m.symbol = w.symbol AND m.n = w.n + 1)),
near AS MATERIALIZED (
  SELECT w.symbol, w.n, w.dt, w.v, w.repaired, w.ahead, m.valid, m.low, m.high, lead(w.v) OVER o AS b, lead(w.dt) OVER o AS b_dt, lag(w.dt) OVER o AS a_dt
  FROM walked w JOIN marked m ON m.symbol = w.symbol AND m.n = w.n WINDOW o AS (PARTITION BY w.symbol ORDER BY w.n)),
bridged AS (
  SELECT symbol, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS dt, CAST(NULL AS DOUBLE) AS close, false AS repaired, false AS future_assisted, false AS valid, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM (SELECT DISTINCT symbol FROM x_bars)
  UNION ALL
  SELECT symbol, n, dt, CASE WHEN hit THEN greatest(least(bridge, high), low) ELSE v END, repaired OR hit, ahead OR hit, valid, low, high
  FROM (SELECT *, coalesce(valid AND NOT repaired AND ln(v / a) * ln(b / v) < 0 AND least(abs(ln(v / a)), abs(ln(b / v))) >= ln(3) AND abs(ln(b / a)) <= ln(1.5) AND bridge BETWEEN low / 1.005 AND high * 1.005, false) AS hit
    FROM (SELECT x.*, p.close AS a, exp(ln(p.close) * (1 - date_diff('day', a_dt, x.dt) * 1.0 / date_diff('day', a_dt, b_dt)) + ln(b) * (date_diff('day', a_dt, x.dt) * 1.0 / date_diff('day', a_dt, b_dt))) AS bridge
      FROM bridged p JOIN near x ON x.symbol = p.symbol AND x.n = p.n + 1)))
SELECT * FROM bridged WHERE close > 0)""",
)
def bar_repair(spark, sf):
    """Closes of three days running are put out of their bars, so that repairs lean on repairs."""
    b = A.bars(spark, sf).select("symbol", "dt", "open", "high", "low", F.when(F.dayofmonth("dt").isin(20, 21, 22), F.col("close") * 10).otherwise(F.col("close")).alias("close"))
    return U.bar_repair(b)


@query("symbol dt pulse", "value", sql="SELECT symbol, dt, coalesce(p, false) AS pulse, CASE WHEN coalesce(p, false) THEN sqrt(a * b) ELSE value END AS value FROM (SELECT *, greatest(value / a, a / value) >= 3 AND greatest(value / b, b / value) >= 3 AND greatest(a / b, b / a) <= 1.5 AS p FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM (SELECT symbol, dt, CASE WHEN month(dt) = 7 THEN value * 100 ELSE value END AS value FROM x_monthly) WINDOW w AS (PARTITION BY symbol ORDER BY dt)))")
def pulse_repair(spark, sf):
    return U.pulse_repair(A.monthly_levels(spark, sf).withColumn("value", F.when(F.month("dt") == 7, F.col("value") * 100).otherwise(F.col("value"))))


@query("symbol fingerprint", sql="SELECT symbol, sha256(string_agg(strftime(dt, '%Y-%m-%d') || '=' || CAST(CAST(floor(value * 10000 + 0.5) AS BIGINT) AS VARCHAR), '|' ORDER BY dt)) AS fingerprint FROM x_monthly GROUP BY symbol")
def series_fingerprint(spark, sf):
    return U.series_fingerprint(A.monthly_levels(spark, sf))


_ALIGNED = "SELECT symbol, count(*) AS n_shared, sha256(string_agg(strftime(m.dt, '%Y-%m-%d') || '=' || CAST(CAST(floor(m.value * 10000 + 0.5) AS BIGINT) AS VARCHAR) || '=' || CAST(CAST(floor(b.value * 10000 + 0.5) AS BIGINT) AS VARCHAR), '|' ORDER BY m.dt)) AS aligned_fingerprint, min(m.dt) AS data_start, max(m.dt) AS data_end FROM x_monthly m JOIN x_bm b ON m.dt = b.dt GROUP BY symbol HAVING count(*) >= 2"
_PRICES = "SELECT symbol, sha256(string_agg(strftime(dt, '%Y-%m-%d') || '=' || CAST(CAST(floor(value * 10000 + 0.5) AS BIGINT) AS VARCHAR), '|' ORDER BY dt)) AS price_fingerprint FROM x_monthly GROUP BY symbol"
_ASKED = "SELECT DISTINCT p_brand AS symbol, 'download' AS stage, 'requested history was not returned' AS detail, true AS again FROM part UNION ALL SELECT r_name, CASE WHEN r_regionkey > 0 THEN 'fx' ELSE 'download' END, CASE WHEN r_regionkey > 0 THEN 'no rate' ELSE 'requested history was not returned' END, r_regionkey = 0 FROM region UNION ALL SELECT n_name, 'calendar', 'fewer than two shared valuation dates', false FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey) UNION ALL SELECT n_name, 'download', 'requested history was not returned', true FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey)"
_COVERED = "SELECT symbol, least(1.0, count(*) * 1.0 / (SELECT count(*) FROM x_bd)) AS data_coverage FROM x_daily WHERE dt IN (SELECT dt FROM x_bd) GROUP BY symbol"


@query(
    "symbol status retryable error_code error n_obs n_pairs score_status data_start data_end n_shared n_dividends n_splits n_factor_jump n_distribution_gap n_split_like n_large_move first_warning audit_status price_fingerprint aligned_fingerprint",
    "total_return cagr max_drawdown volatility sharpe sortino beta alpha score_a score_b score_c data_coverage",
    sql=f"""
SELECT q.symbol, CASE WHEN a.symbol IS NOT NULL THEN 'ok' ELSE 'failed' END AS status, a.symbol IS NULL AND again AS retryable, CASE WHEN a.symbol IS NULL THEN stage || '_unavailable' END AS error_code, CASE WHEN a.symbol IS NULL THEN detail END AS error,
  n_obs, n_pairs, s.status AS score_status, data_start, data_end, n_shared, n_dividends, n_splits, n_factor_jump, n_distribution_gap, n_split_like, n_large_move, first_warning, u.status AS audit_status, price_fingerprint, aligned_fingerprint,
  total_return, cagr, max_drawdown, volatility, sharpe, sortino, beta, alpha, score_a, score_b, score_c, data_coverage
FROM ({_ASKED}) q LEFT JOIN ({_ALIGNED}) a ON q.symbol = a.symbol LEFT JOIN ({_SCORED.replace("o.*, n_pairs", "o.*, p.symbol AS symbol_1, n_pairs")}) s ON a.symbol = s.symbol LEFT JOIN ({_PRICES}) f ON a.symbol = f.symbol LEFT JOIN ({_AUDIT}) u ON a.symbol = u.symbol LEFT JOIN ({_COVERED}) c ON a.symbol = c.symbol""",
)
def scan_rows(spark, sf):
    """All brands are asked for, and names without a usable history: regions have no levels, nations one date, that of their first order."""
    orders, customer, nation, region = (A.table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    first = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).groupBy("c_nationkey").agg(F.last_day(F.to_date(F.min("o_orderdate"))).alias("dt"))
    short = first.join(nation, first["c_nationkey"] == nation["n_nationkey"]).select(F.col("n_name").alias("symbol"), "dt", F.lit(1.0).alias("value"))
    asked = A.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).union(region.select("r_name")).union(nation.select("n_name"))
    failures = region.where("r_regionkey > 0").select(F.col("r_name").alias("symbol"), F.lit("fx").alias("stage"), F.lit("no rate").alias("detail"), F.lit(False).alias("retryable"))
    return scan.scan_rows(asked, A.monthly_levels(spark, sf).union(short), A.benchmark_monthly(spark, sf), bars=adjusted_bars(spark, sf), raw=A.daily_levels(spark, sf), raw_benchmark=A.benchmark_daily(spark, sf), failures=failures, rf=0.02)


@query("symbol", "beta cagr", sql=f"SELECT symbol, beta, cagr FROM ({_REPORT})")
def benchmark_relative_overlay(spark, sf):
    """Standalone measures on a symbol's own calendar, beta on the joint one."""
    own, levels = M.cagr(A.monthly_levels(spark, sf)), A.monthly_levels(spark, sf)
    return own.join(M.beta_alpha(M.benchmark_calendar_returns(levels, A.benchmark_monthly(spark, sf))), "symbol", "left")


@query("symbol n_obs n_expected n_missing first_dt last_dt", sql="SELECT symbol, count(*) AS n_obs, (SELECT count(*) FROM x_bd) AS n_expected, (SELECT count(*) FROM x_bd) - count(*) AS n_missing, min(dt) AS first_dt, max(dt) AS last_dt FROM x_daily GROUP BY symbol")
def asset_preflight(spark, sf):
    total = A.benchmark_daily(spark, sf).agg(F.count(F.lit(1)).alias("n_expected"))
    g = A.daily_levels(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_obs"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    return g.join(F.broadcast(total)).withColumn("n_missing", F.col("n_expected") - F.col("n_obs"))
