"""Queries of nested parameter tuning, and their SQL."""

from __future__ import annotations

from functools import partial

from panelwright.operators import align as L, tuning as U, walk as K
from panelwright.plans import q_walk
from panelwright.plans.registry import CTES, query
from panelwright.sources import adapters as A, files as T

FOLDS, LOOKBACKS, KS, THRESHOLDS, ALLOCATIONS = 4, [3, 6], [2, 4], [0.0, 0.1], ["equal", "inverse_vol"]

CTES["x_wfill"] = "SELECT * FROM (SELECT s.symbol, c.dt, last_value(d.value IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY c.dt) AS value FROM (SELECT DISTINCT symbol FROM x_weekly) s CROSS JOIN (SELECT DISTINCT dt FROM x_weekly) c LEFT JOIN x_weekly d ON d.symbol = s.symbol AND d.dt = c.dt) WHERE value IS NOT NULL"
CTES["x_wret"] = "SELECT symbol, dt, value / lag(value) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS ret FROM x_wfill"
CTES["x_fold"] = f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY period_id) AS n FROM (SELECT period_id, i AS fold, train_start, train_end, CAST(CAST(date_trunc('month', e) AS DATE) - 1 AS DATE) AS decision_date, CAST(date_trunc('month', e) AS DATE) AS eval_start, e AS eval_end, CAST(date_trunc('month', e) - INTERVAL {max(LOOKBACKS)} MONTH AS DATE) AS inner_start FROM (SELECT *, last_day(CAST(train_end - to_months(CAST(i AS INTEGER)) AS DATE)) AS e FROM x_periods, (SELECT unnest(range(0, {FOLDS})) AS i))) WHERE inner_start >= train_start AND eval_end <= train_end) WHERE n = {FOLDS}"
_HASH = "sha256(lookback || '|' || k || '|' || CAST(CAST(floor(threshold * 1000000 + 0.5) AS BIGINT) AS VARCHAR) || '|' || allocation)"
CTES["x_grid"] = f"SELECT *, {_HASH} AS param_hash FROM (SELECT CAST(unnest({LOOKBACKS}) AS INTEGER) AS lookback), (SELECT CAST(unnest({KS}) AS INTEGER) AS k), (SELECT CAST(unnest({THRESHOLDS}) AS DOUBLE) AS threshold), (SELECT unnest({ALLOCATIONS}) AS allocation)"


def _decisions(asks: str, keys: str) -> str:
    """Dual momentum with weights of the rows of ``asks``."""
    own = " AND ".join(f"s.{c} = v.{c}" for c in [*keys.split(", "), "symbol"])
    points = f"SELECT decision_date, lookback, (SELECT min(dt) FROM x_wfill WHERE dt >= CAST(decision_date - to_months(lookback) AS DATE)) AS a, (SELECT max(dt) FROM x_wfill WHERE dt <= decision_date) AS b FROM (SELECT DISTINCT decision_date, lookback FROM {asks})"
    mom = f"SELECT decision_date, lookback, x.symbol, y.value / x.value - 1 AS momentum FROM ({points}) JOIN x_wfill x ON x.dt = a JOIN x_wfill y ON y.dt = b AND y.symbol = x.symbol"
    on = f"SELECT *, bool_or({q_walk._RISKY} AND momentum > threshold) OVER (PARTITION BY {keys}) AS on_ FROM {asks} JOIN ({mom}) USING (decision_date, lookback)"
    top = f"SELECT * FROM ({on}) WHERE CASE WHEN on_ THEN {q_walk._RISKY} AND momentum > threshold ELSE NOT ({q_walk._RISKY}) END QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY momentum DESC, symbol) <= k"
    vol = f"SELECT {', '.join('s.' + c for c in keys.split(', '))}, s.symbol, 1 / nullif(stddev_samp(ret), 0) AS iv FROM ({top}) s JOIN x_wret r ON r.symbol = s.symbol AND r.dt BETWEEN s.train_start AND s.decision_date WHERE ret IS NOT NULL GROUP BY ALL"
    return f"SELECT {keys}, symbol, decision_date, w / sum(w) OVER (PARTITION BY {keys}) AS weight, regime FROM (SELECT s.*, CASE WHEN allocation = 'inverse_vol' THEN v.iv ELSE 1.0 END AS w, CASE WHEN on_ THEN 'risky' ELSE 'defensive' END AS regime FROM ({top}) s LEFT JOIN ({vol}) v ON {own}) WHERE w IS NOT NULL"


CTES["x_ask"] = "SELECT period_id, fold, train_start, decision_date, eval_start, lookback, k, threshold, allocation, param_hash FROM x_fold, x_grid"
CTES["x_idec"] = _decisions("x_ask", "period_id, param_hash, fold")
CTES["x_path"] = "SELECT d.period_id, param_hash, d.fold, d.symbol, weight, w.dt, weight * w.value / b.value AS part FROM x_idec d JOIN x_fold f ON f.period_id = d.period_id AND f.fold = d.fold JOIN x_wfill b ON b.symbol = d.symbol AND b.dt = (SELECT max(dt) FROM x_wfill WHERE dt <= f.decision_date) JOIN x_wfill w ON w.symbol = d.symbol AND w.dt BETWEEN f.eval_start AND f.eval_end"
CTES["x_end"] = "SELECT *, part / sum(part) OVER (PARTITION BY period_id, param_hash, fold) AS old FROM (SELECT period_id, param_hash, fold, symbol, any_value(weight) AS weight, arg_max(part, dt) AS part FROM x_path GROUP BY 1, 2, 3, 4)"
CTES["x_cost"] = "SELECT period_id, param_hash, fold, sum(abs(n - o)) * 0.001 AS cost FROM (SELECT period_id, param_hash, fold, symbol, sum(n) AS n, sum(o) AS o FROM (SELECT period_id, param_hash, fold, symbol, weight AS n, 0.0 AS o FROM x_end UNION ALL SELECT period_id, param_hash, fold - 1, symbol, 0.0, old FROM x_end WHERE fold > 0) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"
CTES["x_inner"] = "SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY period_id, param_hash ORDER BY dt)) AS equity FROM (SELECT p.period_id, p.param_hash, p.fold, dt, CASE WHEN b IS NULL THEN nav * (1 - cost) ELSE nav / b END - 1 AS ret, CASE WHEN b IS NULL THEN cost ELSE 0 END AS cost FROM (SELECT *, lag(nav) OVER (PARTITION BY period_id, param_hash, fold ORDER BY dt) AS b FROM (SELECT period_id, param_hash, fold, dt, sum(part) AS nav FROM x_path GROUP BY 1, 2, 3, 4)) p JOIN x_cost c ON c.period_id = p.period_id AND c.param_hash = p.param_hash AND c.fold = p.fold)"
CTES["x_judged"] = "SELECT period_id, param_hash, count(DISTINCT fold) AS n_folds, avg(ret) * sqrt(52) / nullif(sqrt(avg(pow(least(ret, 0), 2))), 0) AS sortino, min(equity / greatest(1, peak) - 1) AS max_drawdown, arg_max(equity, dt) AS last, max(dt) AS upto, sum(cost * equity / (1 + ret)) AS costs FROM (SELECT *, max(equity) OVER (PARTITION BY period_id, param_hash ORDER BY dt) AS peak FROM x_inner) GROUP BY 1, 2"
CTES["x_tuned"] = f"SELECT *, CASE WHEN status = 'eligible' THEN row_number() OVER (PARTITION BY period_id, status ORDER BY round(sortino, 9) DESC, round(abs(max_drawdown), 9), round(cagr, 9) DESC, round(costs, 9), param_hash) END AS rank FROM (SELECT *, CASE WHEN reason IS NULL THEN 'eligible' ELSE 'failed' END AS status FROM (SELECT p.period_id, g.*, coalesce(n_folds, 0) AS n_folds, sortino, max_drawdown, costs, pow(last, 365.25 / date_diff('day', since, upto)) - 1 AS cagr, CASE WHEN since IS NULL THEN 'insufficient_training' WHEN coalesce(n_folds, 0) < {FOLDS} THEN 'no_selection' WHEN sortino IS NULL THEN 'metrics_unavailable' END AS reason FROM x_periods p CROSS JOIN x_grid g LEFT JOIN (SELECT period_id, min(decision_date) AS since FROM x_fold GROUP BY 1) f ON f.period_id = p.period_id LEFT JOIN x_judged j ON j.period_id = p.period_id AND j.param_hash = g.param_hash))"
CTES["x_refit_ask"] = "SELECT p.period_id, train_start, decision_date, lookback, k, threshold, allocation FROM x_periods p JOIN x_tuned t ON t.period_id = p.period_id AND t.rank = 1"


def inputs(spark, sf):
    """The dense weekly panel, the periods and the risky symbols, landed once: the plan reads the panel many times."""
    land = partial(T.landed, spark)
    return land(L.union_calendar_ffill(A.weekly_levels(spark, sf), complete=False), "panel"), land(q_walk.periods(spark, sf), "periods"), land(q_walk.risky(spark, sf), "risky")


def tuned(spark, panel, periods, risky):
    grid = U.candidates(spark, LOOKBACKS, KS, THRESHOLDS, ALLOCATIONS)
    return U.tune_parameters(panel, periods, K.inner_folds(periods, FOLDS, max(LOOKBACKS)), risky, grid, n_folds=FOLDS, land=partial(T.landed, spark))


@query("period_id lookback k allocation status reason n_folds rank", "threshold sortino max_drawdown cagr costs", sql="SELECT * FROM x_tuned")
def tune_parameters(spark, sf):
    """Sixteen candidates on four inner months of each period's training."""
    return tuned(spark, *inputs(spark, sf))


@query("period_id param_hash rank", "sortino", sql="SELECT period_id, param_hash, rank, sortino FROM x_tuned WHERE status = 'eligible'")
def candidate_rank(spark, sf):
    return tuned(spark, *inputs(spark, sf)).where("status = 'eligible'")


@query("period_id lookback k allocation symbol regime", "threshold weight", sql=f"SELECT period_id, lookback, k, threshold, allocation, symbol, weight, regime FROM x_refit_ask JOIN ({_decisions('x_refit_ask', 'period_id')}) USING (period_id)")
def refit_winner(spark, sf):
    panel, periods, risky = inputs(spark, sf)
    return U.refit_winner(panel, periods, T.landed(spark, tuned(spark, panel, periods, risky), "tuned"), risky)
