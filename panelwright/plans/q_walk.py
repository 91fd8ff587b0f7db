"""Queries of combination search, walk-forward and regression operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelwright.operators import combos as C, metrics as M, regress as R, walk as K, windows as W
from panelwright.plans import q_nav
from panelwright.plans.q_matrix import _C, _LW, returns
from panelwright.plans.registry import CTES, SQL, query
from panelwright.sources import adapters as A

CTES["x_uni"] = "SELECT DISTINCT l_returnflag AS universe_id, symbol FROM x_sales"
CTES["x_pos"] = "SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS pos FROM (SELECT DISTINCT symbol FROM x_monthly)"
CTES["x_combo"] = "SELECT row_number() OVER (ORDER BY a.pos, b.pos, c.pos) - 1 AS combo_rank, a.symbol AS s0, b.symbol AS s1, c.symbol AS s2 FROM x_pos a JOIN x_pos b ON b.pos > a.pos JOIN x_pos c ON c.pos > b.pos"
CTES["x_leg"] = "SELECT symbol, dt, value / first_value(value) OVER (PARTITION BY symbol ORDER BY dt) AS g FROM x_fill"
CTES["x_cnav"] = "SELECT combo_rank, s0, s1, s2, a.dt, (a.g + b.g + c.g) / 3 AS nav FROM x_combo JOIN x_leg a ON a.symbol = s0 JOIN x_leg b ON b.symbol = s1 AND b.dt = a.dt JOIN x_leg c ON c.symbol = s2 AND c.dt = a.dt"
CTES["x_cret"] = "SELECT *, nav / lag(nav) OVER w - 1 AS ret, nav / max(nav) OVER (PARTITION BY combo_rank ORDER BY dt) - 1 AS dd FROM x_cnav WINDOW w AS (PARTITION BY combo_rank ORDER BY dt)"
CTES["x_cmet"] = "SELECT combo_rank, s0 || '|' || s1 || '|' || s2 AS members, arg_max(nav, c.dt) - 1 AS total_return, pow(arg_max(nav, c.dt), 365.25 / date_diff('day', min(c.dt), max(c.dt))) - 1 AS cagr, min(dd) AS max_drawdown, stddev_samp(ret) * sqrt(12) AS volatility, avg(ret) * 12 / (sqrt(avg(CASE WHEN ret IS NOT NULL THEN pow(least(ret, 0), 2) END)) * sqrt(12)) AS sortino, covar_samp(ret, bret) / var_samp(CASE WHEN ret IS NOT NULL THEN bret END) AS beta FROM x_cret c JOIN x_bret b ON b.dt = c.dt GROUP BY combo_rank, s0, s1, s2"
_OK = "sortino IS NOT NULL AND max_drawdown IS NOT NULL AND 1 + cagr >= 0 AND 1 + beta > 1e-12"
_FORMS = {"stable_score": "(1 + cagr) / (1 + beta)", "growth_score": "(1 + cagr) / sqrt(1 + beta)", "drawdown_score": "(1 + cagr) / ((1 + beta) * (1 + abs(max_drawdown)))", "optimized_score": "(1 + cagr) / (pow(1 + beta, 2) * (1 + abs(max_drawdown)))"}
_SCORES = "SELECT *, " + ", ".join(f"CASE WHEN {_OK} THEN sortino * sqrt({x}) END AS {c}" for c, x in _FORMS.items()) + " FROM x_cmet"
_METRICS = "total_return cagr max_drawdown volatility sortino beta"


def universes(spark, sf):
    return A.sales(spark, sf).select(F.col("l_returnflag").alias("universe_id"), "symbol").distinct()


@query("universe_id n combinations", sql="SELECT universe_id, count(*) AS n, CAST(count(*) * (count(*) - 1) * (count(*) - 2) * (count(*) - 3) // 24 AS BIGINT) AS combinations FROM x_uni GROUP BY 1")
def combination_count(spark, sf):
    return C.combination_counts(universes(spark, sf), 4)


_K = " ".join(f"WHEN {p} <= 500000 THEN {k}" for k, p in ((k, " * ".join(f"(n - {k} + {i}) / {i}.0" for i in range(1, k + 1))) for k in range(10, 0, -1)))


@query("universe_id n k", sql=f"SELECT universe_id, n, CAST(CASE {_K} END AS BIGINT) AS k FROM (SELECT universe_id, count(*) AS n FROM x_uni GROUP BY 1)")
def recommended_holdings(spark, sf):
    return C.recommended_holdings(universes(spark, sf))


_MODES = ("never", "monthly", "quarterly", "annually")
CTES["x_leg3"] = "SELECT combo_rank, a.dt, a.g AS g0, b.g AS g1, c.g AS g2 FROM x_combo JOIN x_leg a ON a.symbol = s0 JOIN x_leg b ON b.symbol = s1 AND b.dt = a.dt JOIN x_leg c ON c.symbol = s2 AND c.dt = a.dt"
CTES["x_start"] = f"SELECT mode, dt AS s, lag(dt) OVER w AS p, lead(dt) OVER w AS nxt FROM (SELECT dt, lag(dt) OVER (ORDER BY dt) AS b FROM (SELECT DISTINCT dt FROM x_fill)), (SELECT unnest({list(_MODES)}) AS mode) WHERE b IS NULL OR CASE mode WHEN 'monthly' THEN date_trunc('month', dt) <> date_trunc('month', b) WHEN 'quarterly' THEN date_trunc('quarter', dt) <> date_trunc('quarter', b) WHEN 'annually' THEN year(dt) <> year(b) ELSE false END WINDOW w AS (PARTITION BY mode ORDER BY dt)"
_TRADED = "(abs(f / 3 - w0) + abs(f / 3 - w1) + abs(f / 3 - w2))"
_FIXED = "SELECT *, 1.0 AS f FROM (SELECT *, coalesce(r0 / 3 / growth, 0) AS w0, coalesce(r1 / 3 / growth, 0) AS w1, coalesce(r2 / 3 / growth, 0) AS w2 FROM (SELECT *, coalesce((r0 + r1 + r2) / 3, 1) AS growth FROM (SELECT mode, l.combo_rank, t.s, t.p, t.nxt, l.g0 / q.g0 AS r0, l.g1 / q.g1 AS r1, l.g2 / q.g2 AS r2 FROM x_start t JOIN x_leg3 l ON l.dt = t.s LEFT JOIN x_leg3 q ON q.dt = t.p AND q.combo_rank = l.combo_rank)))"
for _ in range(6):
    _FIXED = f"SELECT * REPLACE (1 - 0.001 * {_TRADED} AS f) FROM ({_FIXED})"
CTES["x_reset"] = f"SELECT *, level / f * {_TRADED} AS gross, level / f * (1 - f) AS cost FROM (SELECT *, exp(sum(ln(growth * f)) OVER (PARTITION BY mode, combo_rank ORDER BY s)) AS level FROM ({_FIXED}))"
CTES["x_rnav"] = "SELECT r.mode, r.combo_rank, x.dt, r.level * (x.g0 / y.g0 + x.g1 / y.g1 + x.g2 / y.g2) / 3 AS nav FROM x_reset r JOIN x_leg3 y ON y.combo_rank = r.combo_rank AND y.dt = r.s JOIN x_leg3 x ON x.combo_rank = r.combo_rank AND x.dt >= r.s AND (r.nxt IS NULL OR x.dt < r.nxt)"
CTES["x_rmet"] = "SELECT n.mode, n.combo_rank, s0 || '|' || s1 || '|' || s2 AS members, last - 1 AS total_return, pow(last, 1 / years) - 1 AS cagr, least(dd, 0) AS max_drawdown, vol AS volatility, CASE WHEN down > 1e-12 THEN mean * 12 / down END AS sortino, beta, (mean - beta * bmean) * 12 AS alpha, gross / (2 * avg_nav) / years AS turnover, rebalances, cost FROM (SELECT mode, combo_rank, arg_max(nav, q.dt) AS last, date_diff('day', min(q.dt), max(q.dt)) / 365.25 AS years, min(nav / greatest(1, top) - 1) AS dd, stddev_samp(ret) * sqrt(12) AS vol, avg(ret) AS mean, sqrt(avg(CASE WHEN ret IS NOT NULL THEN pow(least(ret, 0), 2) END) * 12) AS down, covar_samp(ret, bret) / var_samp(CASE WHEN ret IS NOT NULL THEN bret END) AS beta, avg(CASE WHEN ret IS NOT NULL THEN bret END) AS bmean, avg(nav) AS avg_nav FROM (SELECT *, nav / lag(nav) OVER w - 1 AS ret, max(nav) OVER w AS top FROM x_rnav WINDOW w AS (PARTITION BY mode, combo_rank ORDER BY dt)) q JOIN x_bret b ON b.dt = q.dt GROUP BY 1, 2) n JOIN (SELECT mode, combo_rank, sum(CASE WHEN p IS NOT NULL THEN gross ELSE 0 END) AS gross, count(p) AS rebalances, sum(cost) AS cost FROM x_reset GROUP BY 1, 2) r ON r.mode = n.mode AND r.combo_rank = n.combo_rank JOIN x_combo c ON c.combo_rank = n.combo_rank"


def universe(spark, sf):
    """Names, dates, prices and the benchmark of the monthly panel: symbols times months."""
    names, dates, prices = C.price_matrix(q_nav.filled(spark, sf))
    b = {r.dt: r.value for r in A.benchmark_monthly(spark, sf).collect()}  # a value a month
    return names, dates, prices, np.array([b[d] for d in dates])


@query("combo_rank members", sql="SELECT combo_rank, s0 || '|' || s1 || '|' || s2 AS members FROM x_combo")
def enumerate_combos(spark, sf):
    """All triples of the symbols."""
    return combinations(spark, sf).withColumn("members", F.array_join("members", "|"))


def combinations(spark, sf):
    names = [r.symbol for r in A.monthly_levels(spark, sf).select("symbol").distinct().orderBy("symbol").collect()]  # a universe
    return C.enumerate_combos(C.combo_ranks(spark, len(names), 3), names, 3)


def evaluated(spark, sf, ranks=None, **options):
    """Metrics of all triples, or of those in the table ``ranks``."""
    names, dates, prices, bench = universe(spark, sf)
    df = C.evaluate_combos(C.combo_ranks(spark, len(names), 3) if ranks is None else ranks, names, dates, prices, bench, 3, **options)
    return df.withColumn("members", F.array_join("members", "|"))


@query("mode combo_rank members rebalances", _METRICS + " alpha turnover cost", sql="SELECT * FROM x_rmet")
def evaluate_combos(spark, sf):
    """Ten metrics of all triples in four reset modes, at ten basis points, traded at the signal's date."""
    return evaluated(spark, sf, modes=_MODES, cost_bps=10.0, delay=0)


@query("combo_rank", "stable_score growth_score drawdown_score optimized_score", sql=_SCORES)
def combo_scores(spark, sf):
    return C.combo_scores(evaluated(spark, sf))


@query("combo_rank members", "optimized_score", sql=f"SELECT * FROM ({_SCORES}) ORDER BY optimized_score DESC NULLS LAST, combo_rank LIMIT 1")
def best_combo(spark, sf):
    return C.best_combo(C.combo_scores(evaluated(spark, sf)), "optimized_score")


@query("combo_rank", _METRICS, sql="SELECT * FROM x_cmet WHERE sortino >= 0.5 AND abs(max_drawdown) <= 0.6")
def combo_metric_filter(spark, sf):
    return C.combo_metric_filter(evaluated(spark, sf), sortino=0.5, drawdown=0.6)


@query("combo_rank position", "max_drawdown", sql="SELECT * FROM (SELECT combo_rank, max_drawdown, row_number() OVER (ORDER BY abs(max_drawdown) DESC NULLS LAST, combo_rank) AS position FROM x_cmet) WHERE position BETWEEN 21 AND 40")
def combo_sort_page(spark, sf):
    from panelwright.operators.screen import sort_page

    return sort_page(evaluated(spark, sf), F.abs("max_drawdown"), 1, 20, tie="combo_rank")


@query("combo_rank members", _METRICS, sql=f"SELECT * FROM x_cmet WHERE combo_rank IN (SELECT combo_rank FROM ({_SCORES}) ORDER BY optimized_score DESC NULLS LAST, combo_rank LIMIT 20)")
def combo_materialize(spark, sf):
    """The metrics of the twenty best triples, whose ranks alone are kept of the search."""
    top = C.combo_scores(evaluated(spark, sf)).orderBy(F.desc_nulls_last("optimized_score"), "combo_rank").limit(20)
    return evaluated(spark, sf, ranks=top.select("combo_rank"))


_PLAN = (("stable", "stable_score"), ("growth", "growth_score"), ("drawdown", "drawdown_score"), ("sortino", "sortino"), ("cagr", "cagr"), ("mdd", "-abs(max_drawdown)"))
_PLACES = "SELECT combo_rank, 'primary' AS reason, 0 AS p, n FROM placed WHERE n <= 180 UNION ALL " + " UNION ALL ".join(f"SELECT combo_rank, '{r}', {i}, n{i} FROM placed WHERE n{i} <= 15" for i, (r, _) in enumerate(_PLAN, 1)) + " UNION ALL SELECT combo_rank, 'diversity', 7, n7 FROM placed WHERE n7 <= 30 UNION ALL SELECT combo_rank, 'primary', 8, n FROM placed WHERE n <= 300"


@query(
    "combo_rank reason",
    "optimized_score",
    sql=f"WITH placed AS (SELECT *, row_number() OVER (ORDER BY optimized_score DESC NULLS LAST, combo_rank) AS n, {', '.join(f'row_number() OVER (ORDER BY {c} DESC NULLS LAST, combo_rank) AS n{i}' for i, (_, c) in enumerate(_PLAN, 1))}, row_number() OVER (ORDER BY md5('1:' || combo_rank), combo_rank) AS n7 FROM ({_SCORES})) SELECT combo_rank, reason, optimized_score FROM (SELECT * FROM (SELECT * FROM ({_PLACES}) QUALIFY row_number() OVER (PARTITION BY combo_rank ORDER BY p) = 1) ORDER BY p, n LIMIT 300) JOIN (SELECT combo_rank, optimized_score FROM placed) USING (combo_rank)",
)
def retention_plan(spark, sf):
    """Three hundred of the triples and why each is kept."""
    from panelwright.operators.screen import retention_plan

    rows = C.combo_scores(evaluated(spark, sf))
    secondary = {r: -F.abs("max_drawdown") if r == "mdd" else F.col(c) for r, c in _PLAN}
    return retention_plan(rows, 300, primary=F.col("optimized_score"), secondary=secondary, key="combo_rank")


def periods(spark, sf):
    """All months with a year of the panel before the decision and a complete month after it."""
    day = F.to_date("l_shipdate")
    a, b = A.table(spark, sf, "lineitem").agg(F.min(day), F.max(day)).first()  # two dates
    n = 12 * (b.year - a.year) + b.month - a.month if a else 0
    return K.monthly_periods(spark.range(1).select(F.lit(b).cast("date").alias("dt")), max(n, 1)).where(F.col("train_start") >= F.lit(a))


@query("period_id train_start train_end decision_date eval_start eval_end", sql="SELECT strftime(e, '%Y-%m') AS period_id, CAST(last_day(CAST(e - INTERVAL 12 MONTH AS DATE)) + 1 AS DATE) AS train_start, e AS train_end, e AS decision_date, CAST(e + 1 AS DATE) AS eval_start, last_day(CAST(e + 1 AS DATE)) AS eval_end FROM (SELECT last_day(CAST(d - to_months(CAST(i AS INTEGER)) AS DATE)) AS e FROM (SELECT CAST(date_trunc('month', max(dt)) AS DATE) - 1 AS d FROM x_bd), (SELECT unnest(range(1, 25)) AS i))")
def monthly_periods(spark, sf):
    return K.monthly_periods(A.benchmark_daily(spark, sf), 24)


@query("period_id reason", sql="SELECT period_id, 'overlap' AS reason FROM x_periods WHERE period_id IN ('1998-01', '1998-07') UNION ALL SELECT period_id, 'evaluation_before_decision' FROM x_periods WHERE period_id IN ('1998-01', '1998-07') UNION ALL SELECT period_id, 'too_long' FROM x_periods WHERE period_id IN ('1998-01', '1998-07')")
def validate_schedule(spark, sf):
    p = periods(spark, sf)
    return K.schedule_violations(p.withColumn("eval_start", F.when(F.col("period_id").isin("1998-01", "1998-07"), F.date_sub("eval_start", 20)).otherwise(F.col("eval_start"))))


@query("period_id fold inner_start inner_end eval_start eval_end", sql="SELECT * FROM (SELECT period_id, i AS fold, CAST(date_trunc('month', e) - INTERVAL 6 MONTH AS DATE) AS inner_start, CAST(CAST(date_trunc('month', e) AS DATE) - 1 AS DATE) AS inner_end, CAST(date_trunc('month', e) AS DATE) AS eval_start, e AS eval_end, train_start, train_end FROM (SELECT *, last_day(CAST(train_end - to_months(CAST(i AS INTEGER)) AS DATE)) AS e FROM x_periods, (SELECT unnest(range(0, 8)) AS i))) WHERE inner_start >= train_start AND eval_end <= train_end")
def inner_folds(spark, sf):
    return K.inner_folds(periods(spark, sf), 8, 6)


@query("period_id symbol n", sql="SELECT period_id, symbol, count(*) AS n FROM x_daily d JOIN x_periods p ON d.dt BETWEEN p.train_start AND p.train_end GROUP BY 1, 2")
def slice_panel(spark, sf):
    return K.slice_panel(A.daily_levels(spark, sf), periods(spark, sf), "train_start", "train_end").groupBy("period_id", "symbol").agg(F.count(F.lit(1)).alias("n"))


CTES["x_mom"] = "SELECT period_id, symbol, y / x - 1 AS momentum FROM (SELECT period_id, symbol, arg_min(value, dt) AS x, arg_max(value, dt) AS y, min(dt) AS a, max(dt) AS b, any_value(s) AS s, any_value(decision_date) AS d FROM x_weekly w JOIN (SELECT *, CAST(decision_date - INTERVAL 6 MONTH AS DATE) AS s FROM x_periods) p ON w.dt BETWEEN p.s AND p.decision_date GROUP BY 1, 2) WHERE date_diff('day', s, a) <= 7 AND date_diff('day', b, d) <= 7"
_RISKY = "CAST(regexp_extract(symbol, '(\\d+)$', 1) AS INTEGER) % 3 <> 0"
CTES["x_dual"] = f"SELECT period_id, symbol, 1.0 / count(*) OVER (PARTITION BY period_id) AS weight, CASE WHEN on_ THEN 'risky' ELSE 'defensive' END AS regime FROM (SELECT * FROM (SELECT *, bool_or({_RISKY} AND momentum > 0.1) OVER (PARTITION BY period_id) AS on_ FROM x_mom) WHERE CASE WHEN on_ THEN {_RISKY} AND momentum > 0.1 ELSE NOT ({_RISKY}) END QUALIFY row_number() OVER (PARTITION BY period_id ORDER BY momentum DESC, symbol) <= 4)"


def momentum(spark, sf):
    return K.trailing_momentum(A.weekly_levels(spark, sf), periods(spark, sf), 6)


def risky(spark, sf):
    s = A.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()
    return s.where(A.brand_number(F.col("symbol")) % 3 != 0)


@query("period_id symbol", "momentum", sql="SELECT * FROM x_mom")
def trailing_momentum(spark, sf):
    return momentum(spark, sf)


@query("period_id symbol rank", sql="SELECT period_id, symbol, row_number() OVER (PARTITION BY period_id ORDER BY momentum DESC, symbol) AS rank FROM x_mom")
def relative_momentum_rank(spark, sf):
    return K.momentum_rank(momentum(spark, sf))


@query("period_id symbol rank", sql="SELECT period_id, symbol, row_number() OVER (PARTITION BY period_id ORDER BY momentum DESC, symbol) AS rank FROM x_mom QUALIFY row_number() OVER (PARTITION BY period_id ORDER BY momentum DESC, symbol) <= 4")
def momentum_top_k(spark, sf):
    return K.momentum_rank(momentum(spark, sf)).where("rank <= 4")


def decided(spark, sf):
    return K.dual_momentum(momentum(spark, sf), risky(spark, sf), k=4, threshold=0.1)


@query("period_id symbol regime", "weight", sql="SELECT * FROM x_dual")
def dual_momentum(spark, sf):
    return decided(spark, sf)


@query("period_id decision_hash", sql="SELECT period_id, sha256(string_agg(symbol || '=' || CAST(CAST(floor(weight * 1000000 + 0.5) AS BIGINT) AS VARCHAR), '|' ORDER BY symbol || '=' || CAST(CAST(floor(weight * 1000000 + 0.5) AS BIGINT) AS VARCHAR))) AS decision_hash FROM x_dual GROUP BY 1")
def decision_hash(spark, sf):
    return K.decision_hash(decided(spark, sf))


@query("period_id symbol", sql="SELECT period_id, symbol FROM x_dual d WHERE NOT EXISTS (SELECT 1 FROM x_daily x JOIN x_periods p ON x.dt BETWEEN p.eval_start AND CAST(p.eval_start + 2 AS DATE) WHERE p.period_id = d.period_id AND x.symbol = d.symbol)")
def evaluation_check(spark, sf):
    short = periods(spark, sf).withColumn("eval_end", F.date_add("eval_start", 2))
    return K.evaluation_check(decided(spark, sf), K.slice_panel(A.daily_levels(spark, sf), short, "eval_start", "eval_end"))


_LEGS = "SELECT i, d.period_id, d.symbol, d.weight, (SELECT arg_max(value, dt) FROM x_weekly w WHERE w.symbol = d.symbol AND w.dt <= p.decision_date) AS a, (SELECT arg_max(value, dt) FROM x_weekly w WHERE w.symbol = d.symbol AND w.dt <= p.eval_end) AS b FROM x_dual d JOIN (SELECT *, row_number() OVER (ORDER BY decision_date) AS i FROM x_periods) p ON p.period_id = d.period_id"


@query(
    "period_id",
    "growth turnover cost index equity",
    sql=f"WITH l AS (SELECT *, weight * b / a AS g FROM ({_LEGS})), g AS (SELECT period_id, i, sum(g) AS growth FROM l GROUP BY 1, 2), t AS (SELECT i, sum(abs(coalesce(new, 0) - coalesce(old, 0))) AS turnover FROM (SELECT coalesce(x.i, y.i) AS i, x.weight AS new, y.old FROM l x FULL JOIN (SELECT l.i + 1 AS i, symbol, g.growth, l.g / g.growth AS old FROM l JOIN g ON g.i = l.i) y ON y.i = x.i AND y.symbol = x.symbol) GROUP BY 1) SELECT *, index AS equity FROM (SELECT period_id, growth, turnover, turnover * 0.001 AS cost, exp(sum(ln(growth) + ln(1 - turnover * 0.001)) OVER (ORDER BY g.i)) AS index FROM g JOIN t ON t.i = g.i)",
)
def oos_chain(spark, sf):
    return K.oos_chain(A.weekly_levels(spark, sf), periods(spark, sf), decided(spark, sf))


@query("period_id symbol", "weight", sql="SELECT period_id, symbol, 1.0 / count(*) OVER (PARTITION BY period_id) AS weight FROM x_periods, (SELECT DISTINCT symbol FROM x_monthly)")
def configured_equal_weight(spark, sf):
    from pyspark.sql.window import Window

    s = A.monthly_levels(spark, sf).select("symbol").distinct()
    df = periods(spark, sf).select("period_id").crossJoin(s)
    return df.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("period_id")))


@query("symbol", "weight", sql=f"SELECT a AS symbol, 1 / sqrt(cov) / sum(1 / sqrt(cov)) OVER () AS weight FROM ({_LW}) WHERE a = b AND a IN (SELECT symbol FROM ({_C}) GROUP BY symbol HAVING count(ret) >= 24)")
def allocate_inverse_vol(spark, sf):
    return K.allocate_inverse_vol(returns(spark, sf))


@query("symbol n", "beta alpha r2", sql="SELECT symbol, count(*) AS n, regr_slope(ret, bret) AS beta, regr_intercept(ret, bret) AS alpha, regr_r2(ret, bret) AS r2 FROM x_pair GROUP BY symbol")
def market_ols(spark, sf):
    return R.simple_ols(M.benchmark_calendar_returns(A.monthly_levels(spark, sf), A.benchmark_monthly(spark, sf)))


def factors(spark, sf):
    r = W.daily_returns(A.kind_levels(spark, sf)).where("ret is not null")
    return r.groupBy("dt").pivot("symbol").agg(F.first("ret"))


@query("symbol n", "alpha r2")
def factor_ols(spark, sf):
    """Monthly excess returns on the returns of the part types (a risk-free rate of 0.001 a month)."""
    f = factors(spark, sf)
    names = tuple(c for c in f.columns if c != "dt")
    rows = W.daily_returns(A.monthly_levels(spark, sf)).select("symbol", "dt", (F.col("ret") - 0.001).alias("y")).join(F.broadcast(f), "dt")
    return R.gram_ols(rows, names)


@query("symbol month_end", "ret mkt", sql="SELECT p.symbol, p.dt AS month_end, ret, bret AS mkt FROM x_ret p JOIN x_bret b ON b.dt = p.dt WHERE ret IS NOT NULL AND bret IS NOT NULL")
def factor_join(spark, sf):
    r = W.daily_returns(A.monthly_levels(spark, sf)).where("ret is not null")
    m = M.with_previous(A.benchmark_monthly(spark, sf)).where("bret is not null").select("dt", F.col("bret").alias("mkt"))
    return r.join(F.broadcast(m), "dt").select("symbol", F.col("dt").alias("month_end"), "ret", "mkt")


@query("portfolio_id status", "rate", sql="SELECT portfolio_id, 'unique' AS status, pow(arg_max(nav, dt) / arg_min(nav, dt), 365.2425 / date_diff('day', min(dt), max(dt))) - 1 AS rate FROM x_hold GROUP BY 1")
def xirr_batch(spark, sf):
    h = q_nav.hold(spark, sf)
    w = h.groupBy("portfolio_id").agg(F.min("dt").alias("a"), F.max("dt").alias("b"), F.min_by("nav", "dt").alias("x"), F.max_by("nav", "dt").alias("y"))
    flows = w.select("portfolio_id", F.col("a").alias("dt"), (-F.col("x")).alias("amount")).union(w.select("portfolio_id", "b", "y"))
    return R.xirr_batch(flows)
