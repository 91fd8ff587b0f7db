"""Queries of covariance, correlation, risk and relationship operators on monthly returns of 25 symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from panelwright.operators import matrix as X, metrics as M, windows as W
from panelwright.operators.clean import complete_case
from panelwright.plans.registry import CTES, query
from panelwright.sources import adapters as A, files as S

_C = "SELECT symbol, dt, ret FROM x_ret WHERE ret IS NOT NULL AND dt IN (SELECT dt FROM x_ret WHERE ret IS NOT NULL GROUP BY dt HAVING count(*) = (SELECT count(DISTINCT symbol) FROM x_ret WHERE ret IS NOT NULL))"
_P = f"SELECT p.symbol AS a, q.symbol AS b, p.dt, p.ret AS x, q.ret AS y FROM ({_C}) p JOIN ({_C}) q ON p.dt = q.dt"
_COV = f"SELECT a, b, covar_samp(x, y) * 252 AS cov FROM ({_P}) WHERE a <= b GROUP BY a, b"
_FULL = f"SELECT a, b, covar_samp(x, y) * 252 AS cov FROM ({_P}) GROUP BY a, b"
_CORR = f"SELECT a, b, count(*) AS n, corr(x, y) AS rho FROM ({_P}) WHERE a < b GROUP BY a, b"


def returns(spark, sf):
    """Complete monthly returns."""
    return complete_case(W.daily_returns(A.monthly_levels(spark, sf)).where("ret is not null").select("symbol", "dt", "ret"), "ret")


def bench(spark, sf):
    return M.with_previous(A.benchmark_monthly(spark, sf)).where("bret is not null").select("dt", "bret")


@query("a b", "cov", sql=_COV)
def sample_covariance(spark, sf):
    return X.sample_covariance(returns(spark, sf))


_LW = f"""
WITH c AS (SELECT symbol, dt, ret - avg(ret) OVER (PARTITION BY symbol) AS ret FROM ({_C})),
p AS (SELECT p.symbol AS a, q.symbol AS b, avg(p.ret * q.ret) AS s, avg(p.ret * p.ret * q.ret * q.ret) AS q, count(*) AS n FROM c p JOIN c q ON p.dt = q.dt GROUP BY 1, 2),
t AS (SELECT count(*) FILTER (a = b) AS k, sum(s) FILTER (a = b) / count(*) FILTER (a = b) AS mu, sum(s * s) AS ss, sum(q) AS qq, max(n) AS n FROM p),
u AS (SELECT mu, least((qq - ss) / (n * k), (ss - k * mu * mu) / k) / ((ss - k * mu * mu) / k) AS shrinkage FROM t)
SELECT a, b, ((1 - shrinkage) * s + CASE WHEN a = b THEN shrinkage * mu ELSE 0 END) * 252 AS cov, shrinkage FROM p, u WHERE a <= b
"""


@query("a b", "cov shrinkage", sql=_LW)
def ledoit_wolf(spark, sf):
    return X.ledoit_wolf(returns(spark, sf))


@query(
    "a b",
    "cov",
    sql=f"WITH w AS (SELECT symbol, dt, ret, pow(0.94, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) - 1) AS w FROM ({_C})), n AS (SELECT symbol, dt, ret, w / sum(w) OVER (PARTITION BY symbol) AS w FROM w), c AS (SELECT symbol, dt, w, ret - sum(w * ret) OVER (PARTITION BY symbol) AS r FROM n) SELECT p.symbol AS a, q.symbol AS b, sum(p.w * p.r * q.r) * 252 AS cov FROM c p JOIN c q ON p.dt = q.dt WHERE p.symbol <= q.symbol GROUP BY 1, 2",
)
def ewma_covariance(spark, sf):
    return X.ewma_covariance(returns(spark, sf))


@query("a b n status", "rho", sql=f"SELECT a, b, count(*) AS n, corr(x, y) AS rho, 'ok' AS status FROM ({_P}) WHERE a < b AND dt IN (SELECT DISTINCT dt FROM ({_C}) ORDER BY dt DESC LIMIT 36) GROUP BY a, b")
def correlation_matrix(spark, sf):
    return X.correlation_matrix(W.daily_returns(A.monthly_levels(spark, sf)), 36)


_H = " UNION ALL ".join(f"SELECT a, b, count(*) AS n, CASE WHEN count(*) >= {k} THEN corr(x, y) END AS rho, '{h}' AS horizon FROM ({_P}) WHERE a < b AND dt IN (SELECT DISTINCT dt FROM ({_C}) ORDER BY dt DESC LIMIT {m}) GROUP BY a, b" for h, m, k in (("short", 12, 6), ("medium", 36, 24), ("long", 72, 48)))


@query("a b n horizon", "rho", sql=_H)
def multi_horizon_correlation(spark, sf):
    r = returns(spark, sf)
    return X.multi_horizon_correlation({"short": (r, 12, 6), "medium": (r, 36, 24), "long": (r, 72, 48)})


@query("a b n", "rho", sql=f"SELECT a, b, count(*) AS n, CASE WHEN count(*) >= 20 THEN corr(x, y) END AS rho FROM ({_P}) WHERE a < b AND dt IN (SELECT dt FROM x_bret WHERE bret < 0) GROUP BY a, b")
def downside_correlation(spark, sf):
    return X.downside_correlation(returns(spark, sf), bench(spark, sf))


@query("a b n", "rho", sql=f"SELECT a, b, count(*) AS n, CASE WHEN count(*) >= 5 THEN corr(x, y) END AS rho FROM ({_P}) WHERE a < b AND dt IN (SELECT dt FROM x_bret WHERE bret <= (SELECT quantile_cont(bret, 0.1) FROM x_bret)) GROUP BY a, b")
def stress_correlation(spark, sf):
    return X.stress_correlation(returns(spark, sf), bench(spark, sf))


@query("", "participation_ratio", sql=f"SELECT pow(sum(cov) FILTER (a = b), 2) / sum(cov * cov) AS participation_ratio FROM ({_FULL})")
def participation_ratio(spark, sf):
    return X.participation_ratio(X.sample_covariance(returns(spark, sf)))


@query("", "dispersion", sql=f"SELECT sqrt(sum(pow(cov - lw, 2))) / greatest(sqrt(sum(cov * cov)), sqrt(sum(lw * lw))) AS dispersion FROM (SELECT f.cov, l.cov AS lw FROM ({_FULL}) f JOIN ({_LW.replace('WHERE a <= b', '')}) l ON f.a = l.a AND f.b = l.b)")
def estimator_dispersion(spark, sf):
    r = returns(spark, sf)
    return X.estimator_dispersion(X.sample_covariance(r), X.ledoit_wolf(r))


_RC = f"SELECT portfolio_id, symbol, weight, s / sqrt(v) AS marginal, weight * s / sqrt(v) AS component, v AS variance FROM (SELECT *, sum(weight * s) OVER (PARTITION BY portfolio_id) AS v FROM (SELECT p.portfolio_id, p.symbol, p.weight, sum(cov * q.weight) AS s FROM x_port p JOIN x_port q ON p.portfolio_id = q.portfolio_id JOIN ({_FULL}) m ON m.a = p.symbol AND m.b = q.symbol GROUP BY 1, 2, 3))"


def contributions(spark, sf):
    return X.sample_covariance(returns(spark, sf)), A.portfolios(spark, sf)


@query("portfolio_id symbol", "weight marginal component variance", sql=_RC)
def risk_contributions(spark, sf):
    return X.risk_contributions(*contributions(spark, sf))


@query("portfolio_id", "variance", sql=f"SELECT portfolio_id, max(variance) AS variance FROM ({_RC}) GROUP BY 1")
def portfolio_variance(spark, sf):
    return X.portfolio_variance(*contributions(spark, sf))


@query("portfolio_id", "diversification_ratio", sql=f"SELECT r.portfolio_id, sum(weight * sqrt(cov)) / sqrt(max(variance)) AS diversification_ratio FROM ({_RC}) r JOIN ({_FULL}) m ON m.a = r.symbol AND m.b = r.symbol GROUP BY 1")
def diversification_ratio(spark, sf):
    return X.diversification_ratio(*contributions(spark, sf))


@query("portfolio_id", "by_weight by_risk", sql=f"SELECT portfolio_id, 1 / sum(weight * weight) AS by_weight, 1 / sum(c * c) AS by_risk FROM (SELECT *, abs(component) / sum(abs(component)) OVER (PARTITION BY portfolio_id) AS c FROM ({_RC})) GROUP BY 1")
def effective_holdings(spark, sf):
    return X.effective_holdings(*contributions(spark, sf))


@query("estimator n rank is_psd", "min_eigen max_eigen entropy_rank")
def covariance_diagnostics(spark, sf):
    r = returns(spark, sf)
    both = X.sample_covariance(r).withColumn("estimator", F.lit("sample")).unionByName(X.ledoit_wolf(r).drop("shrinkage").withColumn("estimator", F.lit("ledoit_wolf")))
    return X.covariance_diagnostics(both)


@query("estimator", "entropy_rank")
def entropy_rank(spark, sf):
    return X.covariance_diagnostics(X.sample_covariance(returns(spark, sf)).withColumn("estimator", F.lit("sample")))


@query("a b", "distance", sql=f"SELECT a, b, sqrt(greatest((1 - rho) / 2, 0)) AS distance FROM ({_CORR})")
def correlation_distance(spark, sf):
    return X.correlation_distance(X.correlations(returns(spark, sf)))


@query("a b", "rho", sql=f"SELECT a, b, rho FROM ({_CORR}) ORDER BY abs(rho) DESC, a, b LIMIT 20")
def top_abs_correlations(spark, sf):
    return X.top_abs_correlations(X.correlations(returns(spark, sf)), 20)


def clusters(spark, sf, cut=0.6):
    d = X.correlation_distance(X.correlations(returns(spark, sf)))
    return X.hierarchical_clusters(d.withColumn("method", F.explode(F.array(F.lit("average"), F.lit("complete")))), cut=cut)


@query("method symbol cluster_id")
def hierarchical_clusters(spark, sf):
    return clusters(spark, sf)


@query("cluster_id n_pairs", "low mean high")
def cluster_summary(spark, sf):
    return X.cluster_summary(X.correlations(returns(spark, sf)), clusters(spark, sf).where("method = 'average'"))


@query("replicate step pos")
def bootstrap_index(spark, sf):
    """Positions in the panel's own complete months."""
    return X.bootstrap_index(spark, returns(spark, sf).select("dt").distinct().count())


@query("a b n", "stability")
def bootstrap_pair_corr(spark, sf):
    return X.pair_stability(bootstrapped(spark, weekly(spark, sf)), 0.2)


def _complete(levels: str) -> str:
    """Returns of a levels table on the dates on which every symbol has one."""
    r = f"SELECT symbol, dt, value / lag(value) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS ret FROM {levels}"
    return f"SELECT * FROM ({r}) WHERE ret IS NOT NULL AND dt IN (SELECT dt FROM ({r}) WHERE ret IS NOT NULL GROUP BY dt HAVING count(*) = (SELECT count(DISTINCT symbol) FROM ({r}) WHERE ret IS NOT NULL))"


CTES["x_wcomplete"] = f"SELECT * FROM ({_complete('x_weekly')}) WHERE dt IN (SELECT DISTINCT dt FROM ({_complete('x_weekly')}) ORDER BY dt DESC LIMIT 156)"
CTES["x_dcomplete"] = _complete("x_daily")
CTES["x_dbench"] = "SELECT dt, value / lag(value) OVER (ORDER BY dt) - 1 AS bret FROM x_bd"


def _rho(rows: str, name: str, least: int) -> str:
    return f"SELECT p.symbol AS a, q.symbol AS b, CASE WHEN count(*) >= {least} THEN corr(p.ret, q.ret) END AS {name} FROM ({rows}) p JOIN ({rows}) q ON p.dt = q.dt AND p.symbol < q.symbol GROUP BY 1, 2"


_FALLEN = "SELECT c.symbol, c.dt, c.ret FROM x_dcomplete c JOIN x_dbench b ON b.dt = c.dt WHERE bret "
_CUT = "(SELECT quantile_cont(bret, 0.1) FROM x_dbench WHERE bret IS NOT NULL AND dt IN (SELECT dt FROM x_dcomplete))"
_EV = f"SELECT s.a, s.b, structural, medium, downside, stress FROM ({_rho('SELECT * FROM x_wcomplete', 'structural', 52)}) s LEFT JOIN ({_rho('SELECT * FROM x_dcomplete WHERE dt IN (SELECT DISTINCT dt FROM x_dcomplete ORDER BY dt DESC LIMIT 252)', 'medium', 120)}) m ON m.a = s.a AND m.b = s.b LEFT JOIN ({_rho(_FALLEN + '< 0', 'downside', 20)}) d ON d.a = s.a AND d.b = s.b LEFT JOIN ({_rho(_FALLEN + f'<= {_CUT}', 'stress', 20)}) t ON t.a = s.a AND t.b = s.b"


def correlations(spark, sf, weekly_returns):
    """One frozen sample a horizon: 156 weekly and 252 daily complete returns; falls and the tenth of worst days of the benchmark on all daily ones."""
    r = S.landed(spark, complete_case(W.daily_returns(A.daily_levels(spark, sf)).where("ret is not null").select("symbol", "dt", "ret"), "ret"), "daily")
    b = M.with_previous(A.benchmark_daily(spark, sf)).where("bret is not null").select("dt", "bret")
    b = S.landed(spark, b.join(r.select("dt").distinct(), "dt", "left_semi"), "benchmark")
    return {"structural": X.correlations(weekly_returns, least=52), "medium": X.correlation_matrix(r, 252, least=120), "downside": X.downside_correlation(r, b), "stress": X.stress_correlation(r, b, least=20)}


@query("a b", "structural medium downside stress", sql=_EV)
def pair_correlations(spark, sf):
    """The correlations of ``pair_evidence``."""
    parts = [df.select("a", "b", F.col("rho").alias(c)) for c, df in correlations(spark, sf, weekly(spark, sf)).items()]
    return reduce(lambda x, y: x.join(y, ["a", "b"], "left"), parts)


def weekly(spark, sf, weeks=156):
    """The last complete weekly returns, landed once for the windows and replicates made of them."""
    r = complete_case(W.daily_returns(A.weekly_levels(spark, sf)).where("ret is not null").select("symbol", "dt", "ret"), "ret")
    last = r.select("dt").distinct().orderBy(F.desc("dt")).limit(weeks)
    return S.landed(spark, r.join(F.broadcast(last), "dt", "left_semi"), "weekly")


def window_clusters(r):
    d = X.correlation_distance(X.multi_horizon_correlation({f"{n} weeks": (r, n, 52) for n in (52, 104, 156)}))
    return X.hierarchical_clusters(d, key="horizon", linkage="average")


def bootstrapped(spark, r):
    return X.bootstrap_pair_corr(r, X.bootstrap_index(spark, r.select("dt").distinct().count()))


def bootstrap_clusters(spark, r):
    boot = bootstrapped(spark, r).withColumn("replicate", F.col("replicate").cast("string"))
    return X.hierarchical_clusters(X.correlation_distance(boot), key="replicate", linkage="average")


def evidence(spark, sf):
    """The evidence of all pairs. What rests on many scans or replicates is landed, so that no plan holds more than a few of them."""
    from panelwright.plans import q_more

    r = weekly(spark, sf)
    shared = correlations(spark, sf, r)
    d = X.correlation_distance(shared["structural"])
    groups = X.hierarchical_clusters(d.withColumn("method", F.explode(F.array(F.lit("average"), F.lit("complete")))))
    boot = S.landed(spark, X.cocluster_share(bootstrap_clusters(spark, r), "replicate"), "replicates")
    windows = S.landed(spark, X.cocluster_share(window_clusters(r), "horizon"), "windows")
    implied = S.landed(spark, q_more.implied(spark, sf), "implied")
    return X.pair_evidence(shared, S.landed(spark, groups, "clusters"), boot, windows, implied, q_more.eligibility(spark, sf).where("reason is null"))


_EVIDENCE = "structural medium downside stress factor bootstrap window_share"


@query("a b same_average same_complete factor_eligible n_windows n_replicates", _EVIDENCE)
def pair_evidence(spark, sf):
    return evidence(spark, sf)


@query("a b verdict confidence", _EVIDENCE)
def redundancy_verdict(spark, sf):
    return X.redundancy_verdict(evidence(spark, sf))
