"""Queries of regimes, experiments, allocations and the remaining small operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.functions import scalars as S
from panelwright.operators import matrix as X, metrics as M, nav as N, regress as R, walk as K, windows as W
from panelwright.plans import q_matrix, q_nav, q_walk
from panelwright.plans.registry import query
from panelwright.sources import adapters as A, files as T


@query("label n", sql="SELECT trim(regexp_replace('  ' || p_name || '   x ', '\\s+', ' ', 'g')) AS label, count(*) AS n FROM part GROUP BY 1")
def clean_text(spark, sf):
    return A.table(spark, sf, "part").select(S.clean_text(F.concat(F.lit("  "), "p_name", F.lit("   x "))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("parsed n", sql="SELECT CAST(o_orderdate AS DATE) AS parsed, count(*) AS n FROM orders GROUP BY 1")
def parse_first_trade(spark, sf):
    at = F.unix_timestamp(F.to_timestamp("o_orderdate")) + 43_200
    text = F.when(F.col("o_orderkey") % 2 == 0, at).otherwise(at * 1000).cast("string")
    return A.table(spark, sf, "orders").select(S.first_trade_date(text, F.lit("UTC")).alias("parsed")).groupBy("parsed").agg(F.count(F.lit(1)).alias("n"))


def _regime_sql(low: str, high: str) -> str:
    return f"SELECT series_id, dt, yoy, CASE WHEN d IS NOT NULL THEN CASE WHEN yoy >= m THEN '{high}' ELSE '{low}' END || ' ' || CASE WHEN d >= 0 THEN 'rising' ELSE 'falling' END END AS regime FROM (SELECT *, yoy - lag(yoy) OVER (PARTITION BY series_id ORDER BY dt) AS d, quantile_cont(yoy, 0.5) OVER (PARTITION BY series_id) AS m FROM (SELECT symbol AS series_id, dt, value / lag(value, 12) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS yoy FROM x_kind))"


def _series(spark, sf):
    return A.kind_levels(spark, sf).withColumnRenamed("symbol", "series_id")


@query("series_id dt regime", "yoy", sql=_regime_sql("low", "high"))
def inflation_regime(spark, sf):
    return W.direction_regime(_series(spark, sf), "low", "high")


@query("series_id dt regime", "yoy", sql=_regime_sql("contraction", "expansion"))
def business_cycle_regime(spark, sf):
    return W.direction_regime(_series(spark, sf), "contraction", "expansion")


@query("portfolio_id dt", "real", sql="SELECT portfolio_id, dt, nav / (p / first_value(p) OVER (PARTITION BY portfolio_id ORDER BY dt)) AS real FROM (SELECT h.*, b.value AS p FROM x_hold h JOIN x_bm b ON b.dt = h.dt)")
def inflation_adjusted(spark, sf):
    return W.inflation_adjusted(q_nav.hold(spark, sf), A.benchmark_monthly(spark, sf))


@query("symbol", "sharpe sortino", sql="SELECT symbol, coalesce(avg(ret) * 252 / nullif(stddev_samp(ret) * sqrt(252), 0), 0) AS sharpe, coalesce(avg(ret) * 252 / nullif(sqrt(avg(CASE WHEN ret IS NOT NULL THEN pow(least(ret, 0), 2) END)) * sqrt(252), 0), 0) AS sortino FROM x_ret GROUP BY symbol")
def metrics_legacy(spark, sf):
    """The older variant: ratios are 0 where the current ones are null."""
    r = M.metrics_report(A.monthly_levels(spark, sf), A.benchmark_monthly(spark, sf))
    return r.fillna(0.0, subset=["sharpe", "sortino"])


@query("dt flag", sql="SELECT dt, coalesce(lag(flag, 2) OVER (ORDER BY dt), false) AS flag FROM x_flag")
def execution_delay(spark, sf):
    return W.delayed_flags(q_nav.flags(spark, sf), 2)


_N = "v"
for _ in range(5):
    _N = f"(v - 0.01 * list_sum([abs({_N} * x.w - x.v) for x in legs]))"


@query("portfolio_id dt", "target", sql=f"SELECT portfolio_id, dt, {_N} AS target FROM (SELECT portfolio_id, dt, any_value(growth) AS v, list({{'w': weight, 'v': v}}) AS legs FROM x_mix WHERE flag GROUP BY 1, 2)")
def post_cost_nav(spark, sf):
    d = q_nav.N._segments(q_nav.filled(spark, sf), A.portfolios(spark, sf), q_nav.flags(spark, sf)).where("flag").withColumn("v", F.col("weight") * F.col("value") / F.col("base"))
    g = d.groupBy("portfolio_id", "dt").agg(F.sum("v").alias("value"), F.collect_list(F.struct(F.col("weight").alias("w"), "v")).alias("legs"))
    return g.withColumn("target", N.post_cost_target(F.col("value"), F.col("legs"), 0.01))


@query("portfolio_id symbol", "weight", sql="SELECT portfolio_id, symbol, 1.0 / count(*) OVER (PARTITION BY portfolio_id) AS weight FROM x_port")
def allocate_equal(spark, sf):
    return N.equal_weights(A.portfolios(spark, sf).select("portfolio_id", "symbol"))


@query("portfolio_id symbol", "weight")
def allocate_erc(spark, sf):
    return X.allocate_erc(X.ledoit_wolf(q_matrix.returns(spark, sf)), A.portfolios(spark, sf).where("portfolio_id LIKE 'P%'"))


_VOL = "SELECT d.period_id, d.symbol, 1 / stddev_samp(r.ret) AS iv FROM x_dual d JOIN x_periods p ON p.period_id = d.period_id JOIN (SELECT symbol, dt, value / lag(value) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS ret FROM x_weekly) r ON r.symbol = d.symbol AND r.dt BETWEEN p.train_start AND p.train_end GROUP BY 1, 2"


@query("period_id symbol", "weight", sql=f"SELECT period_id, symbol, iv / sum(iv) OVER (PARTITION BY period_id) AS weight FROM ({_VOL})")
def dual_momentum_allocated(spark, sf):
    r = K.slice_panel(W.daily_returns(A.weekly_levels(spark, sf)), q_walk.periods(spark, sf), "train_start", "train_end")
    iv = r.join(q_walk.decided(spark, sf).select("period_id", "symbol"), ["period_id", "symbol"]).groupBy("period_id", "symbol").agg((1 / F.stddev_samp("ret")).alias("iv"))
    return iv.withColumn("weight", F.col("iv") / F.sum("iv").over(Window.partitionBy("period_id")))


_GROWTH = "SELECT period_id, symbol, arg_max(value, dt) / arg_min(value, dt) AS g FROM x_weekly w JOIN x_periods p ON w.dt BETWEEN p.train_start AND p.train_end GROUP BY 1, 2"


@query("period_id a b", "score", sql=f"SELECT x.period_id, x.symbol AS a, y.symbol AS b, (x.g + y.g) / 2 - 1 AS score FROM ({_GROWTH}) x JOIN ({_GROWTH}) y ON x.period_id = y.period_id AND x.symbol < y.symbol QUALIFY row_number() OVER (PARTITION BY x.period_id ORDER BY round((x.g + y.g) / 2, 9) DESC, x.symbol, y.symbol) = 1")
def pick_combo_winner(spark, sf):
    """The best equal-weight pair of each period on training data alone."""
    t = K.slice_panel(A.weekly_levels(spark, sf), q_walk.periods(spark, sf), "train_start", "train_end").groupBy("period_id", "symbol").agg((F.max_by("value", "dt") / F.min_by("value", "dt")).alias("g"))
    pairs = t.select("period_id", F.col("symbol").alias("a"), F.col("g").alias("_x")).join(t.select("period_id", F.col("symbol").alias("b"), F.col("g").alias("_y")), "period_id").where("a < b")
    score = (F.col("_x") + F.col("_y")) / 2
    order = Window.partitionBy("period_id").orderBy(F.round(score, 9).desc(), "a", "b")
    return pairs.withColumn("score", score - 1).withColumn("_n", F.row_number().over(order)).where("_n = 1")


@query("period_id reason", sql="SELECT period_id, 'gap' AS reason FROM x_periods WHERE period_id = '1998-06'")
def validate_monthly_schedule(spark, sf):
    return K.schedule_violations(q_walk.periods(spark, sf).where("period_id <> '1998-05'"))


@query("period_id inner_start", sql="SELECT period_id, CAST(date_trunc('month', train_end) - INTERVAL 3 MONTH - INTERVAL 6 MONTH AS DATE) AS inner_start FROM x_periods")
def tuning_training_start(spark, sf):
    return K.tuning_training_start(q_walk.periods(spark, sf), 4, 6)


@query("ticker name", "weight", sql="SELECT ticker, name, market_cap AS weight FROM x_fund WHERE sector <> 'SMALL'")
def read_fundamentals_supplement(spark, sf):
    """A bare list or an object with ``data``."""
    f = A.fundamentals(spark, sf).where("sector <> 'SMALL'")
    items = f.groupBy("sector").agg(F.collect_list(F.struct("ticker", "name", F.col("market_cap").alias("weight"))).alias("data"))
    text = F.when(F.col("sector") == "ECONOMY", F.to_json("data")).otherwise(F.to_json(F.struct("data", F.lit("2024-01-01").alias("asOf"))))
    kind = "array<struct<ticker:string,name:string,weight:double>>"
    parsed = F.coalesce(F.from_json("t", f"struct<data:{kind}>")["data"], F.from_json("t", kind))
    return items.select(text.alias("t")).select(F.explode(parsed).alias("r")).select("r.*")


@query("combo_rank members", sql="SELECT combo_rank, s0 || '|' || s1 || '|' || s2 AS members FROM x_combo")
def export_combo_csv(spark, sf):
    return T.export_scan_csv(q_walk.combinations(spark, sf).withColumn("members", F.array_join("members", "|"))).orderBy("combo_rank")


def _sets(spark, sf):
    s = A.monthly_levels(spark, sf).select("symbol").distinct()
    return s.where("symbol <= 'Brand#18'"), s.where("symbol > 'Brand#6'")


_VARIANTS = "WITH s AS (SELECT DISTINCT symbol FROM x_monthly), b AS (SELECT symbol FROM s WHERE symbol <= 'Brand#18'), c AS (SELECT symbol FROM s WHERE symbol > 'Brand#6') SELECT 'base' AS variant_id, symbol FROM b UNION SELECT '-' || x.symbol, b.symbol FROM b x, b WHERE b.symbol <> x.symbol UNION SELECT '+' || c.symbol, b.symbol FROM c, b UNION SELECT '+' || symbol, symbol FROM c UNION SELECT '-' || x.symbol || '+' || c.symbol, b.symbol FROM b x, c, b WHERE b.symbol <> x.symbol UNION SELECT '-' || x.symbol || '+' || c.symbol, c.symbol FROM b x, c"


@query("variant_id symbol", sql=_VARIANTS)
def experiment_variants(spark, sf):
    return X.experiment_variants(*_sets(spark, sf))


def snapshot(spark, sf):
    return X.structural_snapshot(q_matrix.returns(spark, sf), X.experiment_variants(*_sets(spark, sf)))


_SNAPSHOT = f"SELECT v.variant_id, count(*) FILTER (m.a = m.b) AS n, pow(sum(m.cov) FILTER (m.a = m.b), 2) / sum(m.cov * m.cov) AS participation_ratio, avg(m.cov / sqrt(x.cov * y.cov)) FILTER (m.a <> m.b) AS mean_rho FROM ({_VARIANTS}) v JOIN ({_VARIANTS}) w ON v.variant_id = w.variant_id JOIN ({q_matrix._FULL}) m ON m.a = v.symbol AND m.b = w.symbol JOIN ({q_matrix._FULL}) x ON x.a = m.a AND x.b = m.a JOIN ({q_matrix._FULL}) y ON y.a = m.b AND y.b = m.b GROUP BY 1"


@query("variant_id n", "participation_ratio mean_rho", sql=_SNAPSHOT)
def structural_snapshot(spark, sf):
    return snapshot(spark, sf)


@query("variant_id n", "d_participation d_rho", sql=f"WITH snapshots AS ({_SNAPSHOT}) SELECT s.variant_id, s.n, s.participation_ratio - b.participation_ratio AS d_participation, s.mean_rho - b.mean_rho AS d_rho FROM snapshots s JOIN snapshots b ON b.variant_id = 'base' WHERE s.variant_id <> 'base'")
def marginal_experiments(spark, sf):
    return X.marginal_experiments(snapshot(spark, sf))


@query("a b", "rho", sql=f"SELECT a, b, rho FROM ({q_matrix._CORR}) WHERE a > 'Brand#6' OR b > 'Brand#6'")
def pairs_touching(spark, sf):
    c, changed = X.correlations(q_matrix.returns(spark, sf)), _sets(spark, sf)[1].select("symbol")
    near = F.broadcast(changed.select(F.col("symbol").alias("_s")))
    return c.join(near, (F.col("a") == F.col("_s")) | (F.col("b") == F.col("_s")), "left_semi")


@query("confidence n", sql=None)
def redundancy_confidence(spark, sf):
    return X.redundancy_verdict(q_matrix.evidence(spark, sf)).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


@query("symbol n_daily n_weekly status", sql="SELECT d.symbol, n AS n_daily, m AS n_weekly, CASE WHEN n < 60 OR m < 357 THEN 'insufficient' ELSE 'ready' END AS status FROM (SELECT symbol, count(*) AS n FROM x_daily GROUP BY 1) d JOIN (SELECT symbol, count(*) AS m FROM x_weekly GROUP BY 1) w ON d.symbol = w.symbol")
def refinery_readiness(spark, sf):
    n = lambda df, c: df.groupBy("symbol").agg(F.count(F.lit(1)).alias(c))
    j = n(A.daily_levels(spark, sf), "n_daily").join(n(A.weekly_levels(spark, sf), "n_weekly"), "symbol")
    return j.withColumn("status", F.when((F.col("n_daily") < 60) | (F.col("n_weekly") < 357), "insufficient").otherwise("ready"))


@query("a b n", "share")
def window_cluster_agreement(spark, sf):
    return X.cocluster_share(q_matrix.window_clusters(q_matrix.weekly(spark, sf)), "horizon")


@query("a b n", "share")
def bootstrap_cocluster(spark, sf):
    return X.cocluster_share(q_matrix.bootstrap_clusters(spark, q_matrix.weekly(spark, sf)), "replicate")


def _factor_rows(spark, sf):
    f = q_walk.factors(spark, sf)
    names = tuple(c for c in f.columns if c != "dt")
    return W.daily_returns(A.monthly_levels(spark, sf)).select("symbol", "dt", (F.col("ret") - 0.001).alias("y")).join(F.broadcast(f), "dt"), names


@query("a b", "rho")
def factor_implied_corr(spark, sf):
    return implied(spark, sf)


def implied(spark, sf):
    rows, names = _factor_rows(spark, sf)
    cov = X.sample_covariance(W.daily_returns(A.kind_levels(spark, sf)).where("ret is not null"))
    return R.factor_implied_corr(R.gram_ols(rows, names), cov, names)


@query("portfolio_id n", "alpha r2")
def factor_fx_ols(spark, sf):
    """Portfolio returns on the factors and one return per currency."""
    f = q_walk.factors(spark, sf)
    fx = A.fx_levels(spark, sf).groupBy("currency", F.last_day("dt").alias("dt")).agg(F.max_by("level", "dt").alias("value"))
    fx = W.daily_returns(fx, "currency").where("ret is not null").groupBy("dt").pivot("currency").agg(F.first("ret"))
    fx = fx.toDF("dt", *[f"fx_{i}" for i in range(len(fx.columns) - 1)])
    names = tuple(c for c in [*f.columns, *fx.columns] if c != "dt")
    y = W.daily_returns(q_nav.hold(spark, sf).withColumnRenamed("nav", "value"), "portfolio_id").select("portfolio_id", "dt", F.col("ret").alias("y"))
    return R.gram_ols(y.join(F.broadcast(f), "dt").join(F.broadcast(fx), "dt"), names, key="portfolio_id", least=max(24, 3 * len(names)))


@query("portfolio_id n", "sse")
def style_weights(spark, sf):
    f = q_walk.factors(spark, sf)
    names = tuple(c for c in f.columns if c != "dt")
    y = W.daily_returns(q_nav.hold(spark, sf).withColumnRenamed("nav", "value"), "portfolio_id").select("portfolio_id", "dt", F.col("ret").alias("y"))
    return R.style_weights(y.join(F.broadcast(f), "dt"), names)


@query("symbol reason n", sql="SELECT c.symbol, CASE WHEN NOT is_base THEN 'currency' WHEN n < 80 THEN 'short_history' END AS reason, n FROM x_conv c JOIN (SELECT symbol, count(ret) AS n FROM x_ret GROUP BY 1) r ON r.symbol = c.symbol")
def factor_eligibility(spark, sf):
    return eligibility(spark, sf)


def eligibility(spark, sf):
    n = W.daily_returns(A.monthly_levels(spark, sf)).groupBy("symbol").agg(F.count("ret").alias("n"))
    j = A.quote_conventions(spark, sf).join(n, "symbol")
    return j.withColumn("reason", F.when(~F.col("is_base"), "currency").when(F.col("n") < 80, "short_history"))
