"""Covariance, correlation and risk as pair aggregates on long panels ``(symbol, dt, ret)``.

Pairs are never joined by date: rows are dealt out by blocks of dates, each block's cross products are one small matrix product,
and the products are added by pair. Matrices are long and hold ``a <= b``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from panelwright.functions.scalars import EPSILON, safe_ratio
from panelwright.operators.clean import complete_case


SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "sxxyy")


def pairs(returns: DataFrame) -> DataFrame:
    """``a, b, dt, x, y`` for ``a <= b`` on each date."""
    left = returns.select("dt", F.col("symbol").alias("a"), F.col("ret").alias("x"))
    right = returns.select("dt", F.col("symbol").alias("b"), F.col("ret").alias("y"))
    return left.join(right, "dt").where(F.col("a") <= F.col("b"))


def gram(returns: DataFrame, *, keys: tuple[str, ...] = (), tile: int = 512) -> DataFrame:
    """``keys, a, b`` (``a <= b``) and :data:`SUMS` over the dates on which both have a return.

    Rows of one date meet in one task (``keys`` and date are the partitioning); a task multiplies its dates' matrices tile by tile
    of the symbols and gives out one row a pair, and these rows, not the dates, are what is added up. Rows without a
    return count nowhere; a symbol twice on a date is an error of the panel and its last row counts.
    """
    kinds = ", ".join(f"{c} {returns.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"{kinds + ', ' if keys else ''}a string, b string, {', '.join(f'{c} double' for c in SUMS)}"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b.to_pandas() for b in batches if b.num_rows]
        if not rows:
            return
        rows = pd.concat(rows)
        for key, part in rows.groupby(list(keys), dropna=False) if keys else [((), rows)]:
            names, at = np.unique(part["symbol"].to_numpy(), return_inverse=True)
            dates, on = np.unique(part["dt"].to_numpy(), return_inverse=True)
            x = np.full((len(dates), len(names)), np.nan)
            x[on, at] = part["ret"].to_numpy()
            known = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            for i in range(0, len(names), tile):
                for j in range(i, len(names), tile):
                    p, q, mp, mq = x[:, i : i + tile], x[:, j : j + tile], known[:, i : i + tile], known[:, j : j + tile]
                    made = (mp.T @ mq, p.T @ mq, mp.T @ q, (p * p).T @ mq, mp.T @ (q * q), p.T @ q, (p * p).T @ (q * q))
                    r, c = np.nonzero(made[0])
                    r, c = r[i + r <= j + c], c[i + r <= j + c]
                    own = [pa.array([k] * len(r)) for k in key]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(names[i + r], pa.string()), pa.array(names[j + c], pa.string()), *[pa.array(m[r, c]) for m in made]], [*keys, "a", "b", *SUMS])

    dealt = returns.where("ret is not null").select(*keys, "symbol", "dt", F.col("ret").cast("double").alias("ret")).repartition(*keys, "dt")
    return dealt.mapInArrow(sums, schema).groupBy(*keys, "a", "b").agg(*[F.sum(c).alias(c) for c in SUMS])


def _covar(x: str, y: str, xy: str) -> Column:
    return (F.col(xy) - F.col(x) * F.col(y) / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0.0))


def sample_covariance(returns: DataFrame, periods: int = 252, *, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairwise sample covariance of complete cases, annualised."""
    return gram(returns, keys=keys).select(*keys, "a", "b", (_covar("sx", "sy", "sxy") * periods).alias("cov"))


def ledoit_wolf(returns: DataFrame, periods: int = 252) -> DataFrame:
    """``a, b, cov, shrinkage``: the 1/n covariance of complete cases shrunk towards the mean variance times identity.

    All terms are pair aggregates of centred returns: ``avg(xy)``, ``avg(x^2 y^2)`` and sums over pairs.
    """
    mean = returns.groupBy("symbol").agg(F.avg("ret").alias("_m"))
    centred = returns.join(F.broadcast(mean), "symbol").select("symbol", "dt", (F.col("ret") - F.col("_m")).alias("ret"))
    p = gram(centred).select("a", "b", (F.col("sxy") / F.col("n")).alias("s"), (F.col("sxxyy") / F.col("n")).alias("q"), "n")
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    on = F.col("a") == F.col("b")
    t = p.agg(F.count_if(on).alias("p"), F.sum(F.when(on, F.col("s"))).alias("tr"), F.sum(twice * F.col("s") * F.col("s")).alias("ss"), F.sum(twice * F.col("q")).alias("qq"), F.max("n").alias("n"))
    mu = F.col("tr") / F.col("p")
    delta = (F.col("ss") - F.col("p") * mu * mu) / F.col("p")
    beta = F.least((F.col("qq") - F.col("ss")) / (F.col("n") * F.col("p")), delta)
    t = t.select(mu.alias("_mu"), F.coalesce(safe_ratio(beta, F.when(delta > 0, delta)), F.lit(0.0)).alias("shrinkage"))
    cov = (1 - F.col("shrinkage")) * F.col("s") + F.when(on, F.col("shrinkage") * F.col("_mu")).otherwise(0.0)
    return p.join(F.broadcast(t)).select("a", "b", (cov * periods).alias("cov"), "shrinkage")


def ewma_covariance(returns: DataFrame, decay: float = 0.94, periods: int = 252) -> DataFrame:
    """Weights ``decay ** age`` normalised to 1, weighted means removed."""
    age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt"))) - 1
    w = returns.withColumn("_w", F.pow(F.lit(decay), age))
    total = Window.partitionBy("symbol")
    w = w.withColumn("_w", F.col("_w") / F.sum("_w").over(total)).withColumn("_c", F.col("ret") - F.sum(F.col("_w") * F.col("ret")).over(total))
    weights = w.select("symbol", "dt", F.col("_w").alias("w"))
    p = pairs(w.select("symbol", "dt", F.col("_c").alias("ret")))
    p = p.join(weights, (p["a"] == weights["symbol"]) & (p["dt"] == weights["dt"]))
    return p.groupBy("a", "b").agg((F.sum(F.col("w") * F.col("x") * F.col("y")) * periods).alias("cov"))


def correlations(returns: DataFrame, *, least: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, a, b, n, rho`` for ``a < b``; null under ``least`` dates or without variation."""
    x, y = F.sqrt(F.greatest(_covar("sx", "sx", "sxx"), F.lit(0.0))), F.sqrt(F.greatest(_covar("sy", "sy", "syy"), F.lit(0.0)))
    enough = (F.col("n") >= least) & (x > 1e-15) & (y > 1e-15)
    return gram(returns, keys=keys).where("a < b").select(*keys, "a", "b", F.col("n").cast("bigint").alias("n"), F.when(enough, _covar("sx", "sy", "sxy") / (x * y)).alias("rho"))


def correlation_matrix(returns: DataFrame, n: int, *, least: int = 3) -> DataFrame:
    """Correlations over the last ``n`` complete dates, with ``status``: insufficient, degenerate or ok."""
    full = complete_case(returns.where("ret is not null"), "ret")
    last = full.select("dt").distinct().orderBy(F.desc("dt")).limit(n)
    c = correlations(full.join(F.broadcast(last), "dt", "left_semi"), least=least)
    return c.withColumn("status", F.when(F.col("n") < least, "insufficient").when(F.col("rho").isNull(), "degenerate").otherwise("ok"))


def multi_horizon_correlation(panels: dict[str, tuple[DataFrame, int, int]]) -> DataFrame:
    """The matrix for each ``horizon: (returns, dates, least dates)`` with a ``horizon`` column."""
    out = None
    for horizon, (returns, n, least) in panels.items():
        part = correlation_matrix(returns, n, least=least).withColumn("horizon", F.lit(horizon))
        out = part if out is None else out.unionByName(part)
    return out


def downside_correlation(returns: DataFrame, benchmark: DataFrame, *, least: int = 20) -> DataFrame:
    """Correlations on dates on which the benchmark fell."""
    return correlations(returns.join(benchmark.where("bret < 0").select("dt"), "dt", "left_semi"), least=least)


def stress_correlation(returns: DataFrame, benchmark: DataFrame, *, q: float = 0.1, least: int = 5) -> DataFrame:
    """Correlations on dates on which the benchmark is at or below its ``q`` quantile."""
    cut = benchmark.agg(F.percentile("bret", q).alias("_q"))
    dates = benchmark.join(F.broadcast(cut), F.col("bret") <= F.col("_q"), "left_semi").select("dt")
    return correlations(returns.join(dates, "dt", "left_semi"), least=least)


def participation_ratio(cov: DataFrame) -> DataFrame:
    """Squared trace over squared Frobenius norm: the effective number of dimensions without an eigenvalue."""
    on = F.col("a") == F.col("b")
    t = cov.agg(F.sum(F.when(on, F.col("cov"))).alias("tr"), F.sum(F.when(on, 1.0).otherwise(2.0) * F.col("cov") * F.col("cov")).alias("ss"))
    return t.select(safe_ratio(F.col("tr") * F.col("tr"), F.col("ss")).alias("participation_ratio"))


def estimator_dispersion(x: DataFrame, y: DataFrame) -> DataFrame:
    """Frobenius distance of two matrices over the larger norm."""
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    j = x.select("a", "b", F.col("cov").alias("p")).join(y.select("a", "b", F.col("cov").alias("q")), ["a", "b"])
    norm = lambda c: F.sqrt(F.sum(twice * c * c))
    return j.agg(safe_ratio(norm(F.col("p") - F.col("q")), F.greatest(norm(F.col("p")), norm(F.col("q")))).alias("dispersion"))


def _both_ways(cov: DataFrame) -> DataFrame:
    return cov.select("a", "b", "cov").union(cov.where("a <> b").select(F.col("b"), F.col("a"), "cov"))


def risk_contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """``portfolio_id, symbol, weight, marginal, component, variance`` of signed contributions to volatility; they add up to it."""
    m = _both_ways(cov)
    w = weights.select("portfolio_id", F.col("symbol").alias("b"), F.col("weight").alias("_wb"))
    row = m.join(w, "b").groupBy("portfolio_id", "a").agg(F.sum(F.col("cov") * F.col("_wb")).alias("_s"))
    own = weights.select("portfolio_id", "symbol", "weight").join(row.withColumnRenamed("a", "symbol"), ["portfolio_id", "symbol"])
    total = Window.partitionBy("portfolio_id")
    var = F.sum(F.col("weight") * F.col("_s")).over(total)
    df = own.withColumn("variance", F.when(var.between(-EPSILON, 0), 0.0).otherwise(var))
    marginal = safe_ratio(F.col("_s"), F.sqrt(F.col("variance")))
    return df.select("portfolio_id", "symbol", "weight", marginal.alias("marginal"), (F.col("weight") * marginal).alias("component"), "variance")


def portfolio_variance(cov: DataFrame, weights: DataFrame) -> DataFrame:
    return risk_contributions(cov, weights).groupBy("portfolio_id").agg(F.max("variance").alias("variance"))


def diversification_ratio(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean volatility over the portfolio's."""
    sd = cov.where("a = b").select(F.col("a").alias("symbol"), F.sqrt("cov").alias("_sd"))
    g = risk_contributions(cov, weights).join(sd, "symbol").groupBy("portfolio_id").agg(F.sum(F.col("weight") * F.col("_sd")).alias("_x"), F.max("variance").alias("_v"))
    return g.select("portfolio_id", safe_ratio(F.col("_x"), F.sqrt("_v")).alias("diversification_ratio"))


def effective_holdings(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """``by_weight``: 1 / sum of squared weights; ``by_risk``: the same of the shares of absolute risk contributions."""
    r = risk_contributions(cov, weights).withColumn("_c", F.abs("component") / F.sum(F.abs("component")).over(Window.partitionBy("portfolio_id")))
    return r.groupBy("portfolio_id").agg((1 / F.sum(F.col("weight") * F.col("weight"))).alias("by_weight"), (1 / F.sum(F.col("_c") * F.col("_c"))).alias("by_risk"))


def covariance_diagnostics(cov: DataFrame, key: str = "estimator") -> DataFrame:
    """``min_eigen, max_eigen, rank, condition, is_psd, entropy_rank`` of each key's matrix, by a grouped dense job.

    A matrix is as large as its universe squared, which the caller bounds; the parallelism is across keys.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {x: i for i, x in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for a, b, c in zip(pdf["a"], pdf["b"], pdf["cov"], strict=True):
            m[at[a], at[b]] = m[at[b], at[a]] = c
        e = np.linalg.eigvalsh(m)
        tolerance = max(abs(e).max(), 0) * len(e) * np.finfo(float).eps
        share = np.clip(e, 0, None) / max(np.clip(e, 0, None).sum(), 1e-300)
        share = share[share > 0]
        return pd.DataFrame([{key: pdf[key].iloc[0], "n": len(names), "min_eigen": e[0], "max_eigen": e[-1], "rank": int((e > tolerance).sum()), "condition": e[-1] / e[0] if e[0] > tolerance else None, "is_psd": bool(e[0] >= -tolerance), "entropy_rank": float(np.exp(-(share * np.log(share)).sum()))}])

    return cov.select(key, "a", "b", "cov").groupBy(key).applyInPandas(solve, f"{key} string, n bigint, min_eigen double, max_eigen double, rank bigint, condition double, is_psd boolean, entropy_rank double")


def correlation_distance(correlation: DataFrame) -> DataFrame:
    return correlation.withColumn("distance", F.sqrt(F.greatest((1 - F.col("rho")) / 2, F.lit(0.0))))


def top_abs_correlations(correlation: DataFrame, k: int) -> DataFrame:
    """The ``k`` pairs of largest absolute correlation, then by names."""
    return correlation.where("rho is not null").orderBy(F.desc(F.abs("rho")), "a", "b").limit(k)


def agglomerate(distance: np.ndarray, linkage: str) -> list[tuple[int, int, float, int]]:
    """Merges ``(left, right, distance, size)`` by average or complete linkage; ties go to the smaller node ids.

    Every node keeps its nearest later node. A merge looks at all nodes once, and anew only at those whose nearest is gone.
    """
    n = len(distance)
    most = 2 * n - 1
    d = np.full((most, most), np.inf)  # d[i, j], i < j, by node
    d[:n, :n] = np.where(np.triu(np.ones((n, n), bool), 1), distance, np.inf)
    near = np.argmin(d, axis=1) if n > 1 else np.zeros(most, int)
    gap, size, alive = d[np.arange(most), near], np.ones(most, int), np.arange(most) < n
    merges = []
    for node in range(n, most):
        a = int(np.argmin(gap))
        b, best = int(near[a]), float(gap[a])
        alive[[a, b]] = False
        c = np.flatnonzero(alive)
        x, y = d[np.minimum(a, c), np.maximum(a, c)], d[np.minimum(b, c), np.maximum(b, c)]
        size[node] = size[a] + size[b]
        to = np.maximum(x, y) if linkage == "complete" else (x * size[a] + y * size[b]) / size[node]
        d[[a, b], :], d[:, [a, b]], gap[[a, b]] = np.inf, np.inf, np.inf
        d[c, node], alive[node] = to, True
        nearer = to < gap[c]
        near[c[nearer]], gap[c[nearer]] = node, to[nearer]
        for i in c[~nearer & ((near[c] == a) | (near[c] == b))]:
            near[i] = np.argmin(d[i])
            gap[i] = d[i, near[i]]
        merges.append((a, b, best, int(size[node])))
    return merges


def hierarchical_clusters(distances: DataFrame, *, key: str = "method", cut: float = 0.5, linkage: str | None = None) -> DataFrame:
    """``key, symbol, cluster_id`` by ``linkage``, or by the one that the key names; clusters are numbered by their first member.

    A grouped dense job: one key holds one universe's pairs, which the caller bounds. A key with a pair whose distance is not
    known gives no row: an unknown distance is neither near nor far.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {x: i for i, x in enumerate(names)}
        m = np.full((len(names), len(names)), np.nan)
        np.fill_diagonal(m, 0)
        for a, b, c in zip(pdf["a"], pdf["b"], pdf["distance"], strict=True):
            m[at[a], at[b]] = m[at[b], at[a]] = c
        if np.isnan(m).any():
            return pd.DataFrame({key: pd.Series(dtype=object), "symbol": pd.Series(dtype=object), "cluster_id": pd.Series(dtype="int64")})
        groups = {i: [i] for i in range(len(names))}
        for node, (a, b, dist, _) in enumerate(agglomerate(m, linkage or pdf[key].iloc[0]), len(names)):
            if dist <= cut and a in groups and b in groups:
                groups[node] = groups.pop(a) + groups.pop(b)
        ordered = sorted(sorted(names[i] for i in g) for g in groups.values())
        return pd.DataFrame([{key: pdf[key].iloc[0], "symbol": s, "cluster_id": k} for k, g in enumerate(ordered) for s in g])

    return distances.select(key, "a", "b", "distance").groupBy(key).applyInPandas(solve, f"{key} string, symbol string, cluster_id bigint")


def cluster_summary(correlation: DataFrame, clusters: DataFrame) -> DataFrame:
    """``cluster_id, n_pairs, low, mean, high`` of the correlations inside each cluster."""
    c = clusters.select("symbol", "cluster_id")
    j = correlation.join(c.withColumnsRenamed({"symbol": "a", "cluster_id": "_a"}), "a").join(c.withColumnsRenamed({"symbol": "b", "cluster_id": "_b"}), "b").where("_a = _b")
    return j.groupBy(F.col("_a").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n_pairs"), F.min("rho").alias("low"), F.avg("rho").alias("mean"), F.max("rho").alias("high"))


def bootstrap_index(spark, n: int, *, block: int = 4, replicates: int = 200, seed: int = 7) -> DataFrame:
    """``replicate, step, pos``: circular block bootstrap of ``n`` positions; block starts are hashes of seed, replicate and block."""
    blocks = -(-n // block)
    base = spark.range(replicates if n else 0).select(F.col("id").alias("replicate")).withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0)))))
    start = F.pmod(F.xxhash64(F.lit(seed), "replicate", "blk"), F.lit(max(n, 1)))
    steps = base.withColumn("start", start).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    step = (F.col("blk") * block + F.col("k")).cast("bigint")
    return steps.select("replicate", step.alias("step"), F.pmod(F.col("start") + F.col("k"), F.lit(max(n, 1))).cast("bigint").alias("pos")).where(F.col("step") < n)


def bootstrap_pair_corr(returns: DataFrame, index: DataFrame) -> DataFrame:
    """``replicate, a, b, rho`` of complete weekly returns drawn by position; an observation counts as often as it is drawn."""
    pos = returns.select("dt").distinct().withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("dt")).cast("bigint") - 1)
    drawn = index.join(F.broadcast(pos), "pos").select("replicate", "step", "dt")
    sample = drawn.join(returns, "dt").select("replicate", F.col("step").alias("dt"), "symbol", "ret")
    return correlations(sample, keys=("replicate",))


def pair_stability(boot: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of replicates in which a pair's correlation is at least ``threshold``."""
    return boot.groupBy("a", "b").agg(F.avg((F.col("rho") >= threshold).cast("double")).alias("stability"), F.count("rho").alias("n"))


def redundancy_verdict(evidence: DataFrame) -> DataFrame:
    """``verdict`` (HIGH, MEDIUM, LOW, UNCERTAIN) and ``confidence`` of pairs; what is not known speaks neither for nor against.

    ``evidence``: as from ``pair_evidence``. LOW is a finding of its own, not the rest: weak correlation, apart in clusters and in replicates.
    """
    least = lambda c, bound: F.coalesce(F.col(c) >= bound, F.lit(False))
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    # The bounds of each verdict and of each confidence.
    high = true("same_average") & true("same_complete") & least("structural", 0.80) & least("bootstrap", 0.75) & least("window_share", 2 / 3) & least("medium", 0.70)
    support = least("medium", 0.60) | least("downside", 0.65) | least("stress", 0.65) | (true("factor_eligible") & least("factor", 0.65))
    medium = true("same_average") & least("structural", 0.65) & least("bootstrap", 0.60) & support
    low = ~F.col("same_average") & (F.col("structural") <= 0.35) & (F.col("bootstrap") <= 0.35)
    known = F.col("structural").isNotNull() & F.col("bootstrap").isNotNull() & F.col("same_average").isNotNull()
    verdict = F.when(~known, "UNCERTAIN").when(high, "HIGH").when(medium, "MEDIUM").when(low, "LOW").otherwise("UNCERTAIN")
    valid = F.col("structural").isNotNull() & F.col("medium").isNotNull()
    sure = F.when(valid & least("n_windows", 3) & least("n_replicates", 190), "HIGH").when(valid & least("n_windows", 2) & least("n_replicates", 160), "MEDIUM").otherwise("LOW")
    return evidence.withColumns({"verdict": verdict, "confidence": sure})


def same_cluster(clusters: DataFrame) -> DataFrame:
    """``a, b, same_average, same_complete`` from ``method, symbol, cluster_id``."""
    c = clusters.select("method", "symbol", "cluster_id")
    x, y = c.withColumnsRenamed({"symbol": "a", "cluster_id": "_a"}), c.withColumnsRenamed({"symbol": "b", "cluster_id": "_b"})
    same = {m: F.max(F.when(F.col("method") == m, F.col("_a") == F.col("_b"))).alias(f"same_{m}") for m in ("average", "complete")}
    return x.join(y, "method").where("a < b").groupBy("a", "b").agg(*same.values())


def pair_evidence(correlations: dict[str, DataFrame], clusters: DataFrame, bootstrap: DataFrame, windows: DataFrame, factor: DataFrame, eligible: DataFrame) -> DataFrame:
    """All that is known about each pair of the ``structural`` correlations.

    ``correlations``: ``structural``, ``medium``, ``downside`` and ``stress`` with ``a, b, rho``; ``clusters``: by both linkages;
    ``bootstrap``, ``windows``: from ``cocluster_share``; ``factor``: ``a, b, rho`` that a factor model implies; ``eligible``: the
    symbols whose exposures may be used.
    """
    df = correlations["structural"].select("a", "b", F.col("rho").alias("structural"))
    for name in ("medium", "downside", "stress"):
        df = df.join(correlations[name].select("a", "b", F.col("rho").alias(name)), ["a", "b"], "left")
    df = df.join(factor.select("a", "b", F.col("rho").alias("factor")), ["a", "b"], "left").join(same_cluster(clusters), ["a", "b"], "left")
    df = df.join(bootstrap.select("a", "b", F.col("share").alias("bootstrap"), F.col("n").alias("n_replicates")), ["a", "b"], "left")
    df = df.join(windows.select("a", "b", F.col("share").alias("window_share"), F.col("n").alias("n_windows")), ["a", "b"], "left")
    e = eligible.select("symbol").distinct()
    for c in ("a", "b"):
        df = df.join(e.select(F.col("symbol").alias(c), F.lit(True).alias(f"_{c}")), c, "left")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return df.withColumn("factor_eligible", both).na.fill(0, ["n_replicates", "n_windows"]).drop("_a", "_b")


def cocluster_share(clusters: DataFrame, key: str) -> DataFrame:
    """``a, b, share, n``: share of the keys (windows, replicates) in which two symbols have one cluster."""
    c = clusters.select(key, "symbol", "cluster_id")
    x, y = c.withColumnsRenamed({"symbol": "a", "cluster_id": "_a"}), c.withColumnsRenamed({"symbol": "b", "cluster_id": "_b"})
    j = x.join(y, key).where("a < b")
    return j.groupBy("a", "b").agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))


def experiment_variants(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """``variant_id, symbol``: the base set, and one set per symbol removed, candidate added, and symbol replaced."""
    base = members.select("symbol").distinct()
    own = base.agg(F.array_sort(F.collect_list("symbol")).alias("m"))  # a refinery's universe is bounded
    out, new = base.select(F.col("symbol").alias("o")), candidates.select(F.col("symbol").alias("c")).distinct()
    sets = own.select(F.lit("base").alias("variant_id"), F.col("m").alias("s"))
    sets = sets.union(out.join(F.broadcast(own)).select(F.concat(F.lit("-"), "o"), F.array_remove("m", F.col("o"))))
    sets = sets.union(new.join(F.broadcast(own)).select(F.concat(F.lit("+"), "c"), F.array_sort(F.array_union("m", F.array("c")))))
    sets = sets.union(out.crossJoin(new).join(F.broadcast(own)).select(F.concat(F.lit("-"), "o", F.lit("+"), "c"), F.array_sort(F.array_union(F.array_remove("m", F.col("o")), F.array("c")))))
    return sets.select("variant_id", F.explode("s").alias("symbol"))


def structural_snapshot(returns: DataFrame, variants: DataFrame) -> DataFrame:
    """``variant_id, n, participation_ratio, mean_rho`` of each variant on one frozen sample; the covariance is made once."""
    cov = sample_covariance(returns)
    v = variants.select("variant_id", "symbol")
    c = cov.join(v.withColumnRenamed("symbol", "a"), "a").join(v.withColumnsRenamed({"symbol": "b", "variant_id": "_v"}), "b").where("variant_id = _v")
    sd = cov.where("a = b").select("a", F.sqrt("cov").alias("s"))
    c = c.join(F.broadcast(sd), "a").join(F.broadcast(sd.withColumnsRenamed({"a": "b", "s": "_s"})), "b")
    on = F.col("a") == F.col("b")
    g = c.groupBy("variant_id").agg(F.count_if(on).alias("n"), F.sum(F.when(on, F.col("cov"))).alias("tr"), F.sum(F.when(on, 1.0).otherwise(2.0) * F.col("cov") * F.col("cov")).alias("ss"), F.avg(F.when(~on, safe_ratio(F.col("cov"), F.col("s") * F.col("_s")))).alias("mean_rho"))
    return g.select("variant_id", "n", safe_ratio(F.col("tr") * F.col("tr"), F.col("ss")).alias("participation_ratio"), "mean_rho")


def marginal_experiments(snapshot: DataFrame) -> DataFrame:
    """Each variant's differences to the base set's."""
    base = snapshot.where("variant_id = 'base'").select(F.col("participation_ratio").alias("_p"), F.col("mean_rho").alias("_r"))
    df = snapshot.where("variant_id <> 'base'").join(F.broadcast(base))
    return df.select("variant_id", "n", (F.col("participation_ratio") - F.col("_p")).alias("d_participation"), (F.col("mean_rho") - F.col("_r")).alias("d_rho"))


def allocate_erc(cov: DataFrame, members: DataFrame, *, tolerance: float = 1e-8, rounds: int = 1000) -> DataFrame:
    """``portfolio_id, symbol, weight, budget_error``: equal risk contributions by cyclic coordinate descent.

    Spark makes each portfolio's covariance; a grouped job solves the small systems in parallel.
    """
    m = members.select("portfolio_id", "symbol")
    full = _both_ways(cov).join(m.withColumnRenamed("symbol", "a"), "a").join(m.withColumnsRenamed({"symbol": "b", "portfolio_id": "_p"}), "b").where("portfolio_id = _p")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]))
        s = pdf.pivot(index="a", columns="b", values="cov").loc[names, names].to_numpy()
        n, x = len(names), 1 / np.sqrt(np.diag(s))
        for _ in range(rounds):
            for i in range(n):
                rest = s[i] @ x - s[i, i] * x[i]
                x[i] = (-rest + np.sqrt(rest**2 + 4 * s[i, i] / n)) / (2 * s[i, i])
            share = x * (s @ x)
            error = abs(share / share.sum() - 1 / n).max()
            if error <= tolerance:
                break
        return pd.DataFrame({"portfolio_id": pdf["portfolio_id"].iloc[0], "symbol": names, "weight": x / x.sum(), "budget_error": error})

    return full.select("portfolio_id", "a", "b", "cov").groupBy("portfolio_id").applyInPandas(solve, "portfolio_id string, symbol string, weight double, budget_error double")
