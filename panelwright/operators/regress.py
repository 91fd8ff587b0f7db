"""Regressions from Gram sums: Spark adds up X'X and X'y per key, and a small system per key is solved in a grouped job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelwright.functions.scalars import safe_ratio


def gram_ols(rows: DataFrame, regressors: tuple[str, ...], *, key: str = "symbol", y: str = "y", least: int = 36) -> DataFrame:
    """``key, n, alpha, beta_<name>..., r2`` of ``y`` on the regressors and a constant; keys with fewer rows are left out."""
    x = ["_one", *regressors]
    df = rows.withColumn("_one", F.lit(1.0)).dropna(subset=[y, *regressors])
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]
    sums += [F.sum(F.col(a) * F.col(y)).alias(f"xy_{i}") for i, a in enumerate(x)] + [F.sum(F.col(y) * F.col(y)).alias("yy")]
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= least)
    betas = [f"beta_{r}" for r in regressors]

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                k = len(x)
                a = np.array([[r[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                b = np.array([r[f"xy_{i}"] for i in range(k)])
                beta = np.linalg.lstsq(a, b, rcond=None)[0]
                total = r["yy"] - b[0] ** 2 / r["n"]
                rest = r["yy"] - 2 * beta @ b + beta @ a @ beta
                out.append([r[key], r["n"], *beta, 1 - rest / total if total > 1e-15 else None])
            yield pd.DataFrame(out, columns=[key, "n", "alpha", *betas, "r2"])

    return g.mapInPandas(solve, f"{key} string, n bigint, alpha double, {', '.join(f'{b} double' for b in betas)}, r2 double")


def simple_ols(pairs: DataFrame, least: int = 3) -> DataFrame:
    """One regressor (``bret``) in closed form, without Python."""
    g = pairs.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), safe_ratio(F.covar_samp("ret", "bret"), F.var_samp("bret")).alias("beta"), F.avg("ret").alias("a"), F.avg("bret").alias("b"), F.corr("ret", "bret").alias("_r"))
    return g.where(F.col("n") >= least).select("symbol", "n", "beta", (F.col("a") - F.col("beta") * F.col("b")).alias("alpha"), (F.col("_r") * F.col("_r")).alias("r2"))


def xirr_batch(flows: DataFrame, *, low: float = -0.999999, high: float = 1_000_000.0, points: int = 2_400, rounds: int = 5) -> DataFrame:
    """``portfolio_id, status, rate`` of ``(portfolio_id, dt, amount)``: roots of the net present value on a grid of log rates.

    All portfolios at once: a grid over the log rate, sign changes between neighbours, then nested grids of 40 points inside the
    bracket. ``unique`` with its rate, ``multiple``, or ``no_solution``.
    """
    first = flows.groupBy("portfolio_id").agg(F.min("dt").alias("_d"))
    f = flows.join(first, "portfolio_id").groupBy("portfolio_id", (F.datediff("dt", "_d") / 365.2425).alias("t")).agg(F.sum("amount").alias("cf"))
    cash = f.groupBy("portfolio_id").agg(F.array_sort(F.collect_list(F.struct("t", "cf"))).alias("cfs"))  # one row per distinct date of a portfolio
    npv = lambda x: F.aggregate("cfs", F.lit(0.0), lambda a, c: a + c["cf"] * F.exp(-x * c["t"]))
    a, b = float(np.log1p(low)), float(np.log1p(high))

    def brackets(lo, hi, n):
        """Neighbouring grid points between which the value changes sign."""
        at = lambda i: lo + (hi - lo) * i / n
        grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(at(i).alias("x"), at(i + 1).alias("y")))
        return F.filter(grid, lambda s: ((npv(s["x"]) > 0) & (npv(s["y"]) <= 0)) | ((npv(s["x"]) < 0) & (npv(s["y"]) >= 0)))

    df = cash.withColumn("_s", brackets(F.lit(a), F.lit(b), points))
    df = df.withColumn("n_roots", F.size("_s").cast("bigint")).withColumn("_b", F.get("_s", F.lit(0)))
    for _ in range(rounds):
        df = df.withColumn("_b", F.coalesce(F.get(brackets(F.col("_b.x"), F.col("_b.y"), 40), F.lit(0)), F.col("_b")))
    rate = F.expm1((F.col("_b.x") + F.col("_b.y")) / 2)
    status = F.when(F.col("n_roots") == 1, "unique").when(F.col("n_roots") > 1, "multiple").otherwise("no_solution")
    return df.select("portfolio_id", status.alias("status"), F.when(F.col("n_roots") == 1, rate).alias("rate"))


def factor_implied_corr(betas: DataFrame, factor_cov: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``a, b, rho``: correlation of ``B S_f B'``, clipped to [-1, 1]; ``betas`` as from :func:`gram_ols`."""
    long = betas.select("symbol", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"beta_{n}").alias("beta")) for n in names])).alias("x")).select("symbol", "x.f", "x.beta")
    both = factor_cov.select("a", "b", "cov").union(factor_cov.where("a <> b").select("b", "a", "cov"))
    left = long.join(F.broadcast(both), long["f"] == both["a"]).groupBy("symbol", "b").agg(F.sum(F.col("beta") * F.col("cov")).alias("bs"))
    right = long.select(F.col("symbol").alias("other"), "f", "beta")
    c = left.join(right, left["b"] == right["f"]).groupBy("symbol", "other").agg(F.sum(F.col("bs") * F.col("beta")).alias("cov"))
    sd = c.where("symbol = other").select(F.col("symbol").alias("s"), F.sqrt("cov").alias("sd"))
    j = c.where("symbol < other").join(F.broadcast(sd), F.col("symbol") == F.col("s")).withColumnRenamed("sd", "sa").drop("s").join(F.broadcast(sd), F.col("other") == F.col("s"))
    return j.select(F.col("symbol").alias("a"), F.col("other").alias("b"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), safe_ratio(F.col("cov"), F.col("sa") * F.col("sd")))).alias("rho"))


def style_weights(rows: DataFrame, proxies: tuple[str, ...], *, key: str = "portfolio_id", y: str = "y", least: int = 24) -> DataFrame:
    """``key, n, w_<proxy>..., sse``: non-negative weights that sum to 1 with the least squared error.

    Exact: Gram sums by key, then the equality-constrained solution of every support, of which the best feasible one is taken.
    """
    x = list(proxies)
    df = rows.dropna(subset=[y, *x])
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j] + [F.sum(F.col(a) * F.col(y)).alias(f"xy_{i}") for i, a in enumerate(x)]
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), *sums).where(F.col("n") >= least)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                k = len(x)
                a = np.array([[r[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                b = np.array([r[f"xy_{i}"] for i in range(k)])
                best = None
                for bits in range(1, 1 << k):
                    s = [i for i in range(k) if bits >> i & 1]
                    kkt = np.block([[a[np.ix_(s, s)], np.ones((len(s), 1))], [np.ones((1, len(s))), np.zeros((1, 1))]])
                    w = np.zeros(k)
                    w[s] = np.linalg.lstsq(kkt, np.append(b[s], 1.0), rcond=None)[0][:-1]
                    sse = r["yy"] - 2 * w @ b + w @ a @ w
                    if w.min() >= -1e-12 and (best is None or sse < best[0]):
                        best = sse, w
                out.append([r[key], r["n"], *np.clip(best[1], 0, None), best[0]])
            yield pd.DataFrame(out, columns=[key, "n", *[f"w_{p}" for p in x], "sse"])

    return g.mapInPandas(solve, f"{key} string, n bigint, {', '.join(f'w_{p} double' for p in x)}, sse double")
