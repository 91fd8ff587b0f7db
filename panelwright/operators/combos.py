"""Combination search: k-subsets of a universe, evaluated as equal-weight portfolios.

A combination is its rank: tasks take ranges of ranks, work out the members and evaluate them in blocks against one matrix of the
universe's prices. There is no join and no shuffle, and C(n, k) is known before the plan runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def combination_counts(universes: DataFrame, k: int) -> DataFrame:
    """``n, combinations`` of each universe's distinct symbols: C(n, k) by a product, exact while it fits a double's 53 bits."""
    g = universes.groupBy("universe_id").agg(F.countDistinct("symbol").alias("n"))
    factors = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: (F.col("n") - k + i) / i)
    c = F.round(F.aggregate(factors, F.lit(1.0), lambda a, x: a * x)).cast("bigint")
    return g.withColumn("combinations", F.when(F.col("n") >= k, c).otherwise(F.lit(0).cast("bigint")))


def _binomials(n: int, k: int) -> np.ndarray:
    """``C(x, j)`` for ``x`` up to ``n``, ``j`` up to ``k``."""
    if comb(n, k) >= 2**62:
        raise ValueError(f"C({n}, {k}) subsets are more than a 64-bit rank can number")
    return np.array([[min(comb(x, j), 2**62) for j in range(k + 1)] for x in range(n + 1)], np.int64)


def unranked(ranks: np.ndarray, binomials: np.ndarray) -> np.ndarray:
    """Positions of the ``k``-subsets of these lexicographic ranks, a row each: the combinatorial number of the rank from the end."""
    n, k = binomials.shape[0] - 1, binomials.shape[1] - 1
    left, out = binomials[n, k] - 1 - ranks, np.empty((len(ranks), k), np.int64)
    for i in range(k):
        x = np.searchsorted(binomials[:, k - i], left, side="right") - 1
        out[:, i], left = n - 1 - x, left - binomials[x, k - i]
    return out


def combo_ranks(spark: SparkSession, n: int, k: int, *, at_once: int = 50_000) -> DataFrame:
    """``combo_rank`` of every k-subset of ``n``: a range, in blocks of ``at_once`` a task, up to 100,000 tasks."""
    total = comb(n, k) if 0 < k <= n else 0
    return spark.range(0, total, 1, min(max(1, -(-total // at_once)), 100_000)).withColumnRenamed("id", "combo_rank")


def enumerate_combos(ranks: DataFrame, names: list[str], k: int) -> DataFrame:
    """``combo_rank, members``: lexicographic k-subsets of the sorted ``names`` (a universe), made of the ranks alone, without a join."""
    binomials, own = _binomials(len(names), k), np.array(names, object)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = unranked(batch.column("combo_rank").to_numpy(), binomials)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, k), pa.int32()), pa.array(own[at.ravel()], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("combo_rank"), lists], ["combo_rank", "members"])

    return ranks.select("combo_rank").mapInArrow(members, "combo_rank bigint, members array<string>")


def price_matrix(panel: DataFrame, *, most: int = 50_000_000) -> tuple[list[str], list, np.ndarray]:
    """Sorted symbols, dates and prices (a row a symbol) of a panel that has every symbol on every date, at most ``most`` prices."""
    n = panel.count()
    if n > most:
        raise ValueError(f"a panel of {n} prices is more than the {most} that every task may hold")
    rows = panel.select("symbol", "dt", "value").toArrow().to_pandas().pivot(index="symbol", columns="dt", values="value")
    return list(rows.index), list(rows.columns), rows.to_numpy(np.float64)


#: Metrics of :func:`evaluate_combos`.
METRICS = ("total_return", "cagr", "max_drawdown", "volatility", "sortino", "beta", "alpha", "turnover", "rebalances", "cost")


def boundaries(dates: list, mode: str) -> np.ndarray:
    """Where a calendar period begins: the date's month, quarter or year differs from that of the date before."""
    key = {"monthly": lambda d: (d.year, d.month), "quarterly": lambda d: (d.year, (d.month - 1) // 3), "annually": lambda d: d.year}.get(mode, lambda d: 0)
    keys = [key(d) for d in dates]
    return np.array([i > 0 and keys[i] != keys[i - 1] for i in range(len(keys))], bool)


def _after_costs(before: np.ndarray, nav: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Value after trading to equal weights, and what is traded: the fixed point of value less its own costs."""
    k, target = before.shape[1], nav
    traded = lambda t: np.abs(t[:, None] / k - before).sum(axis=1)
    for _ in range(40):
        now = nav - rate * traded(target)
        done = np.abs(now - target).max(initial=0.0) <= 1e-12 * max(1.0, nav.max(initial=0.0))
        target = now
        if done:
            break
    return target, traded(target)


def simulated(prices: np.ndarray, bench: np.ndarray, begins: np.ndarray, *, mode: str, band: float, cost_rate: float, delay: int, per_year: float, years: float) -> dict[str, np.ndarray]:
    """:data:`METRICS` of equal-weight portfolios, ``prices[combination, member, date]``, all combinations a date at a time.

    At the first date equal weights are bought from cash. A signal (a member's weight leaves the ``band`` around its share, or a period
    begins) is traded ``delay`` dates later, and none is taken while one waits or at a date of trading; one that would be traded
    after the last date is dropped.
    """
    m, k, n = prices.shape
    target, _ = _after_costs(np.zeros((m, k)), np.ones(m), cost_rate)
    shares = target[:, None] / k / prices[:, :, 0]
    nav, cost = np.empty((m, n)), 1 - target
    nav[:, 0] = target
    gross, count, waits = np.zeros(m), np.zeros(m, np.int64), np.full(m, -1)
    for t in range(1, n):
        held = shares * prices[:, :, t]
        value = held.sum(axis=1)
        trade, idle = waits == t, waits < 0
        if mode == "band":
            share = held / value[:, None]
            signal = idle & ((share < (1 - band) / k) | (share > (1 + band) / k)).any(axis=1)
        else:
            signal = idle & begins[t]
        if delay == 0:
            trade = trade | signal
        elif t + delay < n:
            waits[signal] = t + delay
        if trade.any():
            after, traded = _after_costs(held[trade], value[trade], cost_rate)
            shares[trade] = after[:, None] / k / prices[trade, :, t]
            gross[trade] += traded
            cost[trade] += value[trade] - after
            count[trade] += 1
            waits[trade & (waits == t)] = -1
            value[trade] = after
        nav[:, t] = value
    ret, b = nav[:, 1:] / nav[:, :-1] - 1, bench[1:] / bench[:-1] - 1
    mean, rest, b_rest = ret.mean(axis=1), ret - ret.mean(axis=1)[:, None], b - b.mean()
    down = np.sqrt((np.minimum(ret, 0) ** 2).mean(axis=1) * per_year)
    peak = np.maximum(np.maximum.accumulate(nav, axis=1), 1)
    freedom = max(n - 2, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        beta = (rest @ b_rest) / (b_rest @ b_rest) if b_rest @ b_rest > 1e-12 else np.full(m, np.nan)
        return {
            "total_return": nav[:, -1] - 1,
            "cagr": np.maximum(nav[:, -1], 1e-12) ** (1 / years) - 1,
            "max_drawdown": np.minimum((nav / peak - 1).min(axis=1), 0),
            "volatility": np.sqrt((rest**2).sum(axis=1) / freedom * per_year),
            "sortino": np.where(down > 1e-12, mean * per_year / down, np.nan),
            "beta": beta,
            "alpha": (mean - beta * b.mean()) * per_year,
            "turnover": gross / (2 * nav.mean(axis=1)) / years,
            "rebalances": count,
            "cost": cost,
        }


def evaluate_combos(
    ranks: DataFrame,
    names: list[str],
    dates: list,
    prices: np.ndarray,
    benchmark: np.ndarray,
    k: int,
    *,
    modes: tuple[str, ...] = ("never",),
    band: float = 0.2,
    cost_bps: float = 0.0,
    delay: int = 1,
    per_year: float = 12,
    doubles_at_once: int = 2_000_000,
) -> DataFrame:
    """``mode, combo_rank, members`` and :data:`METRICS` of the combinations of these ranks, equal weights reset by ``mode``.

    ``modes``: of ``never, monthly, quarterly, annually, band``. ``names, dates, prices``: :func:`price_matrix`, ``benchmark``: its levels on
    the same dates. The matrix (a universe's dense panel) goes to every task once; ranks are evaluated in blocks and nothing is shuffled.
    Metrics that have no value (no loss, a flat benchmark) are null.
    """
    if not len(dates) > 1:
        raise ValueError("an evaluation needs two dates at least")
    binomials, own = _binomials(len(names), k), np.array(names, object)
    shared = ranks.sparkSession.sparkContext.broadcast(prices)
    years = max((dates[-1] - dates[0]).days / 365.25, 1 / 365.25)
    begins, block = {mode: boundaries(dates, mode) for mode in modes}, max(1, doubles_at_once // (k * len(dates)))

    def evaluated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("combo_rank").to_numpy()
            for lo in range(0, len(every), block):
                rank = every[lo : lo + block]
                at = unranked(rank, binomials)
                members = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, k), pa.int32()), pa.array(own[at.ravel()], pa.string()))
                legs = shared.value[at]
                for mode in modes:
                    got = simulated(legs, benchmark, begins[mode], mode=mode, band=band, cost_rate=cost_bps / 10_000, delay=delay, per_year=per_year, years=years)
                    columns = [pa.array(got[c], from_pandas=True) for c in METRICS]
                    yield pa.RecordBatch.from_arrays([pa.array([mode] * len(rank)), pa.array(rank), members, *columns], ["mode", "combo_rank", "members", *METRICS])

    kinds = ", ".join(f"{c} {'bigint' if c == 'rebalances' else 'double'}" for c in METRICS)
    return ranks.select("combo_rank").mapInArrow(evaluated, f"mode string, combo_rank bigint, members array<string>, {kinds}")


def combo_scores(combos: DataFrame) -> DataFrame:
    """``stable_score, growth_score, drawdown_score, optimized_score``: Sortino weighed by growth over beta and drawdown.

    Null where a metric is missing, 1 + CAGR is negative or 1 + beta not positive.
    """
    growth, risk, depth = 1 + F.col("cagr"), 1 + F.col("beta"), 1 + F.abs("max_drawdown")
    ok = F.col("sortino").isNotNull() & F.col("max_drawdown").isNotNull() & (growth >= 0) & (risk > 1e-12)
    score = lambda x: F.when(ok, F.col("sortino") * F.sqrt(x))
    return combos.withColumns(
        {
            "stable_score": score(growth / risk),
            "growth_score": score(growth / F.sqrt(risk)),
            "drawdown_score": score(growth / (risk * depth)),
            "optimized_score": score(growth / (risk * risk * depth)),
        }
    )


def combo_metric_filter(combos: DataFrame, *, sortino: float | None = None, cagr: float | None = None, drawdown: float | None = None) -> DataFrame:
    """Least Sortino and CAGR and most absolute drawdown; a null fails a bound that is set."""
    ok = F.lit(True)
    for c, bound in ((F.col("sortino"), sortino), (F.col("cagr"), cagr), (-F.abs("max_drawdown"), None if drawdown is None else -drawdown)):
        if bound is not None:
            ok &= F.coalesce(c >= bound, F.lit(False))
    return combos.where(ok)


def best_combo(combos: DataFrame, score: str, *keys: str) -> DataFrame:
    """The row of greatest score, of equal ones the smallest rank; nulls lose."""
    value = F.coalesce(F.col(score), F.lit(float("-inf")))
    return combos.groupBy(*keys).agg(F.max_by(F.struct(*combos.columns), F.struct(value, -F.col("combo_rank"))).alias("best")).select("best.*")


def recommended_holdings(universes: DataFrame, *, most: int = 10, budget: int = 500_000) -> DataFrame:
    """The largest ``k`` up to ``most`` with C(n, k) within the budget."""
    g = universes.groupBy("universe_id").agg(F.countDistinct("symbol").alias("n"))
    c = lambda k: F.aggregate(F.transform(F.sequence(F.lit(1), k), lambda i: (F.col("n") - k + i) / i), F.lit(1.0), lambda a, x: a * x)
    ks = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: (k <= F.col("n")) & (c(k) <= budget + 0.5))
    return g.select("universe_id", "n", F.array_max(ks).cast("bigint").alias("k"))
