"""Tuning, combination search and pair sums against plain Python and numpy."""

from __future__ import annotations

import itertools
import random
from datetime import date, timedelta
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import combos as C, matrix as X, tuning as U, walk as K
from panelwright.operators.screen import retention_plan


def weekly_panel(rng, symbols=6, weeks=110, start=date(2020, 1, 3)):
    rows = []
    for s in range(symbols):
        value = 100.0
        for w in range(weeks):
            value *= 1 + rng.uniform(-0.06, 0.065)
            rows.append((f"S{s}", start + timedelta(7 * w), value))
    return rows


def test_no_winner_depends_on_later_prices(spark):
    rng = random.Random(5)
    rows, after = weekly_panel(rng), date(2021, 5, 31)
    changed = [(s, d, v * rng.uniform(0.5, 2)) if d > after else (s, d, v) for s, d, v in rows]
    grid = U.candidates(spark, [2, 4], [1, 3], [0.0], ["equal", "inverse_vol"])
    risky = spark.createDataFrame([("S0",), ("S1",), ("S2",), ("S3",)], "symbol string")

    def run(panel):
        df = spark.createDataFrame(panel, "symbol string, dt date, value double")
        periods = K.monthly_periods(df.agg(F.max("dt").alias("dt")), 12).where("train_start >= date'2020-01-03'")
        tuned = U.tune_parameters(df, periods, K.inner_folds(periods, 4, 4), risky, grid, n_folds=4)
        kept = spark.createDataFrame(tuned.collect(), tuned.schema)
        decided = U.refit_winner(df, periods, kept, risky).collect()
        upto = {r.period_id for r in periods.collect() if r.decision_date <= after}
        return {tuple(r) for r in kept.collect() if r.period_id in upto}, {tuple(r) for r in decided if r.period_id in upto}, kept.collect()

    first, second = run(rows), run(changed)
    assert first[0] and first[1] and first[:2] == second[:2]
    assert first[2] != second[2]
    for period, group in itertools.groupby(sorted(first[2], key=lambda r: r.period_id), key=lambda r: r.period_id):
        group = list(group)
        ranked = [r for r in group if r.status == "eligible"]
        assert len(group) == 8 and sorted(r.rank for r in ranked) == list(range(1, len(ranked) + 1)), period


def test_candidates_fail_with_a_reason(spark):
    rows = weekly_panel(random.Random(1), weeks=60)
    df = spark.createDataFrame(rows, "symbol string, dt date, value double")
    periods = K.monthly_periods(df.agg(F.max("dt").alias("dt")), 2, 6)  # six months of training hold no four folds with four months before
    grid = U.candidates(spark, [4], [1], [0.0], ["equal"])
    got = U.tune_parameters(df, periods, K.inner_folds(periods, 4, 4), spark.createDataFrame([("S0",)], "symbol string"), grid, n_folds=4).collect()
    assert len(got) == 2 and {(r.status, r.reason, r.rank) for r in got} == {("failed", "insufficient_training", None)}


@pytest.mark.parametrize(("n", "k"), [(1, 1), (5, 2), (9, 4), (25, 3)])
def test_unranking_is_lexicographic(n, k):
    got = C.unranked(np.arange(comb(n, k)), C._binomials(n, k))
    assert [tuple(x) for x in got.tolist()] == list(itertools.combinations(range(n), k))


def day_loop(prices, dates, mode, band, rate, delay):
    """One portfolio, a day at a time."""
    k, n = len(prices), len(prices[0])

    def trade(held, nav):
        target = nav
        for _ in range(40):
            target = nav - rate * sum(abs(target / k - h) for h in held)
        return target, sum(abs(target / k - h) for h in held)

    nav, _ = trade([0.0] * k, 1.0)
    shares, out, cost, gross, count, waits = [nav / k / p[0] for p in prices], [nav], 1 - nav, 0.0, 0, None
    key = {"monthly": lambda d: (d.year, d.month), "quarterly": lambda d: (d.year, (d.month - 1) // 3), "annually": lambda d: d.year}.get(mode, lambda d: 0)
    for t in range(1, n):
        held = [s * p[t] for s, p in zip(shares, prices, strict=True)]
        nav, due = sum(held), waits == t
        if waits is None:
            signal = any(not (1 - band) / k <= h / nav <= (1 + band) / k for h in held) if mode == "band" else key(dates[t]) != key(dates[t - 1])
            if signal and delay == 0:
                due = True
            elif signal and t + delay < n:
                waits = t + delay
        if due:
            before = nav
            nav, traded = trade(held, nav)
            shares, waits = [nav / k / p[t] for p in prices], None
            gross, cost, count = gross + traded, cost + before - nav, count + 1
        out.append(nav)
    return out, cost, gross, count


@pytest.mark.parametrize("delay", [0, 1, 3])
@pytest.mark.parametrize("mode", ["never", "monthly", "quarterly", "annually", "band"])
def test_combinations_equal_a_day_loop(spark, mode, delay):
    rng = np.random.default_rng(3)
    dates = [date(2021, 11, 1) + timedelta(3 * i) for i in range(150)]
    prices = 50 * np.cumprod(1 + rng.normal(0, 0.05, (5, len(dates))), axis=1)
    bench = 100 * np.cumprod(1 + rng.normal(0, 0.02, len(dates)))
    names = list("ABCDE")
    df = C.evaluate_combos(C.combo_ranks(spark, 5, 3), names, dates, prices, bench, 3, modes=(mode,), cost_bps=25, delay=delay, per_year=120, doubles_at_once=1000)
    got = {r.combo_rank: r for r in df.collect()}
    assert len(got) == 10
    years = (dates[-1] - dates[0]).days / 365.25
    for rank, members in enumerate(itertools.combinations(range(5), 3)):
        nav, cost, gross, count = day_loop([prices[i].tolist() for i in members], dates, mode, 0.2, 0.0025, delay)
        nav = np.array(nav)
        ret, b = nav[1:] / nav[:-1] - 1, bench[1:] / bench[:-1] - 1
        beta = np.cov(ret, b)[0, 1] / b.var(ddof=1)
        want = (nav[-1] - 1, nav[-1] ** (1 / years) - 1, min((nav / np.maximum(np.maximum.accumulate(nav), 1) - 1).min(), 0), ret.std(ddof=1) * 120**0.5, ret.mean() * 120 / np.sqrt((np.minimum(ret, 0) ** 2).mean() * 120), beta, (ret.mean() - beta * b.mean()) * 120, gross / 2 / nav.mean() / years, count, cost)
        assert got[rank].members == [names[i] for i in members]
        assert np.allclose([got[rank][c] for c in C.METRICS], want, atol=1e-9), (rank, mode)


def test_retention_keeps_the_best_of_every_list(spark):
    rng = random.Random(2)
    rows = [(i, *[rng.choice([None, round(rng.random(), 2)]) for _ in range(3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, p double, q double, r double")
    got = {x.id: x.reason for x in retention_plan(df, 50, primary=F.col("p"), secondary={"q": F.col("q"), "r": F.col("r")}, key="id").collect()}
    top = lambda i, most: [x[0] for x in sorted(rows, key=lambda x: (x[i] is None, -(x[i] or 0), x[0]))[:most]]
    want = dict.fromkeys(top(1, 30), "primary")
    for name, i in (("q", 2), ("r", 3)):
        want |= {x: name for x in top(i, 7) if x not in want}
    assert {k: v for k, v in got.items() if v in ("q", "r")} == {k: v for k, v in want.items() if v in ("q", "r")}
    assert len(got) == 50 and set(want) <= set(got) and sum(v == "diversity" for v in got.values()) <= 6
    assert retention_plan(df.where("false"), 50, primary=F.col("p"), secondary={}, key="id").count() == 0


@pytest.mark.parametrize("tile", [2, 512])
def test_pair_sums_equal_numpy(spark, tile):
    rng = random.Random(9)
    rows = [(g, f"S{s}", date(2020, 1, 1) + timedelta(d), None if rng.random() < 0.2 else rng.gauss(0, 0.1)) for g in ("x", "y") for s in range(5) for d in range(40) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "g string, symbol string, dt date, ret double").repartition(5)
    got = {(r.g, r.a, r.b): r for r in X.gram(df, keys=("g",), tile=tile).collect()}
    at = {(g, s, d): v for g, s, d, v in rows if v is not None}
    for g, a, b in itertools.product("xy", [f"S{i}" for i in range(5)], [f"S{i}" for i in range(5)]):
        both = [(at[g, a, d], at[g, b, d]) for gg, s, d in at if gg == g and s == a and (g, b, d) in at]
        if a > b:
            assert (g, a, b) not in got
            continue
        x, y = np.array(both).T
        assert np.allclose([got[g, a, b][c] for c in X.SUMS], [len(x), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum(), (x * x * y * y).sum()])
    rho = {(r.a, r.b): r.rho for r in X.correlations(df.where("g = 'x'")).collect()}
    x, y = np.array([(at["x", "S0", d], at["x", "S1", d]) for g, s, d in at if (g, s) == ("x", "S0") and ("x", "S1", d) in at]).T
    assert abs(rho["S0", "S1"] - np.corrcoef(x, y)[0, 1]) < 1e-9
    assert X.gram(df.where("false")).count() == 0


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_linkage_equals_the_plain_search(linkage):
    rng = random.Random(4)
    for n in (1, 2, 3, 8, 20):
        for ties in (False, True):
            m = np.zeros((n, n))
            for i, j in itertools.combinations(range(n), 2):
                m[i, j] = m[j, i] = rng.choice([0.1, 0.2, 0.4, 0.8]) if ties else rng.random()
            d = {(i, j): m[i, j] for i, j in itertools.combinations(range(n), 2)}
            size, want = dict.fromkeys(range(n), 1), []
            for node in range(n, 2 * n - 1):
                (a, b), best = min(d.items(), key=lambda kv: (kv[1], kv[0]))
                size[node] = size[a] + size[b]
                want.append((a, b, best, size[node]))
                for c in {x for p in d for x in p} - {a, b}:
                    x, y = d.pop((min(a, c), max(a, c))), d.pop((min(b, c), max(b, c)))
                    d[(c, node)] = max(x, y) if linkage == "complete" else (x * size[a] + y * size[b]) / size[node]
                del d[(a, b)]
            assert X.agglomerate(m, linkage) == want
