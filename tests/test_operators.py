"""Small hand-made cases, naive loops and causality."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators import align, audit, clean, combos, matrix, metrics, nav, regress, scan, walk, windows

D0 = date(2020, 1, 1)


def levels(spark, series, start=D0, step=1):
    rows = [(s, start + timedelta(days=step * i), float(v)) for s, vs in series.items() for i, v in enumerate(vs) if v is not None]
    return spark.createDataFrame(rows, "symbol string, dt date, value double")


def test_empty_and_single(spark):
    none, one = levels(spark, {}), levels(spark, {"A": [5]})
    assert metrics.metrics_report(none, none.select("dt", "value")).count() == 0
    r = metrics.metrics_report(one, one.select("dt", "value")).first()
    assert (r.total_return, r.cagr, r.volatility, r.sharpe, r.beta) == (0.0, None, None, None, None)


def test_constant_series_has_no_ratio(spark):
    c = levels(spark, {"A": [2, 2, 2, 2]})
    r = metrics.metrics_report(c, c.select("dt", "value")).first()
    assert r.volatility == 0 and r.sharpe is None and r.sortino is None and r.beta is None
    assert matrix.correlations(windows.daily_returns(levels(spark, {"A": [2, 2, 2, 2], "B": [1, 2, 1, 3]}))).first().rho is None


def test_total_loss_ends_an_index(spark):
    r = spark.createDataFrame([("A", D0 + timedelta(days=i), x) for i, x in enumerate([None, 0.5, -1.0, 0.5])], "symbol string, dt date, ret double")
    assert [x["index"] for x in windows.return_index(r).orderBy("dt").collect()] == pytest.approx([1, 1.5, 0, 0])


def test_missing_asset_day_kills_two_pairs(spark):
    b = levels(spark, {"B": [1, 2, 3, 4, 5, 6]}).select("dt", "value")
    pairs = metrics.benchmark_calendar_returns(levels(spark, {"A": [1, 2, None, 4, 5, 6]}), b).orderBy("dt").collect()
    assert [p.dt.day for p in pairs] == [2, 5, 6]


def test_forward_fill_never_looks_ahead(spark):
    rows = align.union_calendar_ffill(levels(spark, {"A": [1, None, 3, None], "B": [None, 5, None, 7]})).orderBy("symbol", "dt").collect()
    assert [(r.symbol, r.dt.day, r.value) for r in rows] == [("A", 2, 1.0), ("A", 3, 3.0), ("A", 4, 3.0), ("B", 2, 5.0), ("B", 3, 5.0), ("B", 4, 7.0)]


def test_equal_peaks_move_the_peak(spark):
    r = windows.top_drawdowns(levels(spark, {"A": [10, 8, 10, 10, 5, 6]})).collect()
    assert [(x.depth, x.peak_dt.day, x.trough_dt.day, x.recovery_dt and x.recovery_dt.day) for x in r] == [(pytest.approx(-0.5), 4, 5, None), (pytest.approx(-0.2), 1, 2, 3)]


def test_clean_levels_takes_the_last_good_arrival(spark):
    rows = [("A", "2020-01-01", "1", 0), ("A", "2020-01-01", "2", 1), ("A", "2020-01-02", "nan", 0), ("A", "2020-01-03", "-1", 0), ("A", "2020-01-04", "x", 0), ("A", None, "1", 0)]
    got = clean.clean_levels(spark.createDataFrame(rows, "symbol string, dt string, value string, arrival int")).collect()
    assert [(r.dt.day, r.value) for r in got] == [(1, 2.0)]


@pytest.mark.parametrize("total, bad", [(99.98, True), (99.995, False), (100.02, True)])
def test_weight_sum(spark, total, bad):
    p = spark.createDataFrame([("P", "A", total / 200), ("P", "B", total / 200)], "portfolio_id string, symbol string, weight double")
    assert (clean.weight_violations(p).count() > 0) == bad


def naive_nav(prices, weights, flags, rate):
    """A day loop with shares."""
    names, n = list(weights), len(next(iter(prices.values())))
    value, out = 1.0, []
    shares = {s: weights[s] / prices[s][0] for s in names}
    for t in range(n):
        value = sum(shares[s] * prices[s][t] for s in names)
        if flags[t]:
            value *= 1 - rate * sum(abs(weights[s] - shares[s] * prices[s][t] / value) for s in names)
            shares = {s: value * weights[s] / prices[s][t] for s in names}
        out.append(value)
    return out


def test_segments_equal_a_day_loop(spark):
    rng = random.Random(1)
    prices = {s: list(np.cumprod([1 + rng.uniform(-0.1, 0.12) for _ in range(200)])) for s in "ABC"}
    weights = {"A": 0.5, "B": 0.3, "C": 0.2}
    panel = levels(spark, prices)
    p = spark.createDataFrame([("P", s, w) for s, w in weights.items()], "portfolio_id string, symbol string, weight double")
    flags = nav.rebalance_flags(panel, "MONTH", "first")
    got = nav.nav_periodic(panel, p, flags, cost_bps=25).orderBy("dt").collect()
    want = naive_nav(prices, weights, [r.flag for r in flags.orderBy("dt").collect()], 0.0025)
    assert [r.nav for r in got] == pytest.approx(want, rel=1e-12)
    assert sum(r.rebalanced for r in got) == 6


def test_combos_equal_held_portfolios(spark):
    rng = random.Random(2)
    prices = {s: list(np.cumprod([1 + rng.uniform(-0.1, 0.12) for _ in range(200)])) for s in "ABCDE"}
    panel = levels(spark, prices)
    names, dates, matrix_ = combos.price_matrix(panel)
    ranks = combos.combo_ranks(spark, 5, 3, at_once=4)
    c = combos.enumerate_combos(ranks, names, 3)
    assert [("".join(r.members)) for r in c.orderBy("combo_rank").collect()] == ["ABC", "ABD", "ABE", "ACD", "ACE", "ADE", "BCD", "BCE", "BDE", "CDE"]
    firsts = [r.flag for r in nav.rebalance_flags(panel, "MONTH", "first").orderBy("dt").collect()]
    for mode, flags in (("never", [False] * 200), ("monthly", firsts)):
        for r in combos.evaluate_combos(ranks.where("combo_rank % 3 = 0"), names, dates, matrix_, np.arange(1.0, 201), 3, modes=(mode,), delay=0).collect():
            want = naive_nav({s: prices[s] for s in r.members}, dict.fromkeys(r.members, 1 / 3), flags, 0.0)
            assert r.total_return == pytest.approx(want[-1] - 1, rel=1e-9)
            assert r.max_drawdown == pytest.approx((np.array(want) / np.maximum.accumulate(want) - 1).min(), abs=1e-12)


def test_decisions_do_not_see_the_future(spark):
    rng = random.Random(3)
    series = {s: list(np.cumprod([1 + rng.uniform(-0.05, 0.06) for _ in range(420)])) for s in "ABCDEF"}
    p = walk.monthly_periods(levels(spark, series), 3)
    first = p.orderBy("decision_date").first().decision_date
    cut = (first - D0).days
    changed = {s: [v if i <= cut else v * rng.uniform(0.2, 5) for i, v in enumerate(vs)] for s, vs in series.items()}
    risky = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    decide = lambda x: sorted(tuple(r) for r in walk.dual_momentum(walk.trailing_momentum(levels(spark, x), p.where(F.col("decision_date") == first), 3), risky, k=2).collect())
    assert decide(series) == decide(changed) and decide(series)


def test_risk_components_add_up(spark):
    rng = np.random.default_rng(4)
    r = [(s, D0 + timedelta(days=i), float(x)) for s in "ABCD" for i, x in enumerate(rng.normal(0, 0.01, 60))]
    cov = matrix.ledoit_wolf(spark.createDataFrame(r, "symbol string, dt date, ret double"))
    w = spark.createDataFrame([("P", s, x) for s, x in zip("ABCD", (0.4, 0.3, 0.2, 0.1), strict=True)], "portfolio_id string, symbol string, weight double")
    rows = matrix.risk_contributions(cov, w).collect()
    assert sum(x.component for x in rows) == pytest.approx(rows[0].variance ** 0.5, rel=1e-12)


def test_linkage_of_known_distances():
    d = np.array([[0, 1, 4, 5], [1, 0, 3, 6], [4, 3, 0, 2], [5, 6, 2, 0]], dtype=float)
    assert matrix.agglomerate(d, "average") == [(0, 1, 1.0, 2), (2, 3, 2.0, 2), (4, 5, 4.5, 4)]
    assert matrix.agglomerate(d, "complete")[-1] == (4, 5, 6.0, 4)


def test_gram_ols_equals_lstsq(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3))
    y = 0.3 + x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.1, 80)
    rows = [("A", *map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [("B", 0.0, 0.0, 0.0, 1.0)]
    got = regress.gram_ols(spark.createDataFrame(rows, "symbol string, f1 double, f2 double, f3 double, y double"), ("f1", "f2", "f3")).collect()
    want = np.linalg.lstsq(np.column_stack([np.ones(80), x]), y, rcond=None)[0]
    assert len(got) == 1 and [got[0].alpha, got[0].beta_f1, got[0].beta_f2, got[0].beta_f3] == pytest.approx(want, rel=1e-9)


def test_xirr(spark):
    f = [("R", D0, -1.0), ("R", D0 + timedelta(days=365), 500.0), ("L", D0, -100.0), ("L", D0 + timedelta(days=365), 0.1), ("A", D0, -100.0), ("A", D0 + timedelta(days=365), 110.0), ("B", D0, 1.0), ("C", D0, -100.0), ("C", D0 + timedelta(days=365), 230.0), ("C", D0 + timedelta(days=730), -132.0)]
    got = {r.portfolio_id: (r.status, r.rate) for r in regress.xirr_batch(spark.createDataFrame(f, "portfolio_id string, dt date, amount double")).collect()}
    assert got["A"][0] == "unique" and got["A"][1] == pytest.approx(1.1 ** (365.2425 / 365) - 1, abs=1e-8)
    assert all(got[p][0] == "unique" and 1 + got[p][1] == pytest.approx(x ** (365.2425 / 365), rel=1e-8) for p, x in (("R", 500.0), ("L", 0.001)))
    assert got["B"] == ("no_solution", None) and got["C"][0] == "multiple"


def test_bar_repair_and_pulse(spark):
    bars = [("A", D0 + timedelta(days=i), 10.0, 11.0, 9.0, c) for i, c in enumerate([10, 10, 100, 10.5, 10])]
    got = audit.bar_repair(spark.createDataFrame([(*b[:5], float(b[5])) for b in bars], "symbol string, dt date, open double, high double, low double, close double")).orderBy("dt").collect()
    assert [r.repaired for r in got] == [False, False, True, False, False] and got[2].close == pytest.approx((10 * 10.5) ** 0.5)
    p = audit.pulse_repair(levels(spark, {"A": [1, 1, 100, 1, 50]})).orderBy("dt").collect()
    assert [r.value for r in p] == [1, 1, 1, 1, 50]


def days_repaired(bars, tolerance=1.005):
    """Bar repair of one symbol by scanning all days for each: ``dt: (close, repaired, future_assisted, unresolved)``."""
    n = len(bars)
    day, level = [b[1].toordinal() for b in bars], [b[5] for b in bars]
    inside = lambda i, x: x is not None and bars[i][4] / tolerance <= x <= bars[i][3] * tolerance
    valid = [None not in b[2:5] and min(b[2:5]) > 0 and b[4] <= b[3] and inside(i, b[2]) for i, b in enumerate(bars)]
    good = [valid[i] and inside(i, level[i]) for i in range(n)]
    fixed, ahead = [False] * n, [False] * n
    line = lambda i, p, q: math.exp(math.log(level[p]) + (math.log(level[q]) - math.log(level[p])) * (day[i] - day[p]) / (day[q] - day[p]))
    for i in range(n):
        if valid[i] and not good[i]:
            p, q = max((j for j in range(i) if good[j]), default=None), min((j for j in range(i + 1, n) if good[j]), default=None)
            ahead[i] = None not in (p, q)
            level[i] = min(max(line(i, p, q) if ahead[i] else bars[i][2], bars[i][4]), bars[i][3])
            fixed[i] = good[i] = True
    for i in range(1, n - 1):
        a, x, b = level[i - 1 : i + 2]
        if valid[i] and not fixed[i] and all(y is not None and y > 0 for y in (a, x, b)):
            jumps = (x > a and x > b and min(x / a, x / b) >= 3) or (x < a and x < b and min(a / x, b / x) >= 3)
            if jumps and max(a / b, b / a) <= 1.5 and inside(i, line(i, i - 1, i + 1)):
                level[i], fixed[i], ahead[i] = min(max(line(i, i - 1, i + 1), bars[i][4]), bars[i][3]), True, True
    return {b[1]: (level[i], fixed[i], ahead[i], valid[i] and not inside(i, level[i])) for i, b in enumerate(bars) if level[i] is not None and level[i] > 0}


def test_bar_repair_equals_a_day_loop(spark):
    rng, bars = random.Random(5), []
    for symbol in ("A", "B", "C", "D"):
        dt, price = D0, 10.0
        for _ in range(150):
            dt += timedelta(days=rng.choice([1, 1, 1, 3]))
            price *= math.exp(rng.uniform(-0.1, 0.1))
            wide = rng.choice([1.02, 1.1, 20.0])
            close = price * rng.choice([1, 1, 1, 1.3, 10, 0.1, 1 / 30])
            odd = rng.random()
            high, low = (None, price) if odd < 0.03 else (price / wide, price * wide) if odd < 0.06 else (price * wide, price / wide)
            bars.append((symbol, dt, price * (3 if odd > 0.97 else 1), high, low, None if 0.06 < odd < 0.09 else -close if 0.09 < odd < 0.11 else close))
    df = spark.createDataFrame(bars, "symbol string, dt date, open double, high double, low double, close double").withColumn("_extra", F.lit("x"))
    got = audit.bar_repair(df.repartition(3))
    assert got.columns == ["symbol", "dt", "open", "high", "low", "_extra", "close", "repaired", "future_assisted", "unresolved"]
    rows = {(r.symbol, r.dt): (r.close, r.repaired, r.future_assisted, r.unresolved) for r in got.collect()}
    want = {(s, d): x for s in "ABCD" for d, x in days_repaired([b for b in bars if b[0] == s]).items()}
    assert rows.keys() == want.keys() and sum(x[1] for x in want.values()) > 100
    assert any(x[1] and abs(b[5] / b[2] - 10) < 1 and b[3] > 15 * b[2] for b in bars if (x := want.get(b[:2])) and b[5])  # a bridge in a wide bar
    for k, w in want.items():
        assert rows[k] == (pytest.approx(w[0], rel=1e-12), *w[1:]), k
    assert audit.bar_repair(df.limit(0)).count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([(" brk.b ", "$1,234.5%", "3/4/2021", "1e12"), ("a b", "N/A", "2021-02-30", "1600000000"), (None, "inf", "March 5, 2021", "x")], "a string, b string, c string, d string")
    r = df.select(S.normalize_ticker(F.col("a")), S.optional_number(F.col("b")), S.source_date(F.col("c")), S.first_trade_date(F.col("d"), F.lit("America/New_York")), S.universe_ticker(F.col("a"))).collect()
    assert tuple(r[0]) == ("BRK.B", 1234.5, date(2021, 3, 4), date(2001, 9, 8), "BRK-B")
    assert tuple(r[1])[:4] == (None, None, None, date(2020, 9, 13))
    assert tuple(r[2])[:4] == (None, None, date(2021, 3, 5), None)


def test_entry_without_the_corpus_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scan_rows_settle_every_request(spark):
    series = {"A": [10, 11, 12, 9], "B": [5, None, None, None], "C": [3, None, 4, 5], "unasked": [1, 2, 3, 4]}
    lv, bench = levels(spark, series), levels(spark, {"X": [1, 2, 3, 2]}).select("dt", "value")
    bars = lv.select("symbol", "dt", F.col("value").alias("close"), F.col("value").alias("adj_close"), F.lit(0.0).alias("dividends"), F.lit(0.0).alias("splits"))
    asked = spark.createDataFrame([("A",), ("A",), ("B",), ("C",), ("D",), ("E",), (None,)], "symbol string")
    failed = spark.createDataFrame([("E", "fx", "no rate", False), ("E", "load", "later", True), ("A", "fx", "not so", True)], "symbol string, stage string, detail string, retryable boolean")
    run = lambda lv: {r.symbol: r for r in scan.scan_rows(asked, lv, bench, bars=bars, raw=lv, raw_benchmark=bench, failures=failed).collect()}
    got = run(lv)
    assert {k: (r.status, r.error_code, r.retryable) for k, r in got.items()} == {
        "A": ("ok", None, False),
        "B": ("failed", "calendar_unavailable", False),
        "C": ("ok", None, False),
        "D": ("failed", "download_unavailable", True),
        "E": ("failed", "fx_unavailable", False),
    }
    assert (got["A"].n_shared, got["A"].data_coverage, got["C"].n_shared, got["C"].data_coverage) == (4, 1.0, 3, 0.75)
    assert got["B"].cagr is None and got["B"].price_fingerprint is None and got["A"].total_return == pytest.approx(-0.1)
    moved = run(lv.withColumn("value", F.when((F.col("symbol") == "A") & (F.col("dt") == D0), 10.001).otherwise(F.col("value"))))
    assert moved["A"].price_fingerprint != got["A"].price_fingerprint and moved["A"].aligned_fingerprint != got["A"].aligned_fingerprint
    assert moved["C"].price_fingerprint == got["C"].price_fingerprint
    assert run(lv.limit(0))["A"].error_code == "fx_unavailable"
