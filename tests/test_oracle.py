"""Registered queries against their SQL on the smallest test tables: some of each module; the driver compares them all."""

from __future__ import annotations

import os

import duckdb
import pytest

from panelwright.plans import catalog

SF, DENSER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
CHOSEN = (
    "metrics_report beta_alpha var_cvar top_drawdowns return_index period_returns month_heatmap clean_levels benchmark_calendar_returns value_in_base_ccy union_calendar_ffill "
    "coverage_diagnostics outcome_accounting macro_asof_ffill sample_covariance risk_contributions nav_buy_hold nav_periodic_cost twr_from_flows allocation_drift income_split "
    "screen_universe score_rank membership_churn pit_snapshot_asof corporate_action_audit bar_repair native_components combination_count enumerate_combos trailing_momentum dual_momentum "
    "slice_panel validate_schedule read_holdings_csv read_macro_series ingest_snapshots inflation_regime execution_delay experiment_variants "
    "normalize_sector normalize_universe_ticker scan_rows param_grid export_scan_csv xirr_batch structural_snapshot marginal_experiments"
).split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple("" if x is None else str(x) for x in r))


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    df, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    assert ordered(df.select(*columns).collect()) == ordered(con.sql(f"SELECT {', '.join(columns)} FROM want").fetchall())


SEARCH = "combo_scores best_combo combo_metric_filter combo_sort_page combo_materialize retention_plan export_combo_csv".split()


@pytest.mark.parametrize("name", SEARCH)
def test_combination_query_equals_sql(spark, con, name):
    test_query_equals_sql(spark, con, name)


def test_evaluated_combinations_equal_sql(spark, con):
    """By relative differences: on so few sales a price can grow by ten digits, and six places are more than a double has."""
    df, want = QUERIES["evaluate_combos"](spark, SF), con.sql(SQL["evaluate_combos"])
    assert df.columns == want.columns
    text = [c for c, t in df.dtypes if t != "double"]
    rows = lambda xs: sorted((tuple(x[want.columns.index(c)] for c in text), tuple(v for v, c in zip(x, want.columns, strict=True) if c not in text)) for x in map(tuple, xs))
    got, expected = rows(df.collect()), rows(want.fetchall())
    assert [k for k, _ in got] == [k for k, _ in expected] and len(got) > 1000
    assert all(a == pytest.approx(b, rel=1e-9, abs=2e-6) for (_, a), (_, b) in zip(got, expected, strict=True))


MONTHS = "validate_monthly_schedule inner_folds relative_momentum_rank momentum_top_k oos_chain pick_combo_winner tuning_training_start decision_hash evaluation_check configured_equal_weight dual_momentum_allocated tune_parameters candidate_rank refit_winner".split()


@pytest.mark.parametrize("name", MONTHS)
def test_query_over_all_months_equals_sql(spark, con, name):
    test_query_equals_sql(spark, con, name)


@pytest.mark.parametrize("name", "unpivot_bars allocate_equal allocate_inverse_vol ledoit_wolf downside_correlation stress_correlation pair_correlations".split())
def test_other_query_equals_sql(spark, con, name):
    test_query_equals_sql(spark, con, name)


def test_periods_follow_the_panel(spark):
    months = {r.period_id for r in QUERIES["tuning_training_start"](spark, DENSER).collect()}
    days = spark.read.parquet(f"{DENSER}/lineitem.parquet").selectExpr("min(l_shipdate)", "max(l_shipdate)").first()
    assert {"1996-03", "1999-12", "2000-06"} <= months and len(months) > 36
    assert str(days[0])[:7] < min(months) and max(months) < str(days[1])[:7]


def test_combinations_of_all_symbols(spark):
    n = spark.read.parquet(f"{DENSER}/part.parquet").select("p_brand").distinct().count()
    assert n > 12 and QUERIES["enumerate_combos"](spark, DENSER).count() == n * (n - 1) * (n - 2) // 6


@pytest.mark.parametrize("name", ["hierarchical_clusters", "factor_ols"])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DENSER).count() > 0
