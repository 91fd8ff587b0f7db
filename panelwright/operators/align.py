"""Calendar alignment and joins. Values are carried forward only, never back, and returns are never taken over a fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from panelwright.operators.windows import by_symbol, running


def calendar_union(levels: DataFrame) -> DataFrame:
    return levels.select("dt").distinct()


def calendar_intersection(levels: DataFrame) -> DataFrame:
    """Dates on which every symbol was observed."""
    n = levels.agg(F.countDistinct("symbol").alias("_n"))
    return levels.groupBy("dt").agg(F.countDistinct("symbol").alias("_c")).join(F.broadcast(n), F.col("_c") == F.col("_n"), "left_semi").select("dt")


def align_benchmark(levels: DataFrame, benchmark: DataFrame) -> DataFrame:
    return levels.join(benchmark.select("dt", F.col("value").alias("bvalue")), "dt")


def union_calendar_ffill(levels: DataFrame, *, complete: bool = True) -> DataFrame:
    """Every symbol on every date of the union calendar, carried forward; leading dates go until every symbol has a value.

    The panel is dense by definition: symbols by dates, from the two distinct lists.
    """
    grid = levels.select("dt").distinct().crossJoin(levels.select("symbol").distinct())
    df = grid.join(levels.select("symbol", "dt", "value"), ["symbol", "dt"], "left")
    df = df.withColumn("value", F.last("value", ignorenulls=True).over(running(by_symbol())))
    if not complete:
        return df.where("value is not null")
    start = levels.groupBy("symbol").agg(F.min("dt").alias("_f")).agg(F.max("_f").alias("_start"))
    return df.join(F.broadcast(start), F.col("dt") >= F.col("_start")).drop("_start")


def value_in_base_ccy(levels: DataFrame, conventions: DataFrame, fx: DataFrame) -> DataFrame:
    """``symbol, dt, native, fx, value, ret, is_native_obs`` on the union of a symbol's and its currency's calendars.

    Both sides are carried forward and count from when both are known; a base-currency symbol has rate 1 on its own dates. The
    first return is 0.
    """
    own = levels.join(F.broadcast(conventions), "symbol").select("symbol", "dt", (F.col("value") * F.col("scale")).alias("native"), "currency", "is_base")
    abroad = own.where("NOT is_base")
    rates = fx.join(F.broadcast(conventions.where("NOT is_base").select("symbol", "currency").join(levels.select("symbol").distinct(), "symbol", "left_semi")), "currency").select("symbol", "dt", F.col("level").alias("fx"))
    both = abroad.select("symbol", "dt", "native").join(rates, ["symbol", "dt"], "full")
    both = both.union(own.where("is_base").select("symbol", "dt", "native", F.lit(1.0)))
    w = by_symbol()
    fill = lambda c: F.last(c, ignorenulls=True).over(running(w))
    df = both.select("symbol", "dt", fill("native").alias("native"), fill("fx").alias("fx"), F.col("native").isNotNull().alias("is_native_obs"))
    df = df.where("native is not null and fx is not null").withColumn("value", F.col("native") * F.col("fx"))
    return df.withColumn("ret", F.coalesce(F.col("value") / F.lag("value").over(w) - 1, F.lit(0.0)))


def fx_triangulate(first: DataFrame, second: DataFrame) -> DataFrame:
    """``dt, level`` of two rates chained on the union of their calendars, both carried forward (keys: ``currency``)."""
    w = Window.partitionBy("currency").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    df = first.select("currency", "dt", F.col("level").alias("a")).join(second.select("currency", "dt", F.col("level").alias("b")), ["currency", "dt"], "full")
    return df.select("currency", "dt", (F.last("a", ignorenulls=True).over(w) * F.last("b", ignorenulls=True).over(w)).alias("level")).where("level is not null")


def fx_invert(bars: DataFrame) -> DataFrame:
    """Reciprocal bars: the low's reciprocal is the high."""
    keep = [c for c in bars.columns if c not in ("open", "high", "low", "close")]
    return bars.select(*keep, (1 / F.col("open")).alias("open"), (1 / F.col("low")).alias("high"), (1 / F.col("high")).alias("low"), (1 / F.col("close")).alias("close"))


def fx_pick_best(quality: DataFrame) -> DataFrame:
    """The best method of each currency: fewest unresolved, jumps, corrections, then direct before triangulated, then priority."""
    return quality.groupBy("currency").agg(F.min_by("method", F.struct("unresolved", "jumps", "corrections", "triangulated", "priority")).alias("method"))


def clip_with_prior(levels: DataFrame, start: Column, end: Column, *keys: str) -> DataFrame:
    """Rows in ``[start, end]`` and the last one before."""
    w = Window.partitionBy(*(keys or ("symbol",)), F.col("dt") < start).orderBy(F.desc("dt"))
    return levels.withColumn("_n", F.row_number().over(w)).where(F.col("dt").between(start, end) | ((F.col("dt") < start) & (F.col("_n") == 1))).drop("_n")


def asof_ffill(series: DataFrame, calendar: DataFrame, *keys: str) -> DataFrame:
    """The last value at or before each calendar date, by key: union, carry forward, keep the calendar's rows."""
    known = series.select(*keys, "dt", "value", F.lit(0).alias("_asked"))
    wanted = series.select(*keys).distinct().crossJoin(calendar.select("dt")).select(*keys, "dt", F.lit(None).cast("double").alias("value"), F.lit(1).alias("_asked"))
    w = Window.partitionBy(*keys).orderBy("dt", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    return known.union(wanted).withColumn("value", F.last("value", ignorenulls=True).over(w)).where("_asked = 1").drop("_asked")


def common_window(levels: DataFrame, portfolios: DataFrame) -> DataFrame:
    """``portfolio_id, start, end``: latest first and earliest last date of the members."""
    span = levels.groupBy("symbol").agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    return portfolios.join(span, "symbol").groupBy("portfolio_id").agg(F.max("a").alias("start"), F.min("b").alias("end"))


def align_components(components: DataFrame) -> DataFrame:
    """Returns on the union calendar within the common window, missing ones 0, the first row 0; total = price + distribution.

    ``components``: ``symbol, dt, total_ret, price_ret, dist_ret``.
    """
    span = components.groupBy("symbol").agg(F.min("dt").alias("a"), F.max("dt").alias("b")).agg(F.max("a").alias("_a"), F.min("b").alias("_b"))
    inside = components.join(F.broadcast(span), F.col("dt").between(F.col("_a"), F.col("_b")))
    grid = inside.select("dt").distinct().crossJoin(components.select("symbol").distinct())
    df = grid.join(inside.drop("_a", "_b"), ["symbol", "dt"], "left")
    first = F.col("dt") == F.min("dt").over(Window.partitionBy("symbol"))
    return df.select("symbol", "dt", *[F.when(first, 0.0).otherwise(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("total_ret", "price_ret", "dist_ret")])


def execution_eligible_dates(portfolios: DataFrame, observed: DataFrame) -> DataFrame:
    """``portfolio_id, dt`` on which every member has a quote of its own."""
    n = portfolios.groupBy("portfolio_id").agg(F.countDistinct("symbol").alias("_n"))
    seen = portfolios.join(observed.where("is_native_obs").select("symbol", "dt").distinct(), "symbol").groupBy("portfolio_id", "dt").agg(F.count(F.lit(1)).alias("_c"))
    return seen.join(F.broadcast(n), "portfolio_id").where("_c = _n").select("portfolio_id", "dt")


def execution_clock_audit(trades: DataFrame, portfolios: DataFrame, observed: DataFrame) -> DataFrame:
    """Trades on dates on which some member had no fresh quote: ``portfolio_id, dt, stale`` (sorted members)."""
    asked = trades.select("portfolio_id", "dt").distinct().join(portfolios.select("portfolio_id", "symbol"), "portfolio_id")
    missing = asked.join(observed.where("is_native_obs").select("symbol", "dt"), ["symbol", "dt"], "left_anti")
    return missing.groupBy("portfolio_id", "dt").agg(F.array_sort(F.collect_set("symbol")).alias("stale"))


def missing_symbol_failures(portfolios: DataFrame, resolved: DataFrame) -> DataFrame:
    """Portfolios with members that did not resolve: ``portfolio_id, missing`` (sorted)."""
    return portfolios.join(resolved.select("symbol").distinct(), "symbol", "left_anti").groupBy("portfolio_id").agg(F.array_sort(F.collect_set("symbol")).alias("missing"))


def outcome_accounting(requested: DataFrame, resolved: DataFrame, failed: DataFrame) -> DataFrame:
    """Violations of ``requested = resolved + failed``: ``symbol, problem`` (both, neither, unrequested)."""
    mark = lambda df, c: df.select("symbol").distinct().withColumn(c, F.lit(True))
    df = mark(requested, "q").join(mark(resolved, "r"), "symbol", "full").join(mark(failed, "f"), "symbol", "full")
    q, r, f = (F.coalesce(c, F.lit(False)) for c in "qrf")
    problem = F.when(~q, "unrequested").when(r & f, "both").when(~r & ~f, "neither")
    return df.select("symbol", problem.alias("problem")).where("problem is not null")


def subset_batch(outcomes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``symbol, pos, status`` of a requested list in its order; unaccounted symbols have status ``unaccounted``."""
    return wanted.join(outcomes, "symbol", "left").select("symbol", "pos", F.coalesce("status", F.lit("unaccounted")).alias("status"))


def panel_parity(a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``symbol, column`` of identities that differ between two panels; null equals null."""
    x, y = a.select("symbol", *[F.col(c).alias(f"a_{c}") for c in columns]), b.select("symbol", *[F.col(c).alias(f"b_{c}") for c in columns])
    same = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c) for c in columns]))
    return x.join(y, "symbol", "full").select("symbol", F.explode(same).alias("column"))


def coverage_diagnostics(levels: DataFrame, calendar: DataFrame) -> DataFrame:
    """``symbol, first_pos, last_pos, n_expected, n_missing, coverage`` against a reference calendar's positions.

    Positions count on the calendar alone (a short list of dates); coverage is the share of its dates between a symbol's
    first and last observation.
    """
    pos = calendar.select("dt").distinct().withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("dt")).cast("bigint"))
    g = levels.join(F.broadcast(pos), "dt").groupBy("symbol").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n"))
    expected = F.col("last_pos") - F.col("first_pos") + 1
    return g.select("symbol", "first_pos", "last_pos", expected.alias("n_expected"), (expected - F.col("n")).alias("n_missing"), (F.col("n") / expected).alias("coverage"))


def strict_coverage_gate(diagnostics: DataFrame, n_calendar: int, *, least: float = 0.98, slack: int = 5) -> DataFrame:
    """``symbol, reason`` of symbols that start late, end early or have gaps."""
    reasons = F.array_compact(F.array(F.when(F.col("coverage") < least, "coverage"), F.when(F.col("first_pos") > 1 + slack, "late_start"), F.when(F.col("last_pos") < n_calendar - slack, "early_end")))
    return diagnostics.select("symbol", F.explode(reasons).alias("reason"))
