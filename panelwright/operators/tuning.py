"""Nested tuning of walk-forward decisions: every candidate on inner folds of each training span, the winner refit on all of it.

One plan, keyed by (period, candidate, fold). A candidate is judged on months that end inside its period's training
span, so nothing after a decision can change a winner. Prices are read by equality on calendar dates and months; no join is a
range over the panel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

CANDIDATE = ("lookback", "k", "threshold", "allocation")


def candidates(spark: SparkSession, lookbacks: list[int], ks: list[int], thresholds: list[float], allocations: list[str]) -> DataFrame:
    """:data:`CANDIDATE` and ``param_hash`` of a grid; a handful of rows."""
    rows = [(a, b, c, d) for a in sorted(set(lookbacks)) for b in sorted(set(ks)) for c in sorted(set(thresholds)) for d in sorted(set(allocations))]
    grid = spark.createDataFrame(rows, "lookback int, k int, threshold double, allocation string")
    return grid.withColumn("param_hash", F.sha2(F.concat_ws("|", "lookback", "k", F.floor(F.col("threshold") * 1_000_000 + 0.5).cast("string"), "allocation"), 256))


def on_calendar(calendar: DataFrame, dates: DataFrame, *, before: bool) -> DataFrame:
    """``at, dt``: the last calendar date up to each date ``at``, or the first from it on; null where there is none.

    Both tables hold distinct dates, the only rows that the window without a key sees.
    """
    both = calendar.select(F.col("dt").alias("at"), "dt", F.lit(0).alias("asked")).union(dates.select("at", F.lit(None).cast("date"), F.lit(1)))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("at") if before else F.desc("at"), "asked").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("dt", F.last("dt", ignorenulls=True).over(w)).where("asked = 1").select("at", "dt")


def momentum_at(panel: DataFrame, asks: DataFrame) -> DataFrame:
    """``decision_date, lookback, symbol, momentum`` of a dense panel for the distinct ``(decision_date, lookback)`` of ``asks``."""
    calendar = panel.select("dt").distinct()
    points = asks.select("decision_date", "lookback").distinct().withColumn("from", F.add_months("decision_date", -F.col("lookback")))
    end = on_calendar(calendar, points.select(F.col("decision_date").alias("at")).distinct(), before=True)
    start = on_calendar(calendar, points.select(F.col("from").alias("at")).distinct(), before=False)
    points = points.join(end.select(F.col("at").alias("decision_date"), F.col("dt").alias("b")), "decision_date").join(start.select(F.col("at").alias("from"), F.col("dt").alias("a")), "from")
    points = points.select("decision_date", "lookback", F.inline(F.array(F.struct(F.col("a").alias("dt"), F.lit(True).alias("first")), F.struct(F.col("b").alias("dt"), F.lit(False).alias("first")))))
    both = panel.select("symbol", "dt", "value").join(F.broadcast(points), "dt")  # dates of the calendar times look-backs
    levels = both.groupBy("decision_date", "lookback", "symbol").agg(F.max(F.when(F.col("first"), F.col("value"))).alias("x"), F.max(F.when(~F.col("first"), F.col("value"))).alias("y"))
    return levels.where("x is not null and y is not null").select("decision_date", "lookback", "symbol", (F.col("y") / F.col("x") - 1).alias("momentum"))


def allocated_decisions(panel: DataFrame, asks: DataFrame, risky: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys, symbol, weight, regime``: dual momentum of each row of ``asks(keys, train_start, decision_date, CANDIDATE)``.

    The top ``k`` risky symbols above the threshold, else the top ``k`` of the rest, with equal weights or by one over
    the volatility of the panel's returns from ``train_start`` to the decision; a symbol without volatility gets no weight then.
    """
    m = momentum_at(panel, asks).join(F.broadcast(risky.select("symbol").withColumn("_r", F.lit(True))), "symbol", "left").withColumn("_r", F.coalesce("_r", F.lit(False)))
    d = asks.join(m, ["decision_date", "lookback"])
    above = F.col("_r") & (F.col("momentum") > F.col("threshold"))
    each = Window.partitionBy(*keys)
    d = d.withColumn("_on", F.bool_or(above).over(each)).where(F.when(F.col("_on"), above).otherwise(~F.col("_r")))
    d = d.withColumn("_n", F.row_number().over(each.orderBy(F.desc("momentum"), "symbol"))).where(F.col("_n") <= F.col("k"))
    d = d.withColumn("regime", F.when(F.col("_on"), "risky").otherwise("defensive"))

    returns = panel.withColumn("ret", F.col("value") / F.lag("value").over(Window.partitionBy("symbol").orderBy("dt")) - 1)
    returns = returns.where("ret is not null").select("symbol", F.trunc("dt", "MONTH").alias("_month"), "dt", "ret")
    weighed = d.where("allocation = 'inverse_vol'").select(*keys, "symbol", "train_start", "decision_date", F.explode(F.sequence(F.trunc("train_start", "MONTH"), F.trunc("decision_date", "MONTH"), F.expr("INTERVAL 1 MONTH"))).alias("_month"))
    near = weighed.join(returns, ["symbol", "_month"]).where(F.col("dt").between(F.col("train_start"), F.col("decision_date")))
    iv = near.groupBy(*keys, "symbol").agg((1 / F.nullif(F.stddev_samp("ret"), F.lit(0.0))).alias("_iv"))
    d = d.join(iv, [*keys, "symbol"], "left").withColumn("_w", F.when(F.col("allocation") == "inverse_vol", F.col("_iv")).otherwise(1.0)).where("_w is not null")
    return d.select(*keys, "symbol", (F.col("_w") / F.sum("_w").over(each)).alias("weight"), "regime")


def inner_returns(panel: DataFrame, folds: DataFrame, decisions: DataFrame, *, cost_bps: float) -> DataFrame:
    """``period_id, param_hash, fold, dt, ret, cost``: what each candidate's decisions return by date over its folds, costs included.

    ``folds``: one month each, the newest is fold 0. A decision is bought at the last date up to it and held; at the first date of a
    fold the cost of trading from the drifted old weights (from cash in the oldest fold) is paid.
    """
    keys = ["period_id", "param_hash", "fold"]
    calendar = panel.select("dt").distinct()
    base = on_calendar(calendar, folds.select(F.col("decision_date").alias("at")).distinct(), before=True).select(F.col("at").alias("decision_date"), F.col("dt").alias("_base"))
    days = folds.join(base, "decision_date").join(calendar.select("dt", F.trunc("dt", "MONTH").alias("_month")), F.trunc("eval_start", "MONTH") == F.col("_month")).select("period_id", "fold", "_base", "dt")
    legs = decisions.join(F.broadcast(days.select("period_id", "fold", "_base").distinct()), ["period_id", "fold"])  # periods times folds
    legs = legs.join(panel.select("symbol", F.col("dt").alias("_base"), F.col("value").alias("_a")), ["symbol", "_base"])
    path = legs.join(F.broadcast(days.select("period_id", "fold", "dt")), ["period_id", "fold"]).join(panel.select("symbol", "dt", "value"), ["symbol", "dt"])
    path = path.select(*keys, "symbol", "weight", "dt", (F.col("weight") * F.col("value") / F.col("_a")).alias("part"))
    nav = path.groupBy(*keys, "dt").agg(F.sum("part").alias("nav"))
    ends = path.groupBy(*keys, "symbol").agg(F.max_by("part", "dt").alias("part"), F.first("weight").alias("weight"))
    drift = ends.withColumn("old", F.col("part") / F.sum("part").over(Window.partitionBy(*keys)))
    old = drift.select("period_id", "param_hash", (F.col("fold") - 1).alias("fold"), "symbol", "old").where("fold >= 0")
    moved = ends.select(*keys, "symbol", F.col("weight").alias("new")).join(old, [*keys, "symbol"], "full")
    cost = moved.groupBy(*keys).agg((F.sum(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))) * (cost_bps / 10_000)).alias("_cost"))
    before = F.lag("nav").over(Window.partitionBy(*keys).orderBy("dt"))
    df = nav.join(cost, keys).withColumn("_before", before)
    first = F.col("_before").isNull()
    return df.select(*keys, "dt", (F.col("nav") / F.coalesce("_before", F.lit(1.0)) * F.when(first, 1 - F.col("_cost")).otherwise(1.0) - 1).alias("ret"), F.when(first, F.col("_cost")).otherwise(0.0).alias("cost"))


def tune_parameters(panel: DataFrame, periods: DataFrame, folds: DataFrame, risky: DataFrame, grid: DataFrame, *, n_folds: int, per_year: int = 52, cost_bps: float = 10.0, land: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """``period_id, param_hash, CANDIDATE, status, reason, n_folds, sortino, max_drawdown, cagr, costs, rank``: all candidates of all periods.

    ``folds``: of :func:`panelwright.operators.walk.inner_folds`. A candidate fails, with a reason and without a rank, where the training holds
    fewer than ``n_folds`` folds (``insufficient_training``), a fold has no decision or price (``no_selection``) or a metric is
    unavailable (``metrics_unavailable``). Rank: Sortino, then the smaller drawdown, the larger CAGR, the smaller costs, the hash.
    ``land`` may write a table that the plan reads more than once and give it back as read.
    """
    full = folds.groupBy("period_id").agg(F.count(F.lit(1)).alias("_folds"))
    used = folds.join(F.broadcast(full.where(F.col("_folds") == n_folds)), "period_id", "left_semi").withColumnRenamed("inner_end", "decision_date")
    used = used.join(F.broadcast(periods.select("period_id", "train_start")), "period_id").select("period_id", "fold", "train_start", "decision_date", "eval_start")
    asks = used.crossJoin(F.broadcast(grid))  # periods x folds x a grid of a few rows: the work itself
    used, asks = land(used, "folds"), land(asks, "asks")
    decisions = land(allocated_decisions(panel, asks, risky, ("period_id", "param_hash", "fold")), "decisions")
    r = land(inner_returns(panel, used, decisions, cost_bps=cost_bps), "returns")
    run = Window.partitionBy("period_id", "param_hash").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(run)))
    r = r.withColumns({"peak": F.greatest(F.lit(1.0), F.max("equity").over(run)), "before": F.col("equity") / (1 + F.col("ret"))})
    g = r.groupBy("period_id", "param_hash").agg(
        F.countDistinct("fold").alias("n_folds"),
        (F.avg("ret") * per_year**0.5 / F.nullif(F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), F.lit(2.0)))), F.lit(0.0))).alias("sortino"),
        F.min(F.col("equity") / F.col("peak") - 1).alias("max_drawdown"),
        F.max_by("equity", "dt").alias("_last"),
        F.max("dt").alias("_to"),
        F.sum(F.col("cost") * F.col("before")).alias("costs"),
    )
    span = used.groupBy("period_id").agg(F.min("decision_date").alias("_from"))
    df = periods.select("period_id").crossJoin(F.broadcast(grid)).join(F.broadcast(full), "period_id", "left").join(F.broadcast(span), "period_id", "left").join(g, ["period_id", "param_hash"], "left")
    df = df.withColumns({"cagr": F.pow("_last", F.lit(365.25) / F.datediff("_to", "_from")) - 1, "n_folds": F.coalesce("n_folds", F.lit(0).cast("bigint"))})
    reason = F.when(F.coalesce("_folds", F.lit(0)) < n_folds, "insufficient_training").when(F.col("n_folds") < n_folds, "no_selection").when(F.col("sortino").isNull() | F.col("cagr").isNull(), "metrics_unavailable")
    df = df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "eligible").otherwise("failed"))
    order = Window.partitionBy("period_id", "status").orderBy(F.round("sortino", 9).desc(), F.round(F.abs("max_drawdown"), 9), F.round("cagr", 9).desc(), F.round("costs", 9), "param_hash")
    df = df.withColumn("rank", F.when(F.col("status") == "eligible", F.row_number().over(order)).cast("bigint"))
    return df.select("period_id", "param_hash", *CANDIDATE, "status", "reason", "n_folds", "sortino", "max_drawdown", "cagr", "costs", "rank")


def refit_winner(panel: DataFrame, periods: DataFrame, tuned: DataFrame, risky: DataFrame) -> DataFrame:
    """``period_id, CANDIDATE, symbol, weight, regime``: each period's own winner, decided on the period's whole training span."""
    asks = periods.select("period_id", "train_start", "decision_date").join(tuned.where("rank = 1").select("period_id", *CANDIDATE), "period_id")
    d = allocated_decisions(panel, asks, risky, ("period_id",))
    return asks.select("period_id", *CANDIDATE).join(d, "period_id")
