"""Walk-forward research: periods are a table, and slices are range joins, so all periods run in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from panelwright.operators.matrix import ledoit_wolf


def monthly_periods(latest: DataFrame, n: int, lookback: int = 12) -> DataFrame:
    """``n`` monthly periods ending at the last complete month of ``latest(dt)``: training months before, the next to evaluate."""
    one = latest.agg(F.max("dt").alias("d")).select(F.date_sub(F.trunc("d", "MONTH"), 1).alias("end"))
    ends = one.select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"), "end").select(F.last_day(F.add_months("end", -F.col("i"))).alias("decision_date"))
    return ends.select(
        F.date_format("decision_date", "yyyy-MM").alias("period_id"),
        F.date_add(F.last_day(F.add_months("decision_date", -lookback)), 1).alias("train_start"),
        F.col("decision_date").alias("train_end"),
        "decision_date",
        F.date_add("decision_date", 1).alias("eval_start"),
        F.last_day(F.date_add("decision_date", 1)).alias("eval_end"),
    )


def schedule_violations(periods: DataFrame) -> DataFrame:
    """``period_id, reason``: training after the decision, evaluation not after it, empty spans, overlap or gap with the period before."""
    w = Window.partitionBy(F.lit(0)).orderBy("decision_date", "period_id")
    df = periods.withColumn("_before", F.lag("eval_end").over(w))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("train_start") > F.col("train_end"), "empty_training"),
            F.when(F.col("train_end") > F.col("decision_date"), "training_after_decision"),
            F.when(F.col("eval_start") <= F.col("decision_date"), "evaluation_before_decision"),
            F.when(F.col("eval_start") > F.col("eval_end"), "empty_evaluation"),
            F.when(F.col("eval_start") <= F.col("_before"), "overlap"),
            F.when(F.col("eval_start") > F.date_add("_before", 1), "gap"),
            F.when(F.datediff("eval_end", "eval_start") > 35, "too_long"),
        )
    )
    return df.select("period_id", F.explode(reasons).alias("reason"))


def inner_folds(periods: DataFrame, folds: int, lookback: int) -> DataFrame:
    """The newest ``folds`` complete months inside each training span, with their own training of ``lookback`` months inside it too."""
    f = periods.select("period_id", "train_start", "train_end", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("i"))
    f = f.withColumn("eval_end", F.last_day(F.add_months("train_end", -F.col("i"))))
    f = f.withColumns({"fold": F.col("i").cast("bigint"), "eval_start": F.trunc("eval_end", "MONTH")})
    f = f.withColumn("inner_start", F.add_months("eval_start", -lookback))
    return f.where((F.col("inner_start") >= F.col("train_start")) & (F.col("eval_end") <= F.col("train_end"))).select("period_id", "fold", "inner_start", F.date_sub("eval_start", 1).alias("inner_end"), "eval_start", "eval_end")


def tuning_training_start(periods: DataFrame, folds: int, lookback: int) -> DataFrame:
    """``period_id, inner_start``: where training must begin to serve the newest ``folds`` months with ``lookback`` months before each."""
    return periods.select("period_id", F.add_months(F.trunc("train_end", "MONTH"), 1 - folds - lookback).alias("inner_start"))


def _within(levels: DataFrame, spans: DataFrame) -> DataFrame:
    """``levels`` with the rows of ``spans(_a, _b, ..)`` whose dates hold theirs: joined by month, of which a span lists those it touches."""
    months = F.explode(F.sequence(F.trunc("_a", "MONTH"), F.trunc("_b", "MONTH"), F.expr("INTERVAL 1 MONTH")))
    p = F.broadcast(spans.where("_a <= _b").withColumn("_month", months))  # periods times their months
    return levels.withColumn("_month", F.trunc("dt", "MONTH")).join(p, "_month").where(F.col("dt").between(F.col("_a"), F.col("_b"))).drop("_month")


def slice_panel(levels: DataFrame, periods: DataFrame, start: str, end: str) -> DataFrame:
    """``period_id`` and the panel's rows inside each period's span; the periods are the small side."""
    return _within(levels, periods.select("period_id", F.col(start).alias("_a"), F.col(end).alias("_b"))).drop("_a", "_b")


def trailing_momentum(levels: DataFrame, periods: DataFrame, months: int, *, tolerance: int = 7) -> DataFrame:
    """``period_id, symbol, momentum``: last level by the decision over the first on or after ``months`` earlier, both within
    ``tolerance`` days of those dates."""
    j = _within(levels, periods.select("period_id", F.add_months("decision_date", -months).alias("_a"), F.col("decision_date").alias("_b")))
    g = j.groupBy("period_id", "symbol").agg(F.min_by("value", "dt").alias("x"), F.max_by("value", "dt").alias("y"), F.min("dt").alias("a"), F.max("dt").alias("b"), F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return g.where((F.datediff("a", "_a") <= tolerance) & (F.datediff("_b", "b") <= tolerance)).select("period_id", "symbol", (F.col("y") / F.col("x") - 1).alias("momentum"))


def momentum_rank(momentum: DataFrame) -> DataFrame:
    w = Window.partitionBy("period_id").orderBy(F.desc("momentum"), "symbol")
    return momentum.withColumn("rank", F.row_number().over(w).cast("bigint"))


def dual_momentum(momentum: DataFrame, risky: DataFrame, *, k: int, threshold: float = 0.0) -> DataFrame:
    """``period_id, symbol, weight, regime``: the top ``k`` risky symbols above the threshold, else the top ``k`` of the rest."""
    m = momentum.join(F.broadcast(risky.select("symbol").withColumn("_r", F.lit(True))), "symbol", "left").withColumn("_r", F.coalesce("_r", F.lit(False)))
    on = F.bool_or(F.col("_r") & (F.col("momentum") > threshold)).over(Window.partitionBy("period_id"))
    m = m.withColumn("_on", on).where(F.when(F.col("_on"), F.col("_r") & (F.col("momentum") > threshold)).otherwise(~F.col("_r")))
    top = momentum_rank(m).where(F.col("rank") <= k)
    weight = 1 / F.count(F.lit(1)).over(Window.partitionBy("period_id"))
    return top.select("period_id", "symbol", weight.alias("weight"), F.when(F.col("_on"), "risky").otherwise("defensive").alias("regime"))


def allocate_inverse_vol(returns: DataFrame, *, least: int = 24) -> DataFrame:
    """Weights by one over the shrunk volatility of symbols with at least ``least`` returns."""
    enough = returns.groupBy("symbol").agg(F.count("ret").alias("_n")).where(F.col("_n") >= least)
    lw = ledoit_wolf(returns.join(enough, "symbol", "left_semi")).where("a = b")
    inverse = 1 / F.sqrt("cov")
    return lw.select(F.col("a").alias("symbol"), (inverse / F.sum(inverse).over(Window.partitionBy(F.lit(0)))).alias("weight"))


def oos_chain(levels: DataFrame, periods: DataFrame, decisions: DataFrame, *, cost_bps: float = 10.0, initial: float = 1.0) -> DataFrame:
    """``period_id, growth, turnover, cost, index, equity``: one value over all periods.

    In a period its decision is bought at the last level by the decision date and held. At a hand-off the union of old (drifted)
    and new weights is traded, and the cost reduces equity. The first period is bought from cash.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("decision_date")
    order = periods.withColumn("_i", F.row_number().over(w).cast("bigint")).select("period_id", "decision_date", "eval_end", "_i")
    d = decisions.join(F.broadcast(order), "period_id")
    asked = d.select("symbol", F.explode(F.array("decision_date", "eval_end")).alias("dt")).distinct()
    both = levels.select("symbol", "dt", "value", F.lit(0).alias("_asked")).union(asked.select("symbol", "dt", F.lit(None).cast("double"), F.lit(1)))
    upto = Window.partitionBy("symbol").orderBy("dt", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("value", F.last("value", ignorenulls=True).over(upto)).where("_asked = 1 and value is not null")
    legs = d.join(last.select("symbol", F.col("dt").alias("eval_end"), F.col("value").alias("b")), ["symbol", "eval_end"])
    legs = legs.join(last.select("symbol", F.col("dt").alias("decision_date"), F.col("value").alias("a")), ["symbol", "decision_date"], "left")
    legs = legs.withColumn("g", F.col("weight") * F.col("b") / F.col("a"))
    growth = legs.groupBy("period_id", "_i").agg(F.sum("g").alias("growth"))
    drifted = legs.join(growth.select("period_id", "growth"), "period_id").select((F.col("_i") + 1).alias("_i"), "symbol", (F.col("g") / F.col("growth")).alias("old"))
    moved = legs.select("_i", "symbol", F.col("weight").alias("new")).join(drifted, ["_i", "symbol"], "full")
    turnover = moved.groupBy("_i").agg(F.sum(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("turnover"))
    df = growth.join(turnover, "_i").withColumn("cost", F.col("turnover") * cost_bps / 10_000)
    index = F.exp(F.sum(F.log("growth") + F.log1p(-F.col("cost"))).over(Window.partitionBy(F.lit(0)).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("index", index).select("period_id", "growth", "turnover", "cost", "index", (initial * F.col("index")).alias("equity"))


def evaluation_check(decisions: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Selected symbols without an observation in their evaluation span."""
    return decisions.select("period_id", "symbol").join(evaluation.select("period_id", "symbol").distinct(), ["period_id", "symbol"], "left_anti")


def decision_hash(decisions: DataFrame) -> DataFrame:
    """SHA-256 of a period's sorted symbols and weights (six places); a definition of its own."""
    row = F.concat("symbol", F.lit("="), F.floor(F.col("weight") * 1_000_000 + 0.5).cast("string"))
    return decisions.groupBy("period_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "|"), 256).alias("decision_hash"))


def param_grid(spark, lookbacks: list[int], ks: list[int], thresholds: list[float]) -> DataFrame:
    """``lookback, k, threshold, param_hash`` in canonical order of a cartesian grid."""
    each = lambda name, xs, kind: F.explode(F.array(*[F.lit(x).cast(kind) for x in sorted(set(xs))])).alias(name)
    g = spark.range(1).select(each("lookback", lookbacks, "int")).select("*", each("k", ks, "int")).select("*", each("threshold", thresholds, "double"))
    return g.withColumn("param_hash", F.sha2(F.concat_ws("|", "lookback", "k", F.floor(F.col("threshold") * 1_000_000 + 0.5).cast("string")), 256))
