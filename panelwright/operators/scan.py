"""One row per requested symbol: measures, coverage, audit and fingerprints, or why there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelwright.operators.audit import corporate_action_audit, series_fingerprint
from panelwright.operators.metrics import TRADING_DAYS, benchmark_coverage, metrics_report
from panelwright.operators.screen import scan_scores

AUDITED = ("n_dividends", "n_splits", "n_factor_jump", "n_distribution_gap", "n_split_like", "n_large_move")


def aligned_fingerprint(levels: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``symbol, n_shared, fingerprint``: SHA-256 of the dates that a symbol shares with the benchmark, with both values (ten-thousandths)."""
    shown = lambda c: F.floor(F.col(c) * 10_000 + 0.5).cast("string")
    pairs = levels.join(benchmark.select("dt", F.col("value").alias("_b")), "dt")
    row = F.struct("dt", F.concat_ws("=", F.date_format("dt", "yyyy-MM-dd"), shown("value"), shown("_b")).alias("r"))
    g = pairs.where("value is not null and _b is not null").groupBy("symbol").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return g.select("symbol", F.size("rows").cast("bigint").alias("n_shared"), F.sha2(F.array_join("rows.r", "|"), 256).alias("fingerprint"))


def scan_rows(requested: DataFrame, levels: DataFrame, benchmark: DataFrame, *, bars: DataFrame, raw: DataFrame, raw_benchmark: DataFrame, failures: DataFrame | None = None, rf: float = 0.0, periods: int = TRADING_DAYS) -> DataFrame:
    """A row for each distinct ``symbol`` of ``requested``, in one schema whether it is ``ok`` or ``failed``.

    ``levels`` are valued levels, ``raw`` and ``raw_benchmark`` the calendars as observed, by which ``data_coverage`` counts (a carried
    level is no observation), ``bars`` what is audited. ``failures(symbol, stage, detail, retryable)`` says why a symbol has no levels;
    one without a word of it failed to download and can be tried again. A symbol with fewer than two dates of the benchmark's fails at
    ``calendar`` and can't. Levels, bars and failures of symbols that nobody asked for are left out; of several failures of a symbol the
    first by stage counts. Failed rows have nulls for every measure, the others for every error. Null symbols are not requests.
    """
    asked = requested.select("symbol").where("symbol is not null").distinct()
    own = levels.join(asked, "symbol", "left_semi")
    aligned = aligned_fingerprint(own, benchmark).select("symbol", "n_shared", F.col("fingerprint").alias("aligned_fingerprint"))
    usable = own.join(aligned.where("n_shared >= 2").select("symbol"), "symbol", "left_semi")
    ends = usable.groupBy("symbol").agg(F.min("dt").alias("data_start"), F.max("dt").alias("data_end"))
    scored = scan_scores(metrics_report(usable, benchmark, rf=rf, periods=periods)).withColumnRenamed("status", "score_status")
    audit = corporate_action_audit(bars.join(asked, "symbol", "left_semi"))
    audit = audit.select("symbol", *AUDITED, F.get("warning_dates", F.lit(0)).alias("first_warning"), F.col("status").alias("audit_status"))
    coverage = benchmark_coverage(raw.join(asked, "symbol", "left_semi"), raw_benchmark).select("symbol", F.col("coverage").alias("data_coverage"))
    prices = series_fingerprint(usable).withColumnRenamed("fingerprint", "price_fingerprint")
    measured = scored.join(ends, "symbol").join(aligned, "symbol").join(prices, "symbol").join(audit, "symbol", "left").join(coverage, "symbol", "left")
    measured = measured.withColumn("data_coverage", F.coalesce("data_coverage", F.lit(0.0)))

    seen = own.select("symbol").distinct().withColumn("_seen", F.lit(True))
    rows = asked.join(measured.withColumn("_ok", F.lit(True)), "symbol", "left").join(seen, "symbol", "left")
    reason = F.struct(F.lit("download").alias("stage"), F.lit("requested history was not returned").alias("detail"), F.lit(True).alias("retryable"))
    if failures is not None:
        told = failures.groupBy("symbol").agg(F.min(F.struct("stage", "detail", "retryable")).alias("_told"))
        rows = rows.join(told, "symbol", "left")
        reason = F.coalesce("_told", reason)
    short = F.struct(F.lit("calendar").alias("stage"), F.lit("fewer than two shared valuation dates").alias("detail"), F.lit(False).alias("retryable"))
    why = F.when(F.col("_ok").isNull(), F.when(F.col("_seen"), short).otherwise(reason))
    return rows.select(
        "symbol",
        F.when(F.col("_ok"), "ok").otherwise("failed").alias("status"),
        F.coalesce(why["retryable"], F.lit(False)).alias("retryable"),
        F.concat(why["stage"], F.lit("_unavailable")).alias("error_code"),
        why["detail"].alias("error"),
        *[c for c in measured.columns if c != "symbol"],
    )
