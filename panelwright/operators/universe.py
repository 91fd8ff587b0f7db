"""Universe versions and point-in-time membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def member_lists(members: DataFrame) -> DataFrame:
    """``universe_id, source_as_of, fetched_date, is_proxy, members, member_count, checksum`` of one-row-per-member snapshots."""
    g = members.groupBy("universe_id", "source_as_of", "fetched_date", "is_proxy").agg(F.array_sort(F.collect_set("member")).alias("members"))
    return g.withColumns({"member_count": F.size("members").cast("bigint"), "checksum": member_checksum(F.col("members"))})


def member_checksum(members: Column) -> Column:
    """SHA-256 of the sorted members joined by newlines."""
    return F.sha2(F.array_join(F.array_sort(members), "\n"), 256)


def churn(snapshots: DataFrame) -> DataFrame:
    """``n, previous, count_change, turnover, added, removed`` against the snapshot before."""
    w = Window.partitionBy("universe_id").orderBy("source_as_of")
    df = snapshots.withColumn("_b", F.lag("members").over(w))
    kept = F.size(F.array_intersect("members", "_b"))
    before = F.size("_b")
    return df.where("_b is not null").select(
        "universe_id",
        "source_as_of",
        F.size("members").cast("bigint").alias("n"),
        before.cast("bigint").alias("previous"),
        (F.abs(F.size("members") - before) / before).alias("count_change"),
        (1 - kept / before).alias("turnover"),
        F.array_sort(F.array_except("members", "_b")).alias("added"),
        F.array_sort(F.array_except("_b", "members")).alias("removed"),
    )


def pit_snapshot_asof(decisions: DataFrame, snapshots: DataFrame, *, stale_days: int = 10) -> DataFrame:
    """For each ``(decision_date)`` and universe the latest snapshot of and fetched by that date, with ``reason`` if it can't serve.

    ``reason``: ``missing``, ``stale`` (older than ``stale_days``), ``count_mismatch`` or ``checksum_mismatch``. The snapshot
    table is joined by inequality; the decisions are the small side.
    """
    s = snapshots.select("universe_id", "source_as_of", "fetched_date", "members", "member_count", "checksum")
    asked = decisions.select("decision_date").distinct().crossJoin(F.broadcast(s.select(F.col("universe_id").alias("u")).distinct()))
    j = asked.join(s, (F.col("u") == F.col("universe_id")) & (F.col("source_as_of") <= F.col("decision_date")) & (F.col("fetched_date") <= F.col("decision_date")), "left")
    best = F.max(F.struct("source_as_of", "fetched_date", "member_count", "checksum", "members")).alias("s")
    g = j.groupBy(F.col("u").alias("universe_id"), "decision_date").agg(best)
    age = F.datediff("decision_date", "s.source_as_of")
    reason = (
        F.when(F.col("s.source_as_of").isNull(), "missing")
        .when(age > stale_days, "stale")
        .when(F.size("s.members") != F.col("s.member_count"), "count_mismatch")
        .when(member_checksum(F.col("s.members")) != F.col("s.checksum"), "checksum_mismatch")
    )
    return g.select("universe_id", "decision_date", F.col("s.source_as_of").alias("source_as_of"), F.col("s.member_count").alias("member_count"), reason.alias("reason"), F.col("s.members").alias("members"))


def pit_membership_screen(served: DataFrame, limit: int) -> DataFrame:
    """``universe_id, decision_date, ticker`` of usable snapshots, in ticker order, at most ``limit`` of each."""
    ok = served.where("reason is null")
    return ok.select("universe_id", "decision_date", F.explode(F.slice(F.array_sort("members"), 1, limit)).alias("ticker"))


def current_universe(snapshots: DataFrame, as_of: Column, *, stale_days: int = 10) -> DataFrame:
    """The newest snapshot of each universe and whether it is stale."""
    g = snapshots.groupBy("universe_id").agg(F.max(F.struct("source_as_of", "fetched_date", "member_count")).alias("s"))
    return g.select("universe_id", "s.source_as_of", "s.member_count", (F.datediff(as_of, F.col("s.source_as_of")) > stale_days).alias("is_stale"))


def retain_latest_versions(snapshots: DataFrame, n: int = 12) -> DataFrame:
    w = Window.partitionBy("universe_id").orderBy(F.desc("fetched_date"), F.desc("source_as_of"))
    return snapshots.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def admission_windows(snapshots: DataFrame, as_of: Column, *, days: int = 10, most: int = 100) -> DataFrame:
    """``opens, closes`` of non-proxy snapshots of at most ``most`` members, and whether a universe admits at all."""
    opens = F.greatest("source_as_of", "fetched_date")
    closes = F.least(F.date_add("source_as_of", days), as_of)
    df = snapshots.select("universe_id", "source_as_of", "is_proxy", "member_count", opens.alias("opens"), closes.alias("closes"))
    reason = F.when(F.col("is_proxy"), "proxy").when(F.col("member_count") > most, "too_many").when(F.col("opens") > F.col("closes"), "closed")
    return df.withColumn("reason", reason)


def ingest_decision(snapshots: DataFrame, as_of: Column, *, low: int = 1, high: int = 1000, most_turnover: float = 0.5, future_days: int = 2, stale_days: int | None = None) -> DataFrame:
    """``universe_id, source_as_of, accepted, reason``: freshness, count bounds and churn of landed snapshots."""
    c = churn(snapshots).select("universe_id", "source_as_of", "turnover")
    df = snapshots.select("universe_id", "source_as_of", "member_count").join(c, ["universe_id", "source_as_of"], "left")
    age = F.datediff(as_of, F.col("source_as_of"))
    reason = F.when(age < -future_days, "future")
    if stale_days is not None:
        reason = reason.when(age > stale_days, "stale")
    reason = reason.when(~F.col("member_count").between(low, high), "count").when(F.coalesce(F.col("turnover") > most_turnover, F.lit(False)), "churn")
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
