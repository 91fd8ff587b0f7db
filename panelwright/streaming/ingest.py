"""Landed snapshots as a stream: each micro-batch is judged against the last accepted snapshots and committed under its own number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

LANDED = "universe_id string, source_as_of date, fetched_date date, is_proxy boolean, members array<string>, member_count bigint, checksum string"
STATE = "universe_id string, source_as_of date, members array<string>"
KEY = ["universe_id", "source_as_of"]


def _earlier(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """What batches before this one have committed below ``path``; nothing where there is none yet."""
    try:
        df = spark.read.schema(f"{schema}, batch_id bigint").parquet(path)
        df.limit(1).count()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        df = spark.createDataFrame([], f"{schema}, batch_id bigint")
    return df.where(F.col("batch_id") < batch_id)


def judged(batch: DataFrame, state: DataFrame, as_of: Column, *, low: int = 1, high: int = 1000, most_turnover: float = 0.5, future_days: int = 2, stale_days: int | None = None) -> DataFrame:
    """``batch`` (one row a universe and date) with ``reason``, null where a snapshot is accepted.

    A universe's snapshots are taken in order of date; each one's turnover is against the last accepted, which is ``state`` (one row a
    universe) at first. An older snapshot than the state is judged against it but does not take its place.
    """
    rows = batch.groupBy("universe_id").agg(F.array_sort(F.collect_list(F.struct("source_as_of", *[c for c in batch.columns if c not in KEY]))).alias("rows"))
    rows = rows.join(state.select("universe_id", F.struct("source_as_of", "members").alias("last")), "universe_id", "left")
    kept = rows.schema["rows"].dataType.elementType.simpleString()
    start = F.struct(F.col("last"), F.array().cast(f"array<struct<row:{kept},reason:string>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        age = F.datediff(as_of, x["source_as_of"])
        before = acc["last"]["members"]
        turnover = F.when(F.size(before) > 0, 1 - F.size(F.array_intersect(x["members"], before)) / F.size(before))
        reason = F.when(age < -future_days, "future")
        if stale_days is not None:
            reason = reason.when(age > stale_days, "stale")
        reason = reason.when(~F.coalesce(x["member_count"].between(low, high), F.lit(False)), "count").when(F.coalesce(turnover > most_turnover, F.lit(False)), "churn")
        newer = reason.isNull() & (acc["last"].isNull() | (x["source_as_of"] >= acc["last"]["source_as_of"]))
        last = F.when(newer, F.struct(x["source_as_of"].alias("source_as_of"), x["members"].alias("members"))).otherwise(acc["last"])
        return F.struct(last.alias("last"), F.concat(acc["done"], F.array(F.struct(x.alias("row"), reason.alias("reason")))).alias("done"))

    done = rows.select("universe_id", F.explode(F.aggregate("rows", start, step)["done"]).alias("d"))
    return done.select("universe_id", *[F.col("d.row")[c].alias(c) for c in batch.columns if c != "universe_id"], F.col("d.reason").alias("reason")).select(*batch.columns, "reason")


def publish(spark: SparkSession, batch: DataFrame, batch_id: int, archive: str, rejects: str, state: str, as_of: str, **limits) -> None:
    """Commits one batch: accepted snapshots, rejects with reasons, and the last accepted snapshot of every universe.

    All three are folders of the batch's number, written over, and only earlier numbers are read, so that a batch that is
    run again leaves the same tables. Of snapshots of one universe and date the first fetched counts; those that the archive has are left out.
    """
    columns = [c.split()[0] for c in LANDED.split(", ")]
    first = Window.partitionBy(*KEY).orderBy("fetched_date", "checksum")
    known = _earlier(spark, archive, LANDED, batch_id).select(*KEY)
    fresh = batch.select(*columns).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(known, KEY, "left_anti").select(*columns)
    before = _earlier(spark, state, STATE, batch_id)
    newest = before.agg(F.max("batch_id")).first()[0]  # one number
    before = before.where(F.col("batch_id") == F.lit(newest)).drop("batch_id")
    named = judged(fresh, before, F.lit(as_of).cast("date"), **limits).persist()
    accepted = named.where("reason is null")
    latest = accepted.select("universe_id", "source_as_of", "members").unionByName(before).groupBy("universe_id").agg(F.max_by(F.struct("source_as_of", "members"), "source_as_of").alias("x")).select("universe_id", "x.*")
    for df, to in ((accepted.select(*columns), archive), (named.where("reason is not null").select(*KEY, "reason"), rejects), (latest, state)):
        df.write.mode("overwrite").parquet(f"{to}/batch_id={batch_id}")
    named.unpersist()


def ingest_snapshots(spark: SparkSession, landing: str, archive: str, rejects: str, checkpoint: str, as_of: str, **limits) -> None:
    """Processes what has landed and stops; the state is a table beside the archive."""
    stream = spark.readStream.schema(LANDED).parquet(landing)
    run = lambda batch, n: publish(spark, batch, n, archive, rejects, f"{archive}-state", as_of, **limits)
    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
