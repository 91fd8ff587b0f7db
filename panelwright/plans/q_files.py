"""Queries of sources, sinks and the snapshot stream over files that Spark derives from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import walk as K
from panelwright.plans import q_screen
from panelwright.plans.registry import query
from panelwright.sources import adapters as A, files as S
from panelwright.streaming.ingest import ingest_snapshots as ingest


@query("symbol dt", "close dividends", sql="SELECT symbol, dt, close, dividends FROM x_bars WHERE symbol IN ('Brand#1', 'Brand#7', 'Brand#13') AND dt >= DATE '1997-01-01' AND dt < DATE '1998-01-01'")
def read_bars(spark, sf):
    at = S.shared_folder(spark, "bars")
    A.bars(spark, sf).withColumns({"capital_gains": F.lit(0.0), "repaired": F.lit(False)}).write.parquet(at)
    return S.read_bars(spark, at, ["Brand#1", "Brand#7", "Brand#13", "None"], "1997-01-01", "1998-01-01")[0]


@query("symbol status", sql="SELECT DISTINCT p_brand AS symbol, 'resolved' AS status FROM part UNION ALL SELECT r_name, 'failed' FROM region")
def request_outcomes(spark, sf):
    asked = A.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct().union(A.table(spark, sf, "region").select("r_name"))
    return S.request_outcomes(asked, A.daily_levels(spark, sf))


@query("currency dt", "level", sql="SELECT currency, dt, level FROM x_fx WHERE dt BETWEEN DATE '1997-01-01' - 10 AND DATE '1997-06-30' + 1")
def read_fx_bars(spark, sf):
    return S.read_fx_bars(A.fx_levels(spark, sf), "1997-01-01", "1997-06-30")


@query("symbol dt", "close low", sql="SELECT symbol, dt, close, low FROM x_bars")
def unpivot_bars(spark, sf):
    """A wide table of all symbols, as downloads have it, made long."""
    b = A.bars(spark, sf)
    names = [r.symbol for r in b.select("symbol").distinct().orderBy("symbol").collect()]  # a universe
    wide = b.groupBy("dt").pivot("symbol", names).agg(F.first("close").alias("close"), F.first("low").alias("low"))
    wide = wide.toDF("dt", *[f"{c}|{s}" for s in names for c in ("close", "low")])
    return S.unpivot_bars(wide, ("close", "low"))


@query("as_of ticker sector", "weight", sql="SELECT DATE '2024-03-05' AS as_of, 'P' || p_partkey AS ticker, p_type AS sector, p_size / 10.0 AS weight FROM part WHERE p_size % 2 = 0")
def read_holdings_csv(spark, sf):
    at = S.shared_folder(spark, "holdings-csv")
    p = A.table(spark, sf, "part")
    row = F.concat_ws(",", F.concat(F.lit('"P'), F.col("p_partkey").cast("string"), F.lit('"')), F.concat(F.lit('"'), "p_name", F.lit('"')), "p_type", F.when(F.col("p_size") % 2 == 0, "Equity").otherwise("Cash"), (F.col("p_size") / 10).cast("string"))
    one = p.groupBy(F.col("p_type")).agg(F.concat(F.lit('Fund Holdings as of,"Mar 5"\nMarch 5, 2024\n\nTicker,Name,Sector,Asset Class,Weight (%)\n'), F.array_join(F.collect_list(row), "\n")).alias("value"))
    one.repartition(3).select("value").write.option("lineSep", "\n\n").option("maxRecordsPerFile", 1).text(at)
    return S.read_holdings_csv(spark, at)


@query("ticker name", "weight", sql="SELECT 'P' || p_partkey AS ticker, p_name AS name, p_size * 1.0 AS weight FROM part WHERE p_type <> 'SMALL' OR p_size % 2 = 0")
def read_holdings_json(spark, sf):
    at = S.shared_folder(spark, "holdings-json")
    p = A.table(spark, sf, "part").select("p_type", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("weight"), F.when(F.col("p_size") % 2 == 0, "COM").otherwise("CASH").alias("type"))
    g = p.groupBy("p_type").agg(F.collect_list(F.struct("ticker", "name", "weight", "type")).alias("items"))
    table = F.to_json(F.struct(F.transform("items", lambda x: F.array(x["ticker"], x["name"], x["weight"].cast("string"))).alias("aaData"), F.size("items").alias("count")))
    value = F.when(F.col("p_type") == "SMALL", F.to_json(F.struct(F.col("items").alias("holdings")))).when(F.col("p_type") == "ECONOMY", table).otherwise(F.to_json(F.struct(F.col("items").alias("constituents"))))
    g.select(value.alias("value")).repartition(8).write.option("maxRecordsPerFile", 1).text(at)
    return S.read_holdings_json(spark, at)


@query("ticker sector", "market_cap trailing_pe", sql="SELECT ticker, sector, market_cap, trailing_pe FROM x_fund")
def read_fundamentals(spark, sf):
    at = S.shared_folder(spark, "fundamentals")
    f = A.fundamentals(spark, sf).select("ticker", "name", "sector", "industry", F.concat(F.lit("$"), F.col("market_cap").cast("string")).alias("market_cap"), F.coalesce(F.col("trailing_pe").cast("string"), F.lit("N/A")).alias("trailing_pe"))
    f.groupBy("sector").agg(F.to_json(F.struct(F.collect_list(F.struct(*f.columns)).alias("data"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(at)
    return S.read_fundamentals(spark, at, least=100)


@query("month_end", "mkt rf", sql="SELECT dt AS month_end, floor(value * 10000 + 0.5) / 10000 / 100 AS mkt, 0.001 AS rf FROM x_bm")
def read_monthly_factors(spark, sf):
    from pyspark.sql.window import Window

    b = A.benchmark_monthly(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("dt")))
    rows = b.select("n", F.concat_ws(",", F.date_format("dt", "yyyyMM"), (F.floor(F.col("value") * 10_000 + 0.5) / 10_000).cast("decimal(18,4)").cast("string"), F.lit("0.1")).alias("value"))
    head = A.table(spark, sf, "region").where("r_regionkey < 2").select((F.col("r_regionkey") - 5).alias("n"), F.when(F.col("r_regionkey") == 0, "A header").otherwise(",Mkt,RF").alias("value"))
    annual = b.where("month(dt) = 12").select((F.col("n") + 10_000).alias("n"), F.concat(F.date_format("dt", "  yyyy"), F.lit(",1,2")).alias("value"))
    df = S.parse_factor_text(head.union(rows).union(annual))
    return df.select("month_end", F.col("values")[0].alias("mkt"), F.col("values")[1].alias("rf"))


@query("series_id dt", "value", sql="SELECT symbol AS series_id, dt, CASE WHEN month(dt) <> 2 THEN floor(value * 10000 + 0.5) / 10000 END AS value FROM x_monthly")
def read_macro_series(spark, sf):
    m = A.monthly_levels(spark, sf)
    text = F.when(F.month("dt") == 2, ".").otherwise((F.floor(F.col("value") * 10_000 + 0.5) / 10_000).cast("decimal(18,4)").cast("string"))
    obs = F.struct(F.date_format("dt", "yyyy-MM-dd").alias("date"), text.alias("value"))
    first = F.struct(F.date_format("dt", "yyyy-MM-dd").alias("date"), F.lit("1").alias("value"))
    j = m.groupBy(F.col("symbol").alias("series_id")).agg(F.to_json(F.struct(F.concat(F.collect_list(first), F.collect_list(obs)).alias("observations"))).alias("json"))
    return S.parse_macro(j)


@query("universe_id source_as_of member_count", sql="SELECT universe_id, source_as_of, count(*) AS member_count FROM x_snap GROUP BY 1, 2")
def write_snapshot_archive(spark, sf):
    at = S.shared_folder(spark, "archive")
    staged = q_screen.lists(spark, sf).withColumn("version", F.date_format("fetched_date", "yyyyMMdd"))
    S.write_snapshot_archive(staged, at)
    S.write_snapshot_archive(staged, at, spark.read.parquet(at))  # once more: nothing is added
    return spark.read.parquet(at)


@query("symbol first_warning warnings", sql=f"SELECT symbol, min(dt) FILTER ({q_screen._WARN}) AS first_warning, coalesce(array_to_string(list_transform(list_slice(list(dt ORDER BY dt) FILTER ({q_screen._WARN}), 1, 20), lambda x: strftime(x, '%Y-%m-%d')), ' | '), '') AS warnings FROM ({q_screen._EVENTS}) GROUP BY symbol")
def export_scan_csv(spark, sf):
    from panelwright.operators.audit import corporate_action_audit

    df = corporate_action_audit(q_screen.adjusted_bars(spark, sf)).select("symbol", F.get("warning_dates", F.lit(0)).alias("first_warning"), F.col("warning_dates").alias("warnings"))
    return S.export_scan_csv(df)


_ROW_HASH = "CAST('0x' || substr(md5(symbol || '|' || CAST(dt AS VARCHAR) || '|' || CAST(CAST(floor(value * 1000000 + 0.5) AS BIGINT) AS VARCHAR)), 1, 12) AS BIGINT)"


@query("symbol start_dt end_dt n_symbols n_rows fingerprint", sql=f"SELECT symbol, min(dt) AS start_dt, max(dt) AS end_dt, count(DISTINCT symbol) AS n_symbols, count(*) AS n_rows, CAST(sum({_ROW_HASH}) AS VARCHAR) AS fingerprint FROM x_daily GROUP BY ROLLUP (symbol)")
def write_prepared_panel(spark, sf):
    at = S.shared_folder(spark, "panel")
    A.daily_levels(spark, sf).write.parquet(at)
    return S.prepared_panel_manifest(spark.read.parquet(at))


def _runs(spark, sf):
    o = A.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("library_id"), F.lit(None).cast("string").alias("source_run_id"), F.to_json(F.struct(F.col("o_custkey").alias("customer"))).alias("request_json"), F.lit(1).alias("decision_count"), F.to_timestamp("o_orderdate").alias("created_at"))


@query("run_id library_id", sql="SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority AS library_id FROM orders WHERE o_orderpriority = '5-LOW' ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 50")
def list_research_runs(spark, sf):
    return S.list_research_runs(_runs(spark, sf), F.lit("5-LOW"))


@query("library_id n", sql="SELECT o_orderpriority AS library_id, count(*) AS n FROM orders GROUP BY 1")
def append_research_run(spark, sf):
    at = S.shared_folder(spark, "runs")
    S.append_research_run(_runs(spark, sf), at)
    return spark.read.parquet(at).groupBy("library_id").agg(F.count(F.lit(1)).alias("n"))


@query("run_id customer", sql="SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_custkey AS customer FROM orders WHERE o_orderkey = 77")
def get_research_run(spark, sf):
    return S.get_research_run(_runs(spark, sf), "77", "customer bigint").select("run_id", "request.customer")


@query("universe_id source_as_of", sql="SELECT universe_id, source_as_of FROM x_snap GROUP BY 1, 2 HAVING count(*) BETWEEN 20 AND 1000 AND source_as_of <= DATE '2001-05-03'")
def ingest_snapshots(spark, sf):
    at = S.shared_folder(spark, "stream")
    cols = ["universe_id", "source_as_of", "fetched_date", "is_proxy", "members", "member_count", "checksum"]
    q_screen.lists(spark, sf).select(cols).write.parquet(f"{at}/landing")
    ingest(spark, f"{at}/landing", f"{at}/archive", f"{at}/rejects", f"{at}/checkpoint", "2001-05-01", low=20, most_turnover=1.0)
    return spark.read.parquet(f"{at}/archive")


@query("lookback k param_hash", "threshold", sql="SELECT CAST(3 * i AS INTEGER) AS lookback, k, threshold, sha256(concat_ws('|', 3 * i, k, CAST(floor(threshold * 1000000 + 0.5) AS BIGINT))) AS param_hash FROM (SELECT unnest(generate_series(1, (SELECT year(max(dt)) - year(min(dt)) FROM x_bd))) AS i), (VALUES (2), (4)) ks(k), (VALUES (CAST(0 AS DOUBLE)), (CAST(0.1 AS DOUBLE))) ts(threshold)")
def param_grid(spark, sf):
    """Look-backs up to the panel's years, so the grid follows the data's span."""
    years = A.benchmark_daily(spark, sf).agg((F.year(F.max("dt")) - F.year(F.min("dt"))).alias("n")).first().n
    return K.param_grid(spark, [3 * i for i in range(1, years + 1)], [2, 4], [0.0, 0.1])
