"""Landed files as tables: explicit schemas, built-in parsers, one plan for any number of files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from panelwright.functions.scalars import optional_number, source_date

BARS = "symbol string, dt date, open double, high double, low double, close double, adj_close double, dividends double, splits double, capital_gains double, repaired boolean"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only in local mode, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='panelwright-files-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what uses it more than once scans its sources once."""
    at = shared_folder(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def read_bars(spark: SparkSession, path: str, symbols: list[str], start: str, end_exclusive: str, *, form: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Bars of the requested symbols and dates, and ``symbol, status`` of every request; the filter reaches the scan."""
    df = spark.read.schema(BARS).format(form).options(**({"header": "true"} if form == "csv" else {})).load(path)
    df = df.where(F.col("symbol").isin(symbols) & (F.col("dt") >= F.lit(start).cast("date")) & (F.col("dt") < F.lit(end_exclusive).cast("date")))
    asked = spark.createDataFrame([(s,) for s in dict.fromkeys(symbols)], "symbol string")
    return df, request_outcomes(asked, df)


def request_outcomes(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """``symbol, status`` of each request: resolved if it has a row, else failed."""
    found = rows.select("symbol").distinct().withColumn("status", F.lit("resolved"))
    return asked.join(found, "symbol", "left").select("symbol", F.coalesce("status", F.lit("failed")).alias("status"))


def read_fx_bars(bars: DataFrame, start: str, end: str, *, lookback: int = 10, lookahead: int = 1) -> DataFrame:
    return bars.where(F.col("dt").between(F.date_sub(F.lit(start).cast("date"), lookback), F.date_add(F.lit(end).cast("date"), lookahead)))


def unpivot_bars(wide: DataFrame, fields: tuple[str, ...], separator: str = "|") -> DataFrame:
    """Columns named ``field|symbol`` to one row per symbol and date; a field a symbol lacks is null, a symbol with none gives no row."""
    columns = [c for c in wide.columns if separator in c]
    long = wide.unpivot(["dt"], columns, "_c", "_v").where("_v is not null")
    long = long.select("dt", F.split("_c", f"\\{separator}")[0].alias("field"), F.split("_c", f"\\{separator}")[1].alias("symbol"), "_v")
    return long.groupBy("symbol", "dt").pivot("field", list(fields)).agg(F.first("_v"))


def read_holdings_csv(spark: SparkSession, path: str) -> DataFrame:
    """``file, as_of, ticker, name, sector, asset_class, weight`` of equity rows: a preamble, a header row, then data.

    The as-of date is the first one in a file's first 1000 characters; the header is the first line that begins with ``Ticker``.
    """
    lines = spark.read.format("text").option("wholetext", "true").load(path).select(F.input_file_name().alias("file"), "value")
    as_of = source_date(F.regexp_extract(F.substring("value", 1, 1000), r"((?:\d{4}-\d{2}-\d{2})|(?:\d{1,2}/\d{1,2}/\d{4})|(?:[A-Z][a-z]+ \d{1,2}, \d{4}))", 1))
    body = F.regexp_extract("value", r"(?s)(?:^|\n)\"?Ticker\"?,[^\n]*\n(.*)", 1)
    rows = lines.select("file", as_of.alias("as_of"), F.explode(F.split(body, r"\r?\n")).alias("row")).where("trim(row) <> ''")
    parsed = rows.select("file", "as_of", F.from_csv("row", "ticker string, name string, sector string, asset_class string, weight string").alias("r")).select("file", "as_of", "r.*")
    return parsed.where("asset_class = 'Equity'").withColumn("weight", optional_number(F.col("weight")))


def read_holdings_json(spark: SparkSession, path: str) -> DataFrame:
    """``file, ticker, name, weight`` of three shapes: a list under ``constituents``, a counted ``aaData`` table, or ``holdings`` by type."""
    item = "struct<ticker:string,name:string,weight:double,type:string>"
    raw = spark.read.format("text").option("wholetext", "true").load(path)
    j = F.from_json("value", f"constituents array<{item}>, aaData array<array<string>>, count bigint, holdings array<{item}>")
    df = raw.select(F.input_file_name().alias("file"), j.alias("j"))
    table = F.when(F.size("j.aaData") == F.col("j.count"), F.transform("j.aaData", lambda a: F.struct(F.get(a, F.lit(0)).alias("ticker"), F.get(a, F.lit(1)).alias("name"), F.get(a, F.lit(2)).try_cast("double").alias("weight"), F.lit(None).cast("string").alias("type"))))
    held = F.filter("j.holdings", lambda h: h["type"].isin("ADR", "COM", "DRNY"))
    return df.select("file", F.explode(F.coalesce("j.constituents", table, held)).alias("r")).select("file", "r.ticker", "r.name", "r.weight")


def read_fundamentals(spark: SparkSession, path: str, *, least: int = 1000) -> DataFrame:
    """Typed records of ``{"data": [...]}``; the plan fails where a load has fewer than ``least`` rows."""
    fields = "ticker string, name string, sector string, industry string, market_cap string, trailing_pe string"
    raw = spark.read.format("text").option("wholetext", "true").load(path)
    rows = raw.select(F.explode(F.from_json("value", f"data array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")["data"]).alias("r")).select("r.*")
    n = rows.agg(F.count(F.lit(1)).alias("n")).select(F.assert_true(F.col("n") >= least, F.lit("too few fundamentals")).alias("_ok"))
    return rows.select("ticker", "name", "sector", "industry", optional_number(F.col("market_cap")).alias("market_cap"), optional_number(F.col("trailing_pe")).alias("trailing_pe")).join(F.broadcast(n)).where("_ok is null").drop("_ok")


def parse_factor_text(lines: DataFrame) -> DataFrame:
    """``month_end`` and a column per name of the first contiguous block of ``yyyymm,`` rows after a header that begins with a comma.

    ``lines``: ``n`` (position) and ``value`` of one file's lines. Values are per cent.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("n")  # one small text file
    df = lines.withColumn("_r", F.col("value").rlike(r"^\d{6},"))
    df = df.withColumn("_island", F.sum(F.when(F.col("_r") & ~F.coalesce(F.lag("_r").over(w), F.lit(False)), 1).otherwise(0)).over(w))
    df = df.where("_r AND _island = 1")
    parts = F.split("value", r"\s*,\s*")
    values = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.try_cast("double") / 100)
    return df.select(F.last_day(F.to_date(F.concat(parts[0], F.lit("01")), "yyyyMMdd")).alias("month_end"), values.alias("values"))


def parse_macro(rows: DataFrame) -> DataFrame:
    """``series_id, dt, value`` of JSON ``{"observations": [{"date", "value"}]}``; ``.`` is null, the last duplicate wins."""
    j = F.from_json("json", "observations array<struct<date:string,value:string>>")
    df = rows.select("series_id", F.posexplode(j["observations"]).alias("n", "o"))
    return df.groupBy("series_id", F.to_date("o.date").alias("dt")).agg(F.max_by("o.value", "n").alias("v")).select("series_id", "dt", F.col("v").try_cast("double").alias("value"))


def write_snapshot_archive(staged: DataFrame, path: str, archive: DataFrame | None = None) -> DataFrame:
    """Appends staged snapshots whose stored members are as many as declared and that the archive lacks; returns what was written."""
    key = ["universe_id", "source_as_of", "version"]
    good = staged.where(F.size("members") == F.col("member_count"))
    if archive is not None:
        good = good.join(archive.select(*key), key, "left_anti")
    good.write.partitionBy("universe_id").mode("append").parquet(path)
    return good


def export_scan_csv(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Arrays joined by `` | ``, structs and maps as JSON, everything quoted."""
    out = []
    for name, kind in rows.dtypes:
        c = F.col(name)
        if kind.startswith("array"):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), " | ")
        elif kind.startswith(("struct", "map")):
            c = F.to_json(c)
        out.append(c.alias(name))
    df = rows.select(*out)
    if path:
        df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)
    return df


def append_research_run(runs: DataFrame, path: str) -> None:
    """Appends runs with at least one decision; the plan fails on others."""
    ok = F.assert_true(F.col("decision_count") >= 1, F.lit("a run needs a decision"))
    runs.withColumn("_ok", ok).where("_ok is null").drop("_ok").write.mode("append").parquet(path)


def list_research_runs(runs: DataFrame, library: Column, limit: int = 50) -> DataFrame:
    """Newest first, 1 to 100 of them."""
    return runs.where(F.col("library_id") == library).orderBy(F.desc("created_at"), F.desc("run_id")).limit(max(1, min(100, limit)))


def get_research_run(runs: DataFrame, run_id: str, request_schema: str) -> DataFrame:
    """One run with its request parsed; corrupt JSON fails the plan."""
    return runs.where(F.col("run_id") == run_id).withColumn("request", F.from_json("request_json", request_schema, {"mode": "FAILFAST"}))


def prepared_panel_manifest(panel: DataFrame) -> DataFrame:
    """``symbol, start_dt, end_dt, n_symbols, n_rows, fingerprint`` of each symbol, and with a null symbol of the whole panel.

    A fingerprint is a sum of the rows' hashes (48 bits of an MD5 of symbol, date and the value to six places), so that it does not depend
    on the order of rows or on how they are partitioned, symbols' sums add up to the panel's, and any changed value changes it.
    """
    value = F.coalesce(F.floor(F.col("value") * 1_000_000 + 0.5).cast("string"), F.lit("null"))
    row = F.md5(F.concat_ws("|", "symbol", F.col("dt").cast("string"), value).cast("binary"))
    df = panel.select("symbol", "dt", F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)").alias("_h"))
    return df.rollup("symbol").agg(F.min("dt").alias("start_dt"), F.max("dt").alias("end_dt"), F.countDistinct("symbol").alias("n_symbols"), F.count(F.lit(1)).alias("n_rows"), F.sum("_h").cast("string").alias("fingerprint"))
