"""Queries of cleaning and alignment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators import align as L, clean as C, windows as W
from panelwright.plans.registry import query
from panelwright.sources import adapters as A


def _d(x: str):
    return F.lit(x).cast("date")


_DIRTY = "SELECT symbol, dt, value, 0 AS arrival FROM x_monthly UNION ALL SELECT symbol, dt, CAST(0 AS DOUBLE), 1 FROM x_monthly WHERE month(dt) = 3 UNION ALL SELECT symbol, dt, NULL, 2 FROM x_monthly WHERE month(dt) = 4 UNION ALL SELECT symbol, dt, value * 2, 3 FROM x_monthly WHERE month(dt) = 5 UNION ALL SELECT symbol, dt, -1.0, 4 FROM x_monthly WHERE month(dt) = 6"


def _dirty(spark, sf):
    m = A.monthly_levels(spark, sf)
    row = lambda month, value, n: m.where(F.month("dt") == month).select("symbol", "dt", value.cast("double").alias("value"), F.lit(n).alias("arrival"))
    every = m.withColumn("arrival", F.lit(0))
    return every.union(row(3, F.lit(0), 1)).union(row(4, F.lit(None), 2)).union(row(5, F.col("value") * 2, 3)).union(row(6, F.lit(-1), 4))


@query("symbol dt", "value", sql=f"SELECT symbol, dt, value FROM ({_DIRTY}) WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY symbol, dt ORDER BY arrival DESC) = 1")
def clean_levels(spark, sf):
    return C.clean_levels(_dirty(spark, sf))


@query("symbol dt", "value", sql=f"SELECT symbol, dt, greatest(coalesce(value, 0), 0) AS value FROM ({_DIRTY})")
def clean_events(spark, sf):
    return C.clean_events(_dirty(spark, sf), ("value",), clip=True)


@query("symbol n_bad", sql="SELECT symbol, count(*) FILTER (value - 1500 <= 0) AS n_bad FROM x_monthly GROUP BY symbol HAVING count(*) FILTER (value - 1500 <= 0) > 0")
def strict_levels(spark, sf):
    return C.strict_levels(A.monthly_levels(spark, sf).withColumn("value", F.col("value") - 1500))[1]


@query("ticker n", sql="SELECT ticker, count(*) AS n FROM (SELECT upper(trim(' ' || p_name || ' ')) AS t, CASE WHEN regexp_matches(upper(trim(replace(p_brand, '#', '.'))), '^[A-Z0-9.^=_-]{1,20}$') THEN upper(trim(replace(p_brand, '#', '.'))) END AS ticker FROM part) GROUP BY ticker")
def normalize_ticker(spark, sf):
    t = S.normalize_ticker(F.concat(F.lit(" "), F.translate("p_brand", "#", "."), F.lit(" ")))
    return A.table(spark, sf, "part").select(t.alias("ticker")).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("ticker n", sql="SELECT CASE p_partkey % 5 WHEN 0 THEN 'BRK-A' WHEN 1 THEN 'BRK-B' WHEN 2 THEN 'BF-A' WHEN 3 THEN 'BF-B' ELSE translate(upper(p_brand), '#', '-') END AS ticker, count(*) AS n FROM part GROUP BY 1")
def normalize_universe_ticker(spark, sf):
    k = F.col("p_partkey") % 5
    spelt = F.when(k == 0, " brka").when(k == 1, "BRKB").when(k == 2, "bfa ").when(k == 3, "BFB").otherwise(F.translate("p_brand", "#", "."))
    return A.table(spark, sf, "part").select(S.universe_ticker(spelt).alias("ticker")).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("ticker n", sql="SELECT CASE WHEN length(CAST(o_orderkey AS VARCHAR)) BETWEEN 4 AND 6 THEN o_orderkey || '.TW' ELSE CAST(o_orderkey AS VARCHAR) END AS ticker, count(*) AS n FROM orders GROUP BY 1")
def normalize_local_symbol(spark, sf):
    return A.table(spark, sf, "orders").select(S.local_symbol(F.col("o_orderkey").cast("string")).alias("ticker")).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("label n", sql="SELECT upper(string_split(p_name, ' ')[1]) AS label, count(*) AS n FROM part GROUP BY 1")
def normalize_screen_label(spark, sf):
    return A.table(spark, sf, "part").select(S.screen_label(F.col("p_name")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("symbol pos", sql="SELECT p_brand AS symbol, min(p_partkey) AS pos FROM part GROUP BY 1")
def dedupe_keep_order(spark, sf):
    return C.dedupe_keep_order(A.table(spark, sf, "part").select(F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("pos")))


@query("text", "number", sql="SELECT DISTINCT CASE WHEN p_size % 5 = 0 THEN 'N/A' WHEN p_size % 5 = 1 THEN '$' || (p_size * 1000) WHEN p_size % 5 = 2 THEN p_size || '%' WHEN p_size % 5 = 3 THEN '-' ELSE 'abc' END AS text, CASE WHEN p_size % 5 = 1 THEN p_size * 1000.0 WHEN p_size % 5 = 2 THEN CAST(p_size AS DOUBLE) END AS number FROM part")
def parse_optional_number(spark, sf):
    n = F.col("p_size")
    text = F.when(n % 5 == 0, "N/A").when(n % 5 == 1, F.concat(F.lit("$"), (n * 1000).cast("string"))).when(n % 5 == 2, F.concat(n.cast("string"), F.lit("%"))).when(n % 5 == 3, "-").otherwise("abc")
    return A.table(spark, sf, "part").select(text.alias("text")).distinct().withColumn("number", S.optional_number(F.col("text")))


@query("sector n", sql="SELECT CASE p_partkey % 6 WHEN 0 THEN 'Communication Services' WHEN 1 THEN 'Healthcare' WHEN 2 THEN 'Consumer Cyclical' WHEN 3 THEN 'Consumer Defensive' WHEN 4 THEN 'Financial Services' ELSE p_type END AS sector, count(*) AS n FROM part GROUP BY 1")
def normalize_sector(spark, sf):
    k = F.col("p_partkey") % 6
    spelt = F.when(k == 0, "Telecommunications").when(k == 1, "Health  Care").when(k == 2, "Consumer Discretionary").when(k == 3, "Consumer Staples").when(k == 4, "Finance").otherwise(F.col("p_type"))
    return A.table(spark, sf, "part").select(S.normalize_sector(F.concat(F.lit("  "), spelt, F.lit(" "))).alias("sector")).groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


@query("parsed n", sql="SELECT CAST(o_orderdate AS DATE) AS parsed, count(*) AS n FROM orders GROUP BY 1")
def parse_source_date(spark, sf):
    d = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "MMMM d, yyyy"))
    return A.table(spark, sf, "orders").select(S.source_date(text).alias("parsed")).groupBy("parsed").agg(F.count(F.lit(1)).alias("n"))


@query("reason n", sql="SELECT CASE WHEN date_diff('day', d, DATE '1998-01-01') < -2 THEN 'future' WHEN date_diff('day', d, DATE '1998-01-01') > 14 THEN 'stale' END AS reason, count(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY 1")
def source_freshness(spark, sf):
    rows = A.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("source_as_of"))
    return C.source_freshness(rows, _d("1998-01-01")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("start_text end_text start_dt end_exclusive n", sql="SELECT strftime(d, '%Y-%m') AS start_text, CASE WHEN day(d) <= 15 THEN strftime(d, '%Y-%m') ELSE strftime(d, '%Y-%m-%d') END AS end_text, CAST(date_trunc('month', d) AS DATE) AS start_dt, CASE WHEN day(d) <= 15 THEN CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) ELSE CAST(d + 1 AS DATE) END AS end_exclusive, count(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY ALL")
def resolve_period(spark, sf):
    d = F.to_date("o_orderdate")
    rows = A.table(spark, sf, "orders").select(F.date_format(d, "yyyy-MM").alias("start_text"), F.when(F.dayofmonth(d) <= 15, F.date_format(d, "yyyy-MM")).otherwise(F.date_format(d, "yyyy-MM-dd")).alias("end_text"))
    return C.period_bounds(rows.groupBy("start_text", "end_text").agg(F.count(F.lit(1)).alias("n"))).withColumnRenamed("start", "start_dt")


@query("ok n", sql="SELECT CAST(o_orderdate AS DATE) + 1 <= DATE '1999-06-30' AS ok, count(*) AS n FROM orders GROUP BY 1")
def complete_period_guard(spark, sf):
    rows = A.table(spark, sf, "orders").select(F.date_add(F.to_date("o_orderdate"), 1).alias("end_exclusive"))
    return C.complete_period_guard(rows, _d("1999-06-30")).groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


@query("effective_end n", sql="SELECT CASE WHEN least(d + 200, DATE '1999-12-31') >= d THEN CAST(least(d + 200, DATE '1999-12-31') AS DATE) END AS effective_end, count(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY 1")
def effective_end(spark, sf):
    d = F.to_date("o_orderdate")
    rows = A.table(spark, sf, "orders").select(d.alias("start"), F.date_add(d, 200).alias("end"))
    return C.effective_end(rows, _d("2000-05-01"), year_to_date=False).groupBy("effective_end").agg(F.count(F.lit(1)).alias("n"))


@query("symbol end_dt selection_as_of", sql="SELECT symbol, max(dt) AS end_dt, DATE '2001-06-30' AS selection_as_of FROM x_daily GROUP BY symbol HAVING max(dt) > DATE '2001-06-30'")
def pit_window_guard(spark, sf):
    return C.pit_window_violations(A.daily_levels(spark, sf).groupBy("symbol").agg(F.max("dt").alias("end")).withColumn("selection_as_of", _d("2001-06-30"))).withColumnRenamed("end", "end_dt")


@query("symbol removed status", sql="SELECT d.symbol, count(*) FILTER (dt < first_trade_date) AS removed, CASE WHEN count(*) FILTER (dt < first_trade_date) > 0 THEN 'clipped' ELSE 'ok' END AS status FROM x_daily d JOIN x_inst i ON d.symbol = i.symbol GROUP BY d.symbol")
def lifecycle_clip(spark, sf):
    return C.lifecycle_clip(A.daily_levels(spark, sf), A.instruments(spark, sf))[1]


@query("symbol first_dt last_dt", sql="SELECT symbol, min(dt) AS first_dt, max(dt) AS last_dt FROM x_daily GROUP BY symbol HAVING min(dt) < DATE '1995-01-04' OR max(dt) > DATE '2001-11-02'")
def window_guard(spark, sf):
    return C.window_guard(A.daily_levels(spark, sf), _d("1995-01-04"), _d("2001-11-02"))


@query("symbol first_dt n_weekdays", sql="SELECT symbol, f AS first_dt, n AS n_weekdays FROM (SELECT symbol, min(dt) AS f FROM x_daily WHERE (dt >= DATE '1995-02-01' OR symbol > 'Brand#2') GROUP BY symbol), LATERAL (SELECT count(*) AS n FROM (SELECT unnest(generate_series(DATE '1995-01-02' + 1, f, INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) BETWEEN 1 AND 5) WHERE n > 5")
def late_start_check(spark, sf):
    late = A.daily_levels(spark, sf).where("dt >= DATE'1995-02-01' OR symbol > 'Brand#2'")
    return C.late_starts(late, _d("1995-01-02"))


@query("symbol dt", "value", sql="SELECT symbol, dt, value FROM x_weekly WHERE dt IN (SELECT dt FROM x_weekly GROUP BY dt HAVING count(*) = (SELECT count(DISTINCT symbol) FROM x_weekly))")
def complete_case(spark, sf):
    return C.complete_case(A.weekly_levels(spark, sf))


@query("portfolio_id reason", sql="SELECT portfolio_id, reason FROM (VALUES ('weight_range'), ('weight_sum')) AS t(reason), (SELECT portfolio_id, sum(w) AS s, count(*) FILTER (w <= 0 OR w > 1) AS bad FROM (SELECT portfolio_id, CASE WHEN portfolio_id IN ('P1', 'Q2') THEN weight - 0.19 ELSE weight END AS w FROM x_port) GROUP BY portfolio_id) WHERE (reason = 'weight_range' AND bad > 0) OR (reason = 'weight_sum' AND abs(s - 1) > 1e-4)")
def validate_weights(spark, sf):
    p = A.portfolios(spark, sf)
    return C.weight_violations(p.withColumn("weight", F.when(F.col("portfolio_id").isin("P1", "Q2"), F.col("weight") - 0.19).otherwise(F.col("weight"))))


@query("dt", sql="SELECT DISTINCT dt FROM x_daily")
def calendar_union(spark, sf):
    return L.calendar_union(A.daily_levels(spark, sf))


@query("dt", sql="SELECT dt FROM x_weekly GROUP BY dt HAVING count(*) = (SELECT count(DISTINCT symbol) FROM x_weekly)")
def calendar_intersection(spark, sf):
    return L.calendar_intersection(A.weekly_levels(spark, sf))


@query("symbol dt", "value bvalue", sql="SELECT d.symbol, d.dt, d.value, b.value AS bvalue FROM x_daily d JOIN x_bd b ON d.dt = b.dt")
def align_benchmark(spark, sf):
    return L.align_benchmark(A.daily_levels(spark, sf), A.benchmark_daily(spark, sf))


_GRID = "SELECT s.symbol, c.dt, last_value(d.value IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY c.dt) AS value FROM (SELECT DISTINCT symbol FROM x_daily) s CROSS JOIN (SELECT DISTINCT dt FROM x_daily) c LEFT JOIN x_daily d ON d.symbol = s.symbol AND d.dt = c.dt"


@query("symbol dt", "value", sql=f"SELECT * FROM ({_GRID}) WHERE dt >= (SELECT max(f) FROM (SELECT min(dt) AS f FROM x_daily GROUP BY symbol))")
def union_calendar_ffill(spark, sf):
    return L.union_calendar_ffill(A.daily_levels(spark, sf))


_VAL = """
SELECT *, coalesce(value / lag(value) OVER (PARTITION BY symbol ORDER BY dt) - 1, 0) AS ret FROM (
  SELECT symbol, dt, native, fx, native * fx AS value, is_native_obs FROM (
    SELECT symbol, dt, last_value(native IGNORE NULLS) OVER w AS native, last_value(fx IGNORE NULLS) OVER w AS fx, native IS NOT NULL AS is_native_obs FROM (
      SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.dt, b.dt) AS dt, native, fx
      FROM (SELECT d.symbol, d.dt, d.value * scale AS native FROM x_daily d JOIN x_conv c ON d.symbol = c.symbol WHERE NOT is_base) a
      FULL JOIN (SELECT symbol, dt, level AS fx FROM x_fx f JOIN x_conv c ON f.currency = c.currency WHERE NOT is_base) b ON a.symbol = b.symbol AND a.dt = b.dt
      UNION ALL SELECT d.symbol, d.dt, d.value * scale, 1.0 FROM x_daily d JOIN x_conv c ON d.symbol = c.symbol WHERE is_base)
    WINDOW w AS (PARTITION BY symbol ORDER BY dt)) WHERE native IS NOT NULL AND fx IS NOT NULL)
"""


def valuation(spark, sf):
    return L.value_in_base_ccy(A.daily_levels(spark, sf), A.quote_conventions(spark, sf), A.fx_levels(spark, sf))


@query("symbol dt is_native_obs", "native fx value ret", sql=_VAL)
def value_in_base_ccy(spark, sf):
    return valuation(spark, sf)


@query("symbol currency", "scale", sql="SELECT symbol, currency, scale FROM x_conv")
def scale_minor_units(spark, sf):
    return A.quote_conventions(spark, sf)


@query("currency dt", "level", sql="SELECT * FROM (SELECT currency, dt, last_value(a IGNORE NULLS) OVER w * last_value(b IGNORE NULLS) OVER w AS level FROM (SELECT f.currency, c.dt, CASE WHEN day(c.dt) % 2 = 0 THEN f2.level END AS a, CASE WHEN day(c.dt) % 3 = 0 THEN 1 / f2.level END AS b FROM (SELECT DISTINCT currency FROM x_fx) f CROSS JOIN (SELECT DISTINCT dt FROM x_fx) c JOIN x_fx f2 ON f2.currency = f.currency AND f2.dt = c.dt WHERE day(c.dt) % 2 = 0 OR day(c.dt) % 3 = 0) WINDOW w AS (PARTITION BY currency ORDER BY dt)) WHERE level IS NOT NULL")
def fx_triangulate(spark, sf):
    fx = A.fx_levels(spark, sf)
    return L.fx_triangulate(fx.where(F.dayofmonth("dt") % 2 == 0), fx.where(F.dayofmonth("dt") % 3 == 0).withColumn("level", 1 / F.col("level")))


@query("symbol dt", "open high low close", sql="SELECT symbol, dt, 1 / open AS open, 1 / low AS high, 1 / high AS low, 1 / close AS close FROM x_bars")
def fx_invert(spark, sf):
    return L.fx_invert(A.bars(spark, sf).select("symbol", "dt", "open", "high", "low", "close"))


@query("currency method", sql="SELECT currency, arg_min(method, (n, p)) AS method FROM (SELECT currency, CASE WHEN k = 0 THEN 'direct' ELSE 'cross' END AS method, count(*) FILTER (day(dt) % 5 = k) AS n, k AS p FROM x_fx, (VALUES (0), (1)) AS t(k) GROUP BY currency, k) GROUP BY currency")
def fx_pick_best(spark, sf):
    fx = A.fx_levels(spark, sf)
    quality = lambda k, m: fx.groupBy("currency").agg(F.count_if(F.dayofmonth("dt") % 5 == k).alias("unresolved")).select("currency", F.lit(m).alias("method"), "unresolved", F.lit(0).alias("jumps"), F.lit(0).alias("corrections"), F.lit(k == 1).alias("triangulated"), F.lit(k).alias("priority"))
    return L.fx_pick_best(quality(0, "direct").union(quality(1, "cross")))


@query("symbol dt", "value", sql="SELECT symbol, dt, value FROM x_daily WHERE dt BETWEEN DATE '1997-03-01' AND DATE '1997-12-31' UNION ALL SELECT symbol, max(dt), arg_max(value, dt) FROM x_daily WHERE dt < DATE '1997-03-01' GROUP BY symbol")
def clip_with_prior(spark, sf):
    return L.clip_with_prior(A.daily_levels(spark, sf), _d("1997-03-01"), _d("1997-12-31"))


@query("symbol dt", "value", sql="SELECT m.symbol, c.dt, (SELECT arg_max(value, dt) FROM x_monthly x WHERE x.symbol = m.symbol AND x.dt <= c.dt) AS value FROM (SELECT DISTINCT symbol FROM x_monthly) m CROSS JOIN (SELECT DISTINCT dt FROM x_weekly) c")
def macro_asof_ffill(spark, sf):
    return L.asof_ffill(A.monthly_levels(spark, sf), A.weekly_levels(spark, sf).select("dt").distinct(), "symbol")


@query("portfolio_id start_dt end_dt", sql="SELECT portfolio_id, max(a) AS start_dt, min(b) AS end_dt FROM x_port p JOIN (SELECT symbol, min(dt) AS a, max(dt) AS b FROM x_daily GROUP BY symbol) s ON p.symbol = s.symbol GROUP BY portfolio_id")
def common_window(spark, sf):
    return L.common_window(A.daily_levels(spark, sf), A.portfolios(spark, sf)).withColumnsRenamed({"start": "start_dt", "end": "end_dt"})


@query("portfolio_id dt", sql="SELECT portfolio_id, dt FROM x_port p JOIN x_daily d ON p.symbol = d.symbol GROUP BY portfolio_id, dt HAVING count(*) = (SELECT count(*) FROM x_port q WHERE q.portfolio_id = p.portfolio_id)")
def execution_eligible_dates(spark, sf):
    return L.execution_eligible_dates(A.portfolios(spark, sf), A.daily_levels(spark, sf).withColumn("is_native_obs", F.lit(True)))


@query("portfolio_id dt stale", sql="SELECT t.portfolio_id, t.dt, array_to_string(list_sort(list(p.symbol)), '|') AS stale FROM (SELECT DISTINCT portfolio_id, dt FROM x_port CROSS JOIN x_bd WHERE day(dt) = 20) t JOIN x_port p ON p.portfolio_id = t.portfolio_id WHERE NOT EXISTS (SELECT 1 FROM x_daily d WHERE d.symbol = p.symbol AND d.dt = t.dt) GROUP BY 1, 2")
def execution_clock_audit(spark, sf):
    p = A.portfolios(spark, sf)
    trades = p.select("portfolio_id").distinct().crossJoin(A.benchmark_daily(spark, sf).where(F.dayofmonth("dt") == 20).select("dt"))
    df = L.execution_clock_audit(trades, p, A.daily_levels(spark, sf).withColumn("is_native_obs", F.lit(True)))
    return df.withColumn("stale", F.array_join("stale", "|"))


@query("portfolio_id missing", sql="SELECT portfolio_id, array_to_string(list_sort(list(symbol)), '|') AS missing FROM x_port WHERE symbol NOT IN (SELECT symbol FROM x_daily WHERE symbol < 'Brand#2') GROUP BY 1")
def missing_symbol_failures(spark, sf):
    df = L.missing_symbol_failures(A.portfolios(spark, sf), A.daily_levels(spark, sf).where("symbol < 'Brand#2'"))
    return df.withColumn("missing", F.array_join("missing", "|"))


@query("symbol problem", sql="SELECT symbol, CASE WHEN n % 6 = 0 THEN 'both' ELSE 'neither' END AS problem FROM (SELECT DISTINCT p_brand AS symbol, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS n FROM part) WHERE n % 6 = 0 OR n % 6 = 1 OR n % 6 = 5")
def outcome_accounting(spark, sf):
    s = A.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()
    n = A.brand_number(F.col("symbol"))
    return L.outcome_accounting(s, s.where(n % 2 == 0), s.where(n % 3 == 0))


@query("symbol pos status", sql="SELECT symbol, pos, CASE WHEN n % 2 = 0 THEN 'resolved' ELSE 'unaccounted' END AS status FROM (SELECT p_brand AS symbol, min(p_partkey) AS pos, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS n FROM part GROUP BY 1) WHERE pos < 40")
def subset_batch(spark, sf):
    s = C.dedupe_keep_order(A.table(spark, sf, "part").select(F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("pos")))
    known = s.where(A.brand_number(F.col("symbol")) % 2 == 0).select("symbol", F.lit("resolved").alias("status"))
    return L.subset_batch(known, s.where("pos < 40"))


@query("symbol field", sql="SELECT a.symbol, 'first' AS field FROM (SELECT symbol, min(dt) AS f FROM x_daily GROUP BY 1) a JOIN (SELECT symbol, min(dt) AS f FROM x_weekly GROUP BY 1) b ON a.symbol = b.symbol WHERE a.f IS DISTINCT FROM b.f")
def panel_parity(spark, sf):
    first = lambda df: df.groupBy("symbol").agg(F.min("dt").alias("first"))
    return L.panel_parity(first(A.daily_levels(spark, sf)), first(A.weekly_levels(spark, sf)), ("first",)).withColumnRenamed("column", "field")


_COV = "SELECT symbol, min(pos) AS first_pos, max(pos) AS last_pos, max(pos) - min(pos) + 1 AS n_expected, max(pos) - min(pos) + 1 - count(*) AS n_missing, count(*) * 1.0 / (max(pos) - min(pos) + 1) AS coverage FROM x_daily d JOIN (SELECT dt, row_number() OVER (ORDER BY dt) AS pos FROM x_bd) c ON d.dt = c.dt GROUP BY symbol"


@query("symbol first_pos last_pos n_expected n_missing", "coverage", sql=_COV)
def coverage_diagnostics(spark, sf):
    return L.coverage_diagnostics(A.daily_levels(spark, sf), A.benchmark_daily(spark, sf))


@query("symbol reason", sql=f"SELECT symbol, 'coverage' AS reason FROM ({_COV}) WHERE coverage < 0.98 UNION ALL SELECT symbol, 'late_start' FROM ({_COV}) WHERE first_pos > 6 UNION ALL SELECT symbol, 'early_end' FROM ({_COV}) WHERE last_pos < 2490")
def strict_coverage_gate(spark, sf):
    return L.strict_coverage_gate(L.coverage_diagnostics(A.daily_levels(spark, sf), A.benchmark_daily(spark, sf)), 2495)


@query("symbol dt", "ret", sql="SELECT symbol, dt, value / lag(value) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS ret FROM x_weekly")
def weekly_panel(spark, sf):
    return W.daily_returns(A.weekly_levels(spark, sf))
