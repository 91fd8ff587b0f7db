"""Registered queries and the SQL that gives the same rows.

A query names its key columns and its doubles; doubles are rounded to six places on both sides (a hair above, so that
ties go one way), since sums of doubles depend on
their order in the last digits.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Named common table expressions over the test tables, in an order in which each uses earlier ones only.
CTES: dict[str, str] = {}
_RATIO = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)"
CTES["x_sales"] = "SELECT p_brand AS symbol, p_type AS kind, CAST(l_shipdate AS DATE) AS dt, l_extendedprice / l_quantity AS unit, l_orderkey * 100 + l_linenumber AS seq, l_extendedprice, l_quantity, l_returnflag, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey"
CTES["x_bars"] = f"SELECT *, close AS adj_close, CASE WHEN day(dt) = 15 THEN 0.01 * close ELSE 0 END AS dividends, CASE WHEN day(dt) = 28 AND month(dt) = 6 THEN 2.0 ELSE 0 END AS splits FROM (SELECT symbol, dt, arg_min(unit, seq) AS open, max(unit) AS high, min(unit) AS low, {_RATIO} AS close FROM x_sales GROUP BY symbol, dt)"
CTES["x_daily"] = f"SELECT symbol, dt, {_RATIO} AS value FROM x_sales GROUP BY symbol, dt"
CTES["x_monthly"] = f"SELECT symbol, last_day(dt) AS dt, {_RATIO} AS value FROM x_sales GROUP BY 1, 2"
CTES["x_weekly"] = f"SELECT symbol, CAST(dt + CAST((5 - dayofweek(dt) + 7) % 7 AS INTEGER) AS DATE) AS dt, {_RATIO} AS value FROM x_sales GROUP BY 1, 2"
CTES["x_kind"] = f"SELECT kind AS symbol, last_day(dt) AS dt, {_RATIO} AS value FROM x_sales GROUP BY 1, 2"
CTES["x_bd"] = f"SELECT CAST(l_shipdate AS DATE) AS dt, {_RATIO} AS value FROM lineitem GROUP BY 1"
CTES["x_bm"] = f"SELECT last_day(CAST(l_shipdate AS DATE)) AS dt, {_RATIO} AS value FROM lineitem GROUP BY 1"
CTES["x_ret"] = "SELECT symbol, dt, value, value / lag(value) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS ret FROM x_monthly"
CTES["x_bret"] = "SELECT dt, value AS bvalue, lag(dt) OVER (ORDER BY dt) AS prev_dt, value / lag(value) OVER (ORDER BY dt) - 1 AS bret FROM x_bm"
CTES["x_pair"] = "SELECT symbol, dt, ret, bret FROM (SELECT r.symbol, r.dt, r.ret, b.bret, b.prev_dt, lag(r.dt) OVER (PARTITION BY r.symbol ORDER BY r.dt) AS own_prev FROM x_ret r JOIN x_bret b ON r.dt = b.dt) WHERE own_prev = prev_dt AND ret IS NOT NULL AND bret IS NOT NULL"
CTES["x_conv"] = "SELECT DISTINCT p_brand AS symbol, r_name AS currency, r_regionkey = 0 AS is_base, CASE WHEN r_regionkey = 1 THEN 0.01 ELSE 1.0 END AS scale FROM part JOIN region ON CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 5 = r_regionkey"
CTES["x_fx"] = "SELECT r_name AS currency, CAST(o_orderdate AS DATE) AS dt, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 100000 AS level FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 0 GROUP BY 1, 2"
CTES["x_size"] = "SELECT p_brand AS symbol, CAST(CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 5 AS VARCHAR) AS g, sum(p_size) AS size FROM part GROUP BY 1, 2"
CTES["x_port"] = "SELECT 'P' || g AS portfolio_id, symbol, 1.0 / count(*) OVER (PARTITION BY g) AS weight FROM x_size UNION ALL SELECT 'Q' || g, symbol, CAST(size AS DOUBLE) / sum(size) OVER (PARTITION BY g) FROM x_size"
CTES["x_inst"] = "SELECT symbol, CASE WHEN CAST(regexp_extract(symbol, '(\\d+)$', 1) AS INTEGER) % 2 = 0 THEN CAST(min(dt) + 30 AS DATE) ELSE min(dt) END AS first_trade_date FROM x_daily GROUP BY symbol"
CTES["x_fund"] = "SELECT 'P' || p_partkey AS ticker, p_name AS name, p_type AS sector, p_brand AS industry, p_retailprice AS market_cap, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS trailing_pe, p_size / 100.0 AS dividend_yield FROM part"
CTES["x_snap"] = "SELECT DISTINCT o_orderpriority AS universe_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS source_as_of, n_name AS member, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(month(o_orderdate) % 4 AS INTEGER) AS DATE) AS fetched_date, o_orderpriority = '5-LOW' AS is_proxy FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
CTES["x_periods"] = "SELECT strftime(e, '%Y-%m') AS period_id, CAST(last_day(CAST(e - INTERVAL 12 MONTH AS DATE)) + 1 AS DATE) AS train_start, e AS train_end, e AS decision_date, CAST(e + 1 AS DATE) AS eval_start, last_day(CAST(e + 1 AS DATE)) AS eval_end FROM (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b) - INTERVAL 2 MONTH, INTERVAL 1 MONTH)) AS DATE)) AS e, a FROM (SELECT CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem)) WHERE last_day(CAST(e - INTERVAL 12 MONTH AS DATE)) + 1 >= a"


def with_ctes(names: str, body: str) -> str:
    """``body`` behind the named expressions and those they need."""
    wanted = {x for x in CTES if x in names.split() or re.search(rf"\b{x}\b", body)}
    for name in reversed(CTES):
        if name in wanted:
            wanted |= {x for x in CTES if re.search(rf"\b{x}\b", CTES[name])}
    used = [f"{x} AS ({CTES[x]})" for x in CTES if x in wanted]
    return f"WITH {', '.join(used)} {body}" if used else body


def query(keys: str = "", doubles: str = "", ctes: str = "", sql: str | None = None) -> Callable:
    """Registers a function ``(spark, sf_dir) -> DataFrame`` under its name, with the columns ``keys`` and ``doubles``."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        k, d = keys.split(), doubles.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).select(*k, *[F.round(F.col(c) + 1e-10, 6).alias(c) for c in d])

        run.__name__, run.__doc__, run.__wrapped_mod__ = f.__name__, f.__doc__, f.__module__.rpartition(".")[2]
        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = with_ctes(ctes, f"SELECT {', '.join([*k, *[f'round({c} + 1e-10, 6) + 0.0 AS {c}' for c in d]])} FROM ({sql}) AS result")
        return f

    return register
