"""Corporate-action audits, return components and bar repair."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from math import exp, isfinite, log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from panelwright.functions.scalars import safe_ratio
from panelwright.operators.windows import by_symbol

#: Split ratios and their reciprocals.
SPLIT_RATIOS = (2.0, 3.0, 4.0, 5.0, 10.0, 1.5, 0.5, 1 / 3, 0.25, 0.2, 0.1)

#: A one-day change of scale, and how far apart the logarithms of the days around it may be.
SCALE_RATIO = 3.0
BRIDGE_LIMIT = log(1.5)


def event_columns(bars: DataFrame) -> DataFrame:
    """Bars with the adjustment factor's change and the anomaly flags of each date.

    ``factor_jump``: adjusted over raw close moves by more than 5e-4 with no event on the date or next to it.
    ``distribution_gap``: the change differs from what the dividend implies by more than the larger of 2.5e-3 and a quarter.
    ``split_like``: the close's ratio is within 3% of a split ratio with no declared split. ``large_move``: beyond 75%.
    """
    w = by_symbol()
    factor = F.col("adj_close") / F.col("close")
    df = bars.withColumns({"_f": factor, "_e": (F.col("dividends") > 0) | (F.col("splits") > 0)})
    change = F.col("_f") / F.lag("_f").over(w) - 1
    near = F.col("_e") | F.coalesce(F.lag("_e").over(w), F.lit(False)) | F.coalesce(F.lead("_e").over(w), F.lit(False))
    ratio = F.col("close") / F.lag("close").over(w)
    implied = 1 / (1 - F.col("dividends") / F.lag("close").over(w)) - 1
    close_to = F.array_min(F.array(*[F.abs(ratio / r - 1) for r in SPLIT_RATIOS])) <= 0.03
    no = F.lit(False)
    return df.select(
        *bars.columns,
        F.coalesce((F.abs(change) > 5e-4) & ~near, no).alias("factor_jump"),
        F.coalesce((F.col("dividends") > 0) & (F.abs(change - implied) > F.greatest(F.lit(2.5e-3), F.abs(implied) * 0.25)), no).alias("distribution_gap"),
        F.coalesce(close_to & (F.col("splits") == 0), no).alias("split_like"),
        F.coalesce(F.abs(ratio - 1) > 0.75, no).alias("large_move"),
    )


def corporate_action_audit(bars: DataFrame, first: int = 20) -> DataFrame:
    """Counts of events and anomalies by symbol, the first warning dates, and a status: ``review``, ``events`` or ``clean``."""
    e = event_columns(bars)
    warn = F.col("factor_jump") | F.col("distribution_gap") | F.col("split_like") | F.col("large_move")
    g = e.groupBy("symbol").agg(
        F.count_if(F.col("dividends") > 0).alias("n_dividends"),
        F.count_if(F.col("splits") > 0).alias("n_splits"),
        *[F.count_if(F.col(c)).alias(f"n_{c}") for c in ("factor_jump", "distribution_gap", "split_like", "large_move")],
        F.count_if(warn).alias("n_warnings"),
        F.slice(F.array_sort(F.collect_list(F.when(warn, F.col("dt")))), 1, first).alias("warning_dates"),
    )
    return g.withColumn("status", F.when(F.col("n_warnings") > 0, "review").when(F.col("n_dividends") + F.col("n_splits") > 0, "events").otherwise("clean"))


def portfolio_action_status(portfolios: DataFrame, audit: DataFrame) -> DataFrame:
    """The worst member's status, and the members to review (sorted)."""
    g = portfolios.join(audit.select("symbol", "status"), "symbol", "left").groupBy("portfolio_id")
    some = lambda s: F.bool_or(F.coalesce(F.col("status") == s, F.lit(False)))
    return g.agg(F.when(some("review"), "review").when(some("events"), "events").otherwise("clean").alias("status"), F.array_sort(F.collect_set(F.when(F.col("status") == "review", F.col("symbol")))).alias("review"))


def native_components(bars: DataFrame) -> DataFrame:
    """``symbol, dt, total_ret, price_ret, dist_ret``: total from adjusted closes (else raw), distribution from dividends over the
    previous close, price the rest, so that the identity is exact; the first date is 0."""
    w = by_symbol()
    prior = F.lag("close").over(w)
    total = F.coalesce(F.col("adj_close") / F.lag("adj_close").over(w) - 1, F.col("close") / prior - 1)
    dist = F.coalesce(F.greatest(F.col("dividends"), F.lit(0.0)) / prior, F.lit(0.0))
    df = bars.select("symbol", "dt", F.coalesce(total, F.lit(0.0)).alias("total_ret"), F.when(total.isNull(), 0.0).otherwise(dist).alias("dist_ret"))
    return df.select("symbol", "dt", "total_ret", (F.col("total_ret") - F.col("dist_ret")).alias("price_ret"), "dist_ret")


def base_ccy_components(native: DataFrame, fx_returns: DataFrame) -> DataFrame:
    """Components in the base currency: total ``(1+n)(1+fx)-1``, cash ``dist (1+fx)``, price the rest, and both indexes."""
    j = native.join(fx_returns, ["symbol", "dt"], "left").withColumn("_fx", F.coalesce("fx_ret", F.lit(0.0)))
    total, dist = (1 + F.col("total_ret")) * (1 + F.col("_fx")) - 1, F.col("dist_ret") * (1 + F.col("_fx"))
    df = j.select("symbol", "dt", total.alias("total_ret"), (total - dist).alias("price_ret"), dist.alias("dist_ret"))
    run = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    index = lambda c: F.exp(F.sum(F.when(F.col(c) > -1, F.log1p(c)).otherwise(-745.0)).over(run))
    return df.withColumns({"total_index": index("total_ret"), "price_index": index("price_ret")})


def total_only_components(returns: DataFrame) -> DataFrame:
    return returns.select("symbol", "dt", F.col("ret").alias("total_ret"), F.col("ret").alias("price_ret"), F.lit(0.0).alias("dist_ret"))


def bar_repair(bars: DataFrame, tolerance: float = 1.005) -> DataFrame:
    """Closes outside their bars, and one-day changes of scale, replaced day by day; ``repaired future_assisted unresolved`` tell how.

    A bar is valid with a positive open, high and low, low up to high, and the open in ``[low / tolerance, high x tolerance]``; its
    close is trusted if it lies there too. In date order an untrusted close of a valid bar becomes the point on the straight line of
    logarithms between the nearest trusted closes, weighted by days, else the open, clamped to the bar, and is trusted from then on. Then a close off both its neighbours
    by ``SCALE_RATIO`` in opposite directions, where these are within ``BRIDGE_LIMIT``, becomes their bridge if that lies in the bar.
    Rows whose close is still null or not positive go; ``unresolved`` marks valid bars that do not hold their close.

    The next trusted close is a window; what was repaired before is the state of one pass over a symbol's sorted rows, which holds
    one row of them. ``(symbol, dt)`` is unique.
    """
    inside = lambda c: F.col(c).between(F.col("low") / tolerance, F.col("high") * tolerance)
    df = bars.repartition("symbol").withColumn("_valid", F.coalesce((F.least("open", "high", "low") > 0) & (F.col("low") <= F.col("high")) & inside("open"), F.lit(False)))
    df = df.withColumn("_ok", F.col("_valid") & F.coalesce(inside("close"), F.lit(False)))
    back = Window.partitionBy("symbol").orderBy(F.desc("dt")).rowsBetween(Window.unboundedPreceding, -1)  # a running state from the end
    df = df.withColumns({"_next": F.last(F.when(F.col("_ok"), F.struct(F.unix_date("dt").alias("day"), F.col("close").cast("double").alias("close"))), ignorenulls=True).over(back), "_day": F.unix_date("dt")})
    df = df.select(*bars.columns, "_day", "_valid", "_ok", F.col("_next.day").alias("_next_day"), F.col("_next.close").alias("_next_close"))
    read = ("symbol", "_day", "open", "high", "low", "close", "_valid", "_ok", "_next_day", "_next_close")
    kept = [c for c in bars.columns if c != "close"]

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, done = deque(), []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    yield from zip(*[batch.column(c).to_pylist() for c in read], strict=True)

        for row in repaired_rows(rows(), tolerance):
            done.append(row)
            if len(done) == waiting[0].num_rows:
                batch = waiting.popleft()
                new = [pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.float64(), pa.bool_(), pa.bool_(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], names=[*kept, "close", "repaired", "future_assisted", "unresolved"])
                done = []

    fields = [*[bars.schema[c] for c in kept], StructField("close", DoubleType()), *[StructField(c, BooleanType()) for c in ("repaired", "future_assisted", "unresolved")]]
    return df.sortWithinPartitions("symbol", "dt").mapInArrow(repair, StructType(fields)).where("close > 0 AND NOT isnan(close)")


@dataclass
class _Bar:
    symbol: str
    day: int
    high: float
    low: float
    close: float | None
    valid: bool
    repaired: bool = False
    ahead: bool = False


def _between(a_day: int, a: float, day: int, b_day: int, b: float) -> float:
    """The point of ``day`` on the straight line of logarithms."""
    share = (day - a_day) / (b_day - a_day)
    return exp((1 - share) * log(a) + share * log(b))


def repaired_rows(rows: Iterable[tuple], tolerance: float) -> Iterator[tuple[float | None, bool, bool, bool]]:
    """``close, repaired, future_assisted, unresolved`` of rows in order of symbol and date, each given out once the next is known."""
    trusted: _Bar | None = None
    before: _Bar | None = None
    current: _Bar | None = None
    for symbol, day, first, high, low, close, valid, ok, next_day, next_close in rows:
        bar = _Bar(symbol, day, high, low, close, valid)
        if trusted and trusted.symbol != symbol:
            trusted = None
        if valid and not ok:
            bar.ahead = trusted is not None and next_day is not None
            value = _between(trusted.day, trusted.close, day, next_day, next_close) if bar.ahead else first
            bar.close, bar.repaired = min(max(value, low), high), True
        if valid:
            trusted = replace(bar)  # as it is now: bridges come after all repairs
        if current:
            yield _finished(before, current, bar, tolerance)
        before, current = current, bar
    if current:
        yield _finished(before, current, None, tolerance)


def _finished(a: _Bar | None, bar: _Bar, b: _Bar | None, tolerance: float) -> tuple[float | None, bool, bool, bool]:
    """``bar`` bridged where its neighbours say so; a bridged close is what the next bar sees."""
    near = a and b and a.symbol == bar.symbol == b.symbol and bar.valid and not bar.repaired
    if near and all(x.close is not None and x.close > 0 and isfinite(x.close) for x in (a, bar, b)):
        up, down = log(bar.close / a.close), log(b.close / bar.close)
        if up * down < 0 and min(abs(up), abs(down)) >= log(SCALE_RATIO) and abs(log(b.close / a.close)) <= BRIDGE_LIMIT:
            value = _between(a.day, a.close, bar.day, b.day, b.close)
            if bar.low / tolerance <= value <= bar.high * tolerance:
                bar.close, bar.repaired, bar.ahead = min(max(value, bar.low), bar.high), True, True
    held = bar.close is not None and bar.valid and bar.low / tolerance <= bar.close <= bar.high * tolerance
    return bar.close, bar.repaired, bar.ahead, bar.valid and not held


def pulse_repair(levels: DataFrame, *, jump: float = 3.0, bridge: float = 1.5) -> DataFrame:
    """A one-row change of scale (``jump`` and back, neighbours within ``bridge``) becomes the geometric mean of its neighbours."""
    w = by_symbol()
    p, q, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
    far = lambda x, y: F.greatest(x / y, y / x)
    pulse = F.coalesce((far(v, p) >= jump) & (far(v, q) >= jump) & (far(p, q) <= bridge), F.lit(False))
    return levels.withColumn("pulse", pulse).withColumn("value", F.when(F.col("pulse"), F.sqrt(p * q)).otherwise(v))


def series_fingerprint(levels: DataFrame) -> DataFrame:
    """SHA-256 of a symbol's dates and values (ten-thousandths) in order; a definition of its own."""
    row = F.concat(F.date_format("dt", "yyyy-MM-dd"), F.lit("="), F.floor(F.col("value") * 10_000 + 0.5).cast("string"))
    return levels.groupBy("symbol").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dt", row.alias("r")))), lambda x: x["r"]), "|"), 256).alias("fingerprint"))


def income_yield(bars: DataFrame) -> DataFrame:
    """Dividends of each year over its mean close."""
    return bars.groupBy("symbol", F.year("dt").alias("year")).agg(safe_ratio(F.sum("dividends"), F.avg("close")).alias("yield"))
