"""Screening, scoring and ranking of universes; missing values fail a bound and sort last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def range_condition(ranges: dict[str, tuple[float | None, float | None]]) -> Column:
    """All fields within their bounds; a null fails a bounded field."""
    out = F.lit(True)
    for c, (low, high) in ranges.items():
        if low is not None:
            out &= F.coalesce(F.col(c) >= low, F.lit(False))
        if high is not None:
            out &= F.coalesce(F.col(c) <= high, F.lit(False))
    return out


def screen_range_filter(rows: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    return rows.where(range_condition(ranges))


def missing_fields(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``field, n_missing``."""
    g = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in fields])
    return g.unpivot([], list(fields), "field", "n_missing")


def screen_universe(members: DataFrame, fundamentals: DataFrame, ranges: dict[str, tuple[float | None, float | None]], sectors: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Candidates, and the funnel ``members, matched, in_sector, passed``."""
    j = members.join(fundamentals.withColumn("_known", F.lit(True)), "ticker", "left")
    known = F.coalesce("_known", F.lit(False))
    sector = known & (F.col("sector").isin(*sectors) if sectors else F.lit(True))
    passed = F.coalesce(sector, F.lit(False)) & range_condition(ranges)
    funnel = j.agg(F.count(F.lit(1)).alias("members"), F.count_if(known).alias("matched"), F.count_if(sector).alias("in_sector"), F.count_if(passed).alias("passed"))
    return j.where(passed).drop("_known"), funnel


def screen_sort(rows: DataFrame, by: str, *, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Sorted by a field with nulls last and the ticker to break ties; ``truncated`` tells whether a limit cut rows off."""
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    if limit is None:
        return rows.orderBy(order, "ticker").withColumn("truncated", F.lit(False))
    n = rows.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return rows.orderBy(order, "ticker").limit(limit).join(F.broadcast(n))


def merge_fundamentals(first: DataFrame, second: DataFrame) -> DataFrame:
    """Non-null fields of the second source override the first."""
    fields = [c for c in first.columns if c != "ticker"]
    b = second.select("ticker", *[F.col(c).alias(f"_{c}") for c in fields])
    return first.join(b, "ticker", "full").select("ticker", *[F.coalesce(f"_{c}", c).alias(c) for c in fields])


def coverage_filter(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows with enough coverage, and the number hidden."""
    ok = F.coalesce(F.col("coverage") + 1e-12 >= threshold, F.lit(False))
    return rows.where(ok), rows.agg(F.count_if(~ok).alias("hidden"))


def scan_scores(rows: DataFrame) -> DataFrame:
    """``score_a, score_b, score_c, status`` from ``sortino, cagr, beta, max_drawdown``.

    ``a`` = Sortino x CAGR, ``b`` = ``a`` over the absolute drawdown, ``c`` = ``b`` over beta. Status: ``missing_metrics``,
    ``invalid_cagr_domain`` (CAGR at or below -1), ``invalid_beta_domain`` (beta not positive), or ``ok``.
    """
    missing = F.col("sortino").isNull() | F.col("cagr").isNull() | F.col("beta").isNull() | F.col("max_drawdown").isNull()
    status = F.when(missing, "missing_metrics").when(F.col("cagr") <= -1, "invalid_cagr_domain").when(F.col("beta") <= 0, "invalid_beta_domain").otherwise("ok")
    df = rows.withColumn("status", status)
    ok = F.col("status") == "ok"
    a = F.when(ok, F.col("sortino") * F.col("cagr"))
    b = F.when(ok & (F.col("max_drawdown") < 0), a / F.abs("max_drawdown"))
    return df.withColumns({"score_a": a, "score_b": b, "score_c": F.when(F.col("beta") > 0, b / F.col("beta"))})


def score_rank(rows: DataFrame, score: str, first: str) -> DataFrame:
    """``rank`` by score (equal to 12 places share one), ``delta``: places won against the rank by ``first``. One short result table."""
    rank = lambda c: F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.round(F.col(c), 12).desc_nulls_last()))
    return rows.withColumn("rank", rank(score).cast("bigint")).withColumn("delta", rank(first).cast("bigint") - F.col("rank"))


def scan_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("status") == "ok").alias("settled"), F.count_if(F.col("status") != "ok").alias("failed"), F.percentile("cagr", 0.5).alias("median_cagr"), F.avg("cagr").alias("mean_cagr"), F.percentile("sortino", 0.5).alias("median_sortino"))


def sort_page(rows: DataFrame, by: Column, page: int, size: int, *, tie: str = "symbol") -> DataFrame:
    """``position`` and the rows of one page; nulls last, ties by ``tie``. Tasks keep the rows up to the page's end, which are merged."""
    order = [by.desc_nulls_last(), F.col(tie)]
    first = rows.orderBy(*order).limit((page + 1) * size)
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("bigint")
    return first.withColumn("position", n).where(F.col("position") > page * size)


def retention_plan(rows: DataFrame, n: int, *, primary: Column, secondary: dict[str, Column], key: str, seed: int = 1, primary_share: float = 0.6, secondary_share: float = 0.3) -> DataFrame:
    """``n`` rows and the ``reason`` why each stays: the best by ``primary``, equal numbers of the best by each secondary score, a part by hash.

    Shares are rounded down and the hash takes what they leave. A row is kept for the first list that holds it; the places
    which that frees go to the next best by ``primary``. Nulls come last, ties go to the smaller ``key``. Each list is a bounded
    top-k merge of the tasks' best rows, so no task sorts all rows.
    """
    best, each = int(n * primary_share), int(n * secondary_share) // max(len(secondary), 1)
    spread = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    lists = [("primary", [primary.desc_nulls_last()], best), *[(r, [c.desc_nulls_last()], each) for r, c in secondary.items()], ("diversity", [spread], n - best - each * len(secondary)), ("primary", [primary.desc_nulls_last()], n)]

    def listed(i: int) -> DataFrame:
        reason, order, most = lists[i]
        top = rows.orderBy(*order, key).limit(most)
        return top.select("*", F.lit(reason).alias("reason"), F.lit(i).alias("_list"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order, key)).alias("_n"))

    every = listed(0)
    for i in range(1, len(lists)):
        every = every.union(listed(i))
    first = F.row_number().over(Window.partitionBy(key).orderBy("_list"))
    return every.withColumn("_first", first).where("_first = 1").orderBy("_list", "_n").limit(n).select(*rows.columns, "reason")
