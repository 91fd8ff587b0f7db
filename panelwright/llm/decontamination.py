"""Benchmark decontamination by spaced seeds: word windows hashed under fixed masks that ignore some positions.

Built-in functions only. A seed hit says that a document and a test item agree on a mask's positions; each diagonal (document
position minus item position) with a hit is verified by the words around: of all its segments with four equal words of five or
better, the one with most equal words has to hold enough of them.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.llm.quality_rules import words_of
from panelwright.llm.shared import Workspace

#: 1: the position counts, 0: it is ignored. Two windows of five words out of six, mirrored.
MASKS = ("110111", "111011")
#: Seeds beside the masks. An overlap of at least 13 words, or of four fifths of an item of six words or more, holds four equal
#: words in a row or a window of a mask; the masks alone miss runs of 5, 1, 5, 1 and 5 words, or a six-word item's first word.
RUN = "1111"
#: Items of fewer words must be there whole.
LEAST_WORDS = 6
#: Rows up to which a table of a few numbers and short lists is sent to all executors; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def seeds_of(words: str, masks: tuple[str, ...] = MASKS) -> Column:
    """All masks' hashes at all positions of the array column ``words``: ``array<struct<p, h>>``."""

    def hashed(mask: str) -> Callable[[Column], Column]:
        care = [k for k, x in enumerate(mask) if x == "1"]
        return lambda i: F.struct(i.alias("p"), F.xxhash64(F.lit(mask), *[F.get(F.col(words), i + k) for k in care]).alias("h"))

    none, every = F.array().cast("array<struct<p:int,h:bigint>>"), []
    for mask in masks:
        starts = F.sequence(F.lit(0), F.size(words) - len(mask))
        every.append(F.when(F.size(words) >= len(mask), F.transform(starts, hashed(mask))).otherwise(none))
    return F.concat(*every)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has so few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, min_words: int = 13, min_share: float = 0.8, masks: tuple[str, ...] = MASKS, workspace: Workspace | None = None) -> DataFrame:
    """Verified overlaps: ``doc_id, item_id, matched, span, item_words``, one row per document and item (the best diagonal).

    Words are compared in lower case. An overlap counts if the segment with most equal words, of all whose share of equal words
    is at least ``min_share``, has at least ``min_words`` of them, or ``min_share`` of a shorter item's.

    Items of fewer than six words count where they are found whole; items without words mark nothing; null texts have no words; null ids are left out; rows repeated in
    either table count once; either table may be empty; other columns are not read.
    """
    ws = workspace or Workspace(spark, "decontamination")
    lower = lambda c: words_of(F.lower(F.col(c)))
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), lower("text").alias("item"))
    items = ws.save(items.where(F.size("item") > 0).dropDuplicates(), "items")
    short = [r.n for r in items.select(F.size("item").alias("n")).where(F.col("n") < len(RUN)).distinct().collect()]  # three numbers at most
    whole = [F.when(F.size("item") == n, seeds_of("item", ("1" * n,))).otherwise(F.array().cast("array<struct<p:int,h:bigint>>")) for n in short]
    seeds = items.select("item_id", F.size("item").alias("n"), F.inline(F.concat(seeds_of("item", (*masks, RUN)), *whole))).withColumnRenamed("p", "j")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), lower("text").alias("words"))
    seeded = texts.select("doc_id", F.inline(seeds_of("words", (*masks, RUN, *["1" * n for n in short]))))
    hits = seeded.join(small(ws.save(seeds, "seeds")), "h").select("doc_id", "item_id", "n", (F.col("p") - F.col("j")).alias("d"))
    hits = ws.save(hits.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "n", "d")).alias("hits")), "hits")
    placed = texts.join(small(hits), "doc_id")
    window = lambda h: F.slice(
        F.col("words"), F.greatest(h["d"], F.lit(0)) + 1, F.greatest(F.lit(0), F.least(h["n"] + F.least(h["d"], F.lit(0)), F.size("words") - F.greatest(h["d"], F.lit(0))))
    )
    placed = placed.select("doc_id", F.inline(F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["d"].alias("d"), window(h).alias("part")))))
    aligned = placed.join(small(items), "item_id")
    theirs = F.slice("item", F.greatest(-F.col("d"), F.lit(0)) + 1, F.size("part"))
    share = Fraction(min_share).limit_denominator(1000)
    gain = lambda k, at: share.denominator * k - share.numerator * at

    def step(acc: Column, x: Column) -> Column:
        """Most equal words of a segment that ends at an equal word; ``lows``: the equal words of less gain than all before."""
        here = gain(x["k"], x["at"])
        low = (F.size(acc["lows"]) == 0) | (here < F.element_at(acc["lows"], -1)["gain"])
        lows = F.when(low, F.concat(acc["lows"], F.array(F.struct(x["k"].alias("k"), here.alias("gain"))))).otherwise(acc["lows"])
        first = F.filter(lows, lambda y: y["gain"] <= here + share.denominator - share.numerator)[0]["k"]
        return F.struct(lows.alias("lows"), F.greatest(acc["matched"], x["k"] - first + 1).alias("matched"))

    equal = F.filter(F.transform(F.zip_with("part", theirs, lambda a, b: a == b), lambda same, i: F.when(same, i)), lambda i: i.isNotNull())
    numbered = F.transform("equal", lambda at, k: F.struct(k.cast("bigint").alias("k"), at.cast("bigint").alias("at")))
    zero = F.struct(F.array().cast("array<struct<k:bigint,gain:bigint>>").alias("lows"), F.lit(0).cast("bigint").alias("matched"))
    matched = F.aggregate(numbered, zero, step, lambda acc: acc["matched"])
    df = aligned.select("doc_id", "item_id", equal.alias("equal"), F.size("item").alias("item_words")).where(F.size("equal") > 0)
    df = df.select("doc_id", "item_id", "equal", matched.alias("matched"), "item_words")
    needed = F.when(F.col("item_words") < LEAST_WORDS, F.col("item_words")).otherwise(F.ceil(min_share * F.col("item_words")))
    df = df.where(F.col("matched") >= F.least(F.lit(min_words), needed))
    many = F.col("matched").cast("int")
    spans = F.transform(F.slice("equal", many, F.size("equal") - many + 1), lambda at, k: at - F.get("equal", k) + 1)
    df = df.select("doc_id", "item_id", "item_words", F.struct("matched", F.array_min(spans).cast("bigint").alias("span")).alias("best"))
    best_of = F.max_by(F.struct(F.col("best.matched").alias("matched"), F.col("best.span").alias("span")), F.struct("best.matched", -F.col("best.span"))).alias("b")
    return df.groupBy("doc_id", "item_id", "item_words").agg(best_of).select("doc_id", "item_id", "b.matched", "b.span", F.col("item_words").cast("bigint").alias("item_words"))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, workspace: Workspace | None = None, **options) -> DataFrame:
    """``doc_id, n_items, item_ids, max_matched, contaminated``, one row per input row; rules as in :func:`find_leaks`."""
    leaks = find_leaks(spark, docs, benchmark, workspace=workspace, **options)
    by_doc = leaks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.max("matched").alias("max_matched"))
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).join(by_doc, "doc_id", "left")
    zero = F.lit(0).cast("bigint")
    return df.select("doc_id", F.coalesce("n_items", zero).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("max_matched", zero).alias("max_matched"), F.col("n_items").isNotNull().alias("contaminated"))
