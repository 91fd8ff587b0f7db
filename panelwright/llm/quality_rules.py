"""Quality rules whose thresholds follow the data: quantile sketches by language and source, then a joined filter.

Built-in functions only. Each document's base figures are one projection. Mergeable quantile sketches of its ratios are built
by language and source (map side first, so a source with a third of all rows sends one small sketch per task). Most texts have no symbol
and no repeated line, so these two are judged by the logarithm of a smoothed rate, whose spread no mass at zero hides. A group with
few documents borrows the merged sketch of its language, or of all rows. The fences join back to the figures by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.llm.shared import Workspace

SPACE = r"[\x20\x09-\x0D]+"
#: name -> (base figure, interquartile ranges from a quartile to its fence)
RATIOS = {"word_length": ("word_chars", 4.0), "symbol": ("n_symbols", 2.0), "dup_line": ("n_dup_lines", 2.0)}


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and ``\\x09``-``\\x0D``; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def base_figures(docs: DataFrame, *, text_col: str = "text", keys: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keys`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` of each whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*keys, F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"), words_of(text).alias("_words"), lines.alias("_lines"))
    word = lambda i: F.get(F.col("_words"), i)
    windows = F.when(F.size("_words") >= 6, F.transform(F.sequence(F.lit(0), F.size("_words") - 5), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2), word(i + 3), word(i + 4))))
    df = df.select("*", windows.alias("_windows"))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.select("*", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"))
    same = lambda x, j: F.get(F.col("_sorted"), j)["h"] == x["h"]
    found = F.filter("_sorted", lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
    df = df.select("*", F.sort_array(F.transform(found, lambda x: x["i"])).alias("_at"))
    covered = F.aggregate(F.transform("_at", lambda p, j: F.least(F.lit(5), F.coalesce(F.get(F.col("_at"), j + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    df = df.select(
        *keys,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def ratio(name: str) -> Column:
    """Mean word length; for the other two ``ln((count + 1) / (n_words + 10))``."""
    count = F.col(RATIOS[name][0])
    return count / F.greatest("n_words", F.lit(1)) if name == "word_length" else F.log((count + 1) / (F.col("n_words") + 10))


def fences(figures: DataFrame, *, least_docs: int = 200) -> DataFrame:
    """Upper and lower limits by (``lang``, ``source``) from mergeable sketches of the documents that pass the base rules.

    Limit: upper quartile plus a number of interquartile ranges (:data:`RATIOS`); the lower limit mirrors it. Groups of fewer
    than ``least_docs`` documents take the sketch merged over their language, if that is as few, over all.
    """
    sketch = lambda agg, of: [getattr(F, agg)(of(n)).alias(n) for n in RATIOS]
    passed = figures.where(~F.col("base_failed"))
    by_group = passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *sketch("kll_sketch_agg_double", lambda n: ratio(n)))
    merged = lambda keys: by_group.groupBy(*keys).agg(F.sum("n").alias("n"), *sketch("kll_merge_agg_double", F.col))
    lang = merged(["lang"])
    at = lambda n, q: F.expr(f"kll_sketch_get_quantile_double({n}, {q}D)")

    def limits() -> list[Column]:
        out = []
        for n, (_, fence) in RATIOS.items():
            reach = fence * (at(n, 0.75) - at(n, 0.25))
            out += [(at(n, 0.75) + reach).alias(f"{n}_high"), (at(n, 0.25) - reach).alias(f"{n}_low")]
        return out

    overall = merged([]).where("n > 0").select(*limits()).first()  # six numbers
    groups = figures.select("lang", "source").distinct().select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"))
    as_ = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    a, b = as_(by_group, "a"), as_(lang, "b")
    df = groups.join(a, F.col("g_lang").eqNullSafe(F.col("a_lang")) & F.col("g_source").eqNullSafe(F.col("a_source")), "left").join(b, F.col("g_lang").eqNullSafe(F.col("b_lang")), "left")
    pick = lambda n: F.when(F.col("a_n") >= least_docs, F.col(f"a_{n}")).when(F.col("b_n") >= least_docs, F.col(f"b_{n}"))
    df = df.select("g_lang", "g_source", *[pick(n).alias(n) for n in RATIOS]).select("g_lang", "g_source", *limits())
    spare = lambda c: F.lit(overall[c] if overall else None).cast("double")
    return df.select("g_lang", "g_source", *[F.coalesce(c, spare(c)).alias(c) for c in df.columns[2:]])


def apply_quality_rules(spark: SparkSession, docs: DataFrame, *, least_docs: int = 200, workspace: Workspace | None = None) -> DataFrame:
    """``doc_id, lang, source``, the base figures, ``base_failed``, ``reasons`` and ``kept``, one row per input row.

    ``kept`` is false if the base rules fail or a ratio lies beyond its group's fence. Mean word length has an allowance of
    ``4 / sqrt(n_words)`` at each end, because short texts scatter more; symbols and repeated lines have only an upper limit, and
    a text without any passes. Null and empty texts have no word and fail the base
    rules; null languages and sources are groups of their own; repeated rows are judged each; an empty table gives no row;
    columns other than ``doc_id, text, lang, source`` are not read. A group with no document that passes the base rules and no
    sketch to borrow has no fence, and none of its rows is kept, since they all fail the base rules.
    """
    ws = workspace or Workspace(spark, "quality-rules")
    figures = ws.save(base_figures(docs), "figures")
    limits = ws.save(fences(figures, least_docs=least_docs), "fences")
    df = figures.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    slack = 4 / F.sqrt(F.greatest("n_words", F.lit(1)))
    reasons = [F.when(F.col("base_failed"), "base")]
    reasons += [F.when(ratio("word_length") > F.col("word_length_high") + slack, "word_length_high"), F.when(ratio("word_length") < F.col("word_length_low") - slack, "word_length_low")]
    reasons += [F.when((F.col(RATIOS[n][0]) > 0) & (ratio(n) > F.col(f"{n}_high")), f"{n}_high") for n in ("symbol", "dup_line")]
    df = df.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return df.select(*figures.columns, "reasons", (F.size("reasons") == 0).alias("kept"))
