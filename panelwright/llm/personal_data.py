"""Personal data by patterns of characters, then by the contexts in which such identifiers stand.

Built-in functions only. The base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. These are the seeds of
a bootstrap: the words around a seed are lexical patterns, a graph joins patterns to every identifier-like string (word with a
digit or ``@``) that stands in them, and rounds of joins score it. A pattern is worth the share of known identifiers of
its kind among what it holds, an unknown string of the right shape what its best pattern is worth; strings that score high are
known in the next round, and in the end every place where they stand is a span.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.llm.shared import Workspace

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns. Each group is possessive and each start barred inside a run that a match would have to begin with, so
# that no long run is read twice; the matches are the same. \G lets a match start where the one before it ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

EDGE = r"\x20\x09-\x0D:=|\"'<>,;"
#: An identifier-like string: groups of digits with light separators, or any other word with a digit or ``@``.
STRING = rf"(?<![^{EDGE}])(?:[+(]*+[0-9](?:[\x20()./-]{{0,2}}[0-9])*+(?![^{EDGE}.!?)\]])|[^{EDGE}0-9@]*+[0-9@][^{EDGE}]*+)"
#: What an unknown string must look like to be taken as of a kind (digits alone are counted besides).
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9]++(?:\.[0-9]++){3}$",
    "card": r"^[0-9](?:[\x20-]?[0-9])++$",
    "phone": r"^[+(]*[0-9][\x20()./0-9-]*[0-9]$",
}
DIGITS = {"card": (12, 19), "phone": (7, 15)}

SPACE, BEFORE, AFTER = r"[\x20\x09-\x0D]+", 64, 32
SALTS = 16


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """The digits' sum, every second from the end doubled, is divisible by ten."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, x: Column) -> Column:
    """Whether a match of a base pattern is of its kind."""
    if kind == "ip":
        part = F.split(x, r"\.")
        small = lambda p: (F.length(F.ltrim(F.lit("0"), p)) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)) <= "255")
        return F.forall(part, small)
    n = F.length(digits_of(x))
    if kind == "card":
        return n.between(16, 19) & passes_luhn(digits_of(x))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def words_before(x: Column) -> Column:
    """The last two words of ``x``, nearer one first, in lower case; words with a digit or ``@`` are ``#``."""
    words = F.array_remove(F.split(F.lower(F.right(x, F.lit(BEFORE))), SPACE), "")
    words = F.transform(words, lambda w: F.when(w.rlike("[0-9@]"), "#").otherwise(w))
    return F.slice(F.reverse(words), 1, 2)


def word_after(x: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.left(x, F.lit(AFTER))), SPACE), "")
    word = F.get(words, F.lit(0))
    return F.when(word.rlike("[0-9@]"), "#").otherwise(word)


def patterns_of(before: Column, after: Column) -> Column:
    """The lexical patterns of a place: the word before, the two words before, the words on both sides."""
    one, two = F.get(before, F.lit(0)), F.get(before, F.lit(1))
    made = F.array(F.concat(one, F.lit(" _")), F.concat(two, F.lit(" "), one, F.lit(" _")), F.concat(one, F.lit(" _ "), after))
    return F.filter(made, lambda p: p.isNotNull() & p.rlike(r"\p{L}"))


def _places(hits: str, gaps: str) -> Column:
    """``start, end, string, patterns`` of every hit, in code points; gaps are the texts before, between and after the hits."""
    length = lambda a, i: F.length(F.get(F.col(a), i))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, i: F.struct((a["at"] + length(gaps, i) + length(hits, i)).alias("at"), F.concat(a["starts"], F.array(a["at"] + length(gaps, i))).alias("starts"))
    starts = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), empty, step)["starts"]
    place = lambda s, i: F.struct(
        s.alias("start"),
        (s + length(hits, i)).alias("end"),
        F.get(F.col(hits), i).alias("string"),
        patterns_of(words_before(F.concat(F.when(i > 0, "# ").otherwise(""), F.get(F.col(gaps), i))), word_after(F.get(F.col(gaps), i + 1))).alias("patterns"),
    )
    return F.when(F.size(hits) > 0, F.transform(starts, place))


def base_spans(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep``, an array ``email, ip, card, phone`` of places each, and ``strings``: other identifier-like strings, trimmed, as places.

    A string that holds a base match is none of the others.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digit, at = text.rlike("[0-9]"), text.contains("@")
    guards = {"email": at, "ip": digit, "card": digit, "phone": text.contains("+")}
    every = {**BASE, "string": STRING}
    df = docs.select(*keep, text.alias("_text"), *[F.when(guards.get(k, digit | at), F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"{k}_hits") for k, p in every.items()])
    df = df.select(*keep, *[f"{k}_hits" for k in every], *[F.when(F.size(f"{k}_hits") > 0, F.split("_text", p, -1)).alias(f"{k}_gaps") for k, p in every.items()])
    of = lambda k: lambda x: holds(k, x["string"])
    base = [F.filter(_places(f"{k}_hits", f"{k}_gaps"), of(k)).alias(k) for k in KINDS]
    head = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^[\[({]+(?![0-9])", ""))
    trimmed = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\[({]+(?![0-9])", ""), r"[.!?\])}]+$", "")
    other = lambda x: F.struct((x["start"] + head(x["string"])).alias("start"), (x["start"] + head(x["string"]) + F.length(trimmed(x["string"]))).alias("end"), trimmed(x["string"]).alias("string"), x["patterns"].alias("patterns"))
    is_ = lambda k: lambda m: holds(k, m)
    known = lambda x: reduce(lambda a, b: a | b, [F.exists(F.regexp_extract_all(x["string"], F.lit(BASE[k]), F.lit(0)), is_(k)) for k in KINDS])
    strings = F.transform(F.filter(_places("string_hits", "string_gaps"), lambda x: ~known(x)), other)
    return df.select(*keep, *base, strings.alias("strings"))


def shape_of(kind: str, x: Column) -> Column:
    n = F.length(digits_of(x))
    return x.rlike(SHAPES[kind]) & n.between(*DIGITS.get(kind, (0, 1 << 30)))


def _salted(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small`` (one row a key): rows of a hot key are spread over :data:`SALTS` copies of the small side's row."""
    left = big.withColumn("salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    right = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "salt"], how).drop("salt")


def score_graph(ws: Workspace, edges: DataFrame, *, least_seeds: int, least_score: float, unknown_weight: float, rounds: int) -> DataFrame:
    """``string, kind, score`` of the strings that the bootstrap adds, from ``edges(pattern, string, kind)``; seeds have a kind.

    A pattern's worth for a kind: the known strings' scores in it over these, the strings that are of another kind or can't be of this
    one, ``unknown_weight`` of the others, and one. It counts only with ``least_seeds`` known strings.
    """
    flag = lambda c: F.max(c.cast("int"))
    # a string that is a seed anywhere is no unknown
    kinds = edges.groupBy("string").agg(*[flag(F.coalesce(F.col("kind") == k, F.lit(False))).alias(f"is_{k}") for k in KINDS])
    kinds = kinds.select("string", *[f"is_{k}" for k in KINDS], *[shape_of(k, F.col("string")).cast("int").alias(f"like_{k}") for k in KINDS])
    seeds = reduce(lambda a, b: a + b, [F.col(f"is_{k}") for k in KINDS]) > 0
    kinds = ws.save(kinds.withColumn("seed", seeds), "strings")
    links = ws.save(_salted(edges.select("pattern", "string").distinct(), kinds, "string"), "links")
    found = None
    for _ in range(rounds):
        rated, score = links, {k: F.col(f"is_{k}").cast("double") for k in KINDS}
        if found is not None:
            rated = _salted(links, found, "string", "left")
            score = {k: F.when(F.col("seed"), score[k]).otherwise(F.coalesce(F.when(F.col("kind") == k, F.col("score")), F.lit(0.0))) for k in KINDS}
        known = F.col("seed") if found is None else F.col("seed") | F.col("kind").isNotNull()
        sums = []
        for k in KINDS:
            against = F.when(score[k] > 0, 0.0).when(known | (F.col(f"like_{k}") == 0), 1.0).otherwise(unknown_weight)
            sums += [F.sum(score[k]).alias(f"for_{k}"), F.sum(against).alias(f"against_{k}")]
        worth = rated.groupBy("pattern").agg(*sums)
        each = [F.struct(F.lit(k).alias("kind"), (F.col(f"for_{k}") / (F.col(f"for_{k}") + F.col(f"against_{k}") + 1)).alias("score"), F.col(f"for_{k}").alias("seeds")) for k in KINDS]
        worth = worth.select("pattern", F.inline(F.array(*each))).where((F.col("seeds") >= least_seeds) & (F.col("score") >= least_score))
        worth = worth.groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("best")).select("pattern", "best.*")
        worth = ws.save(worth, "patterns")
        like = reduce(lambda a, k: a.when(F.col("kind") == k, F.col(f"like_{k}")), KINDS, F.when(F.lit(False), 0))
        unseen = links.where(~F.col("seed"))
        hits = _salted(unseen.select("pattern", "string", *[f"like_{k}" for k in KINDS]), worth, "pattern").where(like == 1)
        now = hits.groupBy("string").agg(F.max(F.struct("score", "kind")).alias("best")).select("string", "best.kind", "best.score")
        now = ws.save(now, "found")
        if found is not None and now.select("string", "kind").exceptAll(found.select("string", "kind")).isEmpty():
            break
        found = now
    return now


def find_personal_data(
    spark: SparkSession,
    docs: DataFrame,
    *,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    least_seeds: int = 4,
    least_score: float = 0.75,
    unknown_weight: float = 0.25,
    rounds: int = 4,
    workspace: Workspace | None = None,
) -> DataFrame:
    """``keep``, ``base`` and ``added``: spans ``kind, start, end, string, score`` of the base patterns and of the bootstrap, one row per input row.

    Spans are in code points, end exclusive, in order of kind, then start. An added span overlaps no base span. Base spans of
    different kinds may overlap, those of one kind don't. Null and empty texts have none; a repeated row has its own row, its
    strings count once; rows with a null id are rows like others; an empty table gives no row; other columns are not
    read. Contexts are at most two words in 64 characters before and one in 32 after.
    """
    ws = workspace or Workspace(spark, "personal-data")
    kinds = {k: i for i, k in enumerate(KINDS)}
    found = ws.save(base_spans(docs, keep=keep, text_col=text_col).withColumn("row", F.monotonically_increasing_id()), "spans")
    string = lambda x: F.lower(x["string"])
    tagged = lambda c, k: F.transform(F.coalesce(F.col(c), F.array().cast(found.schema[c].dataType)), lambda x: F.struct(string(x).alias("string"), F.lit(k).cast("string").alias("kind"), x["patterns"].alias("patterns")))
    seen = found.select(F.inline(F.concat(*[tagged(k, k) for k in KINDS], tagged("strings", None))))
    edges = ws.save(seen.select("string", "kind", F.explode("patterns").alias("pattern")).distinct(), "edges")
    known = score_graph(ws, edges, least_seeds=least_seeds, least_score=least_score, unknown_weight=unknown_weight, rounds=rounds)

    places = found.select("row", F.explode("strings").alias("x")).select("row", string(F.col("x")).alias("string"), F.struct("x.start", "x.end", F.col("x.string").alias("text")).alias("x"))
    placed = _salted(places, known, "string").select("row", F.struct("kind", "x.start", "x.end", F.col("x.text").alias("string"), "score").alias("span"))
    added = placed.groupBy(F.col("row").alias("of")).agg(F.collect_list("span").alias("new"))
    span = lambda c, k: F.transform(F.coalesce(F.col(c), F.array().cast(found.schema[c].dataType)), lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["string"].alias("string"), F.lit(1.0).alias("score")))
    df = found.select(*keep, "row", F.concat(*[span(k, k) for k in KINDS]).alias("base")).join(added, F.col("row") == F.col("of"), "left")
    clear = lambda n: ~F.exists("base", lambda b: (b["start"] < n["end"]) & (n["start"] < b["end"]))
    number = lambda x: reduce(lambda a, k: a.when(x["kind"] == k, kinds[k]), KINDS, F.when(F.lit(False), 0))
    new = F.array_sort(F.transform(F.filter(F.coalesce("new", F.array().cast(added.schema["new"].dataType)), clear), lambda x: F.struct(number(x).alias("nr"), x["start"].alias("start"), x.alias("span"))))
    return df.select(*keep, "base", F.transform(new, lambda x: x["span"]).alias("added"))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, by kind as in :data:`KINDS`, then start."""
    number = lambda x: reduce(lambda a, k: a.when(x["kind"] == k, KINDS.index(k)), KINDS, F.when(F.lit(False), 0))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(number(x).alias("nr"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
