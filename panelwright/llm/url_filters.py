"""URL filters with a memory: dated list entries become validity intervals, joined to captures as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from panelwright.llm.decontamination import small


def host_of(url: Column) -> Column:
    """Lower-case host without port; empty for null and for what is no absolute URL."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Path without query and fragment."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """``kind, pattern, action, valid_from, valid_to`` of ``entries(kind, pattern, action, listed_at)``.

    An entry holds from its date until the next one of its pattern; the last has no end. Of several on one date the greatest
    action holds (``block`` over ``allow``), and repeated rows are one. Entries without a pattern or date are left out.
    """
    one = entries.where("kind is not null and pattern is not null and listed_at is not null").groupBy("kind", "pattern", F.col("listed_at").alias("valid_from")).agg(F.max("action").alias("action"))
    order = Window.partitionBy("kind", "pattern").orderBy("valid_from")
    return one.select("kind", "pattern", "action", "valid_from", F.lead("valid_from").over(order).alias("valid_to"))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, host, fetched_at, verdict, kind, pattern, valid_from`` for each row of ``captures(page_id, url, fetched_at)``.

    Every domain suffix of the host (kind ``domain``) and every leading part of host and path that ends at a slash or at the
    end (kind ``prefix``) is looked up by equality, and entries active at the fetch time match. A prefix beats a domain, a
    longer pattern a shorter. Nothing active, a null fetch time or URL: verdict ``none`` and nulls. Repeated captures are
    answered each; empty tables are allowed; other columns are not read. Entries are broadcast only while they are few.
    """
    url = captures.select("page_id", "fetched_at", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i < F.size(parts), "/").otherwise("")).alias("pattern")),
    )
    asked = url.where("host <> '' and fetched_at is not null").distinct().select("*", F.inline(F.concat(domains, prefixes)))
    active = asked.join(small(validity(entries)), ["kind", "pattern"]).where((F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    key = ("page_id", "host", "path", "fetched_at")
    rank = F.struct((F.col("kind") == "prefix").cast("int").alias("r"), F.length("pattern").alias("n"), "kind", "pattern", "action", "valid_from")
    best = active.groupBy(*key).agg(F.max(rank).alias("best"))
    best = best.select(*[F.col(c).alias(f"_{c}") for c in key], "best")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    df = url.join(best, same[0] & same[1] & same[2] & same[3], "left")
    return df.select("page_id", "host", "fetched_at", F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.kind").alias("kind"), F.col("best.pattern").alias("pattern"), F.col("best.valid_from").alias("valid_from"))
