"""Rows that may have one of a set of keys, by a bitmap of bounded size, so that the others need not be shuffled.

The keys' hashes set bits in sixteen bits a key, at least 4 KB and at most 16 MB whatever the number of keys; that bitmap goes to every
task. A row whose bit is not set has none of the keys. The rest, those that have one and a few that share a bit with one, are joined
by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LEAST_BITS, MOST_BITS = 15, 27


def _place(key: Column, bits: int) -> Column:
    """A number from 1 to ``2 ** bits``."""
    return F.pmod(F.xxhash64(key), F.lit(1 << bits)) + 1


def split_by_keys(rows: DataFrame, keys: DataFrame, key: str, *, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be among ``keys(key)``, and those whose key is not; null keys are not.

    ``bits``: the bitmap has ``2 ** bits``; by default the keys are counted.
    """
    bits = bits or min(max(LEAST_BITS, (16 * keys.count()).bit_length()), MOST_BITS)
    at = _place(F.col(key), bits)
    maps = keys.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_map"))
    columns = rows.columns
    seen = rows.withColumn("_at", at).withColumn("_bucket", F.bitmap_bucket_number("_at")).join(F.broadcast(maps), "_bucket", "left")
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    hit = F.col(key).isNotNull() & F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return seen.where(hit).select(*columns), seen.where(~hit).select(*columns)


def without_keys(rows: DataFrame, keys: DataFrame, key: str, *, bits: int | None = None) -> DataFrame:
    """``rows`` whose ``key`` is not among ``keys(key)``; a null key stays."""
    maybe, rest = split_by_keys(rows, keys, key, bits=bits)
    return maybe.join(keys.select(key), key, "left_anti").select(*rows.columns).union(rest)
