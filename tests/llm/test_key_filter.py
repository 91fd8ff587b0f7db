from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelwright.llm import key_filter


@pytest.mark.parametrize("bits", [15, 16, 27, None])
def test_without_keys_is_exact_at_any_size_of_bitmap(spark, bits):
    rng = random.Random(bits or 1)
    rows = [(rng.choice([None, *range(-50, 3000)]), f"t{i}") for i in range(4000)]
    keys = rng.sample(range(-50, 3000), 900)
    df, k = spark.createDataFrame(rows, "k bigint, t string"), spark.createDataFrame([(x,) for x in [*keys, None]], "k bigint")
    got = sorted((r.t, r.k) for r in key_filter.without_keys(df, k, "k", bits=bits).collect())
    gone = set(keys)
    assert got == sorted((t, x) for x, t in rows if x not in gone)
    maybe, rest = key_filter.split_by_keys(df, k, "k", bits=bits)
    assert maybe.count() + rest.count() == len(rows)
    if bits == 27:
        assert maybe.count() < sum(x in gone for x, _ in rows) + 5
    assert key_filter.without_keys(df, k.where("false"), "k").count() == len(rows)
    assert key_filter.without_keys(df.where(F.lit(False)), k, "k").count() == 0
