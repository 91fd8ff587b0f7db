from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import fill_in_middle as M, hard_negatives as H, queries as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "table"), [("op12_fill_in_middle", "documents"), ("op13_hard_negatives", "embeddings")])
def test_query_equals_sql(spark, name, table):
    df, con = Q.queries()[name](spark, SF), duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    assert df.columns == want.columns
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR"}
    assert [kinds[t] for _, t in df.dtypes] == [str(t) for t in want.types]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want.fetchall(), key=key)


def brute_middle(key, text, plain_percent=10):
    h = [int(hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    text, n = text or "", len(text or "")
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("at_once", [1, 50, 1 << 20])
def test_middle_equals_brute_force_and_goes_back(spark, at_once):
    rng = random.Random(1)
    texts = [None, "", "a", "é", "😀", "<P", "<S<S>", "a<M>b", "<", "<<", "\n", "\x00", "ab" * 100_000, "é😀x" * 30_000]
    texts += ["".join(rng.choice("ab<PSM>é😀\n ") for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    rows = [(i % 300, t, "x", "psm", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", "", 2), (5, "twice", "", "", 3), (5, "twice", "", "", 3)]
    df = M.fill_in_middle(spark.createDataFrame(rows, "doc_id bigint, text string, output string, form string, n int"), bytes_at_once=at_once)
    got = [tuple(r) for r in df.select("*", M.restored(F.col("output"), F.col("form"))).collect()]
    want = [(r[0], *brute_middle(r[0], r[1]), r[1] or "") for r in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_middle_of_an_empty_table(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def brute_negatives(rows, scale=256, positives=5, negatives=10):
    ok = [(i, l, [math.floor(scale * x) for x in v]) for i, l, v, _ in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, l, v, (_, _, raw, a) in ((*o, r) for o, r in zip(ok, [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])], strict=True)):
        if a and (i not in anchors or (l, raw) < anchors[i][:2]):
            anchors[i] = (l, raw, v)
    out = []
    for a, (label, _, v) in anchors.items():
        score = lambda w, v=v: sum(x * y for x, y in zip(v, w, strict=False))
        pos = sorted({(-score(w), i) for i, l, w in ok if l == label and i != a})[:positives]
        for p, pid in pos:
            neg = sorted({(-score(w), i) for i, l, w in ok if l != label and 30 * -p <= 100 * score(w) <= 90 * -p})[:negatives]
            out += [(a, pid, r, i, -p, -s) for r, (s, i) in enumerate(neg, 1)]
    return sorted(out)


def negatives(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>, a boolean").withColumn("rank", F.lit(1)).withColumn("id", F.lit("x"))
    return sorted(tuple(r) for r in H.hard_negatives(spark, df.repartition(3), F.col("a"), **options).collect())


@pytest.mark.parametrize(("spread", "options"), [(0.02, {}), (1.0, {"components_at_once": 60, "scores_at_once": 40}), (300.0, {}), (3e6, {})])
def test_negatives_equal_brute_force(spark, spread, options):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), [rng.uniform(-spread, spread) + spread / 2 for _ in range(6)], i % 9 == 0) for i in range(150)]
    rows += rows[:20]  # repeated rows
    rows += [(9, 2, rows[9][2], True), (30, 1, rows[30][2][:4], False), (31, 1, [], False)]  # ids twice, short vectors
    rows += [(None, 1, rows[0][2], True), (200, None, rows[0][2], True), (201, 1, None, True), (202, 1, [1.0, None], True), (203, 1, [float("nan")], True), (204, 1, [float("inf")], True)]
    want = brute_negatives(rows)
    assert want and negatives(spark, rows, **options) == want


def test_ties_go_to_the_smaller_id_and_empty_tables(spark):
    rows = [(i, i % 2, [0.5 if i % 2 else 1.0], i == 0) for i in range(100)]
    got = negatives(spark, rows, scores_at_once=7)
    assert got == brute_negatives(rows) and [r[3] for r in got if r[1] == 2] == list(range(1, 20, 2))
    assert negatives(spark, []) == negatives(spark, [(1, 1, [1.0], False)]) == []


@pytest.mark.parametrize("top", [1, 3, 250, 70_000, 2**30])
def test_packed_products_are_exact(top):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-top, top + 1, (37, 9)), rng.integers(-top // 2, top + 1, (11, 9))
    want = a.astype(object) @ b.T.astype(object)
    assert (H.kronecker_scores(a, b) == want).all()
