"""Snapshot intake and the manifest of a prepared panel."""

from __future__ import annotations

import random
from datetime import date, timedelta

from panelwright.sources import files as S
from panelwright.streaming import ingest as I

DAY = date(2024, 1, 1)


def snap(universe, day, members, fetched=0):
    return universe, DAY + timedelta(day), DAY + timedelta(day + fetched), False, sorted(members), len(members), f"c{fetched}{len(members)}"


def tables(spark, at):
    rows = lambda p: sorted(tuple(map(str, r)) for r in spark.read.parquet(p).collect())
    return rows(f"{at}/archive"), rows(f"{at}/rejects"), rows(f"{at}/archive-state")


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    at, a = str(tmp_path), list("abcdefgh")
    one = [snap("u", 1, a), snap("u", 2, a[:7] + ["x"]), snap("u", 3, list("stuvwxyz")), snap("u", 3, a, 1), snap("v", 1, a[:2]), snap("w", 500, a)]
    two = [snap("u", 1, a), snap("u", 4, a[:6] + ["x", "y"]), snap("u", 0, a), snap("v", 2, a), snap("z", 2, a)]
    run = lambda rows, n: I.publish(spark, spark.createDataFrame(rows, I.LANDED), n, f"{at}/archive", f"{at}/rejects", f"{at}/archive-state", "2024-02-01", low=3, most_turnover=0.4)
    run(one, 0)
    first = tables(spark, at)
    run(one[::-1], 0)
    assert tables(spark, at) == first
    assert {(r[0], r[1]) for r in first[0]} == {("u", "2024-01-02"), ("u", "2024-01-03")}
    assert {(r[0], r[1], r[2]) for r in first[1]} == {("u", "2024-01-04", "churn"), ("v", "2024-01-02", "count"), ("w", "2025-05-15", "future")}
    run(two, 1)
    second = tables(spark, at)
    run(one, 0)
    run(two, 1)
    assert tables(spark, at) == second
    assert {(r[0], r[1]) for r in second[0]} == {("u", "2024-01-01"), ("u", "2024-01-02"), ("u", "2024-01-03"), ("u", "2024-01-05"), ("v", "2024-01-03"), ("z", "2024-01-03")}
    state = {r[0]: r[1] for r in second[2] if r[-1] == "1"}
    assert state == {"u": "2024-01-05", "v": "2024-01-03", "z": "2024-01-03"}  # the older snapshot of u does not come back
    run([], 2)
    assert tables(spark, at)[:2] == second[:2]


def test_stream_takes_what_has_landed_once(spark, tmp_path):
    at = str(tmp_path)
    for day in (1, 2):
        spark.createDataFrame([snap("u", day, "abc"), snap("w", 900, "abc")], I.LANDED).write.mode("append").parquet(f"{at}/landing")
        I.ingest_snapshots(spark, f"{at}/landing", f"{at}/archive", f"{at}/rejects", f"{at}/checkpoint", "2024-02-01")
    archive, rejects, _ = tables(spark, at)
    assert [r[1] for r in archive] == ["2024-01-02", "2024-01-03"] and len(rejects) == 2


def test_one_changed_value_changes_the_manifest(spark):
    rng = random.Random(1)
    rows = [(f"S{s}", DAY + timedelta(d), rng.random()) for s in range(4) for d in range(30)]
    read = lambda x, n: {r.symbol: tuple(r) for r in S.prepared_panel_manifest(spark.createDataFrame(x, "symbol string, dt date, value double").repartition(n)).collect()}
    first = read(rows, 3)
    assert first == read(rows[::-1], 7) and set(first) == {"S0", "S1", "S2", "S3", None}
    assert int(first[None][-1]) == sum(int(v[-1]) for k, v in first.items() if k) and first[None][3:5] == (4, 120)
    changed = read([(s, d, v + 1e-5) if i == 50 else (s, d, v) for i, (s, d, v) in enumerate(rows)], 3)
    assert {k for k in first if first[k] != changed[k]} == {"S1", None}
    swapped = [(s, d, rows[i ^ 1][2]) if i < 2 else (s, d, v) for i, (s, d, v) in enumerate(rows)]
    assert read(swapped, 3)["S0"] != first["S0"]
