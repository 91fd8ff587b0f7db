"""The evidence about pairs and its verdicts, against plain Python."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from panelwright.operators import matrix as X

COLUMNS = "a string, b string, structural double, medium double, downside double, stress double, factor double, bootstrap double, window_share double, same_average boolean, same_complete boolean, factor_eligible boolean, n_windows bigint, n_replicates bigint"


def plain(r) -> tuple[str, str]:
    known = lambda x, least: x is not None and x >= least
    sure = r.structural is not None and r.medium is not None
    confidence = next((name for name, w, n in (("HIGH", 3, 190), ("MEDIUM", 2, 160)) if sure and r.n_windows >= w and r.n_replicates >= n), "LOW")
    if None in (r.structural, r.bootstrap, r.same_average):
        return "UNCERTAIN", confidence
    if r.same_average:
        if r.same_complete and r.structural >= 0.8 and r.bootstrap >= 0.75 and known(r.window_share, 2 / 3) and known(r.medium, 0.7):
            return "HIGH", confidence
        support = known(r.medium, 0.6) or known(r.downside, 0.65) or known(r.stress, 0.65) or (r.factor_eligible and known(r.factor, 0.65))
        return ("MEDIUM" if support and r.structural >= 0.65 and r.bootstrap >= 0.6 else "UNCERTAIN"), confidence
    return ("LOW" if r.structural <= 0.35 and r.bootstrap <= 0.35 else "UNCERTAIN"), confidence


def test_verdicts_equal_plain_rules(spark):
    rng = random.Random(1)
    number = lambda: rng.choice([None, 0.1, 0.35, 0.6, 0.65, 2 / 3, 0.7, 0.75, 0.8, 0.9, 0.95])
    rows = []
    for i in range(3000):
        high = i % 3 == 0  # a third of the rows is near the highest verdict
        v = [rng.choice([0.7, 0.8, 0.9]) if high else number() for _ in range(7)]
        rows.append((f"a{i}", "b", *v, high or rng.choice([True, False, None]), rng.choice([True, False, None]) if not high else rng.random() < 0.8, rng.choice([True, False, None]), rng.randrange(4), rng.choice([0, 159, 160, 189, 190, 200])))
    got = X.redundancy_verdict(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(got) == len(rows) and [(r.verdict, r.confidence) for r in got] == [plain(r) for r in got]
    assert {r.verdict for r in got} == {"HIGH", "MEDIUM", "LOW", "UNCERTAIN"} and {r.confidence for r in got} == {"HIGH", "MEDIUM", "LOW"}
    assert X.redundancy_verdict(spark.createDataFrame([], COLUMNS)).count() == 0


def test_evidence_of_pairs(spark):
    names, rng = "ABCDE", random.Random(2)
    pairs = list(itertools.combinations(names, 2))
    rho = {p: round(rng.random(), 3) for p in pairs}
    table = lambda f, keep=pairs: spark.createDataFrame([(*p, f(p)) for p in keep], "a string, b string, rho double")
    parts = {"structural": table(rho.get), "medium": table(lambda p: 0.5, pairs[:4]), "downside": table(lambda p: None), "stress": table(rho.get, pairs[2:])}
    group = {"average": {"A": 0, "B": 0, "C": 1, "D": 1, "E": 2}, "complete": {"A": 0, "B": 1, "C": 2, "D": 2, "E": 3}}
    clusters = spark.createDataFrame([(m, s, c) for m, g in group.items() for s, c in g.items()], "method string, symbol string, cluster_id bigint")
    runs = spark.createDataFrame([(str(k), s, int(s in names[: k + 1])) for k in range(4) for s in names], "replicate string, symbol string, cluster_id bigint")
    windows = spark.createDataFrame([("one", s, 0) for s in "AB"], "horizon string, symbol string, cluster_id bigint")
    eligible = spark.createDataFrame([("A",), ("B",), ("B",), ("D",)], "symbol string")
    got = {(r.a, r.b): r for r in X.pair_evidence(parts, clusters, X.cocluster_share(runs, "replicate"), X.cocluster_share(windows, "horizon"), table(rho.get, pairs[:1]), eligible).collect()}
    assert set(got) == set(pairs)
    for (a, b), r in got.items():
        assert (r.same_average, r.same_complete) == tuple(group[m][a] == group[m][b] for m in ("average", "complete"))
        together = [(a in names[: k + 1]) == (b in names[: k + 1]) for k in range(4)]
        assert (r.bootstrap, r.n_replicates) == (sum(together) / 4, 4)
        assert (r.window_share, r.n_windows) == ((1.0, 1) if (a, b) == ("A", "B") else (None, 0))
        assert r.factor_eligible == ({a, b} <= {"A", "B", "D"}) and r.structural == rho[a, b] and r.downside is None
        assert r.medium == (0.5 if (a, b) in pairs[:4] else None) and r.factor == (rho[a, b] if (a, b) == ("A", "B") else None)


def test_clusters_need_every_distance(spark):
    rows = [("average", "A", "B", 0.1), ("average", "A", "C", 0.9), ("average", "B", "C", None), ("complete", "A", "B", 0.1), ("complete", "A", "C", 0.9), ("complete", "B", "C", 0.8)]
    got = X.hierarchical_clusters(spark.createDataFrame(rows, "method string, a string, b string, distance double")).where(F.col("method").isNotNull()).collect()
    assert sorted((r.method, r.symbol, r.cluster_id) for r in got) == [("complete", "A", 0), ("complete", "B", 0), ("complete", "C", 1)]
    assert X.bootstrap_index(spark, 0).count() == 0
