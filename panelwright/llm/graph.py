"""Connected components as rounds of joins: alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelwright.llm.shared import Workspace


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``v, component`` (the least id reachable) for every vertex of ``edges(u, v)``; self-loops make their vertex known.

    Neighbours are only ever reduced to their minimum, so a hub is pre-aggregated in map tasks and no list of a vertex's
    neighbours is held anywhere. The number of rounds grows with the logarithm of a component's diameter.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = lambda e: e.groupBy("u").agg(F.min("v").alias("m"))
    now = ws.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        sym = both(now)
        large = sym.join(least(sym).select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = ws.save(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large")
        hooked = large.join(least(large), "u")
        small = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hooked.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, ws.save(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "small")
        if before.count() == now.count() and now.join(before, ["u", "v"], "left_anti").isEmpty():  # both hold an edge once
            break
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("v"), "component")
    roots = stars.select(F.col("component").alias("v"), "component").distinct()
    return stars.union(roots)
