"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import checkpointed

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) with component the smallest node of each; edges has columns a, b.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each keeps at most as many rows as there are
    edges, aggregates to one minimum for each node before rows meet, and about log n rounds end in stars. Nodes without
    edges are listed when nodes is given.
    """
    start = edges.select("a", "b").filter("a <> b")
    both = start.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = checkpointed(both)
    before = None
    for _ in range(MAX_ROUNDS):
        # Large star: each node sends its larger neighbours to the least of itself and its neighbours.
        sym = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node sends its smaller neighbours, and itself, to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (now["n"], now["h"]):
            break
        before = (now["n"], now["h"])
    else:
        raise RuntimeError("connected components did not settle")
    out = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = out.unionByName(roots)
    if nodes is not None:
        rest = nodes.select("node").distinct().join(out, "node", "left_anti")
        out = out.unionByName(rest.select("node", F.col("node").alias("component")))
    return out
