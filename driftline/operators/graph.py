"""Typed relationship graph: best-path walk, exposures, hierarchies.

Edges: source_type, source_key, relationship, target_type, target_key, weight, confidence, data_mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.kernels import exposure_score
from driftline.plans.definitions import TRAVERSALS
from driftline.plans.lineage import cut
from driftline.plans.vocab import DATA_MODE_RANK

HOP_DECAY = 0.85
MAX_HOPS = 4
LEAST_WEIGHT = 0.01
LEAST_CONFIDENCE = 0.05
_PLACES = 9
HOPS = "array<struct<from_type:string,from_key:string,relationship:string,direction:string,to_type:string,to_key:string,weight:double,confidence:double>>"


def steps(edges: DataFrame, traversals=TRAVERSALS) -> DataFrame:
    """Edges in the directions in which they are followed: (from_type, from_key, to_type, to_key, factor, confidence,
    relationship, direction, role, data_mode)."""
    table = edges.sparkSession.createDataFrame(list(traversals), "relationship string, direction string, role string, multiplier double")
    ends = ("source_type", "source_key", "target_type", "target_key")
    fwd = edges.withColumn("direction", F.lit("forward")).withColumnsRenamed(dict(zip(ends, ("from_type", "from_key", "to_type", "to_key"))))
    rev = edges.withColumn("direction", F.lit("reverse")).withColumnsRenamed(dict(zip(ends, ("to_type", "to_key", "from_type", "from_key"))))
    both = fwd.unionByName(rev).join(F.broadcast(table), ["relationship", "direction"])
    return both.select("from_type", "from_key", "to_type", "to_key", (F.col("weight") * F.col("multiplier")).alias("factor"), "weight", "confidence", "relationship", "direction", "role", "data_mode")


def walk(edges: DataFrame, anchors: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(entity_type, entity_key, weight, confidence, order, role, path, mode_rank, hops) for every entity reached.

    Level by level: expand, prune, keep the best of each entity (of equal weights the surer, then the path that sorts
    first) and go on from those that beat what was known. At most max_hops joins; the kept rows are one an entity."""
    e = cut(steps(edges).withColumnRenamed("weight", "factor_weight"))
    front = anchors.select("entity_type", "entity_key", F.col("weight").cast("double").alias("weight"), F.lit(1.0).alias("confidence"), F.lit(0).alias("order"), F.lit(None).cast("string").alias("role"), F.col("entity_key").alias("path"), F.lit(3).alias("mode_rank"), F.array().cast(HOPS).alias("hops"))
    best = front
    rank = F.create_map(*[F.lit(x) for kv in DATA_MODE_RANK.items() for x in kv])
    for _ in range(max_hops):
        company = F.col("to_type") == "COMPANY"
        j = front.select(*[F.col(c).alias(f"p_{c}") for c in front.columns]).join(e, (F.col("p_entity_type") == F.col("from_type")) & (F.col("p_entity_key") == F.col("from_key")))
        nxt = j.select(
            F.col("to_type").alias("entity_type"),
            F.col("to_key").alias("entity_key"),
            F.round(F.col("p_weight") * F.col("factor"), _PLACES).alias("weight"),
            F.round(F.col("p_confidence") * F.col("confidence") * HOP_DECAY, _PLACES).alias("confidence"),
            (F.col("p_order") + company.cast("int")).alias("order"),
            F.when(company, F.col("role")).otherwise(F.col("p_role")).alias("role"),
            F.concat_ws(" > ", "p_path", "to_key").alias("path"),
            F.least(F.col("p_mode_rank"), F.coalesce(rank[F.col("data_mode")], F.lit(0))).alias("mode_rank"),
            F.array_append("p_hops", F.struct(*[F.col(c) for c in ("from_type", "from_key", "relationship", "direction", "to_type", "to_key")], F.col("factor_weight").alias("weight"), F.col("confidence"))).alias("hops"),
        ).filter((F.col("weight") >= LEAST_WEIGHT) & (F.col("confidence") >= LEAST_CONFIDENCE))
        one = nxt.groupBy("entity_type", "entity_key").agg(F.min_by(F.struct(*nxt.columns), F.struct(-F.col("weight"), -F.col("confidence"), F.col("path"))).alias("r")).select("r.*")
        known = best.select("entity_type", "entity_key", F.col("weight").alias("known"))
        front = cut(one.join(known, ["entity_type", "entity_key"], "left").filter(F.col("known").isNull() | (F.col("weight") > F.col("known"))).drop("known"))
        if front.isEmpty():
            break
        beaten = front.select("entity_type", "entity_key")
        best = cut(best.join(beaten, ["entity_type", "entity_key"], "left_anti").unionByName(front))
    return best


def described(hops: Column) -> Column:
    """A path in words: its first entity, then each relationship with an arrow in the direction in which it was followed."""
    arrow = lambda h: F.when(h["direction"] == "forward", "->").otherwise("<-")
    parts = F.transform(hops, lambda h: F.concat(arrow(h), F.lit("["), h["relationship"], F.lit("]"), arrow(h), F.lit(" "), h["to_key"]))
    return F.when(F.size(hops) == 0, F.lit("Directly anchored to the theme.")).otherwise(F.concat_ws(" ", F.get(hops, F.lit(0))["from_key"], F.array_join(parts, " ")))


def exposures(edges: DataFrame, anchors: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Companies reached, with score, order of effect, role, path and the weakest mode along it."""
    names = F.create_map(*[F.lit(x) for k, v in DATA_MODE_RANK.items() for x in (v, k)])
    c = walk(edges, anchors, max_hops).filter((F.col("entity_type") == "COMPANY") & F.col("role").isNotNull())
    return c.select(
        F.col("entity_key").alias("company_key"), "role", F.least(F.lit(5), F.greatest(F.lit(1), F.col("order"))).alias("order_of_effect"), F.round("weight", 6).alias("weight"),
        F.round("confidence", 6).alias("confidence"), exposure_score(F.col("weight")).alias("exposure_score"), F.round(F.col("confidence") * 100, 2).alias("confidence_pct"), "path", "hops", described(F.col("hops")).alias("rationale"), names[F.col("mode_rank")].alias("data_mode"),
    )


def ancestors(nodes: DataFrame) -> DataFrame:
    """(key, depth, root, path) of a hierarchy given as (key, parent); a parent that is not listed makes a root.

    As many rounds as levels; nodes that no root reaches stand in a cycle, which raises."""
    listed = nodes.select(F.col("key").alias("parent"))
    out = level = cut(nodes.join(listed, "parent", "left_anti").select("key", F.lit(0).alias("depth"), F.col("key").alias("root"), F.col("key").alias("path")))
    while not level.isEmpty():
        above = level.select(F.col("key").alias("parent"), "depth", "root", F.col("path").alias("above"))
        level = cut(nodes.join(above, "parent").select("key", (F.col("depth") + 1).alias("depth"), "root", F.concat_ws("/", "above", "key").alias("path")))
        out = out.unionByName(level)
    if not nodes.join(out, "key", "left_anti").isEmpty():
        raise ValueError("the hierarchy has a cycle")
    return out
