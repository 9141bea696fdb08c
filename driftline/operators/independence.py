"""Independence profiles: evidence counts by cluster, never by volume.

Evidence has the columns cluster_id, evidence_id, source_class, source_quality, is_primary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.kernels import entropy_term, normalised_entropy
from driftline.plans.vocab import DATA_MODE_RANK


def representatives(evidence: DataFrame, by: list[str]) -> DataFrame:
    """One row for each set and cluster: class and quality of its best source (of equals the last evidence), whether any
    member is primary, and the number of members. Pre-aggregates in each task, so a large cluster is one row a task."""
    best = F.max_by(F.struct("source_class", "source_quality"), F.struct("source_quality", "evidence_id"))
    return evidence.groupBy(*by, "cluster_id").agg(best.alias("r"), F.max("is_primary").alias("is_primary"), F.count(F.lit(1)).alias("members")).select(
        *by, "cluster_id", F.col("r.source_class").alias("source_class"), F.col("r.source_quality").alias("source_quality"), "is_primary", "members"
    )


def profile(evidence: DataFrame, by: list[str]) -> DataFrame:
    """For each set: evidence_count, independent_sources, source_diversity, primary_ratio, avg_quality, amplification and
    mainstream_share. Two aggregations: by cluster, then by class; the classes of a set make nine rows at most."""
    per_class = representatives(evidence, by).groupBy(*by, "source_class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("members").alias("members"), F.sum("source_quality").alias("quality"), F.sum(F.col("is_primary").cast("long")).alias("primary")
    )
    totals = per_class.groupBy(*by).agg(F.sum("n").alias("all"), F.sum("members").alias("evidence_count"), F.sum("quality").alias("quality"), F.sum("primary").alias("primary"),
        F.collect_list("n").alias("ns"), F.coalesce(F.sum(F.when(F.col("source_class") == "FINANCIAL_MEDIA", F.col("n"))), F.lit(0)).alias("mainstream"))
    n = F.col("all")
    terms = F.aggregate(F.array_sort("ns"), F.lit(0.0), lambda acc, x: acc + entropy_term(x / n))
    return totals.select(
        *by,
        "evidence_count",
        n.alias("independent_sources"),
        F.round(normalised_entropy(terms), 6).alias("source_diversity"),
        F.round(F.col("primary") / n, 6).alias("primary_ratio"),
        F.round(F.col("quality") / n, 6).alias("avg_quality"),
        F.round(n / F.col("evidence_count"), 6).alias("amplification"),
        F.round(F.col("mainstream") / n, 4).alias("mainstream_share"),
    )


def weakest_mode(mode: Column) -> Column:
    """Aggregate: the mode of the lowest rank, UNAVAILABLE where there is none."""
    rank = F.create_map(*[F.lit(x) for kv in DATA_MODE_RANK.items() for x in kv])[mode]
    return F.coalesce(F.min_by(mode, rank), F.lit("UNAVAILABLE"))
