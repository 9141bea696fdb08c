"""Signal series, trends, themes.

``evidence`` has event_id, event_type, subject, t (timestamp), magnitude, confidence and the columns of
``independence``; ``weights`` has signal, subject, event_type, weight. Buckets run backwards from as_of and are half open.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import kernels as K
from driftline.operators.independence import profile


@dataclass(frozen=True)
class Grid:
    as_of: str  # a timestamp literal in UTC
    bucket_days: int = 7
    history_days: int = 126
    observation_days: int = 30
    baseline_days: int = 90
    saturation: float = K.SATURATION

    @property
    def buckets(self) -> int:
        return self.history_days // self.bucket_days

    def age(self, t: Column) -> Column:
        """Microseconds before as_of."""
        return F.unix_micros(F.lit(self.as_of).cast("timestamp")) - F.unix_micros(t)

    def bucket(self, t: Column) -> Column:
        """Number of the bucket before as_of: 0 is [as_of - bucket, as_of). A time on a boundary is in the later bucket."""
        return (F.ceil(self.age(t) / (self.bucket_days * 86_400_000_000.0)) - 1).cast("int")


def contributions(evidence: DataFrame, weights: DataFrame) -> DataFrame:
    """Evidence joined to the signals that weigh its type and subject, with its signed contribution.

    weights is a definition table, a row a signal and type: a list in the source."""
    signed = K.rounded(K.contribution(F.col("magnitude"), F.col("confidence"), F.col("source_quality")) * F.col("weight"), 6)
    return evidence.join(F.broadcast(weights), ["subject", "event_type"]).withColumn("signed", signed)


def aggregate(contributed: DataFrame, by: list[str], saturation: float) -> DataFrame:
    """One value a set: every cluster counts once, by its strongest contribution (of equals the first event)."""
    strongest = contributed.groupBy(*by, "cluster_id").agg(
        F.max_by("signed", F.struct(F.abs("signed"), -F.col("event_id"))).alias("signed"), F.count(F.lit(1)).alias("events")
    )
    net = strongest.groupBy(*by).agg(F.round(F.sum("signed"), 6).alias("net"), F.sum("events").alias("event_count"))
    p = profile(contributed, by)
    out = net.join(p, by)
    return out.select(
        *by,
        "net",
        "event_count",
        "independent_sources",
        "source_diversity",
        "primary_ratio",
        "avg_quality",
        K.saturating_strength(F.col("net"), saturation).alias("strength"),
        K.confidence(F.col("independent_sources"), F.col("source_diversity"), F.col("primary_ratio"), F.col("avg_quality")).alias("confidence"),
        K.direction(F.col("net")).alias("direction"),
    )


def nested_contributions(contributed: DataFrame, by: list[str]) -> DataFrame:
    """For each set its clusters' contributions as an array of structs, by cluster: what a bucket's value is made of."""
    strongest = contributed.groupBy(*by, "cluster_id").agg(F.max_by(F.struct("signed", "event_id", "source_quality"), F.struct(F.abs("signed"), -F.col("event_id"))).alias("c"), F.count(F.lit(1)).alias("events"))
    return strongest.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cluster_id", "c.signed", "c.event_id", "c.source_quality", "events"))).alias("contributions"))


def series(evidence: DataFrame, weights: DataFrame, grid: Grid) -> DataFrame:
    """A row for each signal and bucket; buckets without evidence have zeros."""
    placed = contributions(evidence, weights).withColumn("bucket", grid.bucket(F.col("t"))).filter(F.col("bucket").between(0, grid.buckets - 1))
    values = aggregate(placed, ["signal", "bucket"], grid.saturation)
    frame = weights.select("signal").distinct().select("signal", F.explode(F.sequence(F.lit(0), F.lit(grid.buckets - 1))).alias("bucket"))
    zero = {c: 0.0 for c in ("net", "source_diversity", "primary_ratio", "avg_quality", "strength", "confidence")} | {"event_count": 0, "independent_sources": 0, "direction": "NEUTRAL"}
    return frame.join(values, ["signal", "bucket"], "left").fillna(zero)


def trends(evidence: DataFrame, weights: DataFrame, grid: Grid) -> DataFrame:
    """A row a signal: the observation window against its own baseline.

    Levels count every cluster of a window once; acceleration compares bucket means; rates are per day; a bucket belongs
    to the window in which it starts."""
    buckets = series(evidence, weights, grid)
    start = (F.col("bucket") + 1) * grid.bucket_days  # days before as_of at which the bucket starts
    seen = start <= grid.observation_days
    base = (start > grid.observation_days) & (start <= grid.observation_days + grid.baseline_days)
    mean = lambda c, w: F.coalesce(F.avg(F.when(w, F.col(c))), F.lit(0.0))
    rate = lambda c, w, d: F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0)) / float(d)
    votes = lambda d: F.sum(F.when(seen & (F.col("direction") == d), 1).otherwise(0))
    t = buckets.groupBy("signal").agg(
        F.round(mean("strength", seen), 6).alias("obs_mean"),
        F.round(mean("strength", base), 6).alias("base_mean"),
        rate("event_count", seen, grid.observation_days).alias("obs_rate"),
        rate("event_count", base, grid.baseline_days).alias("base_rate"),
        rate("independent_sources", seen, grid.observation_days).alias("obs_ind"),
        rate("independent_sources", base, grid.baseline_days).alias("base_ind"),
        votes("POSITIVE").alias("up"),
        votes("NEGATIVE").alias("down"),
        F.sum(F.when(seen, 1).otherwise(0)).alias("observation_buckets"),
        F.sum(F.when(base, 1).otherwise(0)).alias("baseline_buckets"),
    )
    day = 86_400_000_000.0
    age = grid.age(F.col("t")) / day
    window = F.when((age > 0) & (age <= grid.observation_days), "obs").when((age > grid.observation_days) & (age <= grid.observation_days + grid.baseline_days), "base")
    levels = aggregate(contributions(evidence, weights).withColumn("part", window).filter("part is not null"), ["signal", "part"], grid.saturation)
    level = levels.groupBy("signal").agg(
        *[F.coalesce(F.max(F.when(F.col("part") == p, F.col(c))), F.lit(0)).alias(f"{p}_{c}") for p in ("obs", "base") for c in ("strength", "independent_sources", "confidence")]
    )
    out = t.join(level, "signal", "left")
    return out.select(
        "signal",
        K.bounded_change(F.col("obs_mean"), F.col("base_mean")).alias("acceleration"),
        K.bounded_change(F.col("obs_rate"), F.col("base_rate"), K.RATE_FLOOR).alias("frequency_change"),
        K.bounded_change(F.col("obs_ind"), F.col("base_ind"), K.RATE_FLOOR).alias("independence_change"),
        F.coalesce("obs_strength", F.lit(0.0)).cast("double").alias("observation_strength"),
        F.coalesce("base_strength", F.lit(0.0)).cast("double").alias("baseline_strength"),
        F.coalesce("obs_independent_sources", F.lit(0)).cast("long").alias("independent_sources"),
        F.round("obs_rate", 4).alias("obs_rate"),
        F.round("base_rate", 4).alias("base_rate"),
        F.when(F.col("up") > F.col("down"), "POSITIVE").when(F.col("down") > F.col("up"), "NEGATIVE").otherwise("NEUTRAL").alias("direction"),
        "observation_buckets",
        "baseline_buckets",
    )


def activated(trend: DataFrame, least: float = 20.0, sources: int = 2) -> DataFrame:
    """The gate of theme formation, with each signal's weight in a theme."""
    return trend.filter((F.col("acceleration") >= least) & (F.col("independent_sources") >= sources)).withColumn("weight", K.activation_weight(F.col("acceleration"), F.col("observation_strength")))


def theme_metrics(evidence: DataFrame, activations: DataFrame, weights: DataFrame, grid: Grid, reaction_type: str, theme: str = "theme") -> DataFrame:
    """A row a theme. activations: theme, signal, subject and the trend's columns with weight. Both ends of the window
    count. Supporting and contradicting clusters are told by the summed sign map of the theme's signals."""
    signs = activations.select(theme, "signal").join(weights.select("signal", "event_type", F.col("weight").alias("w")), "signal").groupBy(theme, "event_type").agg(F.sum("w").alias("sign"))
    subjects = activations.select(theme, "subject").distinct()
    age = grid.age(F.col("t")) / 86_400_000_000.0
    rows = evidence.filter((age >= 0) & (age <= grid.observation_days)).join(subjects, "subject")
    rows = rows.join(signs, [theme, "event_type"], "left")
    side = lambda cond: F.count_distinct(F.when(cond & (F.col("event_type") != reaction_type), F.col("cluster_id")))
    sides = rows.groupBy(theme).agg(side(F.col("sign") > 0).alias("supporting"), side(F.col("sign") < 0).alias("contradicting"), F.max(F.col("event_type") == reaction_type).alias("market_reaction"))
    w = F.coalesce(F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(1.0))
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("weight")) / w, 4)
    means = activations.groupBy(theme).agg(mean("observation_strength").alias("strength"), mean("acceleration").alias("acceleration"), mean("frequency_change").alias("frequency_change"))
    out = means.join(sides, theme, "left").join(profile(rows, [theme]), theme, "left")
    out = out.withColumn("contradiction_ratio", K.contradiction_ratio(F.col("supporting"), F.col("contradicting")))
    return out.withColumn("novelty", K.novelty(F.col("mainstream_share"), F.col("market_reaction")))


def maturity(sources: Column, acceleration: Column, mainstream: Column, reaction: Column, contradiction: Column) -> Column:
    """Ordered rules; the order is part of the meaning."""
    return (
        F.when((contradiction >= 0.6) & (sources >= 4), "INVALIDATED")
        .when(sources < 2, "INVISIBLE")
        .when((mainstream >= 0.65) & reaction, "CROWDED")
        .when(mainstream >= 0.45, "CONSENSUS")
        .when((acceleration >= 25) & (sources >= 5), "ACCELERATING")
        .when(sources >= 4, "DEVELOPING")
        .when(acceleration <= 5, "MATURE")
        .otherwise("EMERGING")
    )


def awareness(mainstream: Column, reaction: Column) -> Column:
    return (
        F.when((mainstream >= 0.65) & reaction, "CROWDED")
        .when(mainstream >= 0.45, "CONSENSUS")
        .when((mainstream >= 0.25) | reaction, "DEVELOPING")
        .when(mainstream > 0, "EMERGING")
        .otherwise("UNKNOWN")
    )
