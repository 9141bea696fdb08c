"""Score models: weights renormalised over the components that could be resolved; missing is never zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import kernels as K
from driftline.plans.definitions import SCORE_MODELS, UNAVAILABLE_COMPONENTS


def specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, i, k, float(w)) for m, parts in SCORE_MODELS.items() for i, (k, w) in enumerate(parts)], "model string, ord int, key string, weight double")


def resolve(metrics: DataFrame, subject: str = "theme") -> DataFrame:
    """Long rows (subject, model, key, raw) of the components that metrics give; confidence is added by ``totals``.

    metrics: strength, acceleration, source_diversity, primary_ratio, avg_quality, independent_sources, novelty,
    contradiction_ratio, exposure_top."""
    c = F.col
    gate = K.independence_gate(c("independent_sources"))
    quality = F.round(0.5 * K.saturating_count(c("independent_sources")) + 0.3 * c("avg_quality") + 0.2 * 100 * c("primary_ratio"), 4)
    half = (c("acceleration") + 100) / 2
    values = {
        ("trend", "signal_strength"): c("strength"),
        ("trend", "signal_acceleration"): half,
        ("trend", "evidence_diversity"): c("source_diversity") * 100,
        ("trend", "novelty"): c("novelty"),
        ("trend", "company_exposure"): c("exposure_top"),
        ("opportunity", "trend_strength"): c("strength"),
        ("opportunity", "trend_acceleration"): half,
        ("opportunity", "company_exposure"): c("exposure_top"),
        ("opportunity", "evidence_quality"): quality,
        ("opportunity", "novelty"): c("novelty"),
        ("confidence", "independent_sources"): K.saturating_count(c("independent_sources")),
        ("confidence", "source_quality"): c("avg_quality") * gate,
        ("confidence", "primary_ratio"): c("primary_ratio") * 100 * gate,
        ("confidence", "source_diversity"): c("source_diversity") * 100 * gate,
        ("confidence", "contradiction_balance"): 100 * (1 - c("contradiction_ratio")) * gate,
    }
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("key"), v.cast("double").alias("value")) for (m, k), v in values.items()])
    return metrics.select(subject, F.inline(rows))


def components(values: DataFrame, subject: str = "theme") -> DataFrame:
    """Each component with its effective weight and contribution. values: subject, model, key, value (null: unavailable).

    A component of a model that values lack for a subject raises: silence would hide a gap."""
    spec = F.broadcast(specs(values.sparkSession))
    frame = values.select(subject, "model").distinct().join(spec, "model")
    known = values.withColumn("given", F.lit(True))
    rows = frame.join(known, [subject, "model", "key"], "left")
    missing = F.col("given").isNull() & ~F.col("key").isin(*UNAVAILABLE_COMPONENTS)
    rows = rows.withColumn("raw", F.round("value", 4)).withColumn("value", F.when(missing, F.raise_error(F.concat(F.lit("unresolved component "), "key")).cast("double")).otherwise(K.component_value(F.col("value"))))
    available = F.col("value").isNotNull()
    total = F.sum(F.when(available, F.col("weight")).otherwise(0.0)).over(Window.partitionBy(subject, "model"))
    effective = F.when(available & (total > 0), F.col("weight") / total).otherwise(0.0)
    return rows.withColumn("effective", effective).select(
        subject, "model", "ord", "key", available.alias("available"), "raw", F.col("value").alias("normalized"), "weight", F.round("effective", 6).alias("effective_weight"), F.round(F.coalesce("value", F.lit(0.0)) * F.col("effective"), 4).alias("contribution"),
    )


def explained(parts: DataFrame) -> DataFrame:
    """parts with a sentence each: what a component measured, or that and why it was left out of the weights."""
    name = F.replace("key", F.lit("_"), F.lit(" "))
    why = F.concat(name, F.lit(" has no source in this corpus; its weight goes to the other components"))
    return parts.withColumn("explanation", F.when(F.col("available"), F.concat(name, F.lit(" measured from the theme's own evidence"))).otherwise(why))


def totals(parts: DataFrame, subject: str = "theme") -> DataFrame:
    """(subject, model, value, weight_coverage, unavailable). A model without an available component raises."""
    t = parts.groupBy(subject, "model").agg(
        F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.sum("contribution"))), 2).alias("value"),
        F.round(F.sum(F.when(F.col("available"), F.col("weight")).otherwise(0.0)), 4).alias("weight_coverage"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("available"), F.col("key")))), ",").alias("unavailable"),
    )
    return t.withColumn("value", F.when(F.col("weight_coverage") > 0, F.col("value")).otherwise(F.raise_error(F.lit("a score without coverage")).cast("double")))


def score(metrics: DataFrame, subject: str = "theme") -> tuple[DataFrame, DataFrame]:
    """(components, totals) of the three models; confidence comes first, since the trend model takes it."""
    values = resolve(metrics, subject)
    confidence = totals(components(values.filter("model = 'confidence'"), subject), subject)
    values = values.unionByName(confidence.select(subject, F.lit("trend").alias("model"), F.lit("confidence").alias("key"), "value"))
    parts = components(values, subject)
    return parts, totals(parts, subject)


def latest(rows: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), *ties)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def ranked(themes: DataFrame) -> DataFrame:
    """Themes by opportunity weighed by confidence, then by acceleration; nulls count as zero."""
    zero = F.lit(0.0)
    weighed = F.coalesce("opportunity", zero) * F.coalesce("confidence", zero) / 100
    return themes.withColumn("rank_score", F.round(weighed, 4)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round(weighed, 4)), F.desc(F.coalesce("acceleration", zero)), "theme")))
