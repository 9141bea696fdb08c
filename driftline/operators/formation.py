"""Themes from trends: formation, trend and exposure tables, finalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.kernels import activation_weight
from driftline.operators import signals as S
from driftline.operators.forest import components
from driftline.plans.definitions import GENERATED_NAME, SIGNALS, SUBJECT_ADJACENCY, SUBJECT_ANCHORS, THEME_TEMPLATES


def definitions(spark: SparkSession) -> DataFrame:
    """The signals, a row for each event type that one weighs."""
    return spark.createDataFrame(list(SIGNALS), "signal string, subject string, event_type string, weight double")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """stored with the rows of new in place of those with the same keys; of the columns in kept the stored value stays."""
    a, b = stored.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    fresh = F.col("b._new").isNotNull()
    b = new.withColumn("_new", F.lit(1)).alias("b")

    def value(c: str) -> Column:
        if c in keys or c in kept:
            return F.coalesce(f"a.{c}", f"b.{c}").alias(c)
        return F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)

    return a.join(b, on, "full").select(*[value(c) for c in stored.columns])


def form_themes(trends: DataFrame, adjacency=SUBJECT_ADJACENCY, templates=THEME_TEMPLATES, least: float = 20.0, sources: int = 2) -> DataFrame:
    """(slug, name, subjects, signals): a theme for each connected group of subjects with activated signals.

    trends: signal, subject, acceleration, observation_strength, independent_sources. The most specific template that fits
    names a theme, else its subjects do; signals come with their weights, by name."""
    spark = trends.sparkSession
    active = trends.filter((F.col("acceleration") >= least) & (F.col("independent_sources") >= sources)).withColumn("weight", activation_weight(F.col("acceleration"), F.col("observation_strength")))
    label = components(active.select(F.col("subject").alias("node")).distinct(), spark.createDataFrame(list(adjacency), "a string, b string"))
    members = active.join(label.withColumnRenamed("node", "subject"), "subject")
    sets = members.groupBy("component").agg(F.array_sort(F.collect_set("subject")).alias("subjects"), F.array_sort(F.collect_list(F.struct("signal", "weight"))).alias("signals"))
    t = spark.createDataFrame([(o, slug, name, list(sub)) for o, slug, name, sub in templates], "ord int, slug string, name string, need array<string>")
    # Templates are a list in the source; a theme meets all of them.
    fit = sets.crossJoin(F.broadcast(t)).filter(F.size(F.array_except("need", "subjects")) == 0)
    best = fit.groupBy("component").agg(F.max_by(F.struct("slug", "name"), F.struct(F.size("need"), -F.col("ord"))).alias("t"))
    plain = lambda to: F.transform("subjects", lambda s: F.replace(s, F.lit("_"), F.lit(to)))
    slug = F.concat(F.array_join(plain("-"), "-"), F.lit("-change"))
    name = F.concat(F.lit(GENERATED_NAME), F.array_join(F.transform(plain(" "), F.initcap), ", "))
    return sets.join(best, "component", "left").select(F.coalesce("t.slug", slug).alias("slug"), F.coalesce("t.name", name).alias("name"), "subjects", "signals")


def theme_anchors(themes: DataFrame, anchors=SUBJECT_ANCHORS) -> DataFrame:
    """(slug, entity_type, entity_key, weight): where a theme's walk through the graph begins; subjects without an anchor have none."""
    a = themes.sparkSession.createDataFrame(list(anchors), "subject string, entity_type string, entity_key string, weight double")
    return themes.select("slug", F.explode("subjects").alias("subject")).join(F.broadcast(a), "subject").select("slug", "entity_type", "entity_key", "weight")


def finalise(metrics: DataFrame, totals: DataFrame, exposures: DataFrame, theme: str = "theme") -> DataFrame:
    """Each theme with its stage, awareness, the mode of that estimate, its scores and how many companies it reaches.

    metrics: ``signals.theme_metrics`` and data_mode; exposures: theme, company_key. Awareness is told from coverage, not
    measured in a market: its mode is DEMO where the data are, else UNAVAILABLE."""
    c = F.col
    stage = S.maturity(c("independent_sources"), c("acceleration"), c("mainstream_share"), c("market_reaction"), c("contradiction_ratio"))
    mode = F.when(c("data_mode") == "DEMO", "DEMO").otherwise("UNAVAILABLE")
    reached = exposures.groupBy(theme).agg(F.count_distinct("company_key").alias("companies"))
    wide = totals.groupBy(theme).pivot("model", ["trend", "opportunity", "confidence"]).agg(F.first("value"))
    out = metrics.withColumns({"maturity": stage, "market_awareness": S.awareness(c("mainstream_share"), c("market_reaction")), "awareness_mode": mode})
    return out.join(wide, theme).join(reached, theme, "left").withColumn("companies", F.coalesce("companies", F.lit(0)))
