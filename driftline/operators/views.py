"""Read views: point lookups, evidence with its provenance, scores, themes, newest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.scoring import latest

#: The fields of a provenance row, by the table that each comes from.
ITEM = ("claim", "excerpt", "confidence", "event_type", "direction", "subject_key", "rule_key", "extracted_by", "extractor_version", "data_mode", "event_at", "published_at", "retrieved_at", "cluster_id")
DOCUMENT = ("event_at_inferred", "document_id", "document_title", "document_url", "cluster_method")
SOURCE = ("source_key", "source_name", "publisher", "source_type", "source_class", "source_quality", "is_synthetic_source")


def lookup(rows: DataFrame, key: str, value, what: str = "row") -> DataFrame:
    """The rows whose natural key is value; none raises."""
    found = rows.filter(F.col(key) == value)
    if found.isEmpty():
        raise LookupError(f"no {what} with {key} {value!r}")
    return found


def provenance(items: DataFrame, documents: DataFrame, sources: DataFrame, clusters: DataFrame, subjects: list[str], limit: int = 200) -> DataFrame:
    """The newest items of the subjects, each with its whole chain: 29 fields.

    items: id and ITEM without cluster columns of other tables; documents: DOCUMENT and source_key; sources: SOURCE; clusters:
    cluster_id, origin_document_id, cluster_size. Items without a document or a source go before the limit counts; what is wide
    is joined after it. An item without a cluster stands for itself: size 1, no origin."""
    known = documents.join(sources.select("source_key"), "source_key", "left_semi").select("document_id")
    newest = items.filter(F.col("subject_key").isin(*subjects)).join(known, "document_id", "left_semi").orderBy(F.desc("event_at"), "id").limit(limit)
    wide = newest.join(documents, "document_id").join(sources, "source_key").join(clusters, "cluster_id", "left")
    origin = F.coalesce(F.col("origin_document_id") == F.col("document_id"), F.lit(False))
    return wide.select("id", *ITEM, *DOCUMENT, *SOURCE, origin.alias("is_cluster_origin"), F.coalesce("cluster_size", F.lit(1)).alias("cluster_size"))


def events_in_window(events: DataFrame, bridge: DataFrame, items: DataFrame, documents: DataFrame, sources: DataFrame, start: Column, end: Column) -> DataFrame:
    """Evidence of the events between start and end, both included, with its source: five tables by equality.

    events: dedupe_key, subject, cluster_id, occurred_at; bridge: dedupe_key, evidence_id; items: evidence_id, document_id;
    documents: document_id, source_key; sources: source_key, source_class, source_quality, is_primary."""
    e = events.filter(F.col("occurred_at").between(start, end)).select("dedupe_key", "subject", "cluster_id", "occurred_at")
    return e.join(bridge, "dedupe_key").join(items.select("evidence_id", "document_id"), "evidence_id").join(documents.select("document_id", "source_key"), "document_id").join(sources, "source_key")


def event_quality(bridge: DataFrame, items: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """(dedupe_key, quality, n_evidence): an event is as good as the best source of its evidence."""
    rows = bridge.join(items.select("evidence_id", "document_id"), "evidence_id").join(documents.select("document_id", "source_key"), "document_id").join(sources.select("source_key", "source_quality"), "source_key")
    return rows.groupBy("dedupe_key").agg(F.max("source_quality").alias("quality"), F.count(F.lit(1)).alias("n_evidence"))


def scores_by_key(parts: DataFrame, totals: DataFrame, subject: str = "theme") -> DataFrame:
    """Each score with its components in the order of their keys, as an array of structs."""
    fields = ("key", "available", "raw", "normalized", "weight", "effective_weight", "contribution", "explanation")
    nested = parts.groupBy(subject, "model").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("components"))
    return totals.join(nested, [subject, "model"]).withColumn("is_computable", F.col("weight_coverage") > 0)


def theme_detail(metrics: DataFrame, scores: DataFrame, trends: DataFrame, exposures: DataFrame) -> DataFrame:
    """A row a theme. scores: theme and a column a model; trends: theme, signal, acceleration; exposures: theme, company_key,
    exposure_score. Trends come by falling acceleration, companies by falling exposure."""
    t = trends.groupBy("theme").agg(F.array_sort(F.collect_list(F.struct((-F.col("acceleration")).alias("o"), "signal"))).alias("t"), F.max("acceleration").alias("top_acceleration"))
    e = exposures.groupBy("theme").agg(F.count(F.lit(1)).alias("companies"), F.max_by("company_key", F.struct("exposure_score", "company_key")).alias("top_company"))
    out = metrics.join(scores, "theme", "left").join(t, "theme", "left").join(e, "theme", "left")
    return out.withColumn("signals", F.transform("t", lambda x: x["signal"])).withColumn("companies", F.coalesce("companies", F.lit(0))).drop("t")


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as one JSON object, as the command line and the service give it."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("json"))


def newest(rows: DataFrame, theme: str, at: str, tie: str, what: str) -> DataFrame:
    """The newest row of a theme; none raises."""
    return latest(lookup(rows, "theme", theme, what), ["theme"], at, tie)


def trace(runs: DataFrame, questions: DataFrame, searches: DataFrame) -> DataFrame:
    """What ran: the newest run of each theme with its questions and searches counted, in the order that they ran."""
    last = runs.withColumn("rn", F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("started_at"), "run_id"))).filter("rn = 1").drop("rn")
    q = questions.groupBy("run_id").agg(F.count(F.lit(1)).alias("questions"))
    s = searches.groupBy("run_id").agg(F.count(F.lit(1)).alias("searches"), F.sum("new_documents").alias("new_documents"), F.max("executed_at").alias("last_search"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return last.join(q, "run_id", "left").join(s, "run_id", "left").select("theme", "run_id", "status", "started_at", zero("questions"), zero("searches"), zero("new_documents"), "last_search")
