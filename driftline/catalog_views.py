"""More queries over the test tables: retrieval, provenance, themes from the built-in signals, read views, research runs.

As in ``catalog`` an event is a piece of evidence; here it is also dealt to the built-in event types and subjects, and stands in
document event_id mod 200.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline import catalog as C
from driftline.operators import ancestry, extract, formation, graph, research, scoring, signals, views
from driftline.operators.independence import profile, weakest_mode
from driftline.plans.definitions import PLAN_QUESTIONS
from driftline.plans.lineage import cut
from driftline.plans.vocab import SOURCE_CLASSES
from driftline.sources import readers

TYPES = ("DEMAND_ACCELERATION", "SUPPLY_CONSTRAINT", "PRICING_INCREASE", "CAPEX_INCREASE", "INVENTORY_DECLINE", "CAPACITY_EXPANSION", "DEMAND_WEAKNESS", "MARKET_REACTION", "CONTRACT_AWARD")
SUBJECTS = ("memory", "ai_infrastructure", "semiconductor_equipment")
RISE = "2024-01-24 00:00:00"
#: (query, text, terms, subject, limit)
SEARCHES = ((1, "the thing and whereas", ("ontion", "THE"), "en", 12), (2, "der und die", ("sch",), None, 5), (3, "zzz", (), "fr", 3))
PROVENANCE_LIMIT = 200


def _pick(items, i):
    return F.element_at(F.array(*[F.lit(x) for x in items]), (i + 1).cast("int"))


def market(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of the built-in types, stronger from RISE on."""
    e = C.evidence(spark, d)
    rising = F.when(F.col("t") >= F.lit(RISE).cast("timestamp"), 1.0).otherwise(0.2)
    return e.withColumns({
        "event_type": _pick(TYPES, F.floor(F.col("event_id") / 3) % len(TYPES)), "subject": _pick(SUBJECTS, F.col("event_id") % 3),
        "magnitude": F.round(F.col("magnitude") * rising, 6), "document_id": F.col("event_id") % 200,
    })


def sources(spark: SparkSession, d: str) -> DataFrame:
    """A row a source of the documents but for those whose number is a multiple of 5."""
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    s = C.read(spark, d, "documents").select("source").distinct().filter(n % 5 != 0)
    return s.select(
        F.col("source").alias("source_key"), F.concat(F.lit("Source "), n.cast("string")).alias("source_name"), F.concat(F.lit("House "), (n % 4).cast("string")).alias("publisher"), F.lit("NEWS").alias("source_type"),
        _pick(SOURCE_CLASSES, n % 9).alias("source_class"), (40 + 10 * (n % 7)).alias("source_quality"), (n % 2 == 1).alias("is_synthetic_source"),
    )


def papers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("document_id")
    return C.documents(spark, d).filter(i < 200).select(
        "document_id", F.col("source").alias("source_key"), F.substring("text", 1, 30).alias("document_title"), F.concat(F.lit("https://h.invalid/"), i.cast("string")).alias("document_url"), (i % 3 == 0).alias("event_at_inferred"),
        F.when(i % 2 == 0, "ORIGIN").otherwise("NEAR_DUPLICATE").alias("cluster_method"),
    )


def weights(spark: SparkSession) -> DataFrame:
    return formation.definitions(spark)


def trends(spark: SparkSession, d: str) -> DataFrame:
    subject = weights(spark).select("signal", "subject").distinct()
    return cut(signals.trends(market(spark, d), weights(spark), C.GRID).join(subject, "signal"))


def exposures(spark: SparkSession, d: str) -> DataFrame:
    return cut(graph.exposures(C.edges(spark, d), C.anchors(spark, d)))


def _q_search(s: SparkSession, d: str) -> DataFrame:
    docs = C.documents(s, d).select("doc_id", F.substring("text", 1, 40).alias("title"), "text", "published_at", F.col("event_at").alias("at"), F.array("lang").alias("subject_hints"))
    until = {1: "2024-01-01 12:00:00"}
    q = s.createDataFrame([(i, t, list(terms), sub, None, until.get(i), n) for i, t, terms, sub, n in SEARCHES], "query_id int, text string, terms array<string>, subject string, since string, until string, hits int")
    q = q.withColumns({c: F.col(c).cast("timestamp") for c in ("since", "until")})
    return extract.keyword_search(docs, q).select("query_id", "doc_id", "score", "rank", "truncated")


ENTITIES = (("ontion", "company:ontion"), ("rein", "company:rein"), ("the", "company:the"))


def _q_entities(s: SparkSession, d: str) -> DataFrame:
    """The first entity of the lexicon that a sentence with a claim names."""
    got = extract.extract(C.read(s, d, "documents"), C.rule_rows(C.DOC_RULES), C.DOC_SUBJECTS, list(ENTITIES), stability=C.DOC_STABLE, forward=C.DOC_FORWARD, dot_all=True)
    return got.filter("entity is not null").select("doc_id", "n", "entity").distinct()


def _q_lookup(s: SparkSession, d: str) -> DataFrame:
    return views.lookup(C.documents(s, d), "document_id", 7, "document").select("document_id", "source", "lang")


def _q_recent(s: SparkSession, d: str) -> DataFrame:
    return readers.recent(C.documents(s, d).withColumn("external_id", F.col("document_id")), 25).select("document_id", "source")


def _q_capability(s: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    docs = C.documents(s, d).withColumnRenamed("source", "source_key")
    known = C.documents(s, d).select(F.col("source").alias("key"), _pick(("NEWS", "SEC_FILING", "BLOG", "COMPANY_FILING", "REGULATORY_FILING"), n % 5).alias("source_type")).distinct()
    parts = [readers.by_capability(docs, known, filings).groupBy().agg(F.count(F.lit(1)).alias("n_documents"), F.sum("document_id").alias("ids")).select(F.lit("FILINGS" if filings else "NEWS_SEARCH").alias("capability"), "n_documents", "ids") for filings in (True, False)]
    return parts[0].unionByName(parts[1])


def _q_allowed(s: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    hosts = ("data.example.org", "m.ththth.example.net", "therha.example.com")
    return C.read(s, d, "pages").select("page_id", F.coalesce(readers.allowed(url, hosts), F.lit(False)).alias("allowed"))


def _q_filings_search(s: SparkSession, d: str) -> DataFrame:
    p = s.createDataFrame([("0000000042", C.FILING), ("0000000043", "{}"), ("0000000044", None), ("0000000045", "not json"), ("0000000046", C.FILING.replace("0000-24", "0001-24"))], "cik string, payload string")
    docs, answer = readers.search_filings(p, 3)
    return docs.crossJoin(answer).select("external_id", F.date_format("published_at", "yyyy-MM-dd").alias("published"), "found", "truncated", "failed")


def _q_provenance(s: SparkSession, d: str) -> DataFrame:
    m = market(s, d)
    items = m.select(
        F.col("evidence_id").alias("id"), "document_id", F.col("event_type").alias("claim"), F.concat_ws(" ", "event_type", "subject").alias("excerpt"), "confidence", "event_type", F.lit("POSITIVE").alias("direction"),
        F.col("subject").alias("subject_key"), F.lower("event_type").alias("rule_key"), F.lit("rules").alias("extracted_by"), F.lit("1").alias("extractor_version"), "data_mode", F.col("t").alias("event_at"),
        F.col("t").alias("published_at"), F.col("t").alias("retrieved_at"), F.when(F.col("k") % 4 != 0, F.col("cluster_id")).alias("cluster_id"),
    )
    clusters = m.groupBy("cluster_id").agg(F.min("document_id").alias("origin_document_id"), F.count(F.lit(1)).alias("cluster_size"))
    out = views.provenance(items, papers(s, d), sources(s, d), clusters, ["memory", "ai_infrastructure"], PROVENANCE_LIMIT)
    return out.withColumns({c: F.unix_micros(c) for c in ("event_at", "published_at", "retrieved_at")} | {"cluster_id": F.col("cluster_id").cast("string")})


def _events(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = market(s, d).withColumn("entity_hint", F.lit(None).cast("string"))
    return m, extract.build_events(m), extract.event_bridge(m)


def _q_bridge(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d)[2]


def _q_new_events(s: SparkSession, d: str) -> DataFrame:
    m, events, _ = _events(s, d)
    stored = events.filter("n_evidence = 1").select("dedupe_key")
    return extract.new_events(m, stored).select("dedupe_key", "n_evidence")


def _q_quality(s: SparkSession, d: str) -> DataFrame:
    m, _, bridge = _events(s, d)
    return views.event_quality(bridge, m, papers(s, d), sources(s, d))


def _q_window(s: SparkSession, d: str) -> DataFrame:
    m, events, bridge = _events(s, d)
    src = sources(s, d).withColumn("is_primary", F.col("source_class").isin(*C.PRIMARY_CLASSES))
    at = lambda x: F.lit(x).cast("timestamp")
    rows = views.events_in_window(events, bridge, m, papers(s, d), src, at("2024-01-10"), at("2024-01-24"))
    r = lambda c, n: F.round(c, n).alias(c)
    return profile(rows, ["subject"]).select("subject", "evidence_count", "independent_sources", r("source_diversity", 3), r("primary_ratio", 3), r("avg_quality", 3), r("amplification", 3))


def _q_nested(s: SparkSession, d: str) -> DataFrame:
    placed = signals.contributions(C.evidence(s, d), C.weights(s)).withColumn("bucket", C.GRID.bucket(F.col("t"))).filter("bucket between 0 and 27")
    one = lambda c: F.concat_ws(":", c["cluster_id"].cast("string"), F.round(c["signed"] * 10000).cast("long").cast("string"), c["event_id"].cast("string"), c["source_quality"].cast("string"), c["events"].cast("string"))
    return signals.nested_contributions(placed, ["signal", "bucket"]).select("signal", "bucket", F.size("contributions").cast("long").alias("n"), F.array_join(F.transform("contributions", one), " ").alias("contributions"))


def _q_defined(s: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 2).alias(c)
    return trends(s, d).select("signal", "subject", r("acceleration"), r("observation_strength"), "independent_sources", "direction")


def _q_trend_upsert(s: SparkSession, d: str) -> DataFrame:
    t = trends(s, d).select("signal", F.lit(C.GRID.as_of).alias("observation_end"), F.lit("1").alias("version"), F.round("acceleration", 2).alias("acceleration"), F.lit("new").alias("written"))
    old = s.createDataFrame([("memory_pricing", C.GRID.as_of, "1", 1.5, "old"), ("memory_pricing", "2024-01-30 00:00:00", "1", 2.5, "old"), ("gone", C.GRID.as_of, "1", 3.5, "old")], t.schema)
    return formation.upsert(old, t, ["signal", "observation_end", "version"])


def themes(s: SparkSession, d: str) -> DataFrame:
    return formation.form_themes(trends(s, d))


def _q_formation(s: SparkSession, d: str) -> DataFrame:
    t = themes(s, d)
    said = F.transform("signals", lambda x: F.concat_ws(":", x["signal"], F.round(x["weight"] * 1000).cast("long").cast("string")))
    return t.select("slug", "name", F.array_join("subjects", ",").alias("subjects"), F.array_join(said, " ").alias("signals"))


def _q_generated(s: SparkSession, d: str) -> DataFrame:
    rows = [("a", "semiconductor_equipment", 30.0, 50.0, 3), ("b", "logistics", 40.0, 20.0, 2), ("c", "logistics", 19.9, 20.0, 9), ("d", "memory", 90.0, 20.0, 1)]
    t = s.createDataFrame(rows, "signal string, subject string, acceleration double, observation_strength double, independent_sources int")
    return formation.form_themes(t).select("slug", "name", F.array_join(F.transform("signals", lambda x: x["signal"]), ",").alias("signals"))


def _q_anchors(s: SparkSession, d: str) -> DataFrame:
    return formation.theme_anchors(themes(s, d))


def _theme_modes(s: SparkSession, d: str) -> DataFrame:
    e = C.evidence(s, d).withColumn("age", C.GRID.age(F.col("t"))).filter(F.col("age").between(0, 7 * 86_400_000_000))
    subject = s.createDataFrame([(t, sub) for t, _, sub in C.THEMES], "theme string, subject string").distinct()
    return e.join(subject, "subject").groupBy("theme").agg(weakest_mode(F.col("data_mode")).alias("data_mode"))


def _theme_exposures(s: SparkSession, d: str) -> DataFrame:
    """Both themes' companies: growth has all, operations the first order only."""
    e = exposures(s, d)
    return e.withColumn("theme", F.lit("growth")).unionByName(e.filter("order_of_effect = 1").withColumn("theme", F.lit("operations")))


def _finalised(s: SparkSession, d: str, scores: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    m, _, totals = scores or C.scored(s, d)
    return formation.finalise(m.join(_theme_modes(s, d), "theme"), totals, _theme_exposures(s, d))


def _q_finalised(s: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 1).alias(c)
    return _finalised(s, d).select("theme", "maturity", "market_awareness", "awareness_mode", r("trend"), r("opportunity"), r("confidence"), "companies")


def _q_explained(s: SparkSession, d: str) -> DataFrame:
    return scoring.explained(C.scored(s, d)[1]).select("theme", "model", "key", F.round("raw", 1).alias("raw"), F.round("normalized", 1).alias("normalized"), "available", "explanation")


def _q_score_view(s: SparkSession, d: str) -> DataFrame:
    _, parts, totals = C.scored(s, d)
    v = views.scores_by_key(scoring.explained(parts), totals)
    said = F.transform("components", lambda c: F.concat_ws("=", c["key"], F.round(c["contribution"]).cast("long").cast("string")))
    return v.select("theme", "model", "is_computable", F.size("components").cast("long").alias("n"), F.array_join(said, ";").alias("components"))


def _q_detail(s: SparkSession, d: str) -> DataFrame:
    t = C.activations(s, d)
    m, _, totals = C.scored(s, d, t)
    scores = totals.groupBy("theme").pivot("model", ["trend", "confidence"]).agg(F.first("value"))
    v = views.theme_detail(m.drop("acceleration"), scores, t.select("theme", "signal", "acceleration"), _theme_exposures(s, d).select("theme", "company_key", "exposure_score"))
    return v.select("theme", "evidence_count", "independent_sources", F.round("amplification", 4).alias("amplification"), F.round("contradiction_ratio", 4).alias("contradiction_ratio"), F.round("trend", 1).alias("trend"), F.round("top_acceleration", 2).alias("top_acceleration"), F.array_join("signals", ",").alias("signals"), "companies", "top_company")


def _q_trace(s: SparkSession, d: str) -> DataFrame:
    """Views are runs of their subject's theme; clicks and errors of the same user are searches and questions of that run."""
    e = C.evidence(s, d)
    runs = e.filter("event_type = 'view'").select(F.col("subject").alias("theme"), F.col("event_id").alias("run_id"), F.lit("SUCCEEDED").alias("status"), F.col("t").alias("started_at"), "cluster_id")
    of = runs.select("cluster_id", "run_id")
    searches = e.filter("event_type = 'click'").join(of, "cluster_id").select("run_id", (F.col("k") % 3).alias("new_documents"), F.col("t").alias("executed_at"))
    questions = e.filter("event_type = 'error'").join(of, "cluster_id").select("run_id")
    return views.trace(runs.drop("cluster_id"), questions, searches).withColumns({c: F.unix_micros(c) for c in ("started_at", "last_search")})


def _q_hypotheses(s: SparkSession, d: str) -> DataFrame:
    t = C.read(s, d, "region").select(F.lower("r_name").alias("theme"), F.initcap("r_name").alias("name"))
    stored = s.createDataFrame([("asia", "Open one", "OPEN"), ("europe", "Closed one", "CLOSED")], "theme string, statement string, status string")
    return research.ensure_hypotheses(t, stored, [("africa", "Stated by a template")]).select("theme", "statement", "status", "created")


def _q_plan_input(s: SparkSession, d: str) -> DataFrame:
    t = s.createDataFrame([("growth", "Growth"), ("operations", "Operations")], "theme string, name string")
    companies = C.read(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("company_key"), F.col("s_name").alias("company_name"))
    p = research.plan_input(t, C.activations(s, d), _theme_exposures(s, d), companies)
    sig = F.transform("signals", lambda x: F.concat_ws(":", x["signal"], F.round(x["acceleration"]).cast("long").cast("string"), x["independent_sources"].cast("string")))
    return p.select("theme", "name", F.array_join(sig, " ").alias("signals"), F.size("companies").cast("long").alias("n_companies"), F.get("companies", F.lit(0))["company_name"].alias("first_company"))


def _plan(s: SparkSession) -> DataFrame:
    t = s.createDataFrame([("ai-memory-demand", "memory", "Maker (MKR), Toolco")], "theme string, primary_subject string, companies string")
    sig = s.createDataFrame([("ai-memory-demand", "memory_demand", 42.0, 6), ("ai-memory-demand", "memory_supply", 25.4, 4)], "theme string, signal string, acceleration double, independent_sources int")
    return research.plan(t, sig)


def _q_first_questions(s: SparkSession, d: str) -> DataFrame:
    return research.first_questions(_plan(s)).select("dimension", "question", "priority", "n_questions")


def _q_plan_summary(s: SparkSession, d: str) -> DataFrame:
    return research.plan_summary(_plan(s)).select("theme", "questions", "counter_evidence", F.array_join("dimensions", ",").alias("dimensions"))


def _q_exposure_finding(s: SparkSession, d: str) -> DataFrame:
    return research.exposure_finding(_theme_exposures(s, d)).select("theme", "claim", F.round("confidence", 3).alias("confidence"), "independent_sources", "stance", "claim_type")


def _q_finding_evidence(s: SparkSession, d: str) -> DataFrame:
    e = C.evidence(s, d).withColumn("event_type", F.when(F.col("k") < 10, None).otherwise(F.col("event_type")))
    return research.finding_evidence(e, C.BRIDGE)


def _q_searches(s: SparkSession, d: str) -> DataFrame:
    docs = C.documents(s, d).select("doc_id", F.substring("text", 1, 40).alias("title"), "text", "published_at", F.col("event_at").alias("at"), F.array("lang").alias("subject_hints"))
    words = ("the and", "der|und", "que|les", "zzz", "thing whereas", "ontion|and", "yyy", "los|del")
    q = s.createDataFrame([(dim, p, f"q{o}", words[o % len(words)]) for o, dim, p, *_ in PLAN_QUESTIONS], "dimension string, priority int, question string, terms string")
    return research.run_searches(q, docs, hits=10)[0].select("n", "dimension", "result_count", "new_count")


def _q_rationale(s: SparkSession, d: str) -> DataFrame:
    hop = lambda h: F.concat_ws("/", h["from_key"], h["relationship"], h["direction"], h["to_key"], F.round(h["weight"] * 10000).cast("long").cast("string"))
    return exposures(s, d).select("company_key", "rationale", F.array_join(F.transform("hops", hop), " ").alias("hops"))


def _q_rebuild(s: SparkSession, d: str) -> DataFrame:
    docs = C.documents(s, d)
    mode = _pick(("LIVE", "HISTORICAL", "DEMO", "UNAVAILABLE"), F.col("doc_id") % 4)
    a = cut(ancestry.assign(docs))
    stored = a.select("cluster_key").distinct().filter("pmod(cast(substring(cluster_key, 9) as int), 3) = 0")
    out = ancestry.rebuild(docs.withColumn("data_mode", mode), stored, a)
    return out.select("cluster_key", "label", "members", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"), "data_mode", "origin_document_id", "created")


def _q_restamp(s: SparkSession, d: str) -> DataFrame:
    e = market(s, d).select("evidence_id", "document_id", F.lit("old").alias("cluster_key"))
    return ancestry.restamp(e, ancestry.assign(C.documents(s, d))).select("evidence_id", "cluster_key", "cluster_method")


def _q_merged(s: SparkSession, d: str) -> DataFrame:
    o = C.read(s, d, "orders").select("o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", 1).alias("documents_created"), F.lit(1).alias("documents_seen"))
    return readers.merged(o, "o_orderstatus")


def _registry(s: SparkSession) -> readers.Registry:
    none = lambda: s.createDataFrame([], readers.NO_ROWS)
    adapters = {"corpus": (none, "DEMO", "a synthetic corpus", False)}
    return readers.Registry(s, adapters, {"NEWS_SEARCH": "corpus", "FILINGS": "elsewhere"})


def _q_health(s: SparkSession, d: str) -> DataFrame:
    return _registry(s).health()


def _q_snapshot(s: SparkSession, d: str) -> DataFrame:
    return readers.market_snapshot(s, ["s1", "s2"]).select("company_key", "price", "data_mode", "detail")


def _q_seed(s: SparkSession, d: str) -> DataFrame:
    ind = C.read(s, d, "region").select(F.col("r_name").alias("key"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit("DEMO").alias("data_mode"))
    sub = C.read(s, d, "nation").join(C.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("n_name").alias("name"), F.col("r_name").alias("parent"), F.lit("DEMO").alias("data_mode"))
    comp = C.read(s, d, "supplier").select(F.col("s_name").alias("key"), F.col("s_name").alias("name"), F.lit("x").alias("industry_key"), F.lit(True).alias("is_fictional"), F.lit("DEMO").alias("data_mode"))
    rel = s.createDataFrame([("COMPANY", "a", "SUPPLIES", "COMPANY", "b", "DEMO"), ("COMPANY", "a", "SUPPLIES", "COMPANY", "b", "DEMO")], "source_type string, source_key string, relationship string, target_type string, target_key string, data_mode string")
    stored = {"industries": ind.filter("key < 'B'"), "companies": comp.filter("key < 'Supplier#00005'"), "relationships": rel.limit(0)}
    out = readers.seed(ind.unionByName(sub), comp, rel, stored)
    return readers.row_counts(out)


def lines(s: SparkSession, d: str) -> DataFrame:
    names = s.createDataFrame([("growth",), ("operations",)], "theme string")
    found = C._finding_rows(s, d).crossJoin(names.filter("theme = 'growth'"))  # one row
    links = _q_finding_evidence(s, d).withColumn("theme", F.lit("growth"))
    active = cut(C.activations(s, d))
    scores = C.scored(s, d, active)
    done, totals = cut(_finalised(s, d, scores)), cut(scores[2])
    return research.report_lines(active, cut(found), cut(links), cut(_theme_exposures(s, d)), done.select("theme", "maturity", "market_awareness", "awareness_mode"), totals)


def _q_report(s: SparkSession, d: str) -> DataFrame:
    """The lines of all sections but those that repeat other queries' texts with their decimals."""
    return lines(s, d).filter("section in ('what_changed', 'why_it_matters', 'why_now', 'supporting_evidence', 'contradictory_evidence', 'contextual_findings', 'research_gaps', 'market_awareness', 'invalidation_conditions', 'provenance')")


def _q_report_sections(s: SparkSession, d: str) -> DataFrame:
    return lines(s, d).groupBy("theme", "section").agg(F.count(F.lit(1)).alias("n_lines"))


def queries() -> dict[str, C.Query]:
    return {
        "keyword_search": _q_search,
        "claim_entities": _q_entities,
        "document_lookup": _q_lookup,
        "recent_documents": _q_recent,
        "capability_split": _q_capability,
        "allowed_urls": _q_allowed,
        "filings_search_inline": _q_filings_search,
        "evidence_provenance": _q_provenance,
        "event_bridge": _q_bridge,
        "event_build_new": _q_new_events,
        "event_quality": _q_quality,
        "theme_window_profile": _q_window,
        "signal_bucket_contributions": _q_nested,
        "builtin_signal_trends": _q_defined,
        "trend_upsert": _q_trend_upsert,
        "theme_formation": _q_formation,
        "theme_generated_names": _q_generated,
        "theme_anchors": _q_anchors,
        "theme_finalised": _q_finalised,
        "score_explained": _q_explained,
        "score_view": _q_score_view,
        "theme_detail": _q_detail,
        "research_trace": _q_trace,
        "research_hypotheses": _q_hypotheses,
        "plan_input": _q_plan_input,
        "plan_first_questions": _q_first_questions,
        "plan_summary": _q_plan_summary,
        "exposure_finding": _q_exposure_finding,
        "finding_evidence": _q_finding_evidence,
        "research_searches": _q_searches,
        "exposure_rationale": _q_rationale,
        "cluster_rebuild": _q_rebuild,
        "evidence_restamped": _q_restamp,
        "ingest_totals": _q_merged,
        "provider_health": _q_health,
        "market_snapshot": _q_snapshot,
        "seed_reference": _q_seed,
        "report_lines": _q_report,
        "report_sections": _q_report_sections,
    }
