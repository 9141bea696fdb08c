"""Queries over the test tables, each with an independent SQL form.

The tables stand in for evidence: an event row is one piece of evidence, its user the cluster, class and quality follow
from the user, magnitude from its value and confidence from its properties. Documents are a minute apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import kernels as K
from driftline.functions import text as X
from driftline.operators import ancestry, extract, graph, research, scoring, signals, validate
from driftline.operators.forest import components
from driftline.operators.independence import profile, representatives, weakest_mode
from driftline.plans.lineage import cut, spread
from driftline.plans.definitions import SUBJECT_ADJACENCY, THEME_TEMPLATES, rule_rows
from driftline.plans.vocab import PRIMARY_CLASSES, SOURCE_CLASSES
from driftline.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
GRID = signals.Grid("2024-01-31 00:00:00", bucket_days=1, history_days=28, observation_days=7, baseline_days=21, saturation=50.0)
SUBJECTS = ("alpha", "beta", "gamma")
#: (signal, subject, event type, weight)
WEIGHTS = (
    ("engagement", "alpha", "click", 1.0),
    ("engagement", "alpha", "view", 0.5),
    ("engagement", "alpha", "error", -1.0),
    ("conversion", "beta", "purchase", 1.0),
    ("conversion", "beta", "signup", 0.6),
    ("conversion", "beta", "error", -0.8),
    ("reliability", "gamma", "error", 1.0),
)
THEMES = (("growth", "engagement", "alpha"), ("growth", "conversion", "beta"), ("operations", "reliability", "gamma"))
BRIDGE = (("DEMAND", "click"), ("DEMAND", "purchase"), ("SUPPLY", "error"), ("SUPPLY", "signup"), ("PRICING", "purchase"), ("RISKS", "error"), ("CONTRADICTORY_EVIDENCE", "error"), ("MARKET_EXPECTATIONS", "view"))
SUPPORTS = ("click", "purchase", "signup")
#: Rules over words that the documents hold, for the extraction query; the two guards likewise.
DOC_RULES = (
    ("SUPPLY", r"(^| )the .{0,30} of ", 0.9, 0.8, "The of"),
    ("SUPPLY", r"(^| )han", 0.5, 0.6, "Han"),
    ("DEMAND", r"(^| )(der|die|das) .{0,40} (und|ist) ", 0.7, 0.75, "Der und"),
    ("DEMAND", r"(^| )que ", 0.6, 0.7, "Que"),
    ("PRICING", r"(^| )(la|le|les) .{0,25} (de|des) ", 0.65, 0.85, "La de"),
    ("CAPEX", r"(^| )and ", 0.4, 0.5, "And"),
)
DOC_STABLE, DOC_FORWARD = (r"(^| )was ",), (r"(^| )that ", r"(^| )sur ")
DOC_SUBJECTS = (("english", ("the ", "and ")), ("german", ("der ", "und ", "die ")), ("french", ("les ", "que ")))
CORPUS = (
    (1, "Suppliers cannot currently meet demand for memory. Contract pricing rose and inventories declined. We expect pricing to fall."),
    (2, "Demand is accelerating and capacity is fully committed for HBM modules! Prices remained steady. Lead times extended for lithography equipment."),
    (3, "Orders grew. Shipments increased? Capital expenditure will increase at hyperscale operators; shares rose on the news."),
    (4, "Weak demand was seen. It could be that demand weakened historically. Inventory build continued: inventories increased."),
    (5, "Nothing to report."),
    (6, ""),
    (7, "DRAM supply is a constraint, orders rose, pricing improved, capacity expansion was announced and a supply agreement signed."),
)
_WORDS = [f"w{i}" for i in range(44)]
#: The fourth text is as near to the second as to the third, which belongs to the cluster that the first founded.
TIED = (
    (1, " ".join([*_WORDS[:35], "z", *[f"y{i}" for i in range(8)]])),
    (2, " ".join([*[f"x{i}" for i in range(8)], *_WORDS[8:]])),
    (3, " ".join([*_WORDS[:36], *[f"y{i}" for i in range(8)]])),
    (4, " ".join(_WORDS)),
)
ODD_TEXTS = (
    (1, "ﬁrst ﬂoor № ½ cup, ＦＵＬＬ ｗｉｄｔｈ １２"),
    (2, "Cafe\u0301 cafe\u0301 CAFÉ x² y₂ ™ ① ⑩ ª º K Å ﷺ"),
    (3, "İstanbul ĳ ǆ ㎏ 𝐁𝐨𝐥𝐝 𝟙𝟚 Ⅷ"),
    (4, "  plain  ASCII,\ttext\nwith lines  "),
    (5, ""),
    (6, "¿¡…"),
)
QUERY_TEXT = "the ontion thing whereas edible reeaux ontion stead"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name == "documents" else df


def evidence(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda items, i: F.element_at(F.array(*[F.lit(x) for x in items]), (i + 1).cast("int"))
    cls = pick(SOURCE_CLASSES, F.col("user_id") % 9)
    return e.select(
        "event_id", F.col("event_id").alias("evidence_id"), F.col("user_id").alias("cluster_id"), "event_type", pick(SUBJECTS, F.col("event_id") % 3).alias("subject"), F.col("ts").cast("timestamp").alias("t"),
        F.round(F.least(F.lit(1.0), F.col("value") / 100), 6).alias("magnitude"), F.round(0.5 + (k % 50) / 100, 6).alias("confidence"), cls.alias("source_class"),
        (40 + 10 * (F.col("user_id") % 7)).cast("int").alias("source_quality"), cls.isin(*PRIMARY_CLASSES).alias("is_primary"), pick(("LIVE", "HISTORICAL", "DEMO", "UNAVAILABLE"), k % 4).alias("data_mode"), k.alias("k"),
    )


def documents(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    at = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)")
    return read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "doc_id", "text", "source", "lang", at.alias("event_at"), at.alias("published_at"), (40 + 10 * (n % 7)).alias("source_quality"), F.lit(None).cast("string").alias("origin_ref"))


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS), "signal string, subject string, event_type string, weight double")


def trend(spark: SparkSession, d: str) -> DataFrame:
    return cut(signals.trends(evidence(spark, d), weights(spark), GRID))  # a row a signal, used several times


def activations(spark: SparkSession, d: str) -> DataFrame:
    themes = spark.createDataFrame(list(THEMES), "theme string, signal string, subject string")
    t = signals.activated(trend(spark, d), least=-100.0)
    return t.join(F.broadcast(themes), "signal")


def metrics(spark: SparkSession, d: str, active: DataFrame | None = None) -> DataFrame:
    return signals.theme_metrics(evidence(spark, d), activations(spark, d) if active is None else active, weights(spark), GRID, "view")


def scored(spark: SparkSession, d: str, active: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics, components, totals). The metrics, a row a theme, are used several times and computed once."""
    m = cut(metrics(spark, d, active))
    return m, *scoring.score(m.withColumn("exposure_top", F.lit(50.0)))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Regions drive demand for nations; suppliers produce for their nation; customers buy from the supplier of most revenue."""
    unit = lambda c: F.round(c, 4)
    nation, region, supplier = (read(spark, d, t) for t in ("nation", "region", "supplier"))
    per = nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("k"))
    r = nation.join(per, "n_regionkey").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lit("INDUSTRY").alias("source_type"), F.col("r_name").alias("source_key"), F.lit("DRIVES_DEMAND_FOR").alias("relationship"), F.lit("TECHNOLOGY").alias("target_type"), F.col("n_name").alias("target_key"),
        unit(0.5 + 0.5 / F.col("k")).alias("weight"), F.lit(0.9).alias("confidence"))
    s = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lit("COMPANY").alias("source_type"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_key"), F.lit("PRODUCES").alias("relationship"), F.lit("TECHNOLOGY").alias("target_type"), F.col("n_name").alias("target_key"),
        unit(0.5 + (F.col("s_suppkey") % 50) / 100).alias("weight"), F.lit(0.8).alias("confidence"))
    items = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    spent = items.groupBy("o_custkey", "l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice")), 2).alias("spent"))
    top = spent.groupBy("o_custkey").agg(F.max_by(F.struct("l_suppkey", "spent"), F.struct("spent", -F.col("l_suppkey"))).alias("b"), F.round(F.sum("spent"), 2).alias("total"))
    c = top.select(
        F.lit("COMPANY").alias("source_type"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_key"), F.lit("BUYS_FROM").alias("relationship"), F.lit("COMPANY").alias("target_type"),
        F.concat(F.lit("s"), F.col("b.l_suppkey").cast("string")).alias("target_key"), unit(F.col("b.spent") / F.col("total")).alias("weight"), F.lit(0.7).alias("confidence"))
    return r.unionByName(s).unionByName(c).withColumn("data_mode", F.lit("HISTORICAL"))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "region").filter("r_regionkey < 2").select(F.lit("INDUSTRY").alias("entity_type"), F.col("r_name").alias("entity_key"), F.round(1.0 - 0.1 * F.col("r_regionkey"), 4).alias("weight"))


def _claims(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n", "rule_key", "event_type", "direction", "magnitude", "confidence", "claim", "subject", "is_forward_looking")


def _q_claims_inline(s: SparkSession, d: str) -> DataFrame:
    return _claims(extract.extract(s.createDataFrame(list(CORPUS), "doc_id long, text string")))


def _q_claims_documents(s: SparkSession, d: str) -> DataFrame:
    return _claims(extract.extract(read(s, d, "documents"), rule_rows(DOC_RULES), DOC_SUBJECTS, stability=DOC_STABLE, forward=DOC_FORWARD, dot_all=True))


def _q_events(s: SparkSession, d: str) -> DataFrame:
    hint = F.when(F.col("k") % 10 == 0, F.concat(F.lit("co"), (F.col("k") % 7).cast("string")))
    e = evidence(s, d).withColumn("entity_hint", hint)
    return extract.build_events(e).select("dedupe_key", "n_evidence", "magnitude", "confidence", "entity_type", "entity_key", F.unix_micros("occurred_at").alias("occurred_us"), "data_mode")


def _q_provenance(s: SparkSession, d: str) -> DataFrame:
    """Events joined to their documents and sources; a source that is not listed has the default quality."""
    docs = documents(s, d).select("doc_id", "source")
    src = s.createDataFrame([(f"src{i}", SOURCE_CLASSES[i % 9], 40 + 10 * (i % 7)) for i in range(0, 20) if i % 5], "source string, source_class string, quality int")
    e = evidence(s, d).select("event_id", "event_type", "cluster_id", (F.col("event_id") % 200).alias("doc_id"))
    size = e.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size")).filter("cluster_size > 60")
    j = e.join(docs, "doc_id").join(F.broadcast(src), "source", "left").join(size, "cluster_id", "left")
    return j.select("event_id", "event_type", "doc_id", "source", F.coalesce("source_class", F.lit("COMMUNITY")).alias("source_class"), F.coalesce("quality", F.lit(50)).alias("quality"), F.coalesce("cluster_size", F.lit(1)).alias("cluster_size"))


def _q_topk(s: SparkSession, d: str) -> DataFrame:
    q = s.createDataFrame([(0, QUERY_TEXT)], "query_id int, text string")
    docs = documents(s, d).select("doc_id", "text", F.col("event_at").alias("at"))
    return extract.search(docs, q, 20).select("doc_id", "score", "rank")


def _q_benchmark_overlap(s: SparkSession, d: str) -> DataFrame:
    q = read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = documents(s, d).select("doc_id", "text", F.col("event_at").alias("at"))
    return extract.search(docs, q, 1).select(F.col("query_id").alias("item_id"), "doc_id", "score")


def _q_series(s: SparkSession, d: str) -> DataFrame:
    return signals.series(evidence(s, d), weights(s), GRID).select("signal", "bucket", F.round("net", 4).alias("net"), "event_count", "independent_sources", F.round("strength", 3).alias("strength"), "direction")


def _q_confidence(s: SparkSession, d: str) -> DataFrame:
    return signals.series(evidence(s, d), weights(s), GRID).select("signal", "bucket", F.round("source_diversity", 4).alias("source_diversity"), F.round("primary_ratio", 4).alias("primary_ratio"), F.round("avg_quality", 3).alias("avg_quality"), F.round("confidence", 2).alias("confidence"))


def _q_gate(s: SparkSession, d: str) -> DataFrame:
    t = trend(s, d)
    passed = (F.col("acceleration") >= 0) & (F.col("independent_sources") >= 2)
    return t.select("signal", "independent_sources", passed.alias("passes"), F.round(K.activation_weight(F.col("acceleration"), F.col("observation_strength")), 4).alias("weight"))


def _q_components(s: SparkSession, d: str) -> DataFrame:
    """Components of the activated subjects and the template that names each."""
    active = s.createDataFrame([("memory",), ("semiconductor_equipment",), ("logistics",)], "node string")
    c = components(active, s.createDataFrame(list(SUBJECT_ADJACENCY), "a string, b string"))
    sets = c.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("subjects"))
    t = s.createDataFrame([(o, slug, name, list(sub)) for o, slug, name, sub in THEME_TEMPLATES], "ord int, slug string, name string, need array<string>")
    fit = sets.crossJoin(F.broadcast(t)).filter(F.size(F.array_except("need", "subjects")) == 0)
    best = fit.groupBy("component").agg(F.max_by("slug", F.struct(F.size("need"), -F.col("ord"))).alias("slug"))
    return sets.join(best, "component", "left").select("component", F.array_join("subjects", ",").alias("subjects"), F.coalesce("slug", F.concat_ws("-", F.lit("theme"), F.array_join("subjects", "-"))).alias("slug"))


def _q_metrics(s: SparkSession, d: str) -> DataFrame:
    r = lambda c, n: F.round(c, n).alias(c)
    return metrics(s, d).select("theme", r("strength", 2), r("acceleration", 2), r("frequency_change", 2), "supporting", "contradicting", "market_reaction", "independent_sources", "evidence_count", r("source_diversity", 4), r("mainstream_share", 4), r("contradiction_ratio", 4), r("novelty", 2))


def _q_maturity(s: SparkSession, d: str) -> DataFrame:
    """Stage and awareness of segments of ten clusters."""
    e = evidence(s, d).withColumn("segment", F.floor(F.col("cluster_id") / 10).cast("long"))
    p = profile(e, ["segment"])
    x = e.groupBy("segment").agg(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("err"), F.max(F.col("event_type") == "purchase").alias("reaction"), F.round(F.avg("magnitude") * 100 - 30, 4).alias("acc"))
    j = p.join(x, "segment").withColumn("sources", F.col("independent_sources") - F.col("segment") % 10)
    contra = F.round(F.col("err") * (F.col("segment") % 4), 4)
    share = F.round(F.col("mainstream_share") * (1 + F.col("segment") % 6), 4)
    react = F.col("reaction") & (F.col("segment") % 2 == 0)
    return j.select("segment", "sources", signals.maturity(F.col("sources"), F.col("acc"), share, react, contra).alias("maturity"), signals.awareness(share, react).alias("awareness"))


def _q_score_components(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d)[1].select("theme", "model", "key", "available", F.round("normalized", 1).alias("normalized"), "effective_weight", F.round("contribution", 1).alias("contribution"))


def _q_score_totals(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d)[2].select("theme", "model", F.round("value", 1).alias("value"), "weight_coverage", "unavailable")


def _wide_scores(s: SparkSession, d: str) -> DataFrame:
    """The metrics of each theme beside its three scores."""
    m, _, totals = scored(s, d)
    t = totals.groupBy("theme").pivot("model", ["trend", "opportunity", "confidence"]).agg(F.first("value"))
    return t.join(m, "theme")


def _q_ranking(s: SparkSession, d: str) -> DataFrame:
    return scoring.ranked(_wide_scores(s, d)).select("theme", "rank", F.round("rank_score", 1).alias("rank_score"))


def _q_underappreciated(s: SparkSession, d: str) -> DataFrame:
    stage = signals.maturity(F.col("independent_sources"), F.col("acceleration"), F.col("mainstream_share"), F.col("market_reaction"), F.col("contradiction_ratio"))
    staged = _wide_scores(s, d).withColumn("maturity", stage)
    early = F.col("maturity").isin("INVALIDATED", "INVISIBLE", "EMERGING", "DEVELOPING", "ACCELERATING")
    return staged.filter(early & (F.col("confidence") >= 50)).select("theme", "maturity", F.round("confidence", 1).alias("confidence"))


def _finding_rows(s: SparkSession, d: str) -> DataFrame:
    e = evidence(s, d).withColumn("event_type", F.when(F.col("k") < 10, None).otherwise(F.col("event_type")))
    return research.findings(e, BRIDGE, SUPPORTS)


def _q_findings(s: SparkSession, d: str) -> DataFrame:
    return _finding_rows(s, d).select("dimension", "stance", "claim_type", F.round("confidence", 3).alias("confidence"), "independent_sources", "claim")


def _q_plan(s: SparkSession, d: str) -> DataFrame:
    t = s.createDataFrame([("ai-memory-demand", "memory", "Maker (MKR), Toolco")], "theme string, primary_subject string, companies string")
    sig = s.createDataFrame([("ai-memory-demand", "memory_demand", 42.0, 6), ("ai-memory-demand", "memory_pricing", 12.0, 3), ("ai-memory-demand", "memory_supply", 25.4, 4)], "theme string, signal string, acceleration double, independent_sources int")
    full = research.plan(t, sig)
    some = full.filter("dimension in ('DEMAND', 'CAPACITY') or ord > 11")
    return research.enforce_coverage(some, full.filter("ord < 12")).select("dimension", "priority", "seeks_counter_evidence", "question", "terms")


FILING = (
    '{"name":"Acme Corp","filings":{"recent":{"form":["8-K","4","10-Q","10-K"],"accessionNumber":["0000-24-1","0000-24-2","0000-24-3","0000-24-4"],'
    '"filingDate":["2024-02-01","2024-02-02","2024-03-05","bad"],"reportDate":["2024-01-31","","2024-02-29"],"primaryDocument":["a.htm","b.htm","c.htm"],"primaryDocDescription":["Report","Own"]}}}'
)


def _q_filings(s: SparkSession, d: str) -> DataFrame:
    p = s.createDataFrame([("0000000042", FILING), ("0000000043", "{}")], "cik string, payload string")
    return readers.parse_filings(p).select("external_id", "url", "title", "body_text", F.date_format("published_at", "yyyy-MM-dd").alias("published"), F.date_format("event_at", "yyyy-MM-dd").alias("event"), "form")


def _q_upsert(s: SparkSession, d: str) -> DataFrame:
    have = documents(s, d).groupBy(F.col("source").alias("key")).agg(F.min("source_quality").alias("base_quality")).select("key", F.concat(F.lit("Source "), "key").alias("name"), F.lit("news").alias("source_type"), "base_quality", F.lit(None).cast("string").alias("notes"))
    new = s.createDataFrame([("src1", "Renamed", "filing", 99, "seen"), ("src77", "Fresh", "filing", 10, None)], "key string, name string, source_type string, base_quality int, notes string")
    return readers.upsert_sources(have, new)


def _q_violations(s: SparkSession, d: str) -> DataFrame:
    e = evidence(s, d)
    line, orders, cust, nat = (read(s, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    return validate.all_of(
        validate.violations(e, "evidence", {"magnitude": validate.between("magnitude", 0, 0.5), "quality": validate.between("source_quality", 0, 100), "demo": validate.implies(F.col("data_mode") == "DEMO", F.col("event_type") != "error")}),
        validate.duplicates(line, "lineitem", ["l_orderkey", "l_linenumber"]),
        validate.duplicates(e, "evidence", ["cluster_id"]),
        validate.orphans(orders, "orders", "o_custkey", cust, "c_custkey"),
        validate.orphans(line, "lineitem", "l_suppkey", nat, "n_nationkey"),
    )


def _q_counts(s: SparkSession, d: str) -> DataFrame:
    return readers.row_counts({t: read(s, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")})


def _q_latest(s: SparkSession, d: str) -> DataFrame:
    """The newest event of each type and cluster, as the newest score of each model and subject would be found."""
    e = evidence(s, d).select("cluster_id", "event_type", "event_id", "t", "magnitude")
    return scoring.latest(e, ["cluster_id", "event_type"], "t", "event_id").select("cluster_id", "event_type", "event_id", "magnitude")


def _q_ancestry(s: SparkSession, d: str) -> DataFrame:
    return ancestry.assign(documents(s, d)).select(F.col("document_id").alias("doc_id"), "cluster_key", "method")


def _q_tie(s: SparkSession, d: str) -> DataFrame:
    at = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)")
    docs = s.createDataFrame(list(TIED), "doc_id long, text string")
    docs = docs.select(F.col("doc_id").alias("document_id"), "text", at.alias("event_at"), at.alias("published_at"), F.lit(40).alias("source_quality"), F.lit(None).cast("string").alias("origin_ref"))
    return ancestry.assign(docs).select(F.col("document_id").alias("doc_id"), "cluster_key", "method")


def _q_odd_texts(s: SparkSession, d: str) -> DataFrame:
    docs = s.createDataFrame(list(ODD_TEXTS), "doc_id long, text string")
    n = X.shingles(docs).select("doc_id", F.size("shingles").cast("long").alias("n_shingles"))
    return docs.select("doc_id", X.normalise(F.col("text")).alias("norm"), X.content_hash(F.col("text")).alias("content_hash")).join(n, "doc_id")


def _q_cluster_summary(s: SparkSession, d: str) -> DataFrame:
    docs = documents(s, d)
    mode = F.element_at(F.array(F.lit("LIVE"), F.lit("HISTORICAL"), F.lit("DEMO"), F.lit("UNAVAILABLE")), (F.col("doc_id") % 4 + 1).cast("int"))
    a = ancestry.assign(docs).join(docs.select("document_id", "event_at", mode.alias("mode")), "document_id")
    at = lambda c: F.unix_micros(c)
    return a.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("members"), at(F.min("event_at")).alias("first_seen"), at(F.max("event_at")).alias("last_seen"), weakest_mode(F.col("mode")).alias("data_mode"))


def _q_near_pairs(s: SparkSession, d: str) -> DataFrame:
    return ancestry.similar_pairs(read(s, d, "documents")).select("a", "b", F.round("jaccard", 4).alias("jaccard"))


def _q_ingest(s: SparkSession, d: str) -> DataFrame:
    docs = documents(s, d).drop("event_at")
    stored = docs.filter("doc_id % 10 = 0").select("source", X.content_hash(F.col("text")).alias("content_hash"))
    return ancestry.ingest(docs, stored).select("doc_id", "source", "content_hash", "word_count", "event_at_inferred")


def _q_shingles(s: SparkSession, d: str) -> DataFrame:
    return X.shingles(read(s, d, "documents")).select("doc_id", F.size("shingles").cast("long").alias("n_shingles"))


def _q_hash(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"), X.word_count(F.col("text")).alias("n_words"))


def _q_exact(s: SparkSession, d: str) -> DataFrame:
    return ancestry.exact_clusters(documents(s, d))


def _q_sentences(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("n", "sentence"))


def _q_independence(s: SparkSession, d: str) -> DataFrame:
    r = lambda c, n: F.round(c, n).alias(c)
    return profile(evidence(s, d), ["event_type"]).select("event_type", "evidence_count", "independent_sources", r("source_diversity", 5), r("primary_ratio", 5), r("avg_quality", 4), r("amplification", 5))


def _q_mainstream(s: SparkSession, d: str) -> DataFrame:
    rep = representatives(evidence(s, d), ["subject"])
    return rep.groupBy("subject").agg(F.count(F.lit(1)).alias("clusters"), F.round(F.avg((F.col("source_class") == "FINANCIAL_MEDIA").cast("double")), 4).alias("mainstream_share"))


def _q_trend(s: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 2).alias(c)
    return trend(s, d).select("signal", r("acceleration"), r("frequency_change"), r("independence_change"), r("observation_strength"), r("baseline_strength"), "independent_sources", "direction").orderBy(F.desc("acceleration"), "signal")


def _q_rates(s: SparkSession, d: str) -> DataFrame:
    return trend(s, d).select("signal", F.round("obs_rate", 3).alias("obs_rate"), F.round("base_rate", 3).alias("base_rate"), "direction", "observation_buckets", "baseline_buckets")


def _q_paths(s: SparkSession, d: str) -> DataFrame:
    return graph.walk(edges(s, d), anchors(s, d)).select("entity_type", "entity_key", F.round("weight", 5).alias("weight"), F.round("confidence", 5).alias("confidence"), F.col("order").cast("long").alias("hops"), "role", "path")


def _q_exposure(s: SparkSession, d: str) -> DataFrame:
    e = graph.exposures(edges(s, d), anchors(s, d))
    top = Window.partitionBy("role").orderBy(F.desc("exposure_score"), "company_key")
    return e.withColumn("rank", F.row_number().over(top)).select("company_key", "role", F.col("order_of_effect").cast("long").alias("order_of_effect"), F.round("exposure_score", 1).alias("exposure_score"), F.round("confidence_pct", 1).alias("confidence_pct"), "data_mode")


def _q_hierarchy(s: SparkSession, d: str) -> DataFrame:
    r = read(s, d, "region").select(F.col("r_name").alias("key"), F.lit("WORLD").alias("parent"))
    n = read(s, d, "nation").join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("r_name").alias("parent"))
    w = s.createDataFrame([("WORLD", None)], "key string, parent string")
    return graph.ancestors(w.unionByName(r).unionByName(n)).select("key", F.col("depth").cast("long").alias("depth"), "root", "path")


def queries() -> dict[str, Query]:
    return {
        "trend_acceleration": _q_trend,
        "doc_normalised_hash": _q_hash,
        "doc_ingest_dedupe": _q_ingest,
        "doc_exact_clusters": _q_exact,
        "doc_shingle_counts": _q_shingles,
        "doc_near_dup_pairs": _q_near_pairs,
        "doc_ancestry_clusters": _q_ancestry,
        "ancestry_tie_inline": _q_tie,
        "normalise_inline": _q_odd_texts,
        "doc_cluster_summary": _q_cluster_summary,
        "sentence_split": _q_sentences,
        "claim_extract_inline": _q_claims_inline,
        "claim_extract_documents": _q_claims_documents,
        "event_build": _q_events,
        "evidence_provenance_join": _q_provenance,
        "token_search_topk": _q_topk,
        "benchmark_token_overlap": _q_benchmark_overlap,
        "independence_by_type": _q_independence,
        "mainstream_share": _q_mainstream,
        "signal_buckets": _q_series,
        "signal_confidence": _q_confidence,
        "trend_rates": _q_rates,
        "theme_gate": _q_gate,
        "theme_components": _q_components,
        "theme_metrics": _q_metrics,
        "maturity_classify": _q_maturity,
        "value_chain_paths": _q_paths,
        "company_exposure": _q_exposure,
        "region_hierarchy": _q_hierarchy,
        "score_components": _q_score_components,
        "score_totals": _q_score_totals,
        "theme_ranking": _q_ranking,
        "underappreciated_themes": _q_underappreciated,
        "finding_by_dimension": _q_findings,
        "research_gaps": lambda s, d: research.gaps(_finding_rows(s, d)),
        "plan_questions": _q_plan,
        "edgar_parse_inline": _q_filings,
        "source_upsert": _q_upsert,
        "constraint_violations": _q_violations,
        "table_counts": _q_counts,
        "latest_score_per_model": _q_latest,
    }

