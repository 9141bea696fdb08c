"""Research: plans, coverage, the search loop, findings, reports."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.kernels import finding_confidence
from driftline.operators.extract import keyword_search
from driftline.operators.independence import profile
from driftline.plans.definitions import (
    AND_SPECULATIVE, AWARENESS_ESTIMATE, BREADTH, COMPANIES_MAPPED, COMPANY_MAPPED, COUNTER_DIMENSIONS, DIMENSION_EVENTS, DISCLAIMER, FALLS, GENERAL_HYPOTHESIS, INDIRECT, INVALIDATES, NEUTRAL_DIMENSIONS,
    NO_EVIDENCE, NO_EXPOSURE, NO_MARKET_DATA, NO_TREND, ON_DIMENSION, ONLY_SPECULATIVE, ORDERS, PLAN_QUESTIONS, RATES, REQUIRED_DIMENSIONS, SIGNAL_CHANGED, SIGNAL_QUESTION, SPECULATIVE_DIMENSIONS, STAGE, STRONGEST, SUPPORTING_TYPES,
)
from driftline.plans.vocab import DIMENSIONS


def plan(themes: DataFrame, signals: DataFrame) -> DataFrame:
    """Questions of a theme: the templates, then one for each signal that accelerates.

    themes: theme, primary_subject, companies (text); signals: theme, signal, acceleration, independent_sources."""
    spark = themes.sparkSession
    t = spark.createDataFrame([(o, d, p, c, q, "|".join(s)) for o, d, p, c, q, s in PLAN_QUESTIONS], "ord int, dimension string, priority int, counter boolean, question string, terms string")
    subject = F.replace(F.coalesce("primary_subject", F.lit("the theme")), F.lit("_"), F.lit(" "))
    companies = F.coalesce("companies", F.lit("the mapped companies"))
    fill = lambda c: F.replace(F.replace(F.col(c), F.lit("{p}"), subject), F.lit("{c}"), companies)
    base = themes.crossJoin(F.broadcast(t)).select("theme", "ord", "dimension", "priority", F.col("counter").alias("seeks_counter_evidence"), fill("question").alias("question"), fill("terms").alias("terms"))
    fast = signals.filter("acceleration >= 20").join(themes.select("theme", subject.alias("p")), "theme")
    q = F.format_string(SIGNAL_QUESTION, "signal", F.round("acceleration", 0).cast("long").cast("string"), F.col("independent_sources").cast("string"))
    more = fast.select("theme", F.lit(len(PLAN_QUESTIONS)).alias("ord"), F.when(F.col("signal").contains("demand"), "DEMAND").otherwise("SUPPLY").alias("dimension"), F.lit(2).alias("priority"), F.lit(False).alias("seeks_counter_evidence"), q.alias("question"), F.concat_ws("|", "signal", "p").alias("terms"))
    return base.unionByName(more)


def missing_dimensions(questions: DataFrame) -> DataFrame:
    """(theme, dimension): required dimensions that a theme's questions do not cover."""
    spark = questions.sparkSession
    need = questions.select("theme").distinct().crossJoin(F.broadcast(spark.createDataFrame([(d,) for d in REQUIRED_DIMENSIONS], "dimension string")))
    return need.join(questions.select("theme", "dimension").distinct(), ["theme", "dimension"], "left_anti")


def enforce_coverage(questions: DataFrame, fallback: DataFrame) -> DataFrame:
    """questions and, from the rule-based plan, those for the required dimensions that they miss."""
    return questions.unionByName(fallback.join(missing_dimensions(questions), ["theme", "dimension"], "left_semi").select(questions.columns))


@dataclass(frozen=True)
class Budget:
    max_searches: int = 30
    saturation: int = 6
    max_calls: int = 2
    max_seconds: float = 120.0
    max_items: int = 40


@dataclass
class SearchOutcome:
    searches: int = 0
    new_documents: list = field(default_factory=list)
    stop_reason: str = "plan_complete"
    trace: list = field(default_factory=list)


def search_loop(questions: list[dict], search: Callable[[dict], list], budget: Budget = Budget(), known: set | None = None) -> SearchOutcome:
    """Questions by (priority, dimension), each searched once, until the plan is done, searches bring nothing new for
    `saturation` in a row, or the budget is spent. Sequential by its meaning, over a plan of a bounded size."""
    out, seen, empty = SearchOutcome(), set(known or ()), 0
    for q in sorted(questions, key=lambda q: (q["priority"], q["dimension"], q["question"])):
        if out.searches >= budget.max_searches:
            out.stop_reason = "budget"
            break
        if empty >= budget.saturation:
            out.stop_reason = "saturation"
            break
        results = search(q)
        found = [d for d in results if d not in seen]
        seen.update(found)
        out.searches += 1
        out.new_documents += found
        out.trace.append({"dimension": q["dimension"], "results": len(results), "new": len(found)})
        empty = 0 if found else empty + 1
    return out


def bridge(spark: SparkSession, pairs=DIMENSION_EVENTS) -> DataFrame:
    return spark.createDataFrame(list(pairs), "dimension string, event_type string")


def findings(evidence: DataFrame, pairs=DIMENSION_EVENTS, supporting=SUPPORTING_TYPES, dimensions=DIMENSIONS) -> DataFrame:
    """A row a dimension, those without evidence too.

    evidence: event_type (null for speculation) and the columns of ``independence``. Speculative statements bear on the
    speculative dimensions alone."""
    spark = evidence.sparkSession
    observed = evidence.join(F.broadcast(bridge(spark, pairs)), "event_type")
    spec = evidence.filter("event_type is null").select("*", F.explode(F.array(*[F.lit(d) for d in SPECULATIVE_DIMENSIONS])).alias("dimension"))
    rows = observed.unionByName(spec)
    kinds = rows.groupBy("dimension", "event_type").agg(F.count(F.lit(1)).alias("n"))
    says = F.concat(F.col("n").cast("string"), F.lit("x "), F.lower(F.replace("event_type", F.lit("_"), F.lit(" "))))
    per = kinds.groupBy("dimension").agg(
        F.coalesce(F.sum(F.when(F.col("event_type").isin(*supporting), F.col("n"))), F.lit(0)).alias("supports"),
        F.coalesce(F.sum(F.when(F.col("event_type").isNotNull(), F.col("n"))), F.lit(0)).alias("observed"),
        F.coalesce(F.sum(F.when(F.col("event_type").isNull(), F.col("n"))), F.lit(0)).alias("speculative"),
        F.count("event_type").alias("types"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type").isNotNull(), F.struct("event_type", says.alias("s"))))), lambda x: x["s"]), ", ").alias("breakdown"),
    )
    all_ = spark.createDataFrame([(i, d) for i, d in enumerate(dimensions)], "ord int, dimension string")
    d = all_.join(per, "dimension", "left").join(profile(rows, ["dimension"]), "dimension", "left")
    opposes = F.col("observed") - F.col("supports")
    stance = (
        F.when(F.col("evidence_count").isNull(), "NEUTRAL")
        .when(F.col("dimension").isin(*COUNTER_DIMENSIONS), "CONTRADICTING")
        .when(F.col("dimension").isin(*NEUTRAL_DIMENSIONS), "NEUTRAL")
        .when(F.col("supports") > opposes, "SUPPORTING")
        .when(opposes > F.col("supports"), "CONTRADICTING")
        .otherwise("NEUTRAL")
    )
    none = F.col("evidence_count").isNull()
    claim_type = F.when(none, "FACT").when(F.col("observed") == 0, "HYPOTHESIS").when(F.col("types") > 1, "INFERENCE").otherwise("FACT")
    name = F.lower(F.replace("dimension", F.lit("_"), F.lit(" ")))
    n = F.coalesce("independent_sources", F.lit(0))
    lead = F.format_string(ON_DIMENSION, n, name, "breakdown")
    claim = (
        F.when(none, F.format_string(NO_EVIDENCE, name))
        .when((F.col("observed") > 0) & (F.col("speculative") > 0), F.format_string(AND_SPECULATIVE, lead, "speculative"))
        .when(F.col("observed") > 0, F.concat(lead, F.lit(".")))
        .otherwise(F.format_string(ONLY_SPECULATIVE, "speculative", name))
    )
    return d.select(
        "ord", "dimension", stance.alias("stance"), claim_type.alias("claim_type"), F.when(none, 0.0).otherwise(finding_confidence(n, F.col("avg_quality"))).alias("confidence"),
        n.cast("long").alias("independent_sources"), F.round(F.coalesce("source_diversity", F.lit(0.0)), 4).alias("source_diversity"), claim.alias("claim"),
    )


def gaps(found: DataFrame) -> DataFrame:
    """Dimensions for which nothing was found."""
    return found.filter("independent_sources = 0").select("dimension", "claim")


def ensure_hypotheses(themes: DataFrame, stored: DataFrame, known: list[tuple[str, str]] = ()) -> DataFrame:
    """(theme, statement, status, created): the open hypothesis of each theme, or a new one from its template or its name.

    themes: theme, name; stored: theme, statement, status."""
    open_ = stored.filter("status = 'OPEN'").groupBy("theme").agg(F.min("statement").alias("statement"))
    t = themes.sparkSession.createDataFrame(list(known), "theme string, given string")
    new = themes.join(open_, "theme", "left_anti").join(F.broadcast(t), "theme", "left").select("theme", F.coalesce("given", F.format_string(GENERAL_HYPOTHESIS, "name")).alias("statement"))
    both = open_.withColumn("created", F.lit(False)).unionByName(new.withColumn("created", F.lit(True)))
    return both.withColumn("status", F.lit("OPEN"))


def plan_input(themes: DataFrame, trends: DataFrame, exposures: DataFrame, companies: DataFrame) -> DataFrame:
    """What a planner sees of each theme: its signals by name and its companies by falling exposure; unknown companies go.

    themes: theme, name, subjects; trends: theme, signal, acceleration, observation_strength, direction, independent_sources;
    exposures: theme, company_key, role, order_of_effect, exposure_score; companies: company_key, company_name."""
    level = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("observation_strength")))
    s = trends.groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("signal", level.alias("level"), "acceleration", "direction", "independent_sources"))).alias("signals"))
    e = exposures.join(companies, "company_key").groupBy("theme").agg(F.array_sort(F.collect_list(F.struct((-F.col("exposure_score")).alias("o"), "company_key", "company_name", "role", "order_of_effect", "exposure_score"))).alias("companies"))
    return themes.join(s, "theme", "left").join(e, "theme", "left")


def first_questions(questions: DataFrame) -> DataFrame:
    """(theme, dimension, question, priority, n_questions): the first question of each dimension, by priority and order."""
    return questions.groupBy("theme", "dimension").agg(F.min_by(F.struct("question", "priority"), F.struct("priority", "ord")).alias("q"), F.count(F.lit(1)).alias("n_questions")).select("theme", "dimension", "q.*", "n_questions")


def plan_summary(questions: DataFrame) -> DataFrame:
    """(theme, questions, counter_evidence, dimensions): how much a plan asks, how much of it against itself, and about what."""
    return questions.groupBy("theme").agg(F.count(F.lit(1)).alias("questions"), F.count(F.when(F.col("seeks_counter_evidence"), 1)).alias("counter_evidence"), F.array_sort(F.collect_set("dimension")).alias("dimensions"))


def exposure_finding(exposures: DataFrame) -> DataFrame:
    """(theme, claim, confidence, independent_sources, stance, claim_type) of the five best exposures of each theme.

    exposures: theme, company_key, role, order_of_effect, exposure_score, confidence_pct."""
    w = Window.partitionBy("theme").orderBy(F.desc("exposure_score"), "company_key")
    top = exposures.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")
    said = F.format_string(COMPANY_MAPPED, "company_key", F.lower(F.replace("role", F.lit("_"), F.lit(" "))), F.col("order_of_effect").cast("int"), "exposure_score")
    five = top.groupBy("theme").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", said.alias("s")))), lambda x: x["s"]), "; ").alias("listed"), F.max("confidence_pct").alias("best"), F.count(F.lit(1)).alias("independent_sources"))
    n = exposures.groupBy("theme").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return five.join(n, "theme").select(
        "theme", F.format_string(COMPANIES_MAPPED, "n", "listed").alias("claim"), F.round(F.least(F.lit(1.0), F.col("best") / 100), 4).alias("confidence"), "independent_sources", F.lit("SUPPORTING").alias("stance"), F.lit("INFERENCE").alias("claim_type")
    )


def finding_evidence(evidence: DataFrame, pairs=DIMENSION_EVENTS) -> DataFrame:
    """(dimension, evidence_id): the evidence that each finding rests on."""
    spec = evidence.filter("event_type is null").select("evidence_id", F.explode(F.array(*[F.lit(d) for d in SPECULATIVE_DIMENSIONS])).alias("dimension"))
    return evidence.join(F.broadcast(bridge(evidence.sparkSession, pairs)), "event_type").select("dimension", "evidence_id").unionByName(spec.select("dimension", "evidence_id"))


def run_searches(questions: DataFrame, docs: DataFrame, budget: Budget = Budget(), hits: int = 20) -> tuple[DataFrame, SearchOutcome]:
    """(search runs, outcome): every question of a plan is searched in one job, then the stopping rules go through the results
    in the order of the plan. questions: dimension, priority, question, terms ('|' between them); docs as in keyword_search.

    What comes to the driver is a plan's questions, each with at most `hits` numbers."""
    spark = questions.sparkSession
    asked = [r.asDict() | {"query_id": i} for i, r in enumerate(questions.select("dimension", "priority", "question", "terms").orderBy("priority", "dimension", "question").collect())]
    rows = [(a["query_id"], a["terms"].replace("|", " "), a["terms"].split("|"), None, None, None, hits) for a in asked]
    q = spark.createDataFrame(rows, "query_id int, text string, terms array<string>, subject string, since timestamp, until timestamp, hits int")
    got = keyword_search(docs, q).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("found"))
    by_id = {r.query_id: [x.doc_id for x in r.found] for r in got.collect()}
    terms = {(a["dimension"], a["question"]): by_id.get(a["query_id"], []) for a in asked}
    outcome = search_loop(asked, lambda a: terms[a["dimension"], a["question"]], budget)
    runs = [(i, t["dimension"], t["results"], t["new"]) for i, t in enumerate(outcome.trace)]
    return spark.createDataFrame(runs, "n int, dimension string, result_count int, new_count int"), outcome


class BudgetExceeded(RuntimeError):
    """An agent asked for more than its budget holds."""


def traced(agent: Callable, payload, budget: Budget = Budget(), clock: Callable[[], float] = time.monotonic, /, **named) -> dict:
    """One row of a run's trace: status SUCCEEDED, TIMED_OUT, BUDGET_EXCEEDED or FAILED, seconds, error, and the output, if any.
    A failure is recorded, never raised."""
    began, output, error = clock(), None, None
    try:
        output, status = agent(payload), "SUCCEEDED"
    except BudgetExceeded as e:
        status, error = "BUDGET_EXCEEDED", str(e)
    except Exception as e:  # whatever went wrong belongs in the trace
        status, error = "FAILED", f"{type(e).__name__}: {e}"
    seconds = clock() - began
    if status == "SUCCEEDED" and seconds > budget.max_seconds:
        output, status, error = None, "TIMED_OUT", f"{seconds:.1f}s of {budget.max_seconds:.1f}s"
    return named | {"strategy": "rule_based", "status": status, "seconds": seconds, "error": error, "output": output}


def report_lines(trends: DataFrame, found: DataFrame, links: DataFrame, exposure: DataFrame, themes: DataFrame, scores: DataFrame, market: str = "no provider", market_mode: str = "UNAVAILABLE") -> DataFrame:
    """(theme, section, ord, text, claim_type, evidence): every line of every theme's report, with how much evidence it rests on.

    trends: theme, signal and ``signals.trends``; found: ``findings`` (theme, dimension, ...); links: theme, dimension, evidence_id;
    exposure: theme and ``graph.exposures``; themes: theme, maturity, market_awareness, awareness_mode; scores: theme, model, value,
    weight_coverage, unavailable. Lines are made as rows; a theme's text is put together last."""
    name = F.initcap(F.replace("signal", F.lit("_"), F.lit(" ")))
    line = lambda df, section, order, text, kind, ids=F.lit(0): df.select("theme", F.lit(section).alias("section"), order.cast("double").alias("o"), text.alias("text"), kind.alias("claim_type"), ids.cast("long").alias("evidence"))
    fact, inference, hypothesis = F.lit("FACT"), F.lit("INFERENCE"), F.lit("HYPOTHESIS")
    n = links.groupBy("theme", "dimension").agg(F.count_distinct("evidence_id").alias("ids"))
    f = found.join(n, ["theme", "dimension"], "left").withColumn("ids", F.coalesce("ids", F.lit(0)))
    best = f.filter("stance = 'SUPPORTING'").groupBy("theme").agg(F.max_by(F.struct("claim", "claim_type", "ids"), F.struct("independent_sources", -F.col("ord"))).alias("b")).select("theme", "b.*")
    fast = trends.groupBy("theme").agg(F.max_by(F.struct("signal", "obs_rate", "base_rate", "independence_change"), F.struct("acceleration", "signal")).alias("t")).select("theme", "t.*")
    orders = exposure.groupBy("theme").agg(F.count(F.when(F.col("order_of_effect") == 1, 1)).cast("int").alias("first"), F.count(F.when(F.col("order_of_effect") > 1, 1)).cast("int").alias("later"))
    indirect = exposure.filter("order_of_effect > 1").groupBy("theme").agg(F.max_by(F.struct("company_key", "role", "order_of_effect", "rationale"), F.struct("exposure_score", "company_key")).alias("b")).select("theme", "b.*")
    words = F.lower(F.replace("role", F.lit("_"), F.lit(" ")))
    section = F.when(F.col("independent_sources") == 0, "research_gaps").when(F.col("stance") == "SUPPORTING", "supporting_evidence").when(F.col("stance") == "CONTRADICTING", "contradictory_evidence").otherwise("contextual_findings")
    rank = F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("exposure_score"), "company_key"))
    none = themes.select("theme").join(exposure, "theme", "left_anti")
    still = themes.select("theme").join(trends, "theme", "left_anti")
    parts = [
        line(trends, "what_changed", -F.col("acceleration"), F.format_string(SIGNAL_CHANGED, name, "observation_strength", "baseline_strength", "acceleration"), fact),
        line(best, "what_changed", F.lit(1000), F.concat(F.lit(STRONGEST), F.col("claim")), F.col("claim_type"), F.col("ids")),
        line(none, "why_it_matters", F.lit(0), F.lit(NO_EXPOSURE), fact),
        line(orders, "why_it_matters", F.lit(0), F.format_string(ORDERS, "first", "later"), inference),
        line(indirect, "why_it_matters", F.lit(1), F.format_string(INDIRECT, "company_key", words, F.col("order_of_effect").cast("int"), "rationale"), inference),
        line(still, "why_now", F.lit(0), F.lit(NO_TREND), fact),
        line(fast, "why_now", F.lit(0), F.format_string(RATES, name, "obs_rate", "base_rate"), fact),
        line(fast, "why_now", F.lit(1), F.format_string(BREADTH, "independence_change"), fact),
        line(themes.join(fast.select("theme"), "theme"), "why_now", F.lit(2), F.format_string(STAGE, "maturity"), inference),
        f.select("theme", section.alias("section"), (-F.col("independent_sources") + F.col("ord") / 100).cast("double").alias("o"), F.col("claim").alias("text"), F.when(section == "research_gaps", "FACT").otherwise(F.col("claim_type")).alias("claim_type"), F.col("ids").cast("long").alias("evidence")),
        line(exposure.withColumn("rank", rank), "companies_exposed", F.col("rank"), F.format_string(COMPANY_MAPPED, "company_key", words, F.col("order_of_effect").cast("int"), "exposure_score"), inference),
        line(themes, "market_awareness", F.lit(0), F.format_string(AWARENESS_ESTIMATE, "market_awareness"), inference),
        line(f.filter("dimension = 'MARKET_EXPECTATIONS'"), "market_awareness", F.lit(2), F.col("claim"), F.col("claim_type")),
        line(trends, "invalidation_conditions", F.lit(0), F.format_string(FALLS, name, "acceleration"), hypothesis),
        line(themes, "invalidation_conditions", F.lit(1), F.lit(INVALIDATES), hypothesis),
        line(scores, "scores", F.lit(0), F.concat_ws(" ", "model", F.format_string("%.1f over %.0f%% of the weights", "value", F.col("weight_coverage") * 100)), fact),
        line(themes, "provenance", F.lit(0), F.lit(DISCLAIMER), fact),
    ]
    if market_mode == "UNAVAILABLE":
        parts.append(line(themes, "market_awareness", F.lit(1), F.lit(NO_MARKET_DATA % market), fact))
    rows = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("theme", "section").orderBy("o", "text")
    return rows.withColumn("ord", F.row_number().over(order)).select("theme", "section", "ord", "text", "claim_type", "evidence")


def report(lines: DataFrame) -> DataFrame:
    """(theme, report): a theme's lines as one JSON object, a list of lines a section."""
    s = lines.groupBy("theme", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text", "claim_type", "evidence"))), lambda x: F.struct(x["text"].alias("text"), x["claim_type"].alias("claim_type"), x["evidence"].alias("evidence"))).alias("lines"))
    return s.groupBy("theme").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "lines"))))).alias("report"))
