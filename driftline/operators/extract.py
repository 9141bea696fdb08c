"""Claim extraction by rules, event building and keyword retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.kernels import event_confidence
from driftline.functions.text import sentence_spans, tokens
from driftline.operators.independence import weakest_mode
from driftline.plans.definitions import FORWARD_PATTERNS, MAX_CLAIMS_PER_SENTENCE, SPECULATIVE_PREFIX, STABILITY_PATTERNS, SUBJECT_LEXICON, rule_rows

#: White space, letters and dots as the rules' authors meant them: Unicode classes, any line end but LF in a dot.
_FLAGS = "(?diuU)"
#: The same with LF in a dot as well.
_FLAGS_DOT_ALL = "(?diuUs)"


def matches(text: Column, pattern: str, dot_all: bool = False) -> Column:
    return text.rlike((_FLAGS_DOT_ALL if dot_all else _FLAGS) + pattern)


def any_of(text: Column, patterns, dot_all: bool = False) -> Column:
    return matches(text, "|".join(f"(?:{p})" for p in patterns), dot_all)


def subject_of(sentence: Column, hints: Column | None = None, lexicon=SUBJECT_LEXICON) -> Column:
    """The subject with most terms in the sentence (of equals the first), else the first hint that names one."""
    low = F.lower(sentence)
    hits = [sum((low.contains(t).cast("int") for t in terms), F.lit(0)) for _, terms in lexicon]
    top = F.greatest(*hits) if len(hits) > 1 else hits[0]
    out = F.when(top <= 0, F.lit(None).cast("string"))
    for (subject, _), h in zip(lexicon, hits, strict=True):
        out = out.when(h == top, subject)
    if hints is None:
        return out
    names = {t: s for s, terms in reversed(lexicon) for t in (*terms, s)}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    named = F.get(F.filter(F.transform(hints, lambda h: F.try_element_at(known, F.lower(h))), lambda s: s.isNotNull()), F.lit(0))
    return F.coalesce(out, named)


def extract(docs: DataFrame, rules: list[tuple] | None = None, lexicon=SUBJECT_LEXICON, entities: list[tuple[str, str]] | None = None, stability=STABILITY_PATTERNS, forward=FORWARD_PATTERNS, id_col: str = "doc_id", dot_all: bool = False) -> DataFrame:
    """A row a claim: id, sentence number, span, rule, type (null for speculation), magnitude, confidence, subject, entity.

    Rules are matched inside the row, as an array of those that fire, so no sentence is shuffled; of the rules of one type
    the first counts, and the first three types. entities: (surface, key) in order; the first that a sentence holds.
    dot_all: a dot in a rule or guard stands for a line feed too; the built-in ones are written for dots that stop there."""
    rules = rule_rows() if rules is None else rules
    hints = F.col("subject_hints") if "subject_hints" in docs.columns else None
    extra = ["subject_hints"] if hints is not None else []
    s = docs.select(F.col(id_col), *extra, F.posexplode(sentence_spans(F.coalesce(F.col("text"), F.lit("")))).alias("n", "span"))
    s = s.select(id_col, *extra, "n", F.col("span.start").alias("start"), F.col("span.end").alias("end"), F.col("span.sentence").alias("sentence")).filter("sentence <> ''")
    if stability:
        s = s.filter(~any_of(F.col("sentence"), stability, dot_all))
    # One array of the rules that fire, cut to the first of each type and to the first types.
    kinds: dict[str, list[tuple]] = {}
    for r in rules:
        kinds.setdefault(r[2], []).append(r)
    first_of = []
    for same in kinds.values():
        hit = F.lit(None).cast("struct<ord:int,rule_key:string,event_type:string,magnitude:double,confidence:double,claim:string>")
        for ord_, key, kind, pattern, magnitude, conf, claim in reversed(same):
            one = F.struct(F.lit(ord_).alias("ord"), F.lit(key).alias("rule_key"), F.lit(kind).alias("event_type"), F.lit(float(magnitude)).alias("magnitude"), F.lit(float(conf)).alias("confidence"), F.lit(claim).alias("claim"))
            hit = F.when(matches(F.col("sentence"), pattern, dot_all), one).otherwise(hit)
        first_of.append(hit)
    fired = F.slice(F.array_sort(F.array_compact(F.array(*first_of))), 1, MAX_CLAIMS_PER_SENTENCE)
    found = s.withColumn("fired", fired)
    spec = any_of(F.col("sentence"), forward, dot_all) if forward else F.lit(False)
    entity = F.lit(None).cast("string")
    for surface, key in reversed(entities or []):
        entity = F.when(F.lower("sentence").contains(surface.lower()), F.lit(key)).otherwise(entity)
    found = found.withColumn("speculative", spec).withColumn("subject", subject_of(F.col("sentence"), hints, lexicon)).withColumn("entity", entity)
    c = found.select(id_col, "n", "start", "end", "sentence", "speculative", "subject", "entity", F.explode("fired").alias("r"))
    is_spec = F.col("speculative")
    return c.select(
        id_col,
        "n",
        "start",
        "end",
        "sentence",
        F.col("r.rule_key").alias("rule_key"),
        F.when(~is_spec, F.col("r.event_type")).alias("event_type"),
        F.when(is_spec, "NEUTRAL").otherwise("POSITIVE").alias("direction"),
        F.when(is_spec, 0.0).otherwise(F.col("r.magnitude")).alias("magnitude"),
        F.when(is_spec, F.round(F.col("r.confidence") * 0.7, 3)).otherwise(F.col("r.confidence")).alias("confidence"),
        F.when(is_spec, F.concat(F.lit(SPECULATIVE_PREFIX), F.lower("r.claim"))).otherwise(F.col("r.claim")).alias("claim"),
        "subject",
        "entity",
        is_spec.alias("is_forward_looking"),
    )


def build_events(evidence: DataFrame) -> DataFrame:
    """Events from evidence by (cluster, type, subject or unspecified, UTC day): the best claim's values, a confidence
    that grows a little with agreement, the first entity, the weakest mode. evidence: evidence_id, cluster_id, event_type,
    subject, t, magnitude, confidence, entity_hint, data_mode."""
    e = evidence.filter("event_type is not null and cluster_id is not null").withColumn("subject", F.coalesce("subject", F.lit("unspecified"))).withColumn("day", F.to_date("t"))
    best = F.max_by(F.struct("magnitude", "confidence"), F.struct("confidence", "magnitude", -F.col("evidence_id")))
    g = e.groupBy("cluster_id", "event_type", "subject", "day").agg(
        best.alias("b"),
        F.count(F.lit(1)).alias("n_evidence"),
        F.min_by("entity_hint", F.when(F.col("entity_hint").isNotNull(), F.col("evidence_id"))).alias("entity"),
        F.min("t").alias("occurred_at"),
        weakest_mode(F.col("data_mode")).alias("data_mode"),
    )
    key = F.concat_ws(":", F.col("cluster_id").cast("string"), "event_type", "subject", F.col("day").cast("string"))
    return g.select(
        key.alias("dedupe_key"), "cluster_id", "event_type", "subject", "day", F.col("b.magnitude").alias("magnitude"), event_confidence(F.col("b.confidence"), F.col("n_evidence")).alias("confidence"),
        "n_evidence", F.when(F.col("entity").isNotNull(), "COMPANY").otherwise("INDUSTRY").alias("entity_type"), F.coalesce("entity", "subject").alias("entity_key"), "occurred_at", "data_mode",
    )


def event_bridge(evidence: DataFrame) -> DataFrame:
    """(dedupe_key, evidence_id): which evidence an event was built from."""
    e = evidence.filter("event_type is not null and cluster_id is not null")
    key = F.concat_ws(":", F.col("cluster_id").cast("string"), "event_type", F.coalesce("subject", F.lit("unspecified")), F.to_date("t").cast("string"))
    return e.select(key.alias("dedupe_key"), "evidence_id")


def new_events(evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """Events whose key is not stored yet."""
    return build_events(evidence).join(stored.select("dedupe_key"), "dedupe_key", "left_anti")


def keyword_search(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, rank, truncated). docs: doc_id, title, text, published_at, at (event or else publication),
    subject_hints; queries: query_id, text, terms, subject, since, until, hits (the limit).

    A document scores one for each of the query's tokens and terms that its title or text has, and two more where it hints at
    the query's subject; without any it is not found. Of equal scores the older comes first. truncated: more were found."""
    words = F.array_distinct(F.concat(tokens(F.coalesce("title", F.lit(""))), tokens(F.coalesce("text", F.lit("")))))
    have = docs.select("doc_id", "published_at", "at", F.transform(F.coalesce("subject_hints", F.array().cast("array<string>")), F.lower).alias("hints"), F.explode(words).alias("token"))
    terms = F.transform(F.coalesce("terms", F.array().cast("array<string>")), F.lower)
    want = queries.select("query_id", "subject", "since", "until", "hits", F.explode(F.array_distinct(F.concat(tokens(F.coalesce("text", F.lit(""))), terms))).alias("token"))
    inside = (F.col("since").isNull() | (F.col("at") >= F.col("since"))) & (F.col("until").isNull() | (F.col("at") <= F.col("until")))
    hinted = F.coalesce(F.array_contains("hints", F.col("subject")), F.lit(False))
    # The overlap is summed in each task before a document's rows meet.
    found = have.join(want, "token").filter(inside).groupBy("query_id", "hits", "doc_id", "published_at", hinted.alias("hinted")).agg(F.count(F.lit(1)).alias("n"))
    scored = found.withColumn("score", F.col("n") + F.when(F.col("hinted"), 2.0).otherwise(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "published_at", "doc_id")
    many = scored.groupBy("query_id").agg((F.count(F.lit(1)) > F.first("hits")).alias("truncated"))
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("hits"))
    return top.join(many, "query_id").select("query_id", "doc_id", "score", "rank", "truncated")


def search(docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the documents with most of a query's tokens, newest last among equals.

    docs: doc_id, text, at; queries: query_id, text. Overlaps are summed in each task before they meet."""
    have = docs.select("doc_id", "at", F.explode(tokens(F.col("text"))).alias("token"))
    want = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token"))
    score = have.join(want, "token").groupBy("query_id", "doc_id", "at").agg(F.count(F.lit(1)).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "at", "doc_id")
    return score.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "doc_id", "score", "rank")
