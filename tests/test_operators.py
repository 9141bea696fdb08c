"""Operators against small cases worked by hand, and the invariants that hold for all."""

import io
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from driftline.functions import kernels as K
from driftline.functions import text as X
from driftline.operators import ancestry, extract, formation, graph, research, scoring, signals, views
from driftline.operators.independence import profile
from driftline.sources import readers


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_golden_numbers(spark):
    xs = [0, 0.5, 1, 2, 2.5, 5, 10]
    assert list(one(spark, *[K.saturating_strength(F.lit(x)) for x in xs])) == [0, 18.1269, 32.968, 55.0671, 63.2121, 86.4665, 98.1684]
    pairs = [(85, 84), (60, 30), (20, 60), (4, 0), (1000, 0.001), (0, 1000)]
    assert list(one(spark, *[K.bounded_change(F.lit(float(o)), F.lit(float(b))) for o, b in pairs])) == [1.1904, 76.1594, -58.2783, 46.2117, 100, -76.1594]
    got = one(spark, *[K.confidence(F.lit(n), F.lit(0.0), F.lit(1.0), F.lit(100.0)) for n in (1, 2, 4, 8)])
    assert list(got) == [27.5283, 45.981, 66.6416, 80.0964]
    assert list(one(spark, *[K.saturating_count(F.lit(n)) for n in (1, 4, 11)])) == [22.1199, 63.2121, 93.6072]
    assert list(one(spark, *[K.finding_confidence(F.lit(n), F.lit(100.0)) for n in (1, 3)])) == [0.4, 1.0]


def evidence(spark, rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "g string, evidence_id int, cluster_id string, source_class string, source_quality int, is_primary boolean")


def test_copies_never_raise_independence(spark):
    base = [("a", "INDUSTRY", 50, False), ("b", "REGULATORY", 90, True), ("c", "FINANCIAL_MEDIA", 60, False)]
    p = profile(evidence(spark, base), ["g"]).first()
    assert (p.independent_sources, p.source_diversity, p.amplification, p.mainstream_share) == (3, 0.5, 1.0, 0.3333)
    more = profile(evidence(spark, base + [("a", "COMMUNITY", 10, False)] * 5).repartition(3), ["g"]).first()
    assert more.independent_sources == 3 and more.source_diversity == 0.5 and more.amplification < 1 and more.avg_quality == p.avg_quality


def test_buckets_are_half_open_and_complete(spark):
    grid = signals.Grid("2024-06-01 00:00:00")
    assert grid.buckets == 18
    times = ["2024-05-31 23:59:59", "2024-05-25 00:00:00", "2024-05-24 23:59:59.999999", "2024-06-01 00:00:00"]
    t = spark.createDataFrame([(x,) for x in times], "s string").select(grid.bucket(F.col("s").cast("timestamp")).alias("b"))
    assert [r.b for r in t.collect()] == [0, 0, 1, -1]
    w = spark.createDataFrame([("x", "m", "UP", 1.0)], "signal string, subject string, event_type string, weight double")
    e = spark.createDataFrame([(1, 1, "c", "UP", "m", "2024-05-31", 1.0, 1.0, "INDUSTRY", 100, False)], "event_id int, evidence_id int, cluster_id string, event_type string, subject string, t string, magnitude double, confidence double, source_class string, source_quality int, is_primary boolean")
    e = e.withColumn("t", F.col("t").cast("timestamp"))
    series = signals.series(e, w, grid).collect()
    assert len(series) == 18 and sum(r.event_count for r in series) == 1
    r = signals.trends(e, w, grid).first()
    assert (r.observation_buckets, r.baseline_buckets, r.independent_sources) == (4, 13, 1) and r.acceleration > 0


def test_maturity_rules_in_order(spark):
    rows = [(6, 45.0, 0.1, False, 0.1, "ACCELERATING"), (6, 45.0, 0.1, False, 0.6, "INVALIDATED"), (1, 45.0, 0.9, True, 0.9, "INVISIBLE"), (6, 45.0, 0.7, True, 0.1, "CROWDED"), (6, 45.0, 0.5, False, 0.1, "CONSENSUS"), (6, 0.0, 0.1, False, 0.1, "DEVELOPING"), (2, 3.0, 0.1, False, 0.1, "MATURE"), (2, 30.0, 0.1, False, 0.1, "EMERGING")]
    df = spark.createDataFrame(rows, "n int, a double, m double, r boolean, c double, want string")
    assert df.filter(signals.maturity(F.col("n"), F.col("a"), F.col("m"), F.col("r"), F.col("c")) != F.col("want")).count() == 0


def test_best_paths(spark):
    rows = [("TECHNOLOGY", "need", "DRIVES_DEMAND_FOR", "TECHNOLOGY", "hbm"), ("COMPANY", "maker", "PRODUCES", "TECHNOLOGY", "hbm"), ("COMPANY", "toolco", "SUPPLIES", "COMPANY", "maker"), ("COMPANY", "materialco", "SUPPLIES", "COMPANY", "toolco"),
            ("COMPANY", "maker", "COMPETES_WITH", "COMPANY", "rival"), ("COMPANY", "rival", "COMPETES_WITH", "COMPANY", "maker"), ("COMPANY", "maker", "REGULATES", "COMPANY", "nobody")]
    e = spark.createDataFrame([(*r, 0.9, 0.9, "DEMO" if i else "LIVE") for i, r in enumerate(rows)], "source_type string, source_key string, relationship string, target_type string, target_key string, weight double, confidence double, data_mode string")
    a = spark.createDataFrame([("TECHNOLOGY", "need", 1.0)], "entity_type string, entity_key string, weight double")
    got = {r.company_key: (r.exposure_score, r.confidence_pct, r.order_of_effect, r.data_mode) for r in graph.exposures(e, a).collect()}
    assert got["maker"] == (81.0, 58.52, 1, "DEMO") and got["toolco"] == (58.32, 44.77, 2, "DEMO") and got["materialco"] == (41.99, 34.25, 3, "DEMO")
    assert got["rival"][2] == 2 and "nobody" not in got
    assert set(r.company_key for r in graph.exposures(e, a, max_hops=3).collect()) == {"maker", "toolco", "rival"}


def test_scores_renormalise_around_missing_components(spark):
    m = spark.createDataFrame([("t", 60.0, 20.0, 0.5, 0.5, 70.0, 6, 80.0, 0.25, 40.0)], "theme string, strength double, acceleration double, source_diversity double, primary_ratio double, avg_quality double, independent_sources int, novelty double, contradiction_ratio double, exposure_top double")
    parts, totals = scoring.score(m)
    cover = {r.model: r.weight_coverage for r in totals.collect()}
    assert cover == {"trend": 0.75, "opportunity": 0.7, "confidence": 1.0}
    p = {(r.model, r.key): r for r in parts.collect()}
    assert p["trend", "signal_strength"].effective_weight == 0.266667 and p["trend", "economic_impact"].normalized is None and p["trend", "economic_impact"].contribution == 0
    assert sum(r.effective_weight for k, r in p.items() if k[0] == "trend") == pytest.approx(1, abs=1e-5)
    with pytest.raises(Exception, match="unresolved"):
        scoring.components(m.select("theme", F.lit("confidence").alias("model"), F.lit("source_quality").alias("key"), F.lit(1.0).alias("value"))).collect()


def sequential(rows, threshold=0.6):
    """The rule as a loop: (id, text, ref) in order."""
    import re

    norm = lambda t: re.sub(" +", " ", re.sub("[^a-z0-9 ]+", " ", t.lower())).strip()

    def shingle(t):
        w = norm(t).split()
        return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else [])

    refs, hashes, clusters, out = {}, {}, [], {}
    for i, t, ref in rows:
        h, s = norm(t), shingle(t)
        c = refs.get(ref) if ref else None
        c = c if c is not None else hashes.get(h)
        if c is None:
            best, at = 0.0, None
            for k, members in enumerate(clusters):
                for m in members:
                    j = len(s & m) / len(s | m) if s and m else 0.0
                    if j > best:
                        best, at = j, k
            c = at if best >= threshold else None
        if c is None:
            clusters.append([])
            c = len(clusters) - 1
        clusters[c].append(s)
        hashes.setdefault(h, c)
        if ref:
            refs.setdefault(ref, c)
        out[i] = c
    return out


def test_ancestry_equals_the_sequential_rule(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        if rows and r.random() < 0.6:
            words = r.choice(rows)[1].split()
            for _ in range(r.choice([0, 1, 1, 2, 6])):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocab)
        else:
            words = [r.choice(vocab) for _ in range(r.randint(0, 40))]
        rows.append((i, " ".join(words), "ref" if i in (5, 31) else None))
    docs = spark.createDataFrame([(i, t, ref, 50) for i, t, ref in rows], "document_id int, text string, origin_ref string, source_quality int").withColumn("event_at", F.expr("timestamp '2024-01-01' + make_dt_interval(0, 0, document_id, 0)")).withColumn("published_at", F.col("event_at"))
    got = {x.document_id: x for x in ancestry.assign(docs.repartition(5)).collect()}
    want = sequential(rows)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({k: x.cluster_key for k, x in got.items()}) == groups(want)
    assert got[31].method == "DECLARED_ORIGIN" and sum(x.method == "ORIGIN" for x in got.values()) == len(set(want.values()))


def test_claims_guards_and_spans(spark):
    text = "Suppliers cannot meet demand.  Demand remained steady, we note! We expect demand is accelerating for Acme modules."
    docs = spark.createDataFrame([(1, text, ["dram"]), (2, None, None)], "doc_id int, text string, subject_hints array<string>")
    got = extract.extract(docs, entities=[("acme", "company:acme")]).orderBy("n", "rule_key").collect()
    assert [(r.rule_key, r.event_type, r.subject, r.is_forward_looking) for r in got] == [("supply_constraint#1", "SUPPLY_CONSTRAINT", "memory", False), ("demand_acceleration#1", None, "memory", True)]
    assert all(text[r.start : r.end] == r.sentence for r in got) and got[1].confidence == 0.595 and got[1].entity == "company:acme"


def test_text_kernels(spark):
    d = spark.createDataFrame([("Ab, Céd  x!",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(X.normalise(F.col("t"))).collect()] == ["ab c d x", "", None]
    assert sorted(d.limit(1).select(X.tokens(F.lit("The cat and the CAT sat on a12"))).first()[0]) == ["a12", "cat", "sat"]
    assert d.select(X.nfkc(F.lit("ﬁ")).alias("x")).first().x == "fi"


def test_search_loop_stops(spark):
    qs = [{"priority": 1, "dimension": f"D{i}", "question": str(i)} for i in range(40)]
    assert research.search_loop(qs, lambda q: []).stop_reason == "saturation"
    out = research.search_loop(qs, lambda q: [q["dimension"]])
    assert out.stop_reason == "budget" and out.searches == 30 and len(out.new_documents) == 30
    assert research.search_loop(qs[:3], lambda q: [q["dimension"]]).stop_reason == "plan_complete"


def test_ingest_twice_adds_nothing(spark):
    docs = spark.createDataFrame([(1, "s", "A b", "2024-01-01"), (2, "s", "a  B!", "2024-01-02"), (3, "r", "a b", "2024-01-03")], "doc_id int, source string, text string, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp"))
    none = spark.createDataFrame([], "source string, content_hash string")
    first = ancestry.ingest(docs, none)
    assert sorted(r.doc_id for r in first.collect()) == [1, 3]
    assert ancestry.ingest(docs, first).count() == 0


def test_registry_urls_and_corpus(spark, tmp_path):
    reg = readers.Registry(spark)
    reg.register("FILINGS", lambda: spark.range(2), "LIVE")
    assert reg.read("NEWS_SEARCH")[1] == "UNAVAILABLE" and reg.read("FILINGS")[0].count() == 2 and reg.health().filter("available").count() == 1
    assert readers.allowed_url("https://a.example/x", ("a.example",)) and not readers.allowed_url("http://a.example/x", ("a.example",)) and not readers.allowed_url("https://u@a.example/", ("a.example",))
    (tmp_path / "c.json").write_text('{"corpus_version":"1","data_mode":"DEMO","sources":[{"key":"s","source_type":"SEC_FILING"}],"documents":[{"external_id":"d","source_key":"s","published_at":"2024-01-01T00:00:00","body_text":"x"}]}')
    corpus = readers.read_corpus(spark, str(tmp_path / "c.json"))
    docs, sources = readers.section(corpus, "documents"), readers.section(corpus, "sources")
    assert docs.first().published_at.year == 2024 and readers.by_capability(docs, sources, True).count() == 1 and readers.by_capability(docs, sources, False).count() == 0
    ref = '{"data_mode":"DEMO","companies":[{"key":"c","name":"C","industry_key":"i"}],"industries":[{"key":"i","parent":"j"}],"relationships":[{"source_entity_type":"COMPANY","source_entity_key":"c","weight":0.5}]}'
    (tmp_path / "r.json").write_text(ref)
    whole = readers.read_corpus(spark, str(tmp_path / "r.json"))
    assert [readers.section(whole, x).count() for x in ("companies", "industries", "relationships", "documents")] == [1, 1, 1, 0]
    reg.register("NEWS_SEARCH", lambda: spark.range(3), "DEMO")
    assert reg.both("NEWS_SEARCH", "FILINGS").count() == 5
    assert readers.fetch_json("https://a.example/x", ("a.example",), opened=lambda url, timeout: io.BytesIO(b'{"n": 1}')) == {"n": 1}
    with pytest.raises(PermissionError):
        readers.fetch_json("https://b.example/x", ("a.example",), opened=lambda *_, **__: None)
    (tmp_path / "l.json").write_text('{"data_mode":"LIVE","documents":[]}')
    with pytest.raises(Exception, match="DEMO"):
        readers.read_corpus(spark, str(tmp_path / "l.json")).collect()


def test_report_puts_lines_into_sections(spark):
    rows = [("t", "gaps", 1, "b", "FACT", 0), ("t", "changed", 2, "y", "FACT", 3), ("t", "changed", 1, "x", "INFERENCE", 2), ("u", "changed", 1, "z", "FACT", 0)]
    got = {r.theme: json.loads(r.report) for r in research.report(spark.createDataFrame(rows, "theme string, section string, ord int, text string, claim_type string, evidence long")).collect()}
    assert got["t"] == {"changed": [{"text": "x", "claim_type": "INFERENCE", "evidence": 2}, {"text": "y", "claim_type": "FACT", "evidence": 3}], "gaps": [{"text": "b", "claim_type": "FACT", "evidence": 0}]} and list(got) != []


def test_snapshot_replaces_its_own_part(spark, tmp_path):
    s = spark.createDataFrame([("2024-01-01", "trend", 1.0), ("2024-01-01", "confidence", 2.0)], "computed_at string, model string, value double")
    readers.write_snapshot(s, str(tmp_path / "s"))
    readers.write_snapshot(s.filter("model = 'trend'").withColumn("value", F.lit(9.0)), str(tmp_path / "s"))
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [2.0, 9.0]


def test_stream_drops_copies(spark, tmp_path):
    from driftline.streaming.ingest import run_batches

    rows = [("s", "Same text", "2024-01-01 00:00:00"), ("s", "same TEXT!", "2024-01-02 00:00:00"), ("r", "same text", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "source string, text string, event_at string").withColumn("event_at", F.col("event_at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("source string, text string, event_at timestamp").parquet(str(tmp_path / "in"))
    run_batches(stream, lambda df, n: seen.extend(r.source for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["r", "s"]


def test_sentence_spans_are_linear_and_exact(spark):
    text = "  One here.  Two é🙂!\n\nThree? " + "Short one. " * 30_000 + "end"
    began = time.time()
    spans = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(X.sentence_spans(F.coalesce("t", F.lit(""))).alias("s")).collect()
    assert time.time() - began < 30 and len(spans[0].s) == 30_004 and spans[1].s == []
    assert all(text[x.start : x.end].strip() == x.sentence for x in spans[0].s)


def test_hierarchies_of_any_depth(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(25)]
    got = graph.ancestors(spark.createDataFrame(chain, "key string, parent string")).collect()
    assert len(got) == 25 and max(r.depth for r in got) == 24
    with pytest.raises(ValueError, match="cycle"):
        graph.ancestors(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "key string, parent string"))


def test_trace_records_what_went_wrong():
    clock = iter(range(0, 1000, 50)).__next__
    ok = research.traced(lambda x: x + 1, 1, research.Budget(max_seconds=60), clock, agent="planner")
    assert (ok["status"], ok["output"], ok["agent"], ok["seconds"]) == ("SUCCEEDED", 2, "planner", 50)
    late = research.traced(lambda x: x, 1, research.Budget(max_seconds=10), clock)
    assert (late["status"], late["output"]) == ("TIMED_OUT", None)

    def spends(_):
        raise research.BudgetExceeded("3 searches of 2")

    assert research.traced(spends, 1)["status"] == "BUDGET_EXCEEDED"
    bad = research.traced(lambda x: 1 / x, 0)
    assert bad["status"] == "FAILED" and bad["error"].startswith("ZeroDivisionError")


def test_bus_isolates_handlers():
    bus, seen = readers.EventBus(), []

    def fails(_):
        raise RuntimeError("no")

    bus.subscribe("EVENT_CREATED", fails)
    bus.subscribe("EVENT_CREATED", seen.append)
    bus.publish("EVENT_CREATED", {"n": 1})
    bus.publish("THEME_UPDATED")
    assert seen == [{"n": 1}] and [e for _, _, e in bus.log] == ["no", None]
    with pytest.raises(ValueError):
        bus.publish("SOMETHING")


def test_lookups_lists_and_health(spark):
    assert readers.parse_list(" a.example, b ,,") == ["a.example", "b"] and readers.parse_list('["x"]') == ["x"] and readers.parse_list("") == [] and readers.parse_list(["q"]) == ["q"]
    with pytest.raises(LookupError, match="document"):
        views.lookup(spark.range(3), "id", 7, "document")

    def down():
        raise OSError("unreachable")

    assert readers.filings_health(None)[0] is False and readers.filings_health("me", down)[2] == "OSError: unreachable" and readers.filings_health("me")[1] == "LIVE"
    assert readers.Registry(spark, {}, {"FILINGS": "odd"}).read("FILINGS")[1] == "UNAVAILABLE"
    runs = spark.createDataFrame([("t", 1, "2024-01-01"), ("t", 2, "2024-01-03"), ("u", 3, "2024-01-05")], "theme string, run_id int, at string")
    assert views.newest(runs, "t", "at", "run_id", "run").first().run_id == 2
    assert json.loads(views.as_json(runs.filter("run_id = 3"), "theme").first().json) == {"theme": "u", "run_id": 3, "at": "2024-01-05"}


def test_seed_refuses_what_is_real(spark):
    ind = spark.createDataFrame([("a", "A", None, "DEMO"), ("b", "B", "a", "DEMO")], "key string, name string, parent string, data_mode string")
    comp = spark.createDataFrame([("c", "C", "b", True, "DEMO")], "key string, name string, industry_key string, is_fictional boolean, data_mode string")
    rel = spark.createDataFrame([("COMPANY", "c", "SUPPLIES", "COMPANY", "d", "DEMO")], "source_type string, source_key string, relationship string, target_type string, target_key string, data_mode string")
    stored = {"industries": ind.limit(0), "companies": comp.limit(0), "relationships": rel.limit(0)}
    assert {k: v.count() for k, v in readers.seed(ind, comp, rel, stored).items()} == {"industries": 2, "companies": 1, "relationships": 1}
    for bad in ((ind, comp.withColumn("is_fictional", F.lit(False)), rel), (ind.withColumn("data_mode", F.lit("LIVE")), comp, rel), (ind.filter("key = 'b'"), comp, rel)):
        with pytest.raises(ValueError):
            readers.seed(*bad, stored)


def test_a_run_is_seen_whole_and_reset_is_refused_in_production(spark, tmp_path):
    root = str(tmp_path / "w")
    readers.write_run({"t": spark.range(3)}, root, "r1")
    readers.write_run({"t": spark.range(5)}, root, "r2")
    assert readers.read_run(spark, root, "t").count() == 5
    with pytest.raises(PermissionError):
        readers.reset(spark, root, "production")
    readers.reset(spark, root, "development")
    assert not (tmp_path / "w").exists()


def test_upserts_keep_what_is_stored(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, first string")
    new = spark.createDataFrame([("b", 9, "z"), ("c", 3, None)], "k string, v int, first string")
    got = sorted(tuple(r) for r in formation.upsert(old, new, ["k"], kept=("first",)).collect())
    assert got == [("a", 1, "x"), ("b", 9, "y"), ("c", 3, None)]
