"""Independent DuckDB forms of the queries of ``catalog_views``."""

from __future__ import annotations

from driftline import catalog as C
from driftline import catalog_views as V
from driftline import oracles as O
from driftline.oracles import EV, arr, lit, profile, values
from driftline.plans import definitions as D
from driftline.plans.vocab import CAPABILITIES, DIMENSIONS, PRIMARY_CLASSES, SOURCE_CLASSES

N = "CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER)"
MV = EV.replace("ev AS (", "ev0 AS (", 1) + f""", ev AS (SELECT event_id, evidence_id, cluster_id, {arr(V.TYPES)}[event_id // 3 % {len(V.TYPES)} + 1] AS event_type, {arr(V.SUBJECTS)}[event_id % 3 + 1] AS subject, t, k,
    round(magnitude * CASE WHEN t >= TIMESTAMP '{V.RISE}' THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END, 6) AS magnitude, confidence, source_class, source_quality, is_primary, data_mode, event_id % 200 AS document_id FROM ev0)"""
SRC = f"""src AS (SELECT DISTINCT source AS source_key, 'Source ' || {N} AS source_name, 'House ' || {N} % 4 AS publisher, 'NEWS' AS source_type, {arr(SOURCE_CLASSES)}[{N} % 9 + 1] AS source_class, 40 + 10 * ({N} % 7) AS source_quality,
    {N} % 2 = 1 AS is_synthetic_source FROM documents WHERE {N} % 5 <> 0)"""
PAPERS = """papers AS (SELECT doc_id AS document_id, source AS source_key, substring(text, 1, 30) AS document_title, 'https://h.invalid/' || doc_id AS document_url, doc_id % 3 = 0 AS event_at_inferred,
    CASE WHEN doc_id % 2 = 0 THEN 'ORIGIN' ELSE 'NEAR_DUPLICATE' END AS cluster_method FROM documents WHERE doc_id < 200)"""
KEY = "cluster_id || ':' || event_type || ':' || subject || ':' || CAST(t AS DATE)"
BUILT = f"{MV}, br AS (SELECT {KEY} AS dedupe_key, evidence_id, document_id, subject, cluster_id, t FROM ev), {PAPERS}, {SRC}"
TREND = O.TREND.replace(EV, MV).replace(values(C.WEIGHTS, "signal, subject, event_type, weight"), values(D.SIGNALS, "signal, subject, event_type, weight")) + ", named AS (SELECT * FROM trend JOIN (SELECT DISTINCT signal, subject FROM w) USING (signal))"
FORMED = f"""{TREND.replace('WITH ', 'WITH RECURSIVE ', 1)}, active AS (SELECT *, round(abs(acceleration) / 100 * observation_strength / 100, 6) AS aw FROM named WHERE acceleration >= 20 AND independent_sources >= 2),
  adj AS {values(D.SUBJECT_ADJACENCY, 'a, b')}, node AS (SELECT DISTINCT subject AS node FROM active),
  reach AS (SELECT node AS a, node AS b FROM node UNION SELECT r.a, j.b FROM reach r JOIN adj j ON j.a = r.b WHERE j.b IN (SELECT node FROM node)), comp AS (SELECT a AS subject, min(b) AS component FROM reach GROUP BY a),
  sets AS (SELECT component, list_sort(list(DISTINCT subject)) AS subjects, string_agg(signal || ':' || CAST(round(aw * 1000) AS BIGINT), ' ' ORDER BY signal) AS signals FROM active JOIN comp USING (subject) GROUP BY component),
  tp AS {values([(o, g, n, '|'.join(x)) for o, g, n, x in D.THEME_TEMPLATES], 'ord, slug, name, need')},
  fit AS (SELECT component, arg_max(struct_pack(slug := slug, name := name), (len(string_split(need, '|')), -ord)) AS t FROM sets JOIN tp ON list_has_all(subjects, string_split(need, '|')) GROUP BY component),
  formed AS (SELECT coalesce(t.slug, replace(array_to_string(subjects, '-'), '_', '-') || '-change') AS slug, t.name AS name, subjects, signals FROM sets LEFT JOIN fit USING (component))"""


def _search(queries: str) -> str:
    """CTE scored(query_id, hits, doc_id, score, at) for queries (query_id, text, terms, subject, hits, until)."""
    t = lambda x: O.TOKENS.format(t=x)
    return f"""q AS {queries}, dw AS (SELECT doc_id, lang, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS happened, unnest(list_distinct({t('substring(text, 1, 40)')} || {t('text')})) AS token FROM documents),
      want AS (SELECT query_id, subject, hits, until, unnest(list_distinct({t('text')} || list_transform(string_split(terms, '|'), lambda x: lower(x)))) AS token FROM q),
      scored AS (SELECT query_id, hits, doc_id, happened, count(*) + CASE WHEN subject = lang THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM dw JOIN want USING (token) WHERE until IS NULL OR happened <= CAST(until AS TIMESTAMP) GROUP BY query_id, hits, doc_id, happened, lang, subject),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, happened, doc_id)::INTEGER AS rank, count(*) OVER (PARTITION BY query_id) > hits AS truncated FROM scored)"""


_WALK_EDGES = (
    O.WALK_EDGES.replace("'DIRECT_BENEFICIARY' AS role FROM nation JOIN per", "'DIRECT_BENEFICIARY' AS role, 'DRIVES_DEMAND_FOR' AS rel, 'forward' AS dir, round(0.5 + 0.5 / k, 4) AS ew FROM nation JOIN per")
    .replace("0.8, 'DIRECT_BENEFICIARY' FROM supplier", "0.8, 'DIRECT_BENEFICIARY', 'PRODUCES', 'reverse', round(0.5 + (s_suppkey % 50) / 100.0, 4) FROM supplier")
    .replace("0.7, 'CUSTOMER' FROM top", "0.7, 'CUSTOMER', 'BUYS_FROM', 'reverse', round(b / total, 4) FROM top")
    .replace("r_name AS path FROM region", "r_name AS path, r_name AS trail, '' AS hopped FROM region")
)
_ARROW = "CASE WHEN dir = 'forward' THEN '->' ELSE '<-' END"


def _hop(k: int) -> str:
    more = f", trail || ' ' || {_ARROW} || '[' || rel || ']' || {_ARROW} || ' ' || tk AS trail, trim(hopped || ' ' || fk || '/' || rel || '/' || dir || '/' || tk || '/' || CAST(round(ew * 10000) AS BIGINT)) AS hopped"
    return O._hop(k).replace("path := path)", "path := path, trail := trail, hopped := hopped)").replace("path || ' > ' || tk AS path", "path || ' > ' || tk AS path" + more)


WALK = f"{_WALK_EDGES}, {', '.join(_hop(k) for k in range(1, 5))}, walk AS (SELECT * FROM h0 {' '.join(f'UNION ALL SELECT ty, ky, r.* FROM h{k}' for k in range(1, 5))})"
EXPOSED = f"""{WALK}, ex AS (SELECT ky AS company_key, role, least(5, greatest(1, hops)) AS order_of_effect, round(least(100, greatest(0, 100 * round(weight, 9))), 2) AS exposure_score, round(confidence * 100, 2) AS confidence_pct, trail, hopped FROM walk WHERE ty = 'COMPANY' AND role IS NOT NULL),
  tex AS (SELECT 'growth' AS theme, * FROM ex UNION ALL SELECT 'operations', * FROM ex WHERE order_of_effect = 1)"""
AWARE = "CASE WHEN mainstream_share >= 0.65 AND market_reaction THEN 'CROWDED' WHEN mainstream_share >= 0.45 THEN 'CONSENSUS' WHEN mainstream_share >= 0.25 OR market_reaction THEN 'DEVELOPING' WHEN mainstream_share > 0 THEN 'EMERGING' ELSE 'UNKNOWN' END"
RANK = "CASE data_mode WHEN 'UNAVAILABLE' THEN 0 WHEN 'DEMO' THEN 1 WHEN 'HISTORICAL' THEN 2 ELSE 3 END"
FINAL = f"""{O.SCORES}, {EXPOSED}, modes AS (SELECT theme, arg_min(data_mode, {RANK}) AS data_mode FROM ev JOIN (SELECT DISTINCT theme, subject FROM th) USING (subject) WHERE epoch_us({O.AS_OF} - t) BETWEEN 0 AND 7 * 86400000000 GROUP BY theme),
  final AS (SELECT metrics.*, wide.* EXCLUDE (theme), CASE WHEN data_mode = 'DEMO' THEN 'DEMO' ELSE 'UNAVAILABLE' END AS awareness_mode, {AWARE} AS market_awareness,
    {O.MATURITY.format(n='independent_sources', a='metrics.acceleration', m='mainstream_share', r='market_reaction', c='contradiction_ratio')} AS maturity,
    coalesce(c.n, 0) AS companies FROM metrics JOIN modes USING (theme) JOIN wide USING (theme) LEFT JOIN (SELECT theme, count(DISTINCT company_key) AS n FROM tex GROUP BY theme) c USING (theme))"""
QUESTIONS = [(o, d, p, c, q.replace("{p}", "memory").replace("{c}", "Maker (MKR), Toolco")) for o, d, p, c, q, _ in D.PLAN_QUESTIONS] + [(12, "DEMAND", 2, False, D.SIGNAL_QUESTION % ("memory_demand", 42, 6)), (12, "SUPPLY", 2, False, D.SIGNAL_QUESTION % ("memory_supply", 25, 4))]
WORDS = ("the and", "der|und", "que|les", "zzz", "thing whereas", "ontion|and", "yyy", "los|del")


def _lines() -> str:
    """CTE lines(theme, section, ord, text, claim_type, evidence)."""
    name = "upper(signal[1]) || replace(signal[2:], '_', ' ')"
    words = "lower(replace(role, '_', ' '))"
    union = " UNION ALL ".join
    section = "CASE WHEN independent_sources = 0 THEN 'research_gaps' WHEN stance = 'SUPPORTING' THEN 'supporting_evidence' WHEN stance = 'CONTRADICTING' THEN 'contradictory_evidence' ELSE 'contextual_findings' END"
    text = lambda s, *xs: f"printf({lit(s)}, {', '.join(xs)})"
    parts = [
        f"SELECT theme, 'what_changed' AS section, -acceleration AS o, {text(D.SIGNAL_CHANGED, name, 'observation_strength', 'baseline_strength', 'acceleration')} AS text, 'FACT' AS claim_type, 0 AS evidence FROM act",
        f"SELECT 'growth', 'what_changed', 1000, {lit(D.STRONGEST)} || b.claim, b.claim_type, b.ids FROM (SELECT arg_max(struct_pack(claim := claim, claim_type := claim_type, ids := ids), (independent_sources, -ord)) AS b FROM fo WHERE stance = 'SUPPORTING' HAVING count(*) > 0)",
        f"SELECT theme, 'why_it_matters', 0, {text(D.ORDERS, 'n1', 'n2')}, 'INFERENCE', 0 FROM (SELECT theme, count(*) FILTER (order_of_effect = 1) AS n1, count(*) FILTER (order_of_effect > 1) AS n2 FROM tex GROUP BY theme)",
        f"SELECT theme, 'why_it_matters', 1, {text(D.INDIRECT, 'b.company_key', 'b.w', 'b.o', 'b.trail')}, 'INFERENCE', 0 FROM (SELECT theme, arg_max(struct_pack(company_key := company_key, w := {words}, o := order_of_effect, trail := trail), (exposure_score, company_key)) AS b FROM tex WHERE order_of_effect > 1 GROUP BY theme)",
        f"SELECT theme, 'why_now', 0, {text(D.RATES, name, 'orate', 'brate')}, 'FACT', 0 FROM fast",
        f"SELECT theme, 'why_now', 1, {text(D.BREADTH, 'independence_change')}, 'FACT', 0 FROM fast",
        f"SELECT theme, 'why_now', 2, {text(D.STAGE, 'maturity')}, 'INFERENCE', 0 FROM final JOIN fast USING (theme)",
        f"SELECT 'growth', {section}, -independent_sources + ord / 100, claim, CASE WHEN independent_sources = 0 THEN 'FACT' ELSE claim_type END, ids FROM fo",
        f"SELECT theme, 'companies_exposed', 0, company_key, 'INFERENCE', 0 FROM tex",
        f"SELECT theme, 'market_awareness', 0, {text(D.AWARENESS_ESTIMATE, 'market_awareness')}, 'INFERENCE', 0 FROM final",
        f"SELECT theme, 'market_awareness', 1, {lit(D.NO_MARKET_DATA % 'no provider')}, 'FACT', 0 FROM final",
        "SELECT 'growth', 'market_awareness', 2, claim, claim_type, 0 FROM fo WHERE dimension = 'MARKET_EXPECTATIONS'",
        f"SELECT theme, 'invalidation_conditions', 0, {text(D.FALLS, name, 'acceleration')}, 'HYPOTHESIS', 0 FROM act",
        f"SELECT theme, 'invalidation_conditions', 1, {lit(D.INVALIDATES)}, 'HYPOTHESIS', 0 FROM final",
        "SELECT theme, 'scores', 0, model, 'FACT', 0 FROM totals",
        f"SELECT theme, 'provenance', 0, {lit(D.DISCLAIMER)}, 'FACT', 0 FROM final",
    ]
    found = O._findings().removeprefix(f"WITH {EV}, ")
    for old in ("br", "kinds", "per", "p", "al"):  # these names are taken
        for a, b in ((f"{old} AS (", f"f_{old} AS ("), (f"JOIN {old} USING", f"JOIN f_{old} USING"), (f"FROM {old} ", f"FROM f_{old} ")):
            found = found.replace(f"{old}.dimension", f"f_{old}.dimension") if old == "br" and a.startswith("br") else found
            found = found.replace(" " + a, " " + b) if a.endswith("(") else found.replace(a, b)
    return f"""{FINAL}, {found}, od AS {values(list(enumerate(DIMENSIONS)), 'ord, dimension')},
      ids AS (SELECT dimension, count(DISTINCT evidence_id) AS ids FROM rws GROUP BY dimension), fo AS (SELECT found.*, ord, coalesce(ids, 0) AS ids FROM found JOIN od USING (dimension) LEFT JOIN ids USING (dimension)),
      fast AS (SELECT theme, t.* FROM (SELECT theme, arg_max(struct_pack(signal := signal, orate := round(orate, 4), brate := round(brate, 4), independence_change := independence_change), (acceleration, signal)) AS t FROM act GROUP BY theme)),
      every AS ({union(parts)}), lines AS (SELECT theme, section, row_number() OVER (PARTITION BY theme, section ORDER BY o, text)::INTEGER AS ord, text, claim_type, evidence::BIGINT AS evidence FROM every)"""


def oracle_sql() -> dict[str, str]:
    kept = ", ".join(map(lit, ("what_changed", "why_it_matters", "why_now", "supporting_evidence", "contradictory_evidence", "contextual_findings", "research_gaps", "market_awareness", "invalidation_conditions", "provenance")))
    asked = [(o, d, p, f"q{o}", WORDS[o % len(WORDS)]) for o, d, p, *_ in D.PLAN_QUESTIONS]
    order = sorted(asked, key=lambda a: (a[2], a[1], a[3]))
    searches = values([(i, a[4].replace("|", " "), a[4], None, 10, None) for i, a in enumerate(order)], "query_id, text, terms, subject, hits, until")
    initcap = "array_to_string(list_transform(string_split(lower(r_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"
    said = "lower(replace(role, '_', ' '))"
    return {
        "keyword_search": f"WITH {_search(values([(i, t, '|'.join(x), s, n, '2024-01-01 12:00:00' if i == 1 else None) for i, t, x, s, n in V.SEARCHES], 'query_id, text, terms, subject, hits, until'))} SELECT query_id, doc_id, score, rank, truncated FROM ranked WHERE rank <= hits",
        "claim_entities": f"""WITH c AS ({O.claims("documents", C.DOC_RULES, C.DOC_SUBJECTS, C.DOC_STABLE, C.DOC_FORWARD)}),
            parts AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda x: x <> '') AS p FROM documents),
            s AS (SELECT doc_id, (unnest(range(1, len(p) + 1)) - 1)::INTEGER AS n, lower(trim(unnest(p))) AS low FROM parts),
            e AS (SELECT DISTINCT c.doc_id, c.n, CASE {' '.join(f"WHEN contains(low, {lit(a)}) THEN {lit(b)}" for a, b in V.ENTITIES)} END AS entity FROM c JOIN s ON s.doc_id = c.doc_id AND s.n = c.n)
          SELECT * FROM e WHERE entity IS NOT NULL""",
        "document_lookup": "SELECT doc_id AS document_id, source, lang FROM documents WHERE doc_id = 7",
        "recent_documents": "SELECT doc_id AS document_id, source FROM documents ORDER BY doc_id DESC LIMIT 25",
        "capability_split": f"SELECT CASE WHEN {N} % 5 IN (1, 3, 4) THEN 'FILINGS' ELSE 'NEWS_SEARCH' END AS capability, count(*) AS n_documents, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1",
        "allowed_urls": "SELECT page_id, coalesce(regexp_matches(url, '^https://(data\\.example\\.org|m\\.ththth\\.example\\.net|therha\\.example\\.com)([/?#]|$)'), FALSE) AS allowed FROM pages",
        "filings_search_inline": "SELECT external_id, published, 4::BIGINT AS found, TRUE AS truncated, 2::BIGINT AS failed FROM (VALUES ('sec:0000000042:0000-24-3', '2024-03-05'), ('sec:0000000046:0001-24-3', '2024-03-05'), ('sec:0000000042:0000-24-1', '2024-02-01'), ('sec:0000000046:0001-24-1', '2024-02-01')) v(external_id, published) ORDER BY published DESC, external_id LIMIT 3",
        "evidence_provenance": f"""WITH {MV}, {PAPERS}, {SRC}, cl AS (SELECT cluster_id, min(document_id) AS origin, count(*) AS n FROM ev GROUP BY ALL),
            items AS (SELECT *, CASE WHEN k % 4 <> 0 THEN cluster_id END AS c FROM ev WHERE subject IN ('memory', 'ai_infrastructure'))
          SELECT evidence_id AS id, event_type AS claim, event_type || ' ' || subject AS excerpt, confidence, event_type, 'POSITIVE' AS direction, subject AS subject_key, lower(event_type) AS rule_key, 'rules' AS extracted_by, '1' AS extractor_version, data_mode,
            epoch_us(t) AS event_at, epoch_us(t) AS published_at, epoch_us(t) AS retrieved_at, CAST(i.c AS VARCHAR) AS cluster_id, event_at_inferred, i.document_id, document_title, document_url, cluster_method, s.source_key, source_name, publisher, source_type, s.source_class, s.source_quality,
            is_synthetic_source, coalesce(cl.origin = i.document_id, FALSE) AS is_cluster_origin, coalesce(cl.n, 1) AS cluster_size
          FROM items i JOIN papers p ON p.document_id = i.document_id JOIN src s ON s.source_key = p.source_key LEFT JOIN cl ON cl.cluster_id = i.c ORDER BY t DESC, evidence_id LIMIT {V.PROVENANCE_LIMIT}""",
        "event_bridge": f"WITH {BUILT} SELECT dedupe_key, evidence_id FROM br",
        "event_build_new": f"WITH {BUILT} SELECT dedupe_key, count(*) AS n_evidence FROM br GROUP BY dedupe_key HAVING count(*) > 1",
        "event_quality": f"WITH {BUILT} SELECT dedupe_key, max(source_quality) AS quality, count(*) AS n_evidence FROM br JOIN papers USING (document_id) JOIN src USING (source_key) GROUP BY dedupe_key",
        "theme_window_profile": f"""WITH {BUILT}, happened AS (SELECT dedupe_key FROM br GROUP BY dedupe_key HAVING min(t) BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-24'),
            rows_ AS (SELECT subject, cluster_id, evidence_id, source_class, source_quality, source_class IN ({', '.join(map(lit, PRIMARY_CLASSES))}) AS is_primary FROM happened JOIN br USING (dedupe_key) JOIN papers USING (document_id) JOIN src USING (source_key)),
            p AS ({profile('rows_', 'subject')}), e AS ({O.entropy('rows_', 'subject')})
          SELECT subject, evidence_count, independent_sources, round(source_diversity, 3) AS source_diversity, round(primary_ratio, 3) AS primary_ratio, round(avg_quality, 3) AS avg_quality, round(amplification, 3) AS amplification FROM p JOIN e USING (subject)""",
        "signal_bucket_contributions": f"""WITH {EV}, {O.CONTRIB}, s AS (SELECT signal, bucket, cluster_id, arg_max(struct_pack(g := signed, e := event_id, q := source_quality), (abs(signed), -event_id)) AS c, count(*) AS n FROM placed GROUP BY ALL)
          SELECT signal, bucket, count(*) AS n, string_agg(cluster_id || ':' || CAST(round(c.g * 10000) AS BIGINT) || ':' || c.e || ':' || c.q || ':' || n, ' ' ORDER BY cluster_id) AS contributions FROM s GROUP BY ALL""",
        "builtin_signal_trends": f"{TREND} SELECT signal, subject, round(acceleration, 2) AS acceleration, round(observation_strength, 2) AS observation_strength, independent_sources, direction FROM named",
        "trend_upsert": f"{TREND} SELECT signal, {lit(C.GRID.as_of)} AS observation_end, '1' AS version, round(acceleration, 2) AS acceleration, 'new' AS written FROM named UNION ALL SELECT * FROM (VALUES ('memory_pricing', '2024-01-30 00:00:00', '1', 2.5::DOUBLE, 'old'), ('gone', {lit(C.GRID.as_of)}, '1', 3.5::DOUBLE, 'old'))",
        "theme_formation": f"{FORMED} SELECT slug, coalesce(name, {lit(D.GENERATED_NAME)} || array_to_string(list_transform(subjects, lambda s: array_to_string(list_transform(string_split(s, '_'), lambda x: upper(x[1]) || x[2:]), ' ')), ', ')) AS name, array_to_string(subjects, ',') AS subjects, signals FROM formed",
        "theme_generated_names": "SELECT * FROM (VALUES ('semiconductor-equipment-change', 'Emerging change: Semiconductor Equipment', 'a'), ('logistics-change', 'Emerging change: Logistics', 'b')) v(slug, name, signals)",
        "theme_anchors": f"{FORMED}, an AS {values(D.SUBJECT_ANCHORS, 'subject, entity_type, entity_key, weight')} SELECT slug, entity_type, entity_key, weight FROM (SELECT slug, unnest(subjects) AS subject FROM formed) JOIN an USING (subject)",
        "theme_finalised": f"{FINAL} SELECT theme, maturity, market_awareness, awareness_mode, round(trend, 1) AS trend, round(opportunity, 1) AS opportunity, round(confidence, 1) AS confidence, companies FROM final",
        "score_explained": f"{O.SCORES} SELECT theme, model, key, round(round(value, 4), 1) AS raw, round(normalized, 1) AS normalized, available, replace(key, '_', ' ') || CASE WHEN available THEN ' measured from the theme''s own evidence' ELSE ' has no source in this corpus; its weight goes to the other components' END AS explanation FROM sc LEFT JOIN all_given USING (theme, model, key)",
        "score_view": f"{O.SCORES} SELECT theme, model, sum(weight) FILTER (available) > 0 AS is_computable, count(*) AS n, string_agg(key || '=' || CAST(round(contribution) AS BIGINT), ';' ORDER BY key) AS components FROM sc GROUP BY ALL",
        "theme_detail": f"""{FINAL}, t AS (SELECT theme, max(acceleration) AS top, string_agg(signal, ',' ORDER BY acceleration DESC, signal) AS signals FROM act GROUP BY theme), c AS (SELECT theme, arg_max(company_key, (exposure_score, company_key)) AS top_company FROM tex GROUP BY theme)
          SELECT theme, final.evidence_count, final.independent_sources, round(round(amplification, 6), 4) AS amplification, round(contradiction_ratio, 4) AS contradiction_ratio, round(trend, 1) AS trend, round(top, 2) AS top_acceleration, signals, companies, top_company FROM final JOIN mp USING (theme) JOIN t USING (theme) JOIN c USING (theme)""",
        "research_trace": f"""WITH {EV}, run AS (SELECT subject AS theme, event_id AS run_id, t, cluster_id FROM ev WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY subject ORDER BY t DESC, event_id) = 1)
          SELECT theme, run_id, 'SUCCEEDED' AS status, epoch_us(t) AS started_at, (SELECT count(*) FROM ev WHERE event_type = 'error' AND ev.cluster_id = run.cluster_id) AS questions, (SELECT count(*) FROM ev WHERE event_type = 'click' AND ev.cluster_id = run.cluster_id) AS searches,
            coalesce((SELECT sum(k % 3) FROM ev WHERE event_type = 'click' AND ev.cluster_id = run.cluster_id), 0)::BIGINT AS new_documents, (SELECT epoch_us(max(t)) FROM ev WHERE event_type = 'click' AND ev.cluster_id = run.cluster_id) AS last_search FROM run""",
        "research_hypotheses": f"SELECT lower(r_name) AS theme, CASE lower(r_name) WHEN 'asia' THEN 'Open one' WHEN 'africa' THEN 'Stated by a template' ELSE {initcap} || {lit(D.GENERAL_HYPOTHESIS.removeprefix('%s'))} END AS statement, 'OPEN' AS status, lower(r_name) <> 'asia' AS created FROM region",
        "plan_input": f"""{FINAL}, s AS (SELECT theme, string_agg(signal || ':' || CAST(round(acceleration) AS BIGINT) || ':' || independent_sources, ' ' ORDER BY signal) AS signals FROM act GROUP BY theme),
            c AS (SELECT theme, count(*) AS n, arg_min(s_name, (-exposure_score, company_key)) AS f FROM tex JOIN supplier ON company_key = 's' || s_suppkey GROUP BY theme)
          SELECT theme, name, signals, n AS n_companies, f AS first_company FROM (VALUES ('growth', 'Growth'), ('operations', 'Operations')) v(theme, name) JOIN s USING (theme) JOIN c USING (theme)""",
        "plan_first_questions": f"SELECT dimension, arg_min(question, (priority, ord)) AS question, min(priority) AS priority, count(*) AS n_questions FROM {values(QUESTIONS, 'ord, dimension, priority, counter, question')} GROUP BY dimension",
        "plan_summary": f"SELECT 'ai-memory-demand' AS theme, count(*) AS questions, count(*) FILTER (counter) AS counter_evidence, string_agg(DISTINCT dimension, ',' ORDER BY dimension) AS dimensions FROM {values(QUESTIONS, 'ord, dimension, priority, counter, question')}",
        "exposure_finding": f"""WITH {EXPOSED}, r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY exposure_score DESC, company_key) AS rk, count(*) OVER (PARTITION BY theme) AS n FROM tex)
          SELECT theme, any_value(n) || ' companies map to this theme through the value chain: ' || string_agg(company_key || ' (' || {said} || ', order ' || order_of_effect || ', exposure ' || CAST(round(exposure_score) AS BIGINT) || ')', '; ' ORDER BY rk) || '.' AS claim,
            round(least(1, max(confidence_pct) / 100), 3) AS confidence, count(*) AS independent_sources, 'SUPPORTING' AS stance, 'INFERENCE' AS claim_type FROM r WHERE rk <= 5 GROUP BY theme""",
        "finding_evidence": f"{O._findings()} SELECT dimension, evidence_id FROM rws",
        "research_searches": f"""WITH {_search(searches)}, found AS (SELECT * FROM ranked WHERE rank <= 10), firsts AS (SELECT doc_id, min(query_id) AS f FROM found GROUP BY doc_id), o AS {values([(i, a[1]) for i, a in enumerate(order)], 'n, dimension')}
          SELECT n, dimension, count(f.doc_id)::INTEGER AS result_count, count(f.doc_id) FILTER (x.f = n)::INTEGER AS new_count FROM o LEFT JOIN found f ON f.query_id = n LEFT JOIN firsts x USING (doc_id) GROUP BY n, dimension""",
        "exposure_rationale": f"WITH {EXPOSED} SELECT company_key, trail AS rationale, hopped AS hops FROM ex",
        "cluster_rebuild": f"""WITH RECURSIVE {O.ANCESTRY} SELECT cluster_key, NULL::VARCHAR AS label, count(*) AS members, epoch_us(min(event_at)) AS first_seen, epoch_us(max(event_at)) AS last_seen, arg_min(['LIVE', 'HISTORICAL', 'DEMO', 'UNAVAILABLE'][doc_id % 4 + 1], [3, 2, 1, 0][doc_id % 4 + 1]) AS data_mode,
            min(doc_id) FILTER (method = 'ORIGIN') AS origin_document_id, CAST(substring(cluster_key, 9) AS BIGINT) % 3 <> 0 AS created FROM assigned JOIN docs USING (doc_id) GROUP BY cluster_key""",
        "evidence_restamped": f"WITH RECURSIVE {MV}, {O.ANCESTRY} SELECT evidence_id, a.cluster_key, a.method AS cluster_method FROM ev LEFT JOIN assigned a ON a.doc_id = ev.document_id",
        "ingest_totals": "SELECT o_orderstatus, coalesce(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END), 0)::BIGINT AS documents_created, count(*) AS documents_seen FROM orders GROUP BY ALL",
        "provider_health": "SELECT * FROM "
        + values([(c, *{"NEWS_SEARCH": ("corpus", True, "DEMO", "a synthetic corpus", False), "FILINGS": ("elsewhere", False, "UNAVAILABLE", "no provider is known by the name 'elsewhere'", False)}.get(c, ("", False, "UNAVAILABLE", "no provider is configured", False))) for c in CAPABILITIES], "capability, provider, available, data_mode, detail, live_path_verified"),
        "market_snapshot": "SELECT company_key, NULL::DOUBLE AS price, 'UNAVAILABLE' AS data_mode, 'no market data provider is configured' AS detail FROM (VALUES ('s1'), ('s2')) v(company_key)",
        "seed_reference": "SELECT 'industries' AS table_name, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n_rows UNION ALL SELECT 'companies', count(*) FROM supplier UNION ALL SELECT 'relationships', 1",
        "report_lines": f"{_lines()} SELECT * FROM lines WHERE section IN ({kept})",
        "report_sections": f"{_lines()} SELECT theme, section, count(*) AS n_lines FROM lines GROUP BY ALL",
    }
