"""Independent DuckDB forms of the catalogue's queries, over the same tables."""

from __future__ import annotations

import re
import unicodedata

from driftline import catalog as C
from driftline.plans import definitions as D
from driftline.plans.vocab import DIMENSIONS, PRIMARY_CLASSES, SOURCE_CLASSES


def lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values(rows, columns: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({columns}))"


def arr(items) -> str:
    return "[" + ", ".join(map(lit, items)) + "]"


EV = f"""ev AS (
  SELECT event_id, event_id AS evidence_id, user_id AS cluster_id, event_type, {arr(C.SUBJECTS)}[event_id % 3 + 1] AS subject, ts AS t, k,
    round(least(1.0, value / 100), 6) AS magnitude, round(0.5 + (k % 50) / 100.0, 6) AS confidence, {arr(SOURCE_CLASSES)}[user_id % 9 + 1] AS source_class,
    CAST(40 + 10 * (user_id % 7) AS INTEGER) AS source_quality, {arr(SOURCE_CLASSES)}[user_id % 9 + 1] IN ({', '.join(map(lit, PRIMARY_CLASSES))}) AS is_primary,
    ['LIVE', 'HISTORICAL', 'DEMO', 'UNAVAILABLE'][k % 4 + 1] AS data_mode
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
#: The characters whose compatibility form has a letter or digit that the normal form keeps, found by rule. SQL composes canonically only.
_COMPAT = {c: f for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]) if (f := unicodedata.normalize("NFKC", c)) != c and re.search("[a-zA-Z0-9]", f)} | {"İ": "i̇"}
_FOLDED = f"array_to_string(list_transform(string_split(nfc_normalize(text), ''), lambda c: CASE WHEN contains({lit(''.join(_COMPAT))}, c) THEN map({arr(_COMPAT)}, {arr(_COMPAT.values())})[c] ELSE c END), '')"
NFKC = f"CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN nfc_normalize({_FOLDED}) ELSE text END"
NORMAL = f"trim(regexp_replace(regexp_replace(lower({NFKC}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
DOCS = f"""docs AS (
  SELECT doc_id, text, source, lang, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS event_at, 40 + 10 * (CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 7) AS quality,
    norm, sha256(norm) AS h FROM (SELECT *, {NORMAL} AS norm FROM documents))"""
SHINGLES = """sh AS (
  SELECT doc_id, norm, CASE WHEN norm = '' THEN [] WHEN len(w) < 5 THEN [norm] ELSE list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] FOR i IN range(1, len(w) - 3)]) END AS s
  FROM (SELECT doc_id, norm, string_split(norm, ' ') AS w FROM docs))"""
PAIRS = """x AS (SELECT doc_id, unnest(s) AS g FROM sh), n AS (SELECT doc_id, len(s) AS n FROM sh),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  pairs AS (SELECT a, b, c.c / (na.n + nb.n - c.c) AS j FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c.c / (na.n + nb.n - c.c) >= 0.6)"""
#: One document after the other, as the rule is stated: roots[i] is the number of the founder of document i's cluster.
ANCESTRY = f"""{DOCS}, {SHINGLES}, {PAIRS},
  numbered AS (SELECT *, row_number() OVER (ORDER BY event_at, doc_id) AS r FROM docs),
  first AS (SELECT h, min(r) AS f FROM numbered GROUP BY h),
  cand AS (SELECT nb.r, list(na.r) AS cands FROM (SELECT *, max(j) OVER (PARTITION BY b) AS best FROM pairs WHERE a IN (SELECT doc_id FROM numbered JOIN first ON r = f) AND b IN (SELECT doc_id FROM numbered JOIN first ON r = f))
    JOIN numbered na ON na.doc_id = a JOIN numbered nb ON nb.doc_id = b WHERE j = best GROUP BY nb.r),
  known AS (SELECT n.r, f, cands FROM numbered n JOIN first USING (h) LEFT JOIN cand ON cand.r = n.r),
  walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS roots UNION ALL
    SELECT k + 1, list_append(roots, CASE WHEN f < k + 1 THEN roots[f] WHEN cands IS NOT NULL THEN list_min(list_transform(cands, lambda c: roots[c])) ELSE k + 1 END) FROM walk JOIN known ON r = k + 1),
  tree AS (SELECT n.doc_id, o.doc_id AS root, CASE WHEN f < n.r THEN 'EXACT_HASH' WHEN cands IS NOT NULL THEN 'NEAR_DUPLICATE' ELSE 'ORIGIN' END AS method
    FROM numbered n JOIN known k ON k.r = n.r JOIN numbered o ON o.r = (SELECT roots FROM walk ORDER BY k DESC LIMIT 1)[n.r]),
  assigned AS (SELECT doc_id, 'cluster:' || root AS cluster_key, CASE WHEN doc_id = arg_min(doc_id, (event_at, -quality, doc_id)) OVER (PARTITION BY root) THEN 'ORIGIN' ELSE method END AS method FROM tree JOIN docs USING (doc_id))"""


def profile(source: str, by: str) -> str:
    """A query for the independence profile of `source` by the columns `by`."""
    return f"""SELECT {by}, sum(members)::BIGINT AS evidence_count, count(*) AS independent_sources, sum(source_quality) / count(*) AS avg_quality, avg(p::INT) AS primary_ratio,
      count(*) / sum(members) AS amplification, avg((source_class = 'FINANCIAL_MEDIA')::INT) AS mainstream
      FROM (SELECT {by}, cluster_id, arg_max(source_class, (source_quality, evidence_id)) AS source_class, max(source_quality) AS source_quality, bool_or(is_primary) AS p, count(*) AS members FROM {source} GROUP BY ALL) GROUP BY {by}"""


def entropy(source: str, by: str) -> str:
    return f"""SELECT {by}, least(1, greatest(0, -sum(n / t * ln(n / t)) / ln(9))) AS source_diversity FROM (SELECT *, sum(n) OVER (PARTITION BY {by}) AS t FROM
      (SELECT {by}, source_class, count(*) AS n FROM (SELECT {by}, cluster_id, arg_max(source_class, (source_quality, evidence_id)) AS source_class FROM {source} GROUP BY ALL) GROUP BY ALL)) GROUP BY {by}"""


GATE = "(CASE WHEN {n} <= 0 THEN 0 ELSE 1 - exp(-{n} / 2.5) END)"


def aggregated(name: str, source: str, by: str) -> str:
    """CTEs ending in `name`: strength, confidence and the rest for each set."""
    return f"""{name}_net AS (SELECT {by}, round(sum(signed), 6) AS net, sum(events)::BIGINT AS event_count FROM
      (SELECT {by}, cluster_id, arg_max(signed, (abs(signed), -event_id)) AS signed, count(*) AS events FROM {source} GROUP BY ALL) GROUP BY {by}),
    {name}_p AS ({profile(source, by)}), {name}_e AS ({entropy(source, by)}),
    {name} AS (SELECT *, round(100 * (1 - exp(-abs(net) / 50.0)), 4) AS strength,
      round(least(100, greatest(0, 100 * {GATE.format(n='independent_sources')} * (0.45 + 0.55 * (0.30 * round(source_diversity, 6) + 0.35 * round(primary_ratio, 6) + 0.35 * round(avg_quality, 6) / 100)))), 4) AS confidence,
      CASE WHEN net > 0.05 THEN 'POSITIVE' WHEN net < -0.05 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS direction FROM {name}_net JOIN {name}_p USING ({by}) JOIN {name}_e USING ({by}))"""


CONTRIB = f"""w AS {values(C.WEIGHTS, 'signal, subject, event_type, weight')},
  contrib AS (SELECT ev.*, w.signal, round(magnitude * confidence * source_quality / 100 * weight, 6) AS signed,
    CAST(ceil(epoch_us({AS_OF} - t) / 86400000000.0) - 1 AS INTEGER) AS bucket, epoch_us({AS_OF} - t) / 86400000000.0 AS age FROM ev JOIN w USING (subject, event_type)),
  placed AS (SELECT * FROM contrib WHERE bucket BETWEEN 0 AND 27)"""
SERIES = f"""WITH {EV}, {CONTRIB}, {aggregated('b', 'placed', 'signal, bucket')},
  series AS (SELECT s.signal, i.bucket::INTEGER AS bucket, coalesce(net, 0) AS net, coalesce(event_count, 0) AS event_count, coalesce(independent_sources, 0) AS independent_sources, coalesce(source_diversity, 0) AS source_diversity,
    coalesce(primary_ratio, 0) AS primary_ratio, coalesce(avg_quality, 0) AS avg_quality, coalesce(strength, 0) AS strength, coalesce(confidence, 0) AS confidence, coalesce(direction, 'NEUTRAL') AS direction
    FROM (SELECT DISTINCT signal FROM w) s CROSS JOIN (SELECT unnest(range(28)) AS bucket) i LEFT JOIN b ON b.signal = s.signal AND b.bucket = i.bucket)"""


def change(o: str, b: str, floor: float) -> str:
    return f"round(100 * tanh(({o} - {b}) / greatest({b}, {floor})), 4) + 0.0"


TREND = f"""{SERIES},
  parted AS (SELECT *, CASE WHEN age > 0 AND age <= 7 THEN 'obs' WHEN age > 7 AND age <= 28 THEN 'base' END AS part FROM contrib),
  windowed AS (SELECT * FROM parted WHERE part IS NOT NULL), {aggregated('lv', 'windowed', 'signal, part')},
  r AS (SELECT signal, round(coalesce(avg(strength) FILTER (bucket < 7), 0), 6) AS om, round(coalesce(avg(strength) FILTER (bucket >= 7), 0), 6) AS bm,
    coalesce(sum(event_count) FILTER (bucket < 7), 0) / 7.0 AS orate, coalesce(sum(event_count) FILTER (bucket >= 7), 0) / 21.0 AS brate,
    coalesce(sum(independent_sources) FILTER (bucket < 7), 0) / 7.0 AS oi, coalesce(sum(independent_sources) FILTER (bucket >= 7), 0) / 21.0 AS bi,
    count(*) FILTER (bucket < 7 AND direction = 'POSITIVE') AS up, count(*) FILTER (bucket < 7 AND direction = 'NEGATIVE') AS down FROM series GROUP BY signal),
  trend AS (SELECT r.signal, {change('om', 'bm', 8.0)} AS acceleration, {change('orate', 'brate', 0.05)} AS frequency_change, {change('oi', 'bi', 0.05)} AS independence_change,
    coalesce(o.strength, 0) AS observation_strength, coalesce(bs.strength, 0) AS baseline_strength, coalesce(o.independent_sources, 0) AS independent_sources, orate, brate,
    CASE WHEN up > down THEN 'POSITIVE' WHEN down > up THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS direction
    FROM r LEFT JOIN lv o ON o.signal = r.signal AND o.part = 'obs' LEFT JOIN lv bs ON bs.signal = r.signal AND bs.part = 'base')"""
METRICS = f"""{TREND}, th AS {values(C.THEMES, 'theme, signal, subject')},
  act AS (SELECT th.theme, th.subject, trend.*, round(abs(acceleration) / 100 * observation_strength / 100, 6) AS weight FROM trend JOIN th USING (signal) WHERE acceleration >= -100 AND independent_sources >= 2),
  signs AS (SELECT theme, w.event_type, sum(w.weight) AS sign FROM act JOIN w USING (signal) GROUP BY ALL),
  mrows AS (SELECT a.theme, ev.*, signs.sign FROM ev JOIN (SELECT DISTINCT theme, subject FROM act) a USING (subject) LEFT JOIN signs ON signs.theme = a.theme AND signs.event_type = ev.event_type
    WHERE epoch_us({AS_OF} - t) / 86400000000.0 BETWEEN 0 AND 7),
  sides AS (SELECT theme, count(DISTINCT cluster_id) FILTER (sign > 0 AND event_type <> 'view') AS supporting, count(DISTINCT cluster_id) FILTER (sign < 0 AND event_type <> 'view') AS contradicting, bool_or(event_type = 'view') AS market_reaction FROM mrows GROUP BY theme),
  mp AS ({profile('mrows', 'theme')}), me AS ({entropy('mrows', 'theme')}),
  means AS (SELECT theme, round(sum(observation_strength * weight) / coalesce(nullif(sum(weight), 0), 1), 4) AS strength, round(sum(acceleration * weight) / coalesce(nullif(sum(weight), 0), 1), 4) AS acceleration,
    round(sum(frequency_change * weight) / coalesce(nullif(sum(weight), 0), 1), 4) AS frequency_change FROM act GROUP BY theme),
  metrics AS (SELECT theme, strength, acceleration, frequency_change, supporting, contradicting, market_reaction, independent_sources, evidence_count, round(source_diversity, 6) AS source_diversity, round(primary_ratio, 6) AS primary_ratio,
    round(avg_quality, 6) AS avg_quality, round(mainstream, 4) AS mainstream_share, CASE WHEN supporting + contradicting > 0 THEN round(contradicting / (supporting + contradicting), 4) ELSE 0 END AS contradiction_ratio,
    round(100 * greatest(0, 1 - (0.65 * round(mainstream, 4) + CASE WHEN market_reaction THEN 0.35 ELSE 0 END)), 4) AS novelty FROM means JOIN sides USING (theme) JOIN mp USING (theme) JOIN me USING (theme))"""
MATURITY = """CASE WHEN {c} >= 0.6 AND {n} >= 4 THEN 'INVALIDATED' WHEN {n} < 2 THEN 'INVISIBLE' WHEN {m} >= 0.65 AND {r} THEN 'CROWDED' WHEN {m} >= 0.45 THEN 'CONSENSUS'
  WHEN {a} >= 25 AND {n} >= 5 THEN 'ACCELERATING' WHEN {n} >= 4 THEN 'DEVELOPING' WHEN {a} <= 5 THEN 'MATURE' ELSE 'EMERGING' END"""
_SAT = "round(100 * (1 - exp(-independent_sources / 4.0)), 4)"
_G = GATE.format(n="independent_sources")
_COMPONENTS = (
    ("trend", "signal_strength", "strength"), ("trend", "signal_acceleration", "(acceleration + 100) / 2"), ("trend", "evidence_diversity", "source_diversity * 100"), ("trend", "novelty", "novelty"), ("trend", "company_exposure", "50.0"),
    ("opportunity", "trend_strength", "strength"), ("opportunity", "trend_acceleration", "(acceleration + 100) / 2"), ("opportunity", "company_exposure", "50.0"),
    ("opportunity", "evidence_quality", f"round(0.5 * {_SAT} + 0.3 * avg_quality + 0.2 * 100 * primary_ratio, 4)"), ("opportunity", "novelty", "novelty"),
    ("confidence", "independent_sources", _SAT), ("confidence", "source_quality", f"avg_quality * {_G}"), ("confidence", "primary_ratio", f"primary_ratio * 100 * {_G}"),
    ("confidence", "source_diversity", f"source_diversity * 100 * {_G}"), ("confidence", "contradiction_balance", f"100 * (1 - contradiction_ratio) * {_G}"),
)
_SPEC = values([(m, k, float(w)) for m, parts in D.SCORE_MODELS.items() for k, w in parts], "model, key, weight")


def _scored(name: str, source: str) -> str:
    return f"""{name}_c AS (SELECT t.theme, spec.model, spec.key, spec.weight, CASE WHEN v.value IS NOT NULL THEN round(least(100, greatest(0, v.value)), 4) END AS normalized, sum(CASE WHEN v.value IS NOT NULL THEN spec.weight ELSE 0 END) OVER (PARTITION BY t.theme, spec.model) AS cover
      FROM (SELECT DISTINCT theme, model FROM {source}) t JOIN spec USING (model) LEFT JOIN {source} v ON v.theme = t.theme AND v.model = spec.model AND v.key = spec.key),
    {name} AS (SELECT *, normalized IS NOT NULL AS available, CASE WHEN normalized IS NOT NULL THEN weight / cover ELSE 0 END AS effective, round(coalesce(normalized, 0) * CASE WHEN normalized IS NOT NULL THEN weight / cover ELSE 0 END, 4) AS contribution FROM {name}_c)"""


SCORES = f"""{METRICS}, spec AS {_SPEC}, given AS ({' UNION ALL '.join(f"SELECT theme, {lit(m)} AS model, {lit(k)} AS key, CAST({e} AS DOUBLE) AS value FROM metrics" for m, k, e in _COMPONENTS)}),
  conf AS (SELECT * FROM given WHERE model = 'confidence'), {_scored('cs', 'conf')},
  all_given AS (SELECT * FROM given UNION ALL SELECT theme, 'trend', 'confidence', round(least(100, greatest(0, sum(contribution))), 2) FROM cs GROUP BY theme), {_scored('sc', 'all_given')},
  totals AS (SELECT theme, model, round(least(100, greatest(0, sum(contribution))), 2) AS value, round(sum(weight) FILTER (available), 4) AS weight_coverage, coalesce(string_agg(key, ',' ORDER BY key) FILTER (NOT available), '') AS unavailable FROM sc GROUP BY ALL),
  wide AS (SELECT theme, max(value) FILTER (model = 'trend') AS trend, max(value) FILTER (model = 'opportunity') AS opportunity, max(value) FILTER (model = 'confidence') AS confidence FROM totals GROUP BY theme)"""


def claims(source: str, rules, lexicon, stable, forward) -> str:
    """Sentences by the splitting that needs no look-behind, then rules as rows."""
    rows = [r for r in D.rule_rows(rules)]
    rx = lambda ps: "|".join(f"(?:{p})" for p in ps)
    hits = [f"({' + '.join(f'contains(low, {lit(t)})::INT' for t in terms)})" for _, terms in lexicon]
    subject = " ".join(f"WHEN {h} = top THEN {lit(s)}" for (s, _), h in zip(lexicon, hits))
    return f"""WITH rules AS {values(rows, 'ord, rule_key, event_type, pattern, magnitude, confidence, claim')},
      parts AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda x: x <> '') AS p FROM {source}),
      s AS (SELECT doc_id, (unnest(range(1, len(p) + 1)) - 1)::INTEGER AS n, trim(unnest(p)) AS sentence FROM parts),
      ok AS (SELECT *, lower(sentence) AS low FROM s WHERE sentence <> '' AND NOT regexp_matches(sentence, {lit(rx(stable))}, 'is')),
      subj AS (SELECT *, greatest({', '.join(hits)}) AS top, regexp_matches(sentence, {lit(rx(forward))}, 'is') AS spec FROM ok),
      named AS (SELECT *, CASE WHEN top <= 0 THEN NULL {subject} END AS subject FROM subj),
      fired AS ({' UNION ALL '.join(f"SELECT doc_id, n, spec, subject, {o} AS ord FROM named WHERE regexp_matches(sentence, {lit(r)}, 'is')" for o, _, _, r, *_ in rows)}),
      one AS (SELECT f.*, r.* EXCLUDE (ord, pattern), row_number() OVER (PARTITION BY doc_id, n, r.event_type ORDER BY r.ord) AS rn FROM fired f JOIN rules r USING (ord)),
      three AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY ord) AS place FROM one WHERE rn = 1)
    SELECT doc_id, n, rule_key, CASE WHEN NOT spec THEN event_type END AS event_type, CASE WHEN spec THEN 'NEUTRAL' ELSE 'POSITIVE' END AS direction, CASE WHEN spec THEN 0.0::DOUBLE ELSE magnitude::DOUBLE END AS magnitude,
      CASE WHEN spec THEN round(confidence::DOUBLE * 0.7::DOUBLE, 3) ELSE confidence::DOUBLE END AS confidence, CASE WHEN spec THEN {lit(D.SPECULATIVE_PREFIX)} || lower(claim) ELSE claim END AS claim, subject, spec AS is_forward_looking FROM three WHERE place <= 3"""


TOKENS = "list_filter(list_distinct(regexp_extract_all(lower({t}), '[a-z0-9]+')), lambda x: length(x) > 2 AND NOT list_contains(" + arr(D.STOPWORDS) + ", x))"

WALK_EDGES = """per AS (SELECT n_regionkey, count(*) AS k FROM nation GROUP BY ALL),
  spent AS (SELECT o_custkey, l_suppkey, round(sum(l_extendedprice), 2) AS spent FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
  top AS (SELECT o_custkey, arg_max(l_suppkey, (spent, -l_suppkey)) AS s, max(spent) AS b, round(sum(spent), 2) AS total FROM spent GROUP BY ALL),
  e AS (SELECT 'INDUSTRY' AS ft, r_name AS fk, 'TECHNOLOGY' AS tt, n_name AS tk, round(0.5 + 0.5 / k, 4) * 1.0 AS f, 0.9 AS c, 'DIRECT_BENEFICIARY' AS role FROM nation JOIN per USING (n_regionkey) JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'TECHNOLOGY', n_name, 'COMPANY', 's' || s_suppkey, round(0.5 + (s_suppkey % 50) / 100.0, 4) * 1.0, 0.8, 'DIRECT_BENEFICIARY' FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT 'COMPANY', 's' || s, 'COMPANY', 'c' || o_custkey, round(b / total, 4) * 0.5, 0.7, 'CUSTOMER' FROM top),
  h0 AS (SELECT 'INDUSTRY' AS ty, r_name AS ky, round(1.0 - 0.1 * r_regionkey, 4)::DOUBLE AS weight, 1.0::DOUBLE AS confidence, 0 AS hops, NULL::VARCHAR AS role, r_name AS path FROM region WHERE r_regionkey < 2)"""


def _hop(k: int) -> str:
    return f"""h{k} AS (SELECT ty, ky, arg_min(r, (-r.weight, -r.confidence, r.path)) AS r FROM (SELECT ty, ky, struct_pack(weight := weight, confidence := confidence, hops := hops, role := role, path := path) AS r FROM
    (SELECT tt AS ty, tk AS ky, round(weight * f, 9) AS weight, round(confidence * c * 0.85, 9) AS confidence, hops + (tt = 'COMPANY')::INT AS hops, CASE WHEN tt = 'COMPANY' THEN e.role ELSE h.role END AS role, path || ' > ' || tk AS path
     FROM {'h0' if k == 1 else f'(SELECT ty, ky, r.* FROM h{k - 1})'} h JOIN e ON h.ty = e.ft AND h.ky = e.fk) WHERE weight >= 0.01 AND confidence >= 0.05) GROUP BY ty, ky)"""


#: This graph is a tree of levels, so no later hop can beat an earlier one.
WALK = f"""WITH {WALK_EDGES}, {', '.join(_hop(k) for k in range(1, 5))}, walk AS (SELECT * FROM h0 {' '.join(f'UNION ALL SELECT ty, ky, r.* FROM h{k}' for k in range(1, 5))})"""


def _findings() -> str:
    spec = arr(D.SPECULATIVE_DIMENSIONS)
    name = "lower(replace(dimension, '_', ' '))"
    return f"""WITH {EV}, e2 AS (SELECT * REPLACE (CASE WHEN k < 10 THEN NULL ELSE event_type END AS event_type) FROM ev), br AS {values(C.BRIDGE, 'dimension, event_type')},
      rws AS (SELECT e2.*, br.dimension FROM e2 JOIN br USING (event_type) UNION ALL SELECT e2.*, unnest({spec}) AS dimension FROM e2 WHERE event_type IS NULL),
      kinds AS (SELECT dimension, event_type, count(*) AS n FROM rws GROUP BY ALL),
      per AS (SELECT dimension, coalesce(sum(n) FILTER (event_type IN ({', '.join(map(lit, C.SUPPORTS))})), 0) AS supports, coalesce(sum(n) FILTER (event_type IS NOT NULL), 0) AS observed, coalesce(sum(n) FILTER (event_type IS NULL), 0)::BIGINT AS speculative,
        count(event_type) AS types, coalesce(string_agg(n || 'x ' || lower(replace(event_type, '_', ' ')), ', ' ORDER BY event_type) FILTER (event_type IS NOT NULL), '') AS breakdown FROM kinds GROUP BY dimension),
      p AS ({profile('rws', 'dimension')}), al AS {values([(d,) for d in DIMENSIONS], 'dimension')},
      found AS (SELECT dimension, CASE WHEN evidence_count IS NULL THEN 'NEUTRAL' WHEN dimension IN ('CONTRADICTORY_EVIDENCE', 'RISKS') THEN 'CONTRADICTING' WHEN dimension IN ('MARKET_EXPECTATIONS', 'HISTORICAL_ANALOGUE') THEN 'NEUTRAL'
          WHEN supports > observed - supports THEN 'SUPPORTING' WHEN observed - supports > supports THEN 'CONTRADICTING' ELSE 'NEUTRAL' END AS stance,
        CASE WHEN evidence_count IS NULL THEN 'FACT' WHEN observed = 0 THEN 'HYPOTHESIS' WHEN types > 1 THEN 'INFERENCE' ELSE 'FACT' END AS claim_type,
        CASE WHEN evidence_count IS NULL THEN 0.0 ELSE round(round(least(1, 0.25 * least(independent_sources, 4) + 0.3 * round(avg_quality, 6) / 100 * CASE WHEN independent_sources > 1 THEN 1.0 ELSE 0.5 END), 4), 3) END::DOUBLE AS confidence,
        coalesce(independent_sources, 0) AS independent_sources,
        CASE WHEN evidence_count IS NULL THEN 'No evidence addressing ' || {name} || ' was located in the available corpus for this window.'
          WHEN observed > 0 AND speculative > 0 THEN independent_sources || ' independent source(s) on ' || {name} || ': ' || breakdown || '; plus ' || speculative || ' forward-looking or historical statement(s).'
          WHEN observed > 0 THEN independent_sources || ' independent source(s) on ' || {name} || ': ' || breakdown || '.'
          ELSE speculative || ' forward-looking or historical statement(s) bear on ' || {name} || '; no observed event of this kind was recorded.' END AS claim
        FROM al LEFT JOIN per USING (dimension) LEFT JOIN p USING (dimension))"""


def _plan() -> str:
    rows = [(d, p, c, q.replace("{p}", "memory").replace("{c}", "Maker (MKR), Toolco"), "|".join(s).replace("{p}", "memory").replace("{c}", "Maker (MKR), Toolco")) for _, d, p, c, q, s in D.PLAN_QUESTIONS]
    full = values(rows, "dimension, priority, seeks_counter_evidence, question, terms")
    say = "'The ''' || signal || ''' signal is running ' || CAST(round(acceleration) AS BIGINT) || ' against its own baseline on ' || n || ' independent sources. What explains the change, and is it durable?'"
    need = ", ".join(map(lit, D.REQUIRED_DIMENSIONS))
    return f"""WITH f AS {full}, sig AS {values([("memory_demand", 42.0, 6), ("memory_pricing", 12.0, 3), ("memory_supply", 25.4, 4)], "signal, acceleration, n")},
      fast AS (SELECT CASE WHEN contains(signal, 'demand') THEN 'DEMAND' ELSE 'SUPPLY' END AS dimension, 2 AS priority, FALSE AS seeks_counter_evidence, {say} AS question, signal || '|memory' AS terms FROM sig WHERE acceleration >= 20),
      part AS (SELECT * FROM f WHERE dimension IN ('DEMAND', 'CAPACITY') UNION ALL SELECT * FROM fast WHERE TRUE)
    SELECT * FROM part UNION ALL SELECT * FROM f WHERE dimension IN ({need}) AND dimension NOT IN (SELECT dimension FROM part)"""


def oracle_sql() -> dict[str, str]:
    search = f"""{DOCS}, have AS (SELECT doc_id, event_at, unnest({TOKENS.format(t='text')}) AS token FROM docs)"""
    seg = "(independent_sources - segment % 10)"
    share = "round(round(mainstream, 4) * (1 + segment % 6), 4)"
    react = "(reaction AND segment % 2 = 0)"
    return {
        "trend_acceleration": f"{TREND} SELECT signal, round(acceleration, 2) AS acceleration, round(frequency_change, 2) AS frequency_change, round(independence_change, 2) AS independence_change, round(observation_strength, 2) AS observation_strength, round(baseline_strength, 2) AS baseline_strength, independent_sources, direction FROM trend ORDER BY acceleration DESC, signal",
        "doc_normalised_hash": f"WITH {DOCS} SELECT doc_id, h AS content_hash, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n_words FROM docs",
        "doc_ingest_dedupe": f"WITH {DOCS}, st AS (SELECT DISTINCT source, h FROM docs WHERE doc_id % 10 = 0), f AS (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) AS rn FROM docs) SELECT doc_id, source, h AS content_hash, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS word_count, TRUE AS event_at_inferred FROM f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM st WHERE st.source = f.source AND st.h = f.h)",
        "doc_exact_clusters": f"WITH {DOCS} SELECT h AS content_hash, arg_min(doc_id, (event_at, -quality, doc_id)) AS origin_id, count(*) AS members FROM docs GROUP BY h",
        "doc_shingle_counts": f"WITH {DOCS}, {SHINGLES} SELECT doc_id, len(s)::BIGINT AS n_shingles FROM sh",
        "doc_near_dup_pairs": f"WITH {DOCS}, {SHINGLES}, {PAIRS} SELECT a, b, round(j, 4) AS jaccard FROM pairs",
        "doc_ancestry_clusters": f"WITH RECURSIVE {ANCESTRY} SELECT doc_id, cluster_key, method FROM assigned",
        "ancestry_tie_inline": f"WITH RECURSIVE documents AS {values([(i, t, 'src0', 'en') for i, t in C.TIED], 'doc_id, text, source, lang')}, {ANCESTRY} SELECT doc_id::BIGINT AS doc_id, cluster_key, method FROM assigned",
        "normalise_inline": f"WITH documents AS {values([(i, t, 'src0', 'en') for i, t in C.ODD_TEXTS], 'doc_id, text, source, lang')}, {DOCS}, {SHINGLES} SELECT doc_id::BIGINT AS doc_id, norm, h AS content_hash, len(s)::BIGINT AS n_shingles FROM docs JOIN sh USING (doc_id, norm)",
        "doc_cluster_summary": f"WITH RECURSIVE {ANCESTRY} SELECT cluster_key, count(*) AS members, epoch_us(min(event_at)) AS first_seen, epoch_us(max(event_at)) AS last_seen, arg_min(['LIVE', 'HISTORICAL', 'DEMO', 'UNAVAILABLE'][doc_id % 4 + 1], [3, 2, 1, 0][doc_id % 4 + 1]) AS data_mode FROM assigned JOIN docs USING (doc_id) GROUP BY cluster_key",
        "sentence_split": "WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda x: x <> '') AS p FROM documents) SELECT doc_id, (unnest(range(1, len(p) + 1)) - 1)::INTEGER AS n, unnest(p) AS sentence FROM p",
        "claim_extract_inline": claims(values(C.CORPUS, "doc_id, text"), D.CLAIM_RULES, D.SUBJECT_LEXICON, D.STABILITY_PATTERNS, D.FORWARD_PATTERNS).replace("SELECT doc_id, n, rule_key", "SELECT doc_id::BIGINT AS doc_id, n, rule_key"),
        "claim_extract_documents": claims("documents", C.DOC_RULES, C.DOC_SUBJECTS, C.DOC_STABLE, C.DOC_FORWARD),
        "event_build": f"""WITH {EV}, g AS (SELECT cluster_id, event_type, subject, CAST(t AS DATE) AS day, arg_max(struct_pack(m := magnitude, c := confidence), (confidence, magnitude, -evidence_id)) AS b, count(*) AS n,
            arg_min('co' || (k % 7), evidence_id) FILTER (k % 10 = 0) AS entity, min(t) AS occurred, min(CASE data_mode WHEN 'UNAVAILABLE' THEN 0 WHEN 'DEMO' THEN 1 WHEN 'HISTORICAL' THEN 2 ELSE 3 END) AS r FROM ev GROUP BY ALL)
          SELECT cluster_id || ':' || event_type || ':' || subject || ':' || day AS dedupe_key, n AS n_evidence, b.m AS magnitude, least(1.0, round(b.c + least(0.1, 0.02 * (n - 1)), 4)) AS confidence, CASE WHEN entity IS NULL THEN 'INDUSTRY' ELSE 'COMPANY' END AS entity_type,
            coalesce(entity, subject) AS entity_key, epoch_us(occurred) AS occurred_us, ['UNAVAILABLE', 'DEMO', 'HISTORICAL', 'LIVE'][r + 1] AS data_mode FROM g""",
        "evidence_provenance_join": f"""WITH {EV}, src AS {values([(f'src{i}', SOURCE_CLASSES[i % 9], 40 + 10 * (i % 7)) for i in range(20) if i % 5], 'source, source_class, quality')}, e AS (SELECT event_id, event_type, cluster_id, event_id % 200 AS doc_id FROM ev),
            big AS (SELECT cluster_id, count(*) AS n FROM e GROUP BY ALL HAVING count(*) > 60)
          SELECT event_id, event_type, doc_id, d.source, coalesce(source_class, 'COMMUNITY') AS source_class, coalesce(quality, 50) AS quality, coalesce(n, 1) AS cluster_size FROM e JOIN documents d USING (doc_id) LEFT JOIN src ON src.source = d.source LEFT JOIN big USING (cluster_id)""",
        "token_search_topk": f"WITH {search}, want AS (SELECT unnest({TOKENS.format(t=lit(C.QUERY_TEXT))}) AS token), s AS (SELECT doc_id, event_at, count(*) AS score FROM have JOIN want USING (token) GROUP BY ALL) SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, event_at, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 20",
        "benchmark_token_overlap": f"WITH {search}, want AS (SELECT item_id, unnest({TOKENS.format(t='text')}) AS token FROM benchmark), s AS (SELECT item_id, doc_id, event_at, count(*) AS score FROM have JOIN want USING (token) GROUP BY ALL) SELECT item_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, event_at, doc_id) = 1",
        "independence_by_type": f"WITH {EV}, p AS ({profile('ev', 'event_type')}), e AS ({entropy('ev', 'event_type')}) SELECT event_type, evidence_count, independent_sources, round(round(source_diversity, 6), 5) AS source_diversity, round(round(primary_ratio, 6), 5) AS primary_ratio, round(round(avg_quality, 6), 4) AS avg_quality, round(round(amplification, 6), 5) AS amplification FROM p JOIN e USING (event_type)",
        "mainstream_share": f"WITH {EV}, p AS ({profile('ev', 'subject')}) SELECT subject, independent_sources AS clusters, round(mainstream, 4) AS mainstream_share FROM p",
        "signal_buckets": f"{SERIES} SELECT signal, bucket, round(net, 4) AS net, event_count, independent_sources, round(strength, 3) AS strength, direction FROM series",
        "signal_confidence": f"{SERIES} SELECT signal, bucket, round(round(source_diversity, 6), 4) AS source_diversity, round(round(primary_ratio, 6), 4) AS primary_ratio, round(round(avg_quality, 6), 3) AS avg_quality, round(confidence, 2) AS confidence FROM series",
        "trend_rates": f"{TREND} SELECT signal, round(round(orate, 4), 3) AS obs_rate, round(round(brate, 4), 3) AS base_rate, direction, 7::BIGINT AS observation_buckets, 21::BIGINT AS baseline_buckets FROM trend",
        "theme_gate": f"{TREND} SELECT signal, independent_sources, acceleration >= 0 AND independent_sources >= 2 AS passes, round(round(abs(acceleration) / 100 * observation_strength / 100, 6), 4) AS weight FROM trend",
        "theme_components": f"""WITH RECURSIVE act AS (SELECT unnest(['memory', 'semiconductor_equipment', 'logistics']) AS node), adj AS {values(D.SUBJECT_ADJACENCY, 'a, b')},
            reach AS (SELECT node AS a, node AS b FROM act UNION SELECT r.a, j.b FROM reach r JOIN adj j ON j.a = r.b WHERE j.b IN (SELECT node FROM act)), c AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
            s AS (SELECT component, list_sort(list(node)) AS subjects FROM c GROUP BY component), t AS {values([(o, g, '|'.join(x)) for o, g, _, x in D.THEME_TEMPLATES], 'ord, slug, need')},
            fit AS (SELECT component, arg_max(slug, (len(string_split(need, '|')), -ord)) AS slug FROM s JOIN t ON list_has_all(subjects, string_split(need, '|')) GROUP BY component)
          SELECT component, array_to_string(subjects, ',') AS subjects, coalesce(slug, 'theme-' || array_to_string(subjects, '-')) AS slug FROM s LEFT JOIN fit USING (component)""",
        "theme_metrics": f"{METRICS} SELECT theme, round(strength, 2) AS strength, round(acceleration, 2) AS acceleration, round(frequency_change, 2) AS frequency_change, supporting, contradicting, market_reaction, independent_sources, evidence_count, round(source_diversity, 4) AS source_diversity, mainstream_share, contradiction_ratio, round(novelty, 2) AS novelty FROM metrics",
        "maturity_classify": f"""WITH {EV}, e AS (SELECT *, cluster_id // 10 AS segment FROM ev), p AS ({profile('e', 'segment')}), x AS (SELECT segment, avg((event_type = 'error')::INT) AS err, bool_or(event_type = 'purchase') AS reaction, round(avg(magnitude) * 100 - 30, 4) AS acc FROM e GROUP BY segment)
          SELECT segment, {seg} AS sources, {MATURITY.format(n=seg, a='acc', m=share, r=react, c='round(err * (segment % 4), 4)')} AS maturity,
            CASE WHEN {share} >= 0.65 AND {react} THEN 'CROWDED' WHEN {share} >= 0.45 THEN 'CONSENSUS' WHEN {share} >= 0.25 OR {react} THEN 'DEVELOPING' WHEN {share} > 0 THEN 'EMERGING' ELSE 'UNKNOWN' END AS awareness FROM p JOIN x USING (segment)""",
        "value_chain_paths": f"{WALK} SELECT ty AS entity_type, ky AS entity_key, round(weight, 5) AS weight, round(confidence, 5) AS confidence, hops::BIGINT AS hops, role, path FROM walk",
        "company_exposure": f"{WALK} SELECT ky AS company_key, role, least(5, greatest(1, hops))::BIGINT AS order_of_effect, round(round(least(100, greatest(0, 100 * weight)), 2), 1) AS exposure_score, round(round(round(confidence, 9) * 100, 2), 1) AS confidence_pct, 'HISTORICAL' AS data_mode FROM walk WHERE ty = 'COMPANY' AND role IS NOT NULL",
        "region_hierarchy": "WITH RECURSIVE n AS (SELECT 'WORLD' AS key, NULL AS parent UNION ALL SELECT r_name, 'WORLD' FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), t AS (SELECT key, 0 AS depth, key AS root, key AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.key, t.depth + 1, t.root, t.path || '/' || n.key FROM n JOIN t ON n.parent = t.key) SELECT key, depth::BIGINT AS depth, root, path FROM t",
        "score_components": f"{SCORES} SELECT theme, model, key, available, round(normalized, 1) AS normalized, round(effective, 6) AS effective_weight, round(contribution, 1) AS contribution FROM sc",
        "score_totals": f"{SCORES} SELECT theme, model, round(value, 1) AS value, weight_coverage, unavailable FROM totals",
        "theme_ranking": f"{SCORES} SELECT theme, row_number() OVER (ORDER BY round(opportunity * confidence / 100, 4) DESC, metrics.acceleration DESC, theme)::INTEGER AS rank, round(round(opportunity * confidence / 100, 4), 1) AS rank_score FROM wide JOIN metrics USING (theme)",
        "underappreciated_themes": f"{SCORES} SELECT * FROM (SELECT theme, {MATURITY.format(n='independent_sources', a='acceleration', m='mainstream_share', r='market_reaction', c='contradiction_ratio')} AS maturity, round(confidence, 1) AS confidence FROM wide JOIN metrics USING (theme) WHERE confidence >= 50) WHERE maturity IN ('INVALIDATED', 'INVISIBLE', 'EMERGING', 'DEVELOPING', 'ACCELERATING')",
        "finding_by_dimension": f"{_findings()} SELECT dimension, stance, claim_type, confidence, independent_sources, claim FROM found",
        "research_gaps": f"{_findings()} SELECT dimension, claim FROM found WHERE independent_sources = 0",
        "plan_questions": _plan(),
        "edgar_parse_inline": f"""WITH p AS (SELECT * FROM (VALUES ('0000000042', {lit(C.FILING)}), ('0000000043', '{{}}')) v(cik, payload)),
            r AS (SELECT cik, coalesce(json_extract_string(payload, '$.name'), 'Unknown filer') AS entity, json_extract(payload, '$.filings.recent') AS j, unnest(range(coalesce(json_array_length(payload, '$.filings.recent.form'), 0)::BIGINT)) AS i FROM p),
            f AS (SELECT cik, entity, {', '.join(f"json_extract_string(j, '$.{a}[' || i || ']') AS {b}" for a, b in (('form', 'form'), ('accessionNumber', 'acc'), ('filingDate', 'filed'), ('reportDate', 'rep'), ('primaryDocument', 'prim'), ('primaryDocDescription', 'descr')))} FROM r),
            o AS (SELECT *, try_cast(filed AS DATE) AS fd, 'sec:' || cik || ':' || coalesce(acc, '') AS ref, coalesce(descr, form) AS what FROM f WHERE form IN ('8-K', '10-Q', '10-K', '6-K', '20-F'))
          SELECT ref AS external_id, CASE WHEN coalesce(acc, '') <> '' AND coalesce(prim, '') <> '' THEN 'https://www.sec.gov/Archives/edgar/data/' || CAST(cik AS BIGINT) || '/' || replace(acc, '-', '') || '/' || prim ELSE 'https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=' || cik END AS url,
            entity || ' — ' || form || ' (' || what || ')' AS title, entity || ' filed a ' || form || ' (' || what || ') with the SEC.' AS body_text, strftime(fd, '%Y-%m-%d') AS published, strftime(try_cast(nullif(rep, '') AS DATE), '%Y-%m-%d') AS event, form FROM o WHERE fd IS NOT NULL""",
        "source_upsert": f"""WITH {DOCS}, have AS (SELECT source AS key, 'Source ' || source AS name, 'news' AS source_type, min(quality)::INTEGER AS base_quality, NULL::VARCHAR AS notes FROM docs GROUP BY source), new AS {values([('src1', 'Renamed', 'filing', 99, 'seen'), ('src77', 'Fresh', 'filing', 10, None)], 'key, name, source_type, base_quality, notes')}
          SELECT coalesce(h.key, n.key) AS key, coalesce(n.name, h.name) AS name, CASE WHEN h.key IS NOT NULL THEN h.source_type ELSE n.source_type END AS source_type, coalesce(n.base_quality, h.base_quality) AS base_quality, coalesce(n.notes, h.notes) AS notes FROM have h FULL JOIN new n ON h.key = n.key""",
        "constraint_violations": f"""WITH {EV} SELECT 'evidence' AS table_name, 'magnitude' AS rule, count(*) FILTER (NOT magnitude BETWEEN 0 AND 0.5) AS violations FROM ev UNION ALL SELECT 'evidence', 'quality', count(*) FILTER (NOT source_quality BETWEEN 0 AND 100) FROM ev
          UNION ALL SELECT 'evidence', 'demo', count(*) FILTER (data_mode = 'DEMO' AND event_type = 'error') FROM ev UNION ALL SELECT 'lineitem', 'unique l_orderkey,l_linenumber', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
          UNION ALL SELECT 'evidence', 'unique cluster_id', count(*) FROM (SELECT 1 FROM ev GROUP BY cluster_id HAVING count(*) > 1) UNION ALL SELECT 'orders', 'o_custkey references c_custkey', count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)
          UNION ALL SELECT 'lineitem', 'l_suppkey references n_nationkey', count(*) FROM lineitem WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT n_nationkey FROM nation)""",
        "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")),
        "latest_score_per_model": f"WITH {EV} SELECT cluster_id, event_type, event_id, magnitude FROM ev QUALIFY row_number() OVER (PARTITION BY cluster_id, event_type ORDER BY t DESC, event_id) = 1",
    }
