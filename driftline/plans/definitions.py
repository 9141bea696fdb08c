"""Definitions as data: rules, lexicons, signals, templates, anchors, traversals, score models, research dimensions."""

from __future__ import annotations

# Fixed values from here on.

#: (event type, pattern, magnitude, confidence, claim); a rule's key is its type and its number within the type.
CLAIM_RULES = (
    ("SUPPLY_CONSTRAINT", r"(cannot|could not|unable to) (currently )?meet.{0,30}(demand|delivery|schedule)", 0.95, 0.90, "Supplier states it cannot meet current demand"),
    ("SUPPLY_CONSTRAINT", r"capacity.{0,40}(substantially |largely |fully )?committed", 0.80, 0.85, "Forward capacity is reported as committed"),
    ("SUPPLY_CONSTRAINT", r"(lead times?).{0,30}(extend|lengthen)|extended lead times?", 0.65, 0.80, "Lead times are reported as extending"),
    ("SUPPLY_CONSTRAINT", r"(tighten|constrain|shortage).{0,30}(availability|supply)|(availability|supply).{0,30}(tighten|constrain)", 0.70, 0.75, "Supply availability is reported as tightening"),
    ("SUPPLY_CONSTRAINT", r"(procurement|supply).{0,30}(is |as )?a constraint", 0.75, 0.80, "Input procurement is described as a constraint on output"),
    ("DEMAND_ACCELERATION", r"demand.{0,40}(is |are |has been )?accelerat", 0.85, 0.85, "Demand is described as accelerating"),
    ("DEMAND_ACCELERATION", r"(increasing|increased|stronger|higher|growing) demand|demand.{0,60}(increas|grow|strengthen)", 0.65, 0.75, "Demand is described as increasing"),
    ("DEMAND_ACCELERATION", r"(order (backlog|intake)|backlog|orders).{0,30}(increase|grew|grow|extend|rose)", 0.70, 0.80, "Order backlog or intake is reported as increasing"),
    ("DEMAND_ACCELERATION", r"(shipments|volumes).{0,25}(continued to grow|increase|grew|rose)", 0.55, 0.70, "Shipment volumes are reported as growing"),
    ("DEMAND_ACCELERATION", r"(increased|increasing|greater).{0,30}(forward )?(purchase|procurement) commitments", 0.70, 0.80, "Buyers are increasing forward purchase commitments"),
    ("DEMAND_ACCELERATION", r"(content|requirement).{0,30}per.{0,25}(server|unit|system).{0,30}(increase|risen|grown|higher)", 0.75, 0.80, "Content per unit is reported as increasing"),
    ("DEMAND_WEAKNESS", r"demand.{0,30}(remains? soft|weak|declin|deteriorat)|(soft|weak|declining) demand", 0.65, 0.80, "Demand is described as soft or weakening"),
    ("PRICING_INCREASE", r"(contract )?pricing.{0,25}(increase|rose|improved|higher|moves? higher)|prices?.{0,25}(increase|rose|rising|higher)", 0.70, 0.80, "Pricing is reported as increasing"),
    ("PRICING_INCREASE", r"(unit values|prices?).{0,25}(creep|tick).{0,10}up", 0.35, 0.55, "Prices are anecdotally reported as edging up"),
    ("PRICING_INCREASE", r"(declared unit values|unit values).{0,20}(rose|increase)", 0.60, 0.85, "Declared unit values are reported as rising"),
    ("PRICING_DECREASE", r"pricing.{0,25}(declin|fell|lower|decrease)|prices?.{0,25}(declin|fell|decrease)", 0.70, 0.80, "Pricing is reported as declining"),
    ("INVENTORY_DECLINE", r"inventor(y|ies).{0,30}(declin|draw down|drew down|fell|below the normal)|(declin|draw down).{0,20}inventor", 0.70, 0.80, "Inventory is reported as declining"),
    ("INVENTORY_BUILD", r"inventor(y|ies).{0,25}(increase|rose|build|built)", 0.60, 0.80, "Inventory is reported as building"),
    ("CAPEX_INCREASE", r"(increas\w*).{0,35}capital expenditure|capital expenditure.{0,25}(increase|will increase|rise)", 0.75, 0.85, "Capital expenditure is being increased"),
    ("CAPEX_DECREASE", r"(reduc\w*|cut\w*|lower\w*).{0,30}capital expenditure", 0.70, 0.85, "Capital expenditure is being reduced"),
    ("CAPACITY_EXPANSION", r"(capacity expansion|expand.{0,15}capacity|capacity additions|adding manufacturing capacity|expansion of production capacity|accelerated.{0,25}capacity expansion)", 0.70, 0.80, "Production capacity is being expanded"),
    ("CAPACITY_EXPANSION", r"(construction of|begin construction|additional facility|new fab)", 0.65, 0.75, "A new production facility is being built"),
    ("CONTRACT_AWARD", r"(multi-year )?supply agreement|supply contract|long-term agreement", 0.60, 0.85, "A supply agreement was announced"),
    ("MARKET_REACTION", r"(shares|stock).{0,30}(have moved|rose|rallied)|valuations? already (embed|price)", 0.55, 0.70, "Market prices are reported to have already moved"),
)
STABILITY_PATTERNS = (
    r"\b(broadly )?(stable|flat|unchanged|little changed|in line with expectations)\b",
    r"\bwithin the normal (historical )?range\b",
    r"\bno (notable |immediate )?(shortage|change|supplier reported)\b",
    r"\bconsistent with (the )?prior\b",
    r"\bproceeding on\b.{0,30}\bschedules?\b",
    r"\bmaintain(s|ed)? a neutral\b",
    r"\bdescribed as steady\b",
    r"\bremained steady\b",
)
FORWARD_PATTERNS = (
    r"\bwe (caution|see risk|expect|forecast|estimate|believe|would need|maintain)\b",
    r"\brisk that\b",
    r"\bcould (be|produce|lead|result|just)\b",
    r"\bmay (be|produce|remain|not|represent)\b",
    r"\bhistorically\b",
    r"\bin previous cycles\b",
    r"\bhave been followed by\b",
    r"\bwe see read-across\b",
    r"\b(seems?|sounds?) like\b",
    r"\bhard to say\b",
    r"\bwould need\b",
)
SUBJECT_LEXICON = (
    ("memory", ("memory", "dram", "hbm", "nand", "high-bandwidth", "high bandwidth", "module")),
    ("ai_infrastructure", ("artificial intelligence", "ai server", "ai servers", "ai accelerator", "ai capacity", "ai infrastructure", "accelerator", "hyperscale", "cloud customers")),
    ("semiconductor_equipment", ("equipment", "lithography", "deposition", "test systems", "packaging", "tools", "wafer")),
)
SPECULATIVE_PREFIX = "Forward-looking or historical statement regarding: "
MAX_CLAIMS_PER_SENTENCE = 3
STOPWORDS = (
    "a", "an", "the", "of", "for", "and", "or", "to", "in", "on", "is", "are", "be",
    "was", "were", "with", "by", "from", "as", "at", "that", "this", "it", "do", "does",
    "did", "any", "their", "there", "has", "have", "had", "we", "our", "will", "would",
    "could", "should", "than", "then",
)

#: (signal, subject, event type, weight)
SIGNALS = (
    ("memory_demand", "memory", "DEMAND_ACCELERATION", 1.0),
    ("memory_demand", "memory", "DEMAND_WEAKNESS", -1.0),
    ("memory_demand", "memory", "CONTRACT_AWARD", 0.5),
    ("memory_supply_tightness", "memory", "SUPPLY_CONSTRAINT", 1.0),
    ("memory_supply_tightness", "memory", "INVENTORY_DECLINE", 0.8),
    ("memory_supply_tightness", "memory", "INVENTORY_BUILD", -0.8),
    ("memory_supply_tightness", "memory", "SUPPLY_EXPANSION", -1.0),
    ("memory_supply_tightness", "memory", "CAPACITY_EXPANSION", -0.6),
    ("memory_pricing", "memory", "PRICING_INCREASE", 1.0),
    ("memory_pricing", "memory", "PRICING_DECREASE", -1.0),
    ("memory_capital_investment", "memory", "CAPEX_INCREASE", 1.0),
    ("memory_capital_investment", "memory", "CAPEX_DECREASE", -1.0),
    ("memory_capital_investment", "memory", "CAPACITY_EXPANSION", 0.6),
    ("ai_infrastructure_investment", "ai_infrastructure", "CAPEX_INCREASE", 1.0),
    ("ai_infrastructure_investment", "ai_infrastructure", "CAPEX_DECREASE", -1.0),
    ("ai_infrastructure_investment", "ai_infrastructure", "DEMAND_ACCELERATION", 0.7),
    ("semiconductor_equipment_demand", "semiconductor_equipment", "DEMAND_ACCELERATION", 1.0),
    ("semiconductor_equipment_demand", "semiconductor_equipment", "SUPPLY_CONSTRAINT", 0.5),
    ("semiconductor_equipment_demand", "semiconductor_equipment", "CAPACITY_EXPANSION", 0.4),
    ("memory_market_reaction", "memory", "MARKET_REACTION", 1.0),
)
SUBJECT_ADJACENCY = (
    ("memory", "ai_infrastructure"),
    ("memory", "semiconductor_equipment"),
    ("ai_infrastructure", "memory"),
    ("semiconductor_equipment", "memory"),
)
#: (subject, entity type, entity key, weight)
SUBJECT_ANCHORS = (
    ("memory", "TECHNOLOGY", "memory_requirement", 1.0),
    ("ai_infrastructure", "TECHNOLOGY", "ai_infrastructure", 0.85),
    ("semiconductor_equipment", "INDUSTRY", "semiconductor_equipment", 0.6),
)
#: (order, slug, name, subjects); the first of the most specific that fit names a theme.
THEME_TEMPLATES = (
    (0, "ai-memory-demand", "AI Memory Demand", ("memory", "ai_infrastructure")),
    (1, "memory-equipment-cycle", "Memory Equipment Cycle", ("memory", "semiconductor_equipment")),
)
#: (relationship, direction, role, multiplier)
TRAVERSALS = (
    ("DRIVES_DEMAND_FOR", "forward", "DIRECT_BENEFICIARY", 1.0),
    ("PRODUCES", "reverse", "DIRECT_BENEFICIARY", 1.0),
    ("SUPPLIES", "reverse", "SUPPLIER", 0.8),
    ("BUYS_FROM", "reverse", "CUSTOMER", 0.5),
    ("COMPETES_WITH", "forward", "COMPETITOR", 0.6),
    ("COMPETES_WITH", "reverse", "COMPETITOR", 0.6),
    ("SUBSTITUTES_FOR", "reverse", "SUBSTITUTE", 0.5),
    ("INVESTS_IN", "reverse", "INFRASTRUCTURE_BENEFICIARY", 0.6),
)
#: model: (component, weight); the weights of a model sum to one.
SCORE_MODELS = {
    "trend": (("signal_strength", 0.20), ("signal_acceleration", 0.15), ("evidence_diversity", 0.15), ("economic_impact", 0.10), ("novelty", 0.10), ("market_mispricing", 0.10), ("company_exposure", 0.10), ("catalyst_proximity", 0.05), ("confidence", 0.05)),
    "opportunity": (("trend_strength", 0.25), ("trend_acceleration", 0.15), ("company_exposure", 0.15), ("market_mispricing", 0.15), ("evidence_quality", 0.10), ("catalyst_strength", 0.10), ("risk_reward", 0.05), ("novelty", 0.05)),
    "confidence": (("independent_sources", 0.30), ("source_quality", 0.20), ("primary_ratio", 0.20), ("source_diversity", 0.15), ("contradiction_balance", 0.15)),
}
UNAVAILABLE_COMPONENTS = ("economic_impact", "market_mispricing", "catalyst_proximity", "catalyst_strength", "risk_reward")
#: (dimension, event type)
DIMENSION_EVENTS = tuple(
    (dimension, event)
    for dimension, events in (
        ("DEMAND", ("DEMAND_ACCELERATION", "DEMAND_WEAKNESS", "CONTRACT_AWARD")),
        ("SUPPLY", ("SUPPLY_CONSTRAINT", "SUPPLY_EXPANSION", "INVENTORY_DECLINE", "INVENTORY_BUILD")),
        ("PRICING", ("PRICING_INCREASE", "PRICING_DECREASE")),
        ("CAPACITY", ("CAPACITY_EXPANSION", "CAPEX_INCREASE", "CAPEX_DECREASE")),
        ("CUSTOMERS", ("DEMAND_ACCELERATION", "CONTRACT_AWARD")),
        ("COMPETITION", ("CAPACITY_EXPANSION", "PRODUCT_LAUNCH", "SUPPLY_EXPANSION")),
        ("TECHNOLOGY", ("TECHNOLOGY_ADOPTION", "PRODUCT_LAUNCH")),
        ("MARKET_EXPECTATIONS", ("MARKET_REACTION",)),
        ("RISKS", ("DEMAND_WEAKNESS", "PRICING_DECREASE", "INVENTORY_BUILD", "SUPPLY_EXPANSION", "CAPACITY_EXPANSION")),
        ("CONTRADICTORY_EVIDENCE", ("DEMAND_WEAKNESS", "PRICING_DECREASE", "INVENTORY_BUILD", "SUPPLY_EXPANSION")),
    )
    for event in events
)
SPECULATIVE_DIMENSIONS = ("HISTORICAL_ANALOGUE", "CONTRADICTORY_EVIDENCE", "RISKS")
COUNTER_DIMENSIONS = ("CONTRADICTORY_EVIDENCE", "RISKS")
NEUTRAL_DIMENSIONS = ("MARKET_EXPECTATIONS", "HISTORICAL_ANALOGUE")
REQUIRED_DIMENSIONS = ("DEMAND", "SUPPLY", "PRICING", "COMPANY_EXPOSURE", "CONTRADICTORY_EVIDENCE", "HISTORICAL_ANALOGUE")
SUPPORTING_TYPES = ("DEMAND_ACCELERATION", "DEMAND_WEAKNESS", "CONTRACT_AWARD", "SUPPLY_CONSTRAINT", "INVENTORY_DECLINE", "PRICING_INCREASE")
#: (order, dimension, priority, seeks counter evidence, question, search terms); {p} is the primary subject, {c} the companies.
PLAN_QUESTIONS = (
    (0, "DEMAND", 1, False, "Is end demand for {p} increasing, and is the increase attributable to a structural driver rather than restocking?", ("{p} demand", "{p} order backlog", "demand growth")),
    (1, "SUPPLY", 1, False, "Is {p} supply constrained, and how quickly can capacity respond?", ("{p} capacity", "{p} shortage", "inventory lead times")),
    (2, "PRICING", 1, False, "Is {p} pricing rising, and is the move contract-based or spot-only?", ("{p} pricing", "contract pricing", "price increase")),
    (3, "CAPACITY", 2, False, "How much new {p} capacity has been announced, and when does it come online?", ("capacity expansion", "capital expenditure", "new facility")),
    (4, "CUSTOMERS", 2, False, "Which customers are driving {p} demand, and are they committing to forward purchases?", ("customers", "purchase commitments", "procurement")),
    (5, "COMPANY_EXPOSURE", 1, False, "Which public companies have the greatest incremental exposure to this change, and through what mechanism? Candidates: {c}.", ("{c}",)),
    (6, "COMPETITION", 3, False, "Are competitors expanding into {p}, and does that erode the advantage of the exposed companies?", ("competition", "market share", "capacity additions")),
    (7, "TECHNOLOGY", 3, False, "Could a technology change reduce the {p} requirement per unit of end demand?", ("technology", "efficiency", "next generation")),
    (8, "MARKET_EXPECTATIONS", 2, False, "What does the available evidence say about how much of this change is already reflected in market expectations?", ("valuation", "shares", "analysts", "expectations")),
    (9, "RISKS", 2, True, "What would have to be true for the {p} thesis to be wrong within twelve months?", ("risk", "oversupply", "slowdown", "decline")),
    (10, "CONTRADICTORY_EVIDENCE", 1, True, "What direct evidence contradicts the claim that {p} demand is outrunning supply?", ("{p} oversupply", "demand slowdown", "pricing decline", "inventory build")),
    (11, "HISTORICAL_ANALOGUE", 2, True, "When has a comparable {p} cycle occurred before, and how did it resolve for suppliers and for pricing?", ("historical cycle", "previous cycle", "cycle history")),
)

GENERATED_NAME = "Emerging change: "
#: Sentences of plans, findings and reports; {} or %-places are filled in.
SIGNAL_QUESTION = "The '%s' signal is running %s against its own baseline on %s independent sources. What explains the change, and is it durable?"
GENERAL_HYPOTHESIS = "%s: the measured change is real, durable and economically meaningful."
NO_COMPANY = "No company could be mapped to this theme through the knowledge graph."
COMPANIES_MAPPED = "%d companies map to this theme through the value chain: %s."
COMPANY_MAPPED = "%s (%s, order %d, exposure %.0f)"
SIGNAL_CHANGED = "%s is running at %.0f/100 over the observation window against %.0f/100 in its prior baseline (acceleration %+.0f on a -100..100 scale)."
STRONGEST = "Strongest corroboration: "
NO_EXPOSURE = "No company exposure could be established, so the economic consequence of this change is not yet attributable to any issuer."
ORDERS = "%d companies are exposed at first order and %d at second order or beyond, so the change has an identifiable transmission path into public equities."
INDIRECT = "The strongest indirect exposure is %s (%s, order %d) via: %s"
NO_TREND = "No trend is attached to this theme, so 'why now' cannot be answered."
RATES = "The evidence rate changed: %s events arrive at %.2f/day in the observation window against %.2f/day in the baseline."
BREADTH = "Independent breadth changed: independence is up %+.0f on the same comparison, so the change is being reported by more separate sources rather than repeated by the same one."
STAGE = "Maturity is classified %s by deterministic rules over those measurements."
AWARENESS_ESTIMATE = "Coverage-derived market awareness is estimated as %s."
NO_MARKET_DATA = (
    "This estimate is derived only from the mix of source types in the evidence. No market-data provider is configured, so price reaction, valuation, positioning and estimate revisions"
    " have NOT been measured. Provider status: %s"
)
FALLS = "%s acceleration falls below 0 against its baseline (currently %+.0f)."
INVALIDATES = "Independent contradicting evidence rises above 60% of independent evidence, which the maturity classifier treats as invalidating."
NO_EVIDENCE = "No evidence addressing %s was located in the available corpus for this window."
ON_DIMENSION = "%s independent source(s) on %s: %s"
AND_SPECULATIVE = "%s; plus %s forward-looking or historical statement(s)."
ONLY_SPECULATIVE = "%s forward-looking or historical statement(s) bear on %s; no observed event of this kind was recorded."
FILING_TITLE = "%s — %s (%s)"
FILING_BODY = "%s filed a %s (%s) with the SEC."
FILING_URL = "https://www.sec.gov/Archives/edgar/data/%s/%s/%s"
FILINGS_URL = "https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=%s"
DISCLAIMER = "Research output. Not investment advice, and not a forecast of any security's price. Scores rank research priority, not expected return."
DOMAIN_EVENTS = ("SOURCE_INGESTED", "EVIDENCE_EXTRACTED", "EVENT_CREATED", "SIGNAL_UPDATED", "TREND_UPDATED", "THEME_UPDATED", "RESEARCH_REQUESTED", "RESEARCH_COMPLETED")
# End of the fixed values.


def rule_rows(rules=CLAIM_RULES) -> list[tuple]:
    """(ord, rule_key, event_type, pattern, magnitude, confidence, claim)"""
    seen: dict[str, int] = {}
    out = []
    for ord_, (kind, pattern, magnitude, confidence, claim) in enumerate(rules):
        seen[kind] = seen.get(kind, 0) + 1
        out.append((ord_, f"{kind.lower()}#{seen[kind]}", kind, pattern, magnitude, confidence, claim))
    return out


def check_models() -> None:
    for model, parts in SCORE_MODELS.items():
        if round(sum(w for _, w in parts), 6) != 1.0:
            raise ValueError(f"the weights of {model} do not sum to one")


check_models()
