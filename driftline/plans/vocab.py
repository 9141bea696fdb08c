"""Vocabularies, as ordered tuples; ranks and stages as maps."""

# Fixed values.
DATA_MODE_RANK = {"UNAVAILABLE": 0, "DEMO": 1, "HISTORICAL": 2, "LIVE": 3}
SOURCE_CLASSES = ("PRIMARY_CORPORATE", "GOVERNMENT", "REGULATORY", "FINANCIAL_MEDIA", "INDUSTRY", "TECHNICAL", "MARKET_DATA", "ALTERNATIVE_DATA", "COMMUNITY")
PRIMARY_CLASSES = ("PRIMARY_CORPORATE", "GOVERNMENT", "REGULATORY")
MATURITY_STAGE = {"INVISIBLE": 0, "EMERGING": 1, "DEVELOPING": 2, "ACCELERATING": 3, "CONSENSUS": 4, "CROWDED": 5, "MATURE": 6, "INVALIDATED": -1}
AWARENESS = ("UNKNOWN", "EMERGING", "DEVELOPING", "CONSENSUS", "CROWDED")
DIMENSIONS = (
    "DEMAND", "SUPPLY", "PRICING", "CAPACITY", "CUSTOMERS", "COMPETITION", "TECHNOLOGY",
    "COMPANY_EXPOSURE", "MARKET_EXPECTATIONS", "RISKS", "CONTRADICTORY_EVIDENCE", "HISTORICAL_ANALOGUE",
)
CLUSTER_METHODS = ("ORIGIN", "EXACT_HASH", "NEAR_DUPLICATE", "DECLARED_ORIGIN")
CAPABILITIES = ("NEWS_SEARCH", "FILINGS", "MARKET_DATA", "COMPANY_DATA")
FILING_SOURCE_TYPES = ("SEC_FILING", "COMPANY_FILING", "REGULATORY_FILING")
FILING_FORMS = ("8-K", "10-Q", "10-K", "6-K", "20-F")
