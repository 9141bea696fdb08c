"""Sources and sinks: corpus JSON, filings payloads, provider registry and health, upserts, snapshots."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import urlsplit
from urllib.request import HTTPRedirectHandler, build_opener

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.plans.definitions import DOMAIN_EVENTS, FILING_BODY, FILING_TITLE, FILING_URL, FILINGS_URL
from driftline.plans.vocab import CAPABILITIES, FILING_FORMS, FILING_SOURCE_TYPES

CORPUS_SCHEMA = (
    "corpus_version string, data_mode string,"
    " sources array<struct<key:string,name:string,publisher:string,source_type:string,source_class:string,data_mode:string,base_quality:int,homepage_url:string,notes:string,is_synthetic:boolean>>,"
    " documents array<struct<external_id:string,source_key:string,url:string,title:string,body_text:string,data_mode:string,published_at:string,event_at:string,origin_ref:string,subject_hints:array<string>>>,"
    " companies array<struct<key:string,name:string,ticker:string,exchange:string,industry_key:string,description:string>>,"
    " industries array<struct<key:string,name:string,parent:string,sector:string>>,"
    " relationships array<struct<source_entity_type:string,source_entity_key:string,target_entity_type:string,target_entity_key:string,relationship_type:string,weight:double,confidence:double,note:string>>"
)
FILINGS_SCHEMA = "name string, filings struct<recent:struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>,primaryDocDescription:array<string>>>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus file; any mode but DEMO raises when it is read."""
    raw = spark.read.schema(CORPUS_SCHEMA).option("multiLine", True).json(path)
    return raw.withColumn("data_mode", F.when(F.col("data_mode") == "DEMO", F.col("data_mode")).otherwise(F.raise_error(F.lit("the corpus is not marked DEMO")).cast("string")))


def section(corpus: DataFrame, name: str) -> DataFrame:
    rows = corpus.select("corpus_version", F.col("data_mode").alias("corpus_mode"), F.inline(name))
    if name == "documents":
        stamp = lambda c: F.try_to_timestamp(F.col(c))
        rows = rows.withColumns({"published_at": stamp("published_at"), "event_at": stamp("event_at"), "subject_hints": F.coalesce("subject_hints", F.array().cast("array<string>"))})
    if name == "sources":
        rows = rows.withColumn("is_synthetic", F.coalesce("is_synthetic", F.lit(False)))
    return rows.filter(F.col("corpus_mode") == "DEMO").drop("corpus_mode")


def by_capability(documents: DataFrame, sources: DataFrame, filings: bool) -> DataFrame:
    """Documents of sources that file, or of those that do not."""
    served = F.col("source_type").isin(*FILING_SOURCE_TYPES)
    return documents.join(sources.filter(served if filings else ~served).select(F.col("key").alias("source_key")), "source_key", "left_semi")


def recent(documents: DataFrame, limit: int) -> DataFrame:
    return documents.orderBy(F.desc("published_at"), "external_id").limit(limit)


def parse_filings(payloads: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Documents from filings indexes. payloads: cik (ten digits), payload (JSON).

    The parallel arrays are joined by position, whatever their lengths; forms that are not listed and rows without a valid
    filing date go; the event is the report date."""
    p = payloads.select("cik", F.from_json("payload", FILINGS_SCHEMA).alias("p")).select("cik", F.coalesce("p.name", F.lit("Unknown filer")).alias("entity"), "p.filings.recent.*")
    rows = p.select("cik", "entity", F.inline(F.arrays_zip("form", "accessionNumber", "filingDate", "reportDate", "primaryDocument", "primaryDocDescription")))
    day = lambda c: F.try_to_timestamp(F.nullif(F.col(c), F.lit("")))
    r = rows.filter(F.col("form").isin(*FILING_FORMS)).withColumn("published_at", day("filingDate")).filter("published_at is not null")
    for bound, op in ((since, ">="), (until, "<=")):
        if bound:
            r = r.filter(F.expr(f"published_at {op} timestamp '{bound}'"))
    accession = F.coalesce("accessionNumber", F.lit(""))
    bare, primary = F.replace(accession, F.lit("-"), F.lit("")), F.coalesce("primaryDocument", F.lit(""))
    what = F.coalesce("primaryDocDescription", "form")
    url = F.when((bare != "") & (primary != ""), F.format_string(FILING_URL, F.col("cik").cast("bigint"), bare, primary)).otherwise(F.format_string(FILINGS_URL, "cik"))
    ref = F.concat(F.lit("sec:"), "cik", F.lit(":"), accession)
    return r.select(
        ref.alias("external_id"), url.alias("url"), F.format_string(FILING_TITLE, "entity", "form", what).alias("title"),
        F.format_string(FILING_BODY, "entity", "form", what).alias("body_text"), "published_at", day("reportDate").alias("event_at"), ref.alias("origin_ref"), "form",
    )


def search_filings(payloads: DataFrame, limit: int, since: str | None = None, until: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, answer): the newest filings of all issuers, at most limit, and one row (found, truncated, failed).

    An issuer whose payload is missing or no JSON object gives no documents and is counted as failed; the others go on."""
    failed = F.col("payload").isNull() | F.get_json_object("payload", "$").isNull()
    docs = parse_filings(payloads.filter(~failed), since, until)
    found = docs.agg(F.count(F.lit(1)).alias("found"), (F.count(F.lit(1)) > limit).alias("truncated"))
    answer = found.crossJoin(payloads.agg(F.count(F.when(failed, 1)).alias("failed")))  # one row each
    return docs.orderBy(F.desc("published_at"), "external_id").limit(limit), answer


def allowed_url(url: str, hosts: tuple[str, ...]) -> bool:
    """Only https to listed hosts, without a user or a port of its own."""
    u = urlsplit(url)
    return u.scheme == "https" and u.hostname in hosts and not u.username and u.port in (None, 443)


class _NoRedirects(HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def fetch_json(url: str, hosts: tuple[str, ...], timeout: float = 20.0, opened: Callable | None = None) -> dict:
    """The JSON at an allowed address. A redirect is an error: it could lead to any other host."""
    if not allowed_url(url, hosts):
        raise PermissionError(f"not an allowed address: {url}")
    with (opened or build_opener(_NoRedirects()).open)(url, timeout=timeout) as answer:
        return json.load(answer)


def allowed(url: Column, hosts: tuple[str, ...]) -> Column:
    return (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(*hosts)


NO_ROWS = "external_id string, title string, body_text string, published_at timestamp"
HEALTH = "capability string, provider string, available boolean, data_mode string, detail string, live_path_verified boolean"


class Registry:
    """Capability to reader; what is not registered answers with no rows and the mode UNAVAILABLE.

    Readers are chosen by configured names: ``adapters`` maps a name to (reader, mode, detail, live path verified), and a name
    that it lacks makes the capability unavailable, with the reason, rather than failing."""

    def __init__(self, spark: SparkSession, adapters: dict[str, tuple] | None = None, configured: dict[str, str] | None = None):
        self.spark, self._readers, self._modes = spark, {}, {}
        self._said: dict[str, tuple[str, str, bool]] = {}  # provider, detail, live path verified
        for capability, name in (configured or {}).items():
            if name in (adapters or {}):
                reader, mode, detail, live = adapters[name]
                self.register(capability, reader, mode, name, detail, live)
            else:
                self._said[capability] = (name, f"no provider is known by the name {name!r}", False)

    def register(self, capability: str, reader: Callable[[], DataFrame], mode: str, provider: str = "", detail: str = "", live: bool = False) -> None:
        if capability not in CAPABILITIES:
            raise ValueError(capability)
        self._readers[capability], self._modes[capability] = reader, mode
        self._said[capability] = (provider, detail, live)

    def read(self, capability: str) -> tuple[DataFrame, str]:
        if capability in self._readers:
            return self._readers[capability](), self._modes[capability]
        return self.spark.createDataFrame([], NO_ROWS), "UNAVAILABLE"

    def both(self, first: str, second: str) -> DataFrame:
        """The documents of two capabilities, one after the other."""
        return self.read(first)[0].unionByName(self.read(second)[0], allowMissingColumns=True)

    def health(self) -> DataFrame:
        """A row a capability; asking never raises."""
        none = ("", "no provider is configured", False)
        rows = [(c, self._said.get(c, none)[0], c in self._readers, self._modes.get(c, "UNAVAILABLE"), *self._said.get(c, none)[1:]) for c in CAPABILITIES]
        return self.spark.createDataFrame(rows, HEALTH)


def filings_health(user_agent: str | None, probe: Callable[[], None] | None = None) -> tuple[bool, str, str]:
    """(available, mode, detail) of the filings provider: it must name itself to the service, and a probe that fails is told."""
    if not user_agent:
        return False, "UNAVAILABLE", "a user agent with a contact must be configured"
    try:
        if probe:
            probe()
    except Exception as e:  # a probe reports, it never raises
        return False, "UNAVAILABLE", f"{type(e).__name__}: {e}"
    return True, "LIVE", "reachable" if probe else "not probed"


def market_snapshot(spark: SparkSession, keys: list[str], reason: str = "no market data provider is configured") -> DataFrame:
    """A typed answer for each company: no measure, the mode UNAVAILABLE, and why."""
    keyed = spark.createDataFrame([(k,) for k in keys], "company_key string")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("price", "double"), ("change_pct", "double"), ("market_cap", "double"), ("as_of", "timestamp"))]
    return keyed.select("company_key", *none, F.lit("UNAVAILABLE").alias("data_mode"), F.lit(reason).alias("detail"))


def seed(industries: DataFrame, companies: DataFrame, relationships: DataFrame, stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The three reference tables with the rows that they lack. Only a marked demonstration may be seeded: any row that is not
    DEMO, or a company that is not fictional, raises, as does an industry whose parent is neither listed nor stored.

    industries: key, name, parent, data_mode; companies: key, name, industry_key, is_fictional, data_mode; relationships: the graph's edges."""
    real = [df.filter(F.coalesce(F.col("data_mode") != "DEMO", F.lit(True))).limit(1) for df in (industries, companies, relationships)]
    real.append(companies.filter(~F.coalesce("is_fictional", F.lit(False))).limit(1))
    if any(not df.isEmpty() for df in real):
        raise ValueError("only fictional rows in the mode DEMO may be seeded")
    known = industries.select("key").unionByName(stored["industries"].select("key")).distinct()
    if not industries.filter(F.col("parent").isNotNull()).join(known.withColumnRenamed("key", "parent"), "parent", "left_anti").isEmpty():
        raise ValueError("an industry's parent is unknown")
    edge = ["source_type", "source_key", "relationship", "target_type", "target_key"]
    return {
        "industries": insert_absent(stored["industries"], industries, ["key"]),
        "companies": insert_absent(stored["companies"], companies, ["key"]),
        "relationships": insert_absent(stored["relationships"], relationships, edge),
    }


def write_run(tables: dict[str, DataFrame], root: str, run: str) -> str:
    """Write a run's tables below root/run and only then point root/CURRENT at it: readers see all of a run or nothing of it."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{run}/{name}")
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("overwrite").parquet(f"{root}/CURRENT")
    return f"{root}/{run}"


def read_run(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{spark.read.parquet(f'{root}/CURRENT').first().run}/{name}")


def reset(spark: SparkSession, root: str, environment: str) -> None:
    """Remove all tables below root; refused in production."""
    if environment == "production":
        raise PermissionError("tables of a production environment are not reset")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parse_list(value) -> list:
    """A configured list: JSON, or values with commas between them; blanks go, and what is no text is taken as it is."""
    if not isinstance(value, str):
        return value
    text = value.strip()
    return json.loads(text) if text.startswith("[") else [x.strip() for x in text.split(",") if x.strip()]


def merged(reports: DataFrame, by: str) -> DataFrame:
    """The counters of several ingestion reports, summed."""
    counters = [c for c in reports.columns if c != by]
    return reports.groupBy(by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


class EventBus:
    """Events by name to handlers, called one after the other; one that fails is noted and stops neither the others nor the sender."""

    def __init__(self):
        self._handlers: dict[str, list[Callable[[dict], None]]] = {}
        self.log: list[tuple[str, str, str | None]] = []  # event, handler, error

    def subscribe(self, event: str, handler: Callable[[dict], None]) -> None:
        if event not in DOMAIN_EVENTS:
            raise ValueError(event)
        self._handlers.setdefault(event, []).append(handler)

    def publish(self, event: str, payload: dict | None = None) -> None:
        if event not in DOMAIN_EVENTS:
            raise ValueError(event)
        for handler in self._handlers.get(event, []):
            try:
                handler(payload or {})
                self.log.append((event, handler.__name__, None))
            except Exception as e:  # a handler must not stop the sender
                self.log.append((event, handler.__name__, str(e)))


def upsert_sources(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sources by key: new ones are added; of known ones only name, base_quality and notes change."""
    a, b = stored.alias("a"), incoming.dropDuplicates(["key"]).alias("b")
    changes = {"name", "base_quality", "notes"}
    known = F.col("a.key").isNotNull()
    cols = [(F.coalesce(f"b.{c}", f"a.{c}") if c in changes else F.when(known, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))).alias(c) if c != "key" else F.coalesce("a.key", "b.key").alias("key") for c in stored.columns]
    return a.join(b, F.col("a.key") == F.col("b.key"), "full").select(*cols)


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return stored.unionByName(incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(stored.columns))


def write_snapshot(scores: DataFrame, path: str) -> None:
    """Replace the snapshot of each (computed_at, model) in scores and leave the others."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("computed_at", "model").parquet(path)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
