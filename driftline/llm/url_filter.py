"""URL filter by link-graph propagation, with DataFrame functions only.

Rules come first: a rule (host, path) fits its host and all subdomains where the
url's path starts with the rule's; of those that fit, the longest decides
(of equal ones a block). Other urls take the verdict of their host:

* Links between hosts are read from the pages' hrefs and counted by pair of
  hosts; share(h, g) is the part of h's links to other hosts that goes to g.
* Hosts most of whose pages a rule allows are trusted seeds, hosts most of whose
  pages a rule blocks are blocked seeds.
* Trust is personalised PageRank from the trusted seeds along the links.
* Distrust runs along the reversed links: a blocked seed has 1, any other host
  DAMPING times the distrust of the hosts that it links to, weighed by share; it
  is the chance that following its links ends at a blocked seed.
* A host is blocked if its distrust reaches THRESHOLD and its trust does not
  reach the mean of all hosts. Hosts that no link or seed tells of are allowed.

Edges are aggregated by pair of hosts before any rank moves. A node whose links
exceed DEGREE_SPLIT is cut into that many parts for the join, with its rank
sent to each, and ranks are summed before the shuffle, so a very popular host is
no hot spot. Each round is written to the shared checkpoint folder. Rounds go on
until no host's distrust moves by more than TOLERANCE and the moves of all trust
add up to no more: as each round shrinks these by DAMPING, later rounds could
change a host's distrust by 0.006 at most, and 0.006 of all trust. Trust that
reaches a host without links of its own ends there.

Null urls, and urls without ``://``, have an empty host and path, fit no rule
and are allowed. A null html has no links. Each row is judged on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import ascii_lower, checkpointed

#: (verdict, host, path); a configured list of at most MAX_RULES, which becomes part of the plan.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_RULES = 1000
DAMPING = 0.85
TOLERANCE = 0.001
MOST_ROUNDS = 400
THRESHOLD = 0.3
DEGREE_SPLIT = 20_000
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the plan takes {MAX_RULES}")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1], r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): the part of src's links to other hosts that goes to dst."""
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), 1)).alias("to"))
    counted = links.select("src", ascii_lower("to").alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = counted.groupBy("src").agg(F.sum("n").alias("all"))
    return counted.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))


def _split(edges: DataFrame, end: str, other: str, part: str) -> DataFrame:
    """edges with `part`: which of the parts of its node at `end` an edge belongs to."""
    degree = edges.groupBy(end).agg(F.ceil(F.count(F.lit(1)) / DEGREE_SPLIT).cast("int").alias("parts"))
    return edges.join(degree.filter("parts > 1"), end, "left").withColumn(part, F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust), settled up to tolerance. seeds: (host, trusted, blocked) for every host of the pages, the flags 0 or 1."""
    ends = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host")))
    nodes = checkpointed(seeds.unionByName(ends.select("host", F.lit(0).alias("trusted"), F.lit(0).alias("blocked"))).groupBy("host").agg(F.max("trusted").alias("trusted"), F.max("blocked").alias("blocked")))
    n_trusted = nodes.agg(F.sum("trusted").alias("n")).first().n or 0
    start = F.col("trusted") / max(1, n_trusted)
    ranks = nodes.select("host", "trusted", "blocked", start.alias("trust"), F.col("blocked").cast("double").alias("distrust"))
    if edges.isEmpty():
        return ranks.select("host", "trust", "distrust")
    edges = checkpointed(_split(_split(edges, "src", "dst", "of_src"), "dst", "src", "of_dst"))
    parts = edges.groupBy(F.col("src").alias("host")).agg((F.max("of_src") + 1).alias("out_parts")).join(edges.groupBy(F.col("dst").alias("host")).agg((F.max("of_dst") + 1).alias("in_parts")), "host", "full")
    parts = checkpointed(parts)
    for _ in range(MOST_ROUNDS):
        r = ranks.join(parts, "host", "left")
        giving = r.filter("trust > 0 and out_parts is not null").select(F.col("host").alias("src"), "trust", F.explode(F.expr("sequence(0, out_parts - 1)")).alias("of_src"))
        warned = r.filter("distrust > 0 and in_parts is not null").select(F.col("host").alias("dst"), "distrust", F.explode(F.expr("sequence(0, in_parts - 1)")).alias("of_dst"))
        zero = F.lit(0.0)
        other = [F.lit(0).alias("trusted"), F.lit(0).alias("blocked"), zero.alias("was_t"), zero.alias("was_d")]
        given = edges.join(giving, ["src", "of_src"]).select(F.col("dst").alias("host"), (F.col("trust") * F.col("share")).alias("t"), zero.alias("d"), *other)
        back = edges.join(warned, ["dst", "of_dst"]).select(F.col("src").alias("host"), zero.alias("t"), (F.col("distrust") * F.col("share")).alias("d"), *other)
        own = ranks.select("host", zero.alias("t"), zero.alias("d"), "trusted", "blocked", F.col("trust").alias("was_t"), F.col("distrust").alias("was_d"))
        most = [F.max(c).alias(c) for c in ("trusted", "blocked", "was_t", "was_d")]
        met = own.unionByName(given).unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"), *most)
        trust = (1 - DAMPING) * F.col("trusted") / max(1, n_trusted) + DAMPING * F.col("t")
        distrust = F.when(F.col("blocked") == 1, F.lit(1.0)).otherwise(DAMPING * F.col("d"))
        moves = [F.abs(trust - F.col("was_t")).alias("move_t"), F.abs(distrust - F.col("was_d")).alias("move_d")]
        ranks = checkpointed(met.select("host", "trusted", "blocked", trust.alias("trust"), distrust.alias("distrust"), *moves))
        if max(ranks.agg(F.sum("move_t"), F.max("move_d")).first()) <= tolerance:
            return ranks.select("host", "trust", "distrust")
    raise RuntimeError("ranks did not settle")


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of pages."""
    url = F.col("url").cast("string")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    ruled = base.select("page_id", "host", "path", best_rule(F.col("host"), F.col("path"), rules).alias("r"))
    share = lambda verdict: F.avg(F.when(F.col("r.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = ruled.filter("host <> ''").groupBy("host").agg((share("allow") > 0.5).cast("int").alias("trusted"), (share("block") > 0.5).cast("int").alias("blocked"))
    edges = checkpointed(host_edges(base))
    ranks = checkpointed(propagate(edges, seeds))
    n = max(1, ranks.count())
    bad = ranks.filter((F.col("distrust") >= THRESHOLD) & (F.col("trust") * n < 1)).select("host", "distrust")
    judged = ruled.join(bad, "host", "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("distrust").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))
