"""Mixing sources to target weights, with DataFrame functions only.

Pack. The words of a source's documents, in the order of a hash of their ids,
form one stream, cut into blocks of BLOCK words (the last may be shorter).
Sums over ranges of the hash and then within a range place each document in its
stream; there are about as many ranges as documents in one, so neither level
gathers a source. Rows alike in id, source and size are counted first and take
consecutive places, so a row that is repeated very often is one row here.

Draw. Each output shard has SHARD slots; a slot takes a source with the
probability of the source's part of all blocks to take, so a shard's counts are
a multinomial draw. The draws come from hashes of the slot's number, and a draw
finds its source through cells of the cumulative weights: an equality join for
any number of sources. What the draws give a source is what the mix takes of it,
but for a correction: a source ends within TOLERANCE of the blocks that its
target names, so draws beyond that are given back from its last shards, and
those that it lacks are placed in closing shards. No source is gone through more
often than ``most`` times.

Map. A source's slots are numbered through its shards; slot j is position
j mod n of epoch j div n of the source's n blocks, and a permutation of
[0, n) of that epoch names the block. The permutation is a swap-or-not shuffle:
in each round x may change places with k - x mod n, as a hash of the larger of
the two says. It is a bijection for every n and needs no table.

Join. Blocks meet the draws by (source, block) and give back to each document
the words that the mix takes of it. A source is taken twice at most, so no
document gives more than twice its words.

Targets. Sources in the order of their code points, null last, weigh 3, 1, 2 in
turn and share ``share`` times all words; a target stops at ``most`` times its
source's words and the excess is shared again by weight until none is above.
Each round is one aggregation over a row a source; sums are of whole numbers, so
no order of addition can tell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import WORD, checkpointed, shuffle_partitions, written

BLOCK = 64
SHARD = 1024
TOLERANCE = 0.005
WEIGHTS = (3, 1, 2)
ROUNDS = 16
#: Copies of one row that a task unfolds.
COPIES = 1000


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size), one row for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def numbered(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """rows with `name`: 0, 1, ... in the order. Sorted by ranges; the window sees one row a range."""
    placed = checkpointed(rows.orderBy(order).withColumn("_n", F.monotonically_increasing_id()))
    part = F.shiftright("_n", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return placed.withColumn("_part", part).join(base, "_part").withColumn(name, F.col("_base") + F.col("_n") - F.shiftleft("_part", 33)).drop("_part", "_base", "_n")


def summed_ahead(rows: DataFrame, key: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with `name`: the sum of value over the rows of the same key that come before in the order (bucket, *order).

    Two levels: windows see the buckets of a key and the rows of a bucket, never all rows of a key."""
    part = rows.withColumn("_b", bucket).withColumn("_v", value)
    ahead = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = part.groupBy(*key, "_b").agg(F.sum("_v").alias("_v")).select(*key, "_b", F.coalesce(F.sum("_v").over(ahead), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_inner", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return part.join(base, [*key, "_b"]).withColumn(name, F.col("_base") + F.col("_inner")).drop("_b", "_v", "_base", "_inner")


def targets(by_source: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(sid, source, source_size, target) from one row (source, source_size) each; sid numbers the sources in order."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    t = checkpointed(numbered(by_source, F.col("source").asc_nulls_last(), "sid").select("sid", "source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * F.lit(most)
    budget, level = share * (t.agg(F.sum("source_size").alias("n")).first().n or 0), -math.inf
    while True:
        over = F.col("weight") * F.lit(level) > cap
        r = t.agg(F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"), F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("full")).first()
        # The set of full sources only grows, so the level rises until none is added.
        new = (budget - most * r.full) / r.free if r.free else math.inf
        if new <= level:
            break
        level = new
    return t.select("sid", "source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def plan_blocks(per_source: DataFrame, most: float = 2.0, block: int = BLOCK, tolerance: float = TOLERANCE) -> DataFrame:
    """targets with blocks, take (the blocks that the target names), low and high (what the draws may give)."""
    p = per_source.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    # Whole rounds over the source's blocks, then as many blocks as come nearest to the rest.
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    rest = F.least(F.col("blocks"), F.round((F.col("target") - whole * F.col("source_size")) / block))
    end = F.floor(F.col("blocks") * F.lit(most)).cast("long")
    p = p.withColumn("take", F.least((whole * F.col("blocks") + rest).cast("long"), end))
    slack = F.floor(F.col("take") * F.lit(tolerance)).cast("long")
    return p.withColumn("low", F.col("take") - slack).withColumn("high", F.least(F.col("take") + slack, end))


def permuted(x: str, n: str, *key: str, rounds: int = ROUNDS) -> str:
    """SQL for the image of x under a permutation of [0, n) that the key columns choose."""
    k = f"pmod(xxhash64({', '.join(key)}, r), {n})"
    mate = f"pmod({k} - x, {n})"
    step = f"CASE WHEN xxhash64({', '.join(key)}, r, greatest(x, {mate}), 1) & 1 = 1 THEN {mate} ELSE x END"
    return f"aggregate(sequence(1, {rounds}), cast({x} as bigint), (x, r) -> {step})"


def shard_counts(plan: DataFrame, seed: int = 8) -> DataFrame:
    """(shard, sid, n): how often each shard's SHARD slots drew each source. plan: sid, take. The last shard may be shorter."""
    known = plan.agg(F.sum("take").alias("slots"), F.count(F.lit(1)).alias("n")).first()
    slots = int(known.slots or 0)
    if not slots:
        return plan.select(F.lit(0).cast("long").alias("shard"), "sid", F.lit(0).cast("long").alias("n")).limit(0)
    side, cells = math.ceil(math.sqrt(known.n)), 4096 + 4 * known.n
    width = math.ceil(slots / cells)
    cdf = summed_ahead(plan.filter("take > 0").select("sid", "take").withColumn("all", F.lit(0)), ["all"], F.expr(f"sid div {side}"), ["sid"], F.col("take"), "lo")
    cell = cdf.select("sid", "lo", (F.col("lo") + F.col("take")).alias("hi"), F.explode(F.expr(f"sequence(lo div {width}, (lo + take - 1) div {width})")).alias("cell"))
    drawn = plan.sparkSession.range(slots).select(F.expr(f"id div {SHARD}").alias("shard"), F.expr(f"pmod(xxhash64({seed}L, id), {slots}L)").alias("v")).withColumn("cell", F.expr(f"v div {width}"))
    return drawn.join(cell, "cell").filter("v >= lo AND v < hi").groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))


def draws(plan: DataFrame, seed: int = 8) -> DataFrame:
    """(shard, sid, epoch, block): one row for each slot of the mix. plan: sid, blocks, take, low, high."""
    counts = checkpointed(shard_counts(plan, seed))
    width = max(1, math.ceil(math.sqrt((counts.agg(F.max("shard").alias("s")).first().s or 0) + 1)))
    first = summed_ahead(counts, ["sid"], F.expr(f"shard div {width}"), ["shard"], F.col("n"), "first")
    limits = plan.select("sid", "low", "high", "blocks")
    runs = first.join(limits, "sid").select("shard", "sid", "blocks", "first", F.least(F.col("first") + F.col("n"), F.col("high")).alias("end")).filter("first < end")
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    # Closing shards follow the others and hold SHARD slots of one source each.
    lacks = limits.join(got, "sid", "left").select("sid", "blocks", F.coalesce("got", F.lit(0)).alias("got"), "low").filter("got < low")
    cut = lacks.select("sid", "blocks", "low", F.explode(F.expr(f"sequence(got, low - 1, {SHARD})")).alias("first"))
    closing = cut.select(F.lit(-1).cast("long").alias("shard"), "sid", "blocks", "first", F.least(F.col("first") + SHARD, F.col("low")).alias("end"))
    # A run is one row here and up to SHARD below: dealt by number, so that few small rows are not put in one task.
    dealt = runs.unionByName(closing).repartition(shuffle_partitions(plan.sparkSession), "sid", "first")
    slot = dealt.select("shard", "sid", "blocks", F.explode(F.expr("sequence(first, end - 1)")).alias("j"))
    slot = slot.select("shard", "sid", "blocks", F.expr("j div blocks").alias("epoch"), F.expr("j % blocks").alias("pos"))
    return slot.select("shard", "sid", "epoch", F.expr(permuted("pos", "blocks", f"{seed}L", "sid", "epoch")).alias("block"))


def packed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, sid, size, at), one row for each row (doc_id, source, size) with words: `at` words of its source come before."""
    alike = rows.filter("size > 0").groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    named = alike.join(plan.select(F.col("source").alias("_source"), "sid"), alike.source.eqNullSafe(F.col("_source"))).select("doc_id", "sid", "size", "copies", F.xxhash64(F.lit(8), "doc_id", "size").alias("h"))
    ranges = max(1, math.ceil(math.sqrt(rows.count())))
    of = F.expr(f"cast(shiftrightunsigned(h, 33) * {ranges} div 2147483648 as long)")
    placed = written(summed_ahead(named, ["sid"], of, ["h", "doc_id", "size"], F.col("size") * F.col("copies"), "at").drop("h"), "packed")
    lots = placed.filter(F.col("copies") > COPIES).withColumn("first", F.explode(F.expr(f"sequence(0, copies - 1, {COPIES})"))).withColumn("end", F.least(F.col("first") + COPIES, F.col("copies")))
    lots = lots.repartition(shuffle_partitions(rows.sparkSession), "doc_id", "first")
    few = placed.filter(F.col("copies") <= COPIES).withColumn("first", F.lit(0).cast("long")).withColumn("end", F.col("copies"))
    each = few.unionByName(lots).withColumn("i", F.explode(F.expr("sequence(first, end - 1)")))
    return each.select("doc_id", "sid", "size", (F.col("at") + F.col("i") * F.col("size")).alias("at"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row for each row of docs.

    Null texts have no words and give none; null sources are one source, the last in order; repeated rows are
    documents of their own; an empty table gives no rows. Two runs agree: all draws are hashes.
    """
    rows = written(sizes(docs), "sizes")
    per = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    plan = checkpointed(plan_blocks(per, most, block, tolerance))
    times = draws(plan).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    pieces = packed(rows, plan).withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    words = F.expr(f"least(at + size, (block + 1) * {block}) - greatest(at, block * {block})")
    taken = pieces.join(times, ["sid", "block"], "left").groupBy("doc_id", "sid", "size", "at").agg(F.sum(words * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    some = written(taken, "taken").join(plan, "sid").select(columns)
    none = rows.filter("size = 0").join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("taken", F.lit(0).cast("long")).select(columns)
    return some.unionByName(none)


def mixing(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, size, source_size, target, taken; then source."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
