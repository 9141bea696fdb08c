"""SimHash near-duplicates by pivot distance tables.

Fingerprint. Words are lower-cased (A-Z) runs of non-white-space; every run of
three words (all words where there are fewer) is hashed with XXH64, seed 42; a
bit is set where more than half of the hashes have it. A text without words has
fingerprint zero, and so have null texts.

Pivots. The reference fingerprints are the zero word and, for each of the 16
half-bytes, three words with three of its four bits set. The distances to the
three words of a half-byte, taken relative to the distance to the zero word,
tell all 16 values of that half-byte apart (the parity of their sum gives one
bit, the differences the rest), so 49 distances resolve the 64 bits.

The distances of every distinct fingerprint to the 49 references are computed
once and written as a table; keys and discards read them from there.

Candidates. Two fingerprints at distance <= 3 differ in at most three of six
groups of half-bytes, so the relative distances of at least three whole groups
are equal: each of the 20 choices of three groups is one table keyed by those
distances. Only fingerprints that share a key with another carry their distances
on. Pairs that meet are discarded when the largest difference of a coordinate
exceeds 3, and the survivors are verified by the exact distance.

Large groups. Fingerprints are made distinct first, so copies cost one row. A
key that gathers more than ``pair_limit`` fingerprints would make pairs with
the square of its size; such fingerprints are linked through balls instead.
Two words within distance 1 of the same centre are within 2 of each other, and
a word within 1 and a word within 2 of a centre are within 3. So every such
fingerprint meets the others at the centres of its 1-ball (65 rows); this finds
the links of distance 1 and 2. A link of distance 3 that is still missing then
joins two components; every fingerprint outside the largest of them sends its
2-ball (2081 rows) to meet the others' 1-balls. No link is lost and the
rows stay proportional to the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import checkpointed, unused, written
from driftline.llm.components import connected_components

SEED = 42
MAX_DISTANCE = 3
SHINGLE = 3
#: Half-bytes of each group; six groups, so three differing bits leave three groups equal.
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (9, 10, 11), (12, 13), (14, 15))
#: Three words a half-byte: bits 0,1,3 / 0,2,3 / 1,2,3 of it.
NIBBLE_PIVOTS = (0b1011, 0b1101, 0b1110)
PAIR_LIMIT = 256


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes. Counted in blocks, so memory does not follow the text."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp, row) for each row of docs: the fingerprint as a signed long and a hash of all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), b.column(2)], names=["id", "fp", "row"])

    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.xxhash64(*docs.columns).alias("row"))
    return some.mapInArrow(run, "id long, fp long, row long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots() -> list[int]:
    """Unsigned reference fingerprints; the first is the zero word."""
    return [0] + [mask << (4 * n) for n in range(16) for mask in NIBBLE_PIVOTS]


def pivot_distances(fp: Column) -> list[Column]:
    return [F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)).cast("long"))) for p in pivots()]


def distance_table(fps: DataFrame) -> DataFrame:
    """(fp, d): the pivot distances of each fingerprint."""
    return fps.select("fp", F.array(*pivot_distances(F.col("fp"))).cast("array<tinyint>").alias("d"))


def _table_rows(distances: DataFrame) -> DataFrame:
    """(fp, table, key): the relative pivot distances of three groups, hashed to a key."""
    # A relative distance is -3, -1, 1 or 3: three bits each, packed group by group.
    packed = [F.aggregate(F.slice("d", 2 + 3 * g[0], 3 * len(g)), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 3).bitwiseOR((x - F.get("d", F.lit(0)) + 3).cast("long"))).alias(f"g{k}") for k, g in enumerate(GROUPS)]
    d = distances.select("fp", *packed)
    tables = list(combinations(range(len(GROUPS)), len(GROUPS) - MAX_DISTANCE))
    rows = F.array(*[F.struct(F.lit(t).cast("tinyint").alias("table"), F.xxhash64(*[F.col(f"g{k}") for k in c]).alias("key")) for t, c in enumerate(tables)])
    return d.select("fp", F.explode(rows).alias("r")).select("fp", "r.table", "r.key")


def links(fps: DataFrame, pair_limit: int = PAIR_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(edges, hot): edges (a, b) between distinct fingerprints at distance <= 3 that meet under a key with at most
    pair_limit fingerprints, each once or more, and the fingerprints that have a fuller key, whose links among each
    other link_hot gives."""
    distances = written(distance_table(fps), "distances")
    rows = _table_rows(distances)
    sizes = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = written(rows.join(sizes, ["table", "key"]).select("fp", "table", "key", "n").join(distances, "fp"), "met")
    cold = met.filter(F.col("n") <= pair_limit)
    a, b = (cold.select(F.col("fp").alias(x), F.col("d").alias(f"d_{x}"), "table", "key") for x in "ab")
    pairs = a.join(b, ["table", "key"]).filter(F.col("a") < F.col("b"))
    apart = F.array_max(F.zip_with("d_a", "d_b", lambda x, y: F.abs(x - y)))
    edges = pairs.filter(apart <= MAX_DISTANCE).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE).select("a", "b")
    hot = met.filter(F.col("n") > pair_limit).select("fp").distinct()
    return edges, hot


def _ball(radius: int) -> list[int]:
    return [_signed(sum(1 << i for i in bits)) for r in range(radius + 1) for bits in combinations(range(64), r)]


def _meet(near: DataFrame, far: DataFrame | None = None) -> DataFrame:
    """Edges between fingerprints that meet at the centre of a ball: near have it within 1, far within 2."""
    masks = F.array(*[F.lit(m).cast("long") for m in _ball(1)])
    rows = near.select("fp", F.explode(masks).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("z"), F.col("fp"))
    hubs = rows.groupBy("z").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n"))
    if far is None:
        # Members of one centre are within 2 of each other, so linking each to the least of them loses no connection.
        return rows.join(hubs.filter("n > 1"), "z").filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    wide = F.array(*[F.lit(m).cast("long") for m in _ball(2)])
    reach = far.select("fp", F.explode(wide).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("z"), "fp")
    return reach.join(hubs, "z").filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def link_hot(hot: DataFrame) -> DataFrame:
    """Edges that connect what links of distance <= 3 connect among the fingerprints of hot, without all pairs."""
    close = checkpointed(_meet(hot).distinct())
    comp = connected_components(close, hot.select(F.col("fp").alias("node")))
    largest = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    rest = comp.join(F.broadcast(largest.select("component")), "component", "left_anti").select(F.col("node").alias("fp"))
    return close.unionByName(_meet(hot, rest))


def _labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(id, fp, row, c, component_id) for each row of docs; c tells components apart that share their smallest id."""
    rows = checkpointed(with_fingerprint(docs, id_col, text_col))
    fps = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("first")))
    edges, hot = links(fps.select("fp"), pair_limit)
    edges = checkpointed(edges.distinct())
    if not hot.isEmpty():
        hot = checkpointed(hot)
        edges = checkpointed(edges.unionByName(link_hot(hot)))
    comp = connected_components(edges)
    labels = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    firsts = labels.groupBy("c").agg(F.min("first").alias("component_id"))
    of_fp = labels.join(firsts, "c").select("fp", "c", "component_id")
    # A fingerprint that a third of the rows share is met by a broadcast or a split join; of_fp has one row each.
    return rows.join(of_fp, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(id, fp, component_id) for each row of docs: the fingerprint as a signed long and the smallest id that links reach.

    Null texts are empty texts; rows that repeat an id keep one result row each; rows with a null id get the component
    of their fingerprint, or null where only null ids reach it. An empty table gives an empty result.
    """
    return _labelled(docs, id_col, text_col, pair_limit).select("id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates one row: of those with the smallest id, the one with the smallest hash of its columns.

    Rows that share an id but not a group all stay, as do rows without an id, which form no group that could be told apart.
    """
    key, row = unused(docs, "id"), unused(docs, "row")
    first = _labelled(docs).filter(F.col("id") == F.col("component_id"))
    found = first.groupBy("c").agg(F.min_by(F.struct("id", "row"), "row").alias("k")).select(F.col("k.id").alias(key), F.col("k.row").alias(row))
    named = docs.filter(F.col("doc_id").isNotNull()).select("*", F.col("doc_id").cast("long").alias(key), F.xxhash64(*docs.columns).alias(row))
    kept = named.join(found, [key, row], "left_semi").dropDuplicates([key, row])
    return kept.select(docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
