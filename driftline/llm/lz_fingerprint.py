"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed into phrases (LZ78: each phrase is the shortest
that the dictionary does not have yet, and enters it), the phrases are hashed,
and the fingerprint keeps the least hash in each of 128 bins, as 16-bit values:
a minimum-hash signature of the phrase set. Texts that compress alike share
phrases. The likeness of two fingerprints is the share of equal bins among those
that either fills; equal texts have equal fingerprints, and two empty ones are
alike.

The dictionary has every prefix of its phrases, so the length of the next phrase
is found by stepping from the last one's: two or three look-ups a phrase.

Every document is also fingerprinted with its last third replaced by the head of
the next document in descending order of id (after the last: the first). The
kept part is parsed once; the parse goes on from its last whole phrase.

Next documents are found by range: documents are dealt by ranges of their id,
the first document of each range goes to the range before it too, and each range
is read in order, one document behind. No range is held in memory.

Null texts are empty; null ids come last; equal ids follow each other in the
order of the SHA-256 of their texts; a lone document is its own next.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import shuffle_partitions

BINS = 128
EMPTY = "0" * (4 * BINS)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Parse:
    """A parse that can be stopped at a byte and continued with other bytes."""

    def __init__(self):
        self.phrases: set[bytes] = set()
        self.log: list[bytes] = []
        self.size = 1

    def feed(self, raw: bytes, start: int = 0) -> int:
        """Parse raw from start; gives the start of the unfinished last phrase, which is known already (or len(raw))."""
        phrases, add, note = self.phrases, self.phrases.add, self.log.append
        n, at, k = len(raw), start, self.size
        while at < n:
            piece = raw[at : at + k]
            if piece in phrases:
                while True:
                    k += 1
                    if at + k > n:
                        self.size = max(1, k - 1)
                        return at
                    piece = raw[at : at + k]
                    if piece not in phrases:
                        break
            else:
                while k > 1:
                    shorter = raw[at : at + k - 1]
                    if shorter in phrases:
                        break
                    k -= 1
                    piece = shorter
                piece = raw[at : at + k]
            add(piece)
            note(piece)
            at += len(piece)
        self.size = max(1, k)
        return at


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin as 16 bits above zero; zero where a bin has none."""
    out = np.zeros(BINS, np.uint16)
    if len(hashes):
        least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
        bins = (hashes % np.uint64(BINS)).astype(np.int64)
        np.minimum.at(least, bins, hashes >> np.uint64(7))
        filled = np.zeros(BINS, bool)
        filled[bins] = True
        out[filled] = ((least[filled] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16) | 1
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([a, b])


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = int(((a != 0) | (b != 0)).sum())
    return float(((a == b) & (a != 0)).sum()) / filled if filled else 1.0


def _hashes(phrases: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, phrases), np.uint64, len(phrases))


def edited_text(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def fingerprints(text: str, following: str) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the text and of its edited form."""
    raw, cut = text.encode("utf-8", "surrogatepass"), len(text) // 3
    kept = text[: len(text) - cut].encode("utf-8", "surrogatepass") if cut else raw
    parse = Parse()
    rest = parse.feed(kept)
    shared = len(parse.log)
    whole = Parse()
    # The two parses agree up to `rest`; each goes on with its own tail.
    whole.phrases, whole.size = (set(parse.phrases) if cut else parse.phrases), parse.size
    tail_from = rest
    whole.feed(raw, tail_from)
    head = _hashes(parse.log[:shared])
    # An unfinished last phrase is in the set already, so it adds nothing.
    own = signature(merged(head, _hashes(whole.log)))
    if not cut:
        return own, own
    edited = kept + following[:cut].encode("utf-8", "surrogatepass")
    parse.log = []
    parse.feed(edited, rest)
    return own, signature(merged(head, _hashes(parse.log)))


def signature_of(text: str | None) -> np.ndarray:
    return fingerprints(text or "", "")[0]


def _result(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, those of a range together and its follower last; each row but the follower gives one result."""
    rows: list[tuple] = []
    held: tuple | None = None  # (range, doc_id, text)

    def step(doc_id, text: str, following: str, later: np.ndarray, own: np.ndarray, edited: np.ndarray) -> tuple:
        sha = hashlib.sha256(edited_text(text, following).encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, len(text), sha, as_text(own), as_text(edited), likeness(own, edited), likeness(own, later))

    waiting: tuple | None = None  # the row before, whose next fingerprint is due
    for b in batches:
        for part, extra, doc_id, value in zip(*(c.to_pylist() for c in b.columns)):
            text = value or ""
            if held is not None and held[0] == part:
                # held's next is this row.
                own, edited = fingerprints(held[2], text)
                if waiting is not None and waiting[0] == part:
                    rows.append(step(waiting[1], waiting[2], held[2], own, waiting[3], waiting[4]))
                waiting = (part, held[1], held[2], own, edited)
                if extra:
                    rows.append(step(held[1], held[2], text, signature_of(text), own, edited))
                    waiting = held = None
                    continue
            elif extra:
                continue  # a second follower of the same range
            held = (part, doc_id, text)
            if len(rows) >= 512:
                yield _result(rows)
                rows = []
    if rows:
        yield _result(rows)


def ranges(docs: DataFrame, parts: int) -> list[int]:
    """Upper ids of the ranges but the last, in ascending order: at most parts - 1 numbers."""
    if parts < 2:
        return []
    cuts = docs.filter("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return sorted({int(x) for x in cuts})


def lz_fingerprint(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """The contract's rows, one for each row of docs: doc_id, n_chars, edited_sha256, the two fingerprints and
    their likenesses. An empty table gives no rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = parts or max(2 * shuffle_partitions(spark), 8)
    cuts = ranges(rows.select("doc_id"), parts)
    # Range 0 has the largest ids; null ids belong to the last range.
    n = len(cuts) + 1
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    above = F.size(F.filter(bounds, lambda c: c < F.col("doc_id")))
    part = F.when(F.col("doc_id").isNull(), F.lit(n - 1)).otherwise(F.lit(n - 1) - above).cast("int")
    firsts = rows.select(part.alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("doc_id")).collect()  # one row a range
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    order = sorted((r.part, r.doc_id) for r in firsts)
    sends = {doc_id: order[i - 1][0] for i, (_, doc_id) in enumerate(order)}  # the first goes behind the last
    whither = F.create_map(*[F.lit(x) for k, v in sends.items() if k is not None for x in (k, v)]) if any(k is not None for k in sends) else None
    to = whither[F.col("doc_id")] if whither is not None else F.lit(None).cast("int")
    if None in sends:  # a range of null ids alone
        to = F.coalesce(to, F.when(F.col("doc_id").isNull(), F.lit(sends[None])))
    copies = F.array_compact(F.array(F.struct(part.alias("part"), F.lit(False).alias("extra")), F.when(to.isNotNull(), F.struct(to.cast("int").alias("part"), F.lit(True).alias("extra")))))
    dealt = rows.select(F.explode(copies).alias("k"), "doc_id", "text").select("k.part", "k.extra", "doc_id", "text")
    placed = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), F.sha2("text", 256))
    return placed.mapInArrow(_ordered, SCHEMA)
