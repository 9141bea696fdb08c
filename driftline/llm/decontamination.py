"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with every run of white space as one
space. An item of m characters may differ by k = floor(rate * m) edits. Cut
into k + 1 pieces, at least one piece of any such passage stands unchanged, so
an Aho-Corasick automaton over all pieces finds every candidate place in one
pass over a text; Myers' bit-parallel distance, with the whole item as the
pattern, then decides on the window around it. An item without words matches
nothing.

Items are taken in blocks of at most BLOCK_CHARS characters: the automaton that
goes to the executors is bounded by that, and more items mean more passes.

Null and empty texts have no matches; null items are ignored; a repeated item id
is matched with each of its texts; each row of a repeated document id is
matched on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 0.07
BLOCK_CHARS = 2_000_000
MATCH = "array<struct<item_id:bigint,distance:int,end:int>>"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces whose lengths differ by at most one."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def peq(item: str) -> dict[str, int]:
    """For each character the positions of the item that hold it, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(masks: dict[str, int], m: int, window: str) -> tuple[int, int]:
    """(distance, end) of the substring of window nearest to the item of m characters, the first such end (Myers, 1999)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(window):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, at = score, j + 1
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return best, at


class Matcher:
    """One block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(i, t, int(rate * len(t))) for i, x in items if (t := normal(x))]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for at, piece in pieces(t, k):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.masks = [peq(t) for _, t, _ in self.items]
        self.empty = not places

    def __call__(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normal form), the nearest place of each item within its budget."""
        if self.empty:
            return []
        body = normal(text)
        windows: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(body):
            begin = last + 1 - size
            for n, at in where:
                _, t, k = self.items[n]
                lo, hi = max(0, begin - at - k), min(len(body), begin - at + len(t) + k)
                spans = windows.setdefault(n, [])
                # Hits come in the order of their ends; begins of one item's windows may step back by its length.
                if spans and lo <= spans[-1][1]:
                    spans[-1][0], spans[-1][1] = min(lo, spans[-1][0]), max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
        found = []
        for n, spans in windows.items():
            i, t, k = self.items[n]
            d, end = min((d, lo + e) for lo, hi in spans for d, e in [best_match(self.masks[n], len(t), body[lo:hi])])
            if d <= k:
                found.append((i, d, end))
        return sorted(found)


def item_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items by id, a bounded block at a time."""
    block, held = [], 0
    rows = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if block and held + len(r.text) > chars:
            yield block
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += len(r.text)
    if block:
        yield block


def matches(text: Column, block: list[tuple[int, str]], rate: float = RATE) -> Column:
    kept: list[Matcher] = []

    @F.arrow_udf(MATCH)
    def run(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Matcher(block, rate))
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"item_id": i, "distance": d, "end": e} for i, d, e in kept[0](t.as_py())] for t in texts], kind)

    return run(text)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, end): for each row of docs each item that a passage of it is within budget of."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(benchmark):
        found = base.select("doc_id", F.inline(matches(F.col("text"), block, rate)))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return base.limit(0).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("distance", "int"), ("end", "int"))])
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs without a benchmark passage."""
    for block in item_blocks(benchmark):
        docs = docs.filter(F.size(matches(F.col("text").cast("string"), block, rate)) == 0)
    return docs
