"""Text kernels as Column expressions: normal form, hash, shingles, tokens, sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.plans.definitions import STOPWORDS


def nfkc(text: Column) -> Column:
    """Compatibility composition (NFKC), by the library that Spark itself sorts with. ASCII is its own normal form."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), composed).otherwise(text)


def normalise(text: Column) -> Column:
    """NFKC, then lower case; runs of anything but a-z, 0-9 and space become one space; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(nfkc(text)), "[^a-z0-9 ]+", " "), " +", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(normalise(text), 256)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def tokens(text: Column) -> Column:
    """Distinct search tokens: a-z and 0-9 runs of more than two characters that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    stop = F.array(*[F.lit(s) for s in STOPWORDS])
    return F.array_except(F.array_distinct(F.filter(found, lambda t: F.length(t) > 2)), stop)


def sentences(text: Column) -> Column:
    """Sentences, split at white space after a full stop, exclamation or question mark; empty ones go."""
    return F.filter(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(numbers: Column) -> Column:
    """0 and the sums of the first one, two, ... numbers."""
    return F.aggregate(numbers, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def sums_before(numbers: Column) -> Column:
    """For each of an array's numbers the sum of those before it. In runs of the root of their count, as an array that
    grows by one is copied each time."""

    def split(n: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(n).cast("double"))).cast("int"))
        starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / width).cast("int")), lambda c: c * width + 1)
        runs = F.transform(starts, lambda at: _running(F.slice(n, at, width)))
        return let(runs, lambda r: F.flatten(F.zip_with(r, F.slice(_running(F.transform(r, lambda x: F.element_at(x, -1))), F.lit(1), F.size(r)), lambda x, base: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda y: y + base))))

    return F.when(F.size(numbers) > 0, let(numbers, split)).otherwise(F.array().cast("array<int>"))


def sentence_spans(text: Column) -> Column:
    """Structs (start, end, sentence); offsets in characters of the text, from the lengths of the sentences and what
    separates them."""
    gap = r"(?U)(?<=[.!?])\s+"
    pieces = F.split(text, gap)
    lengths = F.zip_with(pieces, F.regexp_extract_all(text, F.lit(f"({gap})"), 1), lambda p, g: F.length(p) + F.coalesce(F.length(g), F.lit(0)))
    spans = F.zip_with(pieces, sums_before(lengths), lambda p, at: F.struct(at.cast("int").alias("start"), (at + F.length(p)).cast("int").alias("end"), F.trim(p).alias("sentence")))
    return F.filter(spans, lambda s: s["end"] > s["start"])


def shingles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """(id, shingles): the 64-bit hashes of the distinct runs of size words of the normal form, or of all words where there
    are fewer; none for a text without words. The words come out of a generator, which no later filter or projection is
    merged into: else the text would be split again for every word. Runs are made by zipping the words with themselves,
    moved on by one to size - 1 places, so no run is put together as a string."""
    w = docs.select(F.col(id_col), F.explode(F.array(F.split(normalise(F.col(text_col)), " "))).alias("w"))
    runs = F.greatest(F.size("w") - (size - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice("w", F.lit(k + 1), runs).alias(f"w{k}") for k in range(size)])
    full = F.when(runs > 0, F.transform(zipped, lambda s: F.xxhash64(s))).when(F.array_join("w", "") == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64("w")))
    return w.select(F.col(id_col), F.array_distinct(full).alias("shingles"))
