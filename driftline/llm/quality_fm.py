"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Every text gives a sparse vector: hashed lower-case words (square roots of
their shares), ratios that describe its structure (capitals, digits, symbols,
separators, repetition, line and word lengths; each as a value and as one of
eight bins) and the length stated beside it. The score is
``sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum (v_if x_i)^2])``:
the sum-of-squares identity makes all pairwise interactions cost one pass.

Training takes at most ``TRAIN_ROWS`` labelled rows, those with the smallest
hash of their id, so that it is the same whatever the layout of the tables.
Their vectors, not their texts, go to the driver. Everything else scans all rows.

Null and empty texts have a vector too and so a score; a null ``n_chars`` is the
text's length. Labels that contradict each other count as the lower one. Without
labelled rows every score is 0.5.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import held_out

TRAIN_ROWS = 6000
WORD_BITS = 15
RANK = 8
EPOCHS = 6
THRESHOLD = 0.3
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SPACE = b"\t\n\x0b\x0c\r "
_HIGH = bytes(range(128, 256))
_STATS = 14
_BINS = 8
_WORDS = 1 << WORD_BITS
DIM = _WORDS + _STATS * (_BINS + 1)


def structure(raw: bytes, words: list[bytes], counts: Counter, stated: int | None) -> list[float]:
    """Values in [0, 1]; the counts are those of the lower-case words."""
    n, w = max(1, len(raw)), max(1, len(words))
    less = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    upper, lower, digit, space, high = (less(c) for c in (_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH))
    lines = raw.split(b"\n")
    same = sum(a == b for a, b in zip(words, words[1:])) / w
    return [
        upper,
        lower,
        digit,
        max(0.0, 1 - upper - lower - digit - space - high),
        high,
        min(1.0, 10 * raw.count(b"|") / w),
        min(1.0, 5 * (raw.count(b"!") + raw.count(b"?")) / w),
        same,
        len(counts) / w,
        max(counts.values(), default=0) / w,
        min(1.0, (n - space * n) / w / 16),
        1 - len(set(lines)) / len(lines),
        min(1.0, math.log1p(len(words)) / 12),
        min(1.0, math.log1p(max(0, len(raw) if stated is None else stated)) / 14),
    ]


def vector(text: str | None, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; an index may repeat, which the sums allow."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    counts = Counter(words)
    stats = structure(raw, words, counts, stated)
    crc, mask = zlib.crc32, _WORDS - 1
    idx = [crc(word) & mask for word in counts]
    val = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)) / max(1, len(words)))
    at = [_WORDS + s * (_BINS + 1) for s in range(_STATS)]
    idx += at + [a + 1 + min(_BINS - 1, int(x * _BINS)) for a, x in zip(at, stats)]
    return np.array(idx, np.int32), np.concatenate([val, np.array(stats, np.float32), np.full(_STATS, 0.5, np.float32)])


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, idx: np.ndarray, val: np.ndarray) -> float:
        vx = self.v[idx] * val[:, None]
        sums = vx.sum(axis=0)
        return float(self.w0 + self.w[idx] @ val + 0.5 * (sums @ sums - np.einsum("ij,ij->", vx, vx)))

    def score(self, text: str | None, stated: int | None) -> float:
        z = self.margin(*vector(text, stated))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 11) -> FactorisationMachine:
    """Logistic loss by AdaGrad, one row at a time in a seeded order."""
    rng = np.random.default_rng(seed)
    m = FactorisationMachine(0.0, np.zeros(DIM, np.float32), rng.normal(0, 0.01, (DIM, RANK)).astype(np.float32))
    if not rows:
        return FactorisationMachine(0.0, m.w, np.zeros_like(m.v))
    g0, gw, gv = 1.0, np.full(DIM, 0.1, np.float32), np.full((DIM, RANK), 0.1, np.float32)
    decay = 1e-5
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            idx, val, y = rows[r]
            v = m.v[idx]
            vx = v * val[:, None]
            sums = vx.sum(axis=0)
            z = m.w0 + m.w[idx] @ val + 0.5 * (sums @ sums - np.einsum("ij,ij->", vx, vx))
            e = 1 / (1 + math.exp(-min(30.0, max(-30.0, float(z))))) - y
            dw = e * val + decay * m.w[idx]
            dv = e * val[:, None] * (sums - vx) + decay * v
            g0 += e * e
            m.w0 -= 0.1 * e / math.sqrt(g0)
            gw[idx] += dw * dw
            m.w[idx] -= 0.1 * dw / np.sqrt(gw[idx])
            gv[idx] += dv * dv
            m.v[idx] -= 0.05 * dv / np.sqrt(gv[idx])
    return m


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """Fit on at most rows labelled documents that are not held out (crc32 of the id mod 5 is 0)."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), 5, 0))
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(*order).limit(rows)

    # Vectors travel as bytes: as numbers one by one they would be boxed in the driver's Python, many times their size.
    @F.arrow_udf("struct<i:binary,v:binary>")
    def features(text: pa.Array, stated: pa.Array) -> pa.Array:
        out = [vector(t.as_py(), n.as_py()) for t, n in zip(text, stated)]
        return pa.array([{"i": i.astype("<i4").tobytes(), "v": v.astype("<f4").tobytes()} for i, v in out], pa.struct([("i", pa.binary()), ("v", pa.binary())]))

    # chosen has at most `rows` rows of two numbers, which is what makes the broadcast safe.
    sample = _inputs(docs).join(F.broadcast(chosen), "doc_id").orderBy(*order, F.xxhash64("text")).limit(rows)
    got = sample.select("doc_id", "quality", features("text", "n_chars").alias("x")).collect()
    return fit([(np.frombuffer(r.x.i, "<i4"), np.frombuffer(r.x.v, "<f4"), int(r.quality)) for r in got])


def _inputs(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), stated.alias("n_chars"))


def quality_score(model: FactorisationMachine, text: Column, stated: Column) -> Column:
    @F.arrow_udf("double")
    def score(t: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([model.score(a.as_py(), b.as_py()) for a, b in zip(t, n)], pa.float64())

    return score(text, stated)


def quality_fm(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted; one for each row of docs."""
    model = train(docs, labels)
    scored = _inputs(docs).select("doc_id", quality_score(model, F.col("text"), F.col("n_chars")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with docs' columns."""
    model = train(docs, labels)
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.filter(quality_score(model, F.col("text").cast("string"), stated) >= threshold)
