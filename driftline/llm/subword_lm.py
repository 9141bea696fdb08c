"""LM scoring by subword lattice likelihood.

A text is its lower-case (A-Z) words, then one end. A word's lattice holds every
segmentation of the marked word into vocabulary pieces (byte pieces where no
piece fits), then a stop; the vocabulary's scores weight the pieces, and the
forward recursion in log space sums the probabilities of all segmentations. Each
step chooses among all pieces and the stop, so the words' probabilities sum to
at most one. The scores that the vocabulary file states come from other texts;
one round of expectation maximisation over the distinct words of all training
rows adapts them.

A word that training has seen is a piece of its own beside the vocabulary's, and
a word that the text has had before may also be a repeat. So at each word three
ways are summed:

* the word as a whole, ``max(c - D, 0) / N`` with the discount
  ``D = n1 / (n1 + 2 n2)`` of words seen once and twice (0.5 where either is
  missing),
* its segmentations, ``(D V / N) lattice(word)``: what the discount takes from
  the counts is what the lattice shares out,
* a repeat, with the weight ``r = REPEAT m / (m + REPEAT_AT)`` after m words: the
  word's share of the m words before it; the other two weigh 1 - r.

The end has no lattice and keeps its share of the counts. These sum to at most one
over all words, given the words before, so a document's score, their sum of
logarithms, is the log of its marginal probability: no segmentation crosses words.
The repeat's two constants are fixed; on samples of every size that was tried the
held-out score hardly moved between 0.2 and 0.5, and 50 and 200.

Plan. Words are counted over all rows with one pre-aggregated row a word and
task. Documents are then dealt into groups of bounded size by a hash; each
group's distinct words meet the scored words, come back to the group's texts and
are looked up there. No task sees a word's documents together and tokens are
never shuffled one by one. A frequent word meets one row a group there, on one
key; the join is a plain inner one, which Spark splits by the rows' tasks.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import held_out, written
from driftline.llm.unigram import DEFAULT_PATH, SPACE, Vocabulary, load_vocabulary

#: Distinct words that a task holds before it passes them on.
FLUSH = 300_000
#: Tokens that a group of documents is meant to hold.
GROUP_TOKENS = 1_000_000
#: Words whose lattices are computed together, and the length from which a word is computed alone, by the same recursion.
BATCH = 2000
ALONE = 65
REPEAT = 0.3
REPEAT_AT = 50
STOP_WEIGHT = math.log(0.2)
END = ""


class Lattice:
    """Piece log-probabilities by id, then 256 byte pieces, then the stop."""

    def __init__(self, vocabulary: Vocabulary, logp: list[float] | None = None):
        self.vocabulary = vocabulary
        self.automaton = vocabulary.automaton()
        self.n = len(vocabulary.pieces)
        self.logp = normalised(vocabulary) if logp is None else logp
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.apart = not any(SPACE in p[1:] for p in vocabulary.pieces if p.strip(SPACE))
        self._logp = np.array(self.logp)

    def plain(self, word: str) -> bool:
        """Whether a word's lattice has pieces alone, so that it can be computed beside other words."""
        return self.apart and len(word) < ALONE and SPACE not in word and self.single.issuperset(word)

    def batch(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges of many plain words at once, by end within the word: (node at the start, node at the end, piece,
        where each end's edges begin, the words' last nodes). Node a of word k is its first node plus a.

        The marked words stand in one string; each begins with the mark, which no piece has inside, so no match
        reaches from one word into the next."""
        sizes = np.array([len(w) + 1 for w in batch])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        hits = np.array([(last, size, i) for last, (size, i) in self.automaton.iter(SPACE + SPACE.join(batch))], dtype=np.int64)
        word = np.repeat(np.arange(len(batch)), sizes)[hits[:, 0]]
        end = hits[:, 0] + 1 + word  # each word has one node more than characters
        order = np.lexsort((end, hits[:, 0] - first[word]))
        end, start, piece = end[order], (end - hits[:, 1])[order], hits[order, 2]
        level = (hits[:, 0] - first[word])[order]
        return start, end, piece, np.searchsorted(level, np.arange(level[-1] + 2)), first + np.arange(len(batch)) + sizes

    def _sums(self, into: np.ndarray, at: np.ndarray, terms: np.ndarray) -> None:
        """into[a] = log of the sum of exp(terms) for each run of equal a in at."""
        runs = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        top = np.maximum.reduceat(terms, runs)
        total = np.add.reduceat(np.exp(terms - np.repeat(top, np.diff(np.append(runs, len(at))))), runs)
        into[at[runs]] = top + np.log(total)

    def forward(self, batch: list[str], edges: tuple) -> np.ndarray:
        """The forward recursion in log space for many plain words, one step for each end within a word."""
        start, end, piece, levels, last = edges
        alpha = np.full(last[-1] + 1, -np.inf)
        alpha[last - np.array([len(w) + 1 for w in batch])] = 0.0
        weight = self._logp[piece]
        for a, b in zip(levels, levels[1:]):
            if b > a:
                self._sums(alpha, end[a:b], alpha[start[a:b]] + weight[a:b])
        return alpha

    def log_probabilities(self, batch: list[str]) -> list[float]:
        """log_probability of each word; plain words together."""
        out = [0.0] * len(batch)
        plain = [k for k, w in enumerate(batch) if self.plain(w)]
        for k in set(range(len(batch))).difference(plain):
            out[k] = self.log_probability(batch[k])
        if plain:
            some = [batch[k] for k in plain]
            edges = self.batch(some)
            for k, x in zip(plain, (self.forward(some, edges)[edges[4]] + self.logp[-1]).tolist()):
                out[k] = x
        return out

    def expected_of(self, batch: list[str], into: np.ndarray) -> None:
        """expected for each word; plain words together."""
        some = [w for w in batch if self.plain(w)]
        for w in batch:
            if not self.plain(w):
                self.expected(w, into)
        if not some:
            return
        edges = self.batch(some)
        start, end, piece, levels, last = edges
        alpha = self.forward(some, edges)
        weight = self._logp[piece]
        beta = np.full(len(alpha), -np.inf)
        beta[last] = 0.0
        # Backwards by start within the word: all edges out of a node are known before those into it.
        first = last - np.array([len(w) + 1 for w in some])
        word = np.searchsorted(last, start)
        begin = start - first[word]
        order = np.lexsort((start, -begin))
        s, e, w = start[order], end[order], weight[order]
        steps = -begin[order]
        for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.append(np.flatnonzero(np.concatenate([[True], steps[1:] != steps[:-1]])), len(s)))):
            self._sums(beta, s[a:b], beta[e[a:b]] + w[a:b])
        uses = np.exp(alpha[start] + weight + beta[end] - alpha[last][word])
        into += np.bincount(piece, uses, len(into))
        into[-1] += len(some)

    def edges(self, marked: str) -> Iterator[tuple[int, int, int, float]]:
        """(start, end, piece, log-probability) by end; piece -1 stands for the bytes of a character that is no piece."""
        logp = self.logp
        bare = (at for at, c in enumerate(marked) if c not in self.single)
        at = next(bare, None)
        for last, (size, i) in self.automaton.iter(marked):
            while at is not None and at <= last:
                yield at, at + 1, -1, self._spelled(marked[at])
                at = next(bare, None)
            yield last + 1 - size, last + 1, i, logp[i]
        while at is not None:
            yield at, at + 1, -1, self._spelled(marked[at])
            at = next(bare, None)

    def _bytes(self, c: str) -> list[int]:
        return [self.n + b for b in c.encode("utf-8", "surrogatepass")]

    def _spelled(self, c: str) -> float:
        return sum(self.logp[i] for i in self._bytes(c))

    def _alphas(self, marked: str, note=None) -> list[float]:
        """The forward recursion of one word; each edge goes to note."""
        alpha = [0.0] + [-math.inf] * len(marked)
        now, terms = 0, []
        for start, end, piece, p in self.edges(marked):
            if end != now:
                if now:
                    alpha[now] = _log_sum(terms)
                now, terms = end, []
            terms.append(alpha[start] + p)
            if note:
                note(start, end, piece, p)
        alpha[now] = _log_sum(terms)
        return alpha

    def log_probability(self, word: str) -> float:
        """Natural log of the sum over all segmentations of the word, by the forward recursion in log space."""
        return self._alphas(SPACE + word)[-1] + self.logp[-1]

    def expected(self, word: str, into: np.ndarray) -> None:
        """Add the expected number of uses of each piece in the word's segmentations, in log space too."""
        marked = SPACE + word
        starts, ends, pieces, weights = array("i"), array("i"), array("i"), array("d")

        def note(start: int, end: int, piece: int, p: float) -> None:
            starts.append(start)
            ends.append(end)
            pieces.append(piece)
            weights.append(p)

        alpha = self._alphas(marked, note)
        n = len(marked)
        order = np.argsort(-np.frombuffer(starts, np.int32), kind="stable").tolist()
        beta = [-math.inf] * n + [0.0]
        now, terms = n, []
        for k in order:  # by start, backwards: what leaves a node is known before what comes into it
            if starts[k] != now:
                if terms:
                    beta[now] = _log_sum(terms)
                now, terms = starts[k], []
            terms.append(beta[ends[k]] + weights[k])
        for start, end, piece, p in zip(starts, ends, pieces, weights):
            uses = math.exp(alpha[start] + p + beta[end] - alpha[n])
            for i in [piece] if piece >= 0 else self._bytes(marked[start]):
                into[i] += uses
        into[-1] += 1


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum([math.exp(t - top) for t in terms])) if len(terms) > 1 and top > -math.inf else top


def normalised(vocabulary: Vocabulary) -> list[float]:
    """The vocabulary's scores beside the byte pieces and the stop, as log-probabilities that sum to one."""
    raw = [*vocabulary.scores, *[vocabulary.unknown] * 256]
    total = math.log(sum(map(math.exp, raw)))
    keep = math.log1p(-math.exp(STOP_WEIGHT))
    return [x - total + keep for x in raw] + [STOP_WEIGHT]


def adapted(vocabulary: Vocabulary, expected: np.ndarray) -> list[float]:
    """Expected uses, smoothed by the vocabulary's own scores as 1000 uses."""
    prior = np.exp(np.array(normalised(vocabulary)))
    p = expected + 1000 * prior
    return np.log(p / p.sum()).tolist()


def with_repeats(logp: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 probabilities of a document's tokens with repeats: logp without them, word tells equal tokens."""
    m = np.arange(len(word))
    order = np.argsort(word, kind="stable")
    runs = np.flatnonzero(np.concatenate([[True], np.diff(word[order]) != 0]))
    before = np.empty(len(word), np.int64)  # how often the token came before
    before[order] = m - np.repeat(runs, np.diff(np.append(runs, len(word))))
    r = REPEAT * m / (m + REPEAT_AT)
    out = np.log1p(-r) + logp * math.log(10)
    again = before > 0
    out[again] = np.logaddexp(out[again], np.log(r[again] * before[again] / m[again]))
    return out / math.log(10)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _strings(items: list[bytes]) -> pa.Array:
    return pa.array(items, pa.binary()).cast(pa.string())


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, total): how often each word stands in training rows and in all; docs has text and held_out.

    The empty word is the end of a text. A task holds at most FLUSH distinct words at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt, other = Counter(), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for counts, learns in ((learnt, True), (other, False)):
                n = pa.array(counts.values(), pa.int64())
                yield pa.RecordBatch.from_arrays([_strings(list(counts)), n if learns else pa.array(np.zeros(len(n), np.int64)), n], names=["word", "c", "total"])
                counts.clear()

        for b in batches:
            for text, held in zip(b.column(0), b.column(1)):
                (other if held.as_py() else learnt).update([*words(text.as_py()), b""])
                if len(learnt) + len(other) >= FLUSH:
                    yield from flush()
        yield from flush()

    return docs.select("text", "held_out").mapInArrow(run, "word string, c long, total long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def adapt(words_table: DataFrame, vocabulary: Vocabulary) -> list[float]:
    """One round of expectation maximisation over the distinct words of the training rows.

    What comes to the driver is one number a piece: its size is the vocabulary's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary)
        into = np.zeros(lattice.n + 257)
        for b in batches:
            some = b.column(0).to_pylist()
            for at in range(0, len(some), BATCH):
                lattice.expected_of(some[at : at + BATCH], into)
        at = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(into[at], pa.float64())], names=["piece", "uses"])

    learn = words_table.filter((F.col("c") > 0) & (F.col("word") != END)).select("word")
    expected = np.zeros(len(vocabulary.pieces) + 257)
    for r in learn.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
        expected[r.piece] = r.uses
    return adapted(vocabulary, expected)


def lattice_scores(words_table: DataFrame, vocabulary: Vocabulary, logp: list[float]) -> DataFrame:
    """(word, c, lattice): the natural log of each word's marginal probability; 0 for the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary, logp)
        for b in batches:
            some = b.column(0).to_pylist()
            out = [x for at in range(0, len(some), BATCH) for x in lattice.log_probabilities(some[at : at + BATCH])]
            out = [x if w else 0.0 for w, x in zip(some, out)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["word", "c", "lattice"])

    return words_table.select("word", "c").mapInArrow(run, "word string, c long, lattice double")


def lm_scores(docs: DataFrame, path: str = DEFAULT_PATH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """The contract's rows, and lattice_score: the log10 probability of the words by the vocabulary's segmentations alone.

    One row for each row of docs. A null or empty text is an end alone. Without training rows the segmentations and the
    repeats give the score. An empty table gives no rows.
    """
    vocabulary = load_vocabulary(path)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("held_out", held_out(F.col("doc_id"), 7, 2))
    table = written(count_words(base), "words")
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    c = F.col("c")
    s = table.agg(F.sum("c").alias("n"), one(c > 0).alias("v"), one(c == 1).alias("n1"), one(c == 2).alias("n2"), F.sum("total").alias("total")).first()
    n, v, total = s["n"] or 0, s["v"] or 0, s["total"] or 0
    discount = s["n1"] / (s["n1"] + 2 * s["n2"]) if s["n1"] and s["n2"] else 0.5
    share = discount * v / n if n else 1.0
    scored = lattice_scores(table, vocabulary, adapt(table, vocabulary) if v else normalised(vocabulary))
    # Single precision is enough for a logarithm and half as much to move.
    scored = scored.select("word", "c", F.col("lattice").cast("float").alias("lattice"))
    groups = max(1, math.ceil(total / group_tokens))
    dealt = base.withColumn("g", F.pmod(F.xxhash64("text", "doc_id"), F.lit(groups)).cast("int")).repartition("g")

    def vocabulary_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[bytes]] = {}
        held = 0
        for b in batches:
            for text, g in zip(b.column("text"), b.column("g")):
                own = seen.setdefault(g.as_py(), set())
                held -= len(own)
                own.update(words(text.as_py()))
                own.add(b"")
                held += len(own)
                if held >= 2 * FLUSH:
                    yield from emit(seen)
                    held = 0
        yield from emit(seen)

    def emit(seen: dict[int, set[bytes]]) -> Iterator[pa.RecordBatch]:
        for g, own in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), g), pa.int32()), _strings(list(own))], names=["g", "word"])
        seen.clear()

    # All columns go through, so that this and the look-up below share one exchange of the texts.
    needed = dealt.mapInArrow(vocabulary_of, "g int, word string")
    looked_up = needed.join(scored, "word").select("g", "word", "c", "lattice")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        at = {w: i for i, w in enumerate(right.column("word").cast(pa.binary()).to_pylist())}
        count, lattice = right.column("c").to_numpy(), right.column("lattice").to_numpy().astype(np.float64)
        add_one = np.log10((count + 1) / (n + v + 1))
        counted = np.maximum(count - discount, 0) / max(n, 1)
        with np.errstate(divide="ignore", under="ignore"):
            p = np.where(counted > 0, np.log10(counted + share * np.exp(lattice)), (math.log(share) + lattice) / math.log(10) if share else -math.inf)
        end = at.get(b"")
        if end is not None:
            p[end] = math.log10(counted[end]) if counted[end] > 0 else (add_one[end] if n else 0.0)
        # A discount of nothing leaves the unseen words the share that adding one would.
        p = np.where(np.isfinite(p), p, add_one)
        out: list[list] = [[], [], [], [], []]
        for text in left.column("text"):
            tokens = [*words(text.as_py()), b""]
            idx = np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))
            for x, value in zip(out, (len(tokens), int((count[idx] > 0).sum()), add_one[idx].sum(), with_repeats(p[idx], idx).sum(), lattice[idx].sum() / math.log(10))):
                x.append(value)
        arrays = [left.column("doc_id"), left.column("held_out"), *[pa.array(x, pa.int64()) for x in out[:2]], *[pa.array([float(v) for v in x], pa.float64()) for x in out[2:]]]
        return pa.Table.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "lattice_score"])

    got = dealt.groupBy("g").cogroup(looked_up.groupBy("g")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, lattice_score double")
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "lattice_score")
