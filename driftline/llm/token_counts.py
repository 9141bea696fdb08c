"""Token counts: Viterbi over a unigram vocabulary that keeps scores and counts only.

White space: a space is the mark U+2581 and one stands before the text. An
Aho-Corasick automaton lists every vocabulary match; for each position the
dynamic programme carries the best score of a segmentation that ends there and
its number of pieces. Ties go as in the tokenizers that use such vocabularies:
a later candidate must be better than the one held, and candidates come in the
order of their starts, so the longest piece wins. A character that is no piece
of its own may be an unknown piece, scored by the lowest score less 10, and
counts one piece a UTF-8 byte.

No piece has the mark after another character or a line feed beside another
character, so the best segmentation of a text is that of its words and line
feeds side by side; a vocabulary where that fails is segmented as one piece of
text. Words that a worker has met lately are not segmented again.

Null and empty texts have no tokens. Each row is counted on its own.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.unigram import DEFAULT_PATH, SPACE, Vocabulary, load_vocabulary

#: Words that a worker keeps; beyond it the memory starts anew.
CACHE = 200_000
_CHUNKS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.scores = vocabulary.scores
        self.automaton = vocabulary.automaton()
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.unknown = vocabulary.unknown
        inner = re.compile(f"[^{SPACE}]{SPACE}|\n.|.\n", re.S)
        self.whole = any(inner.search(p) for p in vocabulary.pieces)
        self.memory: dict[str, int] = {}

    def segment(self, s: str) -> tuple[float, int]:
        """(score, pieces) of the best segmentation of s, which is not empty and has its marks."""
        n = len(s)
        best, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        scores = self.scores
        if self.single.issuperset(s):
            for last, (size, i) in self.automaton.iter(s):  # by end, the longest first
                c = best[last + 1 - size] + scores[i]
                if c > best[last + 1]:
                    best[last + 1] = c
                    count[last + 1] = count[last + 1 - size] + 1
            return best[n], count[n]
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, hit in self.automaton.iter(s):
            ends[last].append(hit)
        for last in range(n):
            for size, i in ends[last]:
                c = best[last + 1 - size] + scores[i]
                if c > best[last + 1]:
                    best[last + 1] = c
                    count[last + 1] = count[last + 1 - size] + 1
            if s[last] not in self.single and best[last] + self.unknown > best[last + 1]:
                best[last + 1] = best[last] + self.unknown
                count[last + 1] = count[last] + len(s[last].encode("utf-8", "surrogatepass"))
        return best[n], count[n]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        s = SPACE + text.replace(" ", SPACE)
        if self.whole:
            return self.segment(s)[1]
        memory, total = self.memory, 0
        for word in _CHUNKS.findall(s):
            n = memory.get(word)
            if n is None:
                n = self.segment(word)[1]
                if len(word) <= 64:
                    if len(memory) >= CACHE:
                        memory.clear()
                    memory[word] = n
            total += n
        return total


def n_tokens(text: Column, vocabulary: Vocabulary) -> Column:
    """The vocabulary goes along with the function: its size is that of its file, whatever the data."""
    kept: list[Counter] = []

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Counter(vocabulary))
        return pa.array([kept[0](t.as_py()) for t in texts], pa.int64())

    return run(text)


def token_counts(docs: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """(doc_id, n_tokens), one row for each row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_tokens(F.col("text").cast("string"), load_vocabulary(path)).alias("n_tokens"))
