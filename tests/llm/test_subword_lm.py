import math
import zlib
from collections import Counter

import pytest

from driftline.llm import subword_lm as M
from driftline.llm.unigram import SPACE, Vocabulary, load_vocabulary


def all_segmentations(lattice, marked):
    """Sum over every way to cut the marked word, by recursion over plain substrings."""
    ids = {p: i for i, p in enumerate(lattice.vocabulary.pieces)}

    def total(rest):
        if not rest:
            return 1.0
        out = sum(math.exp(lattice.logp[ids[rest[:k]]]) * total(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in ids)
        if rest[0] not in ids:
            out += math.exp(sum(lattice.logp[lattice.n + b] for b in rest[0].encode())) * total(rest[1:])
        return out

    return math.log(total(marked)) + lattice.logp[-1]


def test_forward_recursion_sums_all_segmentations():
    v = Vocabulary([SPACE, SPACE + "a", "a", "b", "ab", "ba", "aba", "bb"], [-1.0, -2.0, -2.0, -2.5, -3.0, -3.0, -4.0, -5.0])
    lattice = M.Lattice(v)
    assert sum(map(math.exp, lattice.logp)) == pytest.approx(1)
    for w in ["a", "ab", "abab", "bbabaab", "aéb", "zz", "abbbab"]:
        assert lattice.log_probability(w) == pytest.approx(all_segmentations(lattice, SPACE + w))
    assert lattice.log_probability("a" * 20_000) < -1000  # no underflow


def test_words_together_equal_words_alone():
    import numpy as np

    lattice = M.Lattice(load_vocabulary())
    some = ["the", "thinganonorernt", "é", "x" * 70, "日本", "a▁b", "ciónment,", "token***", "q" * 60, "🙂🙃", "the", "a"]
    assert lattice.log_probabilities(some) == pytest.approx([lattice.log_probability(w) for w in some])
    assert lattice.log_probabilities([""] + some)[1:] == pytest.approx(lattice.log_probabilities(some))
    one, all_ = np.zeros(lattice.n + 257), np.zeros(lattice.n + 257)
    for w in some:
        lattice.expected(w, one)
    lattice.expected_of(some, all_)
    assert all_ == pytest.approx(one, abs=1e-9) and all_[-1] == len(some)


def test_long_words_teach_and_nothing_underflows():
    import numpy as np

    lattice = M.Lattice(load_vocabulary())
    for word in ["🙂" * 9, "日本語" * 40, "thing" * 100, "x" * 5000]:
        uses = np.zeros(lattice.n + 257)
        lattice.expected(word, uses)
        # What is used spells the word: pieces by their characters, bytes by theirs.
        chars = sum(u * len(p) for u, p in zip(uses, lattice.vocabulary.pieces))
        spelled = uses[lattice.n : -1].sum() / len(word[0].encode())
        assert chars + spelled == pytest.approx(len(word) + 1, rel=1e-6) and uses[-1] == 1


def test_repeats_make_a_probability():
    import numpy as np

    p = np.log10(np.array([0.5, 0.3, 0.2]))
    for past in ([], [0], [0, 0, 1], [2] * 200):
        total = sum(10 ** M.with_repeats(p[[*past, w]], np.array([*past, w]))[-1] for w in range(3))
        assert total == pytest.approx(1)


def test_scores_equal_a_plain_computation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(100001, None), (100002, ""), (None, "the odd ROW"), (100003, "the " * 500), (100003, "the " * 500)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    got = M.lm_scores(docs, group_tokens=20_000).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    tokens = [(r.doc_id, M.words(r.text) + [b""], zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2) for r in rows]
    c = Counter(w for _, ws, held in tokens if not held for w in ws)
    n, v = sum(c.values()), len(c)
    n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2)
    vocabulary = load_vocabulary()
    first = M.Lattice(vocabulary)
    import numpy as np

    uses = np.zeros(first.n + 257)
    for w in c:
        if w:
            first.expected(w.decode(), uses)
    lattice = M.Lattice(vocabulary, M.adapted(vocabulary, uses))

    def p(w):
        if not w:
            return math.log10((c[w] - d) / n)
        lat = lattice.log_probability(w.decode())
        if c[w] > d:
            return math.log10((c[w] - d) / n + d * v / n * math.exp(lat))
        return (math.log(d * v / n) + lat) / math.log(10)

    def score(ws):
        out, had = 0.0, Counter()
        for m, w in enumerate(ws):
            r = M.REPEAT * m / (m + M.REPEAT_AT)
            out += math.log10((1 - r) * 10 ** p(w) + r * had[w] / m) if had[w] else math.log10(1 - r) + p(w)
            had[w] += 1
        return out

    want = sorted((i or 0, held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4), round(score(ws), 4)) for i, ws, held in tokens)
    have = sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got)
    for a, b in zip(want, have, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5, abs=1e-3)


def test_no_rows_and_no_training_rows(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(60)], "doc_id long, text string")
    assert M.lm_scores(docs.filter("false")).count() == 0
    held = docs.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2")
    got = M.lm_scores(held).collect()
    assert got and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)


def test_long_texts_and_clashing_columns(spark):
    texts = ["the end " * 60_000, "x" * 20_000, "日本" * 3_000, "the end"]
    docs = spark.createDataFrame([(i, t, 1, 2, "w") for i, t in enumerate(texts)], "doc_id long, text string, g int, held_out int, word string")
    got = {r.doc_id: r for r in M.lm_scores(docs, group_tokens=50_000).collect()}
    assert [got[i].n_tokens for i in range(4)] == [120_001, 2, 2, 3]
    assert all(math.isfinite(r.score) and r.score < 0 and math.isfinite(r.lattice_score) for r in got.values())
    # A text that repeats itself costs less a word than its first words do.
    assert got[0].score / got[0].n_tokens > got[3].score / got[3].n_tokens


def test_repeats_and_seen_words_beat_the_base_where_words_are_known(spark):
    """Held-out documents whose words training knows: the score is nearer to the text than the base is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = [r for r in M.lm_scores(docs).collect() if r.held_out and r.n_known == r.n_tokens and r.n_tokens > 20]
    assert len(got) >= 10
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert all(r.score > r.lattice_score for r in got)

