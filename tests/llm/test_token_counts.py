import random

from driftline.llm.token_counts import Counter, token_counts
from driftline.llm.unigram import SPACE, Vocabulary, load_vocabulary


def library(vocabulary):
    """The public library's unigram model over the same pieces, byte pieces included."""
    from tokenizers import Tokenizer, models

    low = min(vocabulary.scores)
    extra = [("<unk>", low)] + [(f"<0x{b:02X}>", low) for b in range(256)]
    return Tokenizer(models.Unigram(extra + list(zip(vocabulary.pieces, vocabulary.scores)), unk_id=0, byte_fallback=True))


def ids(lib, text):
    marked = SPACE + text.replace(" ", SPACE) if text else ""
    return lib.encode(marked, add_special_tokens=False).ids


def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()
    r = random.Random(3)
    odd = ["a", " ", "  a  b", "\n", "x\n\ny", "日本語 🙂🙂 text", "\t", "a" * 3000, "🙂" * 50 + "\n" + "🙂", "é" * 10, "word " * 2000]
    odd += ["".join(r.choice("abé \n🙂the") for _ in range(r.randint(1, 60))) for _ in range(60)]
    return [x.text for x in rows] + odd


def test_counts_equal_the_library(spark):
    v = load_vocabulary()
    lib, own = library(v), Counter(v)
    for t in texts(spark):
        assert own(t) == len(ids(lib, t)), t[:80]


def test_ties_and_whole_text_vocabularies():
    v = Vocabulary([SPACE, "a", "b", "ab", "ba", "aba", "b" + SPACE], [-1.0, -2.0, -2.0, -4.0, -3.0, -5.0, -1.0])
    lib, own = library(v), Counter(v)
    assert own.whole
    for t in ["ab", "aba", "abab", "ababa ab", "b b b", "aab abb"]:
        assert own(t) == len(ids(lib, t)), t


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "", 9), (None, "a b", 9)], "doc_id long, text string, n_tokens int")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(docs).collect()) == [(0, 2), (1, 0), (2, 0), (2, 0)]
    assert token_counts(docs.filter("false")).count() == 0
