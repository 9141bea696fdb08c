import hashlib
import random

import numpy as np
import pytest

from driftline.llm import lz_fingerprint as L


def plain_phrases(raw):
    seen, at = set(), 0
    while at < len(raw):
        k = 1
        while raw[at : at + k] in seen and at + k <= len(raw):
            k += 1
        if at + k > len(raw):
            break
        seen.add(raw[at : at + k])
        at += k
    return seen


def plain(text):
    return L.signature(L._hashes(sorted(plain_phrases(text.encode()))))


def test_signatures_equal_a_plain_parse():
    r = random.Random(5)
    texts = ["", "a", "aa", "aaa" * 50, "é", "日本語"] + ["".join(r.choice("abcé \n") for _ in range(r.randint(0, 400))) for _ in range(150)]
    for a, b in zip(texts, texts[::-1]):
        own, edited = L.fingerprints(a, b)
        assert (own == plain(a)).all() and (edited == plain(L.edited_text(a, b))).all()


def test_likeness_follows_what_texts_share():
    r = random.Random(6)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(2, 7)))
    a, b = (" ".join(word() for _ in range(800)) for _ in range(2))
    near = L.likeness(L.signature_of(a), L.signature_of(L.edited_text(a, b)))
    far = L.likeness(L.signature_of(a), L.signature_of(b))
    assert near > far + 0.2
    assert L.likeness(L.signature_of(a), L.signature_of(a)) == 1.0
    assert L.likeness(L.signature_of(""), L.signature_of("")) == 1.0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_rows_equal_brute_force(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(None, "no id"), (7000, None), (7001, ""), (5, "twice"), (5, "twice again"), (7002, "z" * 30_000)], "doc_id long, text string")
    docs = docs.unionByName(odd).repartition(7)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows.sort(key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.sha256(x[1].encode()).hexdigest()))
    want = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        e = L.edited_text(t, nxt)
        a, b, c = plain(t), plain(e), plain(nxt)
        want.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), L.as_text(a), L.as_text(b), L.likeness(a, b), L.likeness(a, c)))
    got = [(str(r.doc_id), *r[1:]) for r in L.lz_fingerprint(docs, parts).collect()]
    assert sorted(got) == sorted(want)


def test_few_rows(spark):
    one = spark.createDataFrame([(1, "abcdef", "x")], "doc_id long, text string, part string")
    r = L.lz_fingerprint(one).collect()
    assert len(r) == 1 and r[0].near_next == 1.0 and r[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert L.lz_fingerprint(one.filter("false")).count() == 0
    nulls = spark.createDataFrame([(None, "b"), (None, None)], "doc_id long, text string")
    assert L.lz_fingerprint(nulls).count() == 2
