import random

import xxhash
from pyspark.sql import functions as F

from driftline.llm import simhash_dedup as S


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components(fps):
    """Brute force over all pairs of (id, fp)."""
    up = {i: i for i in range(len(fps))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, f, least[root(i)]) for i, (d, f) in enumerate(fps))


def test_fingerprint_matches_plain_form():
    r = random.Random(1)
    texts = ["", None, "a", "A b", "a b c", "É x\ty\x0bz É", "x y z  w", "w " * 50_000]
    texts += [" ".join(r.choice("ab cd EF gh".split()) for _ in range(r.randint(1, 90))) for _ in range(40)]
    for t in texts:
        assert S.fingerprint(t) == plain(t)


def test_pivot_distances_tell_half_bytes_apart():
    seen = {tuple(bin(x & p).count("1") for p in S.NIBBLE_PIVOTS) for x in range(16)}
    assert len(seen) == 16


def rows_of(spark, fps):
    return spark.createDataFrame([(i, S._signed(f)) for i, f in fps], "id long, fp long")


def connected(spark, fps, limit):
    table = rows_of(spark, fps)
    mp = S.with_fingerprint
    try:
        S.with_fingerprint = lambda *a: table
        out = S.near_duplicates(table, pair_limit=limit).collect()
    finally:
        S.with_fingerprint = mp
    return sorted((r.id, r.fp % (1 << 64), r.component_id) for r in out)


def test_components_equal_brute_force(spark):
    r = random.Random(7)
    fps = []
    for c in range(12):
        base = r.getrandbits(64)
        for _ in range(20):
            x = base
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            fps.append(x)
    fps += [0, 0, 7, 2**64 - 1]
    fps = list(enumerate(fps))
    r.shuffle(fps)
    want = components(fps)
    assert connected(spark, fps, 256) == want
    # All groups are over the limit, so that balls find the links instead of pairs.
    assert connected(spark, fps, 1) == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b c d"), (5, "a b c d"), (6, "A B C D"), (7, "zz")]
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, fp string, key int")
    got = {(r.doc_id, r.component_id) for r in S.simhash_near_dedup(docs).collect()}
    assert got == {(1, 1), (2, 1), (None, 5), (5, 5), (6, 5), (7, 7)}
    assert S.simhash_near_dedup(docs).count() == 7
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 7]
    assert S.simhash_near_dedup(docs.filter("false")).count() == 0
    assert docs.select(S.hex_fingerprint(F.lit(10)).alias("h")).first().h == "000000000000000a"


def test_rows_that_share_an_id_but_not_a_text_all_stay(spark):
    # The second text of id 1 is the first of its own group, which id 4 belongs to.
    rows = [(1, "a b c d e", "s"), (1, "p q r s t u", "s"), (1, "p q r s t u", "s"), (1, "k l m n", "s"), (4, "p q r s t u", "s"), (5, "a b c d e", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = S.keep_first(docs.repartition(4))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d e"), (1, "k l m n"), (1, "p q r s t u")]
