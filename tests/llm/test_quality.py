import numpy as np

from driftline.llm import quality_fm as Q

SF = "/root/testdata/sf0.01"


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = Q.FactorisationMachine(0.3, rng.normal(size=Q.DIM), rng.normal(size=(Q.DIM, 4)))
    idx, val = np.array([3, 9, 9, 500, 70]), np.array([0.5, 1.0, 2.0, -1.0, 0.25])
    want = 0.3 + sum(m.w[i] * x for i, x in zip(idx, val)) + sum(m.v[idx[a]] @ m.v[idx[b]] * val[a] * val[b] for a in range(5) for b in range(a))
    assert abs(m.margin(idx, val) - want) < 1e-9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.quality_fm(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    got = out.join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) / len(got) >= 0.97


def test_rows_equal_a_plain_computation(spark):
    """The query against the machine's own sum over all pairs, one document after the other."""
    import math
    import zlib

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    m = Q.train(docs, labels)
    got = {r.doc_id: r for r in Q.quality_fm(docs, labels).collect()}
    for r in docs.collect():
        idx, val = Q.vector(r.text, r.n_chars)
        merged = {}
        for i, x in zip(idx.tolist(), val.tolist()):
            merged.setdefault(i, []).append(x)
        flat = [(i, x) for i, xs in merged.items() for x in xs]
        v = np.array([m.v[i] * x for i, x in flat], dtype=np.float64)
        gram = v @ v.T
        z = m.w0 + sum(float(m.w[i]) * x for i, x in flat) + (gram.sum() - np.trace(gram)) / 2
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-z))) < 1e-4
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, "en"), (2, "", 0, "en"), (None, "x", 1, None), (2, "", 0, "en"), (3, "w " * 200_000, 5, "en")], "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    out = Q.quality_fm(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    none = Q.quality_fm(docs, labels.filter("false")).collect()
    assert {r.score for r in none} == {0.5} and Q.quality_fm(docs.filter("false"), labels).count() == 0
    kept = Q.keep_good(docs, labels.filter("false"))
    assert kept.columns == docs.columns and kept.count() == 5
