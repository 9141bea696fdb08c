import random

from pyspark.sql import functions as F

from driftline.llm import mixing as M


def plain_targets(sizes, share=1.5, most=2.0):
    """Reshare the excess by weight until no source is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = budget - sum(capped.values())
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > most * sizes[s] + 1e-9]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in order}
        capped |= {s: most * sizes[s] for s in over}


def make(spark, seed=1, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice(["a", "a", "a", "a", "b", "é", "Z", None, "tiny"]) if i % 40 else "tiny"
        rows.append((i if i % 50 else 7, None if i % 31 == 0 else " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), source, "x", i))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target long")


def test_targets_and_takings(spark):
    docs = make(spark)
    out = M.mix(docs, block=16).collect()
    assert len(out) == docs.count()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    want, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1.5 * 16 + M.TOLERANCE * want[s] for s in sizes)
    key = lambda rows: sorted(map(str, rows))
    assert key(M.mix(docs.repartition(5), block=16).collect()) == key(out)
    assert M.mix(docs.filter("false")).count() == 0
    assert {r.taken for r in M.mix(docs.withColumn("text", F.lit(""))).collect()} == {0}


def plain_mix(rows, plan, slots, block):
    """Words taken of each row, by walking through every word of every block that the slots name."""
    streams, out = {}, []
    for s in plan:
        here = sorted((r for r in rows if r[3] == s), key=lambda r: r[4])
        streams[s] = [k for r in here for k in [r[0]] * r[2]]
    taken = {}
    for s, b in slots:
        for k in streams[s][b * block : (b + 1) * block]:
            taken[k] = taken.get(k, 0) + 1
    for r in rows:
        out.append(taken.get(r[0], 0))
    return out


def test_takings_equal_a_walk_through_the_drawn_blocks(spark):
    docs = make(spark, n=150).filter("doc_id <> 7").select("doc_id", "text", "source")
    rows = M.sizes(docs).collect()
    per = M.targets(M.sizes(docs).groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = M.plan_blocks(per, block=16)
    sid = {r.source: r.sid for r in plan.collect()}
    ranges = max(1, __import__("math").ceil(len(rows) ** 0.5))
    h = {r.doc_id: r.h for r in M.sizes(docs).select("doc_id", F.xxhash64(F.lit(8), "doc_id", "size").alias("h")).collect()}
    order = lambda x: ((x % 2**64 >> 33) * ranges // 2**31, x)
    known = [(r.doc_id, r.source, r.size, sid[r.source], order(h[r.doc_id])) for r in rows]
    slots = [(r.sid, r.block) for r in M.draws(plan).collect()]
    want = plain_mix(known, set(sid.values()), slots, 16)
    got = {r.doc_id: r.taken for r in M.mix(docs, block=16).collect()}
    assert [got[k[0]] for k in known] == want and sum(want) > 0


def test_a_row_repeated_very_often(spark):
    many = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("w w w").alias("text"), F.lit("s").alias("source"))
    docs = many.unionByName(spark.createDataFrame([(2, "v " * 700, "s"), (3, "u " * 400, "t")], "doc_id long, text string, source string"))
    out = M.mix(docs).collect()
    assert len(out) == 5002 and all(r.taken <= 2 * r.size for r in out)
    for s in "st":
        here = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in here) - here[0].target) <= 1.5 * M.BLOCK + M.TOLERANCE * here[0].target


def test_permutations_are_bijections(spark):
    for n in (1, 2, 3, 10, 257, 1000):
        images = spark.range(n).select(F.expr(M.permuted("id", f"{n}L", "8", "3L", "1L")).alias("y")).collect()
        ys = [r.y for r in images]
        assert sorted(ys) == list(range(n))
        assert n < 10 or ys != list(range(n))


def test_the_draws_decide_the_shards_and_the_takings(spark):
    plan = M.plan_blocks(spark.createDataFrame([(0, "a", 32000 * 64, 48000.0 * 64), (1, "b", 64000 * 64, 16000.0 * 64), (2, "c", 5, 0.0)], "sid long, source string, source_size long, target double")).cache()
    counts = {}
    for r in M.shard_counts(plan).collect():
        counts.setdefault(r.shard, {})[r.sid] = r.n
    assert len(counts) == 63 and all(sum(c.values()) == M.SHARD for k, c in counts.items() if k < 62)
    # A binomial draw with p = 3/4: neither one number in all shards nor far from it.
    firsts = [c[0] for k, c in sorted(counts.items()) if k < 62]
    spread = sum((n - 0.75 * M.SHARD) ** 2 for n in firsts) / len(firsts)
    assert 0.5 < spread / (M.SHARD * 0.75 * 0.25) < 1.7
    got = M.draws(plan).groupBy("shard", "sid").agg(F.count("*").alias("n")).collect()
    # What the draws gave stands, up to the tolerance.
    drawn = {s: sum(c.get(s, 0) for c in counts.values()) for s in (0, 1)}
    assert drawn != {0: 48000, 1: 16000} and drawn[0] + drawn[1] == 64000
    for s, take in ((0, 48000), (1, 16000)):
        slack = int(take * M.TOLERANCE)
        assert sum(r.n for r in got if r.sid == s) == min(take + slack, max(take - slack, drawn[s]))
    kept = {(r.shard, r.sid): r.n for r in got if r.shard >= 0}
    assert all(kept.get((k, s), 0) <= n for k, c in counts.items() for s, n in c.items())
    assert sum(kept.get((k, s), 0) == n for k, c in counts.items() for s, n in c.items()) >= 0.9 * 126
    epochs = M.draws(plan).groupBy("sid", "epoch").agg(F.countDistinct("block").alias("d"), F.count("*").alias("n")).collect()
    assert all(r.d == r.n for r in epochs) and {r.d for r in epochs if (r.sid, r.epoch) == (0, 0)} == {32000}


def test_many_sources_are_numbered_in_order(spark):
    names = [f"h{i:04d}" for i in range(700)] + [None, "Z", "é"]
    got = M.targets(spark.createDataFrame([(n, 10) for n in names], "source string, source_size long").repartition(7)).collect()
    order = sorted((n for n in names if n), key=lambda n: n.encode()) + [None]
    assert [r.source for r in sorted(got, key=lambda r: r.sid)] == order
    want = plain_targets(dict.fromkeys(names, 10))
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in got)
