import corpus_pipeline as P
from driftline.llm.decontamination import RATE, benchmark_matches, normal
from driftline.llm.mixing import BLOCK, TOLERANCE
from driftline.llm.quality_fm import THRESHOLD, train
from tests.llm.test_simhash import components, plain

SF = "/root/testdata/sf0.001"


def within(item, text, k):
    """Plain dynamic programme: whether some substring of text is within k edits of item."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
        if min(row) > k:
            return False
    return min(row) <= k


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = P.quality(spark, docs, SF)
    assert first.columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {d for d, r in rows.items() if model.score(r.text, r.n_chars) >= THRESHOLD}
    assert {r.doc_id for r in first.collect()} == good
    second = P.near_dedup(spark, first, SF)
    keep = {d for d, _, least in components([(d, plain(rows[d].text)) for d in sorted(good)]) if d == least}
    assert second.columns == docs.columns and sorted(r.doc_id for r in second.collect()) == sorted(keep)
    third = P.decontaminate(spark, second, SF)
    kept = {r.doc_id for r in third.collect()}
    items = {r.item_id: normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    near = lambda i, d: within(items[i], normal(rows[d].text), int(RATE * len(items[i])))
    named = {}
    for r in benchmark_matches(second, spark.read.parquet(f"{SF}/benchmark.parquet")).collect():
        named.setdefault(r.doc_id, r.item_id)
    # What went holds the passage that it went for; of what stayed, short documents are held against every item.
    assert set(named) == keep - kept and all(near(i, d) for d, i in named.items())
    for d in sorted(kept, key=lambda d: len(rows[d].text))[:30]:
        assert not any(near(i, d) for i in items)
    assert third.columns == docs.columns and kept < keep
    fourth = P.secrets(spark, third, SF)
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} == kept


def test_the_mix(spark):
    out = P.run(spark, SF).collect()
    assert out and {"doc_id", "size", "source_size", "target", "taken"} <= set(out[0].asDict())
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    target, taken = {}, {}
    for r in out:
        target[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 1.5 * BLOCK + TOLERANCE * target[s] for s in target)


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, extra columns whose names the stages use themselves."""
    good = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id between 20 and 60").select("doc_id", "text", "source").collect()
    rows = [(r.doc_id, r.text, r.source) for r in good]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], "src1"), (None, None, None), (None, "a b c", None), (900, None, "s"), (901, "", "s"), (902, "word " * 40_000, "s"), (902, "other " * 40_000, "s")]
    clash = ["lang", "row", "secrets", "_id", "_row", "fp", "score", "quality", "item_id", "sid", "block", "taken", "t"]
    docs = spark.createDataFrame([(*r, *range(len(clash))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in clash))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert len(got) <= len(rows) and all([r[c] for c in clash] == list(range(len(clash))) for r in got), name
        none = stage(spark, docs.filter("false"), SF)
        assert none.columns == docs.columns and none.count() == 0, name
    kept = P.secrets(spark, docs, SF)
    assert kept.count() == len(rows)
    assert P.mix_sources(spark, docs, SF).count() == len(rows) and P.mix_sources(spark, docs.filter("false"), SF).count() == 0
    first = P.near_dedup(spark, docs, SF).collect()
    assert sum(r.doc_id == rows[0][0] and r.text == rows[0][1] for r in first) == 1 and sum(r.doc_id is None for r in first) == 2
    assert {r.text for r in first if r.doc_id == 902} == {"word " * 40_000, "other " * 40_000}
