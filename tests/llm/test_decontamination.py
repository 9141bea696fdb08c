import random

from driftline.llm import decontamination as D


def plain_best(item, text):
    """Least edit distance of the item to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def edited(r, text, edits):
    s = list(text)
    for _ in range(edits):
        at = r.randrange(len(s))
        kind = r.random()
        if kind < 0.34:
            s[at] = r.choice("abcxyz")
        elif kind < 0.67:
            del s[at]
        else:
            s.insert(at, r.choice("abcxyz"))
    return "".join(s)


def test_distance_equals_dynamic_programming():
    r = random.Random(1)
    for _ in range(150):
        item = "".join(r.choice("abc ") for _ in range(r.randint(1, 90)))
        text = "".join(r.choice("abc ") for _ in range(r.randint(0, 150)))
        assert D.best_match(D.peq(item), len(item), text)[0] == min(len(item), plain_best(item, text))


def test_no_passage_within_budget_is_missed():
    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinsr") for _ in range(r.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(r.randint(12, 40)))) for i in range(12)]
    match = D.Matcher(items)
    for _ in range(80):
        i, t = r.choice(items)
        text = " ".join(word() for _ in range(60)) + " " + edited(r, t, r.randint(0, int(D.RATE * len(t)) + 3)) + " " + " ".join(word() for _ in range(60))
        got = {k: d for k, d, _ in match(text)}
        for k, x in items:
            best = plain_best(D.normal(x), D.normal(text))
            assert got.get(k) == (best if best <= int(D.RATE * len(D.normal(x))) else None)


def test_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "item_blocks", lambda b, chars=40, real=D.item_blocks: real(b, chars))
    bench = spark.createDataFrame([(1, "the first Passage of the benchmark set"), (2, "another passage, of some length here"), (2, "another passage, of some length here"), (3, None), (4, "  ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x THE first\n passage of the benchmark set y", 1), (2, None, 1), (3, "", 1), (None, "another passage of some length here", 1), (5, "clean text", 1), (5, "clean text", 1)], "doc_id long, text string, item_id int")
    got = sorted((r.doc_id or 0, r.item_id, r.distance) for r in D.benchmark_matches(docs, bench).collect())
    assert got == [(0, 2, 1), (1, 1, 0)]
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 5]
    assert D.benchmark_matches(docs, bench.filter("false")).count() == 0 and D.benchmark_matches(docs.filter("false"), bench).count() == 0


def test_a_very_long_text(spark):
    item = "a passage of the benchmark that is long enough to be told from other text by its words"
    long = "filler words of no interest " * 60_000
    docs = spark.createDataFrame([(1, long + item.replace("long", "lone") + " " + long, 0), (2, long * 2, 0)], "doc_id long, text string, distance int")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [tuple(r)[:3] for r in D.benchmark_matches(docs, bench).collect()] == [(1, 7, 1)]
    assert [r.doc_id for r in D.decontaminated(docs, bench).collect()] == [2]
