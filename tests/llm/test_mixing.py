import hashlib
import random
import re

import pytest

from matchloom.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, open_, out = sum(sizes.values()), set(names), {}
    left = float(total)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


def docs(n, seed, hot=None):
    rng = random.Random(seed)
    names = ["b", "a", "é", "Z", None, "c"]
    return [(i, " ".join(["w"] * rng.choice([0, 1, 3, 10, 50, 200])), hot if hot and rng.random() < 0.8 else rng.choice(names), "clash") for i in range(n)]


@pytest.mark.parametrize("seed,hot", [(1, None), (2, "a"), (3, "c")])
def test_targets_and_takings(spark, seed, hot):
    rows = docs(600, seed, hot)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, s string")
    got = mixing.mix(df).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 100  # half the largest document
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=str)


def test_thresholds_are_nested(spark):
    rng = random.Random(1)
    rows = [("s", int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), rng.randint(1, 20)) for i in range(3000)]
    sizes = spark.createDataFrame(rows, "source string, hash long, size long")
    budgets = [0.0, 10.0, 500.0, 501.0, 20000.0]
    got = {r.budget: r.upto for r in mixing.hash_thresholds(sizes, spark.createDataFrame([("s", b) for b in budgets], "source string, budget double")).collect()}
    uptos = [got[b] for b in budgets]
    assert uptos == sorted(uptos)
    for b in budgets:
        assert abs(sum(n for _, h, n in rows if h <= got[b]) - b) <= 10


def test_repeated_rows_ties_nulls_and_empty(spark):
    rows = [(1, "a b c", "x")] * 5 + [(None, "a b", "x"), (None, None, "x"), (2, None, None), (3, "", "y"), (4, "one two", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    assert len({r.taken for r in got if r.doc_id == 1}) == 1
    null_ids = spark.createDataFrame([(None, f"a b {k}", "x" if k % 2 else "y") for k in range(400)] + [(7, "c " * 100, "z")], "doc_id long, text string, source string")
    by_source = {r.source: (r.target, r.t) for r in mixing.mix(null_ids).groupBy("source", "target").sum("taken").withColumnRenamed("sum(taken)", "t").collect()}
    assert all(abs(target - taken) <= 3 for s, (target, taken) in by_source.items() if s != "z")  # not one block
    assert all(r.target == 0 and r.taken == 0 for r in got if r.source == "y")
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "x")], "doc_id long, text string, source string")
    assert mixing.mix(blank).first().taken == 0


def test_documents_are_repeated_as_taken(spark):
    rows = docs(300, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, s string")
    want = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    words = {}
    for r in got.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert {i: n for i, n in want.items() if n} == {i: n for i, n in words.items() if n}
