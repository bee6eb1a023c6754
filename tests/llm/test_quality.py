import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import quality


def corpus(seed=0, n=500):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 400))]
        good = rng.random() < 0.6
        if not good:
            at = rng.randint(0, max(0, len(words) - 100))  # one bad passage spoils a document
            words[at : at + 100] = [w.upper() + "!!" for w in words[at : at + 100]]
        rows.append((k, " ".join(words), int(good)))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", "x") for i, t, _ in rows], "doc_id long, text string, y string, id string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(9999, 1), (1, None), (2, 7)], "doc_id long, quality int")
    return rows, docs, quality.fit(docs, labels)


def test_held_out_accuracy(spark, learned):
    rows, docs, model = learned
    got = {r.doc_id: r.s for r in docs.select("doc_id", quality.scorer(model)("text").alias("s")).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 0]
    assert all(0 <= s <= 1 for s, _ in held)
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) >= 0.95


def test_attention_finds_the_bad_passage(learned):
    _, _, model = learned
    words = ["word"] * 0 + [f"abc{'defgh'[i % 5]}" for i in range(64 * 8)]
    words[64 * 5 : 64 * 6] = [w.upper() + "!!" for w in words[64 * 5 : 64 * 6]]
    x = quality.encode(" ".join(words))
    _, h, _, _, a = quality._forward(model, x)
    assert len(x) == 8
    assert int(np.argmax(np.abs(np.exp(a - a.max()) * (h @ model.out - np.median(h @ model.out))))) == 5


def test_whole_text_is_read_in_pieces(learned, monkeypatch):
    _, _, model = learned
    good = " ".join(f"abc{'defgh'[i % 5]}" for i in range(64 * 200))
    bad = good + " " + " ".join(["ABCD!!"] * 64 * 40)
    assert quality.score(model, bad) < quality.score(model, good)
    one = quality.score(model, bad)
    monkeypatch.setattr(quality, "PIECE", 7000)
    assert abs(quality.score(model, bad) - one) < 0.05


def test_gradients_are_right():
    """A step along the gradients lowers the loss as fitted: training separates two simple bags."""
    rng = np.random.default_rng(0)
    bags = [rng.standard_normal((rng.integers(1, 5), quality.DIM)).astype(np.float32) * 0.1 + (k % 2) * 0.1 for k in range(120)]
    y = np.array([k % 2 for k in range(120)], float)
    model = quality.train(bags, y, epochs=10)
    p = []
    for b in bags:
        _, h, _, _, a = quality._forward(model, b)
        e = np.exp(a - a.max())
        p.append(1 / (1 + np.exp(-((e / e.sum()) @ h @ model.out + model.bias))))
    assert np.mean((np.array(p) > 0.5) == (y == 1)) > 0.95


def test_edge_cases(spark, learned):
    _, docs, model = learned
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, "x" * 300000), (5, "a"), (5, "a"), (None, "é😀")], "doc_id long, text string")
    got = odd.select("doc_id", quality.scorer(model)("text").alias("s")).collect()
    assert len(got) == 7 and all(0 <= r.s <= 1 for r in got)
    assert len({r.s for r in got if r.doc_id in (1, 2, 3)}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, none) is None
    assert odd.select(quality.scorer(None)("text").alias("s")).where(F.col("s") != 0.5).count() == 0
    assert odd.limit(0).select(quality.scorer(model)("text").alias("s")).count() == 0


def test_fitting_reads_every_passage_of_the_sampled_documents(spark, monkeypatch):
    """Documents of 30 passages, of which one that even spacing by 16 would skip tells the label."""
    rng, rows = random.Random(3), []
    for k in range(160):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(64 * 30)]
        if k % 2:
            words[64:128] = [w.upper() + "!!" for w in words[64:128]]
        rows.append((k, " ".join(words), 1 - k % 2))
    bags = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda b, y: (bags.append((b, y)), train(b, y))[1])
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert len(bags[0][0]) == 160 and {len(b) for b in bags[0][0]} == {30}
    assert np.mean([(quality.score(model, t) >= 0.5) == (y == 1) for _, t, y in rows]) > 0.9
    quality.fit(docs, labels, fit_chars=100_000)
    assert 1 <= len(bags[1][0]) <= 100_000 // (64 * 30 * 6) + 1 and {len(b) for b in bags[1][0]} == {30}


def test_scores_match_a_plain_version(learned):
    """Each passage apart, softmax over all at once, from the weights."""
    rows, _, m = learned
    for _, text, _ in rows[:20]:
        words = text.split()
        logits, hidden = [], []
        for x in quality.encode(text):
            z = (x - m.mean) * m.scale
            h = np.tanh(z @ m.embed + m.embed_bias)
            gate = np.tanh(h @ m.gate_v) / (1 + np.exp(-(h @ m.gate_u)))
            logits.append(float(gate @ m.attend))
            hidden.append(h)
        e = np.exp(np.array(logits) - max(logits))
        want = 1 / (1 + np.exp(-((e / e.sum()) @ np.array(hidden) @ m.out + m.bias)))
        assert len(hidden) == -(-len(words) // quality.PASSAGE)
        assert abs(quality.score(m, text) - want) < 1e-6
