import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import blocks, gain, graph, metrics, ranking, retrieval, scoring
from matchloom.sources.shared import cut


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((57, 4))
    x[3] = x[2]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


@pytest.mark.parametrize("block_rows", [1024, 10])
@pytest.mark.parametrize("kind", ["cosine", "l1", "l2"])
def test_similarities(spark, points, kind, block_rows, monkeypatch):
    x, df = points
    monkeypatch.setattr(blocks.per_cell, "__defaults__", (block_rows, None))
    rows = blocks.vectors(df, "id", "vec", kind == "cosine")
    if kind == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u @ u.T
    else:
        d = np.abs(x[:, None] - x[None]).sum(2) if kind == "l1" else np.linalg.norm(x[:, None] - x[None], axis=2)
        s = 1 - d / d.max()
    got = {r.id: (r.top, r.total) for r in blocks.summary(rows, blocks.similarity(rows, kind)).collect()}
    off = s - 10 * np.eye(len(s))
    assert all(got[i] == pytest.approx((off[i].max(), s[i].sum())) for i in range(len(x)))
    near = blocks.nearest(rows, blocks.similarity(rows, kind), 5).collect()
    for i in range(len(x)):
        want = sorted(range(len(x)), key=lambda j: (-round(s[i, j], 9), j))[:5]
        assert [r.j for r in sorted((r for r in near if r.i == i), key=lambda r: r.rank)] == want


@pytest.mark.parametrize("m", [0.0, 0.1, 0.37, 0.5, 0.999, 1.0])
def test_percentile_and_threshold(points, m):
    x, df = points
    d = blocks.l2_distances_9(x, x)
    thr = blocks.percentile(df, blocks.l2_distances_9, m, bins=64)
    assert thr == pytest.approx(np.percentile(d, 100 * m))
    edges = {(r.i, r.j) for r in blocks.within(df, blocks.l2_distances_9, thr).collect()}
    assert edges == set(zip(*map(np.ndarray.tolist, np.nonzero(d <= thr))))


def plain_walk(rows, budget):
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    lo, hi, want, out = 0, len(order) - 1, 1, []
    while len(out) < budget and lo <= hi:
        i = order[hi] if want else order[lo]
        hi, lo = (hi - 1, lo) if want else (hi, lo + 1)
        out.append(i[0])
        if i[2] == want:
            want = 1 - want
    return out


@pytest.mark.parametrize("seed", range(8))
def test_two_ended_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0.1, 0.2, 0.3, rng.random()]), int(rng.random() < rng.choice([0.1, 0.5, 0.9]))) for i in range(rng.randint(1, 30))]
    for budget in (1, 5, len(rows) // 2 + 1):
        got = ranking.two_ended_walk(spark.createDataFrame(rows, "id long, score double, label int"), "id", "score", "label", budget)
        assert [r.id for r in got.orderBy("rank").collect()] == plain_walk(rows, budget)


def test_walk_stops_at_the_number_of_rows(spark):
    rows = [(0, 0.1, 0), (1, 0.2, 1), (2, 0.3, 0)]
    got = ranking.two_ended_walk(spark.createDataFrame(rows, "id long, score double, label int"), "id", "score", "label", 10).collect()
    assert sorted(r.id for r in got) == [0, 1, 2]


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1.0, 2.0, rng.random()])) for i in range(3000)]
    got = ranking.numbered(spark.createDataFrame(rows, "id long, v double").repartition(6), [F.desc("v"), F.asc("id")], "n").collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r.id, r.v) for r in sorted(got, key=lambda r: r.n)] == want
    assert sorted(r.n for r in got) == list(range(1, 3001))


def test_interleave_column_equals_lists(spark):
    for na in range(0, 9):
        for nb in range(0, 9):
            a, b = [("a", i) for i in range(na)], [("b", i) for i in range(nb)]
            df = spark.createDataFrame([*a, *b] or [("c", 0)], "s string, r long")
            key = F.when(F.col("s") == "a", ranking.interleave_key(F.col("r"), F.lit(na), F.lit(nb), True)).otherwise(ranking.interleave_key(F.col("r"), F.lit(nb), F.lit(na), False))
            if na + nb in (5, 9, 12):
                got = [(r.s, r.r) for r in df.withColumn("k", key).orderBy("k").collect()]
                assert got == gain.interleave(a, b)
            assert sorted(gain.interleave(a, b)) == sorted(a + b)


def test_metrics_against_plain_counts(spark):
    rng = random.Random(5)
    for case in range(4):
        rows = [(int(rng.random() < (0.4, 0.0, 1.0, 0.5)[case]), rng.choice([0.5, rng.random()]), rng.randint(0, 3)) for _ in range(60)]
        df = spark.createDataFrame(rows, "label int, prob double, weight long")
        y, p, w = [np.array(c, float) for c in zip(*rows)]
        for metric in ("f1", "f1_v2"):
            got = df.agg(*metrics.weighted_f1(F.col("label"), F.col("prob"), F.col("weight"), metric)).first()
            assert got.score == pytest.approx(gain.weighted_scores(p, y, w, metric))
        got = df.agg(*metrics.weighted_accuracy(F.col("label"), F.col("prob"), F.col("weight"))).first()
        assert got.score == pytest.approx(gain.weighted_scores(p, y, w, "acc"))
        assert df.agg(metrics.certainty(F.col("prob"))[0]).first()[0] == pytest.approx(gain.certainty(p))
    assert spark.createDataFrame([], "prob double").agg(metrics.certainty(F.col("prob"))[0]).first()[0] == 1.0


def test_prf_of_nothing(spark):
    got = spark.createDataFrame([(0, 0)], "y int, p int").agg(*metrics.precision_recall_f1(F.col("y"), F.col("p"))).first()
    assert tuple(got) == (0.0, 0.0, 0.0)


def test_cell_weights_sum_to_the_probabilities_below_one(spark):
    rng = random.Random(2)
    probs = [(i, rng.choice([0.0, 0.5, 1.0, rng.random(), 0.25])) for i in range(400)]
    df = spark.createDataFrame(probs, "id long, prob double")
    some = df.where("id < 23")
    got = {r.id: r.weight for r in metrics.cell_weights(df, "prob", metrics.cell_bounds(some, "id", "prob")).collect()}
    want = gain.cell_weights(np.array([p for _, p in probs]), list(range(23)), dict(probs))
    assert got == want and sum(got.values()) == sum(p < 1 for _, p in probs)


def plain_fewshots(sims, labels, k):
    n = len(sims)
    k = min(k, n)
    pos_num, neg_num = k // 2, k - k // 2
    pos, neg = [], []
    for i in sorted(range(n), key=lambda i: (-sims[i], i)):
        (pos if labels[i] else neg).append(i)
        if len(pos) >= pos_num and len(neg) >= neg_num and len(pos) + len(neg) >= k:
            break
    if len(pos) + len(neg) > k:
        if len(pos) <= pos_num:
            neg = neg[: k - len(pos)]
        elif len(neg) <= neg_num:
            pos = pos[: k - len(neg)]
    return sorted(pos), sorted(neg)


@pytest.mark.parametrize("seed", range(8))
def test_balanced_retrieval(spark, seed):
    rng = random.Random(seed)
    n, k = rng.randint(1, 14), rng.randint(1, 12)
    labels = [int(rng.random() < rng.choice([0.2, 0.5, 0.8])) for _ in range(n)]
    e = [[rng.choice([0.1, 0.2, rng.random()])] for _ in range(n)]
    examples = spark.createDataFrame([(i, v, y) for i, (v, y) in enumerate(zip(e, labels))], "example_id long, vec array<double>, label int")
    tests = spark.createDataFrame([(0, [1.0])], "test_id long, vec array<double>")
    got = retrieval.balanced(tests, examples, k).collect()
    sims = [round(v[0], 9) for v in e]
    assert (sorted(r.example_id for r in got if r.label), sorted(r.example_id for r in got if not r.label)) == plain_fewshots(sims, labels, k)


def test_orders_and_prompts(spark):
    examples = spark.createDataFrame([(i, f"case{i}", y) for i, y in enumerate([1, 1, 0, 0, 0])], "example_id long, text string, label int")
    found = spark.createDataFrame([(7, i, y, s, 0) for i, y, s in [(0, 1, 0.9), (1, 1, 0.2), (2, 0, 0.8), (3, 0, 0.5), (4, 0, 0.1)]], "test_id long, example_id long, label int, sim double, rn int")
    ids = lambda o: [r.example_id for r in retrieval.ordered(found, o).orderBy("pos").collect()]
    assert ids("o1") == [1, 4, 0, 3] and ids("o2") == [4, 1, 3, 0]
    assert ids("o6") == [4, 1, 3, 2, 0] and ids("o7") == [0, 2, 3, 1, 4]
    assert sorted(ids("o5")) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        ids("o4")
    even = found.where("example_id <> 4")
    by_pattern = lambda rows, v: [r.example_id for r in retrieval.ordered(rows, "o3", variant=v).orderBy("pos").collect()]
    assert by_pattern(even, 0) == [3, 1, 0, 2] and by_pattern(even, 1) == [1, 3, 2, 0]
    with pytest.raises(Exception, match="no pattern for 2 matches and 3 non-matches"):
        by_pattern(found, 0)
    tests = spark.createDataFrame([(7, "this"), (8, "that")], "test_id long, text string")
    got = {r.test_id: r.prompt for r in retrieval.prompts(tests, examples, retrieval.ordered(found.where("sim >= 0.8"), "o7")).collect()}
    ask = "Are Product A and Product B the same?"
    assert got[7] == f"This is an entity matching task.\n\ncase0\n{ask} Yes.\n\ncase2\n{ask} No.\n\nthis\n{ask}"
    assert got[8] == f"This is an entity matching task.\n\nthat\n{ask}"
    shared = retrieval.shared_prompts(tests, examples.limit(1).withColumn("rank", F.lit(1)), k=1).where("test_id = 8").first().prompt
    assert shared == f"This is an entity matching task.\n\ncase0\n{ask} Yes.\n\nthat\n{ask}"
    with pytest.raises(ValueError):
        retrieval.shared_prompts(tests, examples.limit(1), "example_id", k=2)
    # selected in the order 3, 2, 1, 0: the first counts as the most similar
    chosen = examples.where("example_id < 4").withColumn("rank", 4 - F.col("example_id"))
    for order, want in {"o1": [0, 2, 1, 3], "o2": [2, 0, 3, 1], "o3": [2, 0, 1, 3], "o6": [0, 1, 2, 3], "o7": [3, 2, 1, 0]}.items():
        prompt = retrieval.shared_prompts(tests, chosen, order=order).where("test_id = 7").first().prompt
        assert [int(x) for x in re.findall(r"case(\d)", prompt)] == want, order
        assert prompt.endswith(f"\n\nthis\n{ask}")
    assert retrieval.prefixed_prompts(tests, "P").where("test_id = 8").first().prompt == f"P\nthat\n{ask}"


def test_greedy_votes_against_a_plain_loop(spark):
    rng = random.Random(6)
    edges = sorted({(i, j, r) for i in range(25) for r, j in enumerate(rng.sample([x for x in range(25) if x != i], 5), 1)})
    got = graph.greedy_votes(spark.createDataFrame(edges, "supporter long, target long, rank int"), 6)
    back, seen = {}, {}
    for s, t, r in edges:
        back.setdefault(t, []).append(s)
        seen[t] = min(seen.get(t, (99, 99)), (s, r))
    order, times, chosen = sorted(back, key=lambda t: (-len(back[t]), seen[t])), dict.fromkeys(range(25), 0), []
    for _ in range(6):
        score = {t: -100 if t in chosen else round(sum(10.0 ** -times[s] for s in back[t] if s not in chosen), 9) for t in order}
        best = max(order, key=lambda t: score[t])
        chosen.append(best)
        for s in back[best]:
            times[s] += 1
    assert [i for i, _ in got] == chosen


def test_cover_on_the_cluster_equals_the_driver(spark, points):
    x, df = points
    d = blocks.l2_distances_9(x, x)
    edges = blocks.within(df, blocks.l2_distances_9, 1.5)
    chosen, covered = graph.greedy_cover(edges, [], 6)
    g, seen, want = d <= 1.5, np.zeros(len(d), bool), []
    while len(want) < 6 and not seen.all():
        new = (g & ~seen).sum(1) * ~seen
        want.append(int(np.argmax(new)))
        seen |= g[want[-1]]
    assert chosen == want and covered == seen.sum()
    assert [i for i, _ in graph.coverage_weights(edges, chosen)] == chosen


def test_scorers(spark):
    good = "x\nProduct A\tred shoe\nProduct B\tred shoe\nsame?"
    bad = "x\nProduct A\tred shoe\nProduct B\tblue mug\nsame?"
    df = spark.createDataFrame([(1, good), (2, bad), (3, None)], "id int, prompt string")
    got = {r.id: r for r in scoring.scored(df, scoring.OverlapScorer, batch=2).collect()}
    assert got[1].prob > got[2].prob and len(got) == 3

    class Flaky:
        calls = 0

        def score(self, prompts):
            Flaky.calls += 1
            if Flaky.calls < 3:
                raise OSError("busy")
            return [0.5] * len(prompts)

    waits = []
    assert scoring.Retrying(Flaky(), sleep=waits.append).score(["a"]) == [0.5] and len(waits) == 2
    Flaky.calls = -100
    with pytest.raises(OSError):
        scoring.Retrying(Flaky(), tries=2, sleep=waits.append).score(["a"])
    vec = scoring.HashEncoder(8).encode(["a b", ""])
    assert math.isclose(math.hypot(*vec[0]), 1) and vec[1] == [0.0] * 8


def test_generated_answers_names_and_costs(spark):
    class Echo:
        def generate(self, prompts):
            return [f"{p}: therefore, the answer is no. And more" if "x" in p else f"{p}: the same." for p in prompts]

    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, prompt string")
    got = {r.id: (r.answer, r.pred) for r in scoring.reasoned(df, Echo, stops=["no.", "zzz"]).collect()}
    assert got == {1: ("x: therefore, the answer is no.", 0), 2: ("y: the same.", 1)}
    names = ["gpt4", "llama2-13b", "llama2-7bf", "llama65", "llama7"]
    assert [scoring.model_name(n) for n in names] == ["gpt-4-0314", "llama-2-13b-hf", "llama-2-7b-chat-hf", "huggyllama/llama-65b", "decapoda-research/llama-7b-hf"]
    with pytest.raises(ValueError):
        scoring.model_name("other")
    assert scoring.context_tokens("llama2-7b") == 4096 and scoring.context_tokens("gpt2") == 2048
    row = df.select(scoring.cost("gpt-4-0314", F.lit(1000), F.lit(1000)).alias("a"), scoring.cost("gpt2", F.lit(5), F.lit(5)).alias("b")).first()
    assert row.a == pytest.approx(0.09) and row.b == 0


def test_equal_width_bins_and_shares(spark):
    rng = np.random.default_rng(1)
    v = rng.random(500)
    lo, hi = v.min(), v.max()
    got = [r.b for r in spark.createDataFrame([(float(x),) for x in v], "x double").select(metrics.equal_width_bin(F.col("x"), F.lit(float(lo)), F.lit(float(hi)), 7).alias("b")).collect()]
    edges = np.linspace(lo, hi, 8)
    assert got == [max(0, int(np.searchsorted(edges, x, side="left")) - 1) for x in v]
    pairs = spark.createDataFrame([(None, 1, 2, 2), (1, None, 2, 2), (1, 1, 2, 2), (1, 1, 2, None), (1, 1, 1, 1), (1, 1, 1, 1)], "a_x int, b_x int, a_y int, b_y int")
    assert {r.column_name: (r.nulls, r.kept) for r in metrics.null_shares(pairs, ["x", "y"]).collect()} == {"x": (2, False), "y": (1, True)}


@pytest.fixture(scope="module")
def copies(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 20))
    x[200:260] = x[7]
    x[260:280] = x[9] + 1e-7 * rng.standard_normal((20, 20))
    return x, spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


def small(monkeypatch):
    monkeypatch.setattr(blocks.against_all, "__defaults__", (64, 64))


def test_nearest_sends_no_partial_lists(copies, monkeypatch):
    x, df = copies
    small(monkeypatch)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    near = blocks.nearest(blocks.vectors(df, "id", "vec", True), blocks.similarity(df, "cosine"), 25)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1  # the rows are dealt once; what is found stays in its task
    got = {}
    for r in near.orderBy("i", "rank").collect():
        got.setdefault(r.i // 3, []).append(r.j // 3)
    assert got == {i: sorted(range(300), key=lambda j: (-s[i, j], j))[:25] for i in range(300)}


def test_greedy_votes_joins_no_votes_and_breaks_ties_by_first_vote(spark):
    lists = spark.createDataFrame([(1, [(1, 9), (2, 8)]), (2, [(1, 8), (2, 9)]), (3, [(1, 7)])], "supporter long, backed array<struct<rank:int,target:long>>")
    assert graph.greedy_list_votes(lists, 3) == [(9, 2.0), (7, 1.0), (8, 0.2)]
    assert graph.greedy_list_votes(lists, 0) == []


@pytest.mark.parametrize("kind", ["l1", "l2"])
def test_distance_summaries_take_one_pass(copies, kind, monkeypatch):
    x, df = copies
    small(monkeypatch)
    passes, plain = [], blocks.against_all
    monkeypatch.setattr(blocks, "against_all", lambda *a: passes.append(1) or plain(*a))
    d = np.abs(x[:, None] - x[None]).sum(2) if kind == "l1" else np.linalg.norm(x[:, None] - x[None], axis=2)
    s = 1 - d / d.max()
    got = {r.id: (r.top, r.total) for r in blocks.similarity_summary(df, kind).collect()}
    assert len(passes) == 1
    off = s - 10 * np.eye(len(s))
    assert all(got[3 * i] == pytest.approx((off[i].max(), s[i].sum()), abs=1e-11) for i in range(300))
    one = blocks.similarity_summary(df.limit(1), kind).first()
    assert one.top is None and one.total == 1


@pytest.mark.parametrize("m", [0.0, 0.01, 0.1, 0.37, 1.0])
def test_threshold_degrees_write_no_edges(copies, m, monkeypatch):
    x, df = copies
    small(monkeypatch)
    monkeypatch.setattr(blocks, "within", None)
    d = blocks.l2_distances_9(x, x)
    top, degrees = blocks.threshold_degrees(df, m, bins=32, most=50)
    assert top == pytest.approx(np.percentile(d, 100 * m), abs=1e-15)
    assert {r.id // 3: r.degree for r in degrees.collect()} == dict(enumerate((d <= top).sum(1)))


def test_stored_rows_are_read_by_each_part_and_not_sent(copies, monkeypatch):
    x, df = copies
    small(monkeypatch)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    rows = cut(df.orderBy(F.desc("id")))
    near = blocks.nearest_lists(blocks.vectors(rows, "id", "vec", True), blocks.similarity(rows, "cosine"), 25, stored=True)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan
    assert near.rdd.getNumPartitions() == 5
    got = {r.i // 3: [j // 3 for j in r.js] for r in near.collect()}
    assert got == {i: sorted(range(300), key=lambda j: (-s[i, j], j))[:25] for i in range(300)}
    assert blocks.nearest_lists(cut(df.limit(0)), blocks.similarity(rows, "cosine"), 3, stored=True).count() == 0
