import heapq
import math

import numpy as np
import pytest

from matchloom.llm import annforest, topk
from matchloom.llm._cells import Grid

ODD = [(9000, None), (9001, []), (9002, [0.0] * 8), (9003, [1.0, None] + [0.0] * 6), (9004, [float("nan")] + [0.0] * 7), (9005, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (9006, [1.0, 2.0])]


def table(spark, n=900, dim=8, seed=0, odd=True):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * rng.uniform(0.2, 2, (n, 1))
    x[n // 3 : 2 * n // 3] = x[0] + 1e-3 * rng.standard_normal((2 * n // 3 - n // 3, dim))  # a very common vector
    x[-5:] = x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + (ODD if odd else [])
    return x, spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<double>, shard int, score string")


def unit(n, dim=64, clusters=0, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    if clusters:
        x = rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] + 0.35 * x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_queue_pops_the_leaves_that_a_heap_pops():
    """With one limit for the whole search: the rows of all leaves that a best-first heap over all trees reaches."""
    x = unit(400, 6)
    forest = annforest.Forest(x, 3, 16, 5)
    for q in unit(5, 6, seed=9):
        side = (np.append(q, 0) @ forest.r).reshape(3, forest.depth)
        queue, order = [(0.0, t, 1, 0) for t in range(3)], []
        while queue:
            cost, t, node, level = heapq.heappop(queue)
            if level == forest.depth:
                order.append((cost, t, node - (1 << level)))
                continue
            m = side[t, level] - forest.cuts[t][node]
            near = 2 * node + (m > 0)
            heapq.heappush(queue, (cost, t, near, level + 1))
            heapq.heappush(queue, (cost + m * m, t, near ^ 1, level + 1))
        assert len(order) == 3 * 2**forest.depth and [c for c, _, _ in order] == sorted(c for c, _, _ in order)
        got = np.isfinite(forest.search(q[None], (np.zeros(0, int), np.zeros(0, int)), 5, 0.05)[0])
        inside = [got[forest.trees[t].rows[forest.trees[t].edges[v] : forest.trees[t].edges[v + 1]]] for _, t, v in order]
        popped = [bool(rows.all()) for rows in inside]
        least = 0.05 * forest.depth**2 * (2 - 2 * np.sort(x @ q)[-5]) / 6  # with the true k-th best: no later limit is lower
        assert all(p for p, (c, _, _) in zip(popped, order) if c <= least)
        union = np.zeros(len(x), bool)
        for p, (_, t, v) in zip(popped, order):
            if p:
                union[forest.trees[t].rows[forest.trees[t].edges[v] : forest.trees[t].edges[v + 1]]] = True
        assert (union == got).all()  # nothing but rows of whole leaves


def test_trees_hold_every_row_once():
    forest = annforest.Forest(np.random.default_rng(2).standard_normal((333, 5)), 4, 16, 0)
    for tree in forest.trees:
        assert sorted(tree.rows.tolist()) == list(range(333)) and tree.edges[-1] == 333 and len(tree.edges) == 2**forest.depth + 1
    annforest.Forest(np.ones((50, 3)), 2, 4, 0)


@pytest.mark.parametrize("clusters,n,recall,share", [(0, 2000, 0.9, 0.85), (0, 14000, 0.9, 0.6), (140, 14000, 0.99, 0.2)])
def test_recall_and_share_of_rows_scored(clusters, n, recall, share):
    """Close neighbours end a search early; the rule is the same for random rows and for clustered ones."""
    x, ids = unit(n, 64, clusters), np.arange(n)
    a, b, _, seen = annforest.nearest(ids, x, ids[:100], x[:100], 20, 16, 64, 0.004, 1)
    s = x[:100] @ x.T
    s[np.arange(100), np.arange(100)] = -np.inf
    found = [len(set(b[a == i]) & set(np.argsort(-s[i])[:20].tolist())) for i in range(100)]
    assert np.mean(found) >= 20 * recall and seen.mean() <= share * n


def test_equal_vectors_have_equal_scores_and_keep_the_order_of_ids():
    x = unit(300, 64)
    x[200:] = x[7]
    a, b, c, _ = annforest.nearest(np.arange(300), x, np.array([3, 7]), x[[3, 7]], 200, 4, 16, 1e9, 1)
    for i in (0, 1):
        copies = [(score, row) for score, row in zip(c[a == i], b[a == i]) if row >= 200]
        assert len({s for s, _ in copies}) == 1 and [r for _, r in copies] == sorted(r for _, r in copies)


@pytest.mark.parametrize("shard_rows,block_rows", [(16384, 8192), (200, 20)])
def test_forest_recall_scores_and_edges(spark, shard_rows, block_rows):
    x, df = table(spark)
    got = annforest.search_forest(df, df.where("vec_id % 20 = 0"), k=20, shard_rows=shard_rows, block_rows=block_rows, reach=4.0).collect()
    s = x @ x.T
    hits = total = 0
    for i in range(0, len(x), 20):
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(r.vec_id != i and abs(r.score - s[i, r.vec_id]) < 1e-9 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        kth = np.sort(np.delete(s[i], i))[-20]
        hits += sum(r.score >= kth - 1e-12 for r in mine)
        total += 20
    assert hits / total >= 0.9
    assert {r.query_id for r in got if r.query_id >= len(x)} <= {9006}


@pytest.mark.parametrize("n,shard_rows", [(60, 16384), (3000, 1024)])
def test_recall_on_random_vectors(spark, n, shard_rows):
    x = unit(n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = annforest.search_forest(df, df.where("vec_id % 20 = 0"), shard_rows=shard_rows).collect()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    hits = sum(r.score >= np.sort(s[r.query_id])[-20] - 1e-12 for r in got)
    assert hits >= 0.9 * 20 * len(range(0, n, 20))


def test_queries_reach_few_cells_of_clustered_rows():
    x = unit(8000, 64, 100)
    router = annforest.Router(x[:4096], 16, 2.0, 10, 1)
    qi, cell = router.reached(x[:500])
    assert router.depth == 4 and np.bincount(router.cells(x), minlength=16).min() > 100
    assert len(qi) < 0.4 * 500 * 16 and np.isin(router.cells(x[:500]), cell).all()
    pairs = set(zip(qi.tolist(), cell.tolist()))
    assert all((i, c) in pairs for i, c in enumerate(router.cells(x[:500]).tolist()))


def test_forest_without_a_limit_is_exact(spark):
    x, df = table(spark, 300, odd=False)
    got = annforest.search_forest(df, df.where("vec_id % 50 = 0"), k=5, stop=1e9).collect()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for i in range(0, 300, 50):
        assert np.allclose(sorted((r.score for r in got if r.query_id == i), reverse=True), np.sort(s[i])[::-1][:5])


@pytest.mark.parametrize("grid,block", [(Grid(), 8), (Grid(150, 7), 3)])
def test_topk_is_exact(spark, grid, block):
    x, df = table(spark, 600)
    v = np.floor(256 * x).astype(np.int64)
    s = v @ v.T
    got = topk.exact_top_k(df, df.where("vec_id % 50 = 0"), grid=grid, block=block).collect()
    want = []
    for i in range(0, 600, 50):
        order = sorted((j for j in range(600) if j != i), key=lambda j: (-s[i, j], j))[:5]
        want += [(i, k + 1, j, int(s[i, j])) for k, j in enumerate(order)]
    zero = [tuple(r) for r in got if r.query_id in (9002,)]
    assert sorted(tuple(r) for r in got if r.query_id < 600) == want
    assert zero == [] and all(r.vec_id is not None for r in got)


def test_topk_bounds_prune():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.standard_normal((500, 32)) * np.linspace(2, 0.01, 32))
    q = x[:10]
    a, b, c = topk.branch_and_bound(np.arange(500), x, np.arange(10), q, 5, 4)
    s = q @ x.T
    s[np.arange(10), np.arange(10)] = -np.inf
    assert [c[a == i].tolist() for i in range(10)] == [np.sort(s[i])[::-1][:5].astype(int).tolist() for i in range(10)]


def test_topk_is_exact_beyond_53_bits(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.integers(-(2**28), 2**28, 4)]) for i in range(60)] + [(k, [float(v) for v in rng.standard_normal(4)]) for k in range(60, 130)]
    rows += [(130, [1e300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.exact_top_k(df, df.where("vec_id % 10 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: [int(math.floor(256 * v)) for v in x] for i, x in rows}
    for i in range(0, 131, 10):
        score = {j: min(max(sum(a * b for a, b in zip(whole[i], w)), -(2**63)), 2**63 - 1) for j, w in whole.items() if j != i}
        best = sorted(score, key=lambda j: (-score[j], j))[:5]
        assert sorted(got[i]) == [(k + 1, j, score[j]) for k, j in enumerate(best)]


def test_few_rows_repeats_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (20, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for find, k in ((annforest.search_forest, 20), (topk.exact_top_k, 5)):
        got = sorted(map(tuple, find(df, df, k=k).select("query_id", "rank", "vec_id").collect()))
        by_dot = [(1, 1, 20), (1, 2, 2), (2, 1, 20), (2, 2, 1), (2, 3, 1), (20, 1, 1), (20, 2, 1), (20, 3, 2)]
        assert got == by_dot  # ties go to the smaller id
        assert find(df.limit(0), df, k=k).count() == 0 and find(df, df.limit(0), k=k).count() == 0
