"""Exact top-k by integer inner product: columnar branch and bound.

Vectors become integers, floor(scale * x). A shard keeps them in vertical layout, one array for
each dimension, with dimensions in order of their total energy. For a query, scores accumulate block
of dimensions by block. After each block the mass that remains, the product of the lengths of
query and row over the dimensions still to come, bounds every score from both sides; the k-th best
lower bound is the threshold, and rows whose upper bound lies below it are compacted away. What is
left after the last block has exact scores.

Defined results: rows with a null id, or a vector that is null, empty or holds a null, NaN or
infinite component, take no part; vectors meet only others of their length; a query never finds
rows of its own id; ties go to the smaller id; fewer than k rows give as many as there are;
empty tables give no rows. Of pairs whose score may pass 2 ** 53 the product is added in integers, outside
of the bounds; scores beyond the range of a long count as its end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from matchloom.llm._cells import Grid, best_of, search, usable


EXACT = 2.0**53
LONG = 1 << 63


def _product(a: list[float], b: list[float]) -> int:
    return min(max(sum(int(v) * int(w) for v, w in zip(a, b)), -LONG), LONG - 1)


def _with_large(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, block: int, size: np.ndarray, q_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """branch_and_bound for rows that are short enough for the query; Python's integers for the others."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(q)):
        with np.errstate(over="ignore", invalid="ignore"):
            exact = size * q_size[i] < EXACT
        small, far = np.flatnonzero(exact), np.flatnonzero(~exact & (ids != query_ids[i]))
        _, rows, score = branch_and_bound(ids[small], x[small], query_ids[i : i + 1], q[i : i + 1], k, block) if len(small) else (None, np.zeros(0, int), np.zeros(0, np.int64))
        mine = q[i].tolist()
        both = [*zip(score.tolist(), small[rows].tolist()), *((_product(x[r].tolist(), mine), r) for r in far.tolist())]
        both = sorted(both, key=lambda p: (-p[0], ids[p[1]]))[:k]
        out.append((np.full(len(both), i), np.array([r for _, r in both], int), np.array([s for s, _ in both], np.int64)))
    a, b, c = zip(*out)
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def branch_and_bound(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query its k best rows; x and q hold integers."""
    with np.errstate(over="ignore"):
        size, q_size = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
        large = size * q_size.max(initial=0) >= EXACT
    if large.any():  # of each query, rows apart whose products with it may not be exact
        return _with_large(ids, x, query_ids, q, k, block, size, q_size)
    order = np.argsort(-(x * x).sum(0), kind="stable")
    columns, q = np.ascontiguousarray(x[:, order].T), q[:, order]
    dims = len(order)
    steps = [(a, min(a + block, dims)) for a in range(0, dims, block)]
    # length of each row over the dimensions after each step
    rest = [np.sqrt((columns[b:] ** 2).sum(0)) for _, b in steps]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(q)):
        alive = np.flatnonzero(ids != query_ids[i])
        score = np.zeros(len(alive))
        whole = len(alive) == len(ids)
        for (a, b), after in zip(steps, rest):
            part = columns[a:b] if whole else columns[a:b, alive]
            score += q[i, a:b] @ part
            if b == dims or len(alive) <= k:
                continue
            slack = np.sqrt((q[i, b:] ** 2).sum()) * (after if whole else after[alive])
            low = score - slack
            least = np.partition(low, len(low) - k)[len(low) - k]
            keep = score + slack >= least - 0.5  # sums are integers; half a unit covers rounding
            if not keep.all():
                alive, score, whole = alive[keep], score[keep], False
        best = best_of(ids, alive, score, k)
        out.append((np.full(len(best), i), alive[best], score[best].astype(np.int64)))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    a, b, c = zip(*out)
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 8, grid: Grid = Grid()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` with the largest score for each query."""

    def find(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return branch_and_bound(ids, np.nan_to_num(np.floor(scale * x)), query_ids, np.nan_to_num(np.floor(scale * q)), k, block)

    return search(usable(vectors, id_col, vec_col, False), usable(queries, id_col, vec_col, False), find, "long", k, grid)
