"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Rows are dealt to cells by the top levels of one random-projection tree, whose cuts come from a bounded
sample of rows (``sample_rows``); a cell holds a forest over all its rows. Each tree halves its rows at their median along
a random direction, level by level, down to leaves of about ``leaf`` rows; a level of a tree has one
direction, so that a query needs one projection for each level and looks only at the cuts of nodes that it visits. To
turn largest inner product into nearest point, rows get one more component that brings them all to one
length (queries get 0 there).

All trees of a cell are searched through one shared priority queue. A node's priority is the sum of squared
distances from the query to the cuts that it lies behind: near children keep it, far ones add to it. The
queue is one of buckets, each as wide as a share of the limit, so that a block of queries pops
together: everything in the next bucket is popped, near children at once, far ones pushed back unless their bucket is open. Rows of the leaves
that were reached are ranked exactly, and the k-th best score so far sets the limit: with r the distance that it means,
a coordinate of what lies between the query and a better row has variance v = r * r / dimensions, and the
queue ends at ``stop`` * depth * depth * v. So close neighbours end a search early, and rows that are all about as far
as each other, as random ones are, end it late; the rule is the same at every size. In the same way a query is
sent to those cells that its queue over the top levels reaches before ``reach`` * v, with r from the sample.

Every row is indexed; only cuts between cells and the r of routing come from the sample. A cell of over ``shard_rows``
rows, such as copies of one vector fill, is dealt to salted shards by a hash of the id. ``visits`` reports the work.

Defined results: rows with a null id, or a vector that is null, empty, zero or holds a null, NaN or
infinite component, take no part; vectors meet only others of their length; a query never
finds rows of its own id; rows that repeat an id count separately, of queries that do the least vector counts; scores are added in the order
of dimensions, so that equal vectors have equal scores; ties go to the smaller id; fewer than k rows give as many as there
are; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from matchloom.llm._cells import best_of, usable
from matchloom.llm._common import cut

BUCKETS = 2


def lift(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with a last component that brings them to the length ``top``, divided by it."""
    rest = np.sqrt(np.maximum(top * top - (x * x).sum(1), 0.0))
    return np.column_stack([x, rest]) / top


def directions(dims: int, n: int, rng: np.random.Generator) -> np.ndarray:
    """(dims, n) of length one; as many as fit are at right angles."""
    parts = [np.linalg.qr(rng.standard_normal((dims, min(dims, n - a))))[0] for a in range(0, n, dims)]
    return np.concatenate(parts, axis=1) if parts else np.zeros((dims, 0))


class Tree:
    """One tree: cuts by heap number (the root is 1), rows in the order of leaves, where leaves start."""

    def __init__(self, side: np.ndarray) -> None:
        """side: (rows, levels), the rows' projections."""
        n, depth = side.shape
        self.cuts = np.zeros(1 << depth)
        order, edges = np.arange(n), np.array([0, n])
        for level in range(depth):
            node = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            order = order[np.argsort(4.0 * node + side[order, level], kind="stable")]  # projections lie in -1 .. 1
            middle = (edges[:-1] + edges[1:]) // 2
            low, high = np.clip(middle - 1, 0, max(0, n - 1)), np.clip(middle, 0, max(0, n - 1))
            self.cuts[1 << level : 2 << level] = (side[order[low], level] + side[order[high], level]) / 2
            edges = np.sort(np.concatenate([edges, middle]))
        self.rows, self.edges = order, edges


class Forest:
    def __init__(self, x: np.ndarray, trees: int, leaf: int, seed: int) -> None:
        self.x, self.top = x, math.sqrt((x * x).sum(1).max())
        self.depth = max(0, math.ceil(math.log2(max(1.0, len(x) / leaf))))
        self.r = directions(x.shape[1] + 1, trees * self.depth, np.random.default_rng(seed))
        side = (lift(x, self.top) @ self.r).reshape(len(x), trees, self.depth)
        self.trees = [Tree(side[:, t]) for t in range(trees)]
        self.cuts = np.stack([t.cuts for t in self.trees])

    def search(self, q: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int, stop: float) -> np.ndarray:
        """(queries, rows): approximate scores of the rows of all leaves that were popped, -inf for others; ``own``: pairs to leave out."""
        n, trees, depth = len(q), len(self.trees), self.depth
        length = np.maximum(np.linalg.norm(q, axis=1), 1e-300)
        side = (np.column_stack([q / length[:, None], np.zeros(n)]) @ self.r).reshape(n, trees, depth)
        scores = np.full((n, len(self.x)), -np.inf)
        limit = np.full(n, np.inf)
        unit = stop * depth * depth / self.x.shape[1]
        # the queue: query, tree, heap number, level, priority
        queue = [np.repeat(np.arange(n), trees), np.tile(np.arange(trees), n), np.ones(n * trees, int), np.zeros(n * trees, int), np.zeros(n * trees)]
        for bucket in range(BUCKETS + 1):
            with np.errstate(invalid="ignore"):
                upto = np.where(np.isinf(limit), 0.0, limit * bucket / BUCKETS)
            open_ = queue[4] <= upto[queue[0]]
            now, queue = [c[open_] for c in queue], [c[~open_] for c in queue]
            pushed, reached = [queue], []
            while len(now[0]):
                leafy = now[3] == depth
                reached.append([c[leafy] for c in now[:3]])
                qi, t, node, level, cost = (c[~leafy] for c in now)
                if not len(qi):
                    break
                m = side[qi, t, level] - self.cuts[t, node]
                near = 2 * node + (m > 0)
                far = cost + m * m
                close, keep = far <= upto[qi], far <= limit[qi]
                later = keep & ~close
                pushed.append([qi[later], t[later], (near ^ 1)[later], level[later] + 1, far[later]])
                now = [np.concatenate([a, b[close]]) for a, b in ((qi, qi), (t, t), (near, near ^ 1), (level + 1, level + 1), (cost, far))]
            queue = [np.concatenate(c) for c in zip(*pushed)]
            if reached:
                self._rank(q, scores, *(np.concatenate(c) for c in zip(*reached)))
            scores[own] = -np.inf
            if bucket == BUCKETS and not np.isinf(limit).any():
                break
            some = min(k, scores.shape[1])
            kth = np.partition(scores, scores.shape[1] - some, axis=1)[:, scores.shape[1] - some]
            # a query with fewer than k rows so far goes on without a limit
            apart = 2 - 2 * np.clip(kth / (length * self.top), -1, 1)
            limit = np.where(np.isfinite(kth) & (some == k), unit * apart, np.inf)
            queue = [c[queue[4] <= limit[queue[0]]] for c in queue]
            short = np.isinf(limit)
            if short.any() and len(queue[0]):  # pop all that such a query has: it has seen hardly any rows
                scores[short] = q[short] @ self.x.T
                scores[own] = -np.inf
                keep = ~short[queue[0]]
                queue = [c[keep] for c in queue]
                limit[short] = 0.0
        return scores

    def _rank(self, q: np.ndarray, scores: np.ndarray, qi: np.ndarray, t: np.ndarray, node: np.ndarray) -> None:
        """Score the rows of the leaves (query, tree, heap number), leaf by leaf."""
        leaves = 1 << self.depth
        at = t * leaves + node - leaves
        order = np.argsort(at, kind="stable")
        at, qi = at[order], qi[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
        for lo, hi in zip(starts, [*starts[1:], len(at)]):
            tree, leaf = divmod(int(at[lo]), leaves)
            tree = self.trees[tree]
            rows = tree.rows[tree.edges[leaf] : tree.edges[leaf + 1]]
            scores[qi[lo:hi, None], rows] = q[qi[lo:hi]] @ self.x[rows].T


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q, added in the order of dimensions."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * q[d]
    return out


def nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, trees: int, leaf: int, stop: float, seed: int, block_bytes: int = 96 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each query its k best rows found, their scores, and for each query how many rows were scored."""
    forest = Forest(x, trees, leaf, seed)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    seen = np.zeros(len(q), np.int64)
    block = max(16, block_bytes // (8 * len(x)))
    order = np.argsort(ids, kind="stable")
    first, last = (np.searchsorted(ids[order], query_ids, side=side) for side in ("left", "right"))
    for at in range(0, len(q), block):
        part = q[at : at + block]
        each = (last - first)[at : at + block]
        own = np.repeat(np.arange(len(part)), each), order[np.repeat(first[at : at + block], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
        scores = forest.search(part, own, k, stop)
        seen[at : at + block] = np.isfinite(scores).sum(1)
        slack = 1e-9 * np.linalg.norm(part, axis=1) * forest.top
        for i, row in enumerate(scores):
            some = np.flatnonzero(row > -np.inf)
            if len(some) > k:
                least = np.partition(row[some], len(some) - k)[len(some) - k]
                some = some[row[some] >= least - slack[i]]
            exact = inner(x[some], part[i])
            best = best_of(ids, some, exact, k)
            out.append((np.full(len(best), at + i), some[best], exact[best]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), seen
    a, b, c = zip(*out)
    return np.concatenate(a), np.concatenate(b), np.concatenate(c), seen


class Router:
    """The top levels of a tree over a sample: which cell a row lies in, and which cells a query's queue reaches."""

    def __init__(self, x: np.ndarray, cells: int, reach: float, rank: int, seed: int) -> None:
        self.sample, self.reach, self.rank = x, reach, rank
        self.top = math.sqrt((x * x).sum(1).max())
        depth = max(0, min(math.ceil(math.log2(max(1, cells))), int(math.log2(max(1, len(x) / 16)))))
        self.r = directions(x.shape[1] + 1, depth, np.random.default_rng(seed))
        self.cuts = Tree(lift(x, self.top) @ self.r).cuts
        self.depth = depth

    def cells(self, x: np.ndarray) -> np.ndarray:
        side = lift(x, max(self.top, 1e-300)) @ self.r
        node = np.ones(len(x), int)
        for level in range(self.depth):
            node = 2 * node + (side[:, level] > self.cuts[node])
        return node - (1 << self.depth)

    def reached(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) pairs."""
        unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        near = np.sort(unit @ self.sample.T, axis=1)[:, -min(self.rank, len(self.sample))] / self.top
        limit = self.reach * (2 - 2 * np.clip(near, -1, 1)) / q.shape[1]
        side = np.column_stack([unit, np.zeros(len(q))]) @ self.r
        qi, node, cost = np.arange(len(q)), np.ones(len(q), int), np.zeros(len(q))
        for level in range(self.depth):
            m = side[qi, level] - self.cuts[node]
            to, far = 2 * node + (m > 0), cost + m * m
            go = far <= limit[qi]
            qi, node, cost = np.concatenate([qi, qi[go]]), np.concatenate([to, (to ^ 1)[go]]), np.concatenate([cost, far[go]])
        return qi, node - (1 << self.depth)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def _routers(rows: DataFrame, counts: dict[int, int], shard_rows: int, sample_rows: int, reach: float, k: int, seed: int) -> dict[int, Router]:
    """A router for each length of vectors that has more rows than a shard holds."""
    out = {}
    for dim, n in sorted(counts.items()):
        if n > _most(shard_rows, dim):
            most = min(sample_rows, max(1024, (1 << 22) // dim))
            some = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(most).select("vec").toArrow()
            # about as far as the k-th of all rows: no nearer in the sample
            out[dim] = Router(_matrix(some.column("vec"), dim), math.ceil(n / _most(shard_rows, dim)), reach, max(1, round(k * len(some) / n)), seed)
    return out


def _most(shard_rows: int, dim: int) -> int:
    """Rows of a shard: fewer of very long vectors."""
    return max(64, min(shard_rows, (1 << 21) // dim))


def _dealt(rows: DataFrame, routers: dict[int, Router], of_queries: bool) -> DataFrame:
    """Rows with their cell, or queries once for each cell that they reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim in np.unique(b.column(0).to_numpy()).tolist():
                part = b.filter(pa.array(b.column(0).to_numpy() == dim))
                if dim not in routers:
                    at, cell = np.arange(len(part)), np.zeros(len(part), int)
                elif of_queries:
                    at, cell = routers[dim].reached(_matrix(part.column(2), dim))
                else:
                    at, cell = np.arange(len(part)), routers[dim].cells(_matrix(part.column(2), dim))
                part = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(cell.astype(np.int64))], names=["dim", "vec_id", "vec", "cell"])

    return rows.select("dim", "vec_id", "vec").mapInArrow(run, "dim int, vec_id long, vec array<double>, cell long")


def _found(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, trees: int, leaf: int, stop: float, reach: float, shard_rows: int, block_rows: int, sample_rows: int, seed: int) -> DataFrame:
    """(query_id, vec_id, score, scored, held) of every shard: its best rows, how many it scored and how many it holds."""
    rows = usable(vectors, id_col, vec_col, True).withColumn("dim", F.size("vec"))
    counts = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    wanted = usable(queries, id_col, vec_col, True).groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    routers = _routers(rows, counts, shard_rows, sample_rows, reach, k, seed)
    left, right = cut(_dealt(rows, routers, False)), cut(_dealt(wanted, routers, True))
    most = F.greatest(F.lit(64), F.least(F.lit(shard_rows), F.floor(F.lit(1 << 21) / F.col("dim"))))
    size = left.groupBy("dim", "cell").count().select("dim", "cell", F.ceil(F.col("count") / most).cast("int").alias("salts"))
    asked = right.groupBy("dim", "cell").count().select("dim", "cell", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    plan = cut(size.join(asked, ["dim", "cell"]))
    here = ["dim", "cell"]
    a = left.join(F.broadcast(plan), here).select(*here, F.pmod(F.xxhash64("vec_id", F.lit(2)), "salts").cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "vec_id", "vec")
    b = right.join(F.broadcast(plan), here).select(*here, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"), F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks").cast("int").alias("b"), "vec_id", "vec")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("scored", pa.int64()), ("held", pa.int64())])

    def shard(key: tuple, x: pa.Table, q: pa.Table) -> pa.Table:
        if not len(x) or not len(q):
            return schema.empty_table()
        dim = key[0].as_py()
        ids, query_ids = x.column("vec_id").to_numpy(), q.column("vec_id").to_numpy()
        vectors = _matrix(x.column("vec"), dim)
        order = np.lexsort((*vectors.T[:1], ids))  # a run that is repeated sees the same order
        ids, vectors = ids[order], vectors[order]
        qi, ri, score, seen = nearest(ids, vectors, query_ids, _matrix(q.column("vec"), dim), k, trees, leaf, stop, seed)
        return pa.table([query_ids[qi], ids[ri], score, seen[qi], np.full(len(qi), len(ids))], schema=schema)

    keys = [*here, "s", "b"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(shard, "query_id long, vec_id long, score double, scored long, held long")


def search_forest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = 16, leaf: int = 64, stop: float = 0.004, reach: float = 2.0, shard_rows: int = 16384, block_rows: int = 8192, sample_rows: int = 4096, seed: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` found for each row of ``queries``.

    stop, reach: how far queues go, in a cell and over cells (see above); larger ones find more and score more rows.
    """
    found = _found(vectors, queries, k, id_col, vec_col, trees, leaf, stop, reach, shard_rows, block_rows, sample_rows, seed)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def visits(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = 16, leaf: int = 64, stop: float = 0.004, reach: float = 2.0, shard_rows: int = 16384, block_rows: int = 8192, sample_rows: int = 4096, seed: int = 1) -> pd.DataFrame:
    """One row: queries, and the mean number of rows scored for one (rows of shards with no find left out)."""
    found = _found(vectors, queries, k, id_col, vec_col, trees, leaf, stop, reach, shard_rows, block_rows, sample_rows, seed)
    shards = found.groupBy("query_id", "held", "scored").count().groupBy("query_id").agg(F.sum("scored").alias("scored"))
    return shards.agg(F.count("*").alias("queries"), F.avg("scored").alias("scored")).toPandas()
