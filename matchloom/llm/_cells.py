"""Searches of many queries against all rows, dealt out as cells of one shard and one block of queries."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from matchloom.llm._common import cut


@dataclass(frozen=True)
class Grid:
    """How rows and queries are dealt: hashed shards of about shard_rows rows, blocks of about block_rows queries,
    and fewer where vectors are so long that either side of a cell would hold over cell_numbers numbers.
    """

    shard_rows: int = 8192
    block_rows: int = 8192
    cell_numbers: int = 1 << 20


def usable(df: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(vec_id, vec): rows with an id and a vector of finite components, in double precision."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    keep = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite
    return rows.where(keep & F.exists("vec", lambda x: x != 0) if nonzero else keep)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64, copy=False)


def search(rows: DataFrame, queries: DataFrame, find: Callable, score_type: str, k: int, grid: Grid = Grid()) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) over all cells; ties go to the smaller vec_id.

    find(ids, x, query_ids, q) gives, for one cell, three equal-length arrays: indices into
    query_ids, indices into ids, scores. Only vectors of equal length meet. Rows go to shards by a hash of
    their id, so no vector that is common makes a shard larger; both sides of a cell are bounded. Of
    queries that repeat an id the least vector is searched for.
    """
    rows = cut(rows.withColumn("dim", F.size("vec")))
    queries = queries.groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # attributes of its own, or pruning mixes the sides up
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    most = max(64, grid.cell_numbers // dims)  # longer vectors, fewer of them
    shards = max(1, math.ceil(n / min(grid.shard_rows, most)))
    blocks = max(1, math.ceil(queries.count() / min(grid.block_rows, most)))
    left = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "vec")
    right = queries.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "vec_id", "vec")
    empty = pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="int64" if score_type == "long" else "float64")})

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return empty
        a = a.sort_values("vec_id", kind="stable")  # a run that is repeated sees the same order
        ids, query_ids = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        qi, ri, score = find(ids, matrix(a["vec"]), query_ids, matrix(b["vec"]))
        return pd.DataFrame({"query_id": query_ids[qi], "vec_id": ids[ri], "score": score})

    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best_of(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[rows[some]], -scores[some]))][:k]
