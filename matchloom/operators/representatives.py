"""Representatives of groups of rows. Blueprint ids: A9, V6, V9, G10d, H26."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from matchloom.functions import scores
from matchloom.operators import blocks
from matchloom.operators.metrics import equal_width_bin


def medoids(rows: DataFrame, group: str | None = None, digits: int = 9) -> DataFrame:
    """(group, id): of each group the row with the least sum of L1 distances to its others; ties to the smaller id.

    Distances are summed in cells of two blocks; rows of different groups don't count.
    """
    keyed = rows.select("id", "vec", (F.col(group) if group else F.lit(0)).cast("long").alias("grp"))

    def fn(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        same = x["grp"].to_numpy()[:, None] == y["grp"].to_numpy()[None, :]
        d = blocks.l1_distances(blocks.stack(x["vec"]), blocks.stack(y["vec"]))
        return pd.DataFrame({"grp": x["grp"].to_numpy(), "id": x["id"].to_numpy(), "far": np.where(same, d, 0.0).sum(1)})

    far = blocks.per_cell(keyed, fn, "grp long, id long, far double").groupBy("grp", "id").agg(F.round(F.sum("far"), digits).alias("far"))
    return far.groupBy("grp").agg(F.min_by("id", F.struct("far", "id")).alias("id")).withColumnRenamed("grp", group or "grp")


def kmeans_members(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """V9: (cluster, id): the row nearest, by L1, to each of n k-means centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=n, seed=seed, featuresCol="features").fit(rows.select(array_to_vector("vec").alias("features")))
    centres = rows.sparkSession.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    far = rows.crossJoin(F.broadcast(centres)).select("cluster", "id", F.round(scores.l1(F.col("vec"), F.col("centre")), 9).alias("far"))  # n centres
    return far.groupBy("cluster").agg(F.min_by("id", F.struct("far", "id")).alias("id"))


def quotas(sizes: dict[int, int], n: int) -> dict[int, int]:
    """How many of n go to each bin: in proportion to its size, one at least, small bins first; what they round
    up is taken from the larger ones.
    """
    out, left = {}, dict(sizes)
    for b in sorted(sizes, key=lambda b: (sizes[b], b)):
        share = (n - sum(out.values())) * left[b] / sum(left.values())
        out[b] = max(1, round(share))
        del left[b]
    return out


def by_confidence(rows: DataFrame, n: int) -> DataFrame:
    """G10d: (bin, id): about n rows; rows: (id, vec, prob).

    Half as many bins of equal width by confidence share n by their sizes, each is cut into as many bins again,
    and the medoid of each of these is taken.
    """
    conf = rows.withColumn("conf", scores.confidence(F.col("prob")))
    low, high = conf.agg(F.min("conf"), F.max("conf")).first()
    binned = conf.withColumn("outer", equal_width_bin(F.col("conf"), F.lit(low), F.lit(high), max(1, n // 2)) if high > low else F.lit(0))
    stats = binned.groupBy("outer").agg(F.count("*").alias("n"), F.min("conf").alias("low"), F.max("conf").alias("high")).collect()  # n / 2 rows
    share = quotas({r["outer"]: r["n"] for r in stats}, n)
    bounds = rows.sparkSession.createDataFrame([(r["outer"], share[r["outer"]], r["low"], r["high"]) for r in stats], "outer int, parts int, low double, high double")
    inner = F.when(F.col("high") > F.col("low"), F.greatest(F.lit(0), F.least(F.col("parts") - 1, F.ceil(F.try_divide(F.col("conf") - F.col("low"), F.col("high") - F.col("low")) * F.col("parts")).cast("int") - 1))).otherwise(0)
    return medoids(binned.join(F.broadcast(bounds), "outer").withColumn("bin", F.col("outer") * (n + 1) + inner), "bin")


def imbalance_target(selected: DataFrame) -> int:
    """G10j: the class to add next, 1 or 0, or 2 if the selected labels are balanced."""
    pos, neg = selected.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first()
    return 2 if pos == neg else int(pos < neg)


def group_sizes(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share) with the share of all rows."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
