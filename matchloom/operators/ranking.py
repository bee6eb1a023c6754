"""Row numbers and ordered walks over whole tables without a single task for all rows.

Blueprint ids: T1-T5, T8-T10, R1, W6, H14.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchloom.sources.shared import cut


def numbered(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """``df`` with 1-based numbers in the given order.

    Rows are sorted over range partitions and numbered inside them; the counts of the partitions,
    one row each, give every partition's offset.
    """
    placed = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    # ids ascend in a sorted partition, so they give the place there without another sort; written
    # before it is read twice, as both readers have to see the same partitions
    inside = cut(placed).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    sizes = inside.groupBy("_part").agg(F.max("_in").alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = inside.join(F.broadcast(before), F.col("_part") == F.col("_p"))
    return joined.withColumn(out, (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_p", "_at", "_in", "_before")


def two_ended_walk(df: DataFrame, id_col: str, score: str, label: str, budget: int) -> DataFrame:
    """(rank, id, label): from the high end until a match, then from the low end until a non-match, in turn.

    In closed form: on each side the sorted rows fall into runs that end at a hit, and runs of the two
    sides alternate. Only the ``budget`` rows at either end can be reached (Q4: each row once).
    """
    rows = df.where(F.col(score).isNotNull()).select(F.col(id_col).alias("id"), F.col(score).alias("score"), F.col(label).cast("int").alias("label"))

    def side(k: int, order: list[Column]) -> DataFrame:
        ends = rows.orderBy(*order).limit(budget)  # budget rows at most reach the window
        w = Window.orderBy(*order)
        hit = F.when(F.col("label") == (1 if k == 0 else 0), 1).otherwise(0)
        run = F.coalesce(F.sum(hit).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return ends.select("id", "label", run.alias("run"), F.lit(k).alias("side"), F.row_number().over(w).alias("at"))

    # in ascending stable order the high end is read backwards: equal scores come with the larger id first
    both = side(0, [F.desc("score"), F.desc("id")]).union(side(1, [F.asc("score"), F.asc("id")]))
    order = Window.orderBy("run", "side", "at")
    taken = both.withColumn("_g", F.row_number().over(order))
    first = taken.withColumn("_f", F.min("_g").over(Window.partitionBy("id"))).where("_g = _f")
    return first.select(F.row_number().over(Window.orderBy("_g")).alias("rank"), "id", "label").where(F.col("rank") <= budget)


def interleave_key(rank: Column, mine: Column, other: Column, first: bool) -> Column:
    """Position key of the item of 0-based ``rank`` when two ranked lists are merged.

    The shorter list (of equal ones the first) is spread into the longer at every ``rate`` places.
    """
    short = (mine < other) | ((mine == other) & F.lit(first))
    rate = F.least(F.bround((mine + other) / F.least(mine, other)), F.lit(3)).cast("long")
    spread = F.when(short, rank * rate).otherwise(rate * F.floor(rank / (rate - 1)) + 1 + rank % (rate - 1))
    return F.when(F.least(mine, other) == 0, rank).otherwise(spread).cast("long")
