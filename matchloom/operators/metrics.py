"""Aggregates over labels, predictions and probabilities. Blueprint ids: A1-A6, A8, A18, A19, A22, W4, J11, H26, W8, P3."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchloom.functions import scores
from matchloom.operators.ranking import numbered

EPS = 1e-6


def _total(keep: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(F.when(keep, weight).otherwise(F.lit(0))), F.lit(0))


def precision_recall_f1(label: Column, pred: Column) -> list[Column]:
    """A1: aggregates precision, recall and f1 in percent; 0 where nothing is predicted or true."""
    one = F.lit(1)
    tp, fp, fn = _total((label == 1) & (pred == 1), one), _total((label != 1) & (pred == 1), one), _total((label == 1) & (pred != 1), one)
    zero = lambda c: F.coalesce(c, F.lit(0.0)) * 100
    return [zero(F.try_divide(tp, tp + fp)).alias("precision"), zero(F.try_divide(tp, tp + fn)).alias("recall"), zero(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1")]


def weighted_f1(label: Column, prob: Column, weight: Column, metric: str = "f1") -> list[Column]:
    """A2: aggregates score, precision, recall, f1; rows count ``weight`` times.

    Without a positive, labels and predictions are flipped. ``f1``, or ``f1_v2``: f1/2 + min/2.
    """
    pred = (prob > 0.5).cast("int")
    positives = _total(label > 0.5, weight)
    side = lambda y: (_total((label == y) & (pred == y), weight), _total(pred == y, weight), _total(label == y, weight))
    picked = [F.when(positives > 0, a).otherwise(b) for a, b in zip(side(1), side(0))]
    tp, said, true = picked
    pre, rec = tp / (said + EPS), tp / (true + EPS)
    f1 = 2 * pre * rec / (pre + rec + EPS)
    score = f1 if metric == "f1" else f1 / 2 + F.least(pre, rec) / 2
    return [score.alias("score"), pre.alias("precision"), rec.alias("recall"), f1.alias("f1")]


def weighted_accuracy(label: Column, prob: Column, weight: Column) -> list[Column]:
    """A3: avg/2 + min(pos, neg)/2 of accuracies; 0 if no positive is right; an absent class counts 1 (Q6)."""
    right = (label > 0.5) == (prob > 0.5)
    of = lambda keep: F.coalesce(F.try_divide(_total(keep & right, weight), _total(keep, weight)).cast("double"), F.lit(1.0))
    every, pos, neg = of(F.lit(True)), of(label > 0.5), of(label <= 0.5)
    return [F.when(pos == 0, F.lit(0.0)).otherwise(every / 2 + F.least(pos, neg) / 2).alias("score"), pos.alias("pos"), neg.alias("neg")]


def certainty(prob: Column) -> list[Column]:
    """Mean confidence/2 + least class mean/2; 0.5 is in no class, an empty one counts 1."""
    conf = scores.confidence(prob)
    every, pos, neg = [F.coalesce(F.avg(c), F.lit(1.0)) for c in (conf, F.when(prob > 0.5, conf), F.when(prob < 0.5, conf))]
    return [(every / 2 + F.least(pos, neg) / 2).alias("certainty"), every.alias("conf_all"), pos.alias("conf_pos"), neg.alias("conf_neg")]


def info(label: Column, prob: Column, weight: Column, metric: str = "f1") -> Column:
    """Half the certainty plus the labelled score."""
    return 0.5 * certainty(prob)[0] + weighted_f1(label, prob, weight, metric)[0]


def histogram(df: DataFrame, label: str, prob: str, bins: int = 20) -> DataFrame:
    """Counts by label and equal bin of (0, 1); the last bin is closed."""
    return df.groupBy(label, F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def report(df: DataFrame, dataset: str, model: str, label: str, pred: str, models: Sequence[str]) -> DataFrame:
    """One row for each dataset, the F1 of each model in a column of its name, ``--`` where missing."""
    f1 = F.round(precision_recall_f1(F.col(label), F.col(pred))[2], 2)
    wide = df.groupBy(dataset).pivot(model, list(models)).agg(f1)
    return wide.select(dataset, *[F.coalesce(F.format_string("%.2f", F.col(f"`{m}`")), F.lit("--")).alias(m) for m in models])


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Right-closed bins of equal width; the first holds the least value as well."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), (F.ceil((value - low) / (high - low) * bins) - 1).cast("int")))


def ranked_bins(df: DataFrame, order: Sequence[Column], size: int, out: str = "bin") -> DataFrame:
    """Consecutive bins of ``size`` rows in the given order.

    Row numbers come from counts of range partitions, so that no task sees all rows.
    """
    return numbered(df, order, "_place").withColumn(out, F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place")


def null_shares(pairs: DataFrame, columns: Sequence[str], a: str = "a_", b: str = "b_", most: float = 0.2) -> DataFrame:
    """(column_name, nulls, kept): attributes that are null on either side of fewer than ``most`` of the pairs."""
    either = [F.sum(F.when(F.col(a + c).isNull() | F.col(b + c).isNull(), 1).otherwise(0)).alias(c) for c in columns]
    counted = pairs.agg(F.count("*").alias("_n"), *either)
    long = counted.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])).alias("x"))
    return long.select("x.column_name", "x.nulls", (F.col("x.nulls") < most * F.col("_n")).alias("kept"))


def cell_bounds(candidates: DataFrame, id_col: str, prob: str) -> DataFrame:
    """(id, lo, hi): midpoints to the neighbours in order of probability; 0 and 1 at the ends.

    Candidates are labelled rows, as many as the label budget; the window has no partition.
    """
    order = Window.orderBy(prob, id_col)
    lag, lead = F.lag(prob).over(order), F.lead(prob).over(order)
    return candidates.select(F.col(id_col).alias("id"), F.coalesce((lag + F.col(prob)) / 2, F.lit(0.0)).alias("lo"), F.coalesce((F.col(prob) + lead) / 2, F.lit(1.0)).alias("hi"))


def cell_weights(probs: DataFrame, prob: str, bounds: DataFrame, slots: int = 1024) -> DataFrame:
    """(id, weight): how many probabilities lie in [lo, hi) of each candidate.

    A range join by slots: equal probabilities are counted first, and meet only the
    bounds that reach into their slot.
    """
    counted = probs.where(F.col(prob).isNotNull()).groupBy(F.col(prob).alias("p")).agg(F.count("*").alias("n")).withColumn("slot", F.floor(F.col("p") * slots).cast("int"))
    reach = bounds.where("hi > lo").withColumn("slot", F.explode(F.sequence(F.floor(F.col("lo") * slots).cast("int"), F.floor(F.col("hi") * slots).cast("int"))))
    inside = counted.join(reach, "slot").where("p >= lo AND p < hi").groupBy("id").agg(F.sum("n").alias("weight"))
    return bounds.select("id").join(inside, "id", "left").select("id", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
