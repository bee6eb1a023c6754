"""A deterministic stand-in for the language model over pairs of vectors, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from matchloom.functions import scores
from matchloom.operators.gain import PredictMany
from matchloom.operators.selection import Predict


def blended(prob: Column, vec: Column, examples: Column, share: float = 0.4, sharp: float = 4.0) -> Column:
    """The pair's own probability, blended with the labels of its examples, the similar ones most."""
    weighed = F.transform(examples, lambda e: F.struct(F.exp(sharp * scores.dot(vec, e["vec"])).alias("w"), e["label"].alias("y")))
    total = F.aggregate(weighed, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("y")), lambda a, e: F.struct((a["n"] + e["w"]).alias("n"), (a["y"] + e["w"] * e["y"]).alias("y")))
    return F.when(F.size(examples) > 0, (1 - share) * prob + share * total["y"] / total["n"]).otherwise(prob)


class Surrogate:
    """Predictions for (id, label, prob, vec), a written table that each call reads; example sets are a label budget long at most."""

    def __init__(self, pairs: DataFrame) -> None:
        self.pairs = pairs.select("id", "label", "prob", scores.unit(F.col("vec")).alias("vec"))
        self.spark: SparkSession = pairs.sparkSession

    def _sets(self, sets: list[list[int]]) -> DataFrame:
        rows = [(n, i) for n, s in enumerate(sets) for i in s]
        named = self.spark.createDataFrame([(n,) for n in range(len(sets))], "set int")
        members = F.broadcast(self.spark.createDataFrame(rows, "set int, id long")).join(self.pairs.select("id", "vec", "label"), "id")
        held = members.groupBy("set").agg(F.array_sort(F.collect_list(F.struct("id", "vec", "label"))).alias("examples"))
        none = F.expr("CAST(array() AS array<struct<id:bigint,vec:array<double>,label:int>>)")
        return named.join(held, "set", "left").select("set", F.coalesce("examples", none).alias("examples"))

    def predict(self, examples: list[int]) -> DataFrame:
        one = F.broadcast(self._sets([examples]))
        return self.pairs.crossJoin(one).select("id", "label", F.round(blended(F.col("prob"), F.col("vec"), F.col("examples")), 9).alias("prob"))

    def predict_many(self, sets: list[list[int]], ids: list[int]) -> list[dict[int, float]]:
        if not sets or not ids:
            return [{} for _ in sets]
        wanted = self.pairs.join(F.broadcast(self.spark.createDataFrame([(i,) for i in ids], "id long")), "id")
        rows = wanted.crossJoin(F.broadcast(self._sets(sets))).select("set", "id", F.round(blended(F.col("prob"), F.col("vec"), F.col("examples")), 9).alias("prob")).collect()
        out: list[dict[int, float]] = [{} for _ in sets]
        for r in rows:
            out[r["set"]][r["id"]] = r["prob"]
        return out


def predictors(pairs: DataFrame) -> tuple[Predict, PredictMany]:
    s = Surrogate(pairs)
    return s.predict, s.predict_many
