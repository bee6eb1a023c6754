"""From files to figures: encode, select, evaluate, and sweeps of them. Blueprint ids: O1, O3-O7, P9, P10, S12, A19, H28.

Run as ``python -m matchloom.plans.pipeline select --dataset WA --method MFL ...``. Settings are one
frozen object; a stage whose result is there already is skipped.
"""

from __future__ import annotations

import argparse
import dataclasses
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchloom.functions import scores, text
from matchloom.operators import gain, metrics, retrieval, scoring, selection
from matchloom.sources import entities
from matchloom.sources.shared import cut

# Data sets by their short names, the folders of two kinds, and the nouns that are not Product, as spelled in prompts.
DATASETS = {
    "AG": "Amazon-Google",
    "BR": "BeerAdvo-RateBeer",
    "DA": "DBLP-ACM",
    "DS": "DBLP-Scholar",
    "FZ": "Fodors-Zagats",
    "IA": "iTunes-Amazon",
    "WA": "Walmart-Amazon",
    "AB": "Abt-Buy",
}
MARKED = ("cameras", "computers", "shoes", "watches")
NOUNS = {"DA": "Paper", "DS": "Paper", "FZ": "Resturant", "IA": "Song"}
WITHOUT_MODEL = ("MFL", "fast_votek", "cosine_sim")


@dataclasses.dataclass(frozen=True)
class Settings:
    dataset: str = "FZ"
    top: str = "data"  # inputs
    work: str = "work"  # vectors, selections, predictions
    attributes: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    dirty: bool = False
    method: str = "MFL"
    model: str = "overlap"
    k: int = 10
    budget: int = 60
    sample_size: int = 2000
    eval_size: int = 100
    sim: str = "cosine"
    metric: str = "f1"
    separate: bool = False
    sample: bool = False  # draw by gain in place of the best
    style: str = "s6"
    order: str = "o7"
    variant: int = 0  # of the patterns of o3
    question: str = "q2"
    task: str = "t3"
    seed: int = 1234
    batch: int = 64

    @property
    def name(self) -> str:
        return DATASETS.get(self.dataset, self.dataset)

    @property
    def marked(self) -> bool:
        return self.dataset in MARKED

    @property
    def noun(self) -> str:
        return NOUNS.get(self.dataset, "Product")

    @property
    def folder(self) -> str:
        """P10"""
        if self.marked:
            kind = "wdc"
        elif self.dataset == "AB":
            kind = "ER-Magellan/Textual"
        else:
            kind = "ER-Magellan/Dirty" if self.dirty else "ER-Magellan/Structured"
        return f"{self.top}/{kind}/{self.name}"

    def vectors(self, split: str) -> str:
        return f"{self.work}/vectors/{self.name}/{split}"

    def selection(self) -> str:
        return entities.selection_path(f"{self.work}/selected/{self.name}", self.method, None if self.method in WITHOUT_MODEL else self.model)

    def predictions(self) -> str:
        return f"{self.work}/results/{self.name}/{self.method}_{self.model}"


def load_pairs(spark: SparkSession, s: Settings, split: str) -> DataFrame:
    """(pair_id, label, a array<string>, b array<string>) of the train or test split."""
    if s.marked:
        name = "train.txt.small" if split == "train" else "test.txt"
        rows = entities.marked_pairs(spark, f"{s.folder}/{name}")
        return rows.select("pair_id", "label", text.clean_marked_title(F.col("textA")).alias("a"), text.clean_marked_title(F.col("textB")).alias("b"))
    pairs = entities.pair_list(spark, f"{s.folder}/{split}.csv")
    a, b = [entities.entity_table(spark, f"{s.folder}/table{x}.csv", s.attributes, s.numeric, s.name) for x in "AB"]
    black = entities.black_list(spark, f"{s.folder}/black_list.csv") if split == "train" else None
    joined = entities.assemble(pairs, a, b, black)
    return joined.select("pair_id", "label", text.as_strings(columns(s), "a_").alias("a"), text.as_strings(columns(s), "b_").alias("b"))


def columns(s: Settings) -> list[str]:
    if s.marked:
        return ["title"]
    keep = entities.KEY_ATTRIBUTES.get(s.name, list(s.attributes))
    return [c for c in s.attributes if c in keep]


def pair_text(s: Settings) -> F.Column:
    return text.PairFormat(columns(s), F.col("a"), F.col("b"), s.noun, s.numeric).write(s.style)


def encode(spark: SparkSession, s: Settings, make: Callable[[], scoring.Encoder] = scoring.HashEncoder) -> None:
    """Vectors of both records and of the pair, for each split; the pair's has length one, diff = |A - B|."""
    question = retrieval.part(retrieval.QUESTIONS, s.question, s.noun)
    for split in ("train", "test"):
        if entities.exists(spark, s.vectors(split)):
            continue
        rows = load_pairs(spark, s, split)
        a, b = [text.encoder_text(columns(s), F.col(x)) for x in "ab"]
        rows = rows.select("pair_id", a.alias("ta"), b.alias("tb"), text.encoder_pair_text(a, b, question).alias("tp"))
        for source, out in (("ta", "a_vec"), ("tb", "b_vec"), ("tp", "pair")):
            rows = scoring.encoded(rows, make, source, out)
        done = rows.select("pair_id", "a_vec", "b_vec", scores.unit(F.col("pair")).alias("vec"), scores.difference(F.col("a_vec"), F.col("b_vec")).alias("diff"))
        entities.write_vectors(done, s.vectors(split))


def candidates(spark: SparkSession, s: Settings) -> DataFrame:
    """(id, label, score, vec, text), reduced by 1-D facility location over the pairs' cosines if there are too many."""
    pairs = load_pairs(spark, s, "train")
    vectors = spark.read.parquet(s.vectors("train"))
    rows = pairs.select("pair_id", "label", pair_text(s).alias("text")).join(vectors, "pair_id")
    rows = cut(rows.select(F.col("pair_id").alias("id"), "label", scores.cosine(F.col("a_vec"), F.col("b_vec")).alias("score"), "vec", "text"))
    if s.sample_size > 0 and rows.count() > s.sample_size:
        kept = selection.facility_sample(rows.select("id", F.array("score").alias("vec")), s.sample_size, early_stop=True)
        rows = cut(rows.join(kept.select("id"), "id", "left_semi"))
    return rows


class PromptPredictor:
    """Predictions of a scorer for candidates, with given demonstrations in the prompt."""

    def __init__(self, rows: DataFrame, s: Settings, make: Callable[[], scoring.Scorer]) -> None:
        self.rows, self.s, self.make = rows, s, make

    def predict(self, examples: list[int]) -> DataFrame:
        shown = self.rows.where(F.col("id").isin(examples) if examples else F.lit(False)).withColumn("rank", F.array_position(F.array(*map(F.lit, examples)), F.col("id")) if examples else F.lit(0))
        s = self.s
        prompts = retrieval.shared_prompts(self.rows.select(F.col("id").alias("test_id"), "text"), shown, "rank", s.noun, s.task, s.question, order=s.order, seed=s.seed, variant=s.variant)
        return scoring.scored(prompts, self.make, batch=self.s.batch).select(F.col("test_id").alias("id"), "prob").join(self.rows.select("id", "label"), "id")

    def predict_many(self, sets: list[list[int]], ids: list[int]) -> list[dict[int, float]]:
        """One job for all sets and ids."""
        if not sets or not ids:
            return [{} for _ in sets]
        spark, ask = self.rows.sparkSession, retrieval.part(retrieval.QUESTIONS, self.s.question, self.s.noun)
        members = spark.createDataFrame([(n, p, i) for n, x in enumerate(sets) for p, i in enumerate(x)], "set int, place int, id long")
        shown = members.join(self.rows.select("id", "label", retrieval.example_text(F.col("text"), F.col("label"), ask).alias("shown")), "id")
        placed = retrieval.in_turn(shown, "set", "place", self.s.order, self.s.seed, self.s.variant)
        block = placed.groupBy("set").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]), "\n\n").alias("block"))
        head = retrieval.part(retrieval.TASKS, self.s.task, self.s.noun)
        asked = self.rows.where(F.col("id").isin(ids)).crossJoin(F.broadcast(block))
        prompts = asked.select("set", "id", F.concat(F.lit(head), "block", F.lit("\n\n"), "text", F.lit(f"\n{ask}")).alias("prompt"))
        out: list[dict[int, float]] = [{} for _ in sets]
        for r in scoring.scored(prompts, self.make, batch=self.s.batch).select("set", "id", "prob").collect():
            out[r["set"]][r["id"]] = r["prob"]
        return out

    def content_free(self) -> float:
        """Mean probability of two pairs without content, clipped."""
        spark, cols = self.rows.sparkSession, columns(self.s)
        blank = spark.createDataFrame([(k, [v] * len(cols), [v] * len(cols)) for k, v in enumerate(("[MASK]", "N/A"))], "test_id long, a array<string>, b array<string>")
        none = self.rows.limit(0).withColumn("rank", F.lit(0))
        prompts = retrieval.shared_prompts(blank.select("test_id", pair_text(self.s).alias("text")), none, "rank", self.s.noun, self.s.task, self.s.question)
        return scoring.scored(prompts, self.make).agg(F.avg("prob")).first()[0]


def choose(rows: DataFrame, s: Settings, predictor: PromptPredictor) -> DataFrame:
    """(rank, id) by the method's name. V3: similarity ``pairdiff`` compares pairs by their cosines alone."""
    placed, kind = (rows.withColumn("vec", F.array("score")), "l1") if s.sim == "pairdiff" else (rows, s.sim)
    if s.method == "MFL":
        return selection.facility_location(placed, s.budget, kind=kind)
    if s.method == "fast_votek":
        return selection.fast_votek(placed, s.budget, kind=kind)
    if s.method == "votek":
        return selection.votek(placed, predictor.predict, s.budget, kind=kind)
    if s.method == "adaicl":
        return selection.adaptive_cover(placed, predictor.predict, s.budget, kind=kind)
    if s.method == "cosine_sim":
        return selection.cosine_extremes(rows, s.budget)
    if s.method == "max_entropy":
        return selection.max_entropy(cut(predictor.predict([])), s.budget)
    if s.method == "min_entropy_bl":
        return selection.min_entropy_balanced(cut(predictor.predict([])), s.budget)
    if s.method == "cbs_maxIG":
        return selection.calibrated_gain(cut(predictor.predict([])), predictor.content_free(), s.budget)
    if s.method == "our":
        known = rows.select("id", "label", "score").collect()  # candidates() has bounded them
        state = gain.iterative_gain(sorted(r["id"] for r in known), {r["id"]: r["label"] for r in known}, {r["id"]: r["score"] for r in known}, predictor.predict_many, s.k, s.budget, s.eval_size, s.metric, separate=s.separate, sample_seed=s.seed if s.sample else None)
        return rows.sparkSession.createDataFrame([(n + 1, i) for n, i in enumerate(state.selected)], "rank int, id long")
    raise ValueError(f"unknown method {s.method!r}")


METHODS = ("MFL", "fast_votek", "votek", "adaicl", "cosine_sim", "max_entropy", "min_entropy_bl", "cbs_maxIG", "our")


def select(spark: SparkSession, s: Settings, make: Callable[[], scoring.Scorer] = scoring.OverlapScorer) -> DataFrame:
    """Demonstrations by the method, written once; (k, rank, index, label)."""
    if not entities.exists(spark, s.selection()):
        rows = candidates(spark, s)
        chosen = choose(rows, s, PromptPredictor(rows, s, make))
        entities.write_selection(chosen, rows.withColumnRenamed("id", "pair_id"), s.k, s.selection())
    return entities.read_selection(spark, s.selection(), budget=s.budget)


def evaluate(spark: SparkSession, s: Settings, make: Callable[[], scoring.Scorer] = scoring.OverlapScorer) -> DataFrame:
    """Predictions for the test split, written once, and their precision, recall and F1."""
    if not entities.exists(spark, s.predictions()):
        train, test = [load_pairs(spark, s, x).withColumn("text", pair_text(s)) for x in ("train", "test")]
        tests = test.join(spark.read.parquet(s.vectors("test")).select("pair_id", "vec"), "pair_id").select(F.col("pair_id").alias("test_id"), "text", "vec", "label")
        chosen = select(spark, s, make)
        shots = cut(entities.demonstrations(chosen, train, spark.read.parquet(s.vectors("train")).select("pair_id", "vec")).select(F.col("pair_id").alias("example_id"), "rank", "text", "label", "vec"))
        if s.k >= shots.count():
            prompts = retrieval.shared_prompts(tests, shots, "rank", s.noun, s.task, s.question, order=s.order, seed=s.seed, variant=s.variant)
        else:
            found = retrieval.balanced(tests.select("test_id", "vec"), shots.select("example_id", "vec", "label"), s.k)
            placed = retrieval.ordered(found, s.order, s.seed, s.variant)
            prompts = retrieval.prompts(tests.select("test_id", "text"), shots, placed, s.noun, s.task, s.question)
        judged = scoring.scored(prompts, make, batch=s.batch).join(tests.select("test_id", "label"), "test_id")
        entities.write_predictions(judged.withColumnRenamed("test_id", "pair_id"), s.predictions())
    done = entities.read_predictions(spark, s.predictions())
    return done.agg(*metrics.precision_recall_f1(F.col("label"), F.col("pred")))


def sweep(spark: SparkSession, settings: Iterable[Settings], make: Callable[[], scoring.Scorer] = scoring.OverlapScorer) -> DataFrame:
    """F1 by data set and model, ``--`` where there is no result."""
    rows = []
    for s in settings:
        f1 = evaluate(spark, s, make).first()["f1"]
        rows.append((s.name, s.model, f1))
    models = sorted({m for _, m, _ in rows})
    wide = spark.createDataFrame(rows, "dataset string, model string, f1 double").groupBy("dataset").pivot("model", models).agg(F.max("f1"))
    return wide.select("dataset", *[F.coalesce(F.format_string("%.2f", F.col(f"`{m}`")), F.lit("--")).alias(m) for m in models])


def probability_histogram(spark: SparkSession, s: Settings, bins: int = 20) -> DataFrame:
    """The data of the figure."""
    return metrics.histogram(entities.read_predictions(spark, s.predictions()), "label", "prob", bins)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("stage", choices=["encode", "select", "evaluate"])
    for f in dataclasses.fields(Settings):
        if f.type == "bool":
            parser.add_argument(f"--{f.name}", action="store_true")
        elif "tuple" in f.type:
            parser.add_argument(f"--{f.name}", type=lambda v: tuple(v.split(",")), default=f.default)
        else:
            parser.add_argument(f"--{f.name}", type={"int": int}.get(f.type, str), default=f.default)
    args = vars(parser.parse_args(argv))
    stage = args.pop("stage")
    spark = SparkSession.builder.appName("matchloom").getOrCreate()
    s = Settings(**args)
    out = encode(spark, s) if stage == "encode" else {"select": select, "evaluate": evaluate}[stage](spark, s, scoring.scorer(s.model))
    if out is not None:
        out.show(truncate=False)


if __name__ == "__main__":
    main()
