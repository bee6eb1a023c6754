import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from matchloom.plans import pipeline
from matchloom.sources import entities
from matchloom.streaming import scoring as streaming


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("data")
    d = top / "ER-Magellan" / "Structured" / "Fodors-Zagats"
    d.mkdir(parents=True)
    rng = random.Random(0)
    names = [f"{rng.choice(['blue', 'red', 'old'])} {rng.choice(['cafe', 'grill', 'house'])} {i}" for i in range(40)]
    with (d / "tableA.csv").open("w") as f:
        f.write("id,name,city,price\n" + "".join(f'{i},"{n}, inc",town{i % 5},{i % 4}\n' for i, n in enumerate(names)))
    with (d / "tableB.csv").open("w") as f:
        f.write("id,name,city,price\n" + "".join(f'{i},"{n}",{"" if i % 7 == 0 else f"town{i % 5}"},{i % 4}\n' for i, n in reversed(list(enumerate(names)))))
    for split, n in (("train", 60), ("test", 30)):
        rows = [(rng.randrange(40), rng.randrange(40)) for _ in range(n)] + [(i, i) for i in range(n // 2)]
        with (d / f"{split}.csv").open("w") as f:
            f.write("ltable_id,rtable_id,label\n" + "".join(f"{a},{b},{int(a == b)}\n" for a, b in rows))
    (d / "black_list.csv").write_text("ltable_id\n3\n")
    return top


@pytest.fixture(scope="module")
def settings(folder):
    return pipeline.Settings(dataset="FZ", top=str(folder), work=str(folder / "work"), attributes=("name", "city", "price"), numeric=("price",), budget=8, k=4, eval_size=12, sample_size=40)


def test_routing():
    s = pipeline.Settings(dataset="DA", dirty=True, top="t")
    assert (s.folder, s.noun) == ("t/ER-Magellan/Dirty/DBLP-ACM", "Paper")
    assert pipeline.Settings(dataset="shoes", top="t").folder == "t/wdc/shoes"
    assert pipeline.Settings(dataset="AB", dirty=True, top="t").folder == "t/ER-Magellan/Textual/Abt-Buy"
    assert entities.selection_path("x", "MFL") == "x/MFL" and entities.selection_path("x", "votek", "m") == "x/votek_m"


def test_pairs_follow_the_file_and_the_black_list(spark, settings):
    rows = pipeline.load_pairs(spark, settings, "train").orderBy("pair_id").collect()
    lines = (open(f"{settings.folder}/train.csv").read().split("\n"))[1:-1]
    want = [(i, int(x.split(",")[2])) for i, x in enumerate(lines) if x.split(",")[0] != "3"]
    assert [(r.pair_id, r.label) for r in rows] == want
    assert all(r.a[0].endswith(", inc") for r in rows)
    assert pipeline.load_pairs(spark, settings, "test").count() == 45


@pytest.mark.parametrize("method", pipeline.METHODS)
def test_all_stages(spark, settings, method):
    s = dataclasses.replace(settings, method=method)
    pipeline.encode(spark, s)
    chosen = pipeline.select(spark, s)
    rows = chosen.orderBy("rank").collect()
    assert 1 < len(rows) <= s.budget and [r.rank for r in rows] == list(range(1, len(rows) + 1))
    assert len({r["index"] for r in rows}) == len(rows) and {r.k for r in rows} == {s.k}
    figures = pipeline.evaluate(spark, s).first()
    assert 0 <= figures.f1 <= 100
    done = entities.read_predictions(spark, s.predictions())
    assert done.count() == 45 and done.where("pred <> cast(prob > 0.5 as int)").count() == 0
    assert pipeline.probability_histogram(spark, s).agg(F.sum("n")).first()[0] == 45


def test_another_order_and_similarity(spark, settings):
    s = dataclasses.replace(settings, work=f"{settings.work}/o1", order="o1", k=2, sim="pairdiff")
    pipeline.encode(spark, s)
    assert pipeline.select(spark, s).count() == s.budget
    assert 0 <= pipeline.evaluate(spark, s).first().f1 <= 100


def test_models_without_a_scorer_are_an_error(spark, settings):
    with pytest.raises(ValueError, match="llama2-7b"):
        pipeline.main(["select", "--model", "llama2-7b", "--top", settings.top, "--work", settings.work])


def test_sweep_reports_missing_results(spark, settings):
    got = pipeline.sweep(spark, [settings, dataclasses.replace(settings, model="other")]).first().asDict()
    assert got["dataset"] == "Fodors-Zagats" and set(got) == {"dataset", "overlap", "other"}


def test_marked_file_vectors_and_logs(spark, tmp_path):
    (tmp_path / "p.tsv").write_text('COL title VAL Red  "Shoe"\tCOL title VAL Shoe\t1\nx\ty\t0\n')
    rows = entities.marked_pairs(spark, str(tmp_path / "p.tsv")).orderBy("pair_id").collect()
    assert [(r.pair_id, r.textA, r.label) for r in rows] == [(0, 'COL title VAL Red  "Shoe"', 1), (1, "x", 0)]
    (tmp_path / "v.txt").write_text("1.0 2e0\n -3 4\n")
    assert [r.vec for r in entities.text_vectors(spark, str(tmp_path / "v.txt")).orderBy("pair_id").collect()] == [[1.0, 2.0], [-3.0, 4.0]]
    (tmp_path / "l.log").write_text("index: 7\nother\nPrecision 3\n")
    assert [r.found for r in entities.read_log(spark, str(tmp_path / "l.log"), r"index: (\d+)").collect()] == ["7"]
    assert entities.is_complete(spark, str(tmp_path / "l.log")) and not entities.is_complete(spark, str(tmp_path / "none"))
    assert entities.black_list(spark, str(tmp_path / "none")).count() == 0


def test_key_attributes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,title,modelno,price\n5,a,b,1.5\n2,c,,\n")
    got = entities.entity_table(spark, str(tmp_path / "a.csv"), ["title", "modelno", "price"], ["price"], "Walmart-Amazon")
    assert got.columns == ["id", "title", "modelno"] and {r.id for r in got.collect()} == {5, 2}


def test_streamed_scores_equal_the_batch(spark, tmp_path):
    rows = [(i, f"x\nProduct A\tred {i % 3}\nProduct B\tred {i % 2}\nsame?", i % 2, f"2024-01-01 00:{i:02d}:00") for i in range(30)]
    df = spark.createDataFrame(rows, "test_id long, prompt string, label int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    query = streaming.score_stream(streaming.prompt_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    from matchloom.operators import scoring

    want = scoring.scored(df, scoring.OverlapScorer)
    assert sorted((r.test_id, r.prob) for r in got.collect()) == sorted((r.test_id, r.prob) for r in want.collect())
    assert streaming.windowed_figures(got).agg(F.sum("n")).first()[0] == 30
