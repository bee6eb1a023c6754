import math
import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions import scores, text


def one(spark, column, **values):
    names = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    df = spark.createDataFrame([tuple(v for _, v in values.values()) or (0,)], names)
    return df.select(column.alias("r")).first()["r"]


COLUMNS = ["title", "brand", "price"]
A = ["red  shoe 42", None, "9.5"]
B = ["shoe, red", "acme", None]
WANT = {
    "s1": 'Product A is "title: red  shoe 42, brand: NULL, price: 9.5". Product B is "title: shoe, red, brand: acme, price: NULL". ',
    "s2": 'Product A is "red  shoe 42, NULL, 9.5". Product B is "shoe, red, acme, NULL". ',
    "s3": "For Product A, its title is red  shoe 42, its brand is missing, its price is 9.5. For Product B, its title is shoe, red, its brand is acme, its price is missing. ",
    "s4": "For Product A and Product B, their title are red  shoe 42 and shoe, red, their brand are missing and acme, their price are 9.5 and missing. ",
    "s5": "Entry\tProduct A\tProduct B\ntitle\tred  shoe 42\tshoe, red\nbrand\tNULL\tacme\nprice\t9.5\tNULL",
    "s6": "Entry\ttitle\tbrand\tprice\nProduct A\tred  shoe 42\tNULL\t9.5\nProduct B\tshoe, red\tacme\tNULL",
    "s7": 'Product A is "title: red  shoe 42, price: 9.5". Product B is "title: shoe, red, brand: acme". ',
    "s8": 'Product A is "red  shoe 42, 9.5". Product B is "shoe, red, acme". ',
    "s9": 'Product A is "title: red  shoe 42". Product B is "title: shoe, red". ',
    "s10": 'Product A is "red  shoe 42". Product B is "shoe, red". ',
    "s11": "Product A\tred  shoe 42\tNULL\t9.5\nProduct B\tshoe, red\tacme\tNULL",
}


@pytest.mark.parametrize("style", sorted(WANT))
def test_styles(spark, style):
    form = text.PairFormat(COLUMNS, F.col("a"), F.col("b"), numeric=("price",))
    assert one(spark, form.write(style), a=("array<string>", A), b=("array<string>", B)) == WANT[style]


def test_unknown_style(spark):
    with pytest.raises(ValueError):
        text.PairFormat(COLUMNS, F.col("a"), F.col("b")).write("s12")


@pytest.mark.parametrize(
    "value,numeric,want",
    [(None, False, "NULL"), ("nan", False, "NULL"), ("", False, ""), ("0", False, "0"), ("0", True, "NULL"), ("0.0", True, "NULL"), ("x", True, "x"), (" ".join(["w"] * 100) + ". b", False, " ".join(["w"] * 100)[:-1] + "w"), (" ".join(["w"] * 99) + ". b", False, " ".join(["w"] * 99) + ". b"), ("w " * 101, False, "w " * 101), ("a " * 100 + "a. b", False, "a " * 100 + "a")],
)
def test_present(spark, value, numeric, want):
    got = one(spark, text.present(F.col("v"), numeric=numeric), v=("string", value))
    assert got == want


def test_empty_as_null_and_title(spark):
    assert one(spark, text.present(F.col("v"), empty_as_null=True), v=("string", "")) == "NULL"
    assert one(spark, text.clean_marked_title(F.col("v")), v=("string", "COL title VAL  Red   Shoe COL title VAL 42 ")) == ["Red Shoe 42"]


def test_encoder_text(spark):
    a = text.encoder_text(COLUMNS, F.col("a"))
    assert one(spark, a, a=("array<string>", A)) == "title: red  shoe 42, brand: nan, price: 9.5"
    assert one(spark, text.encoder_text(COLUMNS, F.col("a"), ["price"]), a=("array<string>", A)) == "price: 9.5"


@pytest.mark.parametrize("answer,want", [("Yes.", 1), ("no", 0), (" NO, yes", 0), ("yes and no", 1), ("maybe", 1), ("I do not know", 0), ("now", 0)])
def test_answers(spark, answer, want):
    assert one(spark, scores.answer_class(F.col("a")), a=("string", answer)) == want


@pytest.mark.parametrize("answer,want", [("So, therefore, the answer is no.", 0), ("Therefore, the answer is yes", 1), ("same same different", 1), ("different different same", 0), ("", 1)])
def test_reasoned_answers(spark, answer, want):
    assert one(spark, scores.reasoned_class(F.col("a")), a=("string", answer)) == want


def test_token_probability(spark):
    def share(m):
        return one(spark, scores.token_probability(F.col("m")), m=("map<string,double>", m))

    assert share({"Yes": 2.0, "yes!": 1.0, "No": 1.0, "x": 9.0}) == pytest.approx(math.e / (1 + math.e))
    assert share({"know": 3.0, "yes": 3.0}) == pytest.approx(0.5)
    assert share({"yes": 1.0}) is None and share({"no": 1.0}) is None
    assert share({"yesno": 2.0, "no": 1.0}) == pytest.approx(math.e / (1 + math.e))


def test_probability_functions(spark):
    p = F.col("p")
    at = lambda c, v: one(spark, c, p=("double", v))
    assert [at(scores.to_class(p), v) for v in (0.5, 0.51)] == [0, 1]
    assert at(scores.clip(p), 0.0) == 1e-6 and at(scores.clip(p), 1.0) == 1 - 1e-6
    assert at(scores.entropy(p), 0.5) == pytest.approx(math.log(2))
    x, y = 0.8 / 0.3, 0.2 / 0.7
    assert at(scores.calibrated(p, F.lit(0.3)), 0.8) == pytest.approx(math.exp(x) / (math.exp(x) + math.exp(y)))
    assert at(scores.recency_weight(p, F.lit(0), 2), 0.8) == pytest.approx(0.2)
    assert one(spark, scores.api_cost(F.lit(1000), F.lit(500), 0.03, 0.06)) == pytest.approx(0.06)
    assert [tuple(one(spark, scores.completion_class(F.lit(t)))) for t in ("Yes", "no", "yes no", "?")] == [(1.0, 1), (0.0, 0), (0.5, 1), (0.5, 1)]


def test_vector_functions(spark):
    rng = random.Random(0)
    a, b = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(2)]
    at = lambda c: one(spark, c, a=("array<double>", a), b=("array<double>", b))
    dot = sum(x * y for x, y in zip(a, b))
    assert at(scores.dot(F.col("a"), F.col("b"))) == pytest.approx(dot)
    assert at(scores.cosine(F.col("a"), F.col("b"))) == pytest.approx(dot / math.hypot(*a) / math.hypot(*b))
    assert at(scores.l1(F.col("a"), F.col("b"))) == pytest.approx(sum(abs(x - y) for x, y in zip(a, b)))
    assert at(scores.l2(F.col("a"), F.col("b"))) == pytest.approx(math.dist(a, b))
    assert at(scores.norm(scores.unit(F.col("a")))) == pytest.approx(1)
