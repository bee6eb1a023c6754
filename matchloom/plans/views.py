"""Derived views of the driver's tables that stand for the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchloom.functions import scores
from matchloom.sources.shared import table

PART_COLUMNS = ("name", "brand", "type", "size")


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, score, vec, other): each vector and the next; a match if their labels agree."""
    e = embeddings(spark, d)
    n = e.count()
    b = e.select(F.col("id").alias("b_id"), F.col("vec").alias("other"), F.col("label").alias("b_label"))
    joined = e.join(b, F.col("b_id") == F.pmod(F.col("id") + 1, F.lit(n)))
    return joined.select("id", (F.col("label") == F.col("b_label")).cast("int").alias("label"), F.round(scores.dot(F.col("vec"), F.col("other")), 9).alias("score"), "vec", "other")


def probs(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, score, prob)"""
    return pairs(spark, d).select("id", "label", "score", ((1 + F.col("score")) / 2).alias("prob"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """(label, prob, weight) of labels: quality is the truth, toxic the prediction."""
    return table(spark, d, "labels").select(F.col("quality").alias("label"), F.col("toxic").cast("double").alias("prob"), (1 + F.col("doc_id") % 3).alias("weight"))


def part_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, a_name, ..., b_size): each part and the next; one brand and one size are missing."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.nullif("p_brand", F.lit("Brand#11")).alias("brand"), F.col("p_type").alias("type"), F.nullif("p_size", F.lit(7)).alias("size"))
    a = p.select(F.col("id").alias("pair_id"), *[F.col(c).alias(f"a_{c}") for c in PART_COLUMNS])
    b = p.select((F.col("id") - 1).alias("pair_id"), *[F.col(c).alias(f"b_{c}") for c in PART_COLUMNS])
    return a.join(b, "pair_id")


#: The same views as SQL common table expressions.
SQL = {
    "pairs": """pairs AS (
  SELECT a.vec_id AS id, (a.label = b.label)::INTEGER AS label, a.embedding::DOUBLE[] AS vec, b.embedding::DOUBLE[] AS other,
         round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
  FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)),
probs AS (SELECT id, label, score, (1 + score) / 2 AS prob FROM pairs)""",
    "labelled": "labelled AS (SELECT quality AS label, toxic::DOUBLE AS prob, 1 + doc_id % 3 AS weight FROM labels)",
    "parts": """p AS (SELECT p_partkey AS id, p_name AS name, nullif(p_brand, 'Brand#11') AS brand, p_type AS type, nullif(p_size, 7)::VARCHAR AS size FROM part),
part_pairs AS (
  SELECT a.id AS pair_id, a.name AS a_name, a.brand AS a_brand, a.type AS a_type, a.size AS a_size,
         b.name AS b_name, b.brand AS b_brand, b.type AS b_type, b.size AS b_size
  FROM p a JOIN p b ON b.id = a.id + 1)""",
    "sims": """vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
unit AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vectors),
sims AS (SELECT a.id AS i, b.id AS j, list_dot_product(a.v, b.v) AS sim FROM unit a CROSS JOIN unit b)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
