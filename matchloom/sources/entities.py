"""Readers and writers of entity tables, pair lists, vectors, selections and predictions.

Blueprint ids: S1-S16, J1-J5, P1, P9, P10, H29. Rows are identified by stored ids, never by their
place in a file; a file whose only identity is its row order gets its ids once, here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

# Attributes that are kept of three data sets.
KEY_ATTRIBUTES = {
    "BeerAdvo-RateBeer": ["Beer_Name", "Brew_Factory_Name"],
    "iTunes-Amazon": ["Song_Name", "Artist_Name", "Album_Name", "Genre", "Price", "Time", "Released"],
    "Walmart-Amazon": ["title", "modelno"],
}
PAIR_SCHEMA = StructType([StructField("ltable_id", LongType()), StructField("rtable_id", LongType()), StructField("label", IntegerType())])
MARKED_SCHEMA = StructType([StructField("textA", StringType()), StructField("textB", StringType()), StructField("label", IntegerType())])
SELECTION_SCHEMA = StructType([StructField("k", IntegerType()), StructField("rank", IntegerType()), StructField("index", LongType()), StructField("label", IntegerType())])
PREDICTION_SCHEMA = StructType([StructField("pair_id", LongType()), StructField("label", IntegerType()), StructField("pred", IntegerType()), StructField("prob", DoubleType())])


def exists(spark: SparkSession, path: str) -> bool:
    """By Hadoop's file system, so that any store will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def entity_table(spark: SparkSession, path: str, attributes: Sequence[str], numeric: Sequence[str] = (), dataset: str | None = None) -> DataFrame:
    """A CSV with a header whose first column is the id; only key attributes where a data set has them."""
    schema = StructType([StructField("id", LongType()), *[StructField(a, DoubleType() if a in numeric else StringType()) for a in attributes]])
    df = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    keep = KEY_ATTRIBUTES.get(dataset or "", list(attributes))
    return df.select("id", *[a for a in attributes if a in keep])


def pair_list(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, ltable_id, rtable_id, label); pair_id follows the order of the file."""
    return with_row_ids(spark.read.schema(PAIR_SCHEMA).option("header", True).csv(path), "pair_id")


def marked_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file without header, two marked titles and a label."""
    return with_row_ids(spark.read.schema(MARKED_SCHEMA).option("sep", "\t").option("header", False).option("quote", "").csv(path), "pair_id")


def black_list(spark: SparkSession, path: str) -> DataFrame:
    """An empty one where there is no file."""
    schema = StructType([StructField("ltable_id", LongType())])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).csv(path).select(F.col("ltable_id").cast("long"))


def with_row_ids(df: DataFrame, name: str) -> DataFrame:
    """0-based ids in the order of the rows as read; partitions' offsets come from their counts."""
    indexed = df.rdd.zipWithIndex().map(lambda r: (r[1], *r[0]))  # file order is imperative by nature
    return df.sparkSession.createDataFrame(indexed, StructType([StructField(name, LongType()), *df.schema.fields]))


def assemble(pairs: DataFrame, a: DataFrame, b: DataFrame, black: DataFrame | None = None) -> DataFrame:
    """Pairs with both records' attributes, as a_<name> and b_<name>; black-listed left ids go first."""
    kept = pairs.join(black, "ltable_id", "left_anti") if black is not None else pairs
    left = a.select(F.col("id").alias("ltable_id"), *[F.col(c).alias(f"a_{c}") for c in a.columns if c != "id"])
    right = b.select(F.col("id").alias("rtable_id"), *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "id"])
    return kept.join(left, "ltable_id").join(right, "rtable_id")


def text_vectors(spark: SparkSession, path: str, id_col: str = "pair_id") -> DataFrame:
    """White-space separated numbers, one vector a line, in the order of the pairs."""
    lines = with_row_ids(spark.read.text(path), id_col)
    return lines.select(id_col, F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("vec"))


def write_vectors(df: DataFrame, path: str) -> None:
    """S7"""
    df.write.mode("overwrite").parquet(path)


def with_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """J4, by id; a pair without a vector is an error of the input and is dropped by the inner join."""
    return pairs.join(vectors, "pair_id")


def selection_path(top: str, method: str, model: str | None = None) -> str:
    """One rule for the name of a selection (Q9)."""
    return f"{top}/{method}" + (f"_{model}" if model else "")


def write_selection(chosen: DataFrame, pairs: DataFrame, k: int, path: str) -> None:
    """Chosen: (rank, id); k is the number asked for (Q3)."""
    rows = chosen.select("rank", "id").join(pairs.select(F.col("pair_id").alias("id"), "label"), "id").select(F.lit(k).alias("k"), "rank", F.col("id").alias("index"), "label")
    rows.orderBy("rank").coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a label budget long


def read_selection(spark: SparkSession, path: str, k: int | None = None, budget: int | None = None) -> DataFrame:
    """All rows, those of one k, or the first ``budget`` by rank."""
    df = spark.read.schema(SELECTION_SCHEMA).option("header", True).csv(path)
    df = df.where(F.col("k") == k) if k is not None else df
    return df.where(F.col("rank") <= budget) if budget is not None else df


def append_selection(old: DataFrame, new: DataFrame) -> DataFrame:
    """U1"""
    return old.unionByName(new)


def demonstrations(selection: DataFrame, pairs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """The selected pairs in their order, with vectors where given."""
    out = selection.select("rank", F.col("index").alias("pair_id")).join(pairs, "pair_id")
    return out.join(vectors, "pair_id") if vectors is not None else out


def write_predictions(df: DataFrame, path: str) -> None:
    """S10, D15"""
    df.select("pair_id", "label", "pred", "prob").write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """S11"""
    return spark.read.schema(PREDICTION_SCHEMA).option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(line, found): lines of a text log that match, and the pattern's first group."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines.where(F.col("line").rlike(pattern)).select("line", F.regexp_extract("line", pattern, 1).alias("found"))


def is_complete(spark: SparkSession, path: str, word: str = "Precision") -> bool:
    """S14"""
    return exists(spark, path) and not spark.read.text(path).where(F.col("value").contains(word)).isEmpty()
