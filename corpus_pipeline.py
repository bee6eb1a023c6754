"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``. Every stage takes nulls in any
column, empty and very long texts, repeated rows, empty tables and further columns, whatever their names; each
states what it makes of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchloom.llm import langid, mixing, neardup, packing, pii, simhash
from matchloom.llm._common import fresh, shared_dir
from matchloom.llm.catalogue import CAPACITY, gpt_tokens


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from every labelled document; documents that are rejected go, the others get the language found.

    Null and letterless texts are rejected; rows with a null language teach nothing; of centroids equally near the first
    wins; repeated rows are judged alike; a very long text is read whole, piece by piece.
    """
    (name,) = fresh(docs, "language")
    found = langid.annotate(docs, langid.fit(docs), out=name)
    return found.where(~F.col(f"{name}.rejected")).withColumn("lang", F.col(f"{name}.lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles with a similarity of 0.8 or more.

    The one with the least id stays, then with the least hash of its text; an id that comes with several texts is a document for
    each; null and blank texts are one group; rows with a null id all stay.
    """
    return simhash.representatives(docs, neardup.similar(docs)).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text.

    A null text stays null, with n_chars null; of spans that overlap the first names the run; repeated rows are treated alike.
    """
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is one of its own; documents without words have size 0 and go with their hash; rows with the same id and
    text, and ties of the hash, are taken or left together.
    """
    return mixing.mixed_documents(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their token ids.

    A null or empty text is its closing id alone; a text over a window is cut; repeated rows are packed each.
    """
    return packing.pack(docs, gpt_tokens(), CAPACITY)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages fit classifiers and link fingerprints, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is kept in the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
