"""Scoring a stream of prompts: an extension, as the engine's own inputs are tables.

Prompts arrive as files; each is scored once by the same scorer interface as in batch, and figures are kept by
windows of event time with a watermark for late rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from matchloom.operators import metrics, scoring

SCHEMA = "test_id long, prompt string, label int, ts timestamp"


def prompt_stream(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def score_stream(prompts: DataFrame, out: str, checkpoint: str, make: Callable[[], scoring.Scorer] = scoring.OverlapScorer) -> StreamingQuery:
    """Scored rows appended to ``out``; the checkpoint makes it exactly once over restarts."""
    return scoring.scored(prompts, make).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_figures(scored: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Precision, recall and F1 by window of event time."""
    return scored.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count("*").alias("n"), *metrics.precision_recall_f1(F.col("label"), F.col("pred")))
