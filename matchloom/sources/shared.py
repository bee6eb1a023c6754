"""Tables of a folder, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder, and executors don't share this machine's own")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="matchloom-checkpoints-"))
    return sc.getCheckpointDir().rstrip("/")


#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, compression: str | None = None, clean: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there from now on.

    A written table has the size of its files, by which Spark chooses joins. A checkpoint would keep the
    estimates of its plan: sizes of joins multiply, and the numbers grow exponentially with the steps of a loop.
    With ``clean``, what was shuffled for the table is deleted once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    try:
        if clean:
            spark.conf.set(CLEAN, "true")
        df.write.parquet(path, compression=compression)
    finally:
        if clean:
            spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)
