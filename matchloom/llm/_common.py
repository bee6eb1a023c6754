"""Helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from matchloom.sources.shared import cut, shared_dir, table

__all__ = ["cached", "cut", "fresh", "shared_dir", "small_batches", "table", "trim"]


def small_batches(df: DataFrame, rows: int = 256, size: str = "2m") -> DataFrame:
    """``df``, with Arrow batches kept small from now on in its session: they hold whole texts."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def trim() -> None:
    """Give the memory that a Python worker has freed back to the system, before it waits for its next task."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def cached(key: str, make):
    """make() once for each Python process; functions sent to executors have no module to keep it in."""
    import sys

    store = sys.__dict__.setdefault("_matchloom_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name, one that clashes with no column of ``df`` (any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
