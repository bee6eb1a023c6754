"""Mixing sources to target weights by hash-threshold histograms.

Sources, in code-point order with null last, get the weights in turn and share ``share`` of all words; a
target stops at ``most`` times its source's size, and the excess is shared again by weight until
none is above. A source takes whole copies of itself as long as they fit its target; what is
left is a budget for one partial copy: the documents whose hash is up to a threshold.

Thresholds are found without sorting documents. Words are summed by source and hash bucket, running
sums over the buckets find the one in which each budget ends, and only the documents of these boundary
buckets are summed again by the next bits of the hash, until a boundary holds one document.
Budgets of one source are nested: a larger one takes all that a smaller one takes. A hot source is
summed before it is shuffled, and meets its threshold in a broadcast table of sources (a plain
join if there are over ``most_broadcast`` sources).

Defined results: a null text has size 0; a null source is a source of its own; sources without
words have target 0; rows with the same id and text are taken or left together, and with
ties in the hash too; an empty table gives no rows. Everything is DataFrame functions, with no Python on executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchloom.llm._common import cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
STEP_BITS = 12


def words(text: Column) -> Column:
    """Words of a text: each becomes one letter and white space goes, which takes no array of words."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "w"), " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def document_hash(key: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id and the text."""
    both = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size, target) of a table (source, size).

    A target is the lesser of the cap and weight times a common level. In the order of cap / weight, the
    level follows from the first source that it leaves below its cap. The windows without a
    partition run over one row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = by_source.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    total = total if share == 1.0 else total * F.lit(float(share))
    levels = weighed.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(onward)).withColumn("place", F.row_number().over(order))
    fits = F.col("level") * F.col("w") <= F.col("cap")
    settled = levels.withColumn("first", F.min(F.when(fits, F.col("place"))).over(everything))
    level = F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(everything)
    out = settled.withColumn("water", level)
    return out.select("source", "source_size", F.when(F.col("place") < F.col("first"), F.col("cap").cast("double")).otherwise(F.coalesce(F.col("water") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def hash_thresholds(sizes: DataFrame, budgets: DataFrame, small: bool = True) -> DataFrame:
    """(source, budget, upto): documents with hash <= upto take about ``budget`` words.

    sizes: (source, hash, size); budgets: (source, budget), any number for each source. The document
    at the boundary is taken if that brings the sum nearer. ``small``: budgets may be broadcast.
    """
    hint = F.broadcast if small else (lambda d: d)
    found = None
    open_ = budgets.select(F.col("source").alias("s"), "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    for used in range(0, HASH_BITS, STEP_BITS):
        left = HASH_BITS - used - STEP_BITS
        here = sizes.withColumn("_p", F.shiftright("hash", HASH_BITS - used) if used else F.lit(0).cast("long"))
        if not used:  # every budget of a source shares the first histogram
            hist = sizes.groupBy("source", F.shiftright("hash", left).alias("bucket")).agg(F.sum("size").alias("tokens"), F.count("*").alias("n"), F.max("hash").alias("last"), F.min("hash").alias("first"))
            hist = hist.join(hint(open_), F.col("source").eqNullSafe(F.col("s")))
        else:
            inner = here.join(hint(open_), F.col("source").eqNullSafe(F.col("s")) & (F.col("_p") == F.col("prefix")))
            hist = inner.groupBy("s", "budget", "base", F.shiftright("hash", left).alias("bucket")).agg(F.sum("size").alias("tokens"), F.count("*").alias("n"), F.max("hash").alias("last"), F.min("hash").alias("first"))
        run = Window.partitionBy("s", "budget").orderBy("bucket")  # at most 2 ** STEP_BITS rows
        summed = hist.withColumn("end", F.col("base") + F.sum("tokens").over(run)).withColumn("low", F.col("end") - F.col("tokens"))
        over = summed.where(F.col("end") > F.col("budget")).groupBy("s", "budget").agg(F.min_by(F.struct("bucket", "tokens", "n", "low", "first", "last"), "bucket").alias("b"))
        edge = cut(over.select("s", "budget", "b.*"))
        done = edge.where("first = last")
        nearer = 2 * (F.col("budget") - F.col("low")) > F.col("tokens")
        done = done.select(F.col("s").alias("source"), "budget", F.when(nearer, F.col("last")).otherwise(F.col("last") - 1).alias("upto"))
        found = done if found is None else found.union(done)
        open_ = edge.where("first < last").select("s", "budget", F.col("bucket").alias("prefix"), F.col("low").alias("base"))
        if not open_.limit(1).count():
            break
    return found


def plan(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: int = 3, most_broadcast: int = 100_000) -> tuple[DataFrame, bool]:
    """(source, source_size, target, epochs, upto) and whether it may be broadcast.

    A document is taken ``epochs`` times, and once more if its hash is at most ``upto``.
    """
    want = cut(targets(sizes, weights, share, most))
    small = want.count() <= most_broadcast
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("long")
    want = want.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    edges = hash_thresholds(sizes, want.select("source", "budget"), small)
    edges = edges.select(F.col("source").alias("s"), F.col("budget").alias("b"), "upto")
    both = want.join(F.broadcast(edges) if small else edges, F.col("source").eqNullSafe(F.col("s")) & (F.col("budget") == F.col("b")), "left")
    # without a boundary there are no words to share out
    return both.select("source", "source_size", "target", "epochs", F.coalesce("upto", F.lit(-1)).alias("upto")), small


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col).cast("string")).alias("size"), document_hash(F.col(id_col), F.col(text_col)).alias("hash"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row; taken counts repeats."""
    sizes = cut(document_sizes(docs, id_col, text_col, source_col))
    how, small = plan(sizes, weights, share, most)
    how = how.withColumnRenamed("source", "s")
    joined = sizes.join(F.broadcast(how) if small else how, F.col("source").eqNullSafe(F.col("s")))
    copies = F.col("epochs") + (F.col("hash") <= F.col("upto")).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    how, small = plan(cut(document_sizes(docs, id_col, text_col, source_col)), weights, share, most)
    s, epochs, upto, copies = fresh(docs, "s", "epochs", "upto", "copies")
    how = how.select(F.col("source").alias(s), F.col("epochs").alias(epochs), F.col("upto").alias(upto))
    joined = docs.join(F.broadcast(how) if small else how, docs[source_col].cast("string").eqNullSafe(F.col(s)))
    times = (F.col(epochs) + (document_hash(docs[id_col], docs[text_col]) <= F.col(upto)).cast("long")).cast("int")
    return joined.withColumn(copies, F.explode(F.array_repeat(F.lit(1), times))).select(*[docs[c] for c in docs.columns])
