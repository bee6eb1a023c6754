"""Few-shot retrieval and prompts. Blueprint ids: J7, V7, W3, R2-R6, H27, H30."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchloom.functions import scores

# Prompt parts, with {item} for the noun; example patterns by numbers of matches and non-matches.
QUESTIONS = {
    "q1": "Do {item} A and {item} B refer to the same entity?",
    "q2": "Are {item} A and {item} B the same?",
    "q3": "Do these two {item}s refer to the same entity?",
    "q4": "Are these two {item}s the same?",
}
TASKS = {
    "t1": "The task is to identify whether the two {item}s refer to the same entity based on the attribute values.\n\n",
    "t2": "The task is to identify whether the two {item}s refer to the same entity.\n\n",
    "t3": "This is an entity matching task.\n\n",
}
PATTERNS = {
    (1, 1): [[1, 0], [0, 1]],
    (2, 2): [[0, 1, 1, 0], [1, 0, 0, 1]],
    (3, 3): [[0, 1, 0, 1, 1, 0], [1, 0, 1, 0, 0, 1]],
    (2, 4): [[0, 1, 0, 1, 0, 0], [0, 0, 1, 0, 1, 0], [0, 0, 0, 1, 1, 0]],
    (4, 4): [[1, 0, 0, 1, 0, 1, 1, 0], [0, 1, 1, 0, 1, 0, 0, 1]],
    (3, 5): [[0, 0, 1, 0, 0, 1, 0, 1], [0, 0, 0, 1, 1, 0, 0, 1], [0, 0, 1, 1, 0, 0, 1, 0]],
    (5, 5): [[0, 1, 1, 0, 0, 1, 0, 1, 1, 0], [1, 0, 0, 1, 1, 0, 1, 0, 0, 1]],
    (4, 6): [[1, 0, 0, 0, 1, 0, 0, 1, 1, 0], [0, 1, 0, 0, 1, 0, 1, 0, 0, 1], [1, 1, 0, 0, 0, 1, 0, 0, 1, 0]],
}


def part(table: dict[str, str], key: str | None, item: str) -> str:
    """A prompt part; nothing for an unknown key."""
    return table.get(key or "", "").replace("{item}", item)


def balanced(tests: DataFrame, examples: DataFrame, k: int, digits: int = 9, most_broadcast: int = 100_000) -> DataFrame:
    """R2: (test_id, example_id, label, sim, rn): for each test its nearest k examples, half of each class.

    Surplus of one class fills what the other lacks. tests: (test_id, vec); examples: (example_id, vec,
    label), the selected demonstrations, as many as the label budget allows; they are broadcast as one array after
    a check of their number, and ranked row by row, without a shuffle. rn ranks by similarity within test and label.
    """
    n, pos = examples.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n > most_broadcast:
        raise ValueError(f"{n} examples; demonstrations are limited to {most_broadcast}")
    k = min(k, n)
    half = k // 2
    keep_pos, keep_neg = max(half, k - (n - pos)), max(k - half, k - pos)
    held = examples.agg(F.collect_list(F.struct("example_id", "label", "vec")).alias("_examples"))
    rows = tests.crossJoin(F.broadcast(held))  # one row on the right

    def best(label: int, keep: int) -> Column:
        mine = F.filter("_examples", lambda e: e["label"] == label)
        near = F.transform(mine, lambda e: F.struct((-F.round(scores.dot(F.col("vec"), e["vec"]), digits)).alias("far"), e["example_id"].alias("example_id"), e["label"].alias("label")))
        first = F.slice(F.array_sort(near), 1, keep)
        return F.transform(first, lambda e, i: F.struct(e["example_id"].alias("example_id"), e["label"].alias("label"), (-e["far"]).alias("sim"), (i + 1).alias("rn")))

    found = rows.select("test_id", F.explode(F.concat(best(1, keep_pos), best(0, keep_neg))).alias("e"))
    return found.select("test_id", "e.example_id", "e.label", "e.sim", "e.rn")


def ordering(order: str, seed: int = 0) -> list[Column] | None:
    """R3a, R3d, R3e: sort keys of a test's examples; any other order, o4 too (R3c), is an error."""
    least_first = [F.asc("sim"), F.desc("example_id")]
    table = {
        "o1": [F.asc("place"), F.desc("label")],
        "o2": [F.asc("place"), F.asc("label")],
        "o5": [F.asc(F.xxhash64(F.lit(seed), "test_id", "example_id")), F.asc("example_id")],
        "o6": least_first,
        "o7": [F.desc("sim"), F.asc("example_id")],
    }
    if order not in table:
        raise ValueError(f"unknown order {order!r}")
    return table[order]


def ordered(retrieved: DataFrame, order: str, seed: int = 0, variant: int = 0) -> DataFrame:
    """(test_id, example_id, label, sim, pos): examples in prompt order.

    o1, o2 alternate the classes, least similar first, and drop the surplus of one class; o3 follows the variant-th
    pattern for a test's numbers of matches and non-matches, and fails where there is none; o5 shuffles by a hash;
    o6 puts the most similar last, o7 first.
    """
    by_class = Window.partitionBy("test_id", "label").orderBy(F.asc("sim"), F.desc("example_id"))
    placed = retrieved.withColumn("place", F.row_number().over(by_class))
    both = Window.partitionBy("test_id")
    count = lambda y: F.sum(F.when(F.col("label") == y, 1).otherwise(0)).over(both)
    if order == "o3":
        turns = [(p, n, y, list(x[variant][: k + 1]).count(y), k + 1) for (p, n), x in PATTERNS.items() if variant < len(x) for k, y in enumerate(x[variant])]
        want = retrieved.sparkSession.createDataFrame(turns, "matches long, others long, label int, place int, pos int")  # a row for each place of the patterns
        counted = placed.withColumn("matches", count(1)).withColumn("others", count(0))
        found = counted.join(F.broadcast(want), ["matches", "others", "label", "place"], "left")
        missing = F.format_string("no pattern for %d matches and %d non-matches", "matches", "others")
        return found.select("test_id", "example_id", "label", "sim", F.coalesce("pos", F.raise_error(missing).cast("int")).alias("pos"))
    if order in ("o1", "o2"):
        placed = placed.withColumn("least", F.least(count(1), count(0))).where(F.col("place") <= F.col("least"))
    at = Window.partitionBy("test_id").orderBy(*ordering(order, seed))
    return placed.select("test_id", "example_id", "label", "sim", F.row_number().over(at).alias("pos"))


def example_text(text: Column, label: Column, question: str) -> Column:
    return F.concat(text, F.lit(f"\n{question} "), F.when(label == 1, "Yes.").otherwise("No."))


def _prompt(head: Column, block: Column, text: Column, ask: str) -> Column:
    shown = F.when(F.coalesce(block, F.lit("")) != "", F.concat(block, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(head, shown, text, F.lit(f"\n{ask}"))


def prompts(tests: DataFrame, examples: DataFrame, placed: DataFrame, item: str = "Product", task: str = "t3", question: str = "q2") -> DataFrame:
    """(test_id, prompt): task, the test's examples in their order, and the test with the question.

    tests: (test_id, text); examples: (example_id, text, label); placed: from ``ordered``. A test without
    examples gets a zero-shot prompt.
    """
    ask = part(QUESTIONS, question, item)
    shown = examples.select("example_id", example_text(F.col("text"), F.col("label"), ask).alias("shown"))
    lines = placed.select("test_id", "example_id", "pos").join(F.broadcast(shown), "example_id")  # a label budget long
    block = lines.groupBy("test_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda s: s["shown"]), "\n\n").alias("block"))
    return tests.join(block, "test_id", "left").select("test_id", _prompt(F.lit(part(TASKS, task, item)), F.col("block"), F.col("text"), ask).alias("prompt"))


def in_turn(examples: DataFrame, group: str, rank: str, order: str, seed: int = 0, variant: int = 0) -> DataFrame:
    """``examples`` with ``pos``: the prompt order within a group, where earlier ranks count as more similar; ranks are unique there."""
    as_found = examples.select(F.col(group).alias("test_id"), F.col(rank).cast("long").alias("example_id"), "label", (-F.col(rank)).cast("double").alias("sim"))
    placed = ordered(as_found, order, seed, variant).select(F.col("test_id").alias("_g"), F.col("example_id").alias("_r"), "pos")
    return examples.join(placed, (F.col(group) == F.col("_g")) & (F.col(rank) == F.col("_r"))).drop("_g", "_r")


def shared_prompts(tests: DataFrame, examples: DataFrame, order_col: str = "rank", item: str = "Product", task: str = "t3", question: str = "q2", k: int = 0, order: str = "o7", seed: int = 0, variant: int = 0) -> DataFrame:
    """With as many shots as examples, all tests share one block of them. R6: fewer than ``k`` is an error.

    The block is in ``order``, as for retrieved examples, with those selected first as the most similar.
    """
    if k and examples.count() < k:
        raise ValueError(f"fewer than {k} examples")
    ask = part(QUESTIONS, question, item)
    placed = in_turn(examples.withColumn("_all", F.lit(0)), "_all", order_col, order, seed, variant)
    block = placed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("o"), example_text(F.col("text"), F.col("label"), ask).alias("shown")))), lambda s: s["shown"]), "\n\n").alias("block"))
    return tests.crossJoin(F.broadcast(block)).select("test_id", _prompt(F.lit(part(TASKS, task, item)), F.col("block"), F.col("text"), ask).alias("prompt"))


def prefixed_prompts(tests: DataFrame, prefix: str, item: str = "Product", question: str = "q2") -> DataFrame:
    """A prefix written by hand (a string, Q14) in place of task and examples."""
    ask = part(QUESTIONS, question, item)
    return tests.select("test_id", F.concat(F.lit(f"{prefix}\n"), F.col("text"), F.lit(f"\n{ask}")).alias("prompt"))
