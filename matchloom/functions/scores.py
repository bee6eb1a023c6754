"""Column builders on probabilities, answers and vectors.

Blueprint ids: H16-H25, P4, P5, T11, V4, A21, M6, W5 and H32.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

EDGE = 1e-6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where a lambda uses it for each element."""
    return F.transform(F.array(value), body)[0]


def to_class(prob: Column) -> Column:
    """P5: 1 if over one half."""
    return (prob > 0.5).cast("int")


def clip(prob: Column) -> Column:
    """H23"""
    return F.greatest(F.least(prob, F.lit(1 - EDGE)), F.lit(EDGE))


def confidence(prob: Column) -> Column:
    """Of the likelier class."""
    return F.greatest(prob, 1 - prob)


def entropy(prob: Column) -> Column:
    """H24, in nats; ``prob`` within (0, 1)."""
    return -(prob * F.ln(prob) + (1 - prob) * F.ln(1 - prob))


def softmax2(a: Column, b: Column) -> Column:
    """Share of the first of two scores; shifted by the lesser."""
    low = F.least(a, b)
    return F.exp(a - low) / (F.exp(a - low) + F.exp(b - low))


def calibrated(prob: Column, content_free: Column) -> Column:
    """Probability after division by that of content-free input."""
    return softmax2(prob / content_free, (1 - prob) / (1 - content_free))


def answer_class(answer: Column) -> Column:
    """Of yes and no the earlier counts; only a ``no`` is 0; neither is 1."""
    a = F.trim(F.lower(answer))
    both = a.contains("yes") & a.contains("no")
    return F.when(both, F.instr(a, "yes") < F.instr(a, "no")).otherwise(~a.contains("no")).cast("int")


def reasoned_class(answer: Column) -> Column:
    """After ``therefore, the answer is`` the last word holding ``no`` is 0; else ``different`` against ``same``."""
    a = F.trim(F.lower(answer))
    words = F.split(F.trim(F.regexp_replace(a, r"(?U)\s+", " ")), " ")
    count = lambda w: F.size(F.filter(words, lambda x: x == w))
    return F.when(a.contains("therefore, the answer is"), ~F.element_at(words, -1).contains("no")).otherwise(count("different") <= count("same")).cast("int")


def token_probability(scores: Column) -> Column:
    """Of a map token -> score, the best token with ``yes`` against the best other one with ``no``.

    Null if a class has no token.
    """
    by_score = F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("score"), e["key"].alias("token")))

    def best(entries: Column, word: str, but: Column | None = None) -> Column:
        return F.array_max(F.filter(entries, lambda e: F.lower(e["token"]).contains(word) & (F.lit(True) if but is None else but.isNull() | (e["token"] != but["token"]))))

    def share(yes: Column, no: Column) -> Column:
        return F.when(yes.isNotNull() & no.isNotNull(), softmax2(yes["score"], no["score"]))

    return let(by_score, lambda es: let(best(es, "yes"), lambda yes: let(best(es, "no", yes), lambda no: share(yes, no))))


def completion_class(text: Column) -> Column:
    """M6: (prob, pred) of a completion without scores: yes alone (1, 1), no alone (0, 0), else (0.5, 1)."""
    a = F.lower(text)
    yes, no = a.contains("yes"), a.contains("no")
    return F.when(yes & ~no, F.struct(F.lit(1.0).alias("prob"), F.lit(1).alias("pred"))).when(no & ~yes, F.struct(F.lit(0.0).alias("prob"), F.lit(0).alias("pred"))).otherwise(F.struct(F.lit(0.5).alias("prob"), F.lit(1).alias("pred")))


def api_cost(prompt_tokens: Column, answer_tokens: Column, prompt_rate: float, answer_rate: float, per: int = 1000) -> Column:
    """Rates are for ``per`` tokens (Q13)."""
    return (prompt_tokens * prompt_rate + answer_tokens * answer_rate) / per


def recency_weight(prob: Column, iteration: Column, iterations: Column | int) -> Column:
    """The latest of ``iterations`` counts half, each earlier one half of the next."""
    return prob * F.pow(F.lit(0.5), F.lit(iterations) - iteration if isinstance(iterations, int) else iterations - iteration)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda p, q: p + q)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """H16"""
    return let(norm(v), lambda n: F.transform(doubles(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """V4"""
    return dot(a, b) / (norm(a) * norm(b))


def difference(a: Column, b: Column) -> Column:
    """Absolute differences."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(difference(a, b), F.lit(0.0), lambda p, q: p + q)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(difference(a, b), F.lit(0.0), lambda p, q: p + q * q))
