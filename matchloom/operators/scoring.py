"""Scoring prompts with a model behind a small interface. Blueprint ids: M1-M9, H28, A21, V8.

A scorer gets a list of prompts and returns as many probabilities; it is made once in each Python worker by a
factory that travels with the task. No model ships with the engine: ``OverlapScorer`` is a
deterministic stand-in, for tests and dry runs.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from matchloom.functions.scores import api_cost, reasoned_class


class Scorer(Protocol):
    def score(self, prompts: Sequence[str]) -> list[float]: ...


class Encoder(Protocol):
    def encode(self, texts: Sequence[str]) -> list[list[float]]: ...


class OverlapScorer:
    """Share of words that the last two lines before the question have in common."""

    def score(self, prompts: Sequence[str]) -> list[float]:
        out = []
        for p in prompts:
            lines = [x for x in p.strip().split("\n") if x][-3:-1]
            a, b = [set(re.findall(r"\w+", x.lower())) for x in (lines + ["", ""])[:2]]
            out.append(len(a & b) / len(a | b) if a | b else 0.5)
        return out


#: Factories of scorers by model name; ``register`` adds to them.
SCORERS: dict[str, Callable[[], Scorer]] = {"overlap": OverlapScorer}


def register(name: str, make: Callable[[], Scorer]) -> None:
    SCORERS[name] = make


def scorer(name: str) -> Callable[[], Scorer]:
    """M1: the factory for a model; an error where none is registered, never a stand-in under another name."""
    if name not in SCORERS:
        raise ValueError(f"no scorer is registered for model {name!r}")
    return SCORERS[name]


class Retrying:
    """M5: another scorer, asked again after failures, with pauses that double up to a limit."""

    def __init__(self, inner: Scorer, tries: int = 6, least: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> None:
        self.inner, self.tries, self.least, self.most, self.sleep = inner, tries, least, most, sleep

    def score(self, prompts: Sequence[str]) -> list[float]:
        for k in range(self.tries):
            try:
                return self.inner.score(prompts)
            except Exception:
                if k + 1 == self.tries:
                    raise
                self.sleep(min(self.most, self.least * 2**k) * random.uniform(0.5, 1.0))
        return []


def scored(prompts: DataFrame, make: Callable[[], Scorer], text_col: str = "prompt", batch: int = 64, max_chars: int | None = None) -> DataFrame:
    """M2: ``prompts`` with prob and pred; M7: the end of a prompt over ``max_chars`` is kept."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make()
        for s in parts:
            texts = [t[-max_chars:] if max_chars else t for t in s.fillna("")]
            yield pd.Series([p for k in range(0, len(texts), batch) for p in scorer.score(texts[k : k + batch])], dtype="float64")

    return prompts.withColumn("prob", run(F.col(text_col))).withColumn("pred", (F.col("prob") > 0.5).cast("int"))


def encoded(df: DataFrame, make: Callable[[], Encoder], text_col: str, out: str = "vec", batch: int = 512) -> DataFrame:
    """V8: ``df`` with the encoder's vector of a text."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for s in parts:
            texts = list(s.fillna(""))
            yield pd.Series([v for k in range(0, len(texts), batch) for v in encoder.encode(texts[k : k + batch])])

    return df.withColumn(out, run(F.col(text_col)))


class Generator(Protocol):
    def generate(self, prompts: Sequence[str]) -> list[str]: ...


def until(text: str, stops: Sequence[str]) -> str:
    """M4: the text up to and with the first stop phrase."""
    ends = [text.find(s) + len(s) for s in stops if s in text]
    return text[: min(ends)] if ends else text


def reasoned(prompts: DataFrame, make: Callable[[], Generator], text_col: str = "prompt", stops: Sequence[str] = (), batch: int = 16) -> DataFrame:
    """M3: ``prompts`` with the generated answer, each row's own, and the class that it argues for."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generator = make()
        for s in parts:
            texts = list(s.fillna(""))
            yield pd.Series([until(a, stops) for k in range(0, len(texts), batch) for a in generator.generate(texts[k : k + batch])], dtype="object")

    return prompts.withColumn("answer", run(F.col(text_col))).withColumn("pred", reasoned_class(F.col("answer")))


# Full names of models by short names; rates by 1,000 tokens of prompt and answer.
MODELS = {
    "gpt2": "gpt2",
    "gpt3.5": "gpt-3.5-turbo-0301",
    "gpt4": "gpt-4-0314",
    "vicuna": "eachadea/vicuna-13b-1.1",
    "ada": "text-ada-001",
}
RATES = {"gpt-4": (0.03, 0.06), "gpt-3.5": (0.002, 0.002)}
LONG_CONTEXT, CONTEXT = 4096, 2048


def model_name(name: str) -> str:
    """llama2-<size>b and llama2-<size>bf (chat), llama<size>, or a name of MODELS."""
    if name in MODELS:
        return MODELS[name]
    if m := re.fullmatch(r"llama2-(\d+)b(f?)", name):
        return f"llama-2-{m[1]}b-{'chat-' if m[2] else ''}hf"
    if m := re.fullmatch(r"llama(\d+)", name):
        return "huggyllama/llama-65b" if m[1] == "65" else f"decapoda-research/llama-{m[1]}b-hf"
    raise ValueError(f"unknown model {name!r}")


def context_tokens(name: str) -> int:
    """M7"""
    return LONG_CONTEXT if name.startswith("llama2-") else CONTEXT


def cost(model: str, prompt_tokens: Column, answer_tokens: Column) -> Column:
    """By the model's rates; nothing for other models."""
    rates = next((r for k, r in RATES.items() if k in model), (0.0, 0.0))
    return api_cost(prompt_tokens, answer_tokens, *rates)


class HashEncoder:
    """A stand-in encoder: signed hashed words, of length one."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: Sequence[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % self.dim] += 1.0 if h >> 31 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out
