"""Language identification by nearest centroid.

A text becomes a vector of hashed character 1- to 3-grams of its letters, weighted by TF-IDF and
scaled to length one. Each language is represented by several centroids, found by spherical
k-means on its labelled texts; a text gets the language of its nearest centroid by cosine. A text
that is farther from every centroid than the rejection distance is marked as rejected.

``fit`` reads document frequencies from every labelled text; the centroids are fitted on a
bounded sample, about ``fit_rows`` texts chosen by a hash of their ids, as many for each language.
The model is a few arrays of fixed size. ``predict`` reads every character of every text.

Defined results: a null text or one without letters is ``und`` with score 0 and counts as rejected;
rows with a null language teach nothing; languages compare as exact strings; if nothing can be
learned every text is ``und``, and only those without letters are rejected; repeated rows count as often as they occur; other columns are
carried by ``annotate`` untouched and renamed never.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchloom.llm._common import cached, cut, small_batches, trim

DIM_BITS = 13
DIM = 1 << DIM_BITS
PIECE = 1 << 16  # characters handled at a time
UNKNOWN = "und"
FULL = 512  # grams from which a text's cosine no longer suffers from its length


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray  # (DIM,)
    centroids: np.ndarray  # (n, DIM), rows of length one
    owner: np.ndarray  # (n,) index into languages
    least: np.ndarray  # (languages,) cosine below which a text of FULL grams or more is rejected


def _grams(code: np.ndarray) -> np.ndarray:
    """Hashed 1-, 2- and 3-grams of an array in which 32 stands for any run of other characters."""
    with np.errstate(over="ignore"):
        one = code * np.uint32(2654435761)
        two = (one[:-1] ^ (code[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (code[2:] * np.uint32(668265263))) * np.uint32(374761393)
    shift = np.uint32(32 - DIM_BITS)
    letter = code != 32
    # two white spaces never stand together, so two- and three-grams all hold a letter
    return np.concatenate([one[letter] >> shift, two >> shift, three >> shift])


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return cached("letters", lambda: np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def counts(text: str | None) -> np.ndarray | None:
    """Occurrences of each hashed gram in the whole text; None if it has no letter."""
    if not text:
        return None
    table, total, tail = _letters(), None, np.array([32], np.uint32)
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(table[code], code, np.uint32(32))
        code = np.concatenate([tail, code])
        code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
        if len(code) > 2:
            # grams of the carried tail were counted with the piece before
            found = np.bincount(_grams(code), minlength=DIM)
            if total is not None:
                found -= np.bincount(_grams(tail), minlength=DIM) if len(tail) > 2 else np.bincount(_few(tail), minlength=DIM)
            total = found if total is None else total + found
        elif len(code) == 2 and total is None:
            total = np.bincount(_few(code), minlength=DIM)
        tail = code[-2:]
    if total is not None and tail[-1] != 32:  # as if a space followed
        total = total + np.bincount(_grams(np.append(tail, np.uint32(32))), minlength=DIM) - np.bincount(_few(tail), minlength=DIM)
    return total if total is not None and total.any() else None


def _few(code: np.ndarray) -> np.ndarray:
    """As _grams, for one or two characters."""
    pad = np.concatenate([code, np.zeros(3 - len(code), np.uint32)])
    grams = _grams(pad)
    n = int((pad != 32).sum())
    return np.concatenate([grams[: int((code != 32).sum())], grams[n : n + len(code) - 1]])


def weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def _length_factor(grams: np.ndarray) -> np.ndarray:
    """What a text of so few grams can be expected to reach of a long text's cosine."""
    return np.sqrt(np.minimum(1, grams / FULL))


def _low(x: np.ndarray, grams: np.ndarray, clusters: int, low: float) -> float:
    """A low quantile of cosines with centroids fitted without the text, each set against its length."""
    own = []
    for part in (0, 1):
        held = np.arange(len(x)) % 2 == part
        if held.any() and (~held).any():
            own.append((x[held] @ _cluster(x[~held], clusters).T).max(1) / _length_factor(grams[held]))
    return float(np.quantile(np.concatenate(own), low)) if own else 0.0


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the farthest-first rows."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        to = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[to == i].mean(0) if (to == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fit_rows: int = 2400,
    clusters: int = 4,
    fewest: int = 8,
    slack: float = 0.6,
    low: float = 0.02,
) -> LanguageModel:
    """Learn from the rows of ``docs`` that have a language.

    ``fit_rows`` bounds the expected size of the sample for the centroids, over all languages, but for
    ``fewest`` texts of each language (all, if it has no more); every language is learned. A text is rejected if its
    cosine is below ``slack`` times the ``low`` quantile that held-out texts of the sample have with their own
    language, both in proportion to ``_length_factor``. A language with one text rejects nothing.
    """
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], np.ones(DIM), np.zeros((0, DIM)), np.zeros(0, int), np.zeros(0))
    languages = sorted(sizes)
    each = fit_rows / len(languages)
    # four times the fewest expected, so that a draw leaves hardly any language without
    rates = {lang: min(1.0, max(each, 4 * fewest) / n) for lang, n in sizes.items()}
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    rate = F.element_at(F.from_json(F.lit(json.dumps(rates)), "map<string,double>"), F.col("lang"))
    kept = rows.select("text", F.when(draw < rate, F.col("lang")).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, out = np.zeros(DIM, np.int64), 0, []
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                tf = counts(text.as_py())
                if tf is None:
                    continue
                has = np.flatnonzero(tf)
                df[has] += 1
                n += 1
                if lang.is_valid:
                    out.append((lang.as_py(), has.astype(np.int32).tolist(), tf[has].tolist()))
        full = np.flatnonzero(df)
        out.append((None, [*full.tolist(), DIM], [*df[full].tolist(), n]))
        yield pa.RecordBatch.from_pydict({"lang": pa.array([x[0] for x in out], pa.string()), "dims": pa.array([x[1] for x in out], pa.list_(pa.int32())), "tf": pa.array([x[2] for x in out], pa.list_(pa.int64()))})
        trim()

    found = cut(kept.mapInArrow(run, "lang string, dims array<int>, tf array<long>"))
    spread = found.where("lang IS NULL").select(F.explode(F.arrays_zip("dims", "tf")).alias("x")).groupBy("x.dims").agg(F.sum("x.tf").alias("df")).collect()
    df = np.zeros(DIM + 1)
    for dim, n in spread:
        df[dim] = n
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1
    sample = found.where("lang IS NOT NULL").collect()
    by_language: dict[str, list] = {}
    for r in sample:
        by_language.setdefault(r["lang"], []).append(r)
    centroids, owner, least = [], [], np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = by_language.get(lang, [])
        tf = np.zeros((len(own), DIM), np.float32)
        for row, r in enumerate(own):
            tf[row, r["dims"]] = r["tf"]
        if len(own):
            mine = weigh(tf, idf.astype(np.float32))
            c = _cluster(mine, clusters)
            least[k] = slack * _low(mine, tf.sum(1), clusters, low)
            centroids.append(c)
            owner += [k] * len(c)
    if not centroids:
        return LanguageModel([], idf, np.zeros((0, DIM)), np.zeros(0, int), np.zeros(0))
    return LanguageModel(languages, idf.astype(np.float32), np.concatenate(centroids).astype(np.float32), np.array(owner), least)


def predictor(model: LanguageModel):
    """A pandas UDF: struct(lang_pred, score, rejected) of a text."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            for at in range(0, len(texts), 64):
                tf = [counts(t) for t in texts.iloc[at : at + 64]]
                known = [k for k, v in enumerate(tf) if v is not None]
                lang, score, rejected = [UNKNOWN] * len(tf), np.zeros(len(tf)), np.ones(len(tf), bool)
                if known and not len(model.centroids):
                    rejected[known] = False
                elif known:
                    cos = weigh(np.stack([tf[k] for k in known]).astype(np.float32), model.idf) @ model.centroids.T
                    best = cos.argmax(1)
                    top = cos[np.arange(len(known)), best].astype(float)
                    for k, b in zip(known, best):
                        lang[k] = model.languages[model.owner[b]]
                    score[known] = np.clip(top, 0, 1)
                    rejected[known] = top < model.least[model.owner[best]] * _length_factor(np.array([tf[k].sum() for k in known]))
                out.append(pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected}))
            yield pd.concat(out) if out else pd.DataFrame({"lang_pred": pd.Series([], dtype=str), "score": pd.Series([], dtype=float), "rejected": pd.Series([], dtype=bool)})
        trim()

    return predict.asNondeterministic()  # so that a filter on it doesn't work it out a second time


def annotate(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with one more column: struct(lang_pred, score, rejected)."""
    return small_batches(docs).withColumn(out, predictor(model)(F.col(text_col).cast("string")))
