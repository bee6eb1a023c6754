"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded as shares of
character-class 1- to 3-grams (hashed), of single ASCII marks, and figures on its words: repeats,
distinct words, mean length, capitals, digits. A linear layer with tanh embeds the encoding; gated
attention, softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages of a document, and the weighted
sum of their embeddings is scored by a logistic unit. All weights are learned together from document labels, by Adam on
a bounded sample of labelled documents, at most about ``fit_rows`` of them and ``fit_chars`` characters, chosen by a hash of their ids. Every
passage of a document in the sample is used; a document that no longer fits is left out whole. Scoring reads every passage.

A very long text is scored as a stream: attention needs only running sums over its passages.

Defined results: a null text, an empty one and one of white space have one passage that is empty; rows
without a label, or with a label other than 0 and 1, teach nothing; a score of exactly 0.5 is up to the caller; repeated labels of a document are
averaged and rounded; without labels every score is 0.5; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchloom.llm._common import cached, small_batches, trim

PASSAGE = 64  # words
GRAM_BITS = 8
GRAMS = 1 << GRAM_BITS
FIGURES = 8
DIM = GRAMS + 128 + FIGURES
PIECE = 1 << 16  # characters encoded at a time


def _classes() -> np.ndarray:
    """For each code point: itself for ASCII marks, else one number for each kind of character."""

    def kind(c: int) -> int:
        ch = chr(c)
        if ch.isspace():
            return 1
        if ch.isupper():
            return 2
        if ch.isalpha():
            return 3
        if ch.isdigit():
            return 4
        return c if c < 128 else 5

    return cached("classes", lambda: np.fromiter((kind(c) for c in range(0x110000)), np.uint32, 0x110000))


def pieces(text: str) -> Iterator[str]:
    """The text in parts of about PIECE characters, cut at white space where there is some near."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        space = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
        end = space + 1 if space > at + PIECE // 2 else end
        yield text[at:end]
        at = end
    yield text[at:]


def encode(text: str) -> np.ndarray:
    """(passages, DIM) of one part of a text."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _classes()[raw]
    inside = c != 1
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.zeros((1, DIM), np.float32)
    word = np.maximum(np.cumsum(np.concatenate([[0], (inside[1:] & ~inside[:-1]).astype(np.int64)])) + (0 if inside[0] else -1), 0)
    passage = word // PASSAGE
    n = int(passage[-1]) + 1
    with np.errstate(over="ignore"):
        two = (c[:-1] * np.uint32(2654435761)) ^ (c[1:] * np.uint32(2246822519))
        three = (two[:-1] * np.uint32(3266489917)) ^ (c[2:] * np.uint32(668265263))
        h = np.concatenate([(two * np.uint32(374761393)) >> np.uint32(32 - GRAM_BITS), (three * np.uint32(374761393)) >> np.uint32(32 - GRAM_BITS)])
        # the same letters at the same places of a word give the same sum
        place = np.arange(len(raw), dtype=np.uint32) - starts.astype(np.uint32)[word]
        mixed = (raw + np.uint32(7)) * (np.uint32(2654435761) + place * np.uint32(40503)) * inside
        words = np.add.reduceat(mixed, starts).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    size = np.maximum(np.bincount(passage, minlength=n), 1).astype(np.float32)
    out = np.zeros((n, DIM), np.float32)
    at = np.concatenate([passage[:-1], passage[:-2]]) * GRAMS + h
    out[:, :GRAMS] = np.bincount(at, minlength=n * GRAMS).reshape(n, GRAMS) / (2 * size[:, None])
    out[:, GRAMS : GRAMS + 128] = np.bincount(passage * 128 + np.minimum(c, 127), minlength=n * 128).reshape(n, 128) / size[:, None]
    of = np.arange(len(words)) // PASSAGE
    count = np.bincount(of, minlength=n).astype(np.float32)
    again = np.concatenate([[False], (words[1:] == words[:-1]) & (of[1:] == of[:-1])])
    both = np.unique(of.astype(np.uint64) << np.uint64(32) | words)
    distinct = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=n)
    letters = np.bincount(passage[inside], minlength=n)
    figures = [
        np.bincount(of[again], minlength=n) / count,
        distinct / count,
        np.minimum(letters / count / 16, 2),
        np.bincount(passage[c == 2], minlength=n) / np.maximum(letters, 1),
        np.bincount(passage[c == 4], minlength=n) / np.maximum(letters, 1),
        np.bincount(passage[c > 4], minlength=n) / np.maximum(letters, 1),
        count / PASSAGE,
        np.ones(n),
    ]
    out[:, GRAMS + 128 :] = np.stack(figures, axis=1)
    return out


@dataclass
class MilModel:
    mean: np.ndarray
    scale: np.ndarray
    embed: np.ndarray  # (DIM, H)
    embed_bias: np.ndarray
    gate_v: np.ndarray  # (H, A)
    gate_u: np.ndarray
    attend: np.ndarray  # (A,)
    out: np.ndarray  # (H,)
    bias: float


def _forward(m: MilModel, x: np.ndarray) -> tuple[np.ndarray, ...]:
    z = (x - m.mean) * m.scale
    h = np.tanh(z @ m.embed + m.embed_bias)
    t, s = np.tanh(h @ m.gate_v), 1 / (1 + np.exp(-np.clip(h @ m.gate_u, -30, 30)))
    return z, h, t, s, (t * s) @ m.attend


def score(m: MilModel, text: str | None) -> float:
    """Probability of label 1, from all passages of the whole text."""
    top, weight, total = -np.inf, 0.0, np.zeros(len(m.out))
    for part in pieces(text or ""):
        _, h, _, _, a = _forward(m, encode(part))
        new = max(top, float(a.max()))
        e = np.exp(a - new)
        shrink = np.exp(top - new) if weight else 0.0
        total, weight, top = total * shrink + e @ h, weight * shrink + float(e.sum()), new
    return float(1 / (1 + np.exp(-np.clip(total / weight @ m.out + m.bias, -30, 30))))


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 30, rate: float = 0.01, decay: float = 1e-4, batch: int = 64, seed: int = 0) -> MilModel:
    """Adam on the mean cross-entropy of bags; a dominant label is not reweighted."""
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags)
    mean, scale = x.mean(0), 1 / (x.std(0) + 0.02)
    ends = np.cumsum([len(b) for b in bags])
    starts = ends - [len(b) for b in bags]
    p = [
        rng.standard_normal((DIM, hidden)) / np.sqrt(DIM), np.zeros(hidden),
        rng.standard_normal((hidden, gate)) / np.sqrt(hidden), rng.standard_normal((hidden, gate)) / np.sqrt(hidden),
        rng.standard_normal(gate) / np.sqrt(gate), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1),
    ]
    m1, m2, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    best, best_p = np.inf, p
    order = rng.permutation(len(bags))
    check, use = order[: len(bags) // 8], order[len(bags) // 8 :]

    def run(which: np.ndarray, w: list[np.ndarray]):
        rows = np.concatenate([np.arange(starts[i], ends[i]) for i in which])
        sizes = np.array([ends[i] - starts[i] for i in which])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        model = MilModel(mean, scale, *w[:6], float(w[6][0]))
        z, h, t, s, a = _forward(model, x[rows])
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), sizes))
        a /= np.repeat(np.add.reduceat(a, first), sizes)
        doc = np.add.reduceat(a[:, None] * h, first)
        prob = 1 / (1 + np.exp(-np.clip(doc @ w[5] + w[6][0], -30, 30)))
        return sizes, first, z, h, t, s, a, doc, prob

    def loss(prob: np.ndarray, y: np.ndarray) -> float:
        return float(-np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)))

    for _ in range(epochs):
        for at in range(0, len(use), batch):
            which = rng.permutation(use)[:batch] if at else use[:batch]
            sizes, first, z, h, t, s, a, doc, prob = run(which, p)
            d_logit = (prob - labels[which]) / len(which)
            d_doc = np.repeat(d_logit[:, None] * p[5], sizes, axis=0)
            d_h = a[:, None] * d_doc
            d_a = (d_doc * h).sum(1)
            d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, first), sizes))
            d_ts = d_e[:, None] * p[4]
            d_t, d_s = d_ts * s * (1 - t * t), d_ts * t * s * (1 - s)
            d_h += d_t @ p[2].T + d_s @ p[3].T
            d_pre = d_h * (1 - h * h)
            grads = [z.T @ d_pre, d_pre.sum(0), h.T @ d_t, h.T @ d_s, (t * s).T @ d_e, doc.T @ d_logit, np.array([d_logit.sum()])]
            step += 1
            for k, g in enumerate(grads):
                g = g + decay * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        now = loss(run(check, p)[-1], labels[check]) if len(check) else 0.0
        if now <= best:
            best, best_p = now, [w.copy() for w in p]
    return MilModel(mean.astype(np.float32), scale.astype(np.float32), *[w.astype(np.float32) for w in best_p[:6]], float(best_p[6][0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 3000, fit_chars: int = 12_000_000) -> MilModel | None:
    """Learn from the labelled rows of ``docs``; ``fit_rows`` bounds the expected size of the sample, ``fit_chars`` its texts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    n = known.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    # the sample is small by its bound; its ids find their texts before texts are moved
    sample = known.where(draw < min(1.0, fit_rows / n)).groupBy("id").agg(F.round(F.avg("y")).alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(draw < min(1.0, fit_rows / n))
    sizes = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n"), F.first("y").alias("y")).orderBy(F.xxhash64("id"), "id").collect()
    chosen, left = [], fit_chars
    for r in sizes:
        if r.n <= left:
            chosen.append((r.id, r.y))
            left -= r.n
    if not chosen:
        return None
    rows = small_batches(texts).join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "id long, y double")), "id").select("id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                x = np.concatenate([encode(part) for part in pieces(text.as_py() or "")])
                yield pa.RecordBatch.from_pydict({"id": pa.array([i], pa.int64()), "y": pa.array([y], pa.float64()), "x": pa.array([x.astype(np.float16).tobytes()], pa.binary())})
        trim()

    found = rows.mapInArrow(run, "id long, y double, x binary").orderBy("id", "x").collect()
    if not found:
        return None
    bags = [np.frombuffer(r["x"], np.float16).astype(np.float32).reshape(-1, DIM) for r in found]
    return train(bags, np.array([r["y"] for r in found]))


def scorer(model: MilModel | None):
    """A pandas UDF: the score of a text."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([0.5 if model is None else score(model, t) for t in texts], dtype="float64")
        trim()

    return run
