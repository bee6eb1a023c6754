"""SimHash near-duplicates by a binary trie self-join.

``fingerprints`` gives every text a 64-bit SimHash of its word shingles; ``components`` links
fingerprints that differ in at most ``budget`` bits and labels each document with the smallest
document id that it reaches through links. ``neardup`` links texts by similarity, beginning with these links.

How the join is dealt out. Of m disjoint bit blocks, two fingerprints within the budget agree on at least
m - budget whole blocks. So for each choice of that many blocks every distinct fingerprint is sent
once, its bits permuted to begin with those blocks, to a subtree of a trie over such keys. m is the
least that lets a subtree hold few fingerprints: more rows take longer prefixes. Within a subtree
node pairs are traversed together: a pair starts as (node, same node), the children of a pair that
disagree in a bit use up one unit of the budget, and a pair over the budget is dropped with all
below it. Exact copies meet before the join (one row for each distinct fingerprint). A prefix with more than
``cell_rows`` fingerprints is dealt to a grid of salted cells, so that no task has to hold it whole.
A task returns a spanning forest of the links it found, never all pairs: node pairs whose leaves are
in one component already are skipped, which loses no connection.

Defined results: a null or blank text has fingerprint zero and links like any other; a text of
fewer words than a shingle has one shingle of them all; rows with a null document id have
their fingerprint and a null component, and link nothing; repeated rows share a component; the texts of
an id that comes with several link only by their fingerprints; an empty table gives no rows. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchloom.llm._common import cut, fresh, small_batches, trim

BITS = 64


SPACE = re.compile(rb"[\x20\x09-\x0D]")
PART = 1 << 20  # bytes of a text that are split into words at a time


def _word_parts(text: bytes) -> Iterator[list[bytes]]:
    """The text's words, part by part."""
    at, text = 0, text.lower()  # bytes: A-Z and the six ASCII white-space characters only
    while len(text) - at > PART and (gap := SPACE.search(text, at + PART)):
        yield text[at : gap.start()].split()
        at = gap.end()
    yield text[at:].split()


def _hash_parts(text: bytes, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, part by part; of a text with fewer words, of them all; of none, nothing."""
    tail: list[bytes] = []
    some = False
    for words in _word_parts(text):
        tail += words
        if len(tail) >= shingle:
            some = True
            yield _shingle_hashes(tail, shingle, seed)
            tail = tail[len(tail) - shingle + 1 :]
    if tail and not some:
        yield _shingle_hashes(tail, shingle, seed)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, for each column of a table of 64-bit hashes: (columns, BITS)."""
    hashes = hashes[:, None] if hashes.ndim == 1 else hashes
    ones = np.zeros(hashes.shape[1] * BITS, np.int64)
    for lo in range(0, len(hashes), 255):  # so many ones fit a byte
        part = np.ascontiguousarray(hashes[lo : lo + 255], "<u8").view(np.uint8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return ones.reshape(-1, BITS)


def _majority(ones: np.ndarray, n: int) -> int:
    """Bit k is set if it is set in over half of n hashes."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _shingle_hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = len(words) - shingle + 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n)


def text_fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text over its shingles, repeats included."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in _hash_parts(text, shingle, seed):
        ones += _ones(hashes)[0]
        n += len(hashes)
    return _majority(ones, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp): the signed 64-bit SimHash of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.large_binary())
            fps = np.fromiter((text_fingerprint(t.as_py() or b"", shingle, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])
        trim()

    text = F.col(text_col).cast("string")
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def block_edges(blocks: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of ``blocks`` blocks that cover all bits."""
    at = [BITS * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def prefixes(n: int, budget: int, slot_rows: int, most: int = 4) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """For each choice of blocks: the order of all blocks, the chosen ones first, and the chosen ones' bits.

    The first number of chosen blocks, up to ``most``, that spreads n fingerprints over slots of some times ``slot_rows``.
    """
    for chosen in range(1, most + 1):
        edges = block_edges(budget + chosen)
        if chosen == most or n / 2 ** sum(sorted(w for _, w in edges)[:chosen]) <= 8 * slot_rows:
            break
    out = []
    for pick in combinations(edges, chosen):
        out.append(((*pick, *(e for e in edges if e not in pick)), sum(w for _, w in pick)))
    return out


def _permuted(order: tuple[tuple[int, int], ...]) -> str:
    """SQL of fp with its bit blocks in the given order."""
    parts, at = [], 0
    for first, width in order:
        low, to = BITS - first - width, BITS - at - width
        parts.append(f"shiftleft(shiftrightunsigned(fp, {low}) & {(1 << width) - 1}L, {to})")
        at += width
    return " | ".join(parts)


def _settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the components of i[k] and j[k]; label[x] is the smallest index of x's component."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(nxt := label[label], label):
            label = nxt
    return label


def trie_join(keys: np.ndarray, depth: int, budget: int, chunk: int = 1 << 18, leaf: int = 32) -> np.ndarray:
    """Component label (index of its first key) of each of the sorted ``keys``.

    Keys link if their first ``depth`` bits agree and at most ``budget`` of the others differ.
    """
    n = len(keys)
    label = np.arange(n)
    if n < 2:
        return label
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
        """Where the one-child of each node starts."""
        if level not in ones:
            bit = (keys >> np.uint64(BITS - 1 - level)) & np.uint64(1)
            ones[level] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        return hi - (ones[level][hi] - ones[level][lo])

    top = keys >> np.uint64(BITS - depth) if depth else np.zeros(n, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    ends = np.append(starts[1:], n)
    roots = ends - starts > 1
    s, e = starts[roots], ends[roots]
    stack = [(depth, np.stack([s, e, s, e, np.zeros_like(s)]))]
    while stack:
        level, pairs = stack.pop()
        if pairs.shape[1] > chunk:
            stack += [(level, pairs[:, k : k + chunk]) for k in range(0, pairs.shape[1], chunk)]
            continue
        # skip pairs that lie in one component already
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        a0, a1, b0, b1, d = pairs
        done = (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (label[a0] == label[b0])
        pairs = pairs[:, ~done]
        # small nodes are compared leaf by leaf
        a0, a1, b0, b1, d = pairs
        many = (a1 - a0) * (b1 - b0)
        small = (many <= leaf) | (level == BITS)
        if small.any():
            x0, nx, y0, ny = a0[small], (a1 - a0)[small], b0[small], (b1 - b0)[small]
            each = nx * ny
            k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i = np.repeat(x0, each) + k // np.repeat(ny, each)
            j = np.repeat(y0, each) + k % np.repeat(ny, each)
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            i, j = i[near], j[near]
            label = _settle(label, i, j)
            a0, a1, b0, b1, d = pairs[:, ~small]
        if not len(a0):
            continue
        am, bm = split(a0, a1, level), split(b0, b1, level)
        same = (a0 == b0) & (a1 == b1)
        apart = ~same
        below = np.concatenate([
            np.stack([a0, am, b0, bm, d]),
            np.stack([am, a1, bm, b1, d]),
            np.stack([a0, am, bm, b1, d + 1]),
            np.stack([am, a1, b0, bm, d + 1])[:, apart],
        ], axis=1)
        below = below[:, (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= budget)]
        alone = (below[0] == below[2]) & (below[1] - below[0] == 1) & (below[3] - below[2] == 1)
        stack.append((level + 1, below[:, ~alone]))
    return label


def links(distinct: DataFrame, n: int, budget: int = 4, slot_rows: int = 8192, cell_rows: int = 32768, most_broadcast: int = 100_000) -> DataFrame:
    """Edges (a, b), a > b, of a forest that connects what lies within the budget.

    ``distinct``: n rows (fp, id), each once. A slot is a prefix's first bits; one of over ``cell_rows`` rows is salted.
    """
    ways = prefixes(n, budget, slot_rows)
    bits = max(0, min(min(w for _, w in ways), math.ceil(math.log2(max(1, n / slot_rows)))))
    at = F.array(*[F.struct(F.lit(k).alias("way"), F.expr(_permuted(order)).alias("key")) for k, (order, _) in enumerate(ways)])
    rest = [c for c in distinct.columns if c != "fp"]
    turned = distinct.select(*rest, F.explode(at).alias("_w")).select(*rest, "_w.way", "_w.key")
    turned = turned.withColumn("slot", F.shiftrightunsigned("key", BITS - bits) if bits else F.lit(0).cast("long"))
    crowded = cut(turned.groupBy("way", "slot").count().where(F.col("count") > cell_rows).select("way", "slot", F.ceil(F.col("count") / cell_rows).cast("int").alias("salts")))
    salted = turned.join(F.broadcast(crowded) if crowded.count() <= most_broadcast else crowded, ["way", "slot"], "left")
    salts = F.coalesce("salts", F.lit(1))
    dealt = (
        salted.withColumn("own", F.pmod(F.xxhash64("key", "id"), salts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), salts - 1)))
        .select("way", "slot", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), "key", *rest)
    )
    depths = [w for _, w in ways]

    def forest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, ids = pdf["key"].to_numpy().view(np.uint64), pdf["id"].to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        label = trie_join(keys, depths[key[0]], budget)
        child = np.flatnonzero(label != np.arange(len(label)))
        a, b = ids[child], ids[label[child]]
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return dealt.groupBy("way", "slot", "s", "t").applyInPandas(forest, "a long, b long")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars: (node, smallest node of its component)."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        both = np.concatenate([np.concatenate([h[k] for h in held]) for k in (0, 1)])
        nodes, at = np.unique(both, return_inverse=True)
        label = _settle(np.arange(len(nodes)), at[: len(at) // 2], at[len(at) // 2 :])
        child = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[label[child]])], names=["a", "b"])


def star_components(edges: DataFrame, most_rounds: int = 60, part_edges: int = 1 << 20) -> DataFrame:
    """(a, b): b is the smallest node that a reaches; nodes that are their own smallest are absent.

    Edges are dealt to parts of at most about ``part_edges``, and each part becomes stars by union-find. What
    several parts leave settles by large-star and small-star steps in turn; minima are aggregated before rows are joined to
    them, so that a hub's neighbours are never gathered in one task. They are written before they are
    joined: then both sides of the join have a shuffle of their own, whose skewed partitions Spark can split.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    parts = max(1, math.ceil(edges.count() / part_edges))
    stars = cut(edges.repartition(parts).mapInArrow(_contract, "a long, b long"))
    if parts == 1:
        return stars
    now = stars.distinct()
    before = state(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        now = cut(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        after = state(now)
        if after == before:
            return now
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, budget: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for every row of ``docs``; root names a component by one of its fingerprints."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = cut(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("id", F.col("fp")))
    roots = star_components(links(distinct.select("fp", "id"), distinct.count(), budget))
    merged = distinct.join(roots, distinct.id == roots.a, "left").select(F.col("fp").alias("f"), "least", F.coalesce("b", "id").alias("root"))
    first = merged.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = merged.select("f", "root").join(first, "root")
    known = F.col("doc_id").isNotNull()
    return fps.join(labels, fps.fp == labels.f, "left").select("doc_id", "text_hash", "fp", F.when(known, F.col("root")).alias("root"), F.when(known, F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, fingerprint, component_id, root, text_hash); the fingerprint as 16 hexadecimal digits."""
    return components(docs, id_col, text_col, **how).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "text_hash")


def representatives(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component of ``found`` (doc_id, text_hash, root): the least by id, then hash of the text.

    Rows with a null id stay. Of rows that repeat an id and a text one stays, the least of them written
    as JSON; an id that comes with several texts is a document for each of them.
    """
    i, t = fresh(docs, "i", "t")
    rows = cut(found.where("doc_id IS NOT NULL").groupBy("root", "doc_id", "text_hash").count())
    least = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    placed = cut(rows.join(least, "root").select("doc_id", "text_hash", "count", (F.struct("doc_id", "text_hash") == F.col("least")).alias("stays")))
    key = placed.select(F.col("doc_id").alias(i), F.col("text_hash").alias(t), "count", "stays")
    at = (docs[id_col].cast("long") == F.col(i)) & (F.xxhash64(docs[text_col].cast("string")) == F.col(t))
    kept = docs.join(key.where("NOT stays OR count > 1").select(i, t), at, "left_anti")
    again = key.where("stays AND count > 1").select(i, t)
    if again.limit(1).count():
        (whole,) = fresh(docs, "whole")
        row = F.struct(*[docs[c] for c in docs.columns])
        once = docs.join(again, at).groupBy(i, t).agg(F.min_by(row, F.to_json(row)).alias(whole)).select(f"{whole}.*")
        kept = kept.unionByName(once)
    return kept
