"""Near-duplicates by similarity: SimHash links first, and an exact way for what they miss.

``similar`` links texts whose sets of distinct word shingles have a Jaccard similarity of ``similarity`` or
more, and labels each with the smallest id that it reaches. Texts with one set are one node.

Candidates come in rounds, and links found in a round spare the next ones their work: a pair within
one component is no candidate any more, which loses no connection.

1. The trie self-join of ``simhash`` over fingerprints of the sets, and, for each element of a prefix,
   its neighbours in the order of sizes. Two sets of the similarity share an element of their
   prefixes (``prefix_length``) in the order (frequent in a sample, hash), so a small group of sets that share
   one is complete here. Members of larger groups are written down.
2. Of groups that still hold several components, neighbours at larger distances.
3. Of groups that even then hold several components, every pair across components. Large groups
   of near copies are one component by then, or one with a few others, so pairs don't grow with the square of a group.

Candidates are dropped if their sizes, the places of the shared element or their parities (``least_difference``) rule the
similarity out; the sets themselves, made from the texts anew, decide the others. So links are exact, up
to clashes of 64-bit hashes. Postings travel in buckets by hash, many in a row; elements that are frequent
in the sample are spread over buckets of their own, and a large group is dealt to a grid of salted
cells, so that no task has to hold it whole.

Defined results: null and blank texts have the empty set, one node; rows with a null id link nothing and have
no component; repeated rows share one; an id with several texts is a row for each; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchloom.llm import simhash
from matchloom.llm._common import cut, small_batches, trim

POSTING = np.dtype([("h", "<u8"), ("node", "<u8"), ("n", "<u4"), ("at", "<u2")])
MEMBER = "h long, node long, n int, at int, c long, s int"


def text_shingles(text: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *simhash._hash_parts(text, shingle, seed)]))


def set_node(hashes: np.ndarray) -> int:
    """A set's name: the hash of its sorted hashes."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.astype("<u8").tobytes(), 1)


def prefix_length(n: int, similarity: float) -> int:
    """Two sets of this similarity share one of the first so many elements of each, in any one order of all elements."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def parities(hashes: np.ndarray) -> bytes:
    """How many hashes fall on each bit, modulo 2; a power of two of bits, about as many as hashes or more.

    Sets that differ in d elements differ in at most d of these bits.
    """
    width = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A bound from below of how many elements two sets differ in, by their parities; wide ones are folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _fits(rows: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sizes, and places of the element that two sets share, allow the similarity."""
    ni, nj = rows["n"][i].astype(np.int64), rows["n"][j].astype(np.int64)
    # the first element that two sets share leaves no more in common than what follows it
    rest = np.minimum(ni - rows["at"][i], nj - rows["at"][j])
    return (np.minimum(ni, nj) >= similarity * np.maximum(ni, nj) - 1e-6) & (rest >= similarity / (1 + similarity) * (ni + nj) - 1e-6)


def _ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by hash, size and node, and where the group of each hash starts and ends."""
    rows = rows[np.lexsort((rows["node"], rows["n"], rows["h"]))]
    starts = np.flatnonzero(np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]])) if len(rows) else np.zeros(0, int)
    return rows, starts, np.append(starts[1:], len(rows))


def _unique(rows: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(pairs, 2): the nodes of pairs of rows, the smaller first, each pair once."""
    if not parts:
        return np.zeros((0, 2), np.uint64)
    a, b = (rows["node"][np.concatenate([p[k] for p in parts])] for k in (0, 1))
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)


def neighbours(rows: np.ndarray, similarity: float, window: int, comp: np.ndarray | None = None) -> np.ndarray:
    """Pairs of nodes at most ``window`` rows apart within the group of a hash, in the order of sizes.

    ``rows`` as _ordered gives them; with ``comp``, only pairs of different components.
    """
    live, parts = np.arange(len(rows)), []
    for d in range(1, window + 1):
        live = live[live + d < len(rows)]
        other = live + d
        near = (rows["h"][live] == rows["h"][other]) & (rows["n"][live] >= similarity * rows["n"][other] - 1e-6)
        live = live[near]
        if not len(live):
            break
        i, j = live, live + d
        if comp is not None:
            apart = comp[i] != comp[j]
            i, j = i[apart], j[apart]
        keep = _fits(rows, i, j, similarity)
        parts.append((i[keep], j[keep]))
    return _unique(rows, parts)


def across(rows: np.ndarray, starts: np.ndarray, stops: np.ndarray, comp: np.ndarray, similarity: float, side: np.ndarray | None = None, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """Pairs of nodes of one group and different components; with ``side``, of different sides.

    Rows of a group's largest component are met by the others only, so the work is the product of a group's rows
    and of those outside of its largest component.
    """
    for lo, hi in zip(starts.tolist(), stops.tolist()):
        c = comp[lo:hi]
        if (c == c[0]).all():
            continue
        names, which, count = np.unique(c, return_inverse=True, return_counts=True)
        few = lo + np.flatnonzero(which != count.argmax())
        size = rows["n"][lo:hi].astype(np.float64)
        n = rows["n"][few].astype(np.float64)
        first = lo + np.searchsorted(size, similarity * n - 1e-6)
        last = lo + np.searchsorted(size, n / similarity + 1e-6, side="right")
        each = last - first
        ends = np.cumsum(each)
        at = 0
        while at < len(few):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk)))
            m = each[at:to]
            i = np.repeat(few[at:to], m)
            j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[at:to], m)
            keep = comp[i] != comp[j]
            if side is not None:
                keep &= side[i] != side[j]
            i, j = i[keep], j[keep]
            keep = _fits(rows, i, j, similarity)
            if keep.any():
                yield _unique(rows, [(i[keep], j[keep])])
            at = to


def _among(hashes: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted array ``some``."""
    if not len(some):
        return np.zeros(len(hashes), bool)
    return some[np.minimum(np.searchsorted(some, hashes), len(some) - 1)] == hashes


def _frequent(texts: DataFrame, shingle: int, seed: int, share: float, sample: int, least: int = 3, most: int = 200_000) -> np.ndarray:
    """Hashes of shingles that recur in a share of the texts, ``sample`` at least; the ``most`` frequent ones.

    They come last in the order of prefixes and are spread: any set is right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).cast(pa.large_binary()):
                yield pa.RecordBatch.from_arrays([pa.array(text_shingles(t.as_py() or b"", shingle, seed).view(np.int64))], names=["h"])
        trim()

    total = texts.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(min(1.0, max(share, sample / max(1, total))) * (1 << 20)) + 1
    rows = texts.where(draw).select("text").mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= least)
    return np.sort(np.array([r.h for r in rows.orderBy(F.desc("count"), "h").limit(most).collect()], np.int64).view(np.uint64))


def _pairs_table(pairs: np.ndarray) -> pa.Table:
    return pa.table({"a": pairs[:, 0].copy().view(np.int64), "b": pairs[:, 1].copy().view(np.int64)})


def _nodes(texts: DataFrame, frequent: np.ndarray, shingle: int, similarity: float, seed: int) -> DataFrame:
    """For each row its set's node, size, fingerprint, parities and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for t in b.column(2).cast(pa.large_binary()):
                s = text_shingles(t.as_py() or b"", shingle, seed)
                late = _among(s, frequent)
                first = np.concatenate([s[~late], s[late]])[: prefix_length(len(s), similarity)]
                made.append((set_node(s), len(s), simhash._majority(simhash._ones(s)[0], len(s)), parities(s), first.tobytes()))
            node, n, fp, odd, first = zip(*made) if made else [()] * 5
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1),
                pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()),
                pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(odd, pa.binary()), pa.array(first, pa.binary()),
            ], names=["doc_id", "text_hash", "node", "n", "fp", "parities", "first"])
        trim()

    return texts.mapInArrow(run, "doc_id long, text_hash long, node long, n long, fp long, parities binary, first binary")


def _posted(one: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, rows): postings of all prefixes, many in a row; buckets from ``buckets`` on hold frequent elements, spread by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            bucket = np.concatenate([p[0] for p in parts])
            rows = np.concatenate([p[1] for p in parts])
            order = np.argsort(bucket, kind="stable")
            bucket, rows = bucket[order], rows[order]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            stops = np.append(starts[1:], len(bucket))
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(starts, stops)], pa.binary())], names=["bucket", "rows"])

        for b in batches:
            for node, n, first in zip(b.column(0).to_numpy().view(np.uint64), b.column(1).to_pylist(), b.column(2)):
                first = np.frombuffer(first.as_py(), np.uint64)
                if not len(first):
                    continue
                rows = np.empty(len(first), POSTING)
                rows["h"], rows["node"], rows["n"], rows["at"] = first, node, n, np.minimum(np.arange(len(first)), 65535)
                spread = _among(first, frequent)
                mixed = np.where(spread, (first ^ node) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20), first)
                parts.append(((mixed & np.uint64(buckets - 1)).astype(np.int64) + buckets * spread, rows))
                held += len(first)
                if held >= 1 << 20:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()
        parts = []
        trim()

    return one.select("node", "n", "first").mapInArrow(run, "bucket int, rows binary")


def _first_round(posted: DataFrame, buckets: int, similarity: float, window: int) -> DataFrame:
    """Candidates (a, b), and with h the members (h, node, n, at) of groups that are not complete."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows, starts, stops = _ordered(np.concatenate([np.frombuffer(x.as_py(), POSTING) for x in table.column("rows")]))
        pairs = neighbours(rows, similarity, window)
        more = np.repeat((stops - starts > window + 1) | (key[0].as_py() >= buckets), stops - starts)
        left = rows[more]
        none = lambda k, kind: pa.nulls(k, kind)
        k, m = len(pairs), len(left)
        found, rest = _pairs_table(pairs), {"h": left["h"].copy().view(np.int64), "a": left["node"].copy().view(np.int64)}
        return pa.concat_tables([
            pa.table({"h": none(k, pa.int64()), "a": found["a"], "b": found["b"], "n": none(k, pa.int32()), "at": none(k, pa.int32())}),
            pa.table({"h": rest["h"], "a": rest["a"], "b": none(m, pa.int64()), "n": left["n"].astype(np.int32), "at": left["at"].astype(np.int32)}),
        ])

    return posted.groupBy("bucket").applyInArrow(run, "h long, a long, b long, n int, at int")


def _members(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ordered rows, group starts and ends, components and salts of members."""
    rows = np.empty(len(table), [*POSTING.descr, ("c", "<i8"), ("s", "<i4")])
    for name in ("h", "node"):
        rows[name] = table.column(name).to_numpy().view(np.uint64)
    for name in ("n", "at", "c", "s"):
        rows[name] = table.column(name).to_numpy()
    rows, starts, stops = _ordered(rows)
    return rows, starts, stops, rows["c"], rows["s"]


def _next_round(members: DataFrame, roots: DataFrame, similarity: float, window: int | None, cell_rows: int, turn: int, groups: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The members of groups with several components, and their candidates (a, b): neighbours, or without a window all pairs across components."""
    known = roots.select(F.col("a").alias("r"), F.col("b").alias("to"))
    named = members.join(known, members.node == known.r, "left").select("h", "node", "n", "at", F.coalesce("to", "node").alias("c"))
    named = cut(named)
    open_ = named.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("k")).where("x <> y")
    open_ = cut(open_.select(F.col("h").alias("g"), F.ceil(F.col("k") / cell_rows).cast("int").alias("salts")))
    left = cut(named.join(open_, named.h == open_.g).select("h", "node", "n", "at", "c", "salts", F.pmod(F.xxhash64("node", "h", F.lit(turn)), F.col("salts")).cast("int").alias("s")))
    own = F.when(F.col("salts") > 1, F.col("h")).otherwise(F.pmod("h", F.lit(groups)))
    if window is None:
        dealt = left.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        dealt = dealt.select(own.alias("g"), F.least("s", "o").alias("p"), F.greatest("s", "o").alias("q"), "h", "node", "n", "at", "c", "s")
    else:
        dealt = left.select(own.alias("g"), F.col("s").alias("p"), F.col("s").alias("q"), "h", "node", "n", "at", "c", "s")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows, starts, stops, comp, salt = _members(table)
        if window is not None:
            return _pairs_table(neighbours(rows, similarity, window, comp))
        made = list(across(rows, starts, stops, comp, similarity, salt if key[1] != key[2] else None))
        return _pairs_table(np.unique(np.concatenate([np.zeros((0, 2), np.uint64), *made]), axis=0))

    return left.select("h", "node", "n", "at"), dealt.groupBy("g", "p", "q").applyInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, one: DataFrame, known: DataFrame, shingle: int, similarity: float, seed: int, most_broadcast: int) -> DataFrame:
    """Those of the candidates (a, b) whose sets have the similarity."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sizes = [c.to_numpy() for c in (x.column("na"), x.column("nb"))]
            most = (sizes[0] + sizes[1]) * (1 - similarity) / (1 + similarity) + 1e-6
            apart = np.array([least_difference(p.as_py(), q.as_py()) for p, q in zip(x.column("pa"), x.column("pb"))])
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(apart <= most)) for c in (x.column("a"), x.column("b"))], names=["a", "b"])
        trim()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [text_shingles(t.as_py() or b"", shingle, seed) for t in b.column(0).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([set_node(s) for s in made], np.uint64).view(np.int64)), pa.array([s.tobytes() for s in made], pa.binary())], names=["node", "hashes"])
        trim()

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for p, q in zip(x.column("pa"), x.column("pb")):
                p, q = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (x.column("a"), x.column("b"))], names=["a", "b"])
        trim()

    end = lambda x: one.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parities").alias(f"p{x}"))
    left = cut(pairs.distinct().join(end("a"), "a").join(end("b"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(possible, "a long, b long"))
    ends = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
    wanted = cut(one.join(ends, "node", "left_semi").select("text_hash").distinct())
    chosen = known.join(F.broadcast(wanted) if wanted.count() <= most_broadcast else wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text")
    whole = cut(chosen.mapInArrow(sets, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes")))
    end = lambda x: whole.select(F.col("node").alias(x), F.col("hashes").alias(f"p{x}"))
    return cut(left.join(end("a"), "a").join(end("b"), "b").select("a", "b", "pa", "pb").mapInArrow(alike, "a long, b long"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, seed: int = 42, budget: int = 4, windows: tuple[int, ...] = (8, 128), share: float = 1 / 16, sample: int = 4000, bucket_postings: int = 1 << 19, cell_rows: int = 1 << 18, most_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, text_hash, root, component_id) for every row of ``docs``; root names a component by one of its nodes.

    budget: differing bits of fingerprints that make a first candidate. windows: neighbours of each round, the first
    for all groups; after them come all pairs across components. share, sample: of the texts, and
    at least so many, are looked through for frequent shingles.
    """
    text = F.col(text_col).cast("string")
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    known = texts.where("doc_id IS NOT NULL")
    frequent = _frequent(known, shingle, seed, share, sample)
    found = cut(_nodes(texts, frequent, shingle, similarity, seed))
    one = cut(found.where("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), *[F.first(c).alias(c) for c in ("n", "fp", "parities", "first")]))
    postings = one.agg(F.sum(F.length("first") / 8)).first()[0] or 0
    buckets = 1 << max(4, math.ceil(math.log2(max(1, postings / bucket_postings))))
    # links of fingerprints: one node speaks for each fingerprint
    speakers = cut(one.groupBy("fp").agg(F.min("node").alias("id"), F.count("*").alias("k")))
    same = one.select("node", "fp").join(speakers.where("k > 1"), "fp").where("node <> id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    linked = simhash.links(speakers.select("fp", "id"), speakers.count(), budget).union(same)
    first = cut(_first_round(_posted(one, frequent, buckets), buckets, similarity, windows[0]))
    members = first.where("h IS NOT NULL").select("h", F.col("a").alias("node"), "n", "at")
    candidates = first.where("h IS NULL").select("a", "b").union(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    edges = _confirm(candidates, one, known, shingle, similarity, seed, most_broadcast)
    roots = simhash.star_components(edges)
    for turn, window in enumerate((*windows[1:], None)):
        members, candidates = _next_round(members, roots, similarity, window, cell_rows, turn)
        if not members.limit(1).count():
            break
        new = _confirm(candidates, one, known, shingle, similarity, seed, most_broadcast)
        edges = roots.union(new)
        if new.limit(1).count():
            roots = simhash.star_components(edges)
    merged = one.join(roots, one.node == roots.a, "left").select(F.col("node").alias("v"), "least", F.coalesce("b", "node").alias("root"))
    labels = merged.join(merged.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    out = found.join(labels, found.node == labels.v, "left")
    has = F.col("doc_id").isNotNull()
    return out.select("doc_id", "text_hash", F.when(has, F.col("root")).alias("root"), F.when(has, F.col("component_id")).alias("component_id"))
