"""Packing token sequences: best-fit decreasing into windows of fixed capacity.

Every document becomes its token ids and an end id. A document over the capacity is first cut into
full windows; the rests, longest first, go each to the open window with the least room that
still holds it, found by a segment tree over remaining capacities. What this leaves
open is closed by cutting: pieces of the emptiest windows fill the gaps of the fullest, and the one
window that is left over is cut at powers of two, which need no padding.

Each task packs the rows of its own partition, some ``flush_tokens`` ids at a time, so nothing is
shuffled and memory is bounded; a task that is run again gives the same sequences.

Defined results: a null or empty text is the end id alone; ids of documents may be null or
repeat, each row is packed by itself; special tokens' strings in a text are what ``encode`` makes of them; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from matchloom.llm._common import cached, small_batches, trim

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
SAFE = 1 << 16


def added_tokens(json_path: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file and their ids; only plain ones, which take nothing around them."""
    import json

    with open(json_path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError("added tokens with rules for what stands around them")
    return {t["content"]: t["id"] for t in found}


def rank_tokenizer(ranks_path: str, pattern: str, added: dict[str, int] | None = None) -> Callable[[str], np.ndarray]:
    """Token ids of a text from a file of byte-pair ranks (base64 and rank on each line).

    Strings of ``added`` in a text become their ids, and what stands between them is encoded by itself.
    """
    import re

    added = added or {}
    cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def make():
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if cuts is not None and len(parts := cuts.split(text)) > 1:
            return np.concatenate([np.array([added[x]], np.uint32) if k % 2 else plain(x) for k, x in enumerate(parts)])
        return plain(text)

    def plain(text: str) -> np.ndarray:
        enc = cached(f"ranks:{ranks_path}", make)
        if len(text) <= SAFE:
            return enc.encode_to_numpy(text, disallowed_special=())
        return np.concatenate([enc.encode_to_numpy(part, disallowed_special=()) for part in safe_parts(text)])

    return encode


def safe_parts(text: str, length: int = SAFE) -> Iterator[str]:
    """Parts of about ``length`` characters whose ids, joined, are those of the whole text.

    A cut is made before a single space between two characters that are no white space: the pattern
    never has such a space inside or at the end of a match.
    """
    at, n = 0, len(text)
    while n - at > length:
        k = text.find(" ", at + length)
        while 0 <= k and not (k + 1 < n and not text[k - 1].isspace() and not text[k + 1].isspace() and text[k - 1].isprintable() and text[k + 1].isprintable()):
            k = text.find(" ", k + 1)
        if k < 0:
            break
        yield text[at:k]
        at = k
    yield text[at:]


class OpenWindows:
    """Open windows by remaining capacity; the inner nodes count those below them."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least room of at least ``need``: (room, window)."""
        k = need + self.leaves
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):  # up, until there is something to the right
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._change(room, -1)
        return room, self.at[room].pop()


def best_fit(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (item, start in the item, length), full but for powers of two."""
    tree, windows = OpenWindows(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        fit = tree.tightest(n)
        if fit is None:
            room, w = capacity, len(windows)
            windows.append([])
        else:
            room, w = fit
        windows[w].append((item, 0, n))
        if room > n:
            tree.add(room - n, w)
    # close the open windows: the emptiest give, the fullest take
    open_ = [w for room in range(1, capacity) for w in tree.at[room]]
    room = {w: r for r in range(1, capacity) for w in tree.at[r]}
    lo, hi = 0, len(open_) - 1
    while lo < hi:
        takes, gives = open_[lo], open_[hi]
        while room[takes] and windows[gives]:
            item, start, n = windows[gives].pop()
            m = min(n, room[takes])
            windows[takes].append((item, start, m))
            room[takes] -= m
            room[gives] += m
            if m < n:
                windows[gives].append((item, start + m, n - m))
        lo += not room[takes]
        hi -= not windows[gives]
    if lo == hi and open_:
        rest, windows[open_[lo]] = windows[open_[lo]], []
        left = sum(n for _, _, n in rest)
        while rest:
            size, own = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                item, start, n = rest.pop(0)
                m = min(n, size)
                own.append((item, start, m))
                size -= m
                if m < n:
                    rest.insert(0, (item, start + m, n - m))
            windows.append(own)
    return [w for w in windows if w]


def pack(docs: DataFrame, encode: Callable[[str], np.ndarray], capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", flush_tokens: int = 1 << 21) -> DataFrame:
    """One row for each piece of a document: where it comes from, its ids (little-endian unsigned
    32-bit integers), and its sequence and place there.

    ``encode`` gives a text's ids and is sent to the executors.
    """

    def emit(rows: list[tuple[int | None, np.ndarray]], first: int) -> tuple[int, list[pa.RecordBatch]]:
        out: list[tuple] = []
        rests, sequence = [], first
        for d, (doc, ids) in enumerate(rows):
            full = len(ids) // capacity * capacity
            for start in range(0, full, capacity):
                out.append((d, start, capacity, sequence, 0))
                sequence += 1
            if len(ids) > full:
                rests.append((d, full, len(ids) - full))
        for window in best_fit([n for _, _, n in rests], capacity):
            offset = 0
            for item, start, n in window:
                out.append((rests[item][0], rests[item][1] + start, n, sequence, offset))
                offset += n
            sequence += 1
        made = []
        for at in range(0, len(out), 1024):
            part = out[at : at + 1024]
            made.append(pa.RecordBatch.from_arrays([
                pa.array([rows[d][0] for d, *_ in part], pa.int64()),
                pa.array([x[1] for x in part], pa.int64()),
                pa.array([x[2] for x in part], pa.int64()),
                pa.array([rows[d][1][s : s + n].tobytes() for d, s, n, _, _ in part], pa.binary()),
                pa.array([len(rows[d][1]) for d, *_ in part], pa.int64()),
                pa.array([x[3] for x in part], pa.int64()),
                pa.array([x[4] for x in part], pa.int64()),
            ], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]))
        return sequence, made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        rows, held = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                rows.append((doc, ids))
                held += len(ids)
                if held >= flush_tokens:
                    sequence, made = emit(rows, sequence)
                    yield from made
                    rows, held = [], 0
        if rows:
            yield from emit(rows, sequence)[1]
        rows = []
        trim()

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)
