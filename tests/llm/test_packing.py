import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import packing


def check_windows(lengths, capacity):
    cover = {}
    for window in packing.best_fit(lengths, capacity):
        total = sum(n for _, _, n in window)
        assert total == capacity or (0 < total < capacity and total & (total - 1) == 0)
        for item, start, n in window:
            cover.setdefault(item, []).append((start, n))
    for item, length in enumerate(lengths):
        at = 0
        for start, n in sorted(cover.get(item, [])):
            assert start == at and n > 0
            at += n
        assert at == length


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_covers_everything(seed):
    rng = random.Random(seed)
    check_windows([rng.randint(1, 1023) for _ in range(rng.randint(0, 300))], 1024)


def test_tree_finds_the_tightest_window():
    rng = random.Random(0)
    for _ in range(60):
        tree, rooms = packing.OpenWindows(64), []
        for k in range(120):
            if rng.random() < 0.6:
                rooms.append(rng.randint(1, 64))
                tree.add(rooms[-1], k)
            else:
                need = rng.randint(1, 64)
                got, fits = tree.tightest(need), [r for r in rooms if r >= need]
                assert (got is None) == (not fits)
                if got:
                    assert got[0] == min(fits)
                    rooms.remove(got[0])


def test_most_items_stay_whole():
    rng = random.Random(1)
    lengths = [rng.randint(1, 1023) for _ in range(4000)]
    windows = packing.best_fit(lengths, 1024)
    assert sum(len(w) for w in windows) < 1.2 * len(lengths)


TOKENIZERS = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encode():
    return packing.rank_tokenizer(str(TOKENIZERS.path("byte_bpe_50k.tiktoken")), TOKENIZERS.PATTERN)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(TOKENIZERS.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "Hello world", "it's  é\n\n x　y​z <|endoftext|> 😀", " " * 500 + "x", "a" * 5000])
def test_ids_equal_the_tokenizers(encode, plain, text):
    assert encode(text).tolist() == plain(text)


def test_long_texts_are_cut_without_a_trace(encode, plain, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "it's ", " ", "\n", "12 ", "é", "x. ", " ", "...", "😀 "]) for _ in range(3000))
    want = plain(text)
    for part in (1, 7, 64, 1000):
        assert [i for p in packing.safe_parts(text, part) for i in packing.rank_tokenizer(str(TOKENIZERS.path("byte_bpe_50k.tiktoken")), TOKENIZERS.PATTERN)(p)] == want
        assert "".join(packing.safe_parts(text, part)) == text


def check_pieces(rows, pieces, encode, capacity=1024):
    by_sequence, by_doc = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append((p.start, ids.tolist(), p.doc_tokens))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == capacity or at & (at - 1) == 0
    for i, text in rows:
        want = [*encode(text or "").tolist(), 0]
        assert [x for _, ids, _ in sorted(by_doc[i]) for x in ids] == want
        assert {n for _, _, n in by_doc[i]} == {len(want)}


def test_round_trip(spark, encode):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "é"]) for _ in range(rng.choice([0, 1, 5, 200, 900, 5000])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "x" * 30000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, start string").repartition(3)
    for flush in (1 << 21, 3000):
        pieces = packing.pack(df, encode, flush_tokens=flush).collect()
        check_pieces(rows, pieces, encode)
    crc = packing.pack(df, encode).select("ids", F.crc32("ids").alias("c")).collect()
    assert all(zlib.crc32(r.ids) == r.c for r in crc)


def test_repeated_rows_null_ids_and_empty(spark, encode):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = packing.pack(df, encode).collect()
    assert sum(p.length for p in got) == 3 + 3 + 2
    assert packing.pack(df.limit(0), encode).count() == 0


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n\n x", "<|endoftext|" + "x y " * 40000 + "<|endoftext|>it's"])
def test_query_ids_equal_the_tokenizers_with_added_tokens(text):
    from tokenizers import Tokenizer

    from matchloom.llm.catalogue import gpt_tokens

    t = Tokenizer.from_file(str(TOKENIZERS.path("byte_bpe_50k.json")))
    assert gpt_tokens()(text).tolist() == t.encode(text, add_special_tokens=False).ids
