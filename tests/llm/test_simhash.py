import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from matchloom.llm import neardup, simhash


def plain_fingerprint(text, shingle=4, seed=42):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def plain_components(fps, budget):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "a b c", "a b c d", "É Straße b c D e", "x " * 9000, "a b c\x0bd e\x1cf g h i"])
def test_fingerprint_matches_plain_version(text):
    assert simhash.text_fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_fingerprint_hash_is_sparks(spark):
    got = spark.sql("SELECT xxhash64('hello big wide world')").first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"hello big wide world", 42)
    assert got % (1 << 64) == simhash.text_fingerprint(b"Hello BIG wide\tworld")


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("depth", [0, 5])
def test_trie_join_matches_all_pairs(seed, depth):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)]
    keys = set()
    for b in base:
        for _ in range(rng.randint(1, 25)):
            x = b
            for _ in range(rng.randint(0, 7)):
                x ^= 1 << rng.randrange(64)
            keys.add(x)
    keys = sorted(keys)
    got = simhash.trie_join(np.array(keys, np.uint64), depth, 4, chunk=16, leaf=2)
    apart = lambda a, b: depth and a >> (64 - depth) != b >> (64 - depth)
    want = plain_components_of(keys, lambda a, b: not apart(a, b) and bin(a ^ b).count("1") <= 4)
    assert got.tolist() == want


def plain_components_of(keys, linked):
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def fixture(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    rows = []
    for g in range(12):
        text = [rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(60, 300))]
        for c in range(rng.randint(1, 8)):
            own = list(text)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = "changed"
            rows.append((g * 100 + c, " ".join(own)))
    rows += [(5000 + i, "the very same text again and again") for i in range(40)]
    rows += [(6000, None), (6001, ""), (6002, " \n"), (6003, "long " * 40000), (None, "the very same text again and again"), (5000, "the very same text again and again")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(i, t, "clash", "x") for i, t in rows], "doc_id long, text string, fp string, component_id string")


@pytest.mark.parametrize("cell_rows", [32768, 4])
def test_components_match_brute_force(spark, monkeypatch, cell_rows):
    rows, df = fixture(spark)
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda d, n, budget: links(d, n, budget, 8, cell_rows))
    got = simhash.near_duplicates(df).collect()
    known = [(i, t) for i, t in rows if i is not None]
    fps = [plain_fingerprint(t) for _, t in known]
    group = plain_components(fps, 4)
    least = {}
    for (i, _), g in zip(known, group):
        least[g] = min(i, least.get(g, i))
    want = sorted((i, f"{f:016x}", least[g]) for (i, _), f, g in zip(known, fps, group))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert len(got) == len(rows)


def test_representatives_keep_one_of_each_group(spark):
    rows, df = fixture(spark)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    kept = simhash.representatives(df, simhash.near_duplicates(df)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({v for v in found.values() if v is not None})
    assert sum(r.doc_id is None for r in kept) == 1
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp", "component_id"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.representatives(df, neardup.similar(df)).count() == 0


@pytest.mark.parametrize("part_edges", [1 << 20, 40])
def test_star_components_on_a_long_chain_and_a_hub(spark, part_edges):
    chain = [(i + 1, i) for i in range(60)]
    hub = [(1000 + i, 999) for i in range(200)]
    got = {r.a: r.b for r in simhash.star_components(spark.createDataFrame(chain + hub, "a long, b long"), part_edges=part_edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 999 for i in range(200)}
    assert simhash.star_components(spark.createDataFrame([], "a long, b long")).where(F.lit(True)).count() == 0


def jaccard(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_prefixes_cover_every_pair_within_the_budget():
    rng = random.Random(8)
    for n in (10, 10**8, 10**10, 10**12):
        ways = simhash.prefixes(n, 4, 8192)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), 4):
                b ^= 1 << k
            assert any(all((a ^ b) >> (64 - first - width) & ((1 << width) - 1) == 0 for first, width in order[: len(ways[0][0]) - 4]) for order, _ in ways)
    assert len(simhash.prefixes(10, 4, 8192)) == 5 and len(simhash.prefixes(10**9, 4, 8192)) == 15


def test_permuted_keys_keep_distances(spark):
    rng = random.Random(9)
    values = [rng.getrandbits(64) for _ in range(40)]
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for order, _ in simhash.prefixes(10**9, 4, 8192)[::4]:
        keys = [r.k % (1 << 64) for r in df.select(F.expr(simhash._permuted(order)).alias("k")).collect()]
        for (a, b), (x, y) in zip(zip(values, values[1:]), zip(keys, keys[1:])):
            assert bin(a ^ b).count("1") == bin(x ^ y).count("1")


def test_longer_prefixes_find_the_same_components(spark, monkeypatch):
    rows, df = fixture(spark)
    want = sorted(map(tuple, simhash.components(df.where("doc_id IS NOT NULL")).collect()))
    prefixes = simhash.prefixes
    monkeypatch.setattr(simhash, "prefixes", lambda n, budget, slot_rows: prefixes(10**9, budget, slot_rows))
    assert sorted(map(tuple, simhash.components(df.where("doc_id IS NOT NULL")).collect())) == want


def test_similar_links_what_is_similar(spark):
    rng = random.Random(12)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows, doc = [], 0
    for g in range(40):
        base = [rng.choice(vocabulary[:60]) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randint(40, 400))]
        rows.append((doc, " ".join(base), g))
        for rate in (0.0, 0.002, 0.01, 0.015):
            doc += 1
            copy = [rng.choice(vocabulary) if rng.random() < rate else w for w in base]
            rows.append((doc, " ".join(copy), g))
        doc += 1
    rows += [(10000 + i, "a b c", -1) for i in range(30)] + [(20000, None, -2), (20001, "  ", -2), (20002, "quite another text", -3)]
    got = {r.doc_id: r.component_id for r in neardup.similar(spark.createDataFrame(rows, "doc_id long, text string, sketch int")).collect()}
    assert len(got) == len(rows)
    by_id = {i: (t or "", g) for i, t, g in rows}
    near = [(a, b) for a in by_id for b in by_id if a < b and by_id[a][1] == by_id[b][1] and jaccard(by_id[a][0], by_id[b][0]) >= 0.8]
    assert len(near) > 150
    assert sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)
    for i, c in got.items():
        assert by_id[i][1] == by_id[c][1]  # never two unrelated texts
    assert got[20000] == got[20001] == 20000 and got[20002] == 20002
    assert neardup.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert neardup.similar(spark.createDataFrame([(None, "a b c")] * 2, "doc_id long, text string")).where("component_id IS NULL").count() == 2


def test_similar_finds_blocks_truncations_and_all_pairs_at_the_threshold(spark):
    rng = random.Random(21)
    rows, bases = [], 70
    for g in range(bases):
        base = [f"w{int(rng.paretovariate(0.6)) % 4000}g{rng.randrange(40)}" for _ in range(rng.randint(30, 400))]
        rows.append((10 * g, base))
        block = [f"b{g}x{k}" for k in range(len(base))]
        n = len(base)
        for k, share in enumerate((0.08, 0.12, 0.16, 0.19, 0.21), 1):
            m, at = max(1, int(share * n)), rng.randrange(n)
            kind = (g + k) % 4
            rows.append((10 * g + k, base + block[:m] if kind == 0 else base[: n - m] if kind == 1 else base[:at] + block[:m] + base[at:] if kind == 2 else [w if rng.random() > share / 7 else block[i] for i, w in enumerate(base)]))
    rows = [(i, " ".join(w)) for i, w in rows]
    near = lambda a, b: jaccard(a[1], b[1]) >= 0.8
    edge = [jaccard(a[1], b[1]) for a, b in zip(rows, rows[1:])]
    assert sum(0.8 <= j < 0.85 for j in edge) > 10
    want = plain_components_of(rows, near)
    got = {r.doc_id: r.component_id for r in neardup.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: rows[w][0] for (i, _), w in zip(rows, want)}


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(100):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(0, 900), dtype=np.uint64))
        y = np.unique(np.concatenate([x[: rng.integers(0, len(x) + 1)], rng.integers(0, 1 << 63, rng.integers(0, 300), dtype=np.uint64)]))
        assert neardup.least_difference(neardup.parities(x), neardup.parities(y)) <= len(np.setxor1d(x, y))


@pytest.mark.parametrize(("windows", "cell_rows", "sample"), [((1, 2), 24, 4000), ((2,), 1 << 18, 1)])
def test_similar_matches_brute_force_on_large_groups(spark, windows, cell_rows, sample):
    """Large groups of near copies, some of them near to only a few others, beside texts that share a passage."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(70):  # a block differs: near to the base, and half of them to few others
        own, at = list(base), rng.randrange(100)
        own[at : at + (8 if k % 2 else 3)] = [f"x{k}y{j}" for j in range(8 if k % 2 else 3)]
        rows.append((k, " ".join(own)))
    rows += [(100 + k, " ".join(base[:25] + [f"z{k}q{j}" for j in range(rng.randint(4, 20))])) for k in range(40)]
    rows += [(200 + k, " ".join(base[:30])) for k in range(5)] + [(300, ""), (301, None), (302, " ".join(base))]
    want = plain_components_of(rows, lambda a, b: jaccard(a[1] or "", b[1] or "") >= 0.8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.similar(df, windows=windows, cell_rows=cell_rows, sample=sample).collect()}
    assert got == {i: rows[w][0] for (i, _), w in zip(rows, want)}
    assert 5 < len(set(got.values())) < len(rows) - 60


def test_across_gives_every_pair_of_different_components():
    rng = np.random.default_rng(2)
    rows = np.zeros(60, neardup.POSTING)
    rows["h"], rows["node"], rows["n"] = rng.integers(0, 3, 60), np.arange(60), rng.integers(50, 70, 60)
    rows, starts, stops = neardup._ordered(rows)
    comp, side = rng.integers(0, 4, 60), rng.integers(0, 2, 60)
    for sides in (None, side):
        got = np.concatenate(list(neardup.across(rows, starts, stops, comp, 0.8, sides, chunk=7))).tolist()
        want = {(min(a, b), max(a, b)) for i, a in enumerate(rows["node"].tolist()) for j, b in enumerate(rows["node"].tolist()) if rows["h"][i] == rows["h"][j] and comp[i] != comp[j] and (sides is None or side[i] != side[j]) and min(rows["n"][i], rows["n"][j]) >= 0.8 * max(rows["n"][i], rows["n"][j])}
        assert {tuple(p) for p in got} == want


def test_an_id_with_several_texts_is_a_document_for_each(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a, "u"), (1, b, "v"), (2, a, "w"), (3, c, "x"), (1, b, "t"), (1, b, None), (None, c, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, i string")
    for found in (neardup.similar(df), simhash.near_duplicates(df)):
        kept = sorted(map(tuple, simhash.representatives(df, found).collect()), key=str)
        assert kept == sorted([(1, a, "u"), (1, b, "t"), (3, c, "x"), (None, c, "n")], key=str)
