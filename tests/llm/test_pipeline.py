import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import catalogue, langid, mixing, neardup, packing, pii, simhash
from matchloom.llm._common import cut


def test_stage_names_and_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes


def test_decisions_take_effect(spark):
    good = " ".join(f"the{k % 17} quick{k % 13} fox{k % 11} jumps" for k in range(60))
    rows = [(k, f"{good} number{k} of{k} this{k} is{k} text{k} " * 2, "en", "s", 0) for k in range(30)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, "12345 !!", "en", "s", 0), (102, None, None, None, None), (103, f"write to someone@example.com {good[:300]}", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {101, 102}
    one = corpus_pipeline.drop_near_duplicates(spark, kept, "")
    found = neardup.similar(kept)
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.component_id for r in found.select("component_id").distinct().collect())
    clean = corpus_pipeline.redact_personal_data(spark, docs, "").where("doc_id = 103").first()
    assert "<EMAIL>" in clean.text and "someone@" not in clean.text and clean.n_chars == len(clean.text)
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    want = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.size}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect() if r.doc_id != 102}
    assert got == {i: n for i, n in want.items() if n}
    pieces = corpus_pipeline.pack_sequences(spark, docs, "")
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(catalogue.gpt_tokens()(r[1] or "")) + 1 for r in rows)


def plain_mix(rows, weights=(5, 2, 1), most=3):
    """[(row, times)] by sorting each source by hash; rows: (doc_id, text, source)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + size(t)
    names = sorted(s for s in total if s is not None) + [s for s in total if s is None]
    weight, target, open_, left = {s: weights[i % 3] for i, s in enumerate(names)}, {}, set(names), float(sum(total.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * total[s] + 1e-9]
        for s in over or open_:
            target[s] = float(most * total[s]) if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - set(over) if over else set()
    out = []
    for s in names:
        mine = sorted(((int(hashlib.md5(f"{i}|{t or ''}".encode()).hexdigest()[:15], 16), i, t) for i, t, x in rows if x == s), key=lambda r: r[0])
        times = min(most, int(target[s] // total[s])) if total[s] else 0
        budget, low = target[s] - times * total[s], 0
        for _, i, t in mine:
            n = size(t)
            once = low + n <= budget or 2 * (budget - low) > n
            out.append((i, times + int(once and total[s] > 0)))
            low += n if low + n <= budget else budget * 2 + n  # nothing after the boundary
    return dict(out)


def test_run_against_brute_force(spark, sf_dir):
    """Each stage's rows, worked out plainly from those of the stage before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = []
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        stages.append(docs.collect())
    spoken, single, clean, mixed, pieces = stages
    assert {r.doc_id for r in spoken} == {i for i, r in rows.items() if re.search(r"[^\W\d_]", r.text)}
    assert sum(r.lang == rows[r.doc_id].lang for r in spoken) >= 0.98 * len(spoken)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets, kept = {r.doc_id: shingles(r.text) for r in spoken}, {r.doc_id for r in single}
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert not [p for p, j in near.items() if j >= 0.85 and set(p) <= kept]
    assert all(any(j >= 0.6 and i in p for p, j in near.items()) for i in sets if i not in kept)
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"(?<![0-9.])[0-9]{1,2}(\.[0-9]{1,2}){3}(?![0-9.])", "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"}
    assert sum(len(re.findall(p, r.text)) for p in base.values() for r in clean) == 0
    plain = {r.doc_id: r.text for r in single if not re.search(r"[0-9@]", r.text)}
    assert plain and all(r.text == plain[r.doc_id] for r in clean if r.doc_id in plain)
    assert all(r.n_chars == len(r.text) for r in clean) and len(clean) == len(single)
    times = Counter(r.doc_id for r in mixed)
    assert times == Counter({i: n for i, n in plain_mix([(r.doc_id, r.text, r.source) for r in clean]).items() if n})
    encode, texts, ids = catalogue.gpt_tokens(), {r.doc_id: r.text for r in clean}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids.setdefault((p.doc_id, p.start), []).append(p)
    got = Counter(p.doc_id for p in pieces for _ in range(p.length))
    assert got == Counter({i: n * (len(encode(texts[i])) + 1) for i, n in times.items()})
    fill = Counter()
    for p in pieces:
        fill[p.sequence_id] += p.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in fill.values())


def test_stages_take_nulls_in_every_column_and_clashing_names(spark):
    text = "the quick brown fox jumps over the lazy dog and runs on "
    rows = [(1, text * 3, "en", "a", 5), (None, text, "en", "a", 5), (2, None, "en", "a", 5), (3, text + "other words here", None, "a", 5), (4, "mail me at a@b.com or " + text, "en", None, 5), (5, "A whole other sentence of nine plain English words", "en", "b", None), (5, "A whole other sentence of nine plain English words", "en", "b", None)]
    docs = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, language string, gone string, spans string, epochs string, sketch string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0
    assert corpus_pipeline.pack_sequences(spark, docs, "").agg(F.sum("length")).first()[0] > len(rows)
    once = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sum(r.doc_id == 5 for r in once) == 1 and sum(r.doc_id is None for r in once) == 1


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_run_equals_the_stages_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    rows = langid.annotate(docs, model).where("NOT language.rejected").drop("language")
    rows = simhash.representatives(rows, neardup.similar(rows))
    rows = pii.redact(rows)
    want = mixing.mixed_documents(rows).collect()
    encode = catalogue.gpt_tokens()
    tokens = {}
    for r in want:
        tokens.setdefault(r.doc_id, [[*encode(r.text).tolist(), 0], 0])[1] += 1
    got = {}
    for p in corpus_pipeline.run(spark, sf_dir).collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + len(np.frombuffer(p.ids, "<u4"))
    assert got == {i: len(ids) * n for i, (ids, n) in tokens.items()}


@pytest.mark.parametrize("name", sorted(n for n in catalogue.queries() if n.startswith("op")))
def test_queries_run(spark, sf_dir, name):
    """As many rows as the contract says, each document once."""
    df = catalogue.queries()[name](spark, sf_dir)
    n = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "embeddings", "pages")}
    key = {"op6_urls": "page_id"}.get(name, "doc_id")
    if name in ("op1_forest", "op7_topk"):
        by, k = (20, 20) if name == "op1_forest" else (50, 5)
        assert df.count() == k * n["embeddings"].where(F.col("vec_id") % by == 0).count()
    elif name == "op4_packing":
        assert df.select(key).distinct().count() == n["documents"].count()
    else:
        assert df.count() == df.select(key).distinct().count() == n["pages" if key == "page_id" else "documents"].count()


def test_packed_table_is_whole(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    encode = catalogue.gpt_tokens()
    lengths = {r.doc_id: n for r in catalogue.op4_packing(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n")).collect() for n in [r.n]}
    assert lengths == {r.doc_id: len(encode(r.text)) + 1 for r in rows}
    assert packing.best_fit([], 1024) == []
