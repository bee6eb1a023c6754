import random

import numpy as np
import pytest

from matchloom.llm import langid


def plain_counts(text):
    s = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    s = " " + " ".join(s.split()) + " "
    if not s.strip():
        return None
    return np.bincount(langid._grams(np.frombuffer(s.encode("utf-32-le"), np.uint32)), minlength=langid.DIM)


@pytest.mark.parametrize("piece", [3, 4, 7, 1 << 16])
def test_counts_do_not_depend_on_pieces(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(200):
        text = "".join(rng.choice("ab. éZ1") for _ in range(rng.randint(0, 14)))
        got, want = langid.counts(text), plain_counts(text)
        assert (got is None) == (want is None)
        assert got is None or (got == want).all()


def corpus(spark, lang_col=True):
    rng = random.Random(2)
    syllables = {"xx": ["ka", "to", "mi", "ru"], "yy": ["sch", "ung", "ber", "ent"], "zz": ["eau", "oux", "que", "ile"]}
    rows = []
    for k in range(240):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        rows.append((k, text, lang if k % 10 else None, lang, "clash"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string, language_ string")


def test_learns_and_predicts(spark):
    rows, df = corpus(spark)
    model = langid.fit(df)
    assert model.languages == ["xx", "yy", "zz"]
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    got = langid.annotate(df, model).select("truth", "language.*").collect()
    assert all(r.lang_pred == r.truth and 0 <= r.score <= 1 and not r.rejected for r in got)


def test_document_frequencies_cover_all_rows(spark):
    rows, df = corpus(spark)
    model = langid.fit(df, fit_rows=30)  # a small sample for the centroids only
    tf = [plain_counts(r[1]) for r in rows if r[2] is not None]
    n = sum((t > 0).astype(int) for t in tf)
    assert np.allclose(model.idf, np.log((1 + len(tf)) / (1 + n)) + 1, atol=1e-5)


def test_edge_cases(spark):
    _, df = corpus(spark)
    model = langid.fit(df)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "ж"), (5, "katomi " * 50000), (6, "katomi"), (6, "katomi")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.annotate(odd, model).select("doc_id", "language.*").collect()}
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (1, 2, 3))
    assert got[4].rejected and got[4].lang_pred in model.languages
    assert got[5].lang_pred == "xx" and got[6].lang_pred == "xx"
    assert langid.annotate(odd.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    found = langid.annotate(df, model).first()["language"]
    assert found.lang_pred == "und" and not found.rejected
    assert langid.fit(df.limit(0)).languages == []


def test_every_language_is_learned(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(230):
        syllables = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(4)]
        rows += [(len(rows) + i, " ".join("".join(rng.choices(syllables, k=2)) for _ in range(30)), f"l{k:03}") for i in range(4 if k < 225 else 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == sorted({r[2] for r in rows}) and set(model.owner) == set(range(230))
    got = langid.annotate(df, model).select("lang", "language.*").collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_gibberish_and_unlearned_languages_are_rejected(spark, sf_dir):
    import base64

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    rng = random.Random(1)
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    odd = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (20, 60, 200, 1000)]
    odd += [base64.b64encode(rng.randbytes(n)).decode() for n in (100, 800, 4000)] + [polish, polish * 20]
    good = ["The house is on the hill.", "Der Hund und die Katze.", "Le chat est sur la table."]
    df = spark.createDataFrame(list(enumerate(odd + good)), "doc_id long, text string")
    got = {r.doc_id: r.rejected for r in langid.annotate(df, model).select("doc_id", "language.rejected").collect()}
    assert [i for i in range(len(odd)) if not got[i]] == []
    assert [t for i, t in enumerate(good, len(odd)) if got[i]] == []
