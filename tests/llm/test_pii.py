import hashlib
import random
import re

import pytest

from matchloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain(text):
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(kind, m.group()))
    return [(kind, s, e) for s, _, e, kind in found]


def texts():
    rng = random.Random(3)
    out = []
    for _ in range(2500):
        letters = rng.choice(["ab.@-_ +%", "0123456789 -.()+", "a1.@ +-()", "0123456789- .", "é1 @.+4a", "4 1-"])
        out.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))))
    return [*out, None, "", "x@y.z " * 300, "a" * 100000, "1." * 3000, "4111 1111 1111 1111 mail a@b.co.uk_d@e.fr", "é😀 a@b.cd 😀 +49 30 1234567 😀"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts())], "doc_id long, text string, spans string").repartition(8)


def test_base_spans_match_brute_force(spark, docs):
    got = {r.doc_id: r for r in pii.digest(docs).collect()}
    for i, text in enumerate(texts()):
        want = plain(text)
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        assert set(filter(None, line.split(","))) <= set(filter(None, got[i].spans.split(",")))
        assert got[i].n_added == len(list(filter(None, got[i].spans.split(",")))) - len(want)


def test_classifier_adds_what_labelers_agree_on(spark):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(i, f'write to a{i}@example.com or b{i} (at) example (dot) com, call +1 (614) 555-800{i % 10} or phone (614) 555-8001; token = "{secret}" and 1.2.3.{i}') for i in range(40)]
    rows += [(100 + i, f"the word {'abcdefghij' * 3} and number 12{i} of 4111 1111 1111 1112") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(df).collect()}
    text = rows[0][1]
    for kind, span in (("secret", secret), ("phone", "(614) 555-8001"), ("email", "b0 (at) example (dot) com")):
        assert f"{kind}:{text.index(span)}:{text.index(span) + len(span)}" in got[0].split(",")
    assert all(got[100 + i] == "" for i in range(40))  # a failed checksum is never added
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0].startswith("write to <EMAIL> or <EMAIL>, call <PHONE> or phone <PHONE>; token = \"<SECRET>\"")
    assert clean[100] == rows[40][1]


def test_reliabilities_follow_the_votes(spark):
    rows = [{"kind": 0, "pattern": 1, "listed": 1, "context": 1, "edges": 1, "long": 1, "digits": 0, "count": 500}, {"kind": 0, "pattern": 0, "listed": 0, "context": 0, "edges": -1, "long": 1, "digits": 0, "count": 500}]
    m = pii.estimate(rows)
    yes, no = m.reliabilities[0, "edges", 1]
    assert yes > 0.9 > 0.1 > no
    assert pii.estimate([]).weights["pattern"] == 0


def test_redaction_takes_out_exactly_the_spans(spark, docs):
    """Every text, from its listed spans, by plain slicing."""
    spans, every = {r.doc_id: r.spans for r in pii.digest(docs).collect()}, texts()
    for r in pii.redact(docs).where("text IS NOT NULL").collect():
        source, want, at = every[r.doc_id], "", 0
        for kind, start, end in sorted(((k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans[r.doc_id].split(",") if x)), key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2])):
            if start >= at:
                want += source[at:start] + f"<{kind.upper()}>"
            at = max(at, end)
        assert r.text == want + source[at:]
        assert r.spans == "clash"


def test_empty_table_and_null_text(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(df).count() == 0
    one = pii.digest(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert one.base_sha256 == hashlib.sha256(b"").hexdigest() and one.spans == "" and one.n_email == 0
    assert pii.redact(spark.createDataFrame([(None, None)], "doc_id long, text string")).first().text is None
