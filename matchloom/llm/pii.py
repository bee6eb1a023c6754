"""Personal data by weak supervision, in DataFrame functions throughout.

Patterns propose candidate spans in whole texts. Four labelers vote on each: the strict *pattern*
(checksum, digit count, part range), a *gazetteer* (top-level domains, card issuers, calling codes, reserved
networks, key words), the *context* (cue words just before) and the *edges* (whether the span is cut out
of a longer token). Expectation-maximisation (Dawid and Skene) estimates each labeler's
reliability for each kind from the counts of vote patterns (failed strict checks are known
negatives, and never added), and the posteriors train a logistic
classifier of spans on votes and shape. Spans of the base rules always stay; the classifier adds to them.

Candidates are found once and written, without their texts where those aren't needed. Only counts of distinct vote-and-shape patterns reach the driver: at most
``len(KINDS) * 2 * 3 * 3 * 2 * 4 * 4`` rows for any input.

Every pattern is written so that a scan is linear: a search starts only where a run of
its characters starts or where the last match ended, and repeats are possessive. Offsets are
running sums of the lengths between and of matches.

Defined results: a null or empty text has no spans; rows are judged one by one, so repeated
rows and null ids are kept as they are; of equal spans the kind listed first comes first; clashing column names are avoided; an empty table gives
no rows, and a model that adds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.llm._common import cut, fresh

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
# The base patterns, each in a form that scans in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser patterns, whose matches the classifier decides on.
SPELLED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(][Aa][Tt][\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(][Dd][Oo][Tt][\])]\x20?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+().-])(?<![0-9+)][\x20])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\x20.-]?[0-9])"
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+"
# Gazetteers.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "us", "ch", "at", "nl", "ca", "au", "jp")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420", "971")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
RESERVED = r"^0*(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
KEY_WORDS = r"(?i)(?:token|secret|key|passw(?:or)?d|bearer|auth)"
# Cue words of the context labeler, by kind.
CUES = {
    "email": r"(?i)(?:mail|contact|write to|address)",
    "ip": r"(?i)(?:\bip\b|host|server|addr|from|login)",
    "card": r"(?i)(?:card|visa|master|amex|pay|credit|debit|\bno\b)",
    "phone": r"(?i)(?:phone|\btel|call|mobile|cell|fax|whatsapp)",
    "secret": r"[=:]\s?[\"']?$",
}
NEAR = 24  # characters of context
STEP = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _running(lengths: Column, n: Column) -> Column:
    """Sums of all that stands before each place of an array, from sums of blocks of STEP."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int")), lambda b: total(F.slice(lengths, b * STEP + 1, F.lit(STEP))))
    return let(
        let(blocks, lambda bs: F.transform(F.sequence(F.lit(1), F.size(bs)), lambda b: total(F.slice(bs, F.lit(1), b - 1)))),
        lambda before: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(before, F.floor(i / STEP).cast("int")) + total(F.slice(lengths, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP))),
    )


def matches(text: Column, pattern: str) -> Column:
    """array<struct(start, end, span, before, after)> of all matches, in code points."""
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,span:string,before:string,after:string>>)")

    def place(x: Column) -> Column:
        return F.when(F.size(x["span"]) == 0, empty).otherwise(
            let(
                let(F.zip_with(x["gap"], x["span"], lambda g, s: F.length(g) + F.coalesce(F.length(s), F.lit(0))), lambda ls: _running(ls, F.size(x["span"]))),
                lambda at: F.transform(
                    x["span"],
                    lambda s, i: let(
                        F.get(at, i) + F.length(F.get(x["gap"], i)),
                        lambda start: F.struct(start.alias("start"), (start + F.length(s)).alias("end"), s.alias("span"), F.right(F.get(x["gap"], i), F.lit(NEAR)).alias("before"), F.left(F.get(x["gap"], i + 1), F.lit(NEAR)).alias("after")),
                    ),
                ),
            )
        )

    found = let(F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("span")), place)
    return F.when(F.length(text) > 0, F.coalesce(found, empty)).otherwise(empty)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _strict(kind: str, span: Column) -> Column:
    n = F.length(_digits(span))
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        return luhn(_digits(span))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "secret":
        return span.rlike("[0-9]") & span.rlike("[A-Za-z]")
    return F.lit(True)


def _listed(kind: str, span: Column) -> Column:
    """1, 0 or -1: what the gazetteer says."""
    yes = {
        "email": F.lower(F.regexp_extract(span, r"([A-Za-z0-9-]+)[\])]?$", 1)).isin(*DOMAINS),
        "ip": ~span.rlike(RESERVED),
        "card": _digits(span).rlike(ISSUERS),
        "phone": span.startswith("+") & _digits(span).rlike("^(?:" + "|".join(CALLING_CODES) + ")"),
        "secret": F.lit(False),
    }[kind]
    no = F.lit(-1) if kind in ("ip", "card") else F.lit(0)
    return F.when(yes, F.lit(1)).otherwise(no)


def _judged(found: Column, kind: str, base: bool) -> Column:
    """Candidates with the labelers' votes and shape."""

    def one(m: Column) -> Column:
        share = F.length(_digits(m["span"])) / F.length(m["span"])
        context = F.when(m["before"].rlike(CUES[kind]), 1).otherwise(0)
        listed = F.when(m["before"].rlike(KEY_WORDS), 1).otherwise(-1) if kind == "secret" else _listed(kind, m["span"])
        inside = m["before"].rlike(r"[A-Za-z0-9_]$") | m["after"].rlike(r"^[A-Za-z0-9_]")
        strict = _strict(kind, m["span"])
        return F.struct(
            m["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            m["end"].alias("end"),
            (strict & F.lit(base)).alias("base"),
            F.when(strict & F.lit(base), 1).when(strict, 0).otherwise(-1).alias("pattern"),
            listed.alias("listed"),
            context.alias("context"),
            F.when(inside, -1).otherwise(1).alias("edges"),
            F.least(F.floor(F.length(m["span"]) / 12), F.lit(3)).cast("int").alias("long"),
            F.least(F.floor(share * 4), F.lit(3)).cast("int").alias("digits"),
        )

    return F.transform(found, one)


NONE = "CAST(array() AS array<struct<start:int,kind:int,end:int,base:boolean,pattern:int,listed:int,context:int,edges:int,long:int,digits:int>>)"


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by start and then kind."""
    digit, at = text.rlike("[0-9]"), F.instr(text, "@") > 0
    spelled = text.rlike(r"[\[(][Aa][Tt][\])]")
    parts = [
        F.when(at, _judged(matches(text, EMAIL), "email", True)),
        F.when(spelled, _judged(matches(text, SPELLED_EMAIL), "email", False)),
        F.when(digit, _judged(matches(text, IP), "ip", True)),
        F.when(digit, _judged(matches(text, CARD), "card", True)),
        F.when(digit & (F.instr(text, "+") > 0), _judged(matches(text, PHONE), "phone", True)),
        F.when(digit, _judged(matches(text, LOCAL_PHONE), "phone", False)),
        F.when(digit, F.filter(_judged(matches(text, SECRET), "secret", False), lambda c: c["pattern"] >= 0)),
    ]
    return F.array_sort(F.concat(*[F.coalesce(p, F.expr(NONE)) for p in parts]))


LABELERS = ("pattern", "listed", "context", "edges")
SHAPE = ("long", "digits")


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier; reliabilities[(kind, labeler, vote)] = P(vote | real), P(vote | not)."""

    bias: tuple[float, ...]  # by kind
    weights: dict[str, float]
    reliabilities: dict[tuple[int, str, int], tuple[float, float]]


def proposed(docs: DataFrame, text_col: str = "text", out: str = "candidates") -> DataFrame:
    """``docs`` with all candidate spans of their texts, worked out once and written."""
    return cut(docs.withColumn(out, candidates(docs[text_col].cast("string"))))


def vote_counts(found: DataFrame, found_col: str = "candidates") -> DataFrame:
    """(kind, votes, shape, count): how often each pattern of votes occurs among the candidates of ``proposed``."""
    spans = found.select(F.explode(found_col).alias("c"))
    return spans.groupBy("c.kind", *[F.col(f"c.{x}") for x in (*LABELERS, *SHAPE)]).count()


def estimate(counts: Sequence[dict], rounds: int = 60, epochs: int = 400) -> SpanModel:
    """EM over vote patterns, then a logistic classifier of its posteriors. All on counts."""
    rows = sorted(counts, key=lambda r: tuple(r[x] for x in ("kind", *LABELERS, *SHAPE)))
    post = [0.0 if r["pattern"] < 0 else min(0.95, max(0.05, 0.5 + 0.15 * sum(r[x] for x in LABELERS))) for r in rows]
    table: dict[tuple[int, str, int], tuple[float, float]] = {}
    for _ in range(rounds):
        prior: dict[int, list[float]] = {}
        for r, p in zip(rows, post):
            s = prior.setdefault(r["kind"], [1.0, 1.0])
            s[0] += p * r["count"]
            s[1] += (1 - p) * r["count"]
        table = {}
        for kind, (yes, no) in prior.items():
            for name in LABELERS:
                # a weak prior belief that a vote for is likelier for real spans
                seen = {v: [2.0 + v, 2.0 - v] for v in (-1, 0, 1)}
                for r, p in zip(rows, post):
                    if r["kind"] == kind:
                        seen[r[name]][0] += p * r["count"]
                        seen[r[name]][1] += (1 - p) * r["count"]
                for v, (a, b) in seen.items():
                    table[kind, name, v] = (a / (yes + 4.0), b / (no + 4.0))
        new = []
        for r in rows:
            yes, no = prior[r["kind"]]
            if r["pattern"] < 0:  # a failed checksum, digit count or part range is no doubtful case
                new.append(0.0)
                continue
            z = math.log(yes / no)
            for name in LABELERS:
                a, b = table[r["kind"], name, r[name]]
                z += math.log(a / b)
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        post = new
    names = [*LABELERS, *SHAPE]
    bias, w = [0.0] * len(KINDS), dict.fromkeys(names, 0.0)
    total = sum(math.log1p(r["count"]) for r in rows) or 1.0
    for _ in range(epochs):
        gb, gw = [0.01 * b for b in bias], {k: 0.01 * v for k, v in w.items()}
        for r, p in zip(rows, post):
            z = bias[r["kind"]] + sum(w[k] * r[k] for k in names)
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * math.log1p(r["count"]) / total
            gb[r["kind"]] += g
            for k in names:
                gw[k] += g * r[k]
        bias = [b - 1.0 * g for b, g in zip(bias, gb)]
        w = {k: w[k] - 1.0 * gw[k] for k in names}
    return SpanModel(tuple(bias), w, table)


def fit(found: DataFrame, found_col: str = "candidates") -> SpanModel:
    """The model of the candidates of ``proposed``."""
    return estimate([r.asDict() for r in vote_counts(found, found_col).collect()])


def _kept(c: Column, model: SpanModel) -> Column:
    z = F.element_at(F.array(*map(F.lit, model.bias)), c["kind"] + 1)
    for name, weight in model.weights.items():
        z = z + F.lit(weight) * c[name]
    return c["base"] | ((c["pattern"] >= 0) & (z >= 0))


def decided(found: Column, model: SpanModel) -> Column:
    """The spans among candidates: array<struct(start, kind, end, base)>, kind an index into KINDS."""
    return F.transform(F.filter(found, lambda c: _kept(c, model)), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base")))


def listing(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or run of spans that overlap, replaced by its kind in angle brackets."""
    name = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(name, s["kind"] + 1)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["parts"]).alias("parts"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data taken out of its texts, by a model of their own candidates."""
    (name,) = fresh(docs, "candidates")
    found = proposed(docs, text_col, name)
    spans = decided(F.col(name), fit(found, name))
    return found.withColumn(text_col, let(spans, lambda s: redacted(F.col(text_col), s))).drop(name)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_<base kind>, base_sha256, spans, n_added): counts and hash of the base spans, all spans."""
    found = cut(docs.select(F.col(id_col).alias("doc_id"), candidates(F.col(text_col).cast("string")).alias("candidates")))
    found = found.select("doc_id", decided(F.col("candidates"), fit(found)).alias("found"))
    found = found.select("doc_id", "found", F.filter("found", lambda s: s["base"]).alias("base"))

    def of(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    n = [of(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    return found.select("doc_id", *n, F.sha2(listing(F.col("base")).cast("binary"), 256).alias("base_sha256"), listing(F.col("found")).alias("spans"), (F.size("found") - F.size("base")).cast("long").alias("n_added"))
