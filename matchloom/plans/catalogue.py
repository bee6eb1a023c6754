"""The queries of the engine over the driver's tables, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchloom.functions import scores, text
from matchloom.operators import blocks, gain, graph, metrics, ranking, retrieval, scoring, selection
from matchloom.plans import views
from matchloom.plans.surrogate import Surrogate
from matchloom.plans.views import PART_COLUMNS, with_views
from matchloom.sources import entities
from matchloom.sources.shared import cut, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- metrics -----------------------------------------------------------------------------------


@query("metric_prf", """
SELECT round(coalesce(tp / nullif(tp + fp, 0), 0) * 100, 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0) * 100, 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * 100, 6) AS f1
FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp,
             count(*) FILTER (quality = 1 AND toxic <> 1) AS fn FROM labels)""")
def metric_prf(spark: SparkSession, d: str) -> DataFrame:
    p, r, f = metrics.precision_recall_f1(F.col("quality"), F.col("toxic"))
    return table(spark, d, "labels").agg(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


WEIGHTED = with_views("labelled") + """,
sums AS (
  SELECT coalesce(sum(weight) FILTER (label > 0.5), 0) AS positives,
         coalesce(sum(weight) FILTER (label = 1 AND prob > 0.5), 0) AS tp1, coalesce(sum(weight) FILTER (prob > 0.5), 0) AS said1, coalesce(sum(weight) FILTER (label = 1), 0) AS true1,
         coalesce(sum(weight) FILTER (label = 0 AND NOT prob > 0.5), 0) AS tp0, coalesce(sum(weight) FILTER (NOT prob > 0.5), 0) AS said0, coalesce(sum(weight) FILTER (label = 0), 0) AS true0
  FROM labelled),
picked AS (SELECT CASE WHEN positives > 0 THEN tp1 ELSE tp0 END AS tp, CASE WHEN positives > 0 THEN said1 ELSE said0 END AS said, CASE WHEN positives > 0 THEN true1 ELSE true0 END AS true_ FROM sums),
rates AS (SELECT tp / (said + 1e-6::DOUBLE) AS pre, tp / (true_ + 1e-6::DOUBLE) AS rec FROM picked),
scored AS (SELECT pre, rec, 2 * pre * rec / (pre + rec + 1e-6::DOUBLE) AS f1 FROM rates)
SELECT round({score}, 9) AS score, round(pre, 9) AS precision, round(rec, 9) AS recall, round(f1, 9) AS f1 FROM scored"""


def _weighted(metric: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = metrics.weighted_f1(F.col("label"), F.col("prob"), F.col("weight"), metric)
        return views.labelled(spark, d).agg(*out).select(*[F.round(c, 9).alias(c) for c in ("score", "precision", "recall", "f1")])

    return run


query("metric_weighted_f1", WEIGHTED.replace("{score}", "f1"))(_weighted("f1"))
query("metric_f1_v2", WEIGHTED.replace("{score}", "f1 / 2 + least(pre, rec) / 2"))(_weighted("f1_v2"))


@query("metric_acc", with_views("labelled") + """,
rates AS (
  SELECT coalesce(sum(weight) FILTER ((label > 0.5) = (prob > 0.5)) / sum(weight)::DOUBLE, 1.0) AS every,
         coalesce(coalesce(sum(weight) FILTER (label > 0.5 AND prob > 0.5), 0) / sum(weight) FILTER (label > 0.5)::DOUBLE, 1.0) AS pos,
         coalesce(coalesce(sum(weight) FILTER (label <= 0.5 AND prob <= 0.5), 0) / sum(weight) FILTER (label <= 0.5)::DOUBLE, 1.0) AS neg
  FROM labelled)
SELECT round(CASE WHEN pos = 0 THEN 0 ELSE every / 2 + least(pos, neg) / 2 END, 9) AS score, round(pos, 9) AS pos, round(neg, 9) AS neg FROM rates""")
def metric_acc(spark: SparkSession, d: str) -> DataFrame:
    out = views.labelled(spark, d).agg(*metrics.weighted_accuracy(F.col("label"), F.col("prob"), F.col("weight")))
    return out.select(*[F.round(c, 9).alias(c) for c in ("score", "pos", "neg")])


CERTAINTY = """certain AS (
  SELECT coalesce(avg(greatest(prob, 1 - prob)), 1.0) AS conf_all, coalesce(avg(prob) FILTER (prob > 0.5), 1.0) AS conf_pos,
         coalesce(avg(1 - prob) FILTER (prob < 0.5), 1.0) AS conf_neg FROM probs)"""


@query("certainty_score", with_views("pairs") + ",\n" + CERTAINTY + """
SELECT round(conf_all / 2 + least(conf_pos, conf_neg) / 2, 9) AS certainty, round(conf_all, 9) AS conf_all, round(conf_pos, 9) AS conf_pos, round(conf_neg, 9) AS conf_neg FROM certain""")
def certainty_score(spark: SparkSession, d: str) -> DataFrame:
    out = views.probs(spark, d).agg(*metrics.certainty(F.col("prob")))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("info_score", with_views("pairs") + ",\n" + CERTAINTY + """,
sums AS (SELECT sum(w) FILTER (label = 1 AND prob > 0.5) AS tp, sum(w) FILTER (prob > 0.5) AS said, sum(w) FILTER (label = 1) AS true_ FROM (SELECT *, 1 + id % 3 AS w FROM probs)),
rates AS (SELECT coalesce(tp, 0) / (coalesce(said, 0) + 1e-6::DOUBLE) AS pre, coalesce(tp, 0) / (true_ + 1e-6::DOUBLE) AS rec FROM sums)
SELECT round(0.5 * (conf_all / 2 + least(conf_pos, conf_neg) / 2) + 2 * pre * rec / (pre + rec + 1e-6::DOUBLE), 9) AS info FROM certain, rates""")
def info_score(spark: SparkSession, d: str) -> DataFrame:
    return views.probs(spark, d).agg(F.round(metrics.info(F.col("label"), F.col("prob"), 1 + F.col("id") % 3), 9).alias("info"))


@query("prob_histogram", with_views("pairs") + " SELECT label, least(floor(prob * 20), 19)::INTEGER AS bin, count(*) AS n FROM probs GROUP BY ALL")
def prob_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(views.probs(spark, d), "label", "prob")


@query("report_pivot", """
WITH r AS (
  SELECT lang AS dataset, unnest([{'m': 'short', 'p': (n_chars < 1000)::INTEGER}, {'m': 'clean', 'p': 1 - toxic}]) AS x, quality AS label
  FROM documents JOIN labels USING (doc_id)),
f AS (
  SELECT dataset, x.m AS model, count(*) FILTER (label = 1 AND x.p = 1) AS tp, count(*) FILTER (label <> 1 AND x.p = 1) AS fp, count(*) FILTER (label = 1 AND x.p <> 1) AS fn
  FROM r GROUP BY ALL),
g AS (SELECT dataset, model, printf('%.2f', round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * 100, 2)) AS f1 FROM f)
SELECT dataset, coalesce(max(f1) FILTER (model = 'short'), '--') AS short, coalesce(max(f1) FILTER (model = 'clean'), '--') AS clean FROM g GROUP BY dataset""")
def report_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    preds = F.array(F.struct(F.lit("short").alias("m"), (F.col("n_chars") < 1000).cast("int").alias("p")), F.struct(F.lit("clean").alias("m"), (1 - F.col("toxic")).cast("int").alias("p")))
    long = rows.select(F.col("lang").alias("dataset"), F.col("quality").alias("label"), F.explode(preds).alias("x")).select("dataset", "label", F.col("x.m").alias("model"), F.col("x.p").alias("pred"))
    return metrics.report(long, "dataset", "model", "label", "pred", ["short", "clean"])


# ---- vectors -----------------------------------------------------------------------------------


@query("pair_cosine", with_views("pairs") + " SELECT id, round(list_dot_product(vec, other) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(other, other))), 9) AS cosine FROM pairs")
def pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    return views.pairs(spark, d).select("id", F.round(scores.cosine(F.col("vec"), F.col("other")), 9).alias("cosine"))


@query("diff_embedding", with_views("pairs") + " SELECT id, round(list_sum(list_transform(list_zip(vec, other), lambda x: abs(x[1] - x[2]))), 6) AS l1, len(vec)::INTEGER AS dims FROM pairs")
def diff_embedding(spark: SparkSession, d: str) -> DataFrame:
    diff = scores.difference(F.col("vec"), F.col("other"))
    return views.pairs(spark, d).select("id", F.round(F.aggregate(diff, F.lit(0.0), lambda a, x: a + x), 6).alias("l1"), F.size(diff).alias("dims"))


def _sim(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = cut(blocks.vectors(views.embeddings(spark, d), "id", "vec", kind == "cosine"))
        return blocks.similarity_summary(rows, kind).select("id", F.round("top", 6).alias("top"), F.round("total", 6).alias("total"))

    return run


SIM_SQL = with_views("sims") + """,
dist AS (SELECT a.id AS i, b.id AS j, {measure} AS x FROM {rows} a CROSS JOIN {rows} b),
s AS (SELECT i, j, {sim} AS s FROM dist)
SELECT i AS id, round(max(s) FILTER (i <> j), 6) AS top, round(sum(s), 6) AS total FROM s GROUP BY i"""
query("sim_cosine", SIM_SQL.format(measure="list_dot_product(a.v, b.v)", sim="x", rows="unit"))(_sim("cosine"))
query("sim_l1", SIM_SQL.format(measure="list_sum(list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2])))", sim="1 - x / max(x) OVER ()", rows="vectors"))(_sim("l1"))
query("sim_l2", SIM_SQL.format(measure="list_distance(a.v, b.v)", sim="1 - x / max(x) OVER ()", rows="vectors"))(_sim("l2"))


@query("sim_pairdiff", with_views("pairs") + """,
dist AS (SELECT a.id AS i, b.id AS j, abs(a.score - b.score) AS x FROM pairs a CROSS JOIN pairs b),
s AS (SELECT i, j, 1 - x / max(x) OVER () AS s FROM dist)
SELECT i AS id, round(max(s) FILTER (i <> j), 6) AS top, round(sum(s), 6) AS total FROM s GROUP BY i""")
def sim_pairdiff(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(views.pairs(spark, d).select("id", F.array("score").alias("vec")))
    return blocks.summary(rows, blocks.similarity(rows, "l1")).select("id", F.round("top", 6).alias("top"), F.round("total", 6).alias("total"))


RANKED = "ranked AS (SELECT i, j, round(sim, 9) AS sim, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j) AS rank FROM sims)"


@query("knn_votes_150", with_views("sims") + f",\n{RANKED} SELECT j AS target, count(*) AS votes FROM ranked WHERE rank <= 150 AND i <> j GROUP BY j")
def knn_votes_150(spark: SparkSession, d: str) -> DataFrame:
    return graph.vote_counts(selection.vote_edges(views.embeddings(spark, d), 150)).select("target", "votes")


@query("knn_votes_15", with_views("sims") + f",\n{RANKED} SELECT j AS target, count(*) AS votes FROM ranked WHERE rank BETWEEN 2 AND 16 GROUP BY j")
def knn_votes_15(spark: SparkSession, d: str) -> DataFrame:
    return graph.vote_counts(selection.vote_edges(views.embeddings(spark, d), 15, skip_first=True)).select("target", "votes")


DISTS = "dists AS (SELECT a.id AS i, b.id AS j, round(list_distance(a.v, b.v), 9) AS x FROM vectors a CROSS JOIN vectors b)"


@query("threshold_graph", with_views("sims") + f",\n{DISTS} SELECT i AS id, count(*) AS degree FROM dists WHERE x <= (SELECT quantile_cont(x, 0.1) FROM dists) GROUP BY i")
def threshold_graph(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(blocks.vectors(views.embeddings(spark, d), "id", "vec"))
    return blocks.threshold_degrees(rows, 0.1)[1]


# ---- probabilities -----------------------------------------------------------------------------


@query("voronoi_weights", with_views("pairs") + """,
cand AS (SELECT id, prob, lag(prob) OVER (ORDER BY prob, id) AS a, lead(prob) OVER (ORDER BY prob, id) AS b FROM probs WHERE label = 1),
bounds AS (SELECT id, coalesce((a + prob) / 2, 0) AS lo, coalesce((prob + b) / 2, 1) AS hi FROM cand)
SELECT b.id, count(p.id) AS weight FROM bounds b LEFT JOIN probs p ON p.prob >= b.lo AND p.prob < b.hi GROUP BY b.id""")
def voronoi_weights(spark: SparkSession, d: str) -> DataFrame:
    probs = cut(views.probs(spark, d))
    return metrics.cell_weights(probs, "prob", metrics.cell_bounds(probs.where("label = 1"), "id", "prob"))


@query("recency_reps", with_views("pairs") + " SELECT id, round(prob * 0.125, 13) AS r0, round(prob * prob * 0.25, 13) AS r1, round(prob * prob * prob * 0.5, 13) AS r2 FROM probs")
def recency_reps(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("prob")
    return views.probs(spark, d).select("id", *[F.round(scores.recency_weight(x, F.lit(k), 3), 13).alias(f"r{k}") for k, x in enumerate((p, p * p, p * p * p))])


WALK = """,
high AS (SELECT id, label, 0 AS side, coalesce(sum((label = 1)::INTEGER) OVER (ORDER BY score DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, row_number() OVER (ORDER BY score DESC, id DESC) AS pos_ FROM walked),
low AS (SELECT id, label, 1 AS side, coalesce(sum((label = 0)::INTEGER) OVER (ORDER BY score, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, row_number() OVER (ORDER BY score, id) AS pos_ FROM walked),
placed AS (SELECT *, row_number() OVER (ORDER BY run, side, pos_) AS g FROM (SELECT * FROM high UNION ALL SELECT * FROM low) x),
firsts AS (SELECT id, any_value(label) AS label, min(g) AS g FROM placed GROUP BY id),
chosen AS (SELECT row_number() OVER (ORDER BY g)::INTEGER AS rank, id, label FROM firsts)"""


@query("walk_by_score", with_views("pairs") + ", walked AS (SELECT id, label, score FROM probs)" + WALK + " SELECT rank, id, label FROM chosen WHERE rank <= 20")
def walk_by_score(spark: SparkSession, d: str) -> DataFrame:
    return selection.cosine_extremes(views.probs(spark, d), 20)


@query("walk_by_prob", with_views("pairs") + ", walked AS (SELECT id, label, prob AS score FROM probs)" + WALK + " SELECT rank, id, label FROM chosen WHERE rank <= 20")
def walk_by_prob(spark: SparkSession, d: str) -> DataFrame:
    return selection.min_entropy_balanced(views.probs(spark, d), 20)


ENTROPY = "-(c * ln(c) + (1 - c) * ln(1 - c))"


@query("max_entropy", with_views("pairs") + f""",
h AS (SELECT id, round({ENTROPY}, 9) AS entropy FROM (SELECT id, greatest(least(prob, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) AS c FROM probs)),
r AS (SELECT row_number() OVER (ORDER BY entropy DESC, id)::INTEGER AS rank, id, entropy FROM h) SELECT * FROM r WHERE rank <= 50""")
def max_entropy(spark: SparkSession, d: str) -> DataFrame:
    return selection.max_entropy(views.probs(spark, d), 50)


@query("calibrated_ig", with_views("pairs") + f""",
a AS (SELECT id, greatest(least(prob, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) AS p FROM probs),
b AS (SELECT id, p / 0.4::DOUBLE AS x, (1 - p) / 0.6::DOUBLE AS y FROM a),
q AS (SELECT id, exp(x - least(x, y)) / (exp(x - least(x, y)) + exp(y - least(x, y))) AS q FROM b),
h AS (SELECT id, round({ENTROPY}, 9) AS entropy FROM (SELECT id, greatest(least(q, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) AS c FROM q)),
r AS (SELECT row_number() OVER (ORDER BY entropy, id)::INTEGER AS rank, id, entropy FROM h) SELECT * FROM r WHERE rank <= 50""")
def calibrated_ig(spark: SparkSession, d: str) -> DataFrame:
    return selection.calibrated_gain(views.probs(spark, d), 0.4, 50)


@query("uncertain_half", with_views("pairs") + """,
r AS (SELECT id, greatest(prob, 1 - prob) AS conf, row_number() OVER (ORDER BY greatest(prob, 1 - prob), id) AS place FROM probs)
SELECT id, conf, place FROM r WHERE place <= (SELECT count(*) // 2 FROM probs)""")
def uncertain_half(spark: SparkSession, d: str) -> DataFrame:
    return selection.uncertain_half(cut(views.probs(spark, d)))


@query("confidence_bins", with_views("pairs") + " SELECT id, (row_number() OVER (ORDER BY greatest(prob, 1 - prob), id) - 1) // 25 AS bin FROM probs")
def confidence_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = views.probs(spark, d).select("id", scores.confidence(F.col("prob")).alias("conf"))
    return metrics.ranked_bins(rows, [F.asc("conf"), F.asc("id")], 25).select("id", "bin")


@query("equal_width_bins", with_views("pairs") + """,
b AS (SELECT min(score) AS lo, max(score) AS hi FROM probs)
SELECT id, greatest(0, least(9, ceil((score - lo) / (hi - lo) * 10) - 1))::INTEGER AS bin FROM probs, b""")
def equal_width_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(views.probs(spark, d))
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    return rows.select("id", metrics.equal_width_bin(F.col("score"), F.lit(low), F.lit(high), 10).alias("bin"))


# ---- retrieval ---------------------------------------------------------------------------------

RETRIEVED = with_views("pairs") + ", walked AS (SELECT id, label, score FROM probs)" + WALK + """,
examples AS (SELECT c.id AS example_id, c.label, p.vec FROM chosen c JOIN pairs p USING (id) WHERE rank <= 40),
counts AS (SELECT least(10, count(*)) AS k, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM examples),
scored AS (SELECT t.id AS test_id, e.example_id, e.label, round(list_dot_product(t.vec, e.vec), 9) AS sim FROM pairs t CROSS JOIN examples e),
numbered AS (SELECT *, row_number() OVER (PARTITION BY test_id, label ORDER BY sim DESC, example_id) AS rn FROM scored),
retrieved AS (
  SELECT n.* FROM numbered n, counts
  WHERE n.rn <= CASE WHEN n.label = 1 THEN greatest(k // 2, k - neg) ELSE greatest(k - k // 2, k - pos) END)"""


def _retrieved(spark: SparkSession, d: str) -> DataFrame:
    pairs = cut(views.pairs(spark, d).select("id", "label", "score", "vec"))
    chosen = cut(selection.cosine_extremes(pairs, 40))
    examples = chosen.join(pairs.select("id", "vec"), "id").select(F.col("id").alias("example_id"), "vec", "label")
    return retrieval.balanced(pairs.select(F.col("id").alias("test_id"), "vec"), examples, 10)


@query("balanced_retrieval", RETRIEVED + " SELECT test_id, example_id, label, sim, rn::INTEGER AS rn FROM retrieved")
def balanced_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(spark, d).select("test_id", "example_id", "label", "sim", F.col("rn").cast("int").alias("rn"))


ORDERED = RETRIEVED + """,
placed2 AS (SELECT *, row_number() OVER (PARTITION BY test_id, label ORDER BY sim, example_id DESC) AS place,
                   least(count(*) FILTER (label = 1) OVER (PARTITION BY test_id), count(*) FILTER (label = 0) OVER (PARTITION BY test_id)) AS least_ FROM retrieved)
SELECT test_id, string_agg(example_id::VARCHAR, ',' ORDER BY {order}) AS examples FROM placed2 {where} GROUP BY test_id"""


def _ordered(order: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        placed = retrieval.ordered(_retrieved(spark, d), order)
        return placed.groupBy("test_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "example_id"))), lambda s: s["example_id"].cast("string")), ",").alias("examples"))

    return run


query("example_order_o1", ORDERED.format(order="place, label DESC", where="WHERE place <= least_"))(_ordered("o1"))
query("example_order_o2", ORDERED.format(order="place, label", where="WHERE place <= least_"))(_ordered("o2"))
query("example_order_o6", ORDERED.format(order="sim, example_id DESC", where=""))(_ordered("o6"))
query("example_order_o7", ORDERED.format(order="sim DESC, example_id", where=""))(_ordered("o7"))


# ---- text --------------------------------------------------------------------------------------


def _shown(side: str, c: str, missing: str = "NULL") -> str:
    return f"coalesce({side}_{c}, '{missing}')"


def _style_sql(style: str) -> str:
    cols = PART_COLUMNS
    framed = lambda a, b: f"'Product A is \"' || {a} || '\". Product B is \"' || {b} || '\". '"
    join = lambda xs, sep="', '": f"concat_ws({sep}, {', '.join(xs)})"
    named = lambda s: join([f"'{c}: ' || {_shown(s, c)}" for c in cols])
    some = lambda s, names, both: join([f"CASE WHEN {'a_' + c + ' IS NOT NULL AND b_' + c if both else s + '_' + c} IS NOT NULL THEN {chr(39) + c + ': ' + chr(39) + ' || ' if names else ''}{s}_{c} END" for c in cols])
    told = lambda s: join([f"'its {c} is ' || {_shown(s, c, 'missing')}" for c in cols])
    tab, line = "chr(9)", "chr(10)"
    rows = [join([f"'Product {s.upper()}'", *[_shown(s, c) for c in cols]], tab) for s in "ab"]
    return {
        "s1": framed(named("a"), named("b")),
        "s2": framed(join([_shown("a", c) for c in cols]), join([_shown("b", c) for c in cols])),
        "s3": f"'For Product A, ' || {told('a')} || '. For Product B, ' || {told('b')} || '. '",
        "s4": "'For Product A and Product B, ' || " + join([f"'their {c} are ' || {_shown('a', c, 'missing')} || ' and ' || {_shown('b', c, 'missing')}" for c in cols]) + " || '. '",
        "s5": join([join(["'Entry'", "'Product A'", "'Product B'"], tab), *[join([f"'{c}'", _shown("a", c), _shown("b", c)], tab) for c in cols]], line),
        "s6": join([join(["'Entry'", *[f"'{c}'" for c in cols]], tab), *rows], line),
        "s7": framed(some("a", True, False), some("b", True, False)),
        "s8": framed(some("a", False, False), some("b", False, False)),
        "s9": framed(some("a", True, True), some("b", True, True)),
        "s10": framed(some("a", False, True), some("b", False, True)),
        "s11": join(rows, line),
    }[style]


def _style(style: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        form = text.PairFormat(PART_COLUMNS, text.as_strings(PART_COLUMNS, "a_"), text.as_strings(PART_COLUMNS, "b_"), numeric=("size",))
        return views.part_pairs(spark, d).select("pair_id", form.write(style).alias("text"))

    return run


for _k in range(1, 12):
    query(f"serialize_s{_k}", with_views("parts") + f" SELECT pair_id, {_style_sql(f's{_k}')} AS text FROM part_pairs")(_style(f"s{_k}"))


@query("encoder_text", with_views("parts") + " SELECT pair_id, 'Entry A is ' || " + " || ', ' || ".join(f"'{c}: ' || coalesce(a_{c}, 'nan')" for c in PART_COLUMNS) + " || '. Entry B is ' || " + " || ', ' || ".join(f"'{c}: ' || coalesce(b_{c}, 'nan')" for c in PART_COLUMNS) + " || '. Are Entry A and Entry B the same?' AS text FROM part_pairs")
def encoder_text(spark: SparkSession, d: str) -> DataFrame:
    a, b = [text.encoder_text(PART_COLUMNS, text.as_strings(PART_COLUMNS, s)) for s in ("a_", "b_")]
    return views.part_pairs(spark, d).select("pair_id", text.encoder_pair_text(a, b, "Are Entry A and Entry B the same?").alias("text"))


@query("long_text", r"""SELECT doc_id, md5(CASE WHEN len(string_split(trim(regexp_replace(text, '[\s\x{a0}]+', ' ', 'g')), ' ')) > 100 THEN split_part(text, '.', 1) ELSE text END) AS digest FROM documents""")
def long_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.shorten(F.col("text")).cast("binary")).alias("digest"))


@query("wdc_clean", r"SELECT doc_id, md5(trim(regexp_replace(replace('COL title VAL ' || text, 'COL title VAL ', ''), '\s+', ' ', 'g'))) AS digest FROM documents")
def wdc_clean(spark: SparkSession, d: str) -> DataFrame:
    value = text.clean_marked_title(F.concat(F.lit(text.MARKER), F.col("text")))[0]
    return table(spark, d, "documents").select("doc_id", F.md5(value.cast("binary")).alias("digest"))


@query("answer_parse", "SELECT conv_id, turn, CASE WHEN contains(a, 'yes') AND contains(a, 'no') THEN (instr(a, 'yes') < instr(a, 'no'))::INTEGER ELSE (NOT contains(a, 'no'))::INTEGER END AS pred FROM (SELECT conv_id, turn, trim(lower(text)) AS a FROM conversations)")
def answer_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", scores.answer_class(F.col("text")).alias("pred"))


@query("cot_parse", r"""
WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(lower(text)) || ' same different same' ELSE trim(lower(text)) || ' therefore, the answer is no' END AS a FROM conversations),
w AS (SELECT *, string_split(trim(regexp_replace(a, '\s+', ' ', 'g')), ' ') AS w FROM a)
SELECT conv_id, turn, (CASE WHEN contains(a, 'therefore, the answer is') THEN NOT contains(w[-1], 'no') ELSE len(list_filter(w, lambda x: x = 'different')) <= len(list_filter(w, lambda x: x = 'same')) END)::INTEGER AS pred FROM w""")
def cot_parse(spark: SparkSession, d: str) -> DataFrame:
    base = F.trim(F.lower("text"))
    answer = F.when(F.col("turn") % 2 == 0, F.concat(base, F.lit(" same different same"))).otherwise(F.concat(base, F.lit(" therefore, the answer is no")))
    return table(spark, d, "conversations").select("conv_id", "turn", scores.reasoned_class(answer).alias("pred"))


@query("token_prob", """
WITH t AS (SELECT DISTINCT conv_id, turn, unnest(string_split(lower(text) || ' yes', ' ')) AS token FROM conversations),
s AS (SELECT *, len(token)::DOUBLE / 4 AS score FROM t),
y AS (SELECT conv_id, turn, max({'score': score, 'token': token}) AS y FROM s WHERE contains(token, 'yes') GROUP BY ALL),
n AS (SELECT s.conv_id, s.turn, max(s.score) AS n FROM s LEFT JOIN y USING (conv_id, turn) WHERE contains(s.token, 'no') AND (y.y IS NULL OR s.token <> y.y.token) GROUP BY ALL),
c AS (SELECT DISTINCT conv_id, turn FROM conversations)
SELECT c.conv_id, c.turn, round(exp(y.y.score - least(y.y.score, n.n)) / (exp(y.y.score - least(y.y.score, n.n)) + exp(n.n - least(y.y.score, n.n))), 9) AS prob
FROM c LEFT JOIN y USING (conv_id, turn) LEFT JOIN n USING (conv_id, turn)""")
def token_prob(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.array_distinct(F.split(F.concat(F.lower("text"), F.lit(" yes")), " "))
    rows = table(spark, d, "conversations").withColumn("tokens", tokens)
    return rows.select("conv_id", "turn", F.round(scores.token_probability(F.map_from_arrays("tokens", F.transform("tokens", lambda t: F.length(t) / 4))), 9).alias("prob"))


# ---- joins -------------------------------------------------------------------------------------


@query("blacklist_pairs", """
SELECT p_brand, s_nationkey, count(*) AS n, sum(l_quantity) AS quantity
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_acctbal < 0 AND b.s_suppkey = l_suppkey) GROUP BY ALL""")
def blacklist_pairs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ltable_id"), F.col("l_partkey").alias("rtable_id"), "l_quantity")
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    black = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("ltable_id"))
    joined = entities.assemble(lines, a, b, black)
    return joined.groupBy(F.col("b_p_brand").alias("p_brand"), F.col("a_s_nationkey").alias("s_nationkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("null_rate_columns", with_views("parts") + """,
n AS (SELECT count(*) AS n, """ + ", ".join(f"count(*) FILTER (a_{c} IS NULL OR b_{c} IS NULL) AS {c}" for c in PART_COLUMNS) + """ FROM part_pairs)
SELECT x.c AS column_name, x.v AS nulls, x.v < 0.2 * n AS kept FROM (SELECT n, unnest([""" + ", ".join(f"{{'c': '{c}', 'v': {c}}}" for c in PART_COLUMNS) + """]) AS x FROM n)""")
def null_rate_columns(spark: SparkSession, d: str) -> DataFrame:
    return metrics.null_shares(views.part_pairs(spark, d), PART_COLUMNS)


# ---- selectors ---------------------------------------------------------------------------------


def _facility_sql(rows: str, sim: str, steps: int = 3) -> str:
    out = f"{rows}, m AS (SELECT i, j, {sim} AS s FROM base), b0 AS (SELECT DISTINCT j, -1.0::DOUBLE AS best FROM m)"
    for k in range(1, steps + 1):
        skip = "".join(f" AND i <> (SELECT i FROM p{q})" for q in range(1, k))
        out += f",\np{k} AS (SELECT i, round(sum(greatest(s - best, 0)), 6) AS gain FROM m JOIN b{k - 1} USING (j) WHERE true{skip} GROUP BY i ORDER BY gain DESC, i LIMIT 1)"
        out += f",\nb{k} AS (SELECT j, greatest(best, s) AS best FROM b{k - 1} JOIN m USING (j) WHERE i = (SELECT i FROM p{k}))"
    return out + "\n" + " UNION ALL ".join(f"SELECT {k}::INTEGER AS rank, i AS id, gain FROM p{k}" for k in range(1, steps + 1))


@query("facility_location_3", _facility_sql(with_views("sims") + ", base AS (SELECT i, j, sim FROM sims)", "sim"))
def facility_location_3(spark: SparkSession, d: str) -> DataFrame:
    return selection.facility_location(views.embeddings(spark, d), 3)


@query("facility_location_1d", _facility_sql(with_views("pairs") + ", base AS (SELECT a.id AS i, b.id AS j, sqrt((a.score - b.score) * (a.score - b.score)) AS x FROM pairs a CROSS JOIN pairs b)", "1 - x / max(x) OVER ()"))
def facility_location_1d(spark: SparkSession, d: str) -> DataFrame:
    return selection.facility_sample(views.pairs(spark, d).select("id", F.array("score").alias("vec")), 3)


def _vote_sql(edges: str, drop: bool, steps: int = 3) -> str:
    out = edges + ", orders AS (SELECT target, count(*) AS votes, min({'s': supporter, 'r': rank}) AS seen FROM e GROUP BY target), t0 AS (SELECT DISTINCT supporter, 0 AS times FROM e)"
    for k in range(1, steps + 1):
        past = [f"(SELECT target FROM p{q})" for q in range(1, k)]
        own = "".join(f" AND target <> {x}" for x in past)
        sup = "".join(f" AND supporter <> {x}" for x in past) if drop else ""
        out += f",\ns{k} AS (SELECT target, round(sum(pow(10.0::DOUBLE, -times)), 9) AS score FROM e JOIN t{k - 1} USING (supporter) WHERE true{own}{sup} GROUP BY target)"
        out += f",\np{k} AS (SELECT target, coalesce(score, 0) AS score FROM orders LEFT JOIN s{k} USING (target) WHERE true{own} ORDER BY coalesce(score, 0) DESC, votes DESC, seen LIMIT 1)"
        out += f",\nt{k} AS (SELECT supporter, times + (supporter IN (SELECT supporter FROM e WHERE target = (SELECT target FROM p{k})))::INTEGER AS times FROM t{k - 1})"
    return out + "\n" + " UNION ALL ".join(f"SELECT {k}::INTEGER AS rank, target AS id, score FROM p{k}" for k in range(1, steps + 1))


@query("fast_votek_3", _vote_sql(with_views("sims") + f",\n{RANKED}, e AS (SELECT i AS supporter, j AS target, rank FROM ranked WHERE rank <= 150 AND i <> j)", True))
def fast_votek_3(spark: SparkSession, d: str) -> DataFrame:
    return selection.fast_votek(views.embeddings(spark, d), 3)


@query("egonet_cover_3", _vote_sql(with_views("sims", "pairs") + f""",
{RANKED}, half AS (SELECT id FROM probs QUALIFY row_number() OVER (ORDER BY greatest(prob, 1 - prob), id) <= (SELECT count(*) // 2 FROM probs)),
e AS (SELECT i AS supporter, j AS target, rank FROM ranked WHERE rank BETWEEN 2 AND 16 AND i IN (SELECT id FROM half))""", False))
def egonet_cover_3(spark: SparkSession, d: str) -> DataFrame:
    edges = selection.vote_edges(views.embeddings(spark, d), 15, skip_first=True)
    chosen = graph.greedy_votes(graph.egonets(edges, selection.uncertain_half(cut(views.probs(spark, d)))), 3, drop_chosen_supporters=False)
    return spark.createDataFrame([(k + 1, i, s) for k, (i, s) in enumerate(chosen)], "rank int, id long, score double")


def _cover_sql(steps: int = 4) -> str:
    out = with_views("sims") + f",\n{DISTS}, e AS (SELECT i, j FROM dists WHERE x <= 1.2), c0 AS (SELECT j FROM e WHERE false)"
    for k in range(1, steps + 1):
        out += f",\np{k} AS (SELECT i, count(*) AS gain FROM e WHERE j NOT IN (SELECT j FROM c{k - 1}) AND i NOT IN (SELECT j FROM c{k - 1}) GROUP BY i ORDER BY gain DESC, i LIMIT 1)"
        out += f",\nc{k} AS (SELECT j FROM c{k - 1} UNION SELECT j FROM e WHERE i = (SELECT i FROM p{k}))"
    return out + "\n" + " UNION ALL ".join(f"SELECT {k}::INTEGER AS rank, i AS id FROM p{k}" for k in range(1, steps + 1))


@query("coverage_greedy", _cover_sql())
def coverage_greedy(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(blocks.vectors(views.embeddings(spark, d), "id", "vec"))
    chosen, _ = graph.greedy_cover(blocks.within(rows, blocks.l2_distances_9, 1.2), [], 4)
    return spark.createDataFrame([(k + 1, i) for k, i in enumerate(chosen)], "rank int, id long")


@query("difficulty_order", with_views("pairs") + """,
k AS (SELECT id, label, prob, (label = 1) <> (prob > 0.5) AS wrong FROM probs),
r AS (SELECT *, row_number() OVER (PARTITION BY wrong, label ORDER BY CASE WHEN label = 1 THEN prob ELSE -prob END, id) - 1 AS rank,
             count(*) FILTER (label = 1) OVER (PARTITION BY wrong) AS pos, count(*) FILTER (label = 0) OVER (PARTITION BY wrong) AS neg FROM k),
m AS (SELECT *, CASE WHEN label = 1 THEN pos ELSE neg END AS mine, CASE WHEN label = 1 THEN neg ELSE pos END AS other FROM r),
t AS (SELECT *, least(round_even((mine + other)::DOUBLE / nullif(least(mine, other), 0), 0), 3)::BIGINT AS rate, mine < other OR (mine = other AND label = 1) AS short FROM m)
SELECT id, wrong, CASE WHEN least(mine, other) = 0 THEN rank WHEN short THEN rank * rate ELSE rate * (rank // (rate - 1)) + 1 + rank % (rate - 1) END AS key FROM t""")
def difficulty_order(spark: SparkSession, d: str) -> DataFrame:
    rows = views.probs(spark, d).withColumn("wrong", (F.col("label") == 1) != (F.col("prob") > 0.5))
    hardest = F.when(F.col("label") == 1, F.col("prob")).otherwise(-F.col("prob"))
    placed = cut(ranking.numbered(rows, [F.asc("wrong"), F.asc("label"), hardest.asc(), F.asc("id")], "place"))
    one = lambda y: F.sum(F.when(F.col("label") == y, 1).otherwise(0))
    counts = placed.groupBy("wrong").agg(one(1).alias("pos"), one(0).alias("neg"))
    starts = placed.groupBy("wrong", "label").agg(F.min("place").alias("start"))  # four rows
    ranked = placed.join(F.broadcast(starts), ["wrong", "label"]).join(F.broadcast(counts), "wrong").withColumn("rank", F.col("place") - F.col("start"))
    key = F.when(F.col("label") == 1, ranking.interleave_key(F.col("rank"), F.col("pos"), F.col("neg"), True)).otherwise(ranking.interleave_key(F.col("rank"), F.col("neg"), F.col("pos"), False))
    return ranked.select("id", "wrong", key.cast("long").alias("key"))


def _with_vectors(spark: SparkSession, d: str) -> DataFrame:
    return cut(views.pairs(spark, d).select("id", "label", "score", ((1 + F.col("score")) / 2).alias("prob"), "vec"), clean=True)


@query("votek_full")
def votek_full(spark: SparkSession, d: str) -> DataFrame:
    pairs = _with_vectors(spark, d)
    return selection.votek(pairs, Surrogate(pairs).predict, 20, stored=True)


@query("adaicl_full")
def adaicl_full(spark: SparkSession, d: str) -> DataFrame:
    pairs = _with_vectors(spark, d)
    return selection.adaptive_cover(pairs, Surrogate(pairs).predict, 8)


@query("iterative_gain")
def iterative_gain(spark: SparkSession, d: str, most: int = 2000) -> DataFrame:
    """Stage one reduces a larger pool to ``most`` candidates by 1-D facility location with early stop."""
    pairs = _with_vectors(spark, d)
    if pairs.count() > most:
        pairs = cut(pairs.join(selection.facility_sample(pairs.select("id", F.array("score").alias("vec")), most, early_stop=True).select("id"), "id"))
    rows = pairs.select("id", "label", "score").collect()  # at most ``most`` rows
    state = gain.iterative_gain(sorted(r["id"] for r in rows), {r["id"]: r["label"] for r in rows}, {r["id"]: r["score"] for r in rows}, Surrogate(pairs).predict_many, k=6, budget=20, eval_size=40)
    return spark.createDataFrame([(k + 1, i) for k, i in enumerate(state.selected)], "rank int, id long")


@query("fewshot_evaluation")
def fewshot_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Prompts for all part pairs with shared demonstrations, scored by the stand-in model, and A1."""
    form = text.PairFormat(PART_COLUMNS, text.as_strings(PART_COLUMNS, "a_"), text.as_strings(PART_COLUMNS, "b_"), numeric=("size",))
    rows = views.part_pairs(spark, d).select("pair_id", form.write("s6").alias("text"), (F.col("a_brand") == F.col("b_brand")).cast("int").alias("label"))
    examples = rows.where("label IS NOT NULL").orderBy("pair_id").limit(6).withColumn("rank", F.col("pair_id"))
    prompts = retrieval.shared_prompts(rows.select(F.col("pair_id").alias("test_id"), "text"), examples)
    judged = scoring.scored(prompts, scoring.OverlapScorer).join(rows.select(F.col("pair_id").alias("test_id"), "label"), "test_id")
    return judged.agg(F.count("*").alias("n"), *metrics.precision_recall_f1(F.col("label"), F.col("pred")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterative_gain(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
