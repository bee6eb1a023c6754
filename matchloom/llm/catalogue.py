"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchloom.llm import annforest, langid, licenses, mixing, packing, pii, quality, simhash, topk, urlfilter
from matchloom.llm._common import table

CAPACITY = 1024
#: Rules of op6 as (verdict, host, path).
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _bucket(n: int):
    """crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def gpt_tokens():
    """The byte-level BPE of 50k ids, from the box's vocabulary files."""
    import public_tokenizers as P

    return packing.rank_tokenizer(str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN, packing.added_tokens(str(P.path("byte_bpe_50k.json"))))


def op1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return annforest.search_forest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), gpt_tokens(), CAPACITY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of pages that were reached through a tracking link."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    tracked = pages.where(F.col("url").contains("utm_source=")).select("url")
    return urlfilter.judge(pages, tracked, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), _bucket(3) == 1
    model = quality.fit(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    scored = docs.select("doc_id", held.alias("held_out"), quality.scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = _bucket(4) == 2
    model = langid.fit(docs.where(~held))
    found = langid.annotate(docs.select("doc_id", "text"), model, out="l")
    return found.select("doc_id", held.alias("held_out"), "l.lang_pred", "l.score", "l.rejected")


#: Words and the water level in closed form; thresholds by running sums over the hash order.
OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         3 * source_size AS cap
  FROM by_source),
levels AS (
  SELECT *, row_number() OVER o AS place,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST)),
settled AS (SELECT *, min(CASE WHEN level * w <= cap THEN place END) OVER () AS first FROM levels),
wanted AS (
  SELECT source, source_size,
         CASE WHEN place < first THEN cap::DOUBLE
              ELSE coalesce(max(CASE WHEN place = first THEN level END) OVER () * w, cap::DOUBLE) END AS target
  FROM settled),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs FROM wanted),
blocks AS (
  SELECT source, h, sum(size) AS tokens, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS stop
  FROM sized GROUP BY source, h),
partial AS (
  SELECT b.source, b.h, b.stop - b.tokens AS low, b.tokens, b.stop, e.target - e.epochs * e.source_size AS budget
  FROM blocks b JOIN epochs e ON b.source IS NOT DISTINCT FROM e.source),
edges AS (
  SELECT source, min_by(CASE WHEN 2 * (budget - low) > tokens THEN h ELSE h - 1 END, h) AS upto
  FROM partial WHERE stop > budget GROUP BY source)
SELECT d.doc_id, d.size, e.source_size, e.target,
       (d.size * (e.epochs + CASE WHEN d.h <= coalesce(g.upto, -1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d
JOIN epochs e ON d.source IS NOT DISTINCT FROM e.source
LEFT JOIN edges g ON d.source IS NOT DISTINCT FROM g.source
"""

OP6_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN
           regexp_replace(regexp_replace(host, ':(?:80|443)$', ''), '^www\.', '') || regexp_replace(path, '(?:\.html?)?/*$', '') END AS key
  FROM split),
listed AS (SELECT DISTINCT key FROM keyed WHERE contains(url, 'utm_source=') AND key IS NOT NULL),
rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT k.page_id, max_by(r.host || r.path, len(r.host || r.path)) AS rule, max_by(r.verdict, len(r.host || r.path)) AS verdict
  FROM keyed k JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)
  GROUP BY k.page_id)
SELECT k.page_id, k.host, k.path, f.rule, coalesce(f.verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       l.key IS NOT NULL AS listed
FROM keyed k LEFT JOIN fits f ON k.page_id = f.page_id LEFT JOIN listed l ON k.key = l.key
"""

OP7_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_forest": op1_forest,
        "op2_pii": op2_pii,
        "op3_mixing": op3_mixing,
        "op4_packing": op4_packing,
        "op5_licenses": op5_licenses,
        "op6_urls": op6_urls,
        "op7_topk": op7_topk,
        "op8_simhash": op8_simhash,
        "op9_quality": op9_quality,
        "op10_language": op10_language,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op6_urls": OP6_SQL, "op7_topk": OP7_SQL}
