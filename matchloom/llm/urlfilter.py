"""URL filtering: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Every listed URL's canonical form sets ``len(SHIFTS)`` bits in one block of 256 bits, which is chosen by a first
hash; the filter is a table of blocks (block, four words), joined by block. URLs whose bits are not all set
are certainly not listed and go no further; the others, listed ones and a few false positives,
meet the distinct listed URLs in a hash join on the canonical URL, which settles them. The filter is broadcast
only if its table is at most ``most_broadcast`` bytes; beyond that the join is by shuffle, on a
hash that spreads URLs evenly. Exact rules on host and path come first.

All steps are DataFrame functions. Defined results: a null URL or one without ``://`` has an empty host
and path, fits no rule and is never listed; repeated rows are judged alike; empty tables (of
URLs or of listed ones) give no rows or no listed URL; null listed URLs are ignored; other
columns of the table are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.llm._common import cut

BLOCK_BITS = 256
SHIFTS = tuple(range(0, 64, 8))  # eight positions of 8 bits from one hash
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One form for URLs that differ in scheme, www, default port, query, fragment, .html or a last slash."""
    plain = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^www\.", "")
    return F.when(host != "", F.concat(plain, F.regexp_replace(path, r"(?:\.html?)?/*$", "")))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):  # the longest ends up outermost
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _word_masks(key: Column) -> list[Column]:
    """The bits that a key sets in each of its block's four words."""
    h = F.xxhash64(key, F.lit("bits"))
    spots = [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for s in SHIFTS]
    words = []
    for w in range(BLOCK_BITS // 64):
        word = F.lit(0).cast("long")
        for p in spots:
            word = word.bitwiseOR(F.when(F.shiftright(p, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return words


def bloom_blocks(keys: DataFrame, n: int, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """(block, w0..w3) over the ``n`` distinct values of the column ``key``, and the number of blocks."""
    blocks = max(1, math.ceil(n * bits_per_key / BLOCK_BITS))
    masks = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *[m.alias(f"w{k}") for k, m in enumerate(_word_masks(F.col("key")))])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)]), blocks


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", bits_per_key: int = 16, most_broadcast: int = 8 << 20) -> DataFrame:
    """(page_id, host, path, rule, verdict, possible, listed) for every row of ``pages``.

    verdict: the rule's where one fits, else block for listed URLs and allow for others.
    possible: whether the filter passed the URL on.
    """
    url = F.col(url_col).cast("string")
    split = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), canonical(F.col("host"), F.col("path")).alias("key"))
    other = F.col(listed_col).cast("string")
    keys = cut(listed.select(canonical(host_of(other), path_of(other)).alias("key")).where("key IS NOT NULL").distinct())
    n = keys.count()
    blocks, size = bloom_blocks(keys, n, bits_per_key)
    blocks = blocks.withColumnRenamed("block", "b")
    blocks = F.broadcast(blocks) if size * 48 <= most_broadcast else blocks
    masks = _word_masks(F.col("key"))
    hit = F.lit(True)
    for k, m in enumerate(masks):
        hit = hit & (F.col(f"w{k}").bitwiseAND(m) == m)
    # rows without a URL have no block to look at; numbers of their own keep them apart
    block = F.when(F.col("key").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(size))).otherwise(-1 - F.pmod(F.xxhash64("page_id"), F.lit(size)))
    probed = rows.withColumn("block", block).join(blocks, F.col("block") == F.col("b"), "left")
    probed = cut(probed.select("page_id", "host", "path", "rule", "by_rule", "key", (F.col("key").isNotNull() & F.coalesce(hit, F.lit(False))).alias("possible")))
    exact = keys.select(F.col("key").alias("k"), F.lit(True).alias("on_list"))
    settled = probed.where("possible").join(exact.hint("shuffle_hash") if n * 100 > most_broadcast else F.broadcast(exact), F.col("key") == F.col("k"), "left").select(*probed.columns, F.coalesce("on_list", F.lit(False)).alias("listed"))
    both = settled.union(probed.where("NOT possible").select("*", F.lit(False)))
    return both.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "possible", "listed")
