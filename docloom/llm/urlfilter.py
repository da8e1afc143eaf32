"""URL filter: host and path rules first, then a list of URLs behind a blocked Bloom filter.

The listed canonical URLs are hashed into a Bloom filter of 256-bit blocks. A page's URL sets eight bits
in one block; if all are set in the listed block the URL is a possible hit. Only possible hits go into
the exact join with the list, which removes false positives. Everything is DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import stored, table, unused

#: (verdict, host, path): a rule fits the host and its subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts whose pages make up the list of the query: a seed list is a parameter of any deployment.
SEED_HOSTS = ("cheap-pills", "spam-farm")
BITS_PER_URL = 16
#: Blocks up to which the filter is broadcast: 36 bytes each, so at most about 18 MB.
BROADCAST_BLOCKS = 500_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules see them; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written host + path, and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for word, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return name, verdict


def canonical(host: Column, path: Column) -> Column:
    """One spelling for a page: no scheme, query, fragment, ``www.``/``m.`` prefix, index file or final slash."""
    bare = F.regexp_replace(host, r"^(?:www|m)\.|:(?:80|443)$", "")
    return F.concat(bare, F.regexp_replace(path, r"(?:/index\.html?|/)$", ""))


def _bit_columns(url: str) -> list[Column]:
    """Columns b0..b3: four longs with the eight bits that a URL sets in its 256-bit block."""
    second = f"xxhash64({url}, 1)"
    out = []
    for word in range(4):
        terms = [f"if(({second} >>> {8 * i + 6}) & 3 = {word}, shiftleft(1L, cast(({second} >>> {8 * i}) & 63 as int)), 0L)" for i in range(8)]
        out.append(F.expr(" | ".join(terms)).alias(f"b{word}"))
    return out


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The filter: one row (block, f0..f3) for each block with a bit set; ``listed`` has a column url."""
    block = F.pmod(F.xxhash64("url"), F.lit(n_blocks)).alias("block")
    return listed.select(block, *_bit_columns("url")).groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"f{i}") for i in range(4)])


def listed_urls(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """``pages`` (with a column ``canonical``) and a boolean ``is_listed``: its canonical URL is in ``listed`` (url).

    Null and empty URLs are never listed; repeated pages stay; repeated, null or empty list entries count
    once or not at all; an empty list marks nothing. Other columns of ``pages`` stay, whatever their names: where one is
    called ``is_listed``, the new one's name begins with an underscore. The Bloom filter is broadcast while it has at most
    BROADCAST_BLOCKS blocks and shuffled beyond. Only possible hits meet the list in an exact join.
    """
    listed = stored(listed.select(F.col("url").cast("string")).where("url <> ''").distinct(), "listed-urls")
    n_blocks = max(1, math.ceil(listed.count() * BITS_PER_URL / 256))
    filter_rows = bloom(listed, n_blocks)
    block, hit, maybe, listed_, *bits = (unused(pages, name) for name in ("block", "hit", "possible", "is_listed", "b0", "b1", "b2", "b3"))
    probe = pages.select("*", F.pmod(F.xxhash64("canonical"), F.lit(n_blocks)).alias(block), *[c.alias(n) for c, n in zip(_bit_columns("canonical"), bits, strict=True)])
    filter_ = filter_rows.toDF(block, *[unused(probe, f"f{i}") for i in range(4)])
    possible = F.lit(True)
    for own, name in zip(bits, filter_.columns[1:], strict=True):
        possible = possible & (F.col(own).bitwiseAND(F.col(name)) == F.col(own))
    probe = probe.join(F.broadcast(filter_) if n_blocks <= BROADCAST_BLOCKS else filter_, block, "left").withColumn(maybe, F.coalesce(possible & (F.col("canonical") != ""), F.lit(False)))
    rest = probe.where(~F.col(maybe)).select(*pages.columns, F.lit(False).alias(listed_))
    hits = probe.where(F.col(maybe)).join(listed.select(F.col("url").alias("canonical"), F.lit(True).alias(hit)), "canonical", "left")
    return rest.unionByName(hits.select(*pages.columns, F.coalesce(hit, F.lit(False)).alias(listed_)))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: the longest rule's, else block for a listed canonical URL and allow for others.

    The list holds the canonical URLs of all pages on SEED_HOSTS, derived from the table itself.
    """
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_verdict(F.col("host"), F.col("path"))
    pages = pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), canonical(F.col("host"), F.col("path")).alias("canonical"))
    seed = F.lit(False)
    for label in SEED_HOSTS:
        seed = seed | F.concat(F.lit("."), F.col("host"), F.lit(".")).contains(f".{label}.")
    judged = listed_urls(pages, pages.where(seed).select(F.col("canonical").alias("url")))
    method = F.when(F.col("is_listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "is_listed")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), c AS (
  SELECT *, regexp_replace(host, '^(www|m)\.|:(80|443)$', '', 'g') || regexp_replace(path, '(/index\.html?|/)$', '') AS canonical,
    CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h
), l AS (
  SELECT DISTINCT canonical FROM c WHERE canonical <> '' AND (contains('.' || host || '.', '.cheap-pills.') OR contains('.' || host || '.', '.spam-farm.'))
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  l.canonical IS NOT NULL AS is_listed
FROM c LEFT JOIN l USING (canonical)
"""
