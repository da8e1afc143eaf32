"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

An item of m shingles (five words each) is compared with windows of m consecutive shingles of a document.
Each window has a 64-bit SimHash. Fingerprints are cut into eight blocks of eight bits, and items are
indexed under every block value within two bits of theirs: two fingerprints at most 23 bits apart differ
by at most two bits in some block, so every pair within RADIUS meets. What meets within RADIUS is verified
by the exact similarity

    M / (T + U)   M: weights of the item's shingles that are in the window
                  T: weights of all the item's shingles
                  U: positions of the window whose shingle isn't the item's, which weigh 1 each

where a shingle's weight falls with the number of items that have it (ln(1 + n / df) / ln(1 + n)).
A window that doesn't begin with one of the item's shingles is no better than the one that begins at its
first common shingle, and one without any has similarity 0: so only windows that begin at a shingle of an
item of their size are fingerprinted, and none is missed by that. All of it is DataFrame operations.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import BROADCAST_ROWS, documents, stored, table

THRESHOLD = 0.8
RADIUS = 23
#: Shingles up to which 16-bit counters do for a fingerprint; longer items take 32-bit ones.
SHORT_ITEM = 30_000
#: Shingles of a text that are handled in one row.
SEGMENT = 1024
#: All changes of at most two bits in a block.
_FLIPS = [sum(1 << i for i in bits) for n in range(3) for bits in combinations(range(8), n)]


def shingled(df: DataFrame, key: str) -> DataFrame:
    """(key, s): the hashes of all five-word shingles of ``text`` in order; words are runs of letters and digits in lower case.

    A text of fewer than five words, an empty one and null have none.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    hashed = df.select(key, F.transform(words, lambda w: F.xxhash64(w)).alias("h"))
    sized = hashed.select(key, "h", F.greatest(F.size("h") - 4, F.lit(0)).alias("n"))
    return sized.select(key, F.expr("transform(slice(h, 1, n), (x, i) -> xxhash64(x, h[i + 1], h[i + 2], h[i + 3], h[i + 4]))").alias("s"))


def _with_fingerprint(df: DataFrame, array: str, name: str, longest: int) -> DataFrame:
    """Adds the SimHash of an array of hashes, ``longest`` at most: bit i is set if more than half of them have it.

    Bits are counted in lanes of longs, eight of 8 bits for up to 127 hashes and four of 16 bits (two of 32 where
    arrays are longer than SHORT_ITEM) for more; a lane's high bit tells after an addition whether its count is over half.
    """
    many = 16 if longest <= SHORT_ITEM else 32

    def lane_sum(bits: int, k: int):
        return F.aggregate(array, F.lit(0).cast("long"), lambda t, x: t + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(_ones(bits))))

    def sums(bits: int):
        return F.array(*[lane_sum(bits, k) for k in range(bits)])

    small_ = F.when(F.size(array) <= 127, sums(8))
    large = F.when(F.size(array) > 127, sums(many))
    summed = df.select("*", small_.alias("_l8"), large.alias("_large"), F.size(array).alias("_n"))

    def bits_of(lanes: str, bits: int) -> str:
        wide = _ones(2 * bits)
        mask = wide * ((1 << bits) - 1)
        add = f"({(1 << (bits - 1)) - 1} - _n div 2) * {wide}L"
        parts = [f"((((({lanes}[{k}] >>> {s}) & {mask}L) + {add}) >>> {bits - 1}) & {wide}L) << {s + k}" for k in range(bits) for s in (0, bits)]
        return " | ".join(f"({p})" for p in parts)

    return summed.select(*df.columns, F.when(F.col("_n") <= 127, F.expr(bits_of("_l8", 8))).otherwise(F.expr(bits_of("_large", many))).alias(name))


def _ones(bits: int) -> int:
    return sum(1 << i for i in range(0, 64, bits))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, word): the documents that hold an item, with their best window for it.

    ``docs`` has doc_id and text, ``items`` item_id and text. similarity (at least ``threshold``) is rounded to
    six digits; word is the window's first word, counted from 0, the least of equals. Items and texts of fewer
    than five words, empty and null ones, match nothing. Repeated rows of a doc_id or item_id give one row.
    Empty tables give an empty result; other columns are left out. Items may be of any length; a row holds twice the longest.
    """
    items = shingled(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "item_id")
    items = stored(items.where("size(s) > 0").distinct(), "items")
    parts = items.select("item_id", F.explode(F.array_distinct("s")).alias("x")).distinct()
    n = items.select("item_id").distinct().count()
    longest = items.agg(F.max(F.size("s"))).first()[0] or 0
    weight = parts.groupBy("x").agg(F.count("*").alias("df")).select("x", (F.log(1 + F.lit(n) / F.col("df")) / F.log(1 + F.lit(max(n, 1)))).alias("w"))
    weighed = parts.join(weight, "x").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("x", "w"))).alias("own"))
    index = _with_fingerprint(items, "s", "item_print", longest).join(weighed, "item_id")
    index = index.select("item_id", F.size("s").alias("m"), "item_print", "own", F.expr("aggregate(own, 0D, (t, o) -> t + o.w)").alias("total"))
    index = stored(index, "item-index")
    # Each broadcast below has at most a row for each item shingle or one for each item and block value: both numbers are checked.
    few = parts.count() <= BROADCAST_ROWS
    hint = F.broadcast if few else lambda df: df
    hint_blocks = F.broadcast if few and index.count() * 8 * len(_FLIPS) <= BROADCAST_ROWS else lambda df: df

    starts = index.select("m", F.explode("own.x").alias("x")).distinct()
    # Long texts go in segments with the longest item's length on both sides, so that no row holds much.
    cut = f"transform(sequence(0, greatest(size(s) - 1, 0), {SEGMENT}), i -> struct(i, greatest(0, i - {longest}) AS off, slice(s, greatest(0, i - {longest}) + 1, least(i, {longest}) + {SEGMENT + longest}) AS seg))"
    segments = shingled(documents(docs), "doc_id").select("doc_id", F.size("s").alias("n"), F.explode_outer(F.expr(cut)).alias("c")).select("doc_id", "n", "c.*")
    places = segments.select("doc_id", "n", "i", "off", "seg", F.posexplode_outer(F.expr(f"slice(seg, i - off + 1, {SEGMENT})")).alias("p", "x"))
    hits = places.join(hint(starts), "x").withColumn("word", F.expr("greatest(0, least(i + p, n - m))"))
    windows = hits.select("doc_id", "m", "word", F.expr("slice(seg, word - off + 1, m)").alias("win"))
    windows = _with_fingerprint(windows, "win", "print", longest)
    probes = windows.select("*", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.expr(f"cast((print >>> {8 * b}) & 255 as int)").alias("value")) for b in range(8)])).alias("probe"))
    probes = probes.select("doc_id", "m", "word", "win", "print", "probe.block", "probe.value")
    blocks = index.select("item_id", "m", "item_print", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.expr(f"cast((item_print >>> {8 * b}) & 255 as int)").alias("value")) for b in range(8)])).alias("own"))
    blocks = blocks.select("item_id", "m", "item_print", "own.block", F.explode(F.array(*[F.col("own.value").bitwiseXOR(F.lit(f)) for f in _FLIPS])).alias("value"))
    met = probes.join(hint_blocks(blocks), ["m", "block", "value"])
    met = met.where(f"bit_count(print ^ item_print) <= {RADIUS}")
    first = "CASE " + " ".join(f"WHEN bit_count(((print ^ item_print) >>> {8 * b}) & 255) <= 2 THEN {b}" for b in range(8)) + " END"
    met = met.where(f"block = {first}").select("doc_id", "item_id", "m", "word", "win")
    near = met.join(hint(index.select("item_id", "m", "own", "total")), ["item_id", "m"])
    found = F.expr("aggregate(own, 0D, (t, o) -> t + if(array_contains(win, o.x), o.w, 0D))")
    others = F.expr("size(filter(win, x -> NOT array_contains(own.x, x)))")
    near = near.select("doc_id", "item_id", "word", (found / (F.col("total") + others)).alias("exact")).where(F.col("exact") >= threshold)
    best = near.groupBy("doc_id", "item_id").agg(F.max(F.struct("exact", (-F.col("word")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", F.round("best.exact", 6).alias("similarity"), (-F.col("best.back")).cast("long").alias("word"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same by plain joins of shingles, windows and items, without fingerprints.
OP3_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark
), s AS (
  SELECT kind, id, len(w) - 4 AS n, unnest(range(len(w) - 4)) AS p, unnest(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS x
  FROM words WHERE len(w) >= 5
), items AS (
  SELECT id AS item_id, n AS m, x FROM s WHERE kind = 'i' GROUP BY ALL
), weights AS (
  SELECT x, ln(1 + (SELECT count(DISTINCT item_id) FROM items) / count(*)) / ln(1 + (SELECT count(DISTINCT item_id) FROM items)) AS weight FROM items GROUP BY x
), own AS (
  SELECT item_id, m, x, weight FROM items JOIN weights USING (x)
), totals AS (
  SELECT item_id, sum(weight) AS total FROM own GROUP BY item_id
), hit AS (
  SELECT id AS doc_id, n, p, x, item_id, m, weight FROM s JOIN own USING (x) WHERE kind = 'd'
), starts AS (
  SELECT DISTINCT doc_id, item_id, n, m, greatest(0, least(p, n - m)) AS word FROM hit
), common AS (
  SELECT doc_id, item_id, word, any_value(n) AS n, any_value(m) AS m, x, count(*) AS places, any_value(weight) AS weight
  FROM starts JOIN hit USING (doc_id, item_id, n, m) WHERE p >= word AND p < word + m GROUP BY doc_id, item_id, word, x
), scored AS (
  SELECT doc_id, item_id, word, sum(weight) / (any_value(total) + least(any_value(m), any_value(n)) - sum(places)) AS exact
  FROM common JOIN totals USING (item_id) GROUP BY doc_id, item_id, word
)
SELECT doc_id, item_id, round(max(exact), 6) AS similarity, arg_max(word, round(exact, 9) - word * 1e-13)::BIGINT AS word
FROM scored WHERE exact >= 0.8 - 1e-12 GROUP BY doc_id, item_id
"""
