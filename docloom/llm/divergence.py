"""Source divergence audit: how far the word use of each source lies from that of the others of its language.

A term's share in a group depends on nothing but its count there (its level), so a pair of groups is
priced by its joint table: how many terms have level i in one and level j in the other. All joint tables come from
products of one-hot matrices. Terms are rows, (group, level) pairs are columns, an entry is 1 where the term has
that level in that group, and the transpose times the matrix holds every table of every pair of groups. Terms are dealt to
blocks of rows with similar totals, so that a block has few columns; a block with many columns is multiplied
column block by column block. Products count at most BLOCK_TERMS ones, which float32 adds exactly. Tables of blocks
add up, and so do their prices: nothing but a few numbers for each pair of groups and block is shuffled. Columns of level 0 are
left out of the matrices: what has no level above 0 follows from the other columns' sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import small, stored, table, trimmed

#: Documents that a term must be in to be kept, and ranks of terms that are reported.
LEAST_DOCUMENTS, RANKS = 3, 200
#: Shares are whole numbers of this scale.
SCALE = 1_000_000_000
#: Rows and columns of one matrix of indicators.
BLOCK_TERMS, BLOCK_COLUMNS = 4096, 512
#: Different (group, term) pairs that a task holds before it passes their counts on.
HELD = 400_000
#: Bytes of a text split at a time.
SPLIT_BYTES = 1 << 20
#: Counts up to this one times SCALE fit 64 bits.
SAFE = 9_000_000_000

#: For each byte of UTF-8: separators are blanks, A-Z are lower case, all else stays.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))

_COUNTS = "lang string, source string, term string, n long, docs long"
_CELLS = "lang string, a string, b string, levels_a array<long>, levels_b array<long>, terms array<long>"


def split(folded: bytes) -> Iterator[list[bytes]]:
    """The runs of ``folded`` between blanks, about SPLIT_BYTES at a time."""
    at = 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= SPLIT_BYTES else folded.rfind(b" ", at, at + SPLIT_BYTES) + 1
        if not end:  # one run longer than that
            end = folded.find(b" ", at + SPLIT_BYTES) + 1 or len(folded)
        yield folded[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each (lang, source), as far as a task has seen them."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            names = list(n)
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang), len(part)), pa.repeat(pa.scalar(source), len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    for batch in batches:
        for i, (lang, source, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for runs in split(text.encode("utf-8", "replace").translate(_FOLD)):
                n.update(runs)
                own.update(runs)
            docs.update(own)
            if i % 50 == 49 and sum(len(x) for x, _ in held.values()) > HELD:
                yield from passed_on()
    yield from passed_on()


def groups_of(docs: DataFrame) -> DataFrame:
    """lang, source and text of ``docs``, nulls as empty strings."""
    return docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, n (all occurrences), sources (source and n of each source that has it) of terms in at least ``least`` documents of the lang.

    Terms are maximal runs of letters A-Z, in lower case, and of characters beyond ASCII. Nulls count as
    empty strings; repeated rows are documents of their own. An empty table, like empty texts, has no term.
    """
    counts = groups_of(docs).mapInArrow(trimmed(_counted), _COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return terms.where(F.col("docs") >= least).select("lang", "term", "n", "sources")


def _block_tables(row: np.ndarray, group: np.ndarray, level: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Joint tables of consecutive terms (``row`` ascends): arrays (group a, group b, level a, level b, terms) with a < b."""
    column = group * (int(level.max()) + 1) + level
    at = 0
    while at < len(row):
        end = int(np.searchsorted(row, row[at] + BLOCK_TERMS))
        _, first = np.unique(column[at:end], return_index=True)
        if len(first) > BLOCK_COLUMNS:  # the block ends before the row that brings one column too many
            end = max(int(np.searchsorted(row, row[at], "right")), int(np.searchsorted(row, row[at + np.sort(first)[BLOCK_COLUMNS]])))
        names, first, inverse = np.unique(column[at:end], return_index=True, return_inverse=True)
        r, g, c = row[at:end] - row[at], group[at:end][first], level[at:end][first]
        height = int(r[-1]) + 1
        cuts = range(0, len(names), BLOCK_COLUMNS)

        def hot(x: int, r=r, inverse=inverse, height=height, names=names) -> np.ndarray:
            inside = (inverse >= x) & (inverse < x + BLOCK_COLUMNS)
            out = np.zeros((height, min(BLOCK_COLUMNS, len(names) - x)), np.float32)
            out[r[inside], inverse[inside] - x] = 1
            return out

        for x in cuts:
            left = hot(x)
            for y in cuts:
                if y < x:  # columns ascend with their group: nothing there has a < b
                    continue
                product = left.T @ (left if x == y else hot(y))
                i, j = np.nonzero(product)
                i, j, n = i + x, j + y, product[i, j].astype(np.int64)
                apart = g[i] < g[j]
                yield g[i][apart], g[j][apart], c[i][apart], c[j][apart], n[apart]
        at = end


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The joint tables of each batch of terms: one row for each pair of sources, lang and block."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        of_lang = langs.indices.to_numpy()
        lists = batch.column("sources")
        entries = lists.flatten()
        owner = pc.list_parent_indices(lists).to_numpy()
        source = entries.field("source").dictionary_encode()
        order = np.argsort(np.asarray(source.dictionary.to_pylist(), object).astype("U") if len(source.dictionary) else [])
        code = np.empty(len(order), np.int64)  # sources by name: a < b everywhere
        code[order] = np.arange(len(order))
        names = source.dictionary.take(pa.array(order))
        group, level = code[source.indices.to_numpy()], entries.field("n").to_numpy()
        for k, lang in enumerate(langs.dictionary):
            mine = of_lang[owner] == k
            if not mine.any():
                continue
            for a, b, i, j, n in _block_tables(owner[mine], group[mine], level[mine]):
                sort = np.lexsort((b, a))
                a, b = a[sort], b[sort]
                start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
                if not len(start):
                    continue
                offsets = pa.array(np.append(start, len(a)), pa.int32())
                columns = [pa.repeat(lang, len(start)), names.take(pa.array(a[start])), names.take(pa.array(b[start]))]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(x[sort])) for x in (i, j, n)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "levels_a", "levels_b", "terms"])


def joint_tables(terms: DataFrame) -> DataFrame:
    """Parts of the joint tables of all pairs of sources a < b of a lang, by code points: level i (over 0) in a, j in b and the number of such ``terms``.

    A pair has a row for each block of terms; its table is their sum. Sources of a lang without a common term have no row.
    """
    near = terms.select("lang", "n", "sources").sortWithinPartitions("lang", "n")
    return near.mapInArrow(trimmed(_multiplied), _CELLS)


def _price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _share(level: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (level + 1) / whole)."""
    if len(level) and level.max() >= SAFE:
        return np.array([1 + SCALE * (int(c) + 1) // int(w) for c, w in zip(level, whole, strict=True)], np.int64)
    return 1 + SCALE * (level + 1) // whole


def _priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each row's cells add to the value of a against b and of b against a, over level 0 in both."""
    for batch in batches:
        lists = batch.column("levels_a")
        owner = pc.list_parent_indices(lists).to_numpy()
        if not len(owner):
            continue
        i, j, n = (batch.column(c).flatten().to_numpy() for c in ("levels_a", "levels_b", "terms"))
        whole_a, whole_b = (batch.column(c).to_numpy()[owner] for c in ("whole_a", "whole_b"))
        joint = batch.column("joint").to_numpy(zero_copy_only=False)[owner]
        zero = np.zeros_like(i)
        pa_, pb, pa0, pb0 = _share(i, whole_a), _share(j, whole_b), _share(zero, whole_a), _share(zero, whole_b)
        start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        sums = []
        for p, q, p0, q0 in ((pa_, pb, pa0, pb0), (pb, pa_, pb0, pa0)):
            base = _price(p0, q0)
            # A cell of a joint table moves terms out of both columns' level 0; a column's sum moves them from (0, 0) only.
            gain = _price(p, q) - base - np.where(joint, _price(p, q0) + _price(p0, q) - 2 * base, 0)
            sums.append(pa.array(np.add.reduceat(n * gain, start)))
        at = pa.array(owner[start])
        yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("lang", "a", "b")] + sums, ["lang", "a", "b", "ab", "ba"])


def share(count, whole):
    """The share of a count as a column: 1 + floor(SCALE * (count + 1) / whole), exact whatever the count."""
    wide = F.expr(f"(CAST({count} AS DECIMAL(20, 0)) + 1) * {SCALE}BD div CAST({whole} AS DECIMAL(20, 0))")
    return F.lit(1) + F.when(F.col(count) < SAFE, F.expr(f"({count} + 1) * {SCALE}L div {whole}")).otherwise(wide)


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` ranks the other sources of the lang by divergence, part ``term`` the terms that the source has more of than its lang.

    Every (lang, source) that occurs is a group, also without terms. Nulls in lang, source and text are empty
    strings. Ties of value are ordered by the item's UTF-8 bytes; the pairs are all ranked, the terms
    to ``ranks``. A lang without kept terms has pairs of value 0; an empty table gives an empty result; other
    columns are left out.
    """
    terms = stored(kept_terms(docs, least), "terms")
    groups = groups_of(docs).select("lang", "source").distinct()
    entries = terms.select("lang", "term", F.col("n").alias("all"), F.explode("sources").alias("s")).select("lang", "term", "all", "s.source", F.col("s.n").alias("n"))
    size = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    levels = stored(entries.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")), "levels")
    own = levels.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("own_n"))
    whole = groups.join(own, ["lang", "source"], "left").join(size, "lang", "left")
    zero = F.lit(0).cast("long")
    whole = whole.select("lang", "source", F.coalesce("v", zero).alias("v"), (F.coalesce("own_n", zero) + F.coalesce("v", zero)).alias("whole"), (F.coalesce("lang_n", zero) + F.coalesce("v", zero)).alias("lang_whole"))
    whole = stored(whole, "sources")

    def named(side: str) -> DataFrame:
        return small(whole).select("lang", F.col("source").alias(side), F.col("whole").alias(f"whole_{side}"))

    # Priced rows: joint tables of blocks, and each source's column sums against each other source.
    tables = joint_tables(terms).join(named("a"), ["lang", "a"]).join(named("b"), ["lang", "b"]).withColumn("joint", F.lit(True))
    column = levels.groupBy("lang", F.col("source").alias("a")).agg(F.collect_list(F.struct("n", "terms")).alias("c"))
    column = column.select("lang", "a", F.col("c.n").alias("levels_a"), F.expr("transform(c, x -> 0L)").alias("levels_b"), F.col("c.terms").alias("terms"))
    sums = column.join(named("a"), ["lang", "a"]).join(named("b"), "lang").where("a <> b").withColumn("joint", F.lit(False))
    shape = ["lang", "a", "b", "levels_a", "levels_b", "terms", "whole_a", "whole_b", "joint"]
    priced = tables.select(*shape).unionByName(sums.select(*shape)).mapInArrow(trimmed(_priced), "lang string, a string, b string, ab long, ba long")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value"))))
    moved = priced.select("lang", both.alias("x")).select("lang", "x.source", "x.item", F.col("x.value").cast("decimal(38,0)").alias("value"))
    pairs = whole.select("lang", "source", "v", "whole").join(named("item"), "lang").where("source <> item").withColumn("none", zero)
    pairs = pairs.withColumn("p", F.when(F.col("v") > 0, share("none", "whole"))).withColumn("q", F.when(F.col("v") > 0, share("none", "whole_item")))
    base = pairs.select("lang", "source", "item", F.coalesce(F.col("v").cast("decimal(20,0)") * F.expr("(p - q) * (p - q) div q").cast("decimal(18,0)"), F.lit(0)).cast("decimal(38,0)").alias("value"))
    pair = base.unionByName(moved).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).withColumn("part", F.lit("pair"))

    per_term = entries.join(small(whole), ["lang", "source"]).withColumn("p", share("n", "whole")).withColumn("q", share("all", "lang_whole")).where("p > q")
    per_term = per_term.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    # Spark limits each partition to the first ranks of every group before it shuffles them.
    best = per_term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    ranked = pair.withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(best.select(*columns))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and telling terms of every (lang, source) of all documents."""
    return divergences(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS MATERIALIZED (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
w AS (SELECT g.lang, g.source, sum(coalesce(c.n, 0))::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT w.lang, w.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (w.n + v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (v.n + v.v) AS q
  FROM w JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT p.lang, p.source, o.source AS item, sum((p.p - o.p) * (p.p - o.p) // o.p) AS value FROM p JOIN p o ON p.lang = o.lang AND p.term = o.term AND p.source <> o.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= 200
"""
