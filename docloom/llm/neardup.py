"""What the near-duplicate operators share: signatures, banding, verified links and classes.

Equal items are one node (a 64-bit hash). Nodes that share a band's key meet in a bucket, where each is compared
with one pivot. Most links of a group show so, and what is in one component needs no further comparison. Then

* a bucket of n members, few of which are outside its largest component, is closed: these meet the members of
  other components, at most CLOSE / n times n pairs;
* members of any other bucket are crowded. Crowded nodes meet by prefixes: with shingles in one order for all,
  rarest among the crowded first, two similar texts have their first common shingle before either has spent
  more than 1 - threshold of its weight. Passages that many texts share come last in that order and changed words
  first, so lists are short where texts differ; both places also bound how similar two texts can be, which
  leaves out most pairs of what is in a list. No similar pair of crowded nodes is missed by this.

So comparisons grow with the members of a bucket, not with their pairs. Every link is verified exactly; classes
are the connected components of links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import few, stored, trimmed
from .textarrays import chunks, mix, shingles

SIMILARITY = 0.8
#: 8 bands of 3 samples: at similarity 0.8 a pair shares a band with probability 0.997, at 0.3 with 0.2.
BANDS, BAND_ROWS = 8, 3
KEYS = [f"k{i}" for i in range(BANDS)]
#: Numbers in which the shingles of crowded nodes are counted, 4 bytes each.
COUNTERS = 1 << 20
#: A bucket is closed if its members, times those outside its largest component, are at most so many.
CLOSE = 1024

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _gamma_table(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at n midpoints."""
    u = (np.arange(n) + 0.5) / n
    x = np.where(u < 0.5, np.sqrt(2 * u), 1 - np.log1p(-u))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        gamma = _gamma_table()
        _TABLES.update(r=gamma.astype(np.float32), inverse=(1 / gamma).astype(np.float32), log=np.log(gamma).astype(np.float32))
    return _TABLES


def weighted_shingles(texts: list, idf: tuple[np.ndarray, np.ndarray, int] | None):
    """(hashes, weights, starts): the distinct shingles of each text, ascending, and their weights.

    ``idf`` has word hashes (ascending), their IDF in thousandths and that of all other words; a shingle
    weighs its count times the mean IDF of its words, in whole numbers so that equal shingles weigh the
    same anywhere. Without ``idf`` a shingle weighs 1 however often it occurs.
    """
    hashes, at, word, start = shingles(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    if idf is None:
        base = np.ones(len(hashes), np.int64)
    else:
        names, values, other = idf
        value = np.full(len(word), other, np.int64)
        if len(names):
            where = np.minimum(np.searchsorted(names, word), len(names) - 1)
            hit = names[where] == word
            value[hit] = values[where[hit]]
        total = np.concatenate(([0], np.cumsum(value)))
        ends = start + 5
        single = np.diff(at)[text] == 1  # perhaps fewer than five words
        if single.any():
            own = np.flatnonzero(single)
            ends[own] = start[own] + np.minimum(5, np.append(start, len(word))[own + 1] - start[own])
        base = (total[ends] - total[start]) // np.maximum(ends - start, 1)
    order = np.lexsort((hashes, text))
    hashes, text, base = hashes[order], text[order], base[order]
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]))) if len(hashes) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(hashes)))
    weights = base[first] * (1 if idf is None else count)
    return hashes[first], weights, np.searchsorted(text[first], np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, weights: np.ndarray, at: np.ndarray, weighted: bool, bands: int = BANDS, band_rows: int = BAND_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(node, keys): a hash of each text's shingles and weights, and its band keys [texts, bands].

    Texts without a shingle get 0s. Weighted texts are sampled by improved consistent weighted sampling: for
    each sample k, shingle s draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash; t = floor(ln w / r + b),
    and the (s, t) with least c / exp(r (t - b + 1)) is taken. Others by MinHash.
    """
    n = len(at) - 1
    full = np.flatnonzero(np.diff(at))
    node, keys = np.zeros(n, np.uint64), np.zeros((n, bands), np.uint64)
    if not len(full):
        return node.astype(np.int64), keys.astype(np.int64)
    starts = at[:-1][full]
    node[full] = mix(np.add.reduceat(mix(hashes + weights.astype(np.uint64) * _STEP), starts) + np.diff(at)[full].astype(np.uint64))
    low = np.uint64(0xFFFFFFFF)
    tables = _tables() if weighted else {}
    log_w = np.log(np.maximum(weights, 1)).astype(np.float32) if weighted else None
    for k in range(bands * band_rows):
        seed = np.uint64(((k + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
        draw = mix(hashes ^ seed)
        if weighted:
            r_at = (draw & np.uint64(0xFFFF)).astype(np.int64)
            r = tables["r"][r_at]
            b = (draw >> np.uint64(40)).astype(np.float32) * np.float32(1 / (1 << 24))
            t = np.floor(log_w * tables["inverse"][r_at] + b)
            value = tables["log"][((draw >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - b + np.float32(1))
            raw = value.view(np.uint32)
            rank = np.where(raw >> 31, ~raw, raw | np.uint32(0x80000000)).astype(np.uint64)  # ordered like the floats
            name = mix(draw + t.astype(np.int64).astype(np.uint64) * _STEP) & low
            sample = np.minimum.reduceat(rank << np.uint64(32) | name, starts) & low
        else:
            sample = np.minimum.reduceat(draw, starts)
        band = k // band_rows
        keys[full, band] = mix(keys[full, band] * np.uint64(31) + sample + np.uint64(band + 1))
    return node.astype(np.int64), keys.astype(np.int64)


def compare(a: tuple, b: tuple) -> np.ndarray:
    """The similarity of texts pair by pair: weighted Jaccard, sum of minima over sum of maxima, 0 without shingles."""
    n = len(a[2]) - 1
    pair = np.concatenate([np.repeat(np.arange(n), np.diff(x[2])) for x in (a, b)])
    hashes, weights = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.lexsort((hashes, pair))
    by, hashes, ordered = pair[order], hashes[order], weights[order]
    both = np.flatnonzero((by[1:] == by[:-1]) & (hashes[1:] == hashes[:-1])) if len(by) else np.zeros(0, np.int64)
    common = np.bincount(by[both], np.minimum(ordered[both], ordered[both + 1]), minlength=n)
    total = np.bincount(pair, weights, minlength=n)
    return common / np.maximum(total - common, 1)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of all ends of ``edges`` (a, b): the least node of each connected component.

    Least labels are passed along the edges and then to where they point, so the rounds grow with the
    logarithm of the longest way; each round is written to the shared folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), name)
    old = labels
    while True:
        for known in (few(labels), None):  # two rounds for each table that is written
            known = labels if known is None else known
            passed = both.join(known.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "label")
            least = labels.unionByName(passed).groupBy("node").agg(F.min("label").alias("label"))
            ahead = known.select(F.col("node").alias("at"), F.col("label").alias("next"))
            labels = least.join(ahead, F.col("label") == F.col("at"), "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"))
        labels = stored(labels, name)
        if labels.join(old.withColumnRenamed("label", "before"), "node").where("label < before").isEmpty():
            return labels
        old = labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after the components that ``links`` (a, b) join have become one."""
    if links.isEmpty():
        return labels
    known = few(labels.select(F.col("node").alias("n"), "label"))
    ends = links.join(known.withColumnsRenamed({"n": "a", "label": "la"}), "a", "left").join(known.withColumnsRenamed({"n": "b", "label": "lb"}), "b", "left")
    ends = stored(ends.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")), "label-links")
    joined = components(ends.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")), "label-components")
    new = ends.select(F.col("a").alias("node"), F.col("la").alias("label")).unionByName(ends.select(F.col("b").alias("node"), F.col("lb").alias("label")))
    every = labels.unionByName(new).distinct()
    joined = joined.withColumnsRenamed({"node": "old", "label": "new"})
    return stored(every.join(few(joined), every["label"] == joined["old"], "left").select("node", F.coalesce("new", "label").alias("label")).distinct(), "labels")


def labelled(met: DataFrame, labels: DataFrame) -> DataFrame:
    """``met`` with the label of each node, its own number where it isn't linked."""
    return met.join(few(labels.withColumnRenamed("label", "_l")), "node", "left").withColumn("label", F.coalesce("_l", "node")).drop("_l")


def open_buckets(met: DataFrame) -> DataFrame:
    """(key, n, others, main) of the buckets with more than one label: main is the most frequent one, others the members without it."""
    sizes = met.groupBy("key", "label").agg(F.count("*").alias("c"))
    top = sizes.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("top"))
    return top.where("n > top.c").select("key", "n", (F.col("n") - F.col("top.c")).alias("others"), F.col("top.label").alias("main"))


def across(met: DataFrame, buckets: DataFrame, where: str = "true") -> DataFrame:
    """Distinct pairs (a, b) of members with different labels in the same bucket, for which ``where`` holds of l and r.

    Two members that both have the bucket's main label are in one component, so one of each pair hasn't got it.
    """
    own = stored(met.join(few(buckets.select("key", "main")), "key"), "bucket-open")
    other = own.where("label <> main").alias("r")
    pairs = own.alias("l").join(other, F.col("l.key") == F.col("r.key")).where("l.label <> r.label AND (l.label = l.main OR l.node < r.node)").where(where)
    return pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def classes(nodes: DataFrame, check: "Check") -> DataFrame:
    """(node, label) of the nodes that are linked with another: the components of all verified links.

    ``nodes`` has node and keys, its band keys.
    """
    members = nodes.select("node", F.explode("keys").alias("key"))
    # Of buckets with the same members, told by their number and the xor of their hashes, one is enough.
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x")).where("n > 1")
    buckets = stored(sizes.groupBy("n", "x").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    degree = F.sum("n").over(Window.partitionBy("node")).alias("degree")
    met = stored(members.join(few(buckets), "key").select("key", "node", degree), "bucket-members")
    check.bind(met.select("node").distinct())
    pivots = stored(met.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("top")).select("key", F.col("top.node").alias("pivot")), "pivots")
    star = met.join(few(pivots), "key").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    labels = components(check.links(star))

    now = stored(labelled(met.select("key", "node"), labels), "bucket-labels")
    opened = stored(open_buckets(now), "buckets-open")
    labels = merged(labels, check.links(across(now, opened.where(F.col("others") * F.col("n") <= CLOSE))))
    large = stored(opened.where(F.col("others") * F.col("n") > CLOSE).select("key"), "buckets-large")
    if large.isEmpty():
        return labels
    lists = check.prefixes(stored(met.join(few(large), "key", "left_semi").select("node").distinct(), "crowded"))
    for alone in (True, False):
        now = stored(labelled(lists, labels), "prefix-labels")
        opened = stored(open_buckets(now), "prefixes-open")
        if opened.isEmpty():
            break
        if alone:  # each with the member that has least before the shingle: changed least
            first = stored(now.join(few(opened.select("key")), "key", "left_semi").groupBy("key").agg(F.min(F.struct("before", "node", "label", "total")).alias("p")), "prefix-pivots")
            star = now.join(few(first), "key").where("label <> p.label").where(may_match("before", "total", "p.before", "p.total", check.threshold))
            pairs = star.select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct()
        else:
            pairs = across(now, opened, may_match("l.before", "l.total", "r.before", "r.total", check.threshold))
        labels = merged(labels, check.links(pairs))
    return labels


def may_match(before_a: str, total_a: str, before_b: str, total_b: str, threshold: float) -> str:
    """Whether two texts whose first common shingle has these weights before it can be similar."""
    return f"least({total_a} - {before_a}, {total_b} - {before_b}) * {1 + threshold} + 1e-6 >= {threshold} * ({total_a} + {total_b})"


def pairs_with_texts(pairs: DataFrame, texts: DataFrame, hint: Callable[[DataFrame], DataFrame] = few) -> DataFrame:
    """(a, b, text_a, text_b): many a meet few b. The texts of a go to those of b; a's are found by broadcast while ``hint`` says so."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(hint(pairs), "a")
    right = texts.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
    return left.join(right.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")


class Check:
    """Compares nodes by their texts. ``texts_of`` gives (node, text) of some nodes, ``idf`` the weights of words.

    ``hint`` says which tables of pairs are broadcast: more of them pay where texts are long.
    """

    def __init__(self, texts_of: Callable[[DataFrame], DataFrame], idf: Callable, threshold: float, hint: Callable[[DataFrame], DataFrame] = few):
        self.texts_of, self.idf, self.threshold, self.hint = texts_of, idf, threshold, hint

    def bind(self, nodes: DataFrame) -> None:
        """Tells once which nodes may be compared: those in a bucket with others."""
        self.texts = stored(self.texts_of(nodes), "texts")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar; stored."""
        idf, threshold = self.idf, self.threshold

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                left, right = batch["text_a"].tolist(), batch["text_b"].tolist()
                for i, j in chunks([x + y for x, y in zip(left, right, strict=True)]):
                    weights = idf()
                    near = compare(weighted_shingles(left[i:j], weights), weighted_shingles(right[i:j], weights)) >= threshold
                    yield batch.iloc[i:j][["a", "b"]][near]

        pairs = stored(pairs, "pairs")
        return stored(pairs_with_texts(pairs, self.texts, self.hint).mapInPandas(trimmed(rows), "a long, b long"), "links")

    def prefixes(self, nodes: DataFrame) -> DataFrame:
        """(key, node, before, total) for each of ``nodes``: the shingles (key) that others have too and that may be the
        first one in common with a similar text, the weight before each in the order, and the text's; stored.

        The order is by how many of ``nodes`` have a shingle, counted in COUNTERS numbers. Shingles that share one
        count together: that changes the order and lengthens lists, never what is found.
        """
        idf, threshold = self.idf, self.threshold
        wanted = stored(self.texts.join(few(nodes), "node", "left_semi").repartition("node"), "crowded-texts")  # groups of copies lie together

        def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(COUNTERS, np.int64)
            for batch in batches:
                texts = batch["text"].tolist()
                for i, j in chunks(texts):
                    total += np.bincount((weighted_shingles(texts[i:j], idf())[0] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            seen = np.flatnonzero(total)
            yield pd.DataFrame({"counter": seen, "n": total[seen]})

        found = wanted.select("text").mapInPandas(trimmed(counts), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
        dense = np.zeros(COUNTERS, np.int64)
        dense[found["counter"].to_numpy(np.int64)] = found["n"]
        numbers = nodes.sparkSession.sparkContext.broadcast(np.minimum(dense, (1 << 31) - 1).astype(np.int32))

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts, node = batch["text"].tolist(), batch["node"].to_numpy()
                for i, j in chunks(texts):
                    h, w, at = weighted_shingles(texts[i:j], idf())
                    text = np.repeat(np.arange(j - i), np.diff(at))
                    n = numbers.value[(h % np.uint64(COUNTERS)).astype(np.int64)]
                    order = np.lexsort((h, n, text))
                    h, w, n = h[order], w[order], n[order]
                    sums = np.concatenate(([0], np.cumsum(w)))
                    before = sums[:-1] - sums[at[text]]
                    total = sums[at[text + 1]] - sums[at[text]]
                    kept = np.flatnonzero((n > 1) & (before <= (1 - threshold) * total + 1e-6))
                    yield pd.DataFrame({"key": h[kept].astype(np.int64), "node": node[i:j][text[kept]], "before": before[kept], "total": total[kept]})

        return stored(wanted.mapInPandas(trimmed(rows), "key long, node long, before long, total long"), "prefixes")
