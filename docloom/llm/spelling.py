"""Spelling variants: words one edit apart, found by PartEnum signatures of their letter multisets.

A word's letter multiset is a binary vector with a dimension for each (letter, k-th occurrence). A replaced letter
moves it by at most two, an inserted or deleted one by one. Dimensions are dealt into n parts. Two vectors
that differ in at most k of them agree on all but k parts, so the enumerated projections on n - k parts, exact
signatures, meet at least once: pairs of the same length under k = 2, pairs whose lengths differ by one under k = 1.
One edit leaves the first or the last half of a word as it is, so each signature is taken once with either half. Equal
signatures are joined and each pair that met is verified by its edit distance.

A signature that more than CROWD words share isn't joined. Its words meet by what deleting
one letter at one place leaves, a key that no more words share than there are letters.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import small, stored, table, trimmed
from .divergence import HELD, split
from .textarrays import mix

#: Words have at least so many code points and so many occurrences; one (document, word) in SLIP loses a letter.
LEAST_LETTERS, LEAST_OCCURRENCES, SLIP = 5, 3, 97
#: Parts of the dimensions for words of the same length (two may differ) and of lengths that differ by one (one may).
PARTS_SAME, PARTS_OTHER = 4, 2
#: Words of one signature that are joined with each other.
CROWD = 500

#: For each byte of Latin-1: A-Z are lower case, other letters of the pattern stay, all else is a blank.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 0xC0 else 32 for i in range(256))


def slipped(run: bytes, base: int) -> bytes:
    """``run`` (Latin-1, folded) without the letter that it loses in the document whose id starts the checksum ``base``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), base)
    if h % SLIP:
        return run
    gone = h % len(run)
    return run[:gone] + run[gone + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word as far as a task has seen it."""
    held: dict[bytes, int] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        names = list(held)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([held[w] for w in part], pa.int64())], ["word", "n"])
        held.clear()

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not text:
                continue
            base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            own: Counter[bytes] = Counter()
            for runs in split(text.encode("latin-1", "replace").translate(_FOLD)):
                own.update(runs)
            for run, n in own.items():
                word = slipped(run, base)
                if len(word) >= LEAST_LETTERS:
                    held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield from passed_on()
    yield from passed_on()


def words_of(docs: DataFrame) -> DataFrame:
    """word, n: the words of ``docs`` (doc_id, text) with at least LEAST_OCCURRENCES, after the deletions that checksums choose.

    Null and empty texts have no word, a null doc_id is an empty one, repeated rows count again, an empty table has no word.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_counted), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_OCCURRENCES)


def _multisets(points: np.ndarray, owner: np.ndarray, n_words: int, parts: int) -> np.ndarray:
    """The sum of hashes of each word's dimensions in each part: equal where the projections on the part are equal."""
    order = np.lexsort((points, owner))
    p, w = points[order], owner[order]
    new = np.concatenate(([True], (p[1:] != p[:-1]) | (w[1:] != w[:-1])))
    start = np.flatnonzero(new)
    occurrence = np.arange(len(p)) - start[np.cumsum(new) - 1]
    dimension = mix((p.astype(np.uint64) << np.uint64(24)) + occurrence.astype(np.uint64) + np.uint64(1))
    out = np.zeros((n_words, parts), np.uint64)
    np.add.at(out, (w, (dimension >> np.uint64(40)) % np.uint64(parts)), dimension)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every signature of every word: role 0 joins words of one length, role 1 the shorter with role 2 the longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column("word").to_pylist()
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        length = np.array([len(w) for w in words])
        begin = np.concatenate(([0], np.cumsum(length)[:-1]))
        owner = np.repeat(np.arange(len(words)), length)
        place = np.arange(len(points)) - begin[owner]
        same, other = (_multisets(points, owner, len(words), n) for n in (PARTS_SAME, PARTS_OTHER))
        letter = points.astype(np.uint64) + np.uint64(1)
        found = []
        for role, sums, parts, apart in ((0, same, PARTS_SAME, 2), (1, other, PARTS_OTHER, 1), (2, other, PARTS_OTHER, 1)):
            shorter = length - (role == 2)
            half = shorter // 2
            # The first `half` letters, and the last `shorter - half`, numbered from the end.
            from_end = length[owner] - place
            first = np.where(place < half[owner], mix(letter * np.uint64(1009) + place.astype(np.uint64)), np.uint64(0))
            last = np.where(from_end <= (shorter - half)[owner], mix(letter * np.uint64(2003) + from_end.astype(np.uint64)), np.uint64(0))
            halves = [np.add.reduceat(x, begin) + np.uint64(k) for k, x in enumerate((first, last))]
            kind = np.uint64(2 if role else 1) * np.uint64(1 << 32) + shorter.astype(np.uint64) * np.uint64(64)
            for k, taken in enumerate(itertools.combinations(range(parts), parts - apart)):
                projection = mix(sums[:, list(taken)].sum(1, dtype=np.uint64) + kind + np.uint64(k))
                found += [(role, mix(projection + half_ * np.uint64(3))) for half_ in halves]
        signature = np.concatenate([x for _, x in found]).astype(np.int64)
        role = np.repeat(np.array([r for r, _ in found], np.int8), len(words))
        again = pa.array(np.tile(np.arange(len(words)), len(found)))
        yield pa.RecordBatch.from_arrays([pa.array(signature), pa.array(role.astype(np.int32)), batch.column("word").take(again), batch.column("n").take(again)], ["signature", "role", "word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: every pair of ``words`` (word, n; different words) that is one inserted, deleted or replaced code point apart, once."""
    signs = stored(words.mapInArrow(trimmed(_signatures), "signature long, role int, word string, n long"), "signatures")
    crowded = stored(signs.groupBy("signature").agg(F.count("*").alias("size")).where(F.col("size") > CROWD).select("signature"), "crowded")
    rest = signs.join(small(crowded), "signature", "left_anti")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("signature", F.col("role").alias(f"role_{name}"), F.col("word").alias(name), F.col("n").alias(f"n_{name}"))

    roles = "(role_a = 0 AND role_b = 0 AND a < b) OR (role_a = 1 AND role_b = 2)"
    met = side(rest, "a").join(side(rest, "b"), "signature").where(roles).where("levenshtein(a, b, 1) = 1")
    columns = ["a", "b", "n_a", "n_b"]
    pairs = met.select(*columns)
    if not crowded.isEmpty():
        dense = signs.join(small(crowded), "signature", "left_semi").select("word", "n").distinct()
        left = F.expr("explode(transform(sequence(1, char_length(word)), i -> struct(concat(left(word, i - 1), substr(word, i + 1)) AS rest, i AS place)))")
        holes = dense.select("word", "n", left.alias("hole")).select("word", "n", "hole.*")
        holes_b = holes.select("rest", "place", F.col("word").alias("b"), F.col("n").alias("n_b"))
        holes_a = holes.select("rest", "place", F.col("word").alias("a"), F.col("n").alias("n_a"))
        replaced = holes_a.join(holes_b, ["rest", "place"]).where("a < b").select(*columns)
        whole = dense.select(F.col("word").alias("a"), F.col("n").alias("n_a"))
        longer = whole.join(holes_b, F.col("a") == F.col("rest")).select(*columns)
        pairs = pairs.unionByName(replaced).unionByName(longer)
    return pairs.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain of ``forms`` (word, form) that starts at a word ends; each round doubles the steps.

    A form has at least twice the word's occurrences, so there is no circle, and no chain is longer than the bits of a count.
    """
    ways = stored(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        ways = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return ways


def spelling_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for ``words`` (word, n).

    The form of a word is its near word with the most occurrences, of several the first by code points, if it has at least
    twice the word's; root is the end of the chain of forms, or the word. n_near counts near words. An empty table
    gives an empty result.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_words(words), "near-words")
    ways = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))).alias("x")).select("x.*")
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("is_form", F.coalesce(-F.col("best.less") >= 2 * F.col("n"), F.lit(False)))
    found = stored(
        found.select("word", F.when(F.col("is_form"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), -F.col("best.less")).alias("form_n")),
        "forms",
    )
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their forms and roots."""
    return spelling_variants(words_of(table(spark, sf_dir, "documents")))

