"""Repeated passages: runs of 50 words or more that stand somewhere else too, wherever lines begin or end.

Words are compared, so line breaks, case and punctuation don't matter. Of each text the least hash of every 26
consecutive 25-word runs is a seed (winnowing): two texts with a run of 50 words in common share a seed in it.
Only windows of 50 words around seeds that occur twice are hashed and counted, each at every position, so the
result is exact. The first occurrence of a window stays; windows that follow another and repeat the same text
are merged into one span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents, small, stored, table
from .paragraphs import repeated_paragraphs
from .textarrays import chunks, span_hashes, words

#: Words of the shortest repeated passage, and of the seeds that lead to it.
PASSAGE_WORDS, SEED_WORDS = 50, 25


def _runs(word: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that begin at ``first``."""
    return span_hashes(word, first, first + n)


def _window_starts(at: np.ndarray) -> np.ndarray:
    """Words at which a window of PASSAGE_WORDS begins that ends in the same text."""
    room = np.repeat(at[1:], np.diff(at)) - np.arange(at[-1])
    return np.flatnonzero(room >= PASSAGE_WORDS)


def _seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, text_hash, at, seed): the seeds of each text and the word where they begin."""
    for batch in batches:
        ids, hashes, texts = batch["doc_id"].astype("Int64"), batch["text_hash"].to_numpy(), batch["text"].tolist()
        for a, b in chunks(texts):
            word, at, _, _ = words(texts[a:b])
            begin = _window_starts(at)
            if not len(begin):
                continue
            runs = _runs(word, np.arange(len(word) - SEED_WORDS + 1), SEED_WORDS)
            seen = np.lib.stride_tricks.sliding_window_view(runs, PASSAGE_WORDS - SEED_WORDS + 1)
            found = np.unique(np.concatenate([x + seen[x].argmin(1) for x in np.array_split(begin, len(begin) // 50_000 + 1)]))
            text = np.searchsorted(at, found, "right") - 1
            yield pd.DataFrame({"doc_id": ids.iloc[a + text].to_numpy(), "text_hash": hashes[a + text], "at": found - at[text], "seed": runs[found].astype(np.int64)})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, text_hash, at, start, end, window): the windows of PASSAGE_WORDS that hold one of ``seeds``."""
    for batch in batches:
        ids, hashes, texts = batch["doc_id"].astype("Int64"), batch["text_hash"].to_numpy(), batch["text"].tolist()
        seeds = batch["seeds"].tolist()
        for a, b in chunks(texts):
            word, at, first, end = words(texts[a:b])
            seed = np.concatenate([np.asarray(x, np.int64) + y for x, y in zip(seeds[a:b], at[:-1], strict=True)])
            change = np.zeros(len(word) + 2, np.int64)
            np.add.at(change, np.maximum(seed - (PASSAGE_WORDS - SEED_WORDS), 0), 1)
            np.add.at(change, seed + 1, -1)
            begin = _window_starts(at)
            begin = begin[np.cumsum(change)[begin] > 0]
            text = np.searchsorted(at, begin, "right") - 1
            zero = np.cumsum([0, *(len(x or "") + 1 for x in texts[a:b])])[text]
            yield pd.DataFrame(
                {
                    "doc_id": ids.iloc[a + text].to_numpy(),
                    "text_hash": hashes[a + text],
                    "at": begin - at[text],
                    "start": first[begin] - zero,
                    "end": end[begin + PASSAGE_WORDS - 1] - zero,
                    "window": _runs(word, begin, PASSAGE_WORDS).astype(np.int64),
                }
            )


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, keep_doc_id, n_words, start, end) of whole texts, of those with PASSAGE_WORDS words or more."""
    for batch in batches:
        texts = batch["text"].tolist()
        for a, b in chunks(texts):
            _, at, first, end = words(texts[a:b])
            zero = np.cumsum([0, *(len(x or "") + 1 for x in texts[a:b])])
            long = np.flatnonzero(np.diff(at) >= PASSAGE_WORDS)
            part = batch.iloc[a + long][["doc_id", "keep_doc_id"]].astype("Int64")
            yield part.assign(n_words=np.diff(at)[long], start=first[at[long]] - zero[long], end=end[at[long + 1] - 1] - zero[long])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Every run of PASSAGE_WORDS words or more that occurs more than once, in the same document or another.

    Returns doc_id, start and end (code points), n_words, keep_doc_id and keep_start (where the first occurrence
    of its first words begins: least doc_id, rows without one last, then place), removed (false for first occurrences). A copy of
    a whole text is one passage. Occurrences in one text that overlap aren't repeats of each other. Equal rows
    (doc_id and text) are one document. Texts of fewer words, empty and null ones have no passage.
    """
    docs = documents(docs).where("text IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    named = docs.select("doc_id", "text_hash").distinct()
    kept = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("kept")
    several = named.groupBy("text_hash").agg(kept, F.count("*").alias("n")).where("n > 1").select("text_hash", F.col("kept.id").alias("keep_doc_id"))
    copies = named.join(several, "text_hash").where(~F.col("doc_id").eqNullSafe(F.col("keep_doc_id")))
    copies = stored(copies.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "keep_doc_id"), "copies")
    is_copy = docs["doc_id"].eqNullSafe(copies["_doc"]) & (docs["text_hash"] == copies["_hash"])
    copied = docs.join(small(copies), is_copy).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "keep_doc_id", "text")
    copied = copied.mapInPandas(_whole, "doc_id long, keep_doc_id long, n_words long, start long, end long")
    copied = stored(copied.withColumn("keep_start", F.col("start")).withColumn("removed", F.lit(True)), "whole-copies")
    own = docs.join(small(copies), is_copy, "left_anti")

    seeds = stored(own.mapInPandas(_seeds, "doc_id long, text_hash long, at long, seed long"), "seeds")
    twice = stored(seeds.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "seeds-twice")
    places = seeds.join(small(twice), "seed").groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set("at").alias("seeds"))
    places = stored(places, "seeded")
    seeded = own.join(places, own["doc_id"].eqNullSafe(places["_doc"]) & (own["text_hash"] == places["_hash"])).select("doc_id", "text_hash", "text", "seeds")
    windows = stored(seeded.mapInPandas(_windows, "doc_id long, text_hash long, at long, start long, end long, window long"), "windows")

    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "at", "start")
    same = "a.hash <=> b.hash AND a.id <=> b.id"
    firsts = windows.groupBy("window").agg(F.min(place).alias("a"), F.max(place).alias("b")).where(f"NOT ({same}) OR b.at >= a.at + {PASSAGE_WORDS}")
    firsts = stored(firsts.select("window", "a"), "first-windows")
    met = windows.join(small(firsts), "window").withColumn("here", F.expr("a.hash = text_hash AND a.id <=> doc_id"))
    met = met.withColumn("removed", ~(F.col("here") & (F.col("a.at") == F.col("at"))))
    met = met.where(f"NOT removed OR NOT here OR at >= a.at + {PASSAGE_WORDS}")
    run = ["doc_id", "text_hash", "removed", F.col("a.id"), F.col("a.hash")]
    met = met.withColumn("run", F.col("at") - F.dense_rank().over(Window.partitionBy(*run).orderBy("at")))
    spans = met.groupBy("doc_id", "text_hash", "removed", F.col("a.id").alias("keep_doc_id"), F.col("a.hash").alias("_hash"), "run")
    spans = spans.agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("at") - F.min("at") + PASSAGE_WORDS).alias("n_words"), F.min_by("a.start", "at").alias("keep_start"))
    columns = ["doc_id", "start", "end", "n_words", "keep_doc_id", "keep_start", "removed"]
    return spans.select(*columns).unionByName(copied.select(*columns))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated line (as op2_paragraphs gives it) and every repeated passage, whose paragraph is NULL."""
    docs = table(spark, sf_dir, "documents")
    return repeated_paragraphs(docs, blocks=False).unionByName(repeated_passages(docs), allowMissingColumns=True)
