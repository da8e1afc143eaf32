"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A shingle's weight is its count in the text times its IDF, the mean of its words' IDFs; word document
frequencies are counted exactly over all documents. A word in at most a thousandth of the documents has
the highest IDF: so only frequent words, whose number is bounded, are kept apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, small, stored, table, trimmed
from .neardup import KEYS, SIMILARITY, Check, classes, signatures, weighted_shingles
from .textarrays import chunks, words

#: Document frequencies count down to this share of all documents.
RARE = 1e-3


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, df): in how many texts of a run each word is."""
    for batch in batches:
        texts = batch["text"].tolist()
        for a, b in chunks(texts):
            word, at, _, _ = words(texts[a:b])
            text = np.repeat(np.arange(b - a), np.diff(at))
            order = np.argsort(word, kind="stable")
            word, text = word[order], text[order]
            new = np.concatenate(([True], (word[1:] != word[:-1]) | (text[1:] != text[:-1])))[: len(word)]
            word = word[new]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))[: len(word)])
            yield pd.DataFrame({"word": word[first].astype(np.int64), "df": np.diff(np.append(first, len(word)))})


def word_idf(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes of frequent words, ascending; their IDFs; the IDF of all others), IDFs 1 + ln(n / df) in thousandths.

    A text has T different words in the mean, so at most T / RARE words are frequent, however many texts there
    are: 16 bytes each on the driver and in each task, 3 MB for texts of 200 different words.
    """
    n = docs.count()
    counts = stored(docs.select("text").mapInPandas(trimmed(_word_counts), "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).where(F.col("df") > n * RARE), "word-counts")
    found = counts.toPandas()
    names = found["word"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(names)
    value = np.round(1000 * (1 + np.log(max(n, 1) / np.maximum(found["df"].to_numpy(np.float64), 1)))).astype(np.int64)
    return names[order], value[order], round(1000 * (1 + math.log(max(1, min(n, 1 / RARE)))))


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, keyed: bool = False) -> DataFrame:
    """(doc_id, class_id) of every row of ``docs``: class_id is the least doc_id of the row's class.

    Documents are linked at a weighted Jaccard similarity of ``threshold`` or more; classes are components of
    links. Texts without a word (null and empty ones too) are in no class with others: class_id is their own
    doc_id. Equal word sequences are always in one class. Repeated rows stay, with the same class. An empty
    table gives an empty result; other columns are left out. ``keyed`` adds text_hash (xxhash64 of the text) and
    class_key, which tells classes apart where doc_id is null or repeated; each text without a word has its own.
    """
    spark = docs.sparkSession
    docs = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    idf = spark.sparkContext.broadcast(word_idf(docs))

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                node, keys = signatures(*weighted_shingles(texts[a:b], idf.value), True)
                out = pd.DataFrame(keys, columns=KEYS)
                yield out.assign(doc_id=batch["doc_id"].iloc[a:b].astype("Int64").to_numpy(), text_hash=batch["text_hash"].iloc[a:b].to_numpy(), node=node)

    columns = ", ".join(f"{k} long" for k in KEYS)
    signs = stored(docs.mapInPandas(trimmed(signed), f"doc_id long, text_hash long, node long, {columns}"), "signatures")
    one = F.struct("doc_id", "text_hash")
    first = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), one)), F.min(one))
    nodes = signs.where("node <> 0").groupBy("node").agg(first.alias("first"), *[F.min(k).alias(k) for k in KEYS])
    nodes = stored(nodes.select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), *KEYS), "nodes")

    def texts_of(met: DataFrame) -> DataFrame:
        wanted = stored(nodes.select("node", "doc_id", "text_hash").join(met, "node", "left_semi"), "met")
        return docs.join(small(wanted), docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["text_hash"] == wanted["text_hash"])).select("node", "text").dropDuplicates(["node"])

    labels = classes(nodes.select("node", F.array(*KEYS).alias("keys")), Check(texts_of, lambda: idf.value, threshold, small))
    own = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = own.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = stored(own.join(least, "label").select("node", "class_id", "label"), "classes")
    alone = F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-"), F.col("text_hash").cast("string"))
    extra = ["text_hash", F.coalesce(F.col("label").cast("string"), F.concat(F.lit("alone"), alone)).alias("class_key")] if keyed else []
    return signs.select("doc_id", "node", "text_hash").join(named, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), *extra)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class."""
    return near_duplicates(table(spark, sf_dir, "documents"))
