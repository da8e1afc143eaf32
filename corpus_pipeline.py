"""A corpus pipeline over ``documents``: language, near duplicates, decontamination, personal data, token ids.

Every stage works on all rows that its predecessor kept and keeps their columns; rows with null or empty
texts, without letters, are rejected by the first, repeated rows go with the near duplicates, an empty table
stays empty, and further columns, whatever their names, are carried along up to the last stage. ``run`` writes each stage's result as Parquet in the
shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.base import short_batches, small, stored, table, unused
from docloom.llm.decontaminate import contaminated
from docloom.llm.langid import label_documents, trained_on
from docloom.llm.minhash import near_duplicates
from docloom.llm.pii import mask_pii
from docloom.llm.spm import encode_decode

#: A text stays if this share of its letters is in its language.
LANGUAGE_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with a language that holds at least LANGUAGE_SHARE of their letters; a null lang gets the language found."""
    short_batches(spark)
    found = unused(docs, "_language")
    labelled = label_documents(docs, trained_on(docs), name=found)
    kept = labelled.where((F.col(f"{found}.lang_pred") != "und") & (F.col(f"{found}.score") >= LANGUAGE_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", f"{found}.lang_pred")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: the least doc_id, of rows without one or with the same the
    least hash of the text, and one of equal rows. Rows without a doc_id stay only in classes without any other.
    """
    short_batches(spark)
    found = stored(near_duplicates(docs, keyed=True), "near-duplicates")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    id_, hash_, rows = (unused(docs, name) for name in ("_kept", "_hash", "_rows"))
    kept = found.groupBy("class_key").agg(F.min(place).alias("k"), F.count("*").alias(rows))
    kept = stored(kept.select(F.col("k.id").alias(id_), F.col("k.hash").alias(hash_), rows), "kept")
    joined = docs.join(small(kept), docs["doc_id"].cast("long").eqNullSafe(kept[id_]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(kept[hash_]))
    if kept.where(F.col(rows) > 1).isEmpty():
        return joined.select(*docs.columns)
    again = joined.where(F.col(rows) > 1).select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return joined.where(F.col(rows) == 1).select(*docs.columns).unionByName(again)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item; texts with the same doc_id, or none, are judged one by one.

    Equal texts hold the same items, so texts are known by their hash here.
    """
    keyed = docs.select(F.xxhash64(F.col("text").cast("string")).alias("doc_id"), "text")
    found = contaminated(keyed, table(spark, sf_dir, "benchmark"))
    gone = stored(found.select(F.col("doc_id").alias("_gone")).distinct(), "contaminated")
    return docs.join(small(gone), F.xxhash64(docs["text"].cast("string")) == gone["_gone"], "left_anti")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with personal data masked; n_chars is counted anew."""
    short_batches(spark)
    masked = mask_pii(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32 and round_trip of every document, under the 32,000-piece model."""
    import public_tokenizers

    short_batches(spark)
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("near_duplicates", one_of_each), ("decontamination", decontaminated), ("pii", private), ("sentencepiece", encoded)]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
