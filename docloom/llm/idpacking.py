"""Token ids as fixed-width bit-packed blocks: the file format, its writer and its reader.

A file is a Parquet table with one row per block, so that Spark's committed writes, any store that Spark
reaches and the loss of an executor need no code here. A block holds whole texts in ascending id order:

    file long, block long    the file (partition) and the block's number in it, both ascending with doc_id
    first long               ids of all texts in the blocks before this one
    width int                bits per id: the least that hold the vocabulary's ids
    doc_ids array<long>      the texts of the block
    offsets array<long>      where each text starts in the block, in ids; one more number ends the last
    payload binary           the ids, ``width`` bits each, lowest bit first, the last byte filled with zeros

Text i of a block is bits ``offsets[i] * width`` to ``offsets[i + 1] * width`` of its payload: any text or
id is reached without unpacking what stands before it.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents, small, stored, table
from .piececache import PieceCache
from .textarrays import chunks

#: Ids after which a block ends with the text at hand.
BLOCK_IDS = 1 << 17
BLOCK_SCHEMA = "block long, width int, doc_ids array<long>, offsets array<long>, payload binary"


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each, lowest bit first."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(ids, f"<u{width // 8}").tobytes()
    bits = (np.asarray(ids, np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of a payload, read from the bytes that hold them and no others."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", end - start, start * (width // 8)).astype(np.uint32)
    first = start * width // 8
    raw = np.frombuffer(payload, np.uint8, (end * width + 7) // 8 - first, first)
    bits = np.unpackbits(raw, bitorder="little")[start * width - 8 * first :][: (end - start) * width]
    return bits.reshape(-1, width).astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


class PieceEncoder(PieceCache):
    """Encodes texts with a byte-level BPE of the tokenizers library, each distinct piece once.

    The library's pre-tokenizer never joins a character that isn't white space to white space after it, so
    a text can be cut there without a change to its ids. The pieces (white space and what follows up to the
    next white space) repeat a lot. Only new ones go to the library, many in one string, which is cut again
    by the bytes that each id stands for.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.width = max(1, (size - 1).bit_length())
        super().__init__(np.uint16 if self.width <= 16 else np.uint32)
        self.id_bytes = np.array([len(self.tokenizer.id_to_token(i)) for i in range(size)], np.int64)
        # White space as the library sees it: without four control characters that Python counts too.
        self.space = np.fromiter((chr(i).isspace() and not 0x1C <= i <= 0x1F for i in range(0x110000)), bool, 0x110000)

    def cuts(self, points: np.ndarray) -> np.ndarray:
        space = self.space[points]
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        return cut

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs: list[list[str]] = []
        for i, piece in enumerate(pieces):  # a piece that can't follow another begins a string of its own
            if not runs or len(runs[-1]) >= 1000 or not self.space[ord(piece[0])] or self.space[ord(pieces[i - 1][-1])]:
                runs.append([])
            runs[-1].append(piece)
        found = self.tokenizer.encode_batch_fast(["".join(x) for x in runs], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, self.flat.dtype) for x in found])
        ends = np.cumsum(np.fromiter((len(x.encode()) for x in pieces), np.int64, len(pieces)))
        cut = np.searchsorted(np.cumsum(self.id_bytes[ids]), ends) + 1
        return ids, np.diff(np.concatenate(([0], cut)))


@functools.lru_cache(1)
def encoder_of(path: str) -> PieceEncoder:
    """The encoder of a Python worker, which keeps its pieces from task to task."""
    return PieceEncoder(path)


def _texts(batches: Iterator[pd.DataFrame], limit: int):
    """Runs of (ids, texts) of about ``limit`` characters."""
    for batch in batches:
        keys, texts = batch["doc_id"].tolist(), batch["text"].tolist()
        for a, b in chunks(texts, limit):
            yield keys[a:b], texts[a:b]


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and stores them as blocks in ascending doc_id order; returns the stored table.

    A null text is empty; every text ends with ``end_id`` unless that is None. Null ids come first; rows with
    the same doc_id stay apart. An empty table gives a file without blocks. One text, however long, is in
    one block. Memory is bounded by BLOCK_IDS ids and one batch of texts.
    """

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer_path)
        number, total, held, keys, sizes = 0, 0, [], [], []

        def block() -> pd.DataFrame:
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            return pd.DataFrame({"block": [number], "width": [encoder.width], "doc_ids": [keys], "offsets": [offsets], "payload": [pack(np.concatenate(held), encoder.width)]})

        for doc_ids, texts in _texts(batches, 1_000_000):
            ids, at = encoder(texts)
            for i, key in enumerate(doc_ids):
                own = ids[at[i] : at[i + 1]]
                if end_id is not None:
                    own = np.append(own, own.dtype.type(end_id))
                held.append(own)
                keys.append(None if pd.isna(key) else int(key))
                sizes.append(len(own))
                total += len(own)
                if total >= BLOCK_IDS:
                    yield block()
                    number, total, held, keys, sizes = number + 1, 0, [], [], []
        if keys:
            yield block()

    # Rows with the same doc_id, or none, are dealt by their texts too: no partition need hold all of them.
    ordered = documents(docs).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    packed = ordered.mapInPandas(blocks, BLOCK_SCHEMA).withColumn("file", F.spark_partition_id().cast("long"))
    return stored(packed.select("file", "block", "width", "doc_ids", "offsets", "payload"), "token-blocks")


def with_first(blocks: DataFrame) -> DataFrame:
    """Adds ``first`` from prefix sums of the files' totals (one row a file) and of the blocks inside a file."""
    sizes = blocks.select("file", "block", F.element_at("offsets", -1).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = sizes.groupBy("file").agg(F.sum("n").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_first"))
    within = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select("file", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("in_file"))
    first = placed.join(F.broadcast(files), "file").select("file", "block", (F.col("file_first") + F.col("in_file")).alias("first"))
    return blocks.join(small(stored(first, "block-firsts")), ["file", "block"])  # three numbers for each 2 ** 17 ids


def read_ids(blocks: DataFrame) -> DataFrame:
    """What the stored blocks hold: doc_id, start, n_tokens and ids_crc32 of every text, unpacked from the payloads."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                offsets = np.asarray(row.offsets, np.int64)
                ids = unpack(row.payload, row.width, 0, int(offsets[-1])).astype("<u4")
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                keys = pd.array([None if pd.isna(k) else int(k) for k in row.doc_ids], "Int64")
                yield pd.DataFrame({"doc_id": keys, "start": row.first + offsets[:-1], "n_tokens": np.diff(offsets), "ids_crc32": crc})

    return with_first(blocks).mapInPandas(texts, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_text_ids(blocks: DataFrame, doc_ids: list[int]) -> DataFrame:
    """Random access: the ids of some texts, unpacked from their own bits only; doc_id, ids."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = set(doc_ids)
        for batch in batches:
            for row in batch.itertuples(index=False):
                for i, key in enumerate(row.doc_ids):
                    if key in wanted:
                        ids = unpack(row.payload, row.width, int(row.offsets[i]), int(row.offsets[i + 1]))
                        yield pd.DataFrame({"doc_id": [int(key)], "ids": [ids.astype(np.int64)]})

    found = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(i)).cast("long") for i in doc_ids])))
    return found.mapInPandas(texts, "doc_id long, ids array<long>")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as 50,257-piece byte-level BPE ids in 16-bit blocks, read back from the stored blocks."""
    import public_tokenizers

    blocks = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    return read_ids(blocks)
