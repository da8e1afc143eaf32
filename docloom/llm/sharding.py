"""Contiguous shards of near-equal bytes, by global prefix sums of per-partition totals.

Rows are ordered by id with a range exchange. Every partition contributes one total; the prefix sums of
those totals (one row a partition) give each partition its offset, a running sum inside the partition
gives each row its global byte position, and cuts at equal byte targets give the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents, stored, table, unused


def byte_shards(rows: DataFrame, n_shards: int, order: list[str], size: str = "size") -> DataFrame:
    """Adds ``shard`` (0..n_shards-1) and ``slot`` (gapless from 0 inside the shard) to ``rows``.

    A row goes to the shard in whose byte range its middle lies, so a shard's bytes are within one row of
    its target on either side. Sizes must be positive; a row larger than a target leaves shards empty.
    Nulls in ``order`` come first, ties are broken by the other columns of ``order`` and are otherwise
    interchangeable. An empty table gives an empty result. Other columns are carried along unchanged, whatever their names: a
    ``shard`` or ``slot`` of the input stays, and the new column's name then begins with an underscore.
    """
    part, bytes_, rows_, before_bytes, before_rows, whole_, sum_, row_, at_, first_, shard, slot = (
        unused(rows, name) for name in ("_part", "_bytes", "_rows", "_bytes_before", "_rows_before", "_total", "_sum", "_row", "_at", "_first", "shard", "slot")
    )
    ordered = rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    ordered = stored(ordered, "shard-rows")  # the partition numbers must not change between the two uses
    totals = ordered.groupBy(part).agg(F.sum(size).alias(bytes_), F.count("*").alias(rows_))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select(
        part,
        F.coalesce(F.sum(bytes_).over(before), F.lit(0)).alias(before_bytes),
        F.coalesce(F.sum(rows_).over(before), F.lit(0)).alias(before_rows),
    )
    whole = totals.agg(F.sum(bytes_).alias(whole_))
    within = Window.partitionBy(part).orderBy(*order)
    placed = (
        ordered.withColumn(sum_, F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(row_, F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), part)  # one row a partition
        .join(F.broadcast(whole))  # one row
    )
    # In whole numbers: twice the middle over twice the total.
    placed = placed.withColumn(shard, F.least(F.lit(n_shards - 1), F.expr(f"({n_shards} * (2 * (`{before_bytes}` + `{sum_}`) - `{size}`)) div (2 * `{whole_}`)")).cast("int"))
    placed = placed.withColumn(at_, F.col(before_rows) + F.col(row_))
    first = placed.groupBy(shard).agg(F.min(at_).alias(first_))  # one row a shard
    return placed.join(F.broadcast(first), shard).withColumn(slot, (F.col(at_) - F.col(first_)).cast("long")).select(*rows.columns, shard, slot)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law ``bytes``; a null text has size 1 and the crc32 of no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    sharded = byte_shards(rows, 8, ["doc_id", "text_crc32", "size"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
