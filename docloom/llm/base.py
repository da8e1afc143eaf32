"""What the operators of this subpackage share: tables, scratch space, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side (a few longs a row) is broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 500_000
#: The same for a single column of longs: some tens of MB.
BROADCAST_KEYS = 2_000_000
#: Rows of one Arrow batch under ``short_batches``.
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder, in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and Spark runs on this machine only (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back.

    This cuts the lineage (a lost executor costs no recomputation), runs ``df`` once, and is the only
    way intermediate results are kept here: no cache, no localCheckpoint.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored, narrow ``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def few(df: DataFrame) -> DataFrame:
    """As ``small``, for tables that grow with the documents: only tiny ones are hinted, else Spark decides by size."""
    return small(df, 20_000)


def _give_back() -> None:
    """Gives freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries give it back themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(rows):
    """``rows`` (for mapInPandas or mapInArrow), giving a task's freed memory back to the system when it ends: idle workers stay small."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            _give_back()

    return run


def short_batches(spark: SparkSession) -> None:
    """Sends at most BATCH_ROWS rows at once to Python from now on: Spark's default of 10,000 whole texts takes much memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text only: other columns, whatever their names, can't clash with ours."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
