"""Tables that a plan reads several times, written once where all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of each application that has none of its own and runs on this machine only.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without one: a temporary folder where Spark runs on this machine only, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[application]


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: it is computed once, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
