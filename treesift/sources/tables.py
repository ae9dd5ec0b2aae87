"""Tables that a scan writes once and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; one of
    our own only where that is unset and the driver runs all tasks itself."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='treesift-')}")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Bytes of a group of rows, the least that a task reads of a file: all cores get a share of texts that are slow to look at.
GROUP_BYTES = 4 << 20


def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written in the shared folder, in a folder for each value of the columns ``by``,
    and read again: worked out once, and executors that are lost later take nothing with them."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", GROUP_BYTES).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
