"""Files that keep arriving, scanned as a stream.

An extension beside the batch scan.  New files under a folder go through the same gate
of texts and the same pass of rules, on lines and across them, as those of a batch scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.functions.text import looks_text
from treesift.operators.rules import Rule, scan


def arriving_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """(repo_id, path, text, arrived) of new files under ``folder``/<repository>/."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    relative = F.regexp_replace("path", "^.*?\\Q" + folder.rstrip("/").split("://")[-1].lstrip("/") + "\\E/", "")
    return files.where(looks_text(F.col("content"))).select(
        F.regexp_extract(relative, "^([^/]+)/", 1).alias("repo_id"), F.regexp_replace(relative, "^[^/]+/", "").alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("modificationTime").alias("arrived"),
    )


def start_scan(files: DataFrame, rules: list[Rule], out: str, checkpoint: str):
    """A query that appends the raw findings of arriving files to the folder ``out``.

    Each micro-batch goes through the same operator as a batch scan, so results
    are the same; a batch that is run again after a failure replaces its own part."""

    def batch(df: DataFrame, number: int) -> None:
        found = scan(df.select("repo_id", "path", "text"), rules)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
