"""Observations of packages that keep arriving: told once, joined with advisories, counted by hour.

An extension beside the batch scan.  An observation (at, repo_id, ecosystem, name,
version) may arrive again, from a retried sender or a second scan; it counts once within
the watermark, whatever batch it comes in.  Advisories are a table; Spark reads it again
for each batch, so new advisories count from the next batch on.  State is bounded by the
watermark: a key leaves it when the watermark has passed it, and what arrives later
than that is left out, as ``late`` says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.functions.versions import is_affected

LATE = "2 hours"
KEY = ("repo_id", "ecosystem", "name", "version")


def told_once(observations: DataFrame, late: str = LATE) -> DataFrame:
    """Observations without those that repeat an earlier one within ``late``; of a batch frame without any repeats."""
    marked = observations.withWatermark("at", late)
    return marked.dropDuplicatesWithinWatermark(list(KEY)) if observations.isStreaming else observations.dropDuplicates(list(KEY))


def exposed(observations: DataFrame, advisories: DataFrame) -> DataFrame:
    """(at, repo_id, ecosystem, name, version, advisory_id) of observations that an advisory
    (ecosystem, name, advisory_id, affected) affects: a join of the stream with a table."""
    right = advisories.select(F.lower("ecosystem").alias("e"), F.lower("name").alias("n"), "advisory_id", "affected")
    met = observations.join(right, (F.lower(observations["ecosystem"]) == F.col("e")) & (F.lower(observations["name"]) == F.col("n")))
    return met.where(is_affected(F.col("version"), F.col("affected"))).select("at", *KEY, "advisory_id")


def hourly(found: DataFrame) -> DataFrame:
    """(hour, advisory_id, repositories) of ``exposed``: an hour is told when the watermark has passed it."""
    return found.groupBy(F.window("at", "1 hour").alias("w"), "advisory_id").agg(F.count("*").alias("observations")).select(F.col("w.start").alias("hour"), "advisory_id", "observations")


def start(observations: DataFrame, advisories: DataFrame, out: str, checkpoint: str, late: str = LATE):
    """A query that appends what is ``exposed`` to the Parquet folder ``out``.  Stopped or lost, it goes
    on from ``checkpoint``: each observation is told exactly once."""
    found = exposed(told_once(observations, late), advisories)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
