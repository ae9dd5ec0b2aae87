"""Digests of whole tables, by a tree of digests over ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a range that meet in one group, about.
RANGE_ROWS = 4096
_SEPARATOR = "\x1f"


def row_text(columns: list[str]) -> Column:
    """A row as text: each value as a string, or nothing for null, each with its end."""
    return F.concat(*[F.concat(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")), F.lit(_SEPARATOR)) for c in columns])


def table_digest(df: DataFrame, range_rows: int = RANGE_ROWS) -> str:
    """The SHA-256 of a table's rows in any order, as hexadecimal digits.

    A leaf is a row's digest with its number of copies; leaves of one beginning are a
    range, ranges of one shorter beginning the next, up to one.  Beginnings are as long
    as the number of rows asks for, so no group is large, whatever the table; equal rows
    are counted before they meet.  An empty table has the digest of no text."""
    leaves = df.groupBy(F.sha2(row_text(df.columns), 256).alias("leaf")).agg(F.count("*").alias("n"))
    leaves = leaves.select("leaf", F.concat("leaf", F.lit(":"), F.col("n").cast("string")).alias("line"))
    rows = leaves.count()
    digits = max(0, math.ceil(math.log(max(1, rows) / range_rows, 16)))
    level = leaves.groupBy(F.substring("leaf", 1, digits).alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))
    while digits:
        digits -= 1
        line = F.concat("at", F.lit(":"), "digest")
        level = level.groupBy(F.substring("at", 1, digits).alias("up")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest")).withColumnRenamed("up", "at")
    found = level.first()
    return found["digest"] if found else "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def digest_by(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, digest) of the rows of each key: as ``table_digest``, with beginnings of four
    hexadecimal digits, then two, then none, so one key of a billion rows is 65,536 small groups."""

    def joined(lines: Column) -> Column:
        return F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), 256).alias("digest")

    leaves = df.groupBy(key, F.sha2(row_text(list(columns)), 256).alias("leaf")).agg(F.count("*").alias("n"))
    level = leaves.groupBy(key, F.substring("leaf", 1, 4).alias("at")).agg(joined(F.concat("leaf", F.lit(":"), F.col("n").cast("string"))))
    level = level.groupBy(key, F.substring("at", 1, 2).alias("up")).agg(joined(F.concat("at", F.lit(":"), "digest")))
    return level.groupBy(key).agg(joined(F.concat("up", F.lit(":"), "digest")))
