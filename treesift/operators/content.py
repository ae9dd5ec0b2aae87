"""Detectors and statistics of file content that need no parser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treesift.functions.paths import classify_context
from treesift.functions.text import DENSE_ENTROPY, DENSE_LINE, LONG_LINE, NEAR, entropy, heuristics_apply, is_dangerous, split_lines


def plain_lines(files: DataFrame) -> DataFrame:
    """(repo_id, path, line_no, line)."""
    return files.select("repo_id", "path", F.posexplode(split_lines(F.col("text"))).alias("at", "line")).select("repo_id", "path", (F.col("at") + 1).alias("line_no"), "line")


def line_statistics(files: DataFrame) -> DataFrame:
    """Lines, bytes, and the longest line of each file, without making rows of lines."""
    sizes = F.transform(split_lines(F.col("text")), F.octet_length)
    return files.select("repo_id", "path", F.size(sizes).alias("lines"), F.octet_length("text").alias("bytes"), F.coalesce(F.array_max(sizes), F.lit(0)).alias("longest"))


def long_lines(files: DataFrame) -> DataFrame:
    """Very long lines outside generated files."""
    kept = files.where(heuristics_apply(F.col("path")))
    return long_ones(plain_lines(kept).where(F.octet_length("line") > LONG_LINE))


def long_ones(lines: DataFrame) -> DataFrame:
    return lines.select("repo_id", "path", "line_no", F.octet_length("line").alias("bytes"), classify_context(F.col("path"), F.col("line")).alias("context")).where("context <> 'generated'")


def dense_lines(files: DataFrame, near: int = NEAR) -> DataFrame:
    """Lines of high entropy with a call that executes within ``near`` lines of them.

    The range predicate becomes flags of neighbours inside each file's own array
    of lines, so no window and no shuffle is needed."""
    lines = split_lines(F.col("text"))
    kept = files.where(heuristics_apply(F.col("path"))).withColumn("lines", lines)
    risky = kept.where(F.exists("lines", is_dangerous)).withColumn("risky", F.transform("lines", lambda x: is_dangerous(x)))
    rows = risky.select("repo_id", "path", "risky", F.posexplode("lines").alias("at", "line")).where(F.octet_length("line") >= DENSE_LINE)
    around = F.slice("risky", F.greatest(F.col("at") + 1 - near, F.lit(1)), F.lit(near) + 1 + F.least(F.col("at"), F.lit(near)))
    return dense_ones(rows.where(F.exists(around, lambda x: x)).select("repo_id", "path", (F.col("at") + 1).alias("line_no"), "line"))


def dense_ones(lines: DataFrame) -> DataFrame:
    """Those of high entropy among lines beside a call that executes."""
    dense = lines.withColumn("entropy", entropy(F.col("line"))).where(F.col("entropy") >= DENSE_ENTROPY)
    context = classify_context(F.col("path"), F.col("line"))
    return dense.select(
        "repo_id", "path", "line_no", F.round("entropy", 4).alias("entropy"), context.alias("context"),
        F.when(context == "executable", "medium").otherwise("low").alias("confidence"),
        F.format_string("entropy: %.2f; length: %d", F.col("entropy"), F.octet_length("line")).alias("evidence"),
    )


def line_entropy(files: DataFrame, at_least: float = DENSE_ENTROPY) -> DataFrame:
    lines = plain_lines(files).where(F.octet_length("line") >= DENSE_LINE)
    return lines.select("repo_id", "path", "line_no", F.round(entropy(F.col("line")), 4).alias("entropy")).where(F.col("entropy") >= at_least)


def hash_matches(files: DataFrame, indicators: DataFrame) -> DataFrame:
    """Files whose SHA-256 is an indicator's (sha256, family).  The planner sends
    the indicators to all tasks where they are small and shuffles digests, never
    texts, where they are not."""
    digests = files.select("repo_id", "path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    last = indicators.groupBy(F.lower("sha256").alias("sha256")).agg(F.max("family").alias("family"))
    return digests.join(last, "sha256").select("repo_id", "path", "sha256", "family")


def duplicate_files(files: DataFrame) -> DataFrame:
    """Contents that stand in more than one file, with their number and first path."""
    digests = files.select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "path", F.octet_length("text").alias("bytes"))
    return digests.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("path").alias("first_path"), F.max("bytes").alias("bytes")).where("copies > 1")


def coverage(files: DataFrame, max_bytes: int, skipped: DataFrame | None = None) -> DataFrame:
    """Counters of each repository's scan; what is too large is skipped and makes it
    incomplete, and so does each row of ``skipped`` (repo_id, path, reason)."""
    size = F.octet_length("text")
    out = files.groupBy("repo_id").agg(
        F.count("*").alias("files_scanned"),
        F.sum(F.when(size <= max_bytes, size).otherwise(0)).alias("bytes_scanned"),
        F.count_if(size > max_bytes).alias("skipped"),
        F.bool_and(size <= max_bytes).alias("complete"),
    )
    if skipped is None:
        return out
    more = skipped.groupBy("repo_id").agg(F.count("*").alias("more"))
    return out.join(more, "repo_id", "left").select(
        "repo_id", "files_scanned", "bytes_scanned", (F.col("skipped") + F.coalesce("more", F.lit(0))).alias("skipped"), (F.col("complete") & F.col("more").isNull()).alias("complete")
    )


def hygiene(repos: DataFrame, files: DataFrame) -> DataFrame:
    """Missing readme or license at the top of each repository, also of empty ones."""
    name = F.lower("path")
    top = files.where(~F.col("path").contains("/"))
    has = top.groupBy("repo_id").agg(
        F.bool_or((name == "readme") | name.startswith("readme.")).alias("readme"),
        F.bool_or((name == "license") | name.startswith("license.") | (name == "copying")).alias("license"),
    )
    both = repos.select("repo_id").join(has, "repo_id", "left").fillna(False, ["readme", "license"])
    missing = F.array_compact(F.array(F.when(~F.col("readme"), "REPO-001"), F.when(~F.col("license"), "REPO-002")))
    return both.select("repo_id", F.explode(missing).alias("rule_id"))


def first_of_section(lines: DataFrame, *keys: str) -> DataFrame:
    """The first line of each group of ``keys`` in a file."""
    return lines.withColumn("turn", F.row_number().over(Window.partitionBy("repo_id", "path", *keys).orderBy("line_no"))).where("turn = 1").drop("turn")
