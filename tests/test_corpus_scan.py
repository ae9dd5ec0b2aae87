"""The whole scan of the text tables, over more files than a walked repository's limit."""

import duckdb
from pyspark.sql import functions as F

from treesift.operators.rules import builtin_rules
from treesift.plans.scan_queries import CORPUS_SCAN_SQL, scan_corpus_t
from treesift.sources.files import CORPUS_SQL, MAX_FILES


def test_more_files_than_the_limit_are_scanned_whole(spark, sf_dir, tmp_path):
    """One more text than the limit of a repository, the last in order with a mail address, and
    a provider's key in a document: rows as by the SQL, and beside them those of the key, which
    a built-in rule meets and the SQL doesn't state."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.when(F.col("doc_id") == 7, F.concat("text", F.lit("\nx AKIA" + "ABCDEFGHIJKLMNOP\n"))).otherwise(F.col("text"))
    docs.withColumn("text", key).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/pages.parquet").limit(5).write.parquet(f"{tmp_path}/pages.parquet")
    last = F.col("id") == 99_999  # "chat/99999-0.md" comes after all the others
    spark.range(MAX_FILES + 1).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.when(last, "to a@b.example\n").otherwise("hello").alias("text")).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = scan_corpus_t(spark, str(tmp_path))
    got = {tuple(r[c] for c in ("repo_id", "rule_id", "findings", "occurrences", "gaps", "complete", "verdict")) for r in df.collect()}
    assert ("chat", "TXT-002", 1, 1, 0, True, "REVIEW REQUIRED") in got
    assert {r for r in got if r[1] != "SECRET-002"} == set(duck.execute(CORPUS_SCAN_SQL).fetchall())
    pattern = next(r.pattern for r in builtin_rules() if r.id == "SECRET-002")
    keys = duck.execute(f"WITH {CORPUS_SQL} SELECT repo_id, count(DISTINCT path), CAST(sum(len(regexp_extract_all(line, '{pattern}'))) AS bigint) FROM lines WHERE regexp_matches(line, '{pattern}') GROUP BY 1").fetchall()
    assert len(keys) == 1 and {(r[0], r[2], r[3]) for r in got if r[1] == "SECRET-002"} == set(keys)
