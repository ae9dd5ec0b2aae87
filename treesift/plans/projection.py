"""Raw findings as a projection of ``lineitem``, for Spark and for the oracle.

The test tables hold no source repositories, so findings at scale come from a
fixed mapping of rows; both engines read the same one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.functions.policy import default_disposition

CATEGORIES = ("remote-fetch", "exfiltration", "host-fingerprinting", "credential-harvesting", "dynamic-execution", "process-execution", "sandbox-evasion")

_BASE = """
  concat('repo', cast(l_suppkey % 7 as {text})) AS repo_id,
  concat({path}, case when l_suppkey % 7 = 5 then '.md' else '.js' end) AS path,
  concat('R', cast(l_partkey % 7 as {text})) AS rule_id,
  case l_partkey % 7 {categories} end AS category,
  case when l_quantity > 45 and l_suppkey % 7 <> 4 then 'critical' when l_quantity > 30 then 'high'
       when l_quantity > 15 then 'medium' else 'low' end AS severity,
  case when l_discount >= 0.07 then 'high' when l_discount >= 0.03 then 'medium' else 'low' end AS confidence,
  case when l_suppkey % 7 = 5 then 'documentation' else 'executable' end AS context,
  concat('m', cast(l_linenumber % 2 as {text})) AS message,
  cast(l_partkey as int) AS start_line,
  cast(null as int) AS end_line,
  concat('e', cast(l_orderkey as {text})) AS evidence,
  1 AS occurrences
"""
_COARSE = "concat('f', cast(l_suppkey % 4 as {text}))"
_FINE = "concat('pkg', cast(l_partkey % 40 as {text}), '/f', cast(l_suppkey % 20 as {text}))"
_SEQ = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _columns(fine: bool, text: str) -> str:
    cases = " ".join(f"when {i} then '{c}'" for i, c in enumerate(CATEGORIES))
    return _BASE.format(path=(_FINE if fine else _COARSE).format(text=text), text=text, categories=cases)


def raw_findings(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    mapped = rows.selectExpr(*_split(_columns(fine, "string")), f"struct({', '.join(_SEQ)}) AS emit_seq")
    return mapped.withColumn("disposition", default_disposition(F.col("rule_id"), F.col("category"), F.col("severity"), F.col("confidence"), F.col("context")))


def _split(columns: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def raw_sql(fine: bool = False) -> str:
    """Common table expressions ``raw`` (with seq) and ``found`` (deduplicated)."""
    return f"""
raw0 AS (SELECT {_columns(fine, "varchar")}, row_number() OVER (ORDER BY {", ".join(_SEQ)}) AS seq FROM lineitem),
raw AS (
  SELECT *, CASE
    WHEN severity = 'critical' AND confidence = 'high' AND context IN ('executable', 'manifest-hook', 'ci-workflow', 'confirmed-ioc') THEN 'block'
    WHEN context = 'documentation' OR severity = 'low' OR confidence = 'low' THEN 'informational' ELSE 'review' END AS disposition
  FROM raw0
),
found AS (
  SELECT repo_id, rule_id, path, message, context, severity, confidence,
         CAST(sum(occurrences) AS BIGINT) AS occurrences, count(DISTINCT start_line) AS n_locations,
         arg_min(category, seq) AS category, arg_min(disposition, seq) AS disposition, arg_min(start_line, seq) AS line,
         arg_min(evidence, seq) AS evidence,
         'sha256:' || sha256(rule_id || chr(0) || path || chr(0) || CAST(arg_min(start_line, seq) AS varchar) || chr(0) || message) AS fingerprint
  FROM raw GROUP BY repo_id, rule_id, path, message, context, severity, confidence
)"""


#: Repositories, whether their scan was complete, and errors: 7 has no findings, 8 none but is incomplete.
COVERAGE = [(f"repo{i}", i not in (0, 5, 8), "clone failed" if i == 9 else "") for i in range(10)]


def coverage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COVERAGE, "repo_id string, complete boolean, error string")


def coverage_sql() -> str:
    values = ", ".join(f"('{r}', {str(c).lower()}, '{e}')" for r, c, e in COVERAGE)
    return f"coverage(repo_id, complete, error) AS (VALUES {values})"
