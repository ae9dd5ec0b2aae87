"""Queries over the finding-shaped projection, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.functions.digests import digest_by
from treesift.operators import display, report
from treesift.operators import findings as ops
from treesift.plans.projection import coverage, coverage_sql, raw_findings, raw_sql

#: Location limits of the test query; the real ones do not bind at small scale.
PER_FINDING, PER_REPO = 20, 2_000
TODAY = "2024-06-30"

RANK = "CASE {} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
CONF = "CASE {} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
DISP = "CASE {} WHEN 'block' THEN 4 WHEN 'review' THEN 3 WHEN 'harden' THEN 2 ELSE 1 END"
TAIL = f"{RANK.format('severity')} DESC, {CONF.format('confidence')} DESC, path, line, rule_id, message, fingerprint, context"
LEAD = f"{DISP.format('disposition')} DESC"


def _found(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    return ops.dedup(raw_findings(spark, sf_dir, fine), count_places=False)


def finding_dedup_f(spark, sf_dir):
    return ops.dedup(raw_findings(spark, sf_dir)).drop("emit_seq")


def location_caps_f(spark, sf_dir):
    return ops.location_caps(raw_findings(spark, sf_dir), PER_FINDING, PER_REPO)


def correlate_combo_f(spark, sf_dir):
    out = ops.correlate(_found(spark, sf_dir, fine=True))
    return out.select("repo_id", "path", "rule_id", "category", "severity", "line", "fingerprint", F.array_join("contributing_rule_ids", ",").alias("contributors"))


def _suppressions(findings: DataFrame) -> DataFrame:
    """A suppression for every finding of rule R1: of repo1 expired, of repo2 in force to the day, else for good."""
    expires = F.when(F.col("repo_id") == "repo1", "2024-06-29").when(F.col("repo_id") == "repo2", TODAY)
    return findings.where("rule_id = 'R1'").select("fingerprint", F.lit("reviewed").alias("reason"), expires.alias("expires"))


def suppress_active_f(spark, sf_dir):
    found = _found(spark, sf_dir)
    left = ops.unsuppressed(found, _suppressions(found), F.lit(TODAY).cast("date"))
    return left.select("repo_id", "rule_id", "path", "message", "context", "severity", "confidence", "fingerprint")


def _results(spark, sf_dir):
    return ops.repository_results(_found(spark, sf_dir), coverage(spark))


def verdict_f(spark, sf_dir):
    return _results(spark, sf_dir).select("repo_id", "findings", "verdict")


def exit_code_f(spark, sf_dir):
    return _results(spark, sf_dir).select("repo_id", "exit_code")


def decision_status_f(spark, sf_dir):
    return _results(spark, sf_dir).select("repo_id", "decision_status")


def severity_counts_f(spark, sf_dir):
    return ops.severity_counts(_found(spark, sf_dir))


def disposition_counts_f(spark, sf_dir):
    return ops.disposition_counts(_found(spark, sf_dir))


def file_hotspots_f(spark, sf_dir):
    return ops.file_hotspots(_found(spark, sf_dir, fine=True))


def facets_f(spark, sf_dir):
    return ops.facets(_found(spark, sf_dir, fine=True))


def sarif_rules_f(spark, sf_dir):
    return ops.sarif_rules(_found(spark, sf_dir))


def combo_locations_f(spark, sf_dir):
    """The places that each finding of signals that meet names."""
    raw = raw_findings(spark, sf_dir, True)
    return ops.combination_locations(raw, ops.correlate(ops.dedup(raw, count_places=False)), 5)


def summary_lines_f(spark, sf_dir):
    """What a terminal shows of each repository, a row a line."""
    return display.summary_lines(_found(spark, sf_dir), coverage(spark), "review", "medium", "medium")


def shown_values_f(spark, sf_dir):
    """Sizes and durations as they are shown, of the prices and keys of line items."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = lambda c: F.col(c).cast("decimal(19,0)")  # products of large keys do not fit a long
    size = key("l_orderkey") * key("l_partkey") * key("l_suppkey")
    time = key("l_orderkey") * key("l_partkey") * F.when(F.col("l_linenumber") % 2 == 0, 1_000_000).otherwise(1_000_000_000)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", display.byte_size(size).alias("size"), display.duration(time).alias("time"))


def sarif_log_f(spark, sf_dir):
    """The rules, results and outcome that each repository's log says, read back from its parts."""
    logs = report.sarif_log(_found(spark, sf_dir), coverage(spark), 50)
    said = "runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string, shortDescription: struct<text: string>, properties: struct<severity: string>>>>>, results: array<struct<ruleId: string, level: string>>, invocations: array<struct<executionSuccessful: boolean>>>>"
    run = logs.select("repo_id", F.from_json("log", said)["runs"][0].alias("run")).select("repo_id", "run.results", F.col("run.tool.driver.rules").alias("rules"), F.col("run.invocations")[0]["executionSuccessful"].alias("successful"))
    results = run.groupBy("repo_id").agg(F.sum(F.size("results")).alias("results"), F.sum(F.size(F.filter("results", lambda r: r["level"] == "error"))).alias("errors"), F.bool_and("successful").alias("successful"))
    rules = run.select("repo_id", F.explode("rules").alias("r")).distinct().groupBy("repo_id").agg(F.count("*").alias("rules"), F.max_by(F.concat("r.shortDescription.text", F.lit(" "), "r.properties.severity"), "r.id").alias("last_rule"))
    return results.join(rules, "repo_id", "left").fillna(0, ["rules"])


def report_digest_f(spark, sf_dir):
    """A digest of each repository's findings, in whatever order they are."""
    return digest_by(_found(spark, sf_dir, fine=True), "repo_id", *DIGESTED)


DIGESTED = ("rule_id", "path", "message", "context", "severity", "confidence", "occurrences", "fingerprint")


def review_queue_f(spark, sf_dir):
    shown = ops.visible(_found(spark, sf_dir, fine=True), "review", "medium", "medium")
    return ops.presentation_rank(shown, "file").select("repo_id", "path", "line", "rule_id", "message", "severity", "confidence", "rank")


def search_facets_f(spark, sf_dir):
    return ops.search(_found(spark, sf_dir, fine=True), text="PKG3", category="exfiltration", actionable=True).select("repo_id", "path", "rule_id", "message", "severity", "confidence")


def top_finding_f(spark, sf_dir):
    return ops.top_finding(_found(spark, sf_dir))


def result_order_f(spark, sf_dir):
    return ops.presentation_rank(_found(spark, sf_dir)).select("repo_id", "rule_id", "path", "message", "context", "severity", "confidence", "rank")


def group_headers_f(spark, sf_dir):
    return ops.group_headers(_found(spark, sf_dir), "severity")


def fix_count_f(spark, sf_dir):
    remedies = spark.createDataFrame([(f"R{i}", "Review it." if i % 2 else "") for i in range(6)], "rule_id string, remediation string")
    return ops.fix_count(_found(spark, sf_dir), remedies)


def location_tree_f(spark, sf_dir):
    return ops.location_tree(ops.stored_locations(raw_findings(spark, sf_dir), PER_FINDING, PER_REPO))


def report_validate_f(spark, sf_dir):
    """The projection as a report with some faults put in, and what validation says of each repository."""
    found = _found(spark, sf_dir)
    broken = found.withColumn("severity", F.when((F.col("repo_id") == "repo3") & (F.col("rule_id") == "R2"), "urgent").otherwise(F.col("severity")))
    results = _results(spark, sf_dir).join(coverage(spark), "repo_id").withColumn("verdict", F.when(F.col("repo_id") == "repo4", "NO FINDINGS").otherwise(F.col("verdict")))
    return report.validation(results.select("repo_id", "complete", "error", "verdict"), broken)


def report_caps_f(spark, sf_dir):
    """Rows of the projection as locations of findings in a loaded report: a finding is an order."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("repo"), (F.col("l_suppkey") % 7).cast("string")).alias("repo_id"), F.col("l_orderkey").alias("finding"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"))
    kept = report.capped_locations(rows, 2, PER_REPO // 4)
    return kept.groupBy("repo_id", "finding").agg(F.count("*").alias("kept"))


_RESULTS = f"""
WITH {raw_sql()}, {coverage_sql()},
flags AS (
  SELECT repo_id, count(*) AS n, bool_or(severity = 'critical' AND confidence = 'high' AND context = 'executable') AS blocking,
         max({RANK.format("severity")}) AS top FROM found GROUP BY repo_id
),
results AS (
  SELECT c.repo_id, c.complete, c.error, coalesce(n, 0) AS findings, coalesce(top, 0) AS top,
         CASE WHEN error <> '' THEN 'SCAN INCOMPLETE' WHEN coalesce(blocking, false) THEN 'DO NOT RUN' WHEN NOT complete THEN 'SCAN INCOMPLETE'
              WHEN coalesce(n, 0) > 0 THEN 'REVIEW REQUIRED' ELSE 'NO FINDINGS' END AS verdict
  FROM coverage c LEFT JOIN flags f ON c.repo_id = f.repo_id
)
"""
_STORED = f"""
WITH {raw_sql()},
places AS (SELECT repo_id, rule_id, path, message, context, severity, confidence, start_line, min(seq) AS seq FROM raw GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY repo_id, rule_id, path, message, context, severity, confidence ORDER BY seq) AS n FROM places),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY seq) AS m FROM k WHERE n <= {PER_FINDING}),
stored AS (SELECT * FROM r WHERE m <= {PER_REPO})
"""


def _combo_sql() -> str:
    sets = {"network": "'remote-fetch', 'exfiltration'", "fingerprint": "'host-fingerprinting'", "environment": "'credential-harvesting', 'environment-access', 'secret'", "execution": "'dynamic-execution', 'process-execution'", "evasion": "'sandbox-evasion'"}
    aggregates = ", ".join(f"coalesce(list(DISTINCT rule_id) FILTER (WHERE category IN ({c})), []) AS {s}, min(line) FILTER (WHERE category IN ({c})) AS {s}_line" for s, c in sets.items())
    parts = []
    for rule, category, severity, _, used in ops.COMBINATIONS:
        condition = "len(network) > 0 AND (len(fingerprint) > 0 OR len(environment) > 0)" if rule == "COMBO-001" else " AND ".join(f"len({s}) > 0" for s in used)
        contributors = "[]"
        for s in used:
            contributors = f"list_concat({contributors}, {s})"
        parts.append(
            f"SELECT repo_id, path, '{rule}' AS rule_id, '{category}' AS category, '{severity}' AS severity, least({', '.join(s + '_line' for s in used)}) AS line, "
            f"'sha256:' || sha256('{rule}' || chr(0) || path) AS fingerprint, array_to_string(list_sort(list_distinct({contributors})), ',') AS contributors FROM s WHERE {condition}"
        )
    return f"WITH {raw_sql(True)}, s AS (SELECT repo_id, path, {aggregates} FROM found WHERE confidence <> 'low' AND context = 'executable' AND disposition <> 'informational' GROUP BY repo_id, path) " + " UNION ALL ".join(parts)


_COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low"))
_DISPOSITIONS = ", ".join(f"count(*) FILTER (WHERE disposition = '{d}') AS {d}" for d in ("block", "review", "harden", "informational"))
_ACTIONABLE = ", ".join(f"count(*) FILTER (WHERE disposition <> 'informational' AND severity = '{s}') AS actionable_{s}" for s in ("critical", "high", "medium", "low"))

SQL = {
    "finding_dedup_f": f"WITH {raw_sql()} SELECT * FROM found",
    "location_caps_f": f"""{_STORED},
        a AS (SELECT repo_id, rule_id, path, message, context, severity, confidence, start_line, count(*) AS n FROM raw GROUP BY ALL)
        SELECT repo_id, rule_id, path, message, context, severity, confidence, count(s.seq) AS locations_stored,
               CAST(sum(CASE WHEN s.seq IS NULL THEN a.n ELSE 0 END) AS BIGINT) AS locations_omitted
        FROM a LEFT JOIN stored s USING (repo_id, rule_id, path, message, context, severity, confidence, start_line) GROUP BY ALL""",
    "correlate_combo_f": _combo_sql(),
    "suppress_active_f": f"""WITH {raw_sql()}, active AS (SELECT DISTINCT fingerprint FROM found WHERE rule_id = 'R1' AND repo_id <> 'repo1')
        SELECT repo_id, rule_id, path, message, context, severity, confidence, fingerprint FROM found WHERE fingerprint NOT IN (SELECT fingerprint FROM active)""",
    "verdict_f": f"{_RESULTS} SELECT repo_id, findings, verdict FROM results",
    "exit_code_f": f"""{_RESULTS} SELECT repo_id, CASE WHEN NOT complete OR error <> '' OR verdict = 'SCAN INCOMPLETE' THEN 2 WHEN top >= 3 THEN 1 ELSE 0 END AS exit_code FROM results""",
    "decision_status_f": f"""{_RESULTS} SELECT repo_id, CASE WHEN NOT complete OR error <> '' OR verdict = 'SCAN INCOMPLETE' THEN 'SCAN INCOMPLETE'
        WHEN verdict = 'NO FINDINGS' THEN 'NO RELEVANT FINDINGS DETECTED' WHEN verdict = 'DO NOT RUN' THEN 'FINDINGS DETECTED' ELSE 'REVIEW REQUIRED' END AS decision_status FROM results""",
    "severity_counts_f": f"WITH {raw_sql()} SELECT repo_id, {_COUNTS} FROM found GROUP BY repo_id",
    "disposition_counts_f": f"WITH {raw_sql()} SELECT repo_id, {_DISPOSITIONS}, count(*) FILTER (WHERE disposition <> 'informational') AS actionable, {_ACTIONABLE} FROM found GROUP BY repo_id",
    "file_hotspots_f": f"""WITH {raw_sql(True)} SELECT repo_id, path, count(*) AS findings,
        CASE max({RANK.format("severity")}) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS max_severity FROM found GROUP BY repo_id, path""",
    "facets_f": f"""WITH {raw_sql(True)} SELECT DISTINCT 'category' AS facet, category AS value FROM found UNION ALL SELECT DISTINCT 'rule', rule_id FROM found UNION ALL SELECT DISTINCT 'file', path FROM found""",
    "sarif_rules_f": f"""WITH {raw_sql()}, o AS (SELECT *, row_number() OVER (ORDER BY repo_id, {LEAD}, {TAIL}) AS n FROM found)
        SELECT rule_id, arg_max(message, n) AS message, arg_max(category, n) AS category, arg_max(severity, n) AS severity, arg_max(confidence, n) AS confidence,
               arg_max(context, n) AS context, arg_max(disposition, n) AS disposition FROM o GROUP BY rule_id""",
    "combo_locations_f": f"""WITH combos AS ({_combo_sql()}), {raw_sql(True)},
        sets(rule_id, category) AS (VALUES {", ".join(f"('{rule}', '{c}')" for rule, _, _, _, used in ops.COMBINATIONS for s in used for c in ops.SIGNALS[s])}),
        p AS (SELECT r.repo_id, r.path, c.rule_id, start_line, arg_min(evidence, seq) AS evidence FROM raw r JOIN sets s USING (category) JOIN combos c ON c.repo_id = r.repo_id AND c.path = r.path AND c.rule_id = s.rule_id
              WHERE confidence <> 'low' AND context = 'executable' AND disposition <> 'informational' GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, rule_id ORDER BY start_line) AS place FROM p)
        SELECT repo_id, path, rule_id, place, start_line, start_line AS end_line, evidence FROM n WHERE place <= 5""",
    "summary_lines_f": f"""{_RESULTS},
        o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {LEAD}, {TAIL}) AS n FROM found),
        s AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {LEAD}, {TAIL}) AS rank FROM found WHERE disposition <> 'informational' AND severity <> 'low' AND confidence <> 'low'),
        c AS (SELECT repo_id, {", ".join(f"count(*) FILTER (WHERE severity = '{x}') AS {x}" for x in ("critical", "high", "medium", "low"))},
              arg_min(rule_id || ' at ' || path || CASE WHEN line > 0 THEN ':' || line ELSE '' END, n) AS first, arg_min(rule_id || ' at ' || path || CASE WHEN line > 0 THEN ':' || line ELSE '' END, n) FILTER (WHERE disposition = 'block') AS first_block FROM o GROUP BY repo_id),
        k AS (SELECT repo_id, count(*) AS shown FROM s GROUP BY repo_id),
        r AS (SELECT results.*, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, first, first_block, coalesce(shown, 0) AS shown
              FROM results LEFT JOIN c USING (repo_id) LEFT JOIN k USING (repo_id))
        SELECT repo_id, 0 AS section, CAST(0 AS BIGINT) AS rank, CASE WHEN NOT complete OR error <> '' OR verdict = 'SCAN INCOMPLETE' THEN 'SCAN INCOMPLETE' WHEN verdict = 'NO FINDINGS' THEN 'NO RELEVANT FINDINGS DETECTED'
               WHEN verdict = 'DO NOT RUN' THEN 'FINDINGS DETECTED' ELSE 'REVIEW REQUIRED' END || ' · ' || repo_id AS text FROM r
        UNION ALL SELECT repo_id, 1, 0, 'error: ' || error FROM r WHERE error <> ''
        UNION ALL SELECT repo_id, 2, 0, 'critical ' || critical || ' · high ' || high || ' · medium ' || medium || ' · low ' || low || ' · ' || CASE WHEN complete THEN 'complete' ELSE 'incomplete' END FROM r
        UNION ALL SELECT repo_id, 3, 0, 'why: ' || CASE verdict WHEN 'SCAN INCOMPLETE' THEN 'coverage was incomplete; look at warnings and skipped areas' WHEN 'NO FINDINGS' THEN 'no enabled rule matched in a completed scan' WHEN 'DO NOT RUN' THEN first_block ELSE first END FROM r
        UNION ALL SELECT repo_id, 5, 0, 'showing ' || shown || ' of ' || findings || ' findings' FROM r WHERE shown < findings
        UNION ALL SELECT repo_id, 4, rank, upper(severity) || ' · ' || upper(confidence) || '  ' || rule_id || ' · ' || message || ' · ' || path || CASE WHEN line > 0 THEN ':' || line ELSE '' END FROM s""",
    "shown_values_f": """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey * l_partkey * l_suppkey AS b, l_orderkey * l_partkey * CASE WHEN l_linenumber % 2 = 0 THEN 1000000 ELSE 1000000000 END AS t FROM lineitem),
        s AS (SELECT *, CAST(round(t / 1000000000.0) AS BIGINT) AS sec, CAST(round(t / 1000000.0) AS BIGINT) AS ms FROM v)
        SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576.0) WHEN b < 1099511627776 THEN printf('%.1f GiB', b / 1073741824.0) ELSE printf('%.1f TiB', b / 1099511627776.0) END AS size,
               CASE WHEN t < 1000000000 AND ms = 0 THEN '0s' WHEN t < 1000000000 AND ms < 1000 THEN ms || 'ms' ELSE CASE WHEN sec >= 3600 THEN (sec // 3600) || 'h' ELSE '' END || CASE WHEN sec >= 60 THEN (sec % 3600 // 60) || 'm' ELSE '' END || (sec % 60) || 's' END AS time FROM s""",
    "sarif_log_f": f"""WITH {raw_sql()}, {coverage_sql()}, o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {LEAD}, {TAIL}) AS n FROM found),
        r AS (SELECT repo_id, count(*) AS results, count(*) FILTER (WHERE severity IN ('critical', 'high')) AS errors FROM found GROUP BY repo_id),
        l AS (SELECT repo_id, rule_id, arg_max(message || ' ' || severity, n) AS said FROM o GROUP BY ALL),
        k AS (SELECT repo_id, count(*) AS rules, arg_max(said, rule_id) AS last_rule FROM l GROUP BY repo_id)
        SELECT c.repo_id, coalesce(results, 0) AS results, coalesce(errors, 0) AS errors, complete AND error = '' AS successful, coalesce(rules, 0) AS rules, last_rule
        FROM coverage c LEFT JOIN r USING (repo_id) LEFT JOIN k USING (repo_id)""",
    "report_digest_f": f"""WITH {raw_sql(True)},
        leaves AS (SELECT repo_id, sha256({" || ".join(f"coalesce('=' || CAST({c} AS varchar), '') || chr(31)" for c in DIGESTED)}) AS leaf, count(*) AS n FROM found GROUP BY ALL),
        a AS (SELECT repo_id, substr(leaf, 1, 4) AS head, sha256(string_agg(leaf || ':' || n, chr(10) ORDER BY leaf || ':' || n)) AS digest FROM leaves GROUP BY ALL),
        b AS (SELECT repo_id, substr(head, 1, 2) AS up, sha256(string_agg(head || ':' || digest, chr(10) ORDER BY head || ':' || digest)) AS digest FROM a GROUP BY ALL)
        SELECT repo_id, sha256(string_agg(up || ':' || digest, chr(10) ORDER BY up || ':' || digest)) AS digest FROM b GROUP BY repo_id""",
    "review_queue_f": f"""WITH {raw_sql(True)} SELECT repo_id, path, line, rule_id, message, severity, confidence, row_number() OVER (PARTITION BY repo_id ORDER BY path, {TAIL}) AS rank
        FROM found WHERE disposition <> 'informational' AND severity <> 'low' AND confidence <> 'low'""",
    "search_facets_f": f"""WITH {raw_sql(True)} SELECT repo_id, path, rule_id, message, severity, confidence FROM found
        WHERE contains(lower(concat_ws(' ', rule_id, category, path, message, evidence, disposition)), 'pkg3') AND category = 'exfiltration' AND disposition <> 'informational'""",
    "top_finding_f": f"""WITH {raw_sql()}, o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {LEAD}, {TAIL}) AS n FROM found)
        SELECT repo_id, rule_id, path, line, message, severity, confidence, disposition FROM o WHERE n = 1""",
    "result_order_f": f"""WITH {raw_sql()} SELECT repo_id, rule_id, path, message, context, severity, confidence, row_number() OVER (PARTITION BY repo_id ORDER BY {LEAD}, {TAIL}) AS rank FROM found""",
    "group_headers_f": f"""WITH {raw_sql()}, o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {LEAD}, {TAIL}) AS n FROM found)
        SELECT repo_id, upper(disposition) AS header, min(n) AS at_rank, count(*) AS findings FROM o GROUP BY ALL""",
    "fix_count_f": f"""WITH {raw_sql()} SELECT repo_id, count(*) FILTER (WHERE rule_id IN ('R1', 'R3', 'R5') AND disposition <> 'informational') AS fixes FROM found GROUP BY repo_id""",
    "location_tree_f": f"""{_STORED} SELECT repo_id, rule_id, path, message, context, severity, confidence,
        string_agg(CAST(start_line AS varchar), ',' ORDER BY start_line) AS lines, count(*) AS n_lines FROM stored GROUP BY ALL""",
    "report_caps_f": f"""WITH r AS (SELECT 'repo' || CAST(l_suppkey % 7 AS varchar) AS repo_id, l_orderkey AS finding, row_number() OVER (PARTITION BY l_suppkey % 7, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
        c AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY finding, n) AS m FROM r WHERE n <= 2) SELECT repo_id, finding, count(*) AS kept FROM c WHERE m <= {PER_REPO // 4} GROUP BY ALL""",
    "report_validate_f": f"""{_RESULTS} SELECT repo_id,
        CASE WHEN repo_id = 'repo3' THEN (SELECT count(*) FROM found WHERE repo_id = 'repo3' AND rule_id = 'R2') ELSE 0 END AS invalid_findings,
        repo_id = 'repo9' AS error_claims_complete, repo_id <> 'repo4' AS verdict_matches, repo_id NOT IN ('repo3', 'repo4', 'repo9') AS valid FROM results""",
}
QUERIES = {name: globals()[name] for name in SQL}
