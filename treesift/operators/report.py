"""Reports as data: building, reading, validating and exporting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from treesift.functions import policy
from treesift.functions.ranks import CONFIDENCES, DISPOSITIONS, SEVERITIES
from treesift.functions.text import sanitized
from treesift.operators.advice import advice
from treesift.operators.findings import ORDER_KEYS, order_columns, sarif_level
from treesift.sources.tables import kept

LOCATION = "struct<path: string, start_line: int, end_line: int, evidence: string>"
FINDING = (
    "struct<rule_id: string, category: string, severity: string, confidence: string, context: string, path: string, line: int, "
    f"occurrences: bigint, message: string, evidence: string, remediation: string, fingerprint: string, disposition: string, locations: array<{LOCATION}>, "
    "locations_omitted: bigint, contributing_rule_ids: array<string>>"
)
COVERAGE = "struct<complete: boolean, files_scanned: bigint, bytes_scanned: bigint, skipped: array<string>, warnings: array<string>>"
RESULT = f"struct<target: string, scan_mode: string, verdict: string, findings: array<{FINDING}>, coverage: {COVERAGE}, error: string, duration_ns: bigint>"
SCHEMA = f"schema_version string, tool_version string, rules_version string, generated_at string, results array<{RESULT}>"


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(results, findings) of a report in JSON; unknown fields are ignored."""
    report = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    results = report.where(F.col("schema_version") == "1").select(F.posexplode("results").alias("repo", "r"))
    base = results.select(F.col("r.target").alias("repo_id"), "repo", "r.verdict", "r.coverage.complete", F.coalesce("r.error", F.lit("")).alias("error"))
    findings = results.select(F.col("r.target").alias("repo_id"), F.posexplode("r.findings").alias("emit_seq", "f")).select("repo_id", "emit_seq", "f.*")
    return base, findings


def _problem(findings: DataFrame) -> Column:
    present = set(findings.columns)
    bad = ~F.col("severity").isin(*SEVERITIES) | ~F.col("confidence").isin(*CONFIDENCES) | F.col("severity").isNull() | F.col("confidence").isNull()
    bad |= (F.coalesce("rule_id", F.lit("")) == "") | (F.coalesce("path", F.lit("")) == "") | (F.col("occurrences") < 0)
    bad |= F.col("disposition").isNotNull() & (F.col("disposition") != "") & ~F.col("disposition").isin(*DISPOSITIONS)
    if "locations_omitted" in present:
        bad |= F.coalesce("locations_omitted", F.lit(0)) < 0
    if "locations" in present:
        bad |= F.exists(
            F.coalesce("locations", F.array().cast(f"array<{LOCATION}>")),
            lambda x: (F.coalesce(x["path"], F.lit("")) == "") | (x["start_line"] < 0) | (x["end_line"] < 0) | ((x["end_line"] > 0) & (x["end_line"] < x["start_line"])),
        )
    return F.coalesce(bad, F.lit(True))


def validation(results: DataFrame, findings: DataFrame) -> DataFrame:
    """Per repository of ``results`` (repo_id, complete, error, verdict): findings with
    invalid fields, an error beside complete coverage, and whether the verdict follows."""
    flags = findings.groupBy("repo_id").agg(
        F.count("*").alias("n"), F.count_if(_problem(findings)).alias("invalid"), F.bool_or(policy.is_blocking(F.col("severity"), F.col("confidence"), F.col("context"))).alias("blocking")
    )
    joined = results.join(flags, "repo_id", "left").fillna({"n": 0, "invalid": 0, "blocking": False})
    failed = F.coalesce("error", F.lit("")) != ""
    expected = F.when(failed, policy.INCOMPLETE).otherwise(policy.verdict(F.col("blocking"), F.col("n"), F.col("complete")))
    claims, matches = failed & F.col("complete"), F.col("verdict") == expected
    return joined.select(
        "repo_id", F.col("invalid").alias("invalid_findings"), claims.alias("error_claims_complete"), matches.alias("verdict_matches"),
        ((F.col("invalid") == 0) & ~claims & matches).alias("valid"),
    )


def capped_locations(locations: DataFrame, per_finding: int, per_repo: int) -> DataFrame:
    """Locations (repo_id, finding, at, ...) of loaded reports under both limits, in
    their own order.  Repeated ones are not merged: a report has them as they are.

    How many of a finding's locations count follows from numbers by finding, so
    no task sorts all locations of a repository."""
    sizes = locations.groupBy("repo_id", "finding").agg(F.least(F.count("*"), F.lit(per_finding)).alias("n"))
    chunk = F.floor(F.col("finding") / 4096)
    chunks = sizes.withColumn("chunk", chunk).groupBy("repo_id", "chunk").agg(F.sum("n").alias("chunk_n"))
    so_far = Window.partitionBy("repo_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("chunk_start", F.coalesce(F.sum("chunk_n").over(so_far), F.lit(0))).drop("chunk_n")
    within = Window.partitionBy("repo_id", "chunk").orderBy("finding").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("chunk", chunk).withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0))).join(chunks, ["repo_id", "chunk"])
    allowed = starts.select("repo_id", "finding", F.greatest(F.least("n", per_repo - F.col("start") - F.col("chunk_start")), F.lit(0)).alias("allowed"))
    turn = F.row_number().over(Window.partitionBy("repo_id", "finding").orderBy("at"))
    return locations.join(allowed.where("allowed > 0"), ["repo_id", "finding"]).withColumn("turn", turn).where("turn <= allowed").drop("turn", "allowed")


def with_rule_info(findings: DataFrame, catalogue: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """Findings with what the catalogue (rule_id, category, disposition) says of their
    rule.  Ids of package advisories fall back to the family's entry, and are filled
    from ``advisories`` (advisory_id, description); unknown rules keep their own data."""
    looked_up = F.when(F.col("rule_id").startswith("IOC-PKG-"), "IOC-PKG-*").otherwise(F.col("rule_id"))
    entry = catalogue.select(F.col("rule_id").alias("entry_id"), F.col("category").alias("entry_category"), F.col("disposition").alias("entry_disposition"))
    out = findings.withColumn("entry_id", looked_up).join(entry, "entry_id", "left").withColumn("known", F.col("entry_category").isNotNull()).drop("entry_id")
    out = out.withColumns({"entry_category": F.coalesce("entry_category", "category"), "entry_disposition": F.coalesce("entry_disposition", "disposition")})
    if advisories is None:
        return out.withColumn("description", F.col("message"))
    first = advisories.groupBy(F.concat(F.lit("IOC-PKG-"), "advisory_id").alias("rule_id")).agg(F.min("description").alias("described"))
    return out.join(first, "rule_id", "left").withColumn("description", F.coalesce(F.nullif(F.col("described"), F.lit("")), F.col("message"))).drop("described")


def _shown(value: Column, kind: T.DataType) -> Column:
    """A value with every string in it fit to be shown."""
    if isinstance(kind, T.StringType):
        return sanitized(value)
    if isinstance(kind, T.ArrayType) and _has_text(kind):
        return F.transform(value, lambda x: _shown(x, kind.elementType))
    if isinstance(kind, T.StructType) and _has_text(kind):
        return F.when(value.isNotNull(), F.struct(*[_shown(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType) and _has_text(kind):
        pairs = F.transform(F.map_entries(value), lambda e: F.struct(_shown(e["key"], kind.keyType).alias("key"), _shown(e["value"], kind.valueType).alias("value")))
        keys = F.transform(pairs, lambda e: e["key"])
        return F.map_from_entries(F.filter(pairs, lambda e, i: F.array_position(keys, e["key"]) == i + 1))  # keys may become equal: the first stays
    return value


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_text(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_text(f.dataType) for f in kind.fields)
    if isinstance(kind, T.MapType):
        return _has_text(kind.keyType) or _has_text(kind.valueType)
    return isinstance(kind, T.StringType)


def sanitized_rows(df: DataFrame) -> DataFrame:
    """Rows fit to be shown: control characters and credentials out of every string, however
    deep it lies in structs, arrays and maps.  Every writer of this module passes through it."""
    return df.select(*[_shown(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


#: Results of one part of a log, about.
PART_RESULTS = 5000
#: Fixed value: the schema that a log names.
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def _sarif_result() -> Column:
    place = F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine"))).alias("region"))
    message = F.concat(F.col("message"), F.when(F.col("evidence") != "", F.concat(F.lit("; evidence: "), F.col("evidence"))).otherwise(F.lit("")))
    return F.struct(
        F.col("rule_id").alias("ruleId"),
        sarif_level(F.col("severity")).alias("level"),
        F.struct(message.alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
        F.create_map(F.lit("treesift/v1"), F.col("fingerprint")).alias("fingerprints"),
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result for each finding, as JSON."""
    return sanitized_rows(findings).select("repo_id", F.to_json(_sarif_result()).alias("result"))


def sarif_log(findings: DataFrame, coverage: DataFrame, part_results: int = PART_RESULTS) -> DataFrame:
    """(repo_id, part, parts, results, log): SARIF 2.1.0 of each repository of ``coverage`` (repo_id,
    complete, error), as JSON in parts of about ``part_results`` results.

    Each part is a whole log with the rules of its results; a rule is described as the last of the
    repository's findings has it.  A run was successful if the scan was complete without an error.
    Parts are by a hash of the result, so no group grows with the repository.  The findings,
    asked for by sizes, rules and results, are worked out once and kept."""
    clean = kept(sanitized_rows(findings), "clean")
    sizes = clean.groupBy("repo_id").agg(F.greatest(F.ceil(F.count("*") / part_results), F.lit(1)).cast("int").alias("parts"))
    repos = coverage.join(sizes, "repo_id", "left").select("repo_id", F.coalesce("parts", F.lit(1)).alias("parts"), (F.col("complete") & (F.coalesce("error", F.lit("")) == "")).alias("success"))
    keyed = clean.withColumns(order_columns("severity")).join(repos.select("repo_id", "parts"), "repo_id")
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("fingerprint", "path", "line", "context", "severity", "confidence"), "parts").cast("int"))
    described = F.struct("message", "category", "severity", "confidence", "context", "disposition")
    last = keyed.groupBy("repo_id", "rule_id").agg(F.max_by(described, F.struct(*ORDER_KEYS)).alias("last"))
    properties = F.struct(*[F.col(f"last.{c}").alias(c) for c in ("category", "severity", "confidence", "context", "disposition")], advice(F.col("last.category")).alias("advice"))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.col("last.message").alias("text")).alias("shortDescription"), properties.alias("properties"))
    used = keyed.select("repo_id", "part", "rule_id").distinct().join(last, ["repo_id", "rule_id"]).groupBy("repo_id", "part").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    order = F.struct(*ORDER_KEYS)
    results = keyed.groupBy("repo_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("order"), F.to_json(_sarif_result()).alias("result")))), lambda r: r["result"]).alias("results"))
    every = repos.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(results, ["repo_id", "part"], "left").join(used, ["repo_id", "part"], "left")
    listed = F.coalesce("results", F.array().cast("array<string>"))
    driver = F.to_json(F.struct(F.lit("treesift").alias("name"), F.coalesce("rules", F.array().cast(used.schema["rules"].dataType)).alias("rules")))
    success = F.when(F.col("success"), "true").otherwise("false")
    run = F.concat(
        F.lit(f'{{"version":"2.1.0","$schema":"{SARIF_SCHEMA}","runs":[{{"tool":{{"driver":'), driver, F.lit('},"results":['), F.array_join(listed, ","),
        F.lit('],"invocations":[{"executionSuccessful":'), success, F.lit("}]}]}"),
    )
    return every.select("repo_id", "part", "parts", F.size(listed).alias("results"), run.alias("log"))


def write_findings(findings: DataFrame, path: str, format: str = "parquet") -> None:
    """Findings as files in parts; nothing is gathered into one."""
    sanitized_rows(findings).write.mode("errorifexists").format(format).save(path)


def write_log(findings: DataFrame, coverage: DataFrame, path: str) -> None:
    """A log of each repository as text files, a part a line."""
    sarif_log(findings, coverage).select("repo_id", F.col("log").alias("value")).write.mode("errorifexists").partitionBy("repo_id").text(path)


def source_link(base: Column, host: Column, revision: Column, path: Column, start: Column, end: Column) -> Column:
    """A deep link to lines of a file at a revision, null for members of archives."""
    escaped = F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")
    tree = F.when(host == "github.com", "/blob/").when(host == "gitlab.com", "/-/blob/").when(host == "bitbucket.org", "/src/")
    lines = (
        F.when(host == "bitbucket.org", F.concat(F.lit("#lines-"), start.cast("string"), F.when(end > start, F.concat(F.lit(":"), end.cast("string"))).otherwise("")))
        .when(host == "gitlab.com", F.concat(F.lit("#L"), start.cast("string"), F.when(end > start, F.concat(F.lit("-"), end.cast("string"))).otherwise("")))
        .otherwise(F.concat(F.lit("#L"), start.cast("string"), F.when(end > start, F.concat(F.lit("-L"), end.cast("string"))).otherwise("")))
    )
    link = F.concat(base, tree, revision, F.lit("/"), escaped, F.when(start > 0, lines).otherwise(""))
    return F.when(revision.rlike("^[0-9a-fA-F]{40,64}$") & ~path.contains("!"), link)
