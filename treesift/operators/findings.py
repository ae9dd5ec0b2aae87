"""From raw findings to findings, verdicts and views, as DataFrame operators.

Raw findings have (repo_id, path, rule_id, category, severity, confidence,
context, message, disposition, start_line, end_line, evidence, occurrences,
emit_seq).  ``emit_seq`` orders their arrival and decides every "first": no
operator relies on the order of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treesift.functions import policy
from treesift.functions.ranks import confidence_rank, disposition_rank, severity_of, severity_rank
from treesift.sources.tables import kept

KEY = ("repo_id", "rule_id", "path", "message", "context", "severity", "confidence")
MAX_PER_FINDING, MAX_PER_REPO = 1_000, 25_000
#: Parts in which a repository's locations are cut down to its limit before they meet.
SALTS = 32


def dedup(raw: DataFrame, count_places: bool = True) -> DataFrame:
    """One finding for each key: occurrences add up, whatever is not in the key
    comes from the first arrival, and distinct locations are counted.

    Everything is a partial aggregate, so a hot key shrinks before the shuffle;
    locations are made distinct in a step of their own for the same reason.  That step
    shuffles each location: without ``count_places`` (and n_locations) only keys are shuffled."""
    rest = F.struct("category", "disposition", F.col("start_line").alias("line"), "evidence")
    of = [F.sum(F.greatest("occurrences", F.lit(1))).alias("occurrences"), F.min(F.struct("emit_seq", rest.alias("rest"))).alias("first")]
    if count_places:
        places = raw.groupBy(*KEY, "start_line", "end_line").agg(*of)
        found = places.groupBy(*KEY).agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("n_locations"), F.min("first").alias("first"))
    else:
        found = raw.groupBy(*KEY).agg(*of)
    counts = ["occurrences", "n_locations"] if count_places else ["occurrences"]
    flat = found.select(*KEY, *counts, "first.emit_seq", "first.rest.*")
    return flat.withColumn("fingerprint", policy.fingerprint(F.col("rule_id"), F.col("path"), F.col("line"), F.col("message")))


def _places(raw: DataFrame) -> DataFrame:
    """The distinct locations of each finding, when each arrived first and how often in all."""
    return raw.groupBy(*KEY, "start_line", "end_line").agg(F.min("emit_seq").alias("emit_seq"), F.count("*").alias("arrivals"))


def _first(df: DataFrame, n: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("emit_seq")
    return df.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= n).drop("turn")


def _stored(places: DataFrame, per_finding: int, per_repo: int) -> DataFrame:
    """The places that are kept under both limits.  A repository's limit is taken in two
    steps, first within salted parts, so that no task sorts all places of a large one;
    a finding's is taken before the shuffle already, as the planner does for first rows."""
    kept = _first(places, per_finding, *KEY)
    spread = kept.withColumn("salt", F.pmod(F.xxhash64("emit_seq"), F.lit(SALTS)))
    return _first(_first(spread, per_repo, "repo_id", "salt").drop("salt"), per_repo, "repo_id")


def stored_locations(raw: DataFrame, per_finding: int = MAX_PER_FINDING, per_repo: int = MAX_PER_REPO) -> DataFrame:
    """The locations that are kept under both limits, in arrival order."""
    return _stored(_places(raw), per_finding, per_repo).drop("arrivals")


def location_caps(raw: DataFrame, per_finding: int = MAX_PER_FINDING, per_repo: int = MAX_PER_REPO) -> DataFrame:
    """Stored and omitted locations of each finding.  An arrival is omitted if its
    location is not stored, also when that location was omitted before.

    Places carry their arrivals, so what is omitted is the rest of a sum and places
    are not joined again."""
    places = _places(raw)
    totals = places.groupBy(*KEY).agg(F.sum("arrivals").alias("arrivals"))
    stored = _stored(places, per_finding, per_repo).groupBy(*KEY).agg(F.count("*").alias("stored"), F.sum("arrivals").alias("held"))
    same = _all([totals[c].eqNullSafe(stored[c]) for c in KEY])
    joined = totals.join(stored, on=same, how="left").select(*[totals[c] for c in KEY], "arrivals", "stored", "held")
    return joined.select(*KEY, F.coalesce("stored", F.lit(0)).alias("locations_stored"), (F.col("arrivals") - F.coalesce("held", F.lit(0))).alias("locations_omitted"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


#: Signals by category, and what their meetings in a file mean.
SIGNALS = {
    "network": ("remote-fetch", "exfiltration"),
    "fingerprint": ("host-fingerprinting",),
    "environment": ("credential-harvesting", "environment-access", "secret"),
    "execution": ("dynamic-execution", "process-execution"),
    "evasion": ("sandbox-evasion",),
}
COMBINATIONS = (
    ("COMBO-001", "collection-and-exfiltration", "high", "Host or credential collection appears alongside network transfer", ("network", "fingerprint", "environment")),
    ("COMBO-002", "fetch-and-execute", "critical", "Network retrieval appears alongside command or code execution", ("network", "execution")),
    ("COMBO-003", "evasion-and-execution", "high", "CI or sandbox evasion appears alongside dynamic execution", ("evasion", "execution")),
)


def correlate(findings: DataFrame) -> DataFrame:
    """Findings about files in which signals meet, from deduplicated findings.
    Rule ids by file are few and distinct, so their sets stay small; lines are
    taken as a minimum rather than gathered."""
    used = findings.where((F.col("confidence") != "low") & (F.col("context") == "executable") & (F.col("disposition") != "informational"))
    ids = {s: F.collect_set(F.when(F.col("category").isin(*cats), F.col("rule_id"))).alias(s) for s, cats in SIGNALS.items()}
    lines = {s: F.min(F.when(F.col("category").isin(*cats), F.col("line"))).alias(f"{s}_line") for s, cats in SIGNALS.items()}
    by_path = used.groupBy("repo_id", "path").agg(*ids.values(), *lines.values())
    has = lambda s: F.size(s) > 0
    when = {
        "COMBO-001": has("network") & (has("fingerprint") | has("environment")),
        "COMBO-002": has("network") & has("execution"),
        "COMBO-003": has("evasion") & has("execution"),
    }
    rows = [
        F.when(
            when[rule],
            F.struct(
                F.lit(rule).alias("rule_id"),
                F.lit(category).alias("category"),
                F.lit(severity).alias("severity"),
                F.lit(message).alias("message"),
                F.array_sort(F.array_distinct(F.flatten(F.array(*sets)))).alias("contributing_rule_ids"),
                F.least(*[F.col(f"{s}_line") for s in sets]).alias("line"),
            ),
        )
        for rule, category, severity, message, sets in COMBINATIONS
    ]
    out = by_path.select("repo_id", "path", F.explode(F.array(*rows)).alias("c")).where("c is not null").select("repo_id", "path", "c.*")
    return out.withColumns(
        {
            "confidence": F.lit("high"),
            "context": F.lit("executable"),
            "occurrences": F.lit(1).cast("long"),
            "evidence": F.lit("correlated behaviors in the same file"),
            "disposition": F.when(F.col("severity") == "critical", "block").otherwise("review"),
            "fingerprint": policy.fingerprint(F.col("rule_id"), F.col("path")),
        }
    )


#: Fixed value: places that a finding names.
MAX_LOCATIONS = 1000


def combination_locations(raw: DataFrame, combined: DataFrame, most: int = MAX_LOCATIONS) -> DataFrame:
    """(repo_id, path, rule_id, place, start_line, end_line, evidence): the places of the signals
    that meet in each finding of ``combined`` (as ``correlate`` gives it), from raw findings.

    A place (start and end) that several signals name counts once, with the evidence that came
    first; places are in their order, the first ``most`` of each finding.  They are counted
    and their evidence chosen before any are brought together."""
    used = raw.where((F.col("confidence") != "low") & (F.col("context") == "executable") & (F.col("disposition") != "informational"))
    of = F.array_compact(F.array(*[F.when(F.col("category").isin(*[c for s in sets for c in SIGNALS[s]]), F.lit(rule)) for rule, _, _, _, sets in COMBINATIONS]))
    each = used.select("repo_id", "path", F.explode(of).alias("rule_id"), F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce(F.when(F.col("end_line") > F.col("start_line"), F.col("end_line")), "start_line").alias("end_line"), "evidence", "emit_seq")
    met = each.join(combined.select("repo_id", "path", "rule_id").distinct(), ["repo_id", "path", "rule_id"])
    places = met.groupBy("repo_id", "path", "rule_id", "start_line", "end_line").agg(F.min_by("evidence", F.struct("emit_seq", "evidence")).alias("evidence"))
    turn = F.row_number().over(Window.partitionBy("repo_id", "path", "rule_id").orderBy("start_line", "end_line"))
    return places.withColumn("place", turn).where(F.col("place") <= most).select("repo_id", "path", "rule_id", "place", "start_line", "end_line", "evidence")


def unsuppressed(findings: DataFrame, suppressions: DataFrame, today: Column) -> DataFrame:
    """Findings without a suppression (fingerprint, reason, expires) in force.
    One that expires on a day holds for all of that day."""
    active = suppressions.where(F.col("expires").isNull() | (F.try_to_timestamp("expires", F.lit("yyyy-MM-dd")).cast("date") >= today))
    return findings.join(active.select("fingerprint").distinct(), "fingerprint", "left_anti")


def repository_results(findings: DataFrame, coverage: DataFrame, threshold: str = "high") -> DataFrame:
    """(repo_id, findings, verdict, decision_status, exit_code) of every repository
    of ``coverage`` (repo_id, complete, error)."""
    flags = findings.groupBy("repo_id").agg(
        F.count("*").alias("findings"),
        F.bool_or(policy.is_blocking(F.col("severity"), F.col("confidence"), F.col("context"))).alias("blocking"),
        F.max(severity_rank()).alias("top"),
    )
    joined = coverage.join(flags, "repo_id", "left").fillna({"findings": 0, "blocking": False, "top": 0})
    named = joined.withColumn("verdict", F.when(F.coalesce("error", F.lit("")) != "", policy.INCOMPLETE).otherwise(policy.verdict(F.col("blocking"), F.col("findings"), F.col("complete"))))
    open_ = ~F.col("complete") | (F.coalesce("error", F.lit("")) != "") | (F.col("verdict") == policy.INCOMPLETE)
    return named.select(
        "repo_id",
        "findings",
        "verdict",
        policy.decision_status(F.col("verdict"), F.col("complete"), F.col("error")).alias("decision_status"),
        F.when(open_, 2).when(F.col("top") >= severity_rank(F.lit(threshold)), 1).otherwise(0).alias("exit_code"),
    )


def run_exit_code(results: DataFrame) -> DataFrame:
    """One row for the run: incomplete wins over findings."""
    return results.agg(F.coalesce(F.max("exit_code"), F.lit(0)).alias("exit_code"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")])


def disposition_counts(findings: DataFrame) -> DataFrame:
    actionable = F.col("disposition") != "informational"
    return findings.groupBy("repo_id").agg(
        *[F.count_if(F.col("disposition") == d).alias(d) for d in ("block", "review", "harden", "informational")],
        F.count_if(actionable).alias("actionable"),
        *[F.count_if(actionable & (F.col("severity") == s)).alias(f"actionable_{s}") for s in ("critical", "high", "medium", "low")],
    )


def file_hotspots(findings: DataFrame) -> DataFrame:
    """Findings and highest severity of each file."""
    return findings.groupBy("repo_id", "path").agg(F.count("*").alias("findings"), severity_of(F.max(severity_rank())).alias("max_severity"))


def facets(findings: DataFrame) -> DataFrame:
    """The distinct values to filter by, as (facet, value) rows: a list of all
    files would not fit one row of a large report."""
    some = [findings.select(F.lit(name).alias("facet"), F.col(column).alias("value")).distinct() for name, column in (("category", "category"), ("rule", "rule_id"), ("file", "path"))]
    return some[0].union(some[1]).union(some[2])


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One entry for each rule: its last finding's attributes, in arrival order."""
    last = F.max_by(F.struct("message", "category", "severity", "confidence", "context", "disposition"), F.struct("repo_id", *ORDER_KEYS))
    return findings.withColumns(order_columns("severity")).groupBy("rule_id").agg(last.alias("last")).select("rule_id", "last.*")


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "low", "note").otherwise("warning")


ORDER_KEYS = ("k_lead", "k_severity", "k_confidence", "path", "line", "rule_id", "message", "fingerprint", "context")


def order_columns(group_by: str) -> dict[str, Column]:
    lead = {"file": F.col("path"), "rule": F.col("rule_id")}.get(group_by, F.lpad((9 - disposition_rank()).cast("string"), 2, "0"))
    return {"k_lead": lead, "k_severity": -severity_rank(), "k_confidence": -confidence_rank()}


def presentation_rank(findings: DataFrame, group_by: str = "severity") -> DataFrame:
    """``rank`` within each repository in display order.

    A repository is cut into ranges of the order by its leading keys, counted,
    and ranked range by range, so one large repository is many tasks' work."""
    keyed = findings.withColumns(order_columns(group_by))
    part = ("repo_id", "k_lead", "k_severity", "k_confidence", "path")
    sizes = keyed.groupBy(*part).agg(F.count("*").alias("size"))
    groups = sizes.groupBy("repo_id", "k_lead", "k_severity", "k_confidence").agg(F.sum("size").alias("group_size"))
    before_group = Window.partitionBy("repo_id").orderBy("k_lead", "k_severity", "k_confidence").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("group_start", F.coalesce(F.sum("group_size").over(before_group), F.lit(0))).drop("group_size")
    before = Window.partitionBy("repo_id", "k_lead", "k_severity", "k_confidence").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).join(groups, ["repo_id", "k_lead", "k_severity", "k_confidence"])
    within = Window.partitionBy(*part).orderBy("line", "rule_id", "message", "fingerprint", "context")
    ranked = keyed.withColumn("turn", F.row_number().over(within)).join(starts.drop("size"), list(part))
    return ranked.withColumn("rank", F.col("group_start") + F.col("start") + F.col("turn")).drop("k_lead", "k_severity", "k_confidence", "turn", "start", "group_start")


def visible(findings: DataFrame, detail: str = "review", min_severity: str = "low", min_confidence: str = "low") -> DataFrame:
    """What a view shows; never what a verdict counts."""
    if detail == "summary":
        return findings.where(F.lit(False))
    shown = findings.where((severity_rank() >= severity_rank(F.lit(min_severity))) & (confidence_rank() >= confidence_rank(F.lit(min_confidence))))
    return shown.where(F.col("disposition") != "informational") if detail == "review" else shown


def search(findings: DataFrame, text: str = "", category: str = "", rule: str = "", file: str = "", actionable: bool = False) -> DataFrame:
    """Findings by a substring of everything that is shown, and by facets."""
    shown = F.lower(F.concat_ws(" ", "rule_id", "category", "path", "message", "evidence", "disposition", "path", "evidence"))
    out = findings.where(shown.contains(text.lower())) if text else findings
    for column, value in (("category", category), ("rule_id", rule), ("path", file)):
        if value:
            out = out.where(F.col(column) == value)
    return out.where(F.col("disposition") != "informational") if actionable else out


def top_finding(findings: DataFrame, blocks_only: bool = False) -> DataFrame:
    """The first finding in display order of each repository."""
    chosen = findings.where(F.col("disposition") == "block") if blocks_only else findings
    keyed = chosen.withColumns(order_columns("severity"))
    first = F.min(F.struct(*ORDER_KEYS, "severity", "confidence", "disposition"))
    return keyed.groupBy("repo_id").agg(first.alias("f")).select("repo_id", *[f"f.{c}" for c in ("rule_id", "path", "line", "message", "severity", "confidence", "disposition")])


def group_headers(findings: DataFrame, group_by: str = "severity") -> DataFrame:
    """A header stands where the group changes in display order, which begins
    with the group: so there is one for each group, at its least rank.  Ranks take the
    findings twice, so these are worked out once and kept."""
    group = {"file": "path", "rule": "rule_id"}.get(group_by, "disposition")
    once = kept(findings.select("repo_id", "path", "line", "rule_id", "message", "fingerprint", "context", "severity", "confidence", "disposition"), "ranked")
    return presentation_rank(once, group_by).groupBy("repo_id", F.upper(group).alias("header")).agg(F.min("rank").alias("at_rank"), F.count("*").alias("findings"))


def fix_count(findings: DataFrame, remediations: DataFrame) -> DataFrame:
    """How many findings that ask for review come with a remedy."""
    with_fix = findings.join(remediations.select("rule_id", "remediation"), "rule_id", "left")
    return with_fix.groupBy("repo_id").agg(F.count_if((F.coalesce("remediation", F.lit("")) != "") & (F.col("disposition") != "informational")).alias("fixes"))


def location_tree(locations: DataFrame) -> DataFrame:
    """Lines by file of each finding, from stored locations, whose number is bounded."""
    label = F.when(F.col("end_line") > F.col("start_line"), F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))).otherwise(F.col("start_line").cast("string"))
    entry = F.struct("start_line", label.alias("label"))
    return locations.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["label"]), ",").alias("lines"), F.count("*").alias("n_lines"))
