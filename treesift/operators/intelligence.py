"""Advisories as data: merging feeds, and checking snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.sources.json_tree import strict_problems


def alias_components(candidates: DataFrame, keep) -> DataFrame:
    """(id, root): candidates that share an identifier, directly or by others.

    ``candidates`` has (id, aliases).  Labels spread along identifiers until
    none changes; ``keep`` cuts lineage each round (a checkpoint or a table)."""
    names = keep(candidates.select("id", F.explode(F.array_distinct(F.concat(F.array("id"), "aliases"))).alias("name")).where("name <> ''"))
    labels = keep(candidates.select("id", F.col("id").alias("root")).distinct())
    while True:
        by_name = names.join(labels, "id").groupBy("name").agg(F.min("root").alias("near"))
        near = names.join(by_name, "name").groupBy("id").agg(F.min("near").alias("near"))
        step = keep(labels.join(near, "id", "left").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("far"))
        step = keep(step.join(jump, "root", "left").select("id", "old", F.coalesce("far", "root").alias("root")))
        labels = step.select("id", "root")
        if not step.where("old <> root").limit(1).count():
            return labels


def merge_candidates(candidates: DataFrame, roots: DataFrame) -> DataFrame:
    """One advisory for each component and package.  A component with a withdrawn
    member is a correction; the primary id prefers GitHub's, then the least."""
    joined = candidates.join(roots, "id")
    gone = joined.groupBy("root").agg(F.bool_or("withdrawn").alias("corrected"))
    merged = joined.groupBy("root", "ecosystem", F.lower("name").alias("name")).agg(
        F.min(F.struct((~F.col("id").startswith("GHSA-")).cast("int"), "id")).getField("id").alias("advisory_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("affected")))).alias("affected"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("id"), "aliases"))))).alias("identifiers"),
        F.min("published").alias("added"),
        F.max("modified").alias("modified"),
    )
    return merged.join(gone, "root")


def merge_snapshot(base: DataFrame, merged: DataFrame) -> DataFrame:
    """The rows of ``base`` (ecosystem, name, advisory_id, affected) that no correction
    takes out, and new ones that it does not have."""
    fixed = merged.where("corrected").select(F.explode("identifiers").alias("advisory_id")).distinct()
    kept = base.join(fixed, "advisory_id", "left_anti")
    fresh = merged.where("not corrected").select("ecosystem", "name", "advisory_id", "affected")
    same = [F.lower(fresh["ecosystem"]) == F.lower(kept["ecosystem"]), fresh["name"] == F.lower(kept["name"]), fresh["advisory_id"] == kept["advisory_id"]]
    return kept.select("ecosystem", "name", "advisory_id", "affected").unionByName(fresh.join(kept, same, "left_anti"))


#: The fields of a snapshot, of its packages and of its file hashes, and rows of each at most.
PACKAGE_FIELDS = (
    "ecosystem", "name", "severity", "source", "source_url", "advisory_id", "aliases", "description", "added", "modified", "affected_versions", "typosquat_of", "campaign", "references", "snapshot_version",
)
HASH_FIELDS = ("sha256", "family", "source_url", "source", "context", "description", "added", "campaign", "actor", "references", "snapshot_version")
MAX_ROWS = 100_000
_LISTS = ("aliases", "affected_versions", "references")


def snapshot_fields() -> list[str]:
    """The fields that a snapshot may have, as ``json_tree.fields`` names them."""
    own = ["$.snapshot_version", "$.snapshot_date"]
    for section, names in (("packages", PACKAGE_FIELDS), ("file_hashes", HASH_FIELDS)):
        own += [f"$.{section}", f"$.{section}[]", *(f"$.{section}[].{n}" for n in names), *(f"$.{section}[].{n}[]" for n in names if n in _LISTS)]
    return own


def read_snapshots(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages, problems) of snapshots ``texts`` (id, json), read strictly: a snapshot with an
    unknown field, something after its end, or no or too many rows of a section has problems
    (id, field, problem) and gives no packages."""
    text = F.try_parse_json("json")
    rows = lambda s: F.coalesce(F.size(F.try_variant_get(text, f"$.{s}", "array<variant>")), F.lit(0))
    counted = texts.where(text.isNotNull()).select("id", F.explode(F.array(*[F.struct(F.lit(f"$.{s}").alias("field"), rows(s).alias("n")) for s in ("packages", "file_hashes")])).alias("s")).select("id", "s.*")
    sizes = counted.where(~F.col("n").between(1, MAX_ROWS)).select("id", "field", F.lit("invalid number of rows").alias("problem"))
    problems = strict_problems(texts, snapshot_fields()).unionByName(sizes)
    good = texts.join(problems.select("id").distinct(), "id", "left_anti")
    kinds = ", ".join(f"{n} {'array<string>' if n in _LISTS else 'string'}" for n in PACKAGE_FIELDS)
    packages = good.select("id", F.inline(F.from_json(F.get_json_object("json", "$.packages"), f"array<struct<{kinds}>>")))
    return packages.withColumnRenamed("affected_versions", "affected"), problems


def _package_problem() -> Column:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(blank("ecosystem") | blank("name") | blank("advisory_id"), "missing field")
        .when(~F.coalesce(F.col("severity").isin("low", "medium", "high", "critical"), F.lit(False)), "invalid severity")
        .when(~F.coalesce(F.col("source_url").rlike("^https://"), F.lit(False)), "invalid url")
        .when(F.try_to_timestamp("added", F.lit("yyyy-MM-dd")).isNull(), "invalid date")
    )


def snapshot_problems(packages: DataFrame) -> DataFrame:
    """Rows of a snapshot that may not be published: invalid or repeated ones."""
    invalid = packages.withColumn("problem", _package_problem()).where("problem is not null").select("ecosystem", "name", "advisory_id", "problem")
    key = (F.lower("ecosystem").alias("ecosystem"), F.lower("name").alias("name"), F.col("advisory_id"))
    repeated = packages.groupBy(*key).count().where(F.col("count") > 1).select("ecosystem", "name", "advisory_id", F.lit("repeated").alias("problem"))
    return invalid.unionByName(repeated)


def snapshot_status(packages: DataFrame, date: Column, today: Column, stale_days: int = 90) -> DataFrame:
    return packages.agg(F.count("*").alias("packages"), F.count_distinct("ecosystem").alias("ecosystems")).withColumn("stale", F.date_add(date, stale_days) < today)


def benchmark_score(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Per case: rules expected and not seen, and whether its control was flagged.

    ``observed`` (case_id, kind, rule_id, severity), ``expected`` (case_id, rule_id)."""
    seen = observed.where("kind = 'risky'").groupBy("case_id").agg(F.collect_set("rule_id").alias("seen"))
    control = observed.where("kind = 'control' and severity in ('high', 'critical')").groupBy("case_id").agg(F.count("*").alias("control_flags"))
    wanted = expected.groupBy("case_id").agg(F.collect_set("rule_id").alias("wanted"))
    joined = wanted.join(seen, "case_id", "left").join(control, "case_id", "left")
    missing = F.array_sort(F.array_except("wanted", F.coalesce("seen", F.array().cast("array<string>"))))
    return joined.select("case_id", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("detected"), F.coalesce("control_flags", F.lit(0)).alias("control_flags"))
