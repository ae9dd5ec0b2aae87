"""Advisory feeds as candidates for a snapshot, read with Spark's JSON source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of ecosystems in feeds, and here.
ECOSYSTEMS = {"PyPI": "pip", "Go": "go", "Packagist": "composer", "RubyGems": "rubygems", "Maven": "maven", "NuGet": "nuget", "crates.io": "rust", "npm": "npm"}
GITHUB = (
    "type string, ghsa_id string, identifiers array<struct<value: string>>, html_url string, published_at string, updated_at string, withdrawn_at string, "
    "vulnerabilities array<struct<package: struct<ecosystem: string, name: string>, vulnerable_version_range: string>>"
)
OSV = (
    "id string, aliases array<string>, published string, modified string, withdrawn string, database_specific struct<review_status: string>, "
    "affected array<struct<package: struct<ecosystem: string, name: string>, versions: array<string>, ranges: array<struct<type: string, events: array<map<string, string>>>>>>"
)
VERSION = r"^[0-9A-Za-z][0-9A-Za-z.+_-]*$"


def _ecosystem(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ECOSYSTEMS.items() for x in pair])
    return F.coalesce(F.element_at(names, F.coalesce(c, F.lit(""))), F.lower(F.coalesce(c, F.lit(""))))


def _names(c: Column, own: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.array_append(F.coalesce(c, F.array().cast("array<string>")), own), lambda x: F.coalesce(x, F.lit("")) != "")))


def _day(c: Column) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, 10)


def github_candidates(feed: DataFrame) -> DataFrame:
    """(id, aliases, ecosystem, name, affected, published, modified, withdrawn) of
    malware advisories in the ``GITHUB`` schema; others are left out."""
    rows = feed.where("type = 'malware'").select("*", F.explode("vulnerabilities").alias("v"))
    ranges = F.trim(F.coalesce("v.vulnerable_version_range", F.lit("")))
    return rows.select(
        F.col("ghsa_id").alias("id"), _names(F.col("identifiers.value"), F.col("ghsa_id")).alias("aliases"), _ecosystem(F.col("v.package.ecosystem")).alias("ecosystem"), F.col("v.package.name").alias("name"),
        F.when(ranges != "", F.array(ranges)).otherwise(F.array().cast("array<string>")).alias("affected"), _day(F.col("published_at")).alias("published"), _day(F.col("updated_at")).alias("modified"),
        (F.coalesce("withdrawn_at", F.lit("")) != "").alias("withdrawn"),
    )


def osv_candidates(feed: DataFrame) -> DataFrame:
    """The same from records in the ``OSV`` schema: listed versions are exact, and a
    range counts only if it was introduced and never ended."""
    rows = feed.select("*", F.explode("affected").alias("a"))
    empty = F.array().cast("array<string>")
    exact = F.transform(F.filter(F.coalesce("a.versions", empty), lambda v: v.rlike(VERSION)), lambda v: F.concat(F.lit("= "), v))
    open_ended = lambda r: (r["type"] == "ECOSYSTEM") & (F.size(r["events"]) == 1) & F.coalesce(F.array_join(F.map_keys(F.get(r["events"], 0)), ",") == "introduced", F.lit(False))
    begins = F.filter(F.transform(F.filter(F.coalesce("a.ranges", F.array().cast("array<struct<type: string, events: array<map<string, string>>>>")), open_ended), lambda r: F.get(r["events"], 0)["introduced"]), lambda v: v.rlike(VERSION))
    review = F.lower(F.coalesce("database_specific.review_status", F.lit("")))
    return rows.select(
        "id", _names(F.col("aliases"), F.col("id")).alias("aliases"), _ecosystem(F.col("a.package.ecosystem")).alias("ecosystem"), F.col("a.package.name").alias("name"),
        F.array_sort(F.array_distinct(F.concat(exact, F.transform(begins, lambda v: F.concat(F.lit(">= "), v))))).alias("affected"), _day(F.col("published")).alias("published"), _day(F.col("modified")).alias("modified"),
        ((F.coalesce("withdrawn", F.lit("")) != "") | review.isin("false_positive", "not_affected", "rejected")).alias("withdrawn"),
    )
