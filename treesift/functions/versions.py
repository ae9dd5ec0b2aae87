"""Version predicates of advisories as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_version(version: Column) -> Column:
    """The version that a declaration pins, or empty for ranges and wildcards."""
    v = F.trim(version)
    bare = F.regexp_replace(v, "^[=v ]+", "")
    return F.when(v.rlike(r"[*|, <>^~]") | (bare == "") | bare.rlike("[xX*]"), "").otherwise(bare)


def _numbers(version: Column) -> Column:
    """The first three numeric parts, 0 for missing ones; null if one is no number."""
    core = F.get(F.split(F.regexp_replace(F.trim(version), "^v", ""), "-", 2), 0)
    parts = F.slice(F.split(core, r"\."), 1, 3)
    valid = F.forall(parts, lambda p: p.rlike(r"^[+-]?[0-9]+$"))
    at = lambda i: F.coalesce(F.get(parts, i).try_cast("long"), F.lit(0))
    return F.when(valid, F.struct(at(0).alias("a"), at(1).alias("b"), at(2).alias("c")))


def compare_versions(one: Column, other: Column) -> Column:
    """-1, 0 or 1; null if either cannot be compared."""
    a, b = _numbers(one), _numbers(other)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(a < b, -1).when(a > b, 1).otherwise(0)


def is_affected(declared: Column, ranges: Column) -> Column:
    """Whether an exact declaration falls under one of the ranges.  A compound
    range never does, as what follows its first bound is no version."""
    exact = exact_version(declared)

    def one(r: Column) -> Column:
        r = F.trim(r)
        out = r.isin("> 0", ">= 0", ">=0") | (r.startswith("=") & (exact_version(F.regexp_replace(r, "^=", "")) == exact))
        out |= ~r.rlike(r"[<>=|,* ]") & (exact_version(r) == exact)
        for op, test in (("<=", lambda c: c <= 0), (">=", lambda c: c >= 0), ("<", lambda c: c < 0), (">", lambda c: c > 0)):
            out |= r.startswith(op) & F.coalesce(test(compare_versions(exact, F.trim(F.substring(r, F.lit(len(op) + 1), F.length(r))))), F.lit(False))
        return out

    return (exact != "") & F.exists(ranges, one)


def range_may_include(declared: Column, ranges: Column) -> Column:
    """Whether a caret or tilde declaration can resolve to an affected exact version."""
    v = F.trim(declared)
    base = exact_version(F.trim(F.substring(v, 2, 1 << 20)))
    caret, tilde = v.startswith("^"), v.startswith("~")
    b = F.split(base, r"\.")

    def one(r: Column) -> Column:
        candidate = exact_version(F.trim(F.regexp_replace(r, "^=", "")))
        c = F.split(candidate, r"\.")
        same = lambda i: F.get(b, i).eqNullSafe(F.get(c, i))
        reach = (base != "") & (candidate != "") & F.coalesce(compare_versions(candidate, base) >= 0, F.lit(False))
        reach &= (F.size(b) >= 2) & (F.size(c) >= 2) & same(0)
        reach &= ~(tilde | (F.get(b, 0) == "0")) | same(1)
        reach &= ~(caret & (F.get(b, 0) == "0") & (F.get(b, 1) == "0") & (F.size(b) >= 3)) | ((F.size(c) >= 3) & same(2))
        return r.isin(">= 0", "> 0") | (r.startswith("=") & (caret | tilde) & reach)

    return (v != "") & (exact_version(v) == "") & F.exists(ranges, one)


def all_exact(ranges: Column) -> Column:
    """Whether every range names one version."""
    return (F.size(ranges) > 0) & F.forall(ranges, lambda r: F.trim(r).startswith("=") & (exact_version(F.trim(F.regexp_replace(F.trim(r), "^=", ""))) != ""))
