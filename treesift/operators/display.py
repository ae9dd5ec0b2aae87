"""Results as lines of text, a row a line, and values as they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.functions import policy
from treesift.operators import findings as ops

UNITS = ("KiB", "MiB", "GiB", "TiB")


def display_text(value: Column) -> Column:
    """Text with control characters as replacement characters."""
    return F.regexp_replace(value, r"[\x00-\x1F\x7F-\x9F]", "�")


def display_target(target: Column) -> Column:
    """An address without what may be secret: user, query and fragment.  What is none stays."""
    address = r"^([A-Za-z][A-Za-z0-9+.-]*://)(?:[^/?#@]*@)?([^/?#]+)([^?#]*)"
    user = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@"), "[REDACTED]@").otherwise("")
    part = lambda n: F.regexp_extract(target, address, n)
    return F.when(target.rlike(address), F.concat(part(1), user, part(2), part(3))).otherwise(target)


def abbreviated_home(path: Column, home: str) -> Column:
    inside = path.startswith(home.rstrip("/") + "/")
    return F.when((path == home) | inside, F.concat(F.lit("~"), F.substring(path, F.lit(len(home.rstrip("/")) + 1), F.length(path)))).otherwise(path)


def byte_size(n: Column) -> Column:
    """Bytes in the largest binary unit that leaves a number of one or more."""
    out = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for power, unit in enumerate(UNITS, 1):
        value = n.cast("double") / F.lit(float(1024**power))
        shown = F.format_string(f"%.1f {unit}", F.bround(value, 1))  # ties to even
        out = out.when(value < 1024, shown) if unit != UNITS[-1] else out.otherwise(shown)
    return out


def duration(ns: Column) -> Column:
    """Nanoseconds in whole milliseconds below a second, in hours, minutes and seconds from one on."""
    exact = ns.cast("double")  # as a long is divided, also where the numbers are wider
    ms = F.round(exact / 1_000_000).cast("long")
    s = F.round(exact / 1_000_000_000).cast("long")
    hours, minutes, seconds = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    text = lambda c, unit: F.concat(c.cast("long").cast("string"), F.lit(unit))
    long = F.concat(F.when(hours > 0, text(hours, "h")).otherwise(""), F.when(s >= 60, text(minutes, "m")).otherwise(""), text(seconds, "s"))
    return F.when((ns < 1_000_000_000) & (ms == 0), "0s").when((ns < 1_000_000_000) & (ms < 1000), text(ms, "ms")).otherwise(long)


def location(path: Column, start: Column, end: Column | None = None) -> Column:
    more = F.when(end > start, F.concat(F.lit("-"), end.cast("string"))).otherwise("") if end is not None else F.lit("")
    return F.concat(display_text(path), F.when(start > 0, F.concat(F.lit(":"), start.cast("string"), more)).otherwise(""))


def summary_lines(findings: DataFrame, coverage: DataFrame, detail: str = "review", min_severity: str = "low", min_confidence: str = "low") -> DataFrame:
    """(repo_id, section, rank, text): what a terminal shows of each repository of ``coverage``
    (repo_id, complete, error) in the order of section and rank.

    Section 0 is the status, 1 an error, 2 the counts, 3 the reason, 4 the findings that are shown,
    in display order, 5 how many are not.  Each line is a row; nothing is gathered."""
    results = ops.repository_results(findings, coverage).join(coverage, "repo_id")
    keyed = findings.withColumns(ops.order_columns("severity"))
    order = F.struct(*ops.ORDER_KEYS)
    first = F.struct("rule_id", "path", "line")
    blocks = F.col("disposition") == "block"
    levels = {s: F.count_if(F.col("severity") == s) for s in ("critical", "high", "medium", "low")}
    of = keyed.groupBy("repo_id").agg(F.min_by(first, order).alias("first"), F.min_by(F.when(blocks, first), F.when(blocks, order)).alias("first_block"), *[c.alias(s) for s, c in levels.items()])
    shown = ops.visible(findings, detail, min_severity, min_confidence)
    numbers = shown.groupBy("repo_id").agg(F.count("*").alias("shown"))
    repo = results.join(of, "repo_id", "left").join(numbers, "repo_id", "left").fillna(0, [*levels, "shown"])
    failed = F.coalesce("error", F.lit("")) != ""
    top = F.when(F.col("verdict") == policy.DO_NOT_RUN, F.col("first_block")).otherwise(F.col("first"))
    why = (
        F.when(F.col("verdict") == policy.INCOMPLETE, "coverage was incomplete; look at warnings and skipped areas")
        .when(F.col("verdict") == policy.NO_FINDINGS, "no enabled rule matched in a completed scan")
        .when(top.isNotNull(), F.concat(display_text(top["rule_id"]), F.lit(" at "), location(top["path"], top["line"])))
    )
    counts = F.concat_ws(" · ", *[F.concat(F.lit(f"{s} "), F.col(s).cast("string")) for s in levels], F.when(F.col("complete"), "complete").otherwise("incomplete"))
    hidden = F.concat(F.lit("showing "), F.col("shown").cast("string"), F.lit(" of "), F.col("findings").cast("string"), F.lit(" findings"))
    texts = {
        0: F.concat("decision_status", F.lit(" · "), display_text(display_target(F.col("repo_id")))), 1: F.when(failed, F.concat(F.lit("error: "), display_text(F.col("error")))),
        2: counts, 3: F.concat(F.lit("why: "), why), 5: F.when(F.col("shown") < F.col("findings"), hidden),
    }
    lines = F.array(*[F.struct(F.lit(n).alias("section"), text.alias("text")) for n, text in texts.items()])
    heads = repo.select("repo_id", F.inline(lines)).where("text is not null").select("repo_id", "section", F.lit(0).cast("long").alias("rank"), "text")
    label = F.concat(F.upper("severity"), F.lit(" · "), F.upper("confidence"), F.lit("  "), display_text(F.col("rule_id")), F.lit(" · "), display_text(F.col("message")), F.lit(" · "), location(F.col("path"), F.col("line")))
    body = ops.presentation_rank(shown).select("repo_id", F.lit(4).alias("section"), F.col("rank").cast("long").alias("rank"), label.alias("text"))
    return heads.unionByName(body)
