"""Settings files: rules and suppressions of one's own."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession

from treesift.functions.ranks import CONFIDENCES, DISPOSITIONS, SEVERITIES
from treesift.functions.regex import to_python
from treesift.operators.rules import Rule


def parse_settings(text: str) -> tuple[list[Rule], list[tuple[str, str, str | None]]]:
    """(rules, suppressions) of a settings file in YAML; raises ValueError for what is not valid."""
    import yaml

    doc = yaml.safe_load(text) or {}
    if doc.get("version") != 1:
        raise ValueError("settings need version 1")
    rules = []
    for r in doc.get("rules") or []:
        try:
            rule = Rule(r["id"], r["category"], r["severity"], r["confidence"], r["description"], r["pattern"], tuple(r.get("globs") or ()), r.get("match_scope", ""), r.get("disposition", ""), r.get("allow_context_downgrade"))
        except KeyError as e:
            raise ValueError(f"a rule lacks {e}") from None
        if rule.severity not in SEVERITIES or rule.confidence not in CONFIDENCES or rule.scope not in ("", "raw", "code") or rule.disposition not in ("", *DISPOSITIONS):
            raise ValueError(f"rule {rule.id} has an invalid field")
        try:
            to_python(rule.pattern)
        except (re.error, IndexError) as e:
            raise ValueError(f"rule {rule.id}: {e}") from None
        rules.append(rule)
    suppressions = []
    for s in doc.get("suppressions") or []:
        if not s.get("fingerprint") or not s.get("reason"):
            raise ValueError("a suppression needs a fingerprint and a reason")
        expires = str(s["expires"]) if s.get("expires") else None
        if expires:
            datetime.date.fromisoformat(expires)
        suppressions.append((s["fingerprint"], s["reason"], expires))
    return rules, suppressions


def suppression_frame(spark: SparkSession, suppressions: list[tuple[str, str, str | None]]) -> DataFrame:
    return spark.createDataFrame(suppressions, "fingerprint string, reason string, expires string")


def parse_targets(lines: DataFrame) -> DataFrame:
    """Targets of a list read with ``spark.read.text``: one a line, without blanks and comments."""
    from pyspark.sql import functions as F

    return lines.select(F.trim("value").alias("target")).where("target <> '' and not startswith(target, '#')")
