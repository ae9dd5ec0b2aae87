"""Decision rules of findings and repositories as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Contexts that only surround code, and contexts in which a critical finding blocks.
CONTEXTUAL = ("documentation", "example", "test-fixture", "evidence", "generated", "dependency", "detection-definition", "metadata")
BLOCKING = ("executable", "manifest-hook", "ci-workflow", "confirmed-ioc")

NO_FINDINGS, REVIEW, DO_NOT_RUN, INCOMPLETE = "NO FINDINGS", "REVIEW REQUIRED", "DO NOT RUN", "SCAN INCOMPLETE"


def is_contextual(context: Column) -> Column:
    return context.isin(*CONTEXTUAL)


def is_blocking(severity: Column, confidence: Column, context: Column) -> Column:
    return (severity == "critical") & (confidence == "high") & context.isin(*BLOCKING)


def default_disposition(rule_id: Column, category: Column, severity: Column, confidence: Column, context: Column) -> Column:
    """What a finding without a disposition of its own suggests."""
    return (
        F.when(is_blocking(severity, confidence, context), "block")
        .when((rule_id == "CICD-003") | rule_id.startswith("REPO-") | (category == "repository-hygiene"), "harden")
        .when(is_contextual(context) | (severity == "low") | (confidence == "low") | (category == "process-capability"), "informational")
        .otherwise("review")
    )


def rule_disposition(rule_id: Column, category: Column, severity: Column, confidence: Column) -> Column:
    """What a rule of the catalogue suggests by itself."""
    return (
        F.when(rule_id.isin("CICD-003", "JVMWRAP-002") | rule_id.startswith("REPO-") | (category == "repository-hygiene"), "harden")
        .when((severity == "low") | (confidence == "low") | (category == "process-capability"), "informational")
        .when((severity == "critical") & (confidence == "high"), "block")
        .otherwise("review")
    )


def contextualized(severity: Column, confidence: Column, context: Column, allowed: Column) -> tuple[Column, Column]:
    """Severity and confidence, capped where the context only surrounds code."""
    caps = allowed & is_contextual(context)
    return F.when(caps & severity.isin("high", "critical"), "medium").otherwise(severity), F.when(caps, "low").otherwise(confidence)


def verdict(blocking: Column, findings: Column, complete: Column) -> Column:
    """A blocking finding counts even in an incomplete scan."""
    return F.when(blocking, DO_NOT_RUN).when(~complete, INCOMPLETE).when(findings > 0, REVIEW).otherwise(NO_FINDINGS)


def decision_status(verdict_: Column, complete: Column, error: Column) -> Column:
    """Unlike the verdict, incompleteness comes first here."""
    return (
        F.when(~complete | (F.coalesce(error, F.lit("")) != "") | (verdict_ == INCOMPLETE), INCOMPLETE)
        .when(verdict_ == NO_FINDINGS, "NO RELEVANT FINDINGS DETECTED")
        .when(verdict_ == DO_NOT_RUN, "FINDINGS DETECTED")
        .otherwise(REVIEW)
    )


def fingerprint(*parts: Column) -> Column:
    """A digest over parts that a zero byte keeps apart."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256))
