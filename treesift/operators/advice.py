"""What to do about a finding, by what its category is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Our own words: parts of categories' names, the first that fits, and the advice.
ADVICE = (
    (("hygiene",), "Ask the owner for the missing file, or judge the repository without it."),
    (("known-malicious",), "Remove it, and treat machines that ran it as compromised."),
    (("secret", "credential"), "Revoke and replace what is shown, then find out who could read it."),
    (("typosquatting", "package-alias", "dependency", "lockfile"), "Compare the name, source and version with the package you meant."),
    (("registry", "source", "repository", "feed"), "Confirm who runs the place that packages come from, and pin it."),
    (("ci-",), "Pin actions by commit, and keep secrets and write access away from input of others."),
    (("prompt", "agent"), "Keep the text away from agents that may act on it."),
    (("symlink", "archive", "traversal"), "Open it only where paths can't leave an empty folder."),
    (("document", "office", "image", "font"), "Open it in a viewer without macros, scripts or links, or convert it first."),
    (("container",), "Read the image's build steps and drop host access that they don't need."),
    (("editor", "devcontainer", "directory-auto", "git-hook", "shell", "startup"), "Open the folder in restricted mode and read what would start by itself."),
    (("lifecycle", "install", "build", "script", "plugin", "package-", "wrapper", "composer", "go-", "python-", "ruby-", "rust-", "jvm", "dotnet"), "Install without running scripts, and read them before they run."),
    (("exfiltration", "remote", "download", "fetch", "network", "proxy", "reverse"), "Find out what is sent or fetched, and block the address until that is clear."),
    (("execution", "decode", "dynamic", "process", "evasion", "obfusc", "encoded", "entropy", "decoded"), "Decode it by hand, without running it, and see what it would do."),
    (("persistence", "backdoor", "cryptomining", "fingerprinting"), "Look for the same traces on machines where it has run."),
)
OTHER = "Read the lines that are named, and decide whether the project needs them."


def advice(category: Column) -> Column:
    found = None
    for parts, words in ADVICE:
        fits = F.lit(False)
        for part in parts:
            fits |= category.contains(part)
        found = F.when(fits, words) if found is None else found.when(fits, words)
    return found.otherwise(OTHER)


def advised(findings: DataFrame) -> DataFrame:
    """Findings with ``remediation``, for all that ask for something to be done."""
    return findings.withColumn("remediation", F.when(F.col("disposition") != "informational", advice(F.col("category"))).otherwise(""))
