"""The rule engine: lines against a catalogue of patterns.

A rule is data (id, category, severity, confidence, scope, disposition, globs,
message, pattern).  Which rules a file can meet follows from its path, and then
from the whole text, on which each pattern is tried once.  Only files that are
left have their lines looked at, with these rules alone, inside the file's own
array; only matches become rows.  Patterns are literals of the JVM's pattern
functions.  A rule whose pattern may hold a line feed and that met no line of a
file is tried on the whole file, in Arrow batches, with offsets; lines and spans
come from one pass over the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.functions import policy
from treesift.functions.code_projection import code_projection
from treesift.functions.paths import C_LIKE, HASH_COMMENTS, applies, classify_context, contains_any, extension, inner_path, match_context
from treesift.functions.regex import anywhere, needles, spans_lines, to_java, to_python
from treesift.functions.text import DENSE_LINE, LONG_LINE, NEAR, folded, heuristics_apply, is_dangerous, safe_evidence
from treesift.operators.rule_table import RULES

#: Rules that look at code without comments and strings.
CODE_SCOPED = ("EXEC-001", "EXEC-002", "BACKDOOR-001", "IMPORT-001", "IMPORT-003", "PROTO-001", "ENV-001", "FINGERPRINT-001", "UNSERIALIZE-001", "PATH-001")
#: Registries that packages may come from.
TRUSTED_REGISTRIES = ("registry.npmjs.org", "registry.yarnpkg.com", "files.pythonhosted.org", "repo1.maven.org", "repo.maven.apache.org")
LITERAL_IMPORT = r"""(?i)^\s*(?:import|require|__import__|Class\.forName)\s*\(\s*["']"""


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    confidence: str
    message: str
    pattern: str
    globs: tuple[str, ...] = ()
    scope: str = ""
    disposition: str = ""
    allow_downgrade: bool | None = None

    def match_scope(self) -> str:
        return self.scope or ("code" if self.id in CODE_SCOPED else "raw")

    def may_downgrade(self) -> bool:
        return self.allow_downgrade if self.allow_downgrade is not None else not self.id.startswith(("IOC-", "SECRET-"))


def builtin_rules() -> list[Rule]:
    return [Rule(i, cat, sev, conf, message, pattern, tuple(globs), scope, disp) for i, cat, sev, conf, scope, disp, globs, message, pattern in RULES]


def rule_frame(spark, rules: list[Rule]) -> DataFrame:
    """The catalogue as a table, with defaults filled in."""
    rows = [(n, r.id, r.category, r.severity, r.confidence, r.message, r.pattern, list(r.globs), r.match_scope(), r.disposition, r.may_downgrade()) for n, r in enumerate(rules)]
    frame = spark.createDataFrame(
        rows, "ordinal int, rule_id string, category string, severity string, confidence string, message string, pattern string, globs array<string>, match_scope string, disposition string, allow_downgrade boolean"
    )
    own = F.col("disposition") != ""
    return frame.withColumn("disposition", F.when(own, F.col("disposition")).otherwise(policy.rule_disposition(F.col("rule_id"), F.col("category"), F.col("severity"), F.col("confidence"))))


def _public_ip(url: Column) -> Column:
    """Whether a URL's address is neither private nor otherwise set aside."""
    parts = F.transform(F.split(F.regexp_extract(url, r"(?i)https?://([0-9]{1,3}(?:\.[0-9]{1,3}){3})", 1), r"\."), lambda p: p.try_cast("int"))
    a, b = F.get(parts, 0), F.get(parts, 1)
    valid = (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p <= 255, F.lit(False)))
    set_aside = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a == 127) | ((a == 169) & (b == 254)) | a.between(224, 239) | F.forall(parts, lambda p: p == 0)
    return valid & ~F.coalesce(set_aside, F.lit(True))


def _trusted_registry(match: Column) -> Column:
    low = F.lower(match)
    secure, plain = F.instr(low, "https://"), F.instr(low, "http://")
    host = F.regexp_extract(low, r"https://([^/\s?#,;)]*)", 1)
    return (secure > 0) & ~((plain > 0) & (plain < secure)) & F.regexp_replace(host, ":443$", "").isin(*TRUSTED_REGISTRIES)


def _count(rule: Rule, line: Column, raw: Column) -> Column:
    """Qualifying matches of a rule on a line."""
    pattern = to_java(rule.pattern)
    keep = {
        "NPMRC-002": lambda m: ~_trusted_registry(m),
        "LOCK-001": lambda m: ~_trusted_registry(m),
        "IPURL-001": _public_ip,
    }.get(rule.id)
    if keep:
        return F.size(F.filter(F.regexp_extract_all(line, F.lit(pattern), 0), keep))
    if rule.id == "IMPORT-001":  # the match is on blanked code, the literal in the line itself
        found = F.regexp_count(line, F.lit(pattern))
        literal = F.regexp_count(raw, F.lit(to_java(LITERAL_IMPORT.replace("^", "", 1))))
        return F.when(found > 0, F.greatest(found - literal, F.lit(0))).otherwise(0)
    if rule.id == "GITHOOK-001":
        squeezed = F.lower(F.replace(F.trim(raw), F.lit(" "), F.lit("")))
        return F.when(squeezed.isin("hookspath=/dev/null", "core.hookspath=/dev/null", "hookspath=nul", "core.hookspath=nul"), 0).otherwise(F.regexp_count(line, F.lit(pattern)))
    return F.regexp_count(line, F.lit(pattern))


def plain_ends(text: Column) -> Column:
    """Text whose lines end in a line feed alone."""
    return F.when(text.contains("\r"), F.regexp_replace(text, r"\r(\n|\z)", "$1")).otherwise(text)


def _lines(text: Column) -> Column:
    """The lines of ``plain_ends``; no empty one after a closing line feed."""
    parts = F.split(text, "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


#: A line of a file that meets a rule, or is a long or a dense one (``LONG``, ``DENSE`` as its ordinal).
MATCH = "struct<line_no: int, raw: string, code: string, ordinal: int, n: int>"
LONG, DENSE = -1, -2


def matched(files: DataFrame, rules: list[Rule], heuristics: bool = False) -> DataFrame:
    """(repo_id, path, text, code_text, matches, tried): each file of ``files`` (repo_id,
    path, text) once, with its lines that meet rules, and the rules that may meet it
    across lines (``tried``).  ``n`` of a match counts qualifying matches and may be 0
    where all were disqualified.

    A rule is first tried on the whole text, whose lines it can only meet if it meets
    this; so most files need no look at single lines, and the others with few rules.  The
    pattern itself is tried only where the text holds one of the words that it needs."""
    usable = [(i, r) for i, r in enumerate(rules) if r.match_scope() != "structured"]
    sets = list(dict.fromkeys(r.globs for _, r in usable))
    ext = extension(inner_path(F.col("path")))
    lexed = ext.isin(*{*C_LIKE, *HASH_COMMENTS})
    has_code = any(r.match_scope() == "code" for _, r in usable)
    pth = F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), r"\r\n|[\r\x0B\x0C\x1C\x1D\x1E\u0085\u2028\u2029]", "\n")  # the line ends of Python's path files
    read = files.select("repo_id", "path", "text", plain_ends(F.col("text")).alias("raw_text"), F.when(ext == ".pth", pth).alias("pth_text"), *[applies(F.col("path"), g).alias(f"g{k}") for k, g in enumerate(sets)])
    if has_code:
        read = read.withColumn("code_text", F.when(lexed, code_projection(F.when(lexed, F.col("text")), ext)).otherwise(F.col("text")))
        read = read.withColumn("code_plain", F.when(lexed, plain_ends(F.col("code_text"))).otherwise(F.col("raw_text")))
    else:
        read = read.withColumns({"code_text": F.col("text"), "code_plain": F.col("raw_text")})
    of_scope = {"raw": F.col("raw_text"), "code": F.col("code_plain"), "pth": F.col("pth_text")}
    scope = lambda r: "pth" if r.id == "PY-004" else r.match_scope()
    read = read.withColumn("folded", folded(F.col("text")))
    sought = {i: needles(r.pattern) for i, r in usable}
    holds = lambda i: contains_any(F.col("folded"), sought[i]) if sought[i] else F.lit(True)
    may = [F.when(F.col(f"g{sets.index(r.globs)}") & holds(i) & of_scope[scope(r)].rlike(anywhere(r.pattern)), F.lit(i)) for i, r in usable]
    read = read.select("repo_id", "path", "text", "code_text", "raw_text", "code_plain", "pth_text", F.array_compact(F.array(*may)).alias("may"))

    def hits(raw: Column, code: Column, which: list) -> Column:
        found = []
        for i, r in which:
            line = code if r.match_scope() == "code" else raw
            found.append(F.when(F.array_contains("may", i) & line.rlike(to_java(r.pattern)), F.struct(F.lit(i).alias("ordinal"), _count(r, line, raw).cast("int").alias("n"))))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<ordinal: int, n: int>>")

    def of_lines(both: Column, which: list) -> Column:
        each = F.transform(both, lambda x, at: F.transform(hits(x["raw"], x["code"], which), lambda h: F.struct((at + 1).alias("line_no"), x["raw"].alias("raw"), x["code"].alias("code"), h["ordinal"].alias("ordinal"), h["n"].alias("n"))))
        return F.flatten(each)

    none = F.array().cast(f"array<{MATCH}>")
    zipped = F.arrays_zip(_lines(F.col("raw_text")).alias("raw"), _lines(F.col("code_plain")).alias("code"))
    parts = [F.when(F.size("may") > 0, of_lines(zipped, [x for x in usable if x[1].id != "PY-004"]))]
    if any(r.id == "PY-004" for _, r in usable):
        own = F.transform(_lines(F.col("pth_text")), lambda x: F.struct(x.alias("raw"), x.alias("code")))
        parts.append(F.when(F.col("pth_text").isNotNull() & (F.size("may") > 0), of_lines(own, [x for x in usable if x[1].id == "PY-004"])))
    if heuristics:
        parts += _odd_lines(_lines(F.col("raw_text")))
    matches = F.concat(*[F.coalesce(p.cast(f"array<{MATCH}>"), none) for p in parts])
    spanning = F.array(*[F.lit(i) for i, r in usable if spans_lines(r.pattern) and r.id != "PY-004"]).cast("array<int>")
    out = read.select("repo_id", "path", "text", "code_text", "may", matches.alias("matches"))
    tried = F.array_except(F.array_intersect("may", spanning), F.transform("matches", lambda m: m["ordinal"]))
    return out.select("repo_id", "path", "text", "code_text", "matches", tried.alias("tried"))


def _odd_lines(lines: Column) -> list[Column]:
    """Long lines, and dense ones by their size and a call near them; their entropy is taken of the few that are left."""
    match = lambda x, at, kind: F.struct((at + 1).alias("line_no"), x.alias("raw"), F.lit(None).cast("string").alias("code"), F.lit(kind).alias("ordinal"), F.lit(1).alias("n"))
    plain = heuristics_apply(F.col("path"))
    long = F.filter(F.transform(lines, lambda x, at: F.when(F.octet_length(x) > LONG_LINE, match(x, at, LONG))), lambda m: m.isNotNull())
    risky = F.transform(lines, is_dangerous)
    near = lambda at: F.exists(F.slice(risky, F.greatest(at + 1 - NEAR, F.lit(1)), F.lit(NEAR) + 1 + F.least(at, F.lit(NEAR))), lambda x: x)
    dense = F.filter(F.transform(lines, lambda x, at: F.when((F.octet_length(x) >= DENSE_LINE) & near(at), match(x, at, DENSE))), lambda m: m.isNotNull())
    return [F.when(plain & (F.octet_length("raw_text") > LONG_LINE), long), F.when(plain & is_dangerous(F.col("raw_text")), dense)]


def across_lines(patterns: dict[int, tuple[re.Pattern, str]], text: str, code: str | None, tried: list[int]) -> Iterator[tuple[int, int, int, str, int]]:
    """(ordinal, start_line, end_line, evidence, at) of the whole-file matches of the rules ``tried``."""
    for i in tried:
        pattern, scope = patterns[i]
        line, seen = 1, 0
        for m in pattern.finditer(code if scope == "code" and code is not None else text):
            line += text.count("\n", seen, m.start())
            seen = m.start()
            yield i, line, line + m[0].count("\n"), text[m.start() : m.end()], m.start()


def compiled(rules: list[Rule]) -> dict[int, tuple[re.Pattern, str]]:
    return {i: (to_python(r.pattern), r.match_scope()) for i, r in enumerate(rules) if r.match_scope() != "structured" and spans_lines(r.pattern)}


#: What the pass over texts says of a file: a line that meets a rule, a match across lines, or what a detector says.
FOUND = (
    "repo_id string, path string, kind string, ordinal int, rule_id string, start_line int, end_line int, n int, at int, raw string, code string, reason string"
)


def on_lines(read: DataFrame) -> DataFrame:
    """The lines of ``matched`` as rows of ``FOUND``."""
    null = lambda kind: F.lit(None).cast(kind)
    # outer, as the planner else asks for the size of the array first and so makes it twice
    rows = read.select("repo_id", "path", F.inline_outer("matches")).where("ordinal is not null")
    return rows.select("repo_id", "path", F.lit("line").alias("kind"), "ordinal", null("string").alias("rule_id"), F.col("line_no").alias("start_line"), null("int").alias("end_line"), "n", F.lit(0).alias("at"), "raw", "code", null("string").alias("reason"))


def with_spans(read: DataFrame, rules: list[Rule]) -> DataFrame:
    """The lines of ``matched``, and the matches across lines of what it has left to try, in one pass."""
    patterns = {i: (r.pattern, r.match_scope()) for i, r in enumerate(rules)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {i: (to_python(p), scope) for i, (p, scope) in patterns.items() if spans_lines(p)}
        for batch in batches:
            yield lines_in_batch(batch)
            rows = []
            for repo, path, text, code, tried in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "path", "text", "code_text", "tried")), strict=True):
                if tried:
                    rows += [(repo, path, "span", i, None, start, end, 1, at, evidence, None, None) for i, start, end, evidence, at in across_lines(ready, text, code, tried)]
            yield found_batch(rows)

    return only_worth(read, F.size("tried") > 0).mapInArrow(run, FOUND)


def only_worth(read: DataFrame, worth: Column, *more: str) -> DataFrame:
    """``matched`` with texts only where ``worth`` says that Python looks at them."""
    return read.select("repo_id", "path", F.when(worth, F.col("text")).alias("text"), F.when(F.size("tried") > 0, F.col("code_text")).alias("code_text"), "matches", "tried", *more)


_FOUND = pa.schema(
    [("repo_id", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("ordinal", pa.int32()), ("rule_id", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()),
     ("n", pa.int32()), ("at", pa.int32()), ("raw", pa.string()), ("code", pa.string()), ("reason", pa.string())]
)


def found_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(_FOUND), _FOUND, strict=True)], schema=_FOUND)


def lines_in_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The matches of a batch of ``matched`` as rows, without making objects of them."""
    lists = batch.column("matches")
    of, each = pc.list_parent_indices(lists), pc.list_flatten(lists)
    field = lambda name: pc.struct_field(each, name)
    n, null = len(each), lambda kind: pa.nulls(len(each), kind)
    columns = {
        "repo_id": batch.column("repo_id").take(of), "path": batch.column("path").take(of), "kind": pa.array(["line"] * n, pa.string()), "ordinal": field("ordinal"), "rule_id": null(pa.string()),
        "start_line": field("line_no"), "end_line": null(pa.int32()), "n": field("n"), "at": pa.array(np.zeros(n, np.int32)), "raw": field("raw"), "code": field("code"), "reason": null(pa.string()),
    }
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in _FOUND], schema=_FOUND)


def _skipped(rule_id: Column, context: Column, path: Column) -> Column:
    """Rules that say nothing in generated code and dependencies."""
    bundle = F.lower(path).contains("/charting_library/bundles/")
    return context.isin("generated", "dependency") & (
        rule_id.isin("ENV-001", "EXEC-004", "OBFS-004", "OBFS-005") | (bundle & rule_id.isin("EXEC-001", "PROTO-001", "OBFS-001", "OBFS-002", "OBFS-003", "OBFS-008"))
    )


def scan(files: DataFrame, rules: list[Rule] | None = None, fallback: bool = True) -> DataFrame:
    """Raw findings of the rules in ``files`` (repo_id, path, text), from one pass over these."""
    rules = builtin_rules() if rules is None else rules
    read = matched(files, rules)
    return rule_findings(with_spans(read, rules) if fallback else on_lines(read), rules)


def rule_findings(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """Raw findings of the lines and spans in ``found`` (``FOUND``)."""
    catalogue = F.broadcast(rule_frame(found.sparkSession, rules).drop("pattern", "globs", "match_scope"))  # as long as the rule list
    spans = F.col("kind") == "span"
    met = found.where((F.col("n") > 0) & F.col("kind").isin("line", "span") & (F.col("ordinal") >= 0)).drop("rule_id").join(catalogue, "ordinal")
    exfil = next((to_java(r.pattern) for r in rules if r.id == "EXFIL-001"), None)
    confidence = F.col("confidence")
    if exfil:
        lexed = extension(inner_path(F.col("path"))).isin(*C_LIKE, *HASH_COMMENTS)
        confidence = F.when(~spans & (F.col("rule_id") == "EXFIL-001") & lexed & ~F.col("code").rlike(exfil), "low").otherwise(confidence)
    context = F.when(spans, classify_context(F.col("path"))).otherwise(match_context(F.col("category"), F.col("path"), F.col("raw")))
    out = met.withColumns({"context": context, "confidence": confidence}).select(
        "repo_id", "path", "rule_id", "category", "severity", "confidence", "context", "message", "disposition", "allow_downgrade",
        "start_line", F.when(F.col("end_line") > F.col("start_line"), F.col("end_line")).alias("end_line"), safe_evidence(F.col("raw")).alias("evidence"), F.col("n").alias("occurrences"),
        F.struct(F.split("path", "/").alias("walk"), "ordinal", F.col("start_line").alias("line"), "at").alias("emit_seq"),
    )
    severity, confidence = policy.contextualized(F.col("severity"), F.col("confidence"), F.col("context"), F.col("allow_downgrade"))
    kept = out.where(~_skipped(F.col("rule_id"), F.col("context"), F.col("path")))
    return kept.withColumns(
        {"severity": severity, "confidence": confidence, "disposition": F.when(policy.is_contextual(F.col("context")), "informational").otherwise(F.col("disposition"))}
    ).drop("allow_downgrade")
