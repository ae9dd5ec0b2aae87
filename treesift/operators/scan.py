"""One scan of everything: trees in, findings, gaps and verdicts out.

Detectors say (repo_id, path, rule_id) and what they know of lines, evidence and
severity.  Their hits meet in one table, which ``raised`` turns into raw findings by
the catalogue; with those of the rules they are deduplicated and correlated, and
lead to a verdict.  Whatever was not looked at is a row of the gaps (repo_id,
path, reason); a repository with one is incomplete.

The tree is read once and written as a table of files, with their texts, flags and
first bytes; archives are opened once.  One stage then passes over all texts, for
rules, lines and detectors alike (``pass_over``).  Settings and manifests, a folder of
their own in that table, are read by their detectors; all else reads small columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treesift.functions import policy
from treesift.functions.paths import base_name, classify_context, extension, walk_key
from treesift.functions.regex import spans_lines, to_python
from treesift.functions.text import looks_text, safe_evidence
from treesift.operators import active, content, findings, packages, rules, supply_chain
from treesift.operators.advice import advised
from treesift.operators.structured_table import CONTEXTS, PATH_CONTEXT, STRUCTURED, TONED_DOWN
from treesift.sources import archives, files, manifests
from treesift.sources.tables import kept

#: Arrival of findings in one file: detectors before the rules, and after them.
BEFORE, AFTER = -1000, 100_000


@dataclass
class Scan:
    """``findings``: deduplicated and correlated; ``gaps``: what was not looked at;
    ``verdicts``: (repo_id, findings, complete, verdict)."""

    findings: DataFrame
    gaps: DataFrame
    verdicts: DataFrame


def structured_frame(spark: SparkSession) -> DataFrame:
    """The catalogue of detectors that are not patterns, and of the rules that detectors raise."""
    rows = list(STRUCTURED)
    own = {r[0] for r in rows}
    rows += [(r.id, r.category, r.severity, r.confidence, r.message) for r in rules.builtin_rules() if r.id not in own]
    return spark.createDataFrame(rows, "entry string, entry_category string, entry_severity string, entry_confidence string, entry_message string")


HIT = ("repo_id", "path", "rule_id", "arrival", "start_line", "end_line", "evidence", "message", "severity", "confidence", "context")


def as_hits(found: DataFrame, arrival: int) -> DataFrame:
    """What a detector says, in the columns that all hits have.  Of ``found`` (repo_id,
    path, rule_id) also start_line, end_line or line_no, evidence or reason, message,
    severity, confidence and context count where there are any.  ``arrival``: when the
    detector's findings come among those of a file."""
    present = set(found.columns)
    of = lambda kind, *names: next((F.col(n) for n in names if n in present), F.lit(None)).cast(kind)
    text = {n: of("string", n) for n in HIT[7:]}
    return found.select(
        "repo_id", "path", "rule_id", F.lit(arrival).alias("arrival"), of("int", "start_line", "line_no").alias("start_line"), of("int", "end_line").alias("end_line"),
        of("string", "evidence", "reason").alias("evidence"), *[c.alias(n) for n, c in text.items()],
    )


def raised(hits: DataFrame) -> DataFrame:
    """Raw findings of hits, with what the catalogue says where a detector says nothing."""
    entry = F.when(F.col("rule_id").startswith("IOC-PKG-"), "IOC-PKG-*").otherwise(F.col("rule_id"))
    catalogue = F.broadcast(structured_frame(hits.sparkSession))  # as long as the catalogue
    joined = hits.withColumn("entry", entry).join(catalogue, "entry").withColumn("start_line", F.coalesce("start_line", F.lit(0)))
    by_rule = F.when(F.col("rule_id").isin(*PATH_CONTEXT, *TONED_DOWN), classify_context(F.col("path")))
    for name, ids in CONTEXTS.items():
        by_rule = by_rule.when(F.col("rule_id").isin(*ids), name)
    own = joined.withColumns(
        {
            "context": F.coalesce("context", by_rule, F.lit("executable")), "severity": F.coalesce("severity", "entry_severity"),
            "confidence": F.coalesce("confidence", "entry_confidence"), "end_line": F.when(F.col("end_line") > F.col("start_line"), F.col("end_line")),
        }
    )
    severity, confidence = policy.contextualized(F.col("severity"), F.col("confidence"), F.col("context"), F.col("rule_id").isin(*TONED_DOWN))
    toned = own.withColumns({"severity": severity, "confidence": confidence})
    disposition = policy.default_disposition(F.col("rule_id"), F.col("entry_category"), F.col("severity"), F.col("confidence"), F.col("context"))
    reviewed = F.col("rule_id").isin(*TONED_DOWN, "IDE-007") & ~policy.is_contextual(F.col("context"))
    return toned.select(
        "repo_id", "path", "rule_id", F.col("entry_category").alias("category"), "severity", "confidence", "context", F.coalesce("message", "entry_message").alias("message"),
        F.when(reviewed, "review").otherwise(disposition).alias("disposition"), "start_line", "end_line", safe_evidence(F.coalesce("evidence", F.lit(""))).alias("evidence"),
        F.lit(1).alias("occurrences"), F.struct(F.split("path", "/").alias("walk"), F.col("arrival").alias("ordinal"), F.col("start_line").alias("line"), F.lit(0).alias("at")).alias("emit_seq"),
    )


#: Source and prose, of which no detector of settings, manifests or packages reads the text.
_PROSE = (
    ".txt", ".md", ".markdown", ".rst", ".adoc", ".html", ".htm", ".svg", ".css", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".py", ".pyw", ".c", ".h", ".cc", ".cpp", ".go", ".java", ".kt", ".swift", ".php",
)


def _is_setting(path: Column) -> Column:
    base = F.lower(base_name(path))
    prose = extension(path).isin(*_PROSE) & ~base.startswith("requirements") & ~base.startswith("gemfile")
    return path.contains("!") | F.concat(F.lit("/"), path).contains("/.git/") | ~prose


def _entries(rows: DataFrame, member: bool, digests: bool) -> DataFrame:
    """Rows (repo_id, path, executable, link_target, content, problem) with what a scan asks of
    their bytes: text, or else the bytes themselves (also of archives), the first of them, and flags."""
    content = F.col("content")
    readable = F.col("link_target").isNull() & F.col("problem").isNull() & content.isNotNull()
    text = F.coalesce(readable & looks_text(content), F.lit(False))
    archive = F.coalesce(readable & archives.is_archive(F.col("path"), content), F.lit(False))
    return rows.select(
        "repo_id", "path", F.coalesce("executable", F.lit(False)).alias("executable"), "link_target", "problem", F.lit(member).alias("member"), readable.alias("readable"), (archive & F.lit(not member)).alias("archive"),
        F.when(readable, F.substring("content", 1, 4)).alias("head"), F.when(readable & F.lit(digests), F.sha2("content", 256)).alias("sha256"),
        F.when(text, F.make_valid_utf8(content.cast("string"))).alias("text"), F.when(readable & (archive | ~text), content).alias("content"),
        (readable & ~text & files.source_or_settings(F.col("path"), F.col("executable"), content)).alias("undecodable"), F.coalesce(_is_setting(F.col("path")), F.lit(True)).alias("setting"),
    )


def listing(tree: DataFrame, max_files: int | None = files.MAX_FILES, digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """(every file, repositories over the limit of files): the tree is read once and written
    as a table, split by what is a setting and what is prose; members of archives follow as
    rows of their own.  Files beyond the limit are left out; None is no limit."""
    first = kept(_entries(tree, False, digests), "entries", "setting")
    if max_files is None:
        over = first.sparkSession.createDataFrame([], "repo_id string")
    else:
        over = kept(first.where("readable").groupBy("repo_id").count().where(F.col("count") > max_files).select("repo_id"), "over")
    if max_files is not None and not over.isEmpty():  # the last path of each such repository, from the paths alone
        order = Window.partitionBy("repo_id").orderBy(walk_key(F.col("path")))
        turns = first.where("readable").join(over, "repo_id", "left_semi").select("repo_id", "path", F.row_number().over(order).alias("turn"))
        last = turns.where(F.col("turn") == max_files).select("repo_id", walk_key(F.col("path")).alias("last"))
        first = first.join(last, "repo_id", "left").where(~F.col("readable") | F.col("last").isNull() | (walk_key(F.col("path")) <= F.col("last"))).drop("last")
    packed = first.where("archive")
    if packed.select("path").isEmpty():
        return first, over
    inner = archives.inside(packed).select("repo_id", "path", F.lit(False).alias("executable"), F.lit(None).cast("string").alias("link_target"), "content", F.nullif("problem", F.lit("")).alias("problem"))
    return first.unionByName(kept(_entries(inner, True, digests), "members", "setting")), over


#: What looks at one text, by the place of its findings among those of a file.
PASS: dict[int, active.Detector] = {
    BEFORE + 5: active.SVG, BEFORE + 6: active.HIDDEN, BEFORE + 7: active.JS_FLOW, BEFORE + 8: active.PY_FLOW, AFTER + 2: active.STAGED, AFTER + 3: active.WORKFLOW,
}
DECODED = BEFORE + 7


def pass_over(texts: DataFrame, rule_list: list[rules.Rule]) -> DataFrame:
    """What rules, line heuristics and detectors find in ``texts`` (repo_id, path, text), as
    ``rules.FOUND``: one read of each text in one stage without a shuffle.  Rules and lines are
    expressions over the file's row; a text goes to Python only if a detector's gate or a rule
    that spans lines asks for it, once for all of these.  Of detectors, ``ordinal`` is their
    place and a row without rule_id a gap; decoded literals have kind ``value``."""
    gates = {**{n: d.gate() for n, d in PASS.items()}, 0: active.decodes()}
    chosen = F.array_compact(F.array(*[F.when(g, F.lit(n)) for n, g in gates.items()]))
    read = rules.matched(texts, rule_list, heuristics=True).withColumn("chosen", chosen)
    patterns = {i: (r.pattern, r.match_scope()) for i, r in enumerate(rule_list) if spans_lines(r.pattern)}

    def found_in(repo: str, path: str, text: str, code: str | None, tried: list[int], chosen: list[int], ready: dict) -> Iterator[tuple]:
        for i, start, end, evidence, at in rules.across_lines(ready, text, code, tried):
            yield repo, path, "span", i, None, start, end, 1, at, evidence, None, None
        for n in chosen:
            if n:
                for rule_id, start, end, reason in PASS[n].hits(path, text):
                    yield repo, path, "hit" if rule_id else "gap", n, rule_id, start, end, 1, 0, None, None, reason
            else:
                for start, end, method, raw, value in active.js_literals(path, text):
                    yield repo, path, "gap" if value is None else "value", DECODED, None, start, end, 1, 0, raw, value, method

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {i: (to_python(p), scope) for i, (p, scope) in patterns.items()}
        for batch in batches:
            yield rules.lines_in_batch(batch)
            rows = []
            for repo, path, text, code, tried, chosen in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "path", "text", "code_text", "tried", "chosen")), strict=True):
                if text is not None and (tried or chosen):
                    rows += found_in(repo, path, text, code, tried, chosen, ready)
            yield rules.found_batch(rows)

    worth = (F.size("tried") > 0) | (F.size("chosen") > 0)
    return rules.only_worth(read, worth, "chosen").mapInArrow(run, rules.FOUND)


def pass_hits(found: DataFrame) -> list[tuple[int, DataFrame]]:
    """(order, hits) of the detectors and line heuristics in the result of ``pass_over``."""
    hits = [(n, found.where((F.col("kind") == "hit") & (F.col("ordinal") == n)).select("repo_id", "path", "rule_id", "start_line", "end_line", "reason", F.lit("ci-workflow" if d is active.WORKFLOW else None).cast("string").alias("context"))) for n, d in PASS.items()]
    values = found.where("kind = 'value'").select("repo_id", "path", "start_line", "end_line", F.col("reason").alias("method"), "raw", F.col("code").alias("value"))
    lines = lambda kind: found.where((F.col("kind") == "line") & (F.col("ordinal") == kind)).select("repo_id", "path", F.col("start_line").alias("line_no"), F.col("raw").alias("line"))
    return [*hits, (DECODED, active.decoded_findings(values)), (AFTER, _lines(content.long_ones(lines(rules.LONG)), "OBFS-004")), (AFTER + 1, _lines(content.dense_ones(lines(rules.DENSE)), "OBFS-005"))]


def package_hits(text: DataFrame, advisories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits of advisories and of names like known ones, with the words of each."""
    found = manifests.dependencies(text)
    named = supply_chain.package_findings(found, advisories)
    advisory = F.substring("rule_id", 9, 1000)
    exposure = {
        "resolved": ("Resolved lockfile version matches malware advisory ", ""),
        "exact-declared": ("Exact declared version matches malware advisory ", "; no resolved version was established"),
        "range-could-resolve": ("Declared version range could resolve to a version in malware advisory ", ""),
        "declared-outside": ("Declared version is outside the listed affected versions in advisory ", "; verify package identity and resolution"),
        "unknown": ("Package name appears in malware advisory ", "; version exposure is unknown"),
    }
    message = F.coalesce(*[F.when(F.col("exposure") == k, F.concat(F.lit(a), advisory, F.lit(b))) for k, (a, b) in exposure.items()])
    evidence = F.concat_ws(" ", "name", "version")
    hits = named.select("repo_id", "path", "rule_id", "severity", "confidence", "context", message.alias("message"), evidence.alias("evidence"))
    like = supply_chain.typosquats(found, named)
    squats = like.select("repo_id", "path", F.lit("TYPOSQUAT-001").alias("rule_id"), F.concat(F.lit("Dependency resembles "), "target", F.lit(": "), "name").alias("message"), evidence.alias("evidence"))
    return hits, squats


def archive_hits(every: DataFrame) -> DataFrame:
    """Members that would leave the folder an archive is unpacked to."""
    return every.where("member and problem = 'traversal'").select("repo_id", "path", F.lit("ARCHIVE-001").alias("rule_id"), F.lit("unsafe archive path").alias("evidence"))


def hash_hits(every: DataFrame, indicators: DataFrame) -> DataFrame:
    """Files whose bytes an indicator (sha256, family) names."""
    last = indicators.groupBy(F.lower("sha256").alias("sha256")).agg(F.max("family").alias("family"))
    message = F.concat(F.lit("File SHA-256 matches a confirmed "), "family", F.lit(" indicator"))
    return every.where("sha256 is not null").join(last, "sha256").select("repo_id", "path", F.lit("IOC-HASH-SHA256").alias("rule_id"), message.alias("message"), F.concat(F.lit("sha256:"), "sha256").alias("evidence"))


def _lines(df: DataFrame, rule_id: str) -> DataFrame:
    return df.withColumn("rule_id", F.lit(rule_id))


def byte_hits(every: DataFrame) -> list[tuple[int, DataFrame]]:
    """(order, hits) of the detectors that look at bytes: of all files the first four, of binaries all."""
    heads = every.where("readable").select("repo_id", "path", "executable", "link_target", F.col("head").alias("content"))
    binaries = every.where("setting and content is not null").select("repo_id", "path", "content")
    return [(BEFORE + i, h) for i, h in enumerate((packages.binary_findings(heads), packages.font_findings(binaries), active.pdf_findings(binaries)))]


def setting_hits(settings: DataFrame) -> list[tuple[int, DataFrame]]:
    """(order, hits) of the detectors that look at settings, manifests and members of packages (repo_id, path, text)."""
    before = [packages.office_findings(settings), packages.extension_findings(settings)]
    after = [
        packages.hook_findings(settings), supply_chain.npm_scripts(settings), supply_chain.npm_dependency_findings(settings), supply_chain.npm_binaries(settings), supply_chain.npm_overrides(settings),
        supply_chain.pip_sources(settings), supply_chain.cargo_sources(settings), supply_chain.jvm_wrappers(settings), supply_chain.ruby_sources(settings), supply_chain.go_replacements(settings),
        supply_chain.composer_sources(settings), packages.dotnet_findings(settings), packages.yarn_findings(settings), supply_chain.implicit_build_scripts(settings),
    ]
    return [(BEFORE + 3 + i, h) for i, h in enumerate(before)] + [(AFTER + 4 + i, h) for i, h in enumerate(after)]


def _texts(every: DataFrame) -> DataFrame:
    return every.where("text is not null").select("repo_id", "path", "text")


def scan_everything(
    tree: DataFrame,
    advisories: DataFrame | None = None,
    indicators: DataFrame | None = None,
    custom: list[rules.Rule] | None = None,
    repos: DataFrame | None = None,
    max_files: int | None = files.MAX_FILES,
) -> Scan:
    """Scan a tree as ``files.walk_tree`` gives it.  ``advisories`` (ecosystem, name,
    advisory_id, affected) and ``indicators`` (sha256, family) are looked up where given,
    ``custom`` rules stand beside the built-in ones, and ``repos`` (repo_id) may name
    repositories without files.  Of each repository ``max_files`` are scanned, with None
    all.  The tree is read once, and every text in it once more."""
    spark = tree.sparkSession
    rule_list = rules.builtin_rules() + (custom or [])
    every, over = listing(tree, max_files, indicators is not None)
    found = kept(pass_over(_texts(every), rule_list), "found")
    settings = _texts(every.where("setting"))
    hits = pass_hits(found) + byte_hits(every)
    hits += [(BEFORE - 10, archive_hits(every)), (AFTER + 500, hygiene_hits(every.where("not member"), repos)), (AFTER - 10, files.link_findings(every.where("not member")))]
    if indicators is not None:
        hits.append((BEFORE - 5, hash_hits(every, indicators)))
    if not settings.select("path").isEmpty():
        named, like = package_hits(settings, advisories if advisories is not None else spark.createDataFrame([], "ecosystem string, name string, advisory_id string, affected array<string>"))
        hits += [*setting_hits(settings), (BEFORE + 500, named), (BEFORE + 501, like)]
    columns = ["repo_id", "path", "rule_id", "category", "severity", "confidence", "context", "message", "disposition", "start_line", "end_line", "evidence", "occurrences", "emit_seq"]
    of_rules = rules.rule_findings(found, rule_list).select(columns)
    all_hits = kept(reduce(DataFrame.union, [as_hits(h, arrival) for arrival, h in hits]), "hits")
    single = kept(findings.dedup(of_rules.unionByName(raised(all_hits))), "single")
    done = advised(single.unionByName(findings.correlate(single), allowMissingColumns=True))
    gaps = kept(_gaps(every, over, found), "gaps")
    return Scan(done, gaps, verdicts(every if repos is None else repos, done, gaps))


def hygiene_hits(tree: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Repositories without a readme or license."""
    everyone = (tree if repos is None else repos).select("repo_id").distinct()
    return content.hygiene(everyone, tree).withColumn("path", F.lit("."))


def _gaps(every: DataFrame, over: DataFrame, found: DataFrame) -> DataFrame:
    walked = every.where("not member and problem is not null").select("repo_id", "path", F.col("problem").alias("reason"))
    inside = every.where("member and problem is not null").select("repo_id", "path", F.when(F.col("problem") == "traversal", "unsafe archive entry").otherwise(F.concat(F.lit("archive: "), "problem")).alias("reason"))
    bytes_ = every.where("undecodable").select("repo_id", "path", F.lit("undecodable source or configuration").alias("reason"))
    limits = over.select("repo_id", F.lit("").alias("path"), F.lit("file-count limit").alias("reason"))
    fonts = packages.font_gaps(every.where("setting and content is not null"))
    manifest = manifests.unreadable(_texts(every.where("setting")))
    return reduce(DataFrame.union, [walked, inside, bytes_, limits, fonts, manifest, found.where("kind = 'gap'").select("repo_id", "path", "reason")]).distinct()


def scan_gaps(tree: DataFrame, max_files: int | None = files.MAX_FILES) -> DataFrame:
    """(repo_id, path, reason) of everything that was not looked at, in whole or in part."""
    every, over = listing(tree, max_files)
    return _gaps(every, over, kept(pass_over(_texts(every), []), "found"))


def verdicts(repos: DataFrame, found: DataFrame, gaps: DataFrame) -> DataFrame:
    """(repo_id, findings, gaps, complete, verdict) of every repository, also of those without findings."""
    blocking: Column = policy.is_blocking(F.col("severity"), F.col("confidence"), F.col("context"))
    of = found.groupBy("repo_id").agg(F.count("*").alias("findings"), F.bool_or(blocking).alias("blocking"))
    missed = gaps.groupBy("repo_id").agg(F.count("*").alias("gaps"))
    out = repos.select("repo_id").distinct().join(of, "repo_id", "left").join(missed, "repo_id", "left").fillna(0, ["findings", "gaps"]).fillna(False, ["blocking"])
    complete = F.col("gaps") == 0
    return out.select("repo_id", "findings", "gaps", complete.alias("complete"), policy.verdict(F.col("blocking"), F.col("findings"), complete).alias("verdict"))
