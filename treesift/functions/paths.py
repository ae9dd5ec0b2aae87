"""Paths, and the context that a path gives to what is found under it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesift.functions.regex import glob_to_java

#: Extensions by the lexical family of their languages.
C_LIKE = (".c", ".cc", ".cpp", ".cxx", ".h", ".hpp", ".cs", ".go", ".java", ".js", ".jsx", ".kt", ".kts", ".mjs", ".cjs", ".rs", ".swift", ".ts", ".tsx")
HASH_COMMENTS = (".py", ".pyw", ".rb", ".sh", ".bash", ".zsh", ".ps1", ".toml", ".yaml", ".yml")
SCRIPT = (".js", ".cjs", ".mjs", ".jsx", ".ts", ".tsx")
#: Folders that are not walked unless asked for.
PRUNED = (
    "node_modules", ".venv", "venv", ".tox", "vendor", "target", ".gradle", ".m2", "__pycache__", ".convex", ".expo", ".next", ".turbo", "Pods", "DerivedData",
)


def inner_path(path: Column) -> Column:
    """The path inside the innermost archive."""
    return F.element_at(F.split(path, "!"), -1)


def outer_path(path: Column) -> Column:
    return F.when(path.contains("!"), F.regexp_replace(path, "![^!]*$", ""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    """From the last dot of the base name on, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(base_name(path), r"\.[^.]*$", 0))


def walk_key(path: Column) -> Column:
    """Sorts as a walk visits: by path segments, not by the path as a string."""
    return F.split(path, "/")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(column: Column, needles) -> Column:
    return _any([column.contains(n) for n in needles])


def applies(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether a rule's globs include a path: by base name, or by the whole inner path."""
    if not globs:
        return F.lit(True)
    inner = F.lower(inner_path(path))
    base = base_name(inner)
    tests = []
    for g in (g.lower() for g in globs):
        tests += [base.rlike(glob_to_java(g))]
        if "/" in g:
            tests += [inner.rlike(glob_to_java(g))]
        if g.startswith("**/"):
            tests += [base.rlike(glob_to_java(g[3:]))]
    return _any(tests)


def is_agent_instruction(slashed: Column, base: Column) -> Column:
    ext = F.regexp_extract(base, r"\.[^.]*$", 0)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    return (
        base.isin(".cursorrules", ".clinerules", ".windsurfrules", "copilot-instructions.md", "skill.md")
        | slashed.contains("/.cursor/rules/")
        | (slashed.contains("/.github/instructions/") & base.endswith(".instructions.md"))
        | (stem.isin("agents", "claude", "gemini") & ext.isin(".md", ".mdc", ".markdown", ".mdx", ".txt", ".yaml", ".yml", ".json", ".toml"))
    )


def looks_like_signature(line: Column) -> Column:
    """A line that defines a detection rather than being one."""
    l = F.trim(line)  # noqa: E741
    return (
        l.startswith("#")
        | contains_any(l, (r"\s", r"\(", r"[^\n]", "Pattern:", "needle := range []string{", "regexp.MustCompile(", ".finding("))
        | (l.contains("string(data[:") & contains_any(l, (r"\x7fELF", r"\xcf\xfa\xed\xfe")))
        | ((F.length(l) - F.length(F.replace(l, F.lit("|"), F.lit(""))) >= 4) & contains_any(l, ("curl", "eval")))
        | (l.startswith("{") & l.contains("ID:") & l.contains("Category:"))
    )


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def classify_context(path: Column, line: Column | None = None) -> Column:
    """An ordered decision: the first that fits counts.  Folders are sought in the
    whole path, names and extensions in the part inside the innermost archive."""
    inner = F.lower(inner_path(path))
    parts = F.struct(
        F.concat(F.lit("/"), F.regexp_replace(F.lower(path), "^/", "")).alias("slashed"), base_name(inner).alias("base"), extension(inner).alias("ext"), (F.lit("") if line is None else line).alias("line")
    )
    return once(parts, lambda p: _context(p["slashed"], p["base"], p["ext"], p["line"]))


def _context(slashed: Column, base: Column, ext: Column, line: Column) -> Column:
    any_of = lambda *n: contains_any(slashed, n)
    return (
        F.when(any_of("/.local-evidence/", "/evidence/"), "evidence")
        .when(any_of("/testdata/", "/fixtures/", "/fixture/", "/__tests__/", "/snapshots/") | base.endswith("_test.go") | contains_any(base, (".test.", ".spec.")), "test-fixture")
        .when(
            any_of("/_generated/", "/generated/", "/build/generated/", "/autolinking/") | (ext == ".pbxproj") | contains_any(base, (".generated.", "_generated.")) | base.endswith(".gen.go") | base.endswith(".g.cs"),
            "generated",
        )
        .when(
            any_of("/dist/", "/build/", "/charting_library/bundles/") | base.endswith(".min.js") | base.endswith(".bundle.js") | base.endswith(".min.css")
            | ((base == "sw.js") & slashed.contains("/public/") & (F.octet_length(line) > 600)),
            "generated",
        )
        .when(any_of("/node_modules/", "/vendor/", "/pods/", "/.venv/"), "dependency")
        .when(is_agent_instruction(slashed, base), "agent-instruction")
        .when(any_of("/examples/", "/example/", "/samples/"), "example")
        .when(any_of("/.github/workflows/"), "ci-workflow")
        .when(any_of("/.git/hooks/"), "git-hook")
        .when(ext.isin(".md", ".markdown", ".rst", ".adoc", ".txt"), "documentation")
        .when(base.isin("package.json", "pyproject.toml", "setup.py", "composer.json", "cargo.toml", "pom.xml") | base.startswith("build.gradle"), "manifest")
        .when((base.endswith("_signatures.sh") | base.isin("scanner.go", "rules.go")) & looks_like_signature(line), "detection-definition")
        .otherwise("executable")
    )


def is_comment_line(path: Column, line: Column) -> Column:
    """A line that is surely a comment in its language."""
    trimmed, ext = F.regexp_replace(line, r"^\s+", ""), extension(inner_path(path))
    slashes = ext.isin(*[e for e in C_LIKE if e not in (".cxx",)])
    return F.when(slashes, trimmed.startswith("//") | trimmed.startswith("/*") | trimmed.startswith("*")).when(ext.isin(*HASH_COMMENTS), trimmed.startswith("#")).otherwise(F.lit(False))


def match_context(category: Column, path: Column, line: Column) -> Column:
    """The context of a match on a line: comments only show, but for some categories."""
    context = classify_context(path, line)
    context = F.when((category == "prompt-injection") & (context == "executable") & (extension(inner_path(path)) == ".mdx"), "documentation").otherwise(context)
    stays = category.isin("secret", "known-malicious-file", "known-malicious-package", "social-engineering", "agent-execution", "prompt-injection")
    return F.when(is_comment_line(path, line) & ~stays, "example").otherwise(context)


def unsafe_archive_path(path: Column) -> Column:
    """Absolute, with a drive letter, or climbing out of the archive."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    step = lambda p: F.when(p == "..", -1).otherwise(1)
    walk = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda a, p: F.struct((a["depth"] + step(p)).alias("depth"), F.least(a["least"], a["depth"] + step(p)).alias("least")),
        lambda a: a["least"],
    )
    return slashed.startswith("/") | slashed.rlike("^[A-Za-z]:") | (walk < 0)


def is_pruned(path: Column, include_dependencies: bool = False) -> Column:
    """Under a folder that is not walked."""
    if include_dependencies:
        return F.lit(False)
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*map(F.lit, PRUNED)))
