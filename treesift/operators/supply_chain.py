"""What manifests and build settings say about where code comes from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.functions.paths import base_name, contains_any, directory, inner_path
from treesift.functions.versions import all_exact, exact_version, is_affected, range_may_include
from treesift.sources.json_tree import nested
from treesift.sources.manifests import npm_alias, sectioned

#: Names that resemble a package, and the package.
TYPO_TARGETS = {
    "lodahs": "lodash", "loadsh": "lodash", "lodsh": "lodash", "lodashs": "lodash",
    "crossenv": "cross-env", "cross-env.js": "cross-env", "cross-environment": "cross-env",
    "expres": "express", "expresss": "express", "express-js": "express",
    "axois": "axios", "axioss": "axios", "axios-js": "axios",
    "web-pack": "webpack", "webpackk": "webpack", "webpck": "webpack",
    "babeljs": "@babel/core", "babel-coree": "@babel/core",
    "type-script": "typescript", "typescriptt": "typescript",
    "momnet": "moment", "momentjs": "moment",
    "chalkk": "chalk", "chalk-js": "chalk",
    "comander": "commander", "commanderr": "commander",
    "es-lint": "eslint", "eslintt": "eslint",
    "eventstream": "event-stream", "event-stream-js": "event-stream",
    "colour": "colors", "colorss": "colors",
    "faker-js": "faker", "facker": "faker",
    "reqeust": "request", "requset": "request", "requsets": "request", "requesrs": "requests",
    "reactt": "react", "react-js": "react", "djago": "django", "flaskk": "flask",
}
#: Scripts that an installation runs, and what a source other than a registry begins with.
INSTALL_HOOKS = ("preinstall", "install", "postinstall", "prepare", "prepublish")
SOURCE_PREFIXES = ("git+", "git:", "github:", "gitlab:", "bitbucket:", "http:", "https:", "file:", "link:")
#: Parts of commands that fetch and that execute.
FETCH = ("curl ", "wget ", "http://", "https://")
EXECUTE = ("| sh", "| bash", "eval", "node -e", "python -c", "powershell")


def _base() -> Column:
    return F.lower(base_name(inner_path(F.col("path"))))


# --- advisories --------------------------------------------------------------------------------


def package_findings(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies that an advisory (ecosystem, name, advisory_id, affected) names.

    An equi-join on the lower-cased names; the planner broadcasts the advisories
    while they are small."""
    right = advisories.select(F.lower("ecosystem").alias("e"), F.lower("name").alias("n"), "advisory_id", "affected")
    met = dependencies.join(right, (F.lower("ecosystem") == F.col("e")) & (F.lower("name") == F.col("n")))
    matched, potential = is_affected(F.col("version"), F.col("affected")), range_may_include(F.col("version"), F.col("affected"))
    outside = ~matched & (exact_version(F.col("version")) != "") & all_exact(F.col("affected"))
    locked = F.col("scope") == "lockfile"
    flags = met.withColumns({"matched": matched, "potential": potential, "outside": outside}).where(~(F.col("outside") & locked))
    sure = F.col("matched") & locked
    exposure = (
        F.when(sure, "resolved")
        .when(F.col("matched"), "exact-declared")
        .when(F.col("potential"), "range-could-resolve")
        .when(F.col("outside"), "declared-outside")
        .otherwise("unknown")
    )
    return flags.select(
        "repo_id", "path", "ecosystem", "name", "version", "scope", F.concat(F.lit("IOC-PKG-"), "advisory_id").alias("rule_id"), exposure.alias("exposure"),
        F.when(sure, "critical").otherwise("high").alias("severity"), F.when(sure, "high").otherwise("medium").alias("confidence"),
        F.when(sure, "confirmed-ioc").otherwise("manifest-review").alias("context"),
    )


def typosquats(dependencies: DataFrame, package_hits: DataFrame) -> DataFrame:
    """Dependencies with a name like a known one's, unless an advisory already names them."""
    targets = F.create_map(*[F.lit(x) for pair in TYPO_TARGETS.items() for x in pair])
    named = dependencies.where(F.col("ecosystem").isin("npm", "pip")).withColumn("target", F.element_at(targets, F.lower("name"))).where("target is not null")
    known = package_hits.select("repo_id", "path", "ecosystem", "name", "version", "scope").distinct()
    return named.join(known, ["repo_id", "path", "ecosystem", "name", "version", "scope"], "left_anti").select("repo_id", "path", "ecosystem", "name", "version", "target")


# --- npm ---------------------------------------------------------------------------------------


def _suspicious(command: Column) -> Column:
    low = F.lower(command)
    return contains_any(low, EXECUTE) & (contains_any(low, FETCH) | low.contains("base64"))


def npm_scripts(files: DataFrame) -> DataFrame:
    """Lifecycle hooks, and other scripts that fetch and execute."""
    scripts = F.from_json(F.get_json_object("text", "$.scripts"), "map<string,string>")
    rows = files.where(_base() == "package.json").select("repo_id", "path", F.explode(scripts).alias("name", "command"))
    hook, bad = F.col("name").isin(*INSTALL_HOOKS), _suspicious(F.col("command"))
    return rows.where(hook | bad).select(
        "repo_id", "path", F.when(hook, "PKG-001").otherwise("PKG-007").alias("rule_id"), "name",
        F.when(hook & bad, "critical").when(hook, "medium").otherwise("high").alias("severity"),
        F.when(hook & bad, "high").otherwise("medium").alias("confidence"),
    )


def non_registry_source(spec: Column) -> Column:
    """What kind of source a specifier names if it is not a registry; else null."""
    low = F.lower(F.trim(spec))
    kind = None
    for prefix in SOURCE_PREFIXES:
        value = prefix.removesuffix(":")
        kind = F.when(low.startswith(prefix), value) if kind is None else kind.when(low.startswith(prefix), value)
    place = F.get(F.split(low, "#", 2), 0)
    return kind.when(place.rlike("^[^/]*/[^/]*$") & ~place.rlike("[ \t:@]"), "github shorthand")


def npm_dependency_findings(files: DataFrame) -> DataFrame:
    """Odd sources, versions and aliases.  A name that several scopes declare counts as the last of them says."""
    scope = lambda n: F.coalesce(F.from_json(F.get_json_object("text", f"$.{n}"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    order = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")

    def over(older: Column, newer: Column) -> Column:
        return F.map_concat(F.map_filter(older, lambda k, v: ~F.map_contains_key(newer, k)), newer)

    merged = reduce(over, map(scope, order))
    rows = files.where(_base() == "package.json").select("repo_id", "path", F.explode(merged).alias("name", "version"))
    target, _ = npm_alias(F.col("version"))
    major = F.regexp_extract(F.regexp_replace(F.trim("version"), "^[~^<>=v ]+", ""), r"^([0-9]+)\.", 1).try_cast("int")
    found = F.array_compact(
        F.array(
            F.when(target.isNotNull() & (target != F.col("name")), "PKG-009"),
            F.when(non_registry_source(F.col("version")).isNotNull(), "PKG-002"),
            F.when(F.col("version").isin("0.0.0", "0.0.1"), "PKG-003"),
            F.when(major >= 90, "PKG-005"),
        )
    )
    return rows.select("repo_id", "path", "name", "version", F.explode(found).alias("rule_id"))


def escapes_package(target: Column) -> Column:
    slashed = F.trim(target)
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda a, p: F.struct((a["now"] + F.when(p == "..", -1).otherwise(1)).alias("now"), F.least(a["least"], a["now"] + F.when(p == "..", -1).otherwise(1)).alias("least")),
        lambda a: a["least"],
    )
    return slashed.startswith("/") | slashed.rlike(r"(?i)^[a-z]:[\\/]") | (depth < 0)


def npm_binaries(files: DataFrame) -> DataFrame:
    """Commands that a package installs, and targets outside it or with behaviour in them."""
    bin_ = F.get_json_object("text", "$.bin")
    some = files.where(_base() == "package.json").withColumn("bin", bin_).where("bin is not null")
    targets = F.when(F.col("bin").startswith("{"), F.map_values(F.from_json("bin", "map<string,string>"))).otherwise(F.array("bin"))
    each = some.select("repo_id", "path", F.explode(targets).alias("target"))
    bad = each.where(escapes_package(F.col("target")) | F.col("target").rlike(r"[;|`]|\$\(|\$\{"))
    return some.select("repo_id", "path", F.lit("PKG-004").alias("rule_id"), F.lit("").alias("target")).union(bad.select("repo_id", "path", F.lit("PKG-006"), "target"))


def npm_overrides(files: DataFrame) -> DataFrame:
    """Overrides that lead a name elsewhere, nested to any depth."""
    text = F.try_parse_json("text")
    some = files.where(_base() == "package.json")
    trees = some.select("repo_id", "path", F.explode(F.array(*[F.try_variant_get(text, q, "variant") for q in ("$.overrides", "$.resolutions", "$.pnpm.overrides")])).alias("tree"))
    leaves = nested(trees).where(F.schema_of_variant("item") == "STRING")
    rows = leaves.select("repo_id", "path", "name", F.try_variant_get("item", "$", "string").alias("value"))
    target, _ = npm_alias(F.col("value"))
    reason = F.when(non_registry_source(F.col("value")).isNotNull(), non_registry_source(F.col("value"))).when(target.isNotNull() & (target != F.col("name")), F.concat(F.lit("identity: "), target))
    return rows.select("repo_id", "path", F.lit("PKG-008").alias("rule_id"), "name", reason.alias("reason")).where("reason is not null")


# --- other ecosystems --------------------------------------------------------------------------


def _default_index(url: Column, host: str, paths: tuple[str, ...]) -> Column:
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.lower(F.try_parse_url(url, F.lit("HOST"))) == host) & F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")).isin(*paths), F.lit(False)) & ~url.rlike("[?#@]")


_PIP_OPTION = r"(?i)^\s*(--extra-index-url|extra-index-url|--index-url|index-url|-i|--find-links|-f)\s*(?:=|\s)\s*([^\s#]+)"


def pip_sources(files: DataFrame) -> DataFrame:
    """Package indexes other than the default, of pip and Pipfiles."""
    some = files.where((_base().startswith("requirements") & _base().endswith(".txt")) | _base().isin("pip.conf", "pip.ini", "pipfile", ".pip.conf"))
    rows = sectioned(some, r"^(\[.*)$", None).where("line <> '' and not line rlike '^[#;]'")
    option, value = F.lower(F.regexp_extract("line", _PIP_OPTION, 1)), F.regexp_replace(F.regexp_extract("line", _PIP_OPTION, 2), "^[\"']+|[\"']+$", "")
    web = F.lower(value).rlike("^https?://")
    pip = rows.where(_base() != "pipfile").withColumns({"option": option, "value": value}).where((F.col("option") != "") & (~F.col("option").isin("--find-links", "-f") | web))
    high = F.col("option").isin("--extra-index-url", "extra-index-url") | F.lower("value").startswith("http://")
    pip = pip.select("repo_id", "path", "line_no", "value", F.when(high, "high").otherwise("medium").alias("severity"))
    assigned = F.regexp_replace(F.regexp_extract("line", r"(?i)^url[^=]*=\s*(.*)$", 1), "^[\"']+|[\"']+$", "")
    pipfile = rows.where((_base() == "pipfile") & (F.lower("section") == "[[source]]") & F.col("line").rlike("(?i)^url[^=]*=")).select("repo_id", "path", "line_no", assigned.alias("value"), F.lit("medium").alias("severity"))
    return pip.union(pipfile).where(~_default_index(F.col("value"), "pypi.org", ("/simple", "/simple/"))).withColumn("rule_id", F.lit("PY-003"))


def cargo_lines(files: DataFrame) -> DataFrame:
    """(…, line_no, section, key, value) of the assignments of Cargo files."""
    rows = sectioned(files, r"^\[+\s*([^\[\]]*?)\s*\]+$", r"#(?=(?:[^\"']*[\"'][^\"']*[\"'])*[^\"']*$).*$", lower=True)
    return rows.where(F.col("head").isNull() & F.col("line").contains("=")).select(
        "repo_id", "path", "line_no", "section", F.lower(F.trim(F.regexp_extract("line", "^([^=]*)=", 1))).alias("key"), F.trim(F.regexp_extract("line", "^[^=]*=(.*)$", 1)).alias("value")
    )


def cargo_sources(files: DataFrame) -> DataFrame:
    """Dependencies from elsewhere, overrides (the first of each kind), and redirected registries."""
    manifests = cargo_lines(files.where(_base() == "cargo.toml"))
    s = F.col("section")
    in_section = s.rlike(r"^(?:dependencies|dev-dependencies|build-dependencies|workspace\.dependencies)$|^(?:dev-|build-)?dependencies\.|\.(?:dev-|build-)?dependencies")
    in_table = s.rlike(r"^(?:dev-|build-)?dependencies\.|\.(?:dev-|build-)?dependencies\.")
    other = in_section & (F.col("value").rlike(r"(?i)\b(?:git|path|registry)\s*=") | (in_table & F.col("key").isin("git", "path", "registry")))
    kind = F.when(s.rlike(r"^patch(?:\.|$)"), "patch").when(s == "replace", "replace")
    sources = manifests.where(other).select("repo_id", "path", F.lit("RUST-005").alias("rule_id"), "line_no")
    overrides = manifests.withColumn("kind", kind).where("kind is not null").groupBy("repo_id", "path", "kind").agg(F.min("line_no").alias("line_no")).select("repo_id", "path", F.lit("RUST-004").alias("rule_id"), "line_no")
    config = cargo_lines(files.where((_base() == "config.toml") & (F.lower(base_name(directory(F.col("path")))) == ".cargo")))
    redirected = (s.startswith("source.") & F.col("key").isin("replace-with", "registry")) | (s.startswith("registries.") & (F.col("key") == "index"))
    return sources.union(overrides).union(config.where(redirected).select("repo_id", "path", F.lit("RUST-003").alias("rule_id"), "line_no"))


def implicit_build_scripts(files: DataFrame) -> DataFrame:
    """build.rs files beside a package manifest that does not name a build script."""
    placed = files.withColumn("dir", directory(F.col("path")))
    manifests = sectioned(placed.where(_base() == "cargo.toml"), r"^\[+\s*([^\[\]]*?)\s*\]+$", r"#.*$")
    package = manifests.groupBy("repo_id", "path").agg(
        F.bool_or(F.coalesce(F.col("head") == "package", F.lit(False))).alias("has"),
        F.bool_or((F.col("section") == "package") & F.col("head").isNull() & F.col("line").rlike(r"^build\s*=")).alias("names"),
    )
    found = package.where("has and not names").select("repo_id", directory(F.col("path")).alias("dir"))
    scripts = placed.where(_base() == "build.rs").select("repo_id", "path", "dir")
    return scripts.join(found, ["repo_id", "dir"]).select("repo_id", "path", F.lit("RUST-002").alias("rule_id"))


def jvm_wrappers(files: DataFrame) -> DataFrame:
    """Wrappers that fetch a build tool from elsewhere, or without a checksum of it."""
    path = F.lower(inner_path(F.col("path")))
    kind = F.when(path.rlike(r"(?:^|/)gradle/wrapper/gradle-wrapper\.properties$"), "gradle").when(path.rlike(r"(?:^|/)\.mvn/wrapper/maven-wrapper\.properties$"), "maven")
    joined = F.regexp_replace("text", r"\\[ \t\r\f]*\n[ \t\f]*", "")
    value = lambda k: F.try_element_at(F.regexp_extract_all(joined, F.lit(rf"(?m)^[ \t\f]*{k}[ \t]*[=:][ \t]*(.*?)[ \t\r]*$"), 1), F.lit(-1))
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\([:=])", "$1"), r"\\\\", r"\\")
    rows = files.withColumn("kind", kind).where("kind is not null").withColumns({"url": plain(value("distributionUrl")), "sha": value("distributionSha256Sum")})
    official = F.when(F.col("kind") == "gradle", F.col("url").rlike(r"(?i)^https://(?:services|downloads)\.gradle\.org(?::443)?/distributions/")).otherwise(
        F.col("url").rlike(r"(?i)^https://(?:repo\.maven\.apache\.org(?::443)?/maven2/|repository\.apache\.org(?::443)?/content/repositories/)")
    )
    missing = F.coalesce(F.trim("sha"), F.lit("")) == ""
    found = F.array_compact(F.array(F.when(~F.coalesce(official, F.lit(False)), "JVMWRAP-001"), F.when(missing, "JVMWRAP-002"), F.when(~missing & ~F.trim("sha").rlike("^[0-9a-fA-F]{64}$"), "JVMWRAP-003")))
    return rows.select("repo_id", "path", F.explode(found).alias("rule_id"))


def ruby_sources(files: DataFrame) -> DataFrame:
    some = files.where((_base() == "gemfile") | F.concat(F.lit("/"), F.lower("path")).endswith("/.bundle/config"))
    lines = some.select("repo_id", "path", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(~F.trim("line").startswith("#"))
    url = F.regexp_extract("line", r"""(?i)^\s*source\s+["']([^"']+)["']""", 1)
    gem = (_base() == "gemfile") & (url != "") & ~_default_index(url, "rubygems.org", ("", "/"))
    mirror = (_base() != "gemfile") & F.upper(F.trim("line")).startswith("BUNDLE_MIRROR__")
    return lines.where(gem | mirror).select("repo_id", "path", F.lit("RUBY-002").alias("rule_id"), (F.col("at") + 1).alias("line_no"))


def go_replacements(files: DataFrame) -> DataFrame:
    """Replacements inside a block; single ones are a rule's."""
    rows = sectioned(files.where(_base().isin("go.mod", "go.work")), r"^((?:[a-z]+ )?[()])$", "//.*$")
    return rows.where((F.col("section") == "replace (") & F.col("head").isNull() & F.col("line").contains("=>")).select("repo_id", "path", F.lit("GO-002").alias("rule_id"), "line_no")


def composer_sources(files: DataFrame) -> DataFrame:
    """Repositories of a Composer project, and plugins that may all run."""
    some = files.where(_base() == "composer.json")
    repos, plugins = F.get_json_object("text", "$.repositories"), F.get_json_object("text", "$.config.allow-plugins")
    found = F.array_compact(F.array(F.when(F.length(F.coalesce(repos, F.lit(""))) > 2, "PHP-002"), F.when((plugins == "true") | (F.from_json(plugins, "map<string,string>")["*"] == "true"), "PHP-003")))
    return some.select("repo_id", "path", F.explode(found).alias("rule_id"))
