"""Dependencies that manifests declare, read with the built-in parsers.

Every reader takes files (repo_id, path, text) and gives (repo_id, path,
ecosystem, name, version, scope, alias).  Line-oriented formats become rows of
lines with the section carried forward inside the file's own array, so state
never crosses rows and nothing is shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.functions.paths import base_name, inner_path
from treesift.sources.json_tree import entries_below, is_json

_OUT = ("repo_id", "path", "ecosystem", "name", "version", "scope", "alias")


def _base() -> Column:
    return base_name(inner_path(F.col("path")))


def _rows(df: DataFrame, ecosystem: str, name: Column, version: Column, scope: Column, alias: Column | None = None) -> DataFrame:
    alias = F.lit("") if alias is None else alias
    return df.select("repo_id", "path", F.lit(ecosystem).alias("ecosystem"), name.alias("name"), F.coalesce(version, F.lit("")).alias("version"), scope.alias("scope"), alias.alias("alias"))


def npm_alias(spec: Column) -> tuple[Column, Column]:
    """(name, version) of ``npm:name@version``; the name is null for anything else."""
    value = F.regexp_extract(spec, "^npm:(.+)$", 1)
    scoped = value.rlike("^.+@")
    name = F.when(scoped, F.regexp_extract(value, "^(.+)@[^@]*$", 1)).otherwise(value)
    good = spec.startswith("npm:") & (name != "") & ~name.rlike(r"[ \t\r\n]")
    return F.when(good, name), F.when(good & scoped, F.regexp_extract(value, "@([^@]*)$", 1)).otherwise("")


def _json_maps(files: DataFrame, ecosystem: str, scopes: tuple[str, ...]) -> DataFrame:
    """Each scope is read by itself, so one that is no map of strings is skipped alone."""
    parts = [files.select("repo_id", "path", F.lit(s).alias("scope"), F.explode(F.from_json(F.get_json_object("text", f"$['{s}']"), "map<string,string>")).alias("name", "version")) for s in scopes]
    return reduce(DataFrame.unionByName, parts).withColumn("ecosystem", F.lit(ecosystem))


def npm(files: DataFrame) -> DataFrame:
    found = _json_maps(files.where(_base() == "package.json"), "npm", ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies"))
    target, version = npm_alias(F.col("version"))
    plain = _rows(found, "npm", F.col("name"), F.col("version"), F.col("scope"))
    aliased = found.withColumns({"target": target, "target_version": version}).where("target is not null and target <> name")
    return plain.unionByName(_rows(aliased, "npm", F.col("target"), F.col("target_version"), F.concat("scope", F.lit(":alias-target")), F.col("name")))


def composer(files: DataFrame) -> DataFrame:
    found = _json_maps(files.where(_base() == "composer.json"), "composer", ("require", "require-dev"))
    return _rows(found, "composer", F.col("name"), F.col("version"), F.col("scope"))


_LOCKS = ("package-lock.json", "npm-shrinkwrap.json")


def npm_lock(files: DataFrame) -> DataFrame:
    """Lockfiles: a flat map of packages, or else the nested tree of the older form, to any depth, from one read of each text."""
    locks = files.where(_base().isin(*_LOCKS)).withColumn("packages", F.from_json(F.get_json_object("text", "$.packages"), "map<string,struct<version:string>>"))
    flat = F.transform(F.map_entries("packages"), lambda e: F.struct(F.regexp_extract(e["key"], r"^(?:.*node_modules/)(.+)$", 1).alias("name"), e["value"]["version"].alias("value")))
    is_tree = F.coalesce(F.size("packages"), F.lit(0)) <= 0
    trees = locks.withColumn("tree", F.when(is_tree, F.try_variant_get(F.try_parse_json("text"), "$.dependencies", "variant")))
    entries = F.when(is_tree, entries_below(F.col("tree"), F.col("text"), "$.dependencies", "$.version")).otherwise(F.filter(flat, lambda e: e["name"] != ""))
    # outer, as the planner else asks for the size of the array first and so makes it twice
    found = trees.select("repo_id", "path", F.inline_outer(entries)).where(F.coalesce("value", F.lit("")) != "")
    return _rows(found, "npm", F.col("name"), F.col("value"), F.lit("lockfile"))


def unreadable(files: DataFrame) -> DataFrame:
    """(repo_id, path, reason) of manifests in JSON that are none, or too deeply nested for Spark's parser."""
    json = files.where(_base().isin(*_LOCKS, "package.json", "composer.json"))
    return json.where(~is_json(F.col("text"))).select("repo_id", "path", F.lit("unreadable JSON manifest").alias("reason"))


def sectioned(files: DataFrame, header: str, comment: str | None, lower: bool = False) -> DataFrame:
    """(repo_id, path, line_no, line, raw, section): lines with the section that they stand in.

    ``header`` is a pattern whose group is the section's name; ``comment`` cuts a
    line.  The section is carried along in the file's array of lines."""
    clean = lambda x: F.trim(F.regexp_replace(x, comment, "") if comment else x)
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.regexp_replace(clean(x), r"^\s+|\s+$", "").alias("line"), x.alias("raw")))
    name = lambda x: F.lower(F.regexp_extract(x, header, 1)) if lower else F.regexp_extract(x, header, 1)
    heads = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), x["line"].alias("line"), x["raw"].alias("raw"), F.when(x["line"].rlike(header), name(x["line"])).alias("head")))
    with_heads = files.select("repo_id", "path", heads.alias("lines")).withColumn("heads", F.filter("lines", lambda x: x["head"].isNotNull()))
    rows = with_heads.select("repo_id", "path", "heads", F.explode("lines").alias("l"))
    before = F.filter("heads", lambda h: h["line_no"] <= F.col("l.line_no"))
    return rows.select("repo_id", "path", "l.*", F.coalesce(F.get(before, F.size(before) - 1)["head"], F.lit("")).alias("section"))


_TOML = r"^\[+([^\[\]]*)\]+$"
#: Assignments, requirements and calls that declare a dependency.
_QUOTED = r"""^\s*["']?([^"'\s=]+)["']?\s*=\s*["']([^"']+)["']"""
_INLINE = r"""^\s*["']?([^"'\s=]+)["']?\s*=\s*\{[^}]*version\s*=\s*["']([^"']+)["']"""
_REQUIREMENT = r"^\s*([A-Za-z0-9_.-]+)\s*(===|==|~=|>=|<=|!=|>|<)?\s*([^;#\s]+)?"
_GEM = r"""(?m)^\s*gem\s+["']([^"']+)["'](?:\s*,\s*["']([^"']+)["'])?"""
_LIST = r"(?s)dependencies\s*=\s*\[(.*?)\]"


def _toml(files: DataFrame, ecosystem: str, sections: tuple[str, ...]) -> DataFrame:
    rows = sectioned(files, _TOML, "#.*$").where(F.col("head").isNull() & F.col("section").isin(*sections))
    pick = lambda i: F.when(F.col("line").rlike(_QUOTED), F.regexp_extract("line", _QUOTED, i)).when(F.col("line").rlike(_INLINE), F.regexp_extract("line", _INLINE, i))
    return _rows(rows.where(F.col("line").rlike(_QUOTED) | F.col("line").rlike(_INLINE)), ecosystem, pick(1), pick(2), F.col("section"))


def cargo(files: DataFrame) -> DataFrame:
    return _toml(files.where(_base() == "Cargo.toml"), "rust", ("dependencies", "dev-dependencies", "build-dependencies"))


def _requirement_rows(df: DataFrame, line: Column, scope: str) -> DataFrame:
    trimmed = F.regexp_replace(line, r"^\s+|\s+$", "")
    kept = df.withColumn("line", trimmed).where((F.col("line") != "") & ~F.col("line").rlike("^[#-]") & F.col("line").rlike(_REQUIREMENT))
    version = F.concat(F.regexp_extract("line", _REQUIREMENT, 2), F.regexp_extract("line", _REQUIREMENT, 3))
    return _rows(kept, "pip", F.regexp_extract("line", _REQUIREMENT, 1), version, F.lit(scope))


def requirements(files: DataFrame) -> DataFrame:
    some = files.where(_base().startswith("requirements") & _base().endswith(".txt"))
    return _requirement_rows(some.select("repo_id", "path", F.explode(F.split("text", "\n")).alias("line")), F.col("line"), "requirement")


def pyproject(files: DataFrame) -> DataFrame:
    some = files.where(_base() == "pyproject.toml")
    lists = F.regexp_extract_all("text", F.lit(_LIST), 1)
    quoted = F.regexp_extract_all("body", F.lit(r"""["']([^"']+)["']"""), 1)
    listed = some.select("repo_id", "path", F.explode(lists).alias("body")).select("repo_id", "path", F.explode(quoted).alias("line"))
    tables = _toml(some, "pip", ("tool.poetry.dependencies", "tool.poetry.dev-dependencies", "tool.pdm.dependencies"))
    return tables.unionByName(_requirement_rows(listed, F.col("line"), "project.dependencies"))


def gemfile(files: DataFrame) -> DataFrame:
    calls = files.where(_base() == "Gemfile").select("repo_id", "path", F.explode(F.regexp_extract_all("text", F.lit(_GEM), 0)).alias("call"))
    return _rows(calls, "rubygems", F.regexp_extract("call", _GEM, 1), F.regexp_extract("call", _GEM, 2), F.lit("gem"))


def go_mod(files: DataFrame) -> DataFrame:
    """Single requirements and blocks of them."""
    rows = sectioned(files.where(_base() == "go.mod"), r"^((?:[a-z]+ )?[()])$", "//.*$")
    single = F.col("line").startswith("require ") & (F.col("line") != "require (")
    inside = (F.col("section") == "require (") & F.col("head").isNull()
    fields = F.filter(F.split(F.when(single, F.regexp_replace("line", "^require ", "")).otherwise(F.col("line")), r"\s+"), lambda x: x != "")
    kept = rows.where(single | inside).withColumn("fields", fields).where(F.size("fields") >= 2)
    return _rows(kept, "go", F.get("fields", 0), F.get("fields", 1), F.lit("require"))


def _xml_rows(files: DataFrame, pattern: str) -> DataFrame:
    return files.select("repo_id", "path", F.explode(F.regexp_extract_all(F.regexp_replace("text", r"(?s)<!--.*?-->", ""), F.lit(pattern), 0)).alias("node"))


def nuget(files: DataFrame) -> DataFrame:
    """Packages of .NET projects; attributes in their order of preference."""
    some = files.where(_base().isin("packages.config", "Directory.Packages.props") | _base().rlike(r"\.(?:cs|fs|vb)proj$"))
    nodes = _xml_rows(some, r"<(?:package|PackageReference|PackageVersion)\b[^>]*>")
    attribute = lambda n: F.nullif(F.regexp_extract("node", rf"""\s{n}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    rows = nodes.withColumns({"name": F.coalesce(attribute("id"), attribute("Include"), attribute("Update")), "version": F.coalesce(attribute("version"), attribute("Version"), F.lit(""))})
    return _rows(rows.where("name is not null"), "nuget", F.col("name"), F.col("version"), F.lit("package"))


def maven(files: DataFrame) -> DataFrame:
    """The project's own dependencies, not those that it manages for others."""
    some = files.where(_base() == "pom.xml").withColumn("text", F.regexp_replace("text", r"(?s)<(dependencyManagement|build|profiles)>.*?</\1>", ""))
    nodes = _xml_rows(some, r"(?s)<dependency>.*?</dependency>")
    child = lambda n: F.trim(F.regexp_extract("node", rf"(?s)<{n}>\s*(.*?)\s*</{n}>", 1))
    rows = nodes.withColumns({"g": child("groupId"), "a": child("artifactId"), "v": child("version"), "s": child("scope")}).where("g <> '' and a <> ''")
    return _rows(rows, "maven", F.concat_ws(":", "g", "a"), F.col("v"), F.col("s"))


READERS = (npm, npm_lock, composer, cargo, requirements, pyproject, gemfile, go_mod, nuget, maven)


def dependencies(files: DataFrame) -> DataFrame:
    """All dependencies of all manifests among ``files``."""
    return reduce(DataFrame.unionByName, (r(files) for r in READERS))


def with_lines(found: DataFrame, files: DataFrame) -> DataFrame:
    """``found`` with the first line of its file that names the dependency."""
    name = F.coalesce(F.nullif(F.col("alias"), F.lit("")), F.col("name"))
    edge = F.lit("(?<![A-Za-z0-9_.@/-])"), F.lit("(?![A-Za-z0-9_.@/-])")
    joined = found.join(files.select("repo_id", "path", F.split("text", "\n").alias("lines")), ["repo_id", "path"])
    pattern = F.concat(edge[0], F.lit("\\Q"), name, F.lit("\\E"), edge[1])
    at = F.array_position(F.transform("lines", lambda x: F.regexp_like(x, pattern)), True)
    return joined.withColumn("line", F.nullif(at, F.lit(0)).cast("int")).drop("lines")
