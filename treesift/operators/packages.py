"""Files that are more than text: binaries, hooks, packages of office suites and
editors, fonts, and build settings of .NET and Yarn.

Members of packages come from ``sources.archives.expand`` as files with paths
``outer!inner``, so what is said about a package is a filter over its members."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from treesift.functions.paths import base_name, contains_any, extension, inner_path, outer_path
from treesift.functions.text import executable_magic
from treesift.operators.active import Detector, detect, svg_active
from treesift.operators.supply_chain import escapes_package

#: Packages of office suites, what a hook should not do, fonts.
OFFICE = (".docx", ".docm", ".dotx", ".dotm", ".xlsx", ".xlsm", ".xltx", ".xltm", ".pptx", ".pptm", ".potx", ".potm", ".ppsx", ".ppsm")
SUSPICIOUS_HOOK = ("curl ", "wget ", "eval ", "node -e", "python -c", "bash -c", "powershell", "/dev/tcp/", "base64 -d")
#: Fixed value: bytes that the drawings of a font's glyphs may unpack to.
MAX_GLYPH_BYTES = 8 << 20
#: Beside the rules: a font of which the drawings were not looked at.
LIMIT = "limit"
FONTS = (".ttf", ".otf", ".ttc", ".woff", ".woff2")
CONTRIBUTIONS = ("commands", "debuggers", "taskDefinitions", "terminalProfiles", "customEditors", "authentication", "notebooks", "notebookRenderer", "views")


def _rows(files: DataFrame, found: Column, *more: str) -> DataFrame:
    return files.select("repo_id", "path", *more, F.explode(F.array_compact(found)).alias("rule_id"))


def binary_findings(tree: DataFrame) -> DataFrame:
    """Compiled content, else the executable bit; packaged editor extensions."""
    compiled = executable_magic(F.col("content"))
    found = F.array(
        F.when(extension(inner_path(F.col("path"))) == ".vsix", "IDE-007"), F.when(compiled, "BINARY-001").when(F.col("executable"), "EXECBIT-001")
    )
    return _rows(tree.where("link_target is null"), found)


def hook_findings(files: DataFrame) -> DataFrame:
    """Git hooks in use that fetch or execute."""
    hook = F.concat(F.lit("/"), "path").contains("/.git/hooks/") & ~F.lower("path").endswith(".sample")
    return files.where(hook & contains_any(F.lower("text"), SUSPICIOUS_HOOK)).select("repo_id", "path", F.lit("GITHOOK-002").alias("rule_id"))


def office_findings(members: DataFrame) -> DataFrame:
    """Macros, content from elsewhere and data exchange fields, from members as text
    (repo_id, path, text).  A field's instruction may be cut over several runs; runs of
    different fields, between which a field begins, has its result or ends, are kept apart."""
    some = members.where(F.col("path").contains("!") & extension(outer_path(F.col("path"))).isin(*OFFICE))
    inner = F.lower(inner_path(F.col("path")))
    relations = F.regexp_extract_all("text", F.lit(r"(?is)<(?:\w+:)?Relationship\b[^>]*>"), 0)
    external = F.exists(relations, lambda r: r.rlike(r"""(?i)\sTargetMode\s*=\s*["']\s*External\s*["']"""))
    vba = F.exists(relations, lambda r: r.rlike(r"""(?i)relationships/vbaProject["']"""))
    pieces = F.split("text", r"(?i)<(?:\w+:)?(?:fldChar|fldSimple|p)\b|</(?:\w+:)?(?:fldSimple|p)\s*>")
    runs = F.transform(pieces, lambda x: F.array_join(F.regexp_extract_all(x, F.lit(r"(?is)<(?:\w+:)?instrText\b[^>]*>([^<]*)<"), 1), ""))
    simple = F.regexp_extract_all("text", F.lit(r"""(?is)<(?:\w+:)?fldSimple\b[^>]*\binstr\s*=\s*(?:"([^"]*)"|'([^']*)')"""), 1)
    dde = F.exists(F.concat(runs, simple), lambda x: x.rlike(r"(?i)(?:^|\s)DDE(?:AUTO)?\s"))
    found = F.array(F.when((base_name(inner) == "vbaproject.bin") | vba, "DOC-002"), F.when(inner.endswith(".rels") & external, "DOC-003"), F.when(inner.endswith(".xml") & dde, "DOC-004"))
    return _rows(some, found)


def extension_findings(members: DataFrame) -> DataFrame:
    """What a packaged editor extension can start, and what its installation runs."""
    some = members.where((extension(outer_path(F.col("path"))) == ".vsix") & (F.lower(inner_path(F.col("path"))) == "extension/package.json"))
    value = lambda q: F.get_json_object("text", q)
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    capability = F.coalesce(
        F.when(value("$.activationEvents").isNotNull(), "activationEvents"), F.when(filled(value("$.main")), "main"), F.when(filled(value("$.browser")), "browser"),
        *[F.when(value(f"$.contributes.{c}").isNotNull(), f"contributes.{c}") for c in CONTRIBUTIONS],
    )
    script = F.coalesce(*[F.when(filled(value(f"$.scripts.{n}")), F.concat(F.lit(f"{n}: "), value(f"$.scripts.{n}"))) for n in ("preinstall", "install", "postinstall")])
    rows = some.withColumns({"capability": capability, "script": script})
    return rows.select(
        "repo_id", "path", F.explode(F.array_compact(F.array(
            F.when(F.col("capability").isNotNull(), F.struct(F.lit("IDE-008").alias("rule_id"), F.col("capability").alias("reason"))),
            F.when(F.col("script").isNotNull(), F.struct(F.lit("IDE-009").alias("rule_id"), F.col("script").alias("reason"))),
        ))).alias("f"),
    ).select("repo_id", "path", "f.*")


def _elements(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(event, name, attributes) of an XML text, names in lower case without namespaces; ends
    with ParseError where the text is no XML any more."""
    parser = ElementTree.XMLPullParser(events=("start", "end"))
    local = lambda name: name.rpartition("}")[2].lower()
    try:
        for at in range(0, len(text), 1 << 16):
            parser.feed(text[at : at + (1 << 16)])
            for event, element in parser.read_events():
                yield event, local(element.tag), {local(k): v for k, v in element.attrib.items()}
        parser.close()
    except ElementTree.ParseError:
        for event, element in parser.read_events():
            yield event, local(element.tag), {local(k): v for k, v in element.attrib.items()}
        raise


def _first_line(text: str, *values: str) -> int:
    """The first line in which the first of the values stands that stands anywhere."""
    return next((text.count("\n", 0, at) + 1 for v in values if v and (at := text.find(v)) >= 0), 1)


def project_commands(path: str, text: str) -> Iterator[tuple[str, int, int, str]]:
    """Commands that a .NET project runs, up to where it is no XML any more."""
    root = True
    try:
        for event, name, attributes in _elements(text):
            if event == "start":
                if root and name != "project":
                    return
                root = False
                if name == "exec" and attributes.get("command", "").strip():
                    line = _first_line(text, attributes["command"], "Exec")
                    yield "DOTNET-001", line, line, "high"
    except ElementTree.ParseError:
        return


def _default_nuget(value: str) -> bool:
    return re.fullmatch(r"https://api\.nuget\.org(?::443)?/v3/index\.json", value) is not None


def nuget_sources(path: str, text: str) -> Iterator[tuple[str, int, int, str]]:
    """Package sources other than the default; one that may give any package, or has no secure address, weighs more."""
    stack, sources, wild, mapped = [], [], set(), ""
    try:
        for event, name, attributes in _elements(text):
            if event == "end":
                stack.pop()
                continue
            parent = stack[-1] if stack else ""
            if not stack and name != "configuration":
                return
            if (parent, name) == ("packagesources", "add"):
                sources.append((attributes.get("key", ""), attributes.get("value", "")))
            elif (parent, name) == ("packagesourcemapping", "packagesource"):
                mapped = attributes.get("key", "").lower()
            elif (parent, name) == ("packagesource", "package") and attributes.get("pattern") == "*":
                wild.add(mapped)
            stack.append(name)
    except ElementTree.ParseError:
        return
    for key, value in sources:
        if value and not _default_nuget(value):
            line = _first_line(text, value, key)
            yield "NUGET-001", line, line, "high" if key.lower() in wild or value.lower().startswith("http://") else "medium"


def _base_name() -> Column:
    return F.lower(base_name(inner_path(F.col("path"))))


PROJECT = Detector(lambda: _base_name().rlike(r"\.(?:csproj|fsproj|vbproj|props|targets|proj)$"), project_commands)
NUGET = Detector(lambda: _base_name() == "nuget.config", nuget_sources)


def dotnet_findings(files: DataFrame) -> DataFrame:
    """Commands that a project runs, and package sources other than the default."""
    found = detect(files, PROJECT).unionByName(detect(files, NUGET))
    return found.select("repo_id", "path", "rule_id", "start_line", F.col("reason").alias("severity"))


def yarn_runtime(path: str, text: str) -> Iterator[tuple[str, int, int, str]]:
    """The Yarn executable and the plugins with a path; nothing of a file that is no YAML of this shape."""
    import yaml

    try:
        root = yaml.compose(text, Loader=yaml.SafeLoader)
    except yaml.YAMLError:
        return
    pairs = lambda node: {k.value: (k, v) for k, v in node.value if isinstance(k, yaml.ScalarNode)} if isinstance(node, yaml.MappingNode) else {}
    top = pairs(root)
    key, chosen = top.get("yarnPath", (None, None))
    _, plugins = top.get("plugins", (None, None))
    listed = plugins.value if isinstance(plugins, yaml.SequenceNode) else []
    if chosen is not None and not isinstance(chosen, yaml.ScalarNode) or plugins is not None and (not isinstance(plugins, yaml.SequenceNode) or any(not isinstance(x, yaml.MappingNode) for x in listed)):
        return
    if chosen is not None and chosen.value:
        line = key.start_mark.line + 1
        yield "YARN-001", line, line, chosen.value
    for plugin in listed:
        _, value = pairs(plugin).get("path", (None, None))
        if isinstance(value, yaml.ScalarNode) and value.value:
            line = value.start_mark.line + 1
            yield "YARN-002", line, line, value.value


YARN = Detector(lambda: _base_name() == ".yarnrc.yml", yarn_runtime)


def yarn_findings(files: DataFrame) -> DataFrame:
    """The Yarn executable and plugins that a project selects."""
    value = F.col("reason")
    outside = escapes_package(value) | value.contains("://")
    return detect(files, YARN).select("repo_id", "path", "rule_id", F.col("start_line").alias("line_no"), F.when(outside, "high").otherwise("medium").alias("severity"))


def _glyph_documents(table: bytes) -> list[str]:
    """The drawings of a font's glyphs, unpacked up to a limit in all."""
    (at,) = struct.unpack(">I", table[2:6])
    (count,) = struct.unpack(">H", table[at : at + 2])
    out, left = [], MAX_GLYPH_BYTES
    for i in range(count):
        offset, length = struct.unpack(">II", table[at + 2 + 12 * i + 4 : at + 2 + 12 * i + 12])
        data = table[at + offset : at + offset + length]
        if len(data) < length:
            raise ValueError("a drawing lies outside its table")
        if data[:2] == b"\x1f\x8b":
            data = zlib.decompressobj(31).decompress(data, left + 1)
        left -= len(data)
        if left < 0:
            raise OverflowError("drawings are too large")
        out.append(data.decode("utf-8", "replace"))
    return out


def font_rules(suffix: str, data: bytes) -> list[str]:
    """The rules of ``_font_rules`` alone."""
    return [r for r in _font_rules(suffix, data) if r != LIMIT]


def _font_rules(suffix: str, data: bytes) -> list[str]:
    """Rules that a font file meets: always the inventory; then what is wrong with its
    table directory, or else whether its glyphs' drawings act and whether it carries
    instructions."""
    out = ["FONT-002"]
    if suffix not in (".ttf", ".otf"):
        magic = {".ttc": (b"ttcf",), ".woff": (b"wOFF",), ".woff2": (b"wOF2",)}[suffix]
        return out if data[:4] in magic else [*out, "FONT-003"]
    bad = [*out, "FONT-003"]
    if len(data) < 12 or data[:4] not in (b"\0\1\0\0", b"OTTO", b"true", b"typ1"):
        return bad
    (count,) = struct.unpack(">H", data[4:6])
    end = 12 + 16 * count
    if not 0 < count <= 4096 or end > len(data):
        return bad
    tables: dict[bytes, tuple[int, int]] = {}
    for i in range(count):
        tag, _, offset, length = struct.unpack(">4sIII", data[12 + 16 * i : 28 + 16 * i])
        if tag in tables or offset % 4 or offset + length > len(data) or length and offset < end:
            return bad
        tables[tag] = (offset, length)
    spans = sorted(s for s in tables.values() if s[1])
    if any(a + n > b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)):
        return bad
    head = data[tables[b"head"][0] :][: tables[b"head"][1]] if b"head" in tables else None
    if head is not None and (len(head) < 54 or head[12:16] != b"\x5f\x0f\x3c\xf5" or not 16 <= struct.unpack(">H", head[18:20])[0] <= 16384 or struct.unpack(">h", head[50:52])[0] not in (0, 1)):
        return bad
    maxp = data[tables[b"maxp"][0] :][: tables[b"maxp"][1]] if b"maxp" in tables else None
    if maxp is not None and (len(maxp) < 6 or maxp[4:6] == b"\0\0"):
        return bad
    if b"SVG " in tables:
        offset, length = tables[b"SVG "]
        try:
            drawings = _glyph_documents(data[offset : offset + length])
        except OverflowError:
            return [*bad, LIMIT]
        except (struct.error, ValueError, zlib.error):
            return bad
        if any(True for x in drawings for _ in svg_active("glyph.svg", x)):
            out.append("FONT-004")
    return [*out, "FONT-005"] if b"fpgm" in tables or b"prep" in tables else out


@F.pandas_udf(ArrayType(StringType()))
def _font(suffixes: pd.Series, contents: pd.Series) -> pd.Series:
    return pd.Series([_font_rules(s, bytes(c)) for s, c in zip(suffixes, contents, strict=True)], dtype=object)


def _fonts(tree: DataFrame) -> DataFrame:
    suffix = extension(inner_path(F.col("path")))
    return tree.where(suffix.isin(*FONTS)).select("repo_id", "path", F.explode(_font(suffix, "content")).alias("rule_id"))


def font_findings(tree: DataFrame) -> DataFrame:
    return _fonts(tree).where(F.col("rule_id") != LIMIT)


def font_gaps(tree: DataFrame) -> DataFrame:
    """(repo_id, path, reason) of fonts whose drawings are too large to be looked at."""
    return _fonts(tree).where(F.col("rule_id") == LIMIT).select("repo_id", "path", F.lit("font drawing limit").alias("reason"))
