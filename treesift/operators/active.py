"""Active content and data flow inside single files.

Formats that need a parser: each detector takes one file and yields (rule_id,
start_line, end_line, reason).  Spark chooses the files by name and by cheap
substrings first, so only candidates cross into Python, in Arrow batches.
Work is bounded by sizes and counts, never by a clock, so results do not
depend on the machine.  Only data flows have such limits; a file that one of
them leaves out, in whole or in part, is a row of ``skipped_files``."""

from __future__ import annotations

import base64
import binascii
import bisect
import posixpath
import re
import shlex
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from treesift.functions.code_projection import project
from treesift.functions.paths import SCRIPT, applies, contains_any, extension, inner_path
from treesift.functions.regex import to_java
from treesift.operators.js_tables import table_values
from treesift.operators.rules import builtin_rules

Hit = tuple[str, int, int, str]
#: Bytes of a file that flow detectors look at, their hits of one file, bytes between a source and its sink.
MAX_FLOW_SOURCE, MAX_FLOW_HITS, MAX_REACH = 1 << 20, 64, 64 << 10
STAGED_LINES = 40
_HITS = "repo_id string, path string, rule_id string, start_line int, end_line int, reason string"


@dataclass(frozen=True)
class Detector:
    """What looks at one file: ``gate`` chooses files by path and cheap substrings, ``find``
    says (rule_id, start_line, end_line, reason); a file of which a limit leaves something
    out has a hit without rule_id that names the limit."""

    gate: Callable[[], Column]
    find: Callable[[str, str], Iterator[Hit]]
    what: str = ""
    max_bytes: int | None = None
    max_hits: int | None = None

    def hits(self, path: str, text: str) -> Iterator[Hit]:
        if self.max_bytes is not None and len(text.encode()) > self.max_bytes:
            yield None, 0, 0, f"{self.what} source-byte limit"
            return
        for n, hit in enumerate(self.find(path, text)):
            if n == self.max_hits:
                yield None, 0, 0, f"{self.what} finding limit"
                return
            yield hit


def detect(files: DataFrame, detector: Detector) -> DataFrame:
    """(repo_id, path, rule_id, start_line, end_line, reason) of the files (repo_id, path, text) that pass a detector's gate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(repo, path, *hit) for repo, path, text in batch.itertuples(index=False) for hit in detector.hits(path, text)]
            yield pd.DataFrame(rows, columns=["repo_id", "path", "rule_id", "start_line", "end_line", "reason"])

    return files.where(detector.gate() & F.col("text").isNotNull()).select("repo_id", "path", "text").mapInPandas(run, _HITS)


def _ext() -> Column:
    return extension(inner_path(F.col("path")))


def _line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


# --- shell scripts: a download that a later line executes ----------------------------------------

_FETCHERS = ("curl", "wget", "invoke-webrequest", "start-bitstransfer")
_OUTPUT = {"curl": ("-o", "--output"), "wget": ("-O", "--output-document"), "invoke-webrequest": ("-outfile", "-destination"), "start-bitstransfer": ("-outfile", "-destination")}
_RUNNERS = {"sudo", "&", "bash", "sh", "zsh", "python", "python3", "node", "pwsh", "powershell"}


def _segments(line: str) -> list[list[str]]:
    """The commands of a line as words, comments left out."""
    try:
        lexer = shlex.shlex(line, posix=True, punctuation_chars=";&|")
        lexer.whitespace_split = True
        words = list(lexer)
    except ValueError:
        words = line.split()
    out: list[list[str]] = [[]]
    for w in words:
        if w in (";", "&&", "||", ";;"):
            out.append([])
        else:
            out[-1].append(w)
    return [s for s in out if s]


def _command(word: str) -> str:
    return posixpath.basename(word.replace("\\", "/")).lower().removesuffix(".exe")


def _destination(words: list[str]) -> str:
    while words and words[0].lower() in ("sudo", "command", "&"):
        words = words[1:]
    if not words or (command := _command(words[0])) not in _FETCHERS:
        return ""
    for i, w in enumerate(words[1:], 1):
        for flag in _OUTPUT[command]:
            if w == ">" or w == flag or (len(flag) > 2 and w.lower() == flag):
                return words[i + 1] if i + 1 < len(words) else ""
            if w.lower().startswith((f"{flag.lower()}=", f"{flag.lower()}:")) and len(flag) > 2:
                return w[len(flag) + 1 :]
            if len(flag) == 2 and w.startswith(flag) and len(w) > 2 and not w.startswith("--"):
                return w[2:].lstrip("=")
    if command == "wget" or command == "curl" and any(w == "-O" or w.lower() == "--remote-name" for w in words):
        url = next((w for w in words if w.lower().startswith(("http://", "https://"))), "")
        return posixpath.basename(url.split("://", 1)[-1].partition("/")[2].split("?")[0].split("#")[0])
    return ""


def _normal(path: str) -> str:
    return posixpath.normpath(path.replace("\\", "/")).removeprefix("./").lower()


def _runs(words: list[str], destination: str) -> bool:
    if words and words[0].lower() in ("chmod", "icacls"):
        return False
    while words and _command(words[0]) in _RUNNERS | {"start-process"}:
        words = words[1:]
        if words and words[0].lower() == "-filepath":
            words = words[1:]
    return bool(words) and _normal(words[0]) == _normal(destination)


def staged_execution(path: str, text: str) -> Iterator[Hit]:
    lines = [_segments(x) for x in text.split("\n")]
    for i, segments in enumerate(lines):
        destination = next((d for s in segments if (d := _destination(s))), "")
        if not destination:
            continue
        end = next((j for j in range(i, min(i + STAGED_LINES + 1, len(lines))) if any(_runs(s, destination) for s in lines[j])), None)
        if end is not None:
            yield "CHAIN-004", i + 1, end + 1, destination


def _staged_gate() -> Column:
    script = _ext().isin(".sh", ".bash", ".zsh", ".fish", ".ps1", ".bat", ".cmd") | F.col("text").startswith("#!")
    return script & contains_any(F.lower("text"), _FETCHERS)


STAGED = Detector(_staged_gate, staged_execution)


def staged_findings(files: DataFrame) -> DataFrame:
    return detect(files, STAGED)


def _targets(words: list[str]) -> str:
    """What a command executes, as ``_runs`` compares it; empty for none."""
    if words and words[0].lower() in ("chmod", "icacls"):
        return ""
    while words and _command(words[0]) in _RUNNERS | {"start-process"}:
        words = words[1:]
        if words and words[0].lower() == "-filepath":
            words = words[1:]
    return _normal(words[0]) if words else ""


def staged_in_lines(lines: DataFrame, within: int = STAGED_LINES) -> DataFrame:
    """(repo_id, path, start_line, end_line, destination): each line of ``lines`` (repo_id, path,
    line_no, line) that downloads to a place, with the first line up to ``within`` lines on that
    executes it; as ``staged_execution``, for files of any length, as a join.

    Both sides are by file, place and a bin of lines, and a download looks into two bins.
    A bin holds a line once for each place, so no group is larger than a bin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo, path, number, line in batch.itertuples(index=False):
                segments = _segments(line)
                destination = next((d for s in segments if (d := _destination(s))), "")
                if destination:
                    rows.append((repo, path, number, _normal(destination), destination))
                rows += [(repo, path, number, target, None) for target in {_targets(s) for s in segments} - {""}]
            yield pd.DataFrame(rows, columns=["repo_id", "path", "line_no", "place", "destination"])

    said = lines.where("line is not null").select("repo_id", "path", F.col("line_no").cast("int").alias("line_no"), "line").mapInPandas(run, "repo_id string, path string, line_no int, place string, destination string")
    width = within + 1
    bin_of = F.floor(F.col("line_no") / width).cast("int")
    fetched = said.where("destination is not null").select("repo_id", "path", "place", F.col("line_no").alias("start_line"), "destination", F.explode(F.array(bin_of, bin_of + 1)).alias("bin"))
    executed = said.where("destination is null").select("repo_id", "path", "place", F.col("line_no").alias("end_line"), bin_of.alias("bin"))
    near = fetched.join(executed, ["repo_id", "path", "place", "bin"]).where(F.col("end_line").between(F.col("start_line"), F.col("start_line") + within))
    return near.groupBy("repo_id", "path", "start_line", "destination").agg(F.min("end_line").alias("end_line")).select("repo_id", "path", "start_line", "end_line", "destination")


# --- markup: text that is hidden and instructs --------------------------------------------------

#: Instructions to an agent, and elements by how they lay out.
_INSTRUCTION = re.compile(
    r"(?i)((ignore|disregard|override|forget)\s+(all\s+|any\s+|the\s+)?(previous|prior|earlier|above|system)\s+instructions?"
    r"|(?:reveal|show|print|disclose)\s+(your\s+|the\s+)?(system prompt|secrets?|credentials?))"
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_SILENT = frozenset("script style template noscript".split())


def _style(value: str) -> dict[str, str]:
    """Declarations of an inline style; important ones win, later ones over earlier."""
    out: dict[str, tuple[bool, str]] = {}
    for part in re.sub(r"/\*.*?\*/", "", value, flags=re.S).split(";"):
        name, colon, v = part.partition(":")
        v, important = re.subn(r"\s*!\s*important\s*$", "", v.strip().lower())
        if colon and (important or not out.get(name.strip().lower(), (False,))[0]):
            out[name.strip().lower()] = (bool(important), v)
    return {k: v for k, (_, v) in out.items()}


#: Names of colours.
COLOURS = {
    "black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "yellow": "#ffff00", "gray": "#808080", "grey": "#808080", "silver": "#c0c0c0",
    "maroon": "#800000", "purple": "#800080", "fuchsia": "#ff00ff", "lime": "#00ff00", "olive": "#808000", "navy": "#000080", "teal": "#008080", "aqua": "#00ffff",
}
#: What SVG elements may say in attributes as well as in their style.
_PRESENTATION = ("display", "visibility", "opacity", "fill", "stroke", "fill-opacity", "color")


def _none(opacity: str) -> bool:
    """Whether an opacity is zero or less."""
    m = re.match(r"\s*(-?[0-9.]+)", opacity)
    return bool(m) and float(m[1].rstrip(".") or 1) <= 0


def _rgb(value: str | None) -> tuple[int, int, int] | None:
    value = (value or "").strip()
    value = COLOURS.get(value, value)
    if m := re.fullmatch(r"#([0-9a-f]{3}|[0-9a-f]{6})", value):
        h = m[1] if len(m[1]) == 6 else "".join(c * 2 for c in m[1])
        return int(h[:2], 16), int(h[2:4], 16), int(h[4:], 16)
    if m := re.fullmatch(r"rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)", value):
        return int(m[1]), int(m[2]), int(m[3])
    return None


class _Hidden(HTMLParser):
    """Runs of text that cannot be seen, with the line on which each begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict]] = [("", {"gone": "", "visibility": "", "color": None, "background": None, "silent": False, "svg": False, "fill": "", "stroke": "none"})]
        self.runs: list[tuple[int, str, str]] = []
        self.run: list[str] = []
        self.line, self.why = 0, ""

    def close_run(self) -> None:
        if text := " ".join("".join(self.run).split()):
            self.runs.append((self.line, self.why, text))
        self.run = []

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self.close_run()
        if tag in _VOID:
            return
        state = dict(self.stack[-1][1])
        given = dict(attrs)
        style = _style(given.get("style") or "")
        state["svg"] = state["svg"] or tag == "svg"
        if state["svg"]:
            style = {k: given[k].strip().lower() for k in _PRESENTATION if given.get(k)} | style
        display = style.get("display", "")
        if display == "none" or "hidden" in given and not display:
            state["gone"] = "display"
        if _none(style.get("opacity", "")):
            state["gone"] = state["gone"] or "opacity"
        if state["svg"]:  # text is painted by its fill and stroke
            state["fill"] = "none" if _none(style.get("fill-opacity", "")) else style.get("fill", state["fill"])
            state["stroke"] = style.get("stroke", state["stroke"])
        if "visibility" in style:
            state["visibility"] = style["visibility"] if style["visibility"] in ("hidden", "collapse") else ""
        if "color" in style:
            state["color"] = style["color"]
        background = style.get("background-color") or style.get("background")
        if background:
            state["background"] = background
        state["silent"] = state["silent"] or tag in _SILENT
        self.stack.append((tag, state))

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.close_run()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def _reason(self) -> str:
        state = self.stack[-1][1]
        if state["gone"]:
            return state["gone"]
        if state["visibility"]:
            return "visibility"
        if (state["color"] or "").strip() == "transparent":
            return "transparent"
        if state["svg"] and state["fill"].strip() in ("none", "transparent") and state["stroke"].strip() in ("none", "transparent"):
            return "transparent"
        a, b = _rgb(state["color"]), _rgb(state["background"])
        return "same colour" if a and b and all(abs(x - y) <= 1 for x, y in zip(a, b, strict=True)) else ""

    def handle_data(self, data):
        if self.stack[-1][1]["silent"]:
            return
        why = self._reason()
        if not why:
            if data.strip():
                self.close_run()
            return
        if not self.run:
            self.line, self.why = self.getpos()[0], why
        self.run.append(data)


def hidden_instructions(path: str, text: str) -> Iterator[Hit]:
    parser = _Hidden()
    parser.feed(text)
    parser.close()
    parser.close_run()
    for line, why, run in parser.runs:
        if _INSTRUCTION.search(run):
            yield "AGENT-003", line, line, why


def _hidden_gate() -> Column:
    low = F.lower("text")
    marked = contains_any(low, ("display", "opacity", "visibility", "transparent", "hidden", "color", "fill"))
    spoken = contains_any(low, ("ignore", "disregard", "override", "forget", "reveal", "show", "print", "disclose"))
    return _ext().isin(".html", ".htm", ".svg", ".xhtml") & low.rlike(r"style\s*=|hidden|(?:display|visibility|opacity|fill)\s*=") & marked & spoken


HIDDEN = Detector(_hidden_gate, hidden_instructions)


def hidden_findings(files: DataFrame) -> DataFrame:
    return detect(files, HIDDEN)


# --- SVG ----------------------------------------------------------------------------------------


def svg_active(path: str, text: str) -> Iterator[Hit]:
    parser = ElementTree.XMLPullParser(events=("start",))
    root = True
    lines = text.split("\n")
    try:
        for n, line in enumerate(lines, 1):
            parser.feed(line + "\n")
            for _, element in parser.read_events():
                name = element.tag.rpartition("}")[2].lower()
                if root and name != "svg":
                    return
                root = False
                kinds = {k.rpartition("}")[2].lower(): v for k, v in element.attrib.items()}
                if name == "script":
                    yield "IMAGE-001", n, n, "script element"
                elif any(k.startswith("on") and v.strip() for k, v in kinds.items()):
                    yield "IMAGE-001", n, n, "event handler"
                elif re.sub(r"[\x00-\x20]", "", kinds.get("href", "")).lower().startswith("javascript:"):
                    yield "IMAGE-001", n, n, "script link"
    except ElementTree.ParseError:
        return


SVG = Detector(lambda: (_ext() == ".svg") & F.lower("text").rlike(r"<[a-z:]*script|\son[a-z]+\s*=|javascript:"), svg_active)


def svg_findings(files: DataFrame) -> DataFrame:
    return detect(files, SVG)


# --- workflows ----------------------------------------------------------------------------------

_EVENT = re.compile(r"\$\{\{\s*github\.event\.(issue|pull_request|comment|review|discussion)[^}]*\}\}")
_SECRET = re.compile(r"\$\{\{\s*secrets\.[^}]+\}\}")
_OUTBOUND = re.compile(r"(?i)\b(curl|wget|invoke-webrequest)\b")
_EXECUTES = re.compile(r"(?i)^(?:sudo\s+)?(?:bash|sh|zsh|python[0-9.]*|node|npm|npx|yarn|pnpm|make|pwsh|powershell|chmod\s+\+x|\./)")


def _field(node, name):
    import yaml

    if isinstance(node, yaml.MappingNode):
        for key, value in node.value:
            if key.value == name:
                return value
    return None


def _children(node) -> list:
    import yaml

    if isinstance(node, yaml.MappingNode):
        return [x for pair in node.value for x in pair]
    return node.value if isinstance(node, yaml.SequenceNode) else []


def _steps(job) -> list:
    steps = _field(job, "steps")
    return _children(steps) if steps is not None else []


def workflow_risks(path: str, text: str) -> Iterator[Hit]:
    import yaml

    try:
        root = yaml.compose(text, Loader=yaml.SafeLoader)
    except yaml.YAMLError:
        return
    line = lambda node: node.start_mark.line + 1
    pending = [root] if root is not None else []
    while pending:
        node = pending.pop()
        uses = _field(node, "uses")
        if isinstance(uses, yaml.ScalarNode):
            ref = uses.value.strip()
            if not ref.startswith("./") and "@" in ref and not re.fullmatch(r"[^\s@]+@[0-9a-fA-F]{40}", ref):
                yield "CICD-003", line(uses), line(uses), ref
        pending += _children(node)
    jobs = _field(root, "jobs")
    on = _field(root, "on")
    triggers = {on.value} if isinstance(on, yaml.ScalarNode) else {c.value for c in _children(on) if isinstance(c, yaml.ScalarNode)} if on is not None else set()
    all_jobs = [v for _, v in jobs.value] if isinstance(jobs, yaml.MappingNode) else []
    for job in all_jobs:
        for run in (r for s in _steps(job) if (r := _field(s, "run")) is not None):
            if getattr(run, "style", None) not in ("|", ">"):
                continue
            script = "\n".join(x for x in run.value.split("\n") if not x.strip().startswith("#"))
            if _EVENT.search(script):
                yield "CICD-002", line(run), line(run), "event text in a run block"
            if _SECRET.search(script) and _OUTBOUND.search(script):
                yield "CICD-004", line(run), line(run), "secret in an outbound command"
    if triggers & {"pull_request_target", "issue_comment", "workflow_run"}:
        seen = set()
        for job in all_jobs:
            mode = _field(job, "cache-mode") or _field(root, "cache-mode")
            if isinstance(mode, yaml.ScalarNode) and mode.value.strip().lower() in ("write", "write-only") and line(mode) not in seen:
                seen.add(line(mode))
                yield "CICD-007", line(mode), line(mode), mode.value
    if "workflow_run" in triggers:
        for job in all_jobs:
            downloaded = False
            for step in _steps(job):
                uses, run_id, run = _field(step, "uses"), _field(_field(step, "with"), "run-id"), _field(step, "run")
                if uses is not None and uses.value.strip().lower().startswith("actions/download-artifact@") and run_id is not None and "github.event.workflow_run.id" in run_id.value:
                    downloaded = True
                if downloaded and run is not None and any(_EXECUTES.match(x.strip()) for x in run.value.split("\n") if not x.strip().startswith("#")):
                    yield "CICD-006", line(run), line(run), "artifact, then a command"
    if "pull_request" in triggers:
        for job in all_jobs:
            runner = _field(job, "runs-on")
            names = [runner, *_children(runner)] if runner is not None else []
            if any(isinstance(n, yaml.ScalarNode) and n.value.strip().lower() == "self-hosted" for n in names):
                yield "CICD-008", line(runner), line(runner), "self-hosted"


WORKFLOW = Detector(lambda: F.concat(F.lit("/"), F.lower(inner_path(F.col("path")))).contains("/.github/workflows/"), workflow_risks)


def workflow_findings(files: DataFrame) -> DataFrame:
    return detect(files, WORKFLOW)


# --- JavaScript ---------------------------------------------------------------------------------

#: Fixed value: bytes of a file whose literals are decoded.
MAX_DECODE_SOURCE = 2 << 20
#: The rules that decoded text is held against.
DECODED_RULES = ("CRED-", "REVSHELL-", "PERSIST-", "SECRET-", "EXFIL-002", "IPURL-001")
_ESCAPES = r"""\\(?:[nrtbf\\'"/]|x[0-9A-Fa-f]{2}|u(?![dD][89A-Fa-f])[0-9A-Fa-f]{4})"""
_STRING = rf"""'(?:[^\\'\n\r]|{_ESCAPES})*+'|"(?:[^\\"\n\r]|{_ESCAPES})*+\""""
_ONE_STRING = re.compile(_STRING)
#: Comments and templates, which hold no literals, and strings with the strings joined to them.
_JS_STRING = re.compile(rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|`(?:\\[\s\S]|[^`\\])*+(?:`|\\?\Z)|(?P<strings>(?:{_STRING})(?:[ \t\r\n]*\+[ \t\r\n]*(?:{_STRING}))*)")
_JS_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|(.))", re.S)
_JS_CODES = re.compile(r"\bString\.fromCharCode\s*\(([^()]+)\)|\b(?:new\s+)?Uint8Array\s*\(\s*\[([^\]]+)\]\s*\)", re.A)
_JS_CODES_START = re.compile(r"\bString\.fromCharCode\s*\(", re.A)
#: Text that executes, which the rules for decoded text leave out.
_DECODED = r"(?i)\beval\s*\(|\bnew\s+Function\s*\(|child_process|\bexecSync\b|(?:curl|wget)[^\n|;]{0,200}\|\s*(?:sh|bash|zsh|node|python[0-9.]*)\b|/dev/tcp/|powershell"
_SIMPLE = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
Decoded = tuple[int, int, str, str, str]


def _unescape(value: str) -> str:
    return _JS_ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SIMPLE.get(m[3], m[3]), value)


def _code(item: str) -> int:
    """A number of one byte as JavaScript or Go writes it; ValueError for anything else."""
    item = item.strip()
    value = int(item, 8) if re.fullmatch("0[0-7]+", item) else int(item, 0)
    if not item[:1].isdigit() or value > 255:
        raise ValueError(item)
    return value


def js_decoded(path: str, text: str) -> tuple[list[Decoded], bool]:
    """(start_line, end_line, method, raw, value) of literals that only say what they do
    once escapes, joins, base64, hexadecimal, or arrays of codes are undone; and
    whether there are arrays of codes that are no literals."""
    ends = [m.start() for m in re.finditer("\n", text)]
    out: list[Decoded] = []

    def add(m: re.Match, method: str, raw: str, value: str) -> None:
        if value:
            out.append((bisect.bisect_left(ends, m.start()) + 1, bisect.bisect_left(ends, m.end()) + 1, method, raw, value))

    for m in _JS_STRING.finditer(text):
        if m["strings"] is None:
            continue
        literals = [x[0][1:-1] for x in _ONE_STRING.finditer(m[0])]
        raw = "".join(literals)
        value = _unescape(raw)
        if len(literals) > 1 or "\\" in raw:
            add(m, "literal concatenation" if len(literals) > 1 else "JavaScript escape", raw, value)
        if len(value) >= 32:
            plain = value.replace("\r", "").replace("\n", "")
            if re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", plain) and len(plain) % 4 == 0:
                try:
                    add(m, "Base64 literal", raw, base64.b64decode(plain, validate=True).decode("utf-8"))
                except (binascii.Error, UnicodeDecodeError):
                    pass
            if re.fullmatch(r"(?:[0-9A-Fa-f]{2})+", value):
                try:
                    add(m, "hex literal", raw, bytes.fromhex(value).decode("utf-8"))
                except UnicodeDecodeError:
                    pass
    unsupported = False
    if "fromCharCode" in text or "Uint8Array" in text:
        # blanks stand for bytes, so places are those of bytes
        data, code = text.encode().decode("latin-1"), (project(text, ".js") or "").encode().decode("latin-1")
        ends = [m.start() for m in re.finditer("\n", data)]
        for m in _JS_CODES.finditer(data):
            if code[m.start()] != data[m.start()]:
                continue
            items = (m[1] or m[2]).split(",")
            if not items[-1].strip():  # a comma at the end
                items.pop()
            try:
                add(m, "literal character/byte array", m[0], bytes(_code(x) for x in items).decode("utf-8"))
            except UnicodeDecodeError:
                pass
            except ValueError:
                unsupported = True
        unsupported |= any(not _JS_CODES.match(data, m.start()) for m in _JS_CODES_START.finditer(code))
    return out, unsupported


_AXIOS = r"\baxios(?:\s*\.\s*(?:get|post|put|patch|delete|request|head))?\s*\("
_AWAITED = re.compile(r"\b(?:const|let|var)\s+(\{[^}]*\bdata\b[^}]*\}|[A-Za-z_$][\w$]*)\s*=\s*(?:\(\s*)?await\s+" + _AXIOS)
_CHAINED = re.compile(_AXIOS)
_CALLBACK = re.compile(r"\.\s*(?:then|catch)\s*\(\s*(?:async\s*)?(?:function\s*\w*\s*\(\s*([A-Za-z_$][\w$]*)|\(?\s*([A-Za-z_$][\w$]*)\s*\)?\s*=>)")
_SINK = r"(?<![.\w$])(?:eval|new\s+Function|Function|(?:vm\s*\.\s*)?runIn(?:NewContext|ThisContext))\s*\(\s*"


def _scope_end(code: str, at: int) -> int:
    """Where the innermost open brace around ``at`` closes."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if depth < 0:
            return m.start()
    return len(code)


def js_flow(path: str, text: str) -> Iterator[Hit]:
    """A response of an HTTP client that a later call in its scope executes."""
    code = project(text, ".js") or ""
    found: list[Hit] = []

    def follow(name: str, start: int, end: int, source: int) -> None:
        body = code[start : min(end, start + MAX_REACH)]
        names = {name}
        for a in re.finditer(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*([A-Za-z_$][\w$]*)\s*(?:\.\s*data\b[\w$.\s]*)?;", body):
            if a[2] in names and len(names) < 8:
                names.add(a[1])
        for n in names:
            for s in re.finditer(_SINK + re.escape(n) + r"\b(?:\s*\.\s*data\b)?", body):
                found.append(("FLOW-001", source, _line_of(text, start + s.start()), n))

    for m in _AWAITED.finditer(code):
        name = "data" if m[1].startswith("{") else m[1]
        follow(name, m.end(), _scope_end(code, m.end()), _line_of(text, m.start()))
    for m in _CHAINED.finditer(code):
        statement = code[m.end() : m.end() + MAX_REACH]
        stop = statement.find(";\n")
        c = _CALLBACK.search(statement, 0, len(statement) if stop < 0 else stop)
        if c and not re.search(r"\n\s*\n", statement[: c.start()]):
            at = m.end() + c.end()
            follow(c[1] or c[2], at, min(_scope_end(code, code.find("{", at) + 1) if "{" in code[at : at + 8] else at + 400, len(code)), _line_of(text, m.start()))
    yield from sorted(set(found), key=lambda h: (h[2], h[1]))


def _script() -> Column:
    return _ext().isin(*SCRIPT)


def _js_gate() -> Column:
    return _script() & F.col("text").contains("axios") & contains_any(F.col("text"), ("eval", "Function", "runIn"))


JS_FLOW = Detector(_js_gate, js_flow, "JavaScript flow", MAX_FLOW_SOURCE, MAX_FLOW_HITS)


def decodes() -> Column:
    """Files that may hold literals worth decoding."""
    return _script() & F.col("text").rlike(r"\\|[A-Za-z0-9+/]{30}|[\"']\s*\+\s*[\"']|fromCharCode|Uint8Array|\[\s*[\"']")


def js_literals(path: str, text: str) -> list[tuple[int, int, str, str | None, str | None]]:
    """(start_line, end_line, method, raw, value) of decoded literals; one without value names
    what was not decoded as its method."""
    if len(text.encode()) > MAX_DECODE_SOURCE:
        return [(0, 0, "JavaScript decoder source-byte limit", None, None)]
    found, unsupported = js_decoded(path, text)
    tables, more = table_values(text)
    reasons = dict.fromkeys(x for x in ("unsupported JavaScript literal expression" if unsupported else "", more) if x)
    return [*found, *tables, *((0, 0, x, None, None) for x in reasons)]


def js_values(files: DataFrame) -> DataFrame:
    """(repo_id, path, start_line, end_line, method, raw, value) of ``js_literals`` of all files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(repo, path, *x) for repo, path, text in batch.itertuples(index=False) for x in js_literals(path, text)]
            yield pd.DataFrame(rows, columns=["repo_id", "path", "start_line", "end_line", "method", "raw", "value"])

    return files.where(decodes()).select("repo_id", "path", "text").mapInPandas(run, "repo_id string, path string, start_line int, end_line int, method string, raw string, value string")


def js_decoded_findings(files: DataFrame) -> DataFrame:
    """DECODE-001 of the literals of ``files`` (repo_id, path, text)."""
    return decoded_findings(js_values(files))


def decoded_findings(values: DataFrame) -> DataFrame:
    """DECODE-001 for each decoded value (as of ``js_values``) and rule that it meets, with the rule's
    severity and its id as ``contributing``; and, without one, for each literal that hides text that executes."""
    met = [
        F.when(applies(F.col("path"), r.globs) & F.col("value").rlike(to_java(r.pattern)), F.struct(F.lit(r.id).alias("contributing"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message")))
        for r in builtin_rules()
        if r.id.startswith(DECODED_RULES)
    ]
    executes = F.col("value").rlike(to_java(_DECODED)) & ~F.col("raw").rlike(to_java(_DECODED))
    own = F.when(executes, F.struct(F.lit(None).cast("string").alias("contributing"), F.lit("high").alias("severity"), F.lit("text that executes").alias("message")))
    hits = values.where("value is not null").select("*", F.inline(F.array_compact(F.array(*met, own))))
    return hits.select("repo_id", "path", F.lit("DECODE-001").alias("rule_id"), "start_line", "end_line", F.concat(F.lit("Static "), F.col("method"), F.lit(" reveals "), F.col("message")).alias("reason"), "severity", "contributing")


def js_findings(files: DataFrame) -> DataFrame:
    return detect(files, JS_FLOW).where("rule_id is not null").unionByName(js_decoded_findings(files), allowMissingColumns=True)


# --- Python -------------------------------------------------------------------------------------

_CALL = r"(?:(?:requests|httpx)\.(?:get|post|request|put|patch|delete|head)|(?:urllib\.request\.)?urlopen)\s*\("
_PY_SOURCE = re.compile(r"^" + _CALL)
_READ = r"(?:\s*\.\s*(?:text|content|read\s*\(\s*\)|decode\s*\([^()]*\)))*"
_PY_VALUE = re.compile(r"^([A-Za-z_]\w*)" + _READ + r"\s*$")
_PY_SINK = re.compile(r"(?<![.\w])(exec|eval|compile)\s*\(\s*(?:compile\s*\(\s*)?([A-Za-z_]\w*" + _READ + r")\s*(?:[,)]|$)")
_PY_INLINE = re.compile(r"(?<![.\w])(exec|eval|compile)\s*\(\s*" + _CALL + r"[^()]*\)\s*\.\s*(?:text|content|read\s*\(\s*\))\s*(?:[,)]|$)")
_PY_SCOPE = re.compile(r"^(?:async\s+)?(?:def|class)\b")
_PY_BRANCH = re.compile(r"^(?:if|elif|else|for|while|try|except|finally|with|match|case|async\s+(?:for|with))\b")
_PY_ASSIGN = re.compile(r"^([A-Za-z_]\w*)\s*(?::[^=]+)?([-+*/%&|^@]?|//|\*\*|<<|>>)=(?!=)\s*(.*)$")


def py_flow(path: str, text: str) -> Iterator[Hit]:
    """A response that straight-line assignments carry to a call that executes it."""
    stack: list[tuple[int, dict[str, int], list[int]]] = [(-1, {}, [])]
    for number, code in enumerate((project(text, ".py") or "").split("\n"), 1):
        line = code.lstrip(" \t").rstrip()
        if not line:
            continue
        indent = len(code) - len(code.lstrip(" \t"))
        while len(stack) > 1 and indent <= stack[-1][0]:
            stack.pop()
        if _PY_SCOPE.match(line):
            stack.append((indent, {}, []))
            continue
        _, values, branches = stack[-1]
        while branches and indent <= branches[-1]:
            branches.pop()
            values.clear()
        if _PY_BRANCH.match(line):
            values.clear()
            branches.append(indent)
            continue
        for s in _PY_SINK.finditer(line):
            v = _PY_VALUE.match(s[2])
            if v and v[1] in values:
                yield "FLOW-002", values[v[1]], number, s[1]
        for s in _PY_INLINE.finditer(line):
            yield "FLOW-002", number, number, s[1]
        if m := _PY_ASSIGN.match(line):
            v = _PY_VALUE.match(m[3])
            source = number if not m[2] and _PY_SOURCE.match(m[3]) else values.get(v[1], 0) if v and not m[2] else 0
            values.pop(m[1], None)
            if source:
                values[m[1]] = source
        elif d := re.match(r"^del\s+(\w+)", line):
            values.pop(d[1], None)


def _py_gate() -> Column:
    text = F.col("text")
    return _ext().isin(".py", ".pyw") & contains_any(text, ("requests", "httpx", "urlopen")) & contains_any(text, ("exec", "eval", "compile"))


PY_FLOW = Detector(_py_gate, py_flow, "Python flow", MAX_FLOW_SOURCE, MAX_FLOW_HITS)


def py_findings(files: DataFrame) -> DataFrame:
    return detect(files, PY_FLOW).where("rule_id is not null")


def skipped_files(files: DataFrame) -> DataFrame:
    """(repo_id, path, reason) of every file that a limit of a detector leaves out, in whole or in part."""
    flows = detect(files, JS_FLOW).union(detect(files, PY_FLOW)).where("rule_id is null").select("repo_id", "path", "reason")
    return flows.union(js_values(files).where("value is null").select("repo_id", "path", F.col("method").alias("reason")))


# --- documents ----------------------------------------------------------------------------------

_PDF = {"JavaScript": rb"/(?:JS|JavaScript)\b", "automatic action": rb"/(?:OpenAction|AA)\b", "launch": rb"/Launch\b", "embedded file": rb"/EmbeddedFiles?\b", "rich media": rb"/RichMedia\b", "form submission": rb"/SubmitForm\b"}


def pdf_labels(data: bytes) -> list[str]:
    """What a PDF does by itself; names are decoded, streams, strings and comments left out."""
    data = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data)
    data = re.sub(rb"stream\r?\n.*?endstream", b" ", data, flags=re.S)
    data = re.sub(rb"\((?:\\.|[^()\\])*\)|%[^\r\n]*", b" ", data, flags=re.S)
    return sorted(k for k, p in _PDF.items() if re.search(p, data))


@F.pandas_udf(ArrayType(StringType()))
def _pdf(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: pdf_labels(bytes(c)))


def pdf_findings(files: DataFrame) -> DataFrame:
    """DOC-001 of files with binary content."""
    some = files.where((_ext() == ".pdf") & (F.hex(F.substring("content", 1, 4)) == "25504446")).select("repo_id", "path", _pdf("content").alias("labels"))
    return some.where(F.size("labels") > 0).select("repo_id", "path", F.lit("DOC-001").alias("rule_id"), F.array_join("labels", ", ").alias("reason"))


__all__ = ["detect", "hidden_findings", "js_findings", "pdf_findings", "py_findings", "skipped_files", "staged_findings", "svg_findings", "workflow_findings"]
