"""Constant string tables of JavaScript, and what is looked up in them.

A small abstract interpreter over a file's tokens.  Its state is which names stand
for arrays of literal strings.  A lookup by a literal number has a value while
its table is constant: a change of the table anywhere in the file, by a method,
by an element, by another assignment or through another name, takes the table
away, and a rotation (an element pushed that was shifted off) takes all.  What was
taken away is told, as its values are not known.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

#: Characters from a table to a lookup in it, with no brace between them; methods that change a table.
REACH = 1024
CHANGES = frozenset(("push", "shift", "pop", "unshift", "reverse", "splice", "sort"))
METHOD = "string-table lookup"
ROTATED, UNSUPPORTED, TWICE = "dynamic string-table rotation", "unsupported JavaScript literal expression", "unsupported duplicate literal table identifier"

_TOKEN = re.compile(
    r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|`(?:\\[\s\S]|[^`\\])*+(?:`|\\?\Z)"""
    r"""|(?P<string>'(?:[^\\'\n]|\\[\s\S])*+'|"(?:[^\\"\n]|\\[\s\S])*+")|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>0[xX][0-9A-Fa-f]+|[0-9]+(?![\w.]))|(?P<other>[-+*/%&|^<>!=]=+|=>|\+\+|--|[^\s\w])"""
)
_ROTATION = re.compile(r"""\[\s*['"]push['"]\s*\]\s*\([^\n]{0,128}\[\s*['"]shift['"]\s*\]\s*\(|\.\s*push\s*\([^\n]{0,128}\.\s*shift\s*\(""")
_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|([\s\S]))")
_SHORT = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


@dataclass
class _Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class _Table:
    values: list[str]
    places: list[int]
    end: int


def _tokens(text: str) -> Iterator[_Token]:
    for m in _TOKEN.finditer(text):
        if m.lastgroup:
            yield _Token(m.lastgroup, m[0], m.start(), m.end())


def _plain(literal: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SHORT.get(m[3], m[3]), literal[1:-1])


def _table_at(tokens: list[_Token], i: int) -> tuple[_Table, int] | None:
    """The table that opens with the bracket ``tokens[i]``, and the token after it."""
    values, places, j = [], [], i + 1
    while j + 1 < len(tokens) and tokens[j].kind == "string":
        values.append(_plain(tokens[j].text))
        places.append(tokens[j].start)
        j += 1
        if tokens[j].text == ",":
            j += 1
    if not values or j >= len(tokens) or tokens[j].text != "]":
        return None
    after = tokens[j + 1].text if j + 1 < len(tokens) else ";"
    return None if after in (".", "[", "(", "+") else (_Table(values, places, tokens[j].end), j + 1)


def _changed(tokens: list[_Token], i: int) -> bool:
    """Whether what is done with the table named by ``tokens[i]`` may change it."""
    text = lambda k: tokens[k].text if 0 <= k < len(tokens) else ""
    if text(i + 1) == "." and text(i + 2) in CHANGES and text(i + 3) == "(":
        return True
    if text(i + 1) == "[":
        depth, j = 1, i + 2
        while j < len(tokens) and depth:
            depth += {"[": 1, "]": -1}.get(text(j), 0)
            j += 1
        assigns = text(j).endswith("=") and text(j) not in ("==", "===", "!=", "!==", "<=", ">=") or text(j) in ("++", "--")
        return assigns or text(i - 1) in ("++", "--", "delete") or text(i + 2)[1:-1] in CHANGES and text(j) == "("
    if text(i + 1).endswith("=") and text(i + 1) not in ("==", "===", "!=", "!=="):
        return True
    return text(i - 1) == "=" and text(i + 1) in (";", ",", "", ")") or text(i - 1) == "=" and tokens[i + 1].kind == "name"  # another name for it


def table_values(text: str) -> tuple[list[tuple[int, int, str, str, str]], str]:
    """(start_line, end_line, method, raw, value) of lookups in constant tables, joined where
    they are added up; and why some tables have no values, or an empty string."""
    if "[" not in text:
        return [], ""
    tokens = list(_tokens(text))
    declared: dict[int, tuple[str, _Table, int]] = {}
    gone: set[str] = set()
    trouble = ""
    names: set[str] = set()
    for i in range(len(tokens) - 3):
        if tokens[i].text in ("const", "let", "var") and tokens[i + 1].kind == "name" and tokens[i + 2].text == "=" and tokens[i + 3].text == "[" and (found := _table_at(tokens, i + 3)):
            name = tokens[i + 1].text
            if name in names:
                gone.add(name)
                trouble = TWICE
            names.add(name)
            declared[i + 1] = (name, *found)
    if not names:
        return [], ""
    if _ROTATION.search(text):
        return [], ROTATED
    for i, t in enumerate(tokens):
        if t.kind == "name" and t.text in names and i not in declared and (i == 0 or tokens[i - 1].text != ".") and _changed(tokens, i):
            gone.add(t.text)
            trouble = trouble or UNSUPPORTED
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect.bisect_left(ends, at) + 1
    out: list[tuple[int, int, str, str, str]] = []
    seen: dict[str, _Table] = {}

    def lookup(i: int) -> tuple[str, int] | None:
        """(value, place of its item) of ``name[number]`` at token ``i``."""
        if i + 3 >= len(tokens) or tokens[i].kind != "name" or tokens[i + 1].text != "[" or tokens[i + 2].kind != "number" or tokens[i + 3].text != "]":
            return None
        table, at = seen.get(tokens[i].text), int(tokens[i + 2].text, 0) if tokens[i + 2].text[:2] in ("0x", "0X") else int(tokens[i + 2].text)
        if table is None or at >= len(table.values) or tokens[i].start - table.end > REACH or i and tokens[i - 1].text == ".":
            return None
        return table.values[at], table.places[at]

    i = 0
    while i < len(tokens):
        if tokens[i].text in ("{", "}"):
            seen = {}
        elif i in declared:
            name, table, i = declared[i]
            if name not in gone:
                seen[name] = table
            continue
        elif first := lookup(i):
            parts, start = [first], i
            i += 4
            while i < len(tokens) and tokens[i].text == "+" and (more := lookup(i + 1)):
                parts.append(more)
                i += 5
            begin, end = tokens[start].start, tokens[i - 1].end
            origins = ", ".join(str(line(place)) for _, place in parts)
            out.append((line(begin), line(end), f"{METHOD} (items on lines {origins})", text[begin:end], "".join(v for v, _ in parts)))
            continue
        i += 1
    return out, trouble
