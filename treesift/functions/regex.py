"""Patterns in RE2 syntax, rewritten so that Java and Python give RE2's meaning."""

from __future__ import annotations

import re
from re import _parser as parser  # the parse tree of a pattern

_SPACE = r"\t\n\f\r "
_BOUNDARY = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_FLAGS = re.compile(r"\(\?([ims]+)\)")


def _rewrite(pattern: str, java: bool, many_lines: bool = False) -> tuple[str, str]:
    """(flags, body)."""
    flags = ""
    if m := _FLAGS.match(pattern):
        flags, pattern = m[1], pattern[m.end() :]
    out, i, n = [], 0, len(pattern)
    in_class = False
    while i < n:
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            if e == "x" and pattern[i + 2 : i + 3] == "{":
                end = pattern.index("}", i)
                code = int(pattern[i + 3 : end], 16)
                out.append(f"\\x{{{code:X}}}" if java else f"\\U{code:08x}")
                i = end + 1
                continue
            plain = {"b": _BOUNDARY if java else r"\b", "s": f"[{_SPACE}]", "S": f"[^{_SPACE}]", "z": r"\z" if java else r"\Z"}
            inside = {"s": _SPACE, "S": r"\S\x0B"}
            out.append((inside if in_class else plain).get(e, c + e))
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c == "[":
                c = r"\["
            elif c == "&" and pattern[i + 1] == "&":
                c = r"\&"
            out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1] == "]":
                out.append(r"\]")
                i += 1
        elif c == "$" and "m" not in flags and not many_lines:
            out.append(r"\z" if java else r"\Z")
        else:
            out.append(c)
        i += 1
    return flags, "".join(out)


def to_java(pattern: str) -> str:
    """For Spark's rlike and regexp_ functions."""
    flags, body = _rewrite(pattern, java=True)
    return f"(?d{flags}{'u' if 'i' in flags else ''}){body}"


def anywhere(pattern: str) -> str:
    """A Java pattern that meets a text (lines ended by line feeds) wherever ``to_java``'s
    meets one of its lines, and perhaps more: RE2 looks around at no other line than its own."""
    flags, body = _rewrite(pattern.replace("\\z", "$").replace("\\A", "^"), java=True, many_lines=True)
    return f"(?dm{flags}{'u' if 'i' in flags else ''}){body}"


def to_python(pattern: str) -> re.Pattern:
    """For whole-file matches with offsets."""
    flags, body = _rewrite(pattern, java=False)
    bits = re.ASCII
    for f in flags:
        bits |= {"i": re.I, "m": re.M, "s": re.S}[f]
    return re.compile(body, bits)


def spans_lines(pattern: str) -> bool:
    """Whether a match may hold a line feed, so that only a whole-file search finds it."""
    flags, body = _rewrite(pattern, java=False)
    return "s" in flags or r"\n\f\r" in body or "[^" in body


#: Most texts that a part of a pattern is spelt out to.
_SPELLINGS = 24


def needles(pattern: str) -> tuple[str, ...]:
    """Lower-case texts, one of which stands in whatever ``pattern`` meets, compared as
    ``folded`` in functions/text.py has it; none where the pattern asks for no such text.

    They hold neither blanks nor letters beyond ASCII, so that a text with its line ends
    or comments changed holds them only if the text itself does."""
    compiled = to_python(pattern)
    spelt, asked = _spelt(parser.parse(compiled.pattern, compiled.flags))
    best = _better(spelt, asked) or frozenset()
    return tuple(sorted(n for n in best if not any(other in n for other in best - {n})))


def _better(*sets: frozenset[str] | None) -> frozenset[str] | None:
    """The set whose shortest text is the longest, then the smallest set; sets with texts under two characters don't count."""
    usable = [s for s in sets if s and min(map(len, s)) >= 2]
    return max(usable, key=lambda s: (min(min(map(len, s)), 6), -len(s), sorted(s)), default=None)


def _spelt(items) -> tuple[frozenset[str] | None, frozenset[str] | None]:
    """(all texts that a part of a pattern meets, if they are few; texts of which it needs one)."""
    run, best, whole = frozenset({""}), None, True
    for kind, value in items:
        every, asked = _part(str(kind), value)
        if every is not None and len(run) * len(every) <= _SPELLINGS:
            run = frozenset(a + b for a in run for b in every)
            best = _better(best, asked)
            continue
        best, whole = _better(best, run, asked), False
        run = frozenset({""}) if every is None else every
    return (run if whole else None), _better(best, run)


def _part(kind: str, value) -> tuple[frozenset[str] | None, frozenset[str] | None]:
    if kind == "LITERAL":
        return (frozenset({chr(value).lower()}) if 32 < value < 127 else None), None
    if kind == "IN":
        chars = [_part(str(k), v)[0] if str(k) == "LITERAL" else None for k, v in value]
        return (frozenset().union(*chars) if len(chars) <= 4 and None not in chars else None), None
    if kind in ("AT", "ASSERT", "ASSERT_NOT"):
        return frozenset({""}), None
    if kind == "SUBPATTERN":
        return _spelt(value[3])
    if kind == "BRANCH":
        parts = [_spelt(b) for b in value[1]]
        spelt, asked = [e for e, _ in parts], [_better(e, a) for e, a in parts]
        union = frozenset().union(*spelt) if None not in spelt else None
        return (union if union is not None and len(union) <= _SPELLINGS else None), (frozenset().union(*asked) if None not in asked else None)
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, body = value
        every, asked = _spelt(body)
        if (least, most) == (1, 1):
            return every, asked
        if least == 0:
            return (every | {""} if most == 1 and every is not None else None), None
        return None, _better(every, asked)
    return None, None


def glob_to_java(glob: str) -> str:
    """A path glob, where ``*`` and ``?`` stay within a segment, as an anchored pattern."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i:]:
            end = glob.index("]", i + 1)
            out += glob[i : end + 1]
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^(?:{out})$"
