"""Source text with comments and the insides of strings blanked, byte for byte.

The one scalar of the rule engine that built-in functions cannot express: a
lexer with states.  It runs as an Arrow-batched UDF over whole files, once a
file and only for languages that it knows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from treesift.functions.paths import C_LIKE, HASH_COMMENTS

#: What can change the state, by family; everything between is passed over at once.
_CODE = {
    "c": re.compile(rb"//|/\*|['\"`{}]"),
    "hash": re.compile(rb"#|['\"]"),
    "python": re.compile(rb"#|'''|\"\"\"|['\"]"),
}
_IN_QUOTE = {q: re.compile(rb"\\[^\n]|\n|" + re.escape(q)) for q in (b"'", b'"')}
_IN_TEMPLATE = re.compile(rb"\\[^\n]|\$\{|`")


def _blank(data: bytes) -> bytes:
    return re.sub(rb"[^\n]", b" ", data)


def _family(extension: str) -> str | None:
    if extension in (".py", ".pyw"):
        return "python"
    return "c" if extension in C_LIKE else "hash" if extension in HASH_COMMENTS else None


def project(text: str | None, extension: str | None) -> str | None:
    """``text`` with definite comments and string contents as blanks of as many bytes."""
    family = _family(extension or "")
    if text is None or family is None:
        return text
    data, out, at, depth = text.encode(), [], 0, 0
    n = len(data)

    def string_end(start: int, quote: bytes) -> int:
        """Just after the closing quote, or at the line feed that ends an open string."""
        i = start
        while m := _IN_QUOTE[quote].search(data, i):
            if m[0] == quote:
                return m.end()
            if m[0] == b"\n":
                return m.start()
            i = m.end()
        return n

    def template_end(start: int) -> tuple[int, bool]:
        """(end, whether an expression opens there)."""
        i = start
        while m := _IN_TEMPLATE.search(data, i):
            if m[0] == b"`":
                return m.end(), False
            if m[0] == b"${":
                return m.end(), True
            i = m.end()
        return n, False

    while at < n:
        m = _CODE[family].search(data, at)
        if not m:
            out.append(data[at:])
            break
        out.append(data[at : m.start()])
        token, start, end = m[0], m.start(), m.end()
        if token in (b"{", b"}"):
            closes = token == b"}" and depth == 1  # the expression of a template ends
            if depth:
                depth += 1 if token == b"{" else -1
            if closes:
                end, opens = template_end(end)
                depth = int(opens)
                out.append(_blank(data[start:end]))
            else:
                out.append(token)
        else:
            if token in (b"//", b"#"):
                line = data.find(b"\n", end)
                end = line if line >= 0 else n
            elif token == b"/*":
                close = data.find(b"*/", end)
                end = close + 2 if close >= 0 else n
            elif token in (b"'''", b'"""'):
                close = data.find(token, end)
                end = close + 3 if close >= 0 else n
            elif token == b"`":
                end, opens = template_end(end)
                depth = 1 if opens else depth
            else:
                end = string_end(end, token)
            out.append(_blank(data[start:end]))
        at = end
    return b"".join(out).decode("utf-8", "replace")


@F.pandas_udf(StringType())
def code_projection(text: pd.Series, extension: pd.Series) -> pd.Series:
    return pd.Series([project(t, e) for t, e in zip(text, extension, strict=True)], dtype=object)
