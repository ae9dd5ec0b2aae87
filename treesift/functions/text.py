"""Lines, evidence and entropy as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from treesift.functions.paths import base_name, classify_context, contains_any, inner_path
from treesift.functions.regex import to_java

#: Calls beside which dense text is suspicious.
DANGEROUS = ("eval(", "exec(", "execsync(", "spawn(", "b64decode", "fromcharcode", "runinnewcontext")
#: Credentials in evidence.
ASSIGNMENT = r"""(?i)\b(token|password|secret|api[_-]?key|access[_-]?token|client[_-]?secret)\b\s*[=:]\s*(?:"(?:\\.|[^"])*"|'(?:\\.|[^'])*'|[^\s,;]+)"""
CREDENTIALS = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9_]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"sk_live_[A-Za-z0-9]{16,}",
    r"xox[baprs]-[A-Za-z0-9-]{16,}",
    r"(?i)https://[^/@\s]+:[^/@\s]+@",
)
REDACTED = "[REDACTED]"
WORD_LIMIT, LINE_LIMIT = 40, 160


def split_lines(text: Column) -> Column:
    """Lines without their ends; no empty one after a closing line feed."""
    parts = F.split(text, "\n")
    open_ended = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(open_ended, lambda x: F.regexp_replace(x, r"\r\z", ""))


def _safe_line(line: Column) -> Column:
    v = F.regexp_replace(line, r"(?U)^\s+|\s+\z", "")
    v = F.regexp_replace(v, r"[\x00-\x1F\x7F-\x9F]", "�")
    v = F.regexp_replace(v, to_java(ASSIGNMENT), r"$1=[REDACTED]")
    for pattern in CREDENTIALS:
        v = F.regexp_replace(v, to_java(pattern), REDACTED)
    words = F.filter(F.split(v, r"(?U)\s+"), lambda w: w != "")
    hide = lambda w: ~w.contains(REDACTED) & ((F.length(w) > WORD_LIMIT) | contains_any(F.lower(w), ("token=", "password=")))
    v = F.array_join(F.transform(words, lambda w: F.when(hide(w), REDACTED).otherwise(w)), " ")
    return F.when(F.length(v) > LINE_LIMIT, F.concat(F.substring(v, 1, LINE_LIMIT), F.lit("…"))).otherwise(v)


def safe_evidence(text: Column) -> Column:
    """Evidence fit to be shown: trimmed, credentials out, long words out, cut."""
    lines = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, _safe_line), lambda x: x != ""), "\n")


#: Credentials in any text that comes from a source.
SOURCE_ASSIGNMENT = r"""(?i)\b(token|password|secret|api[_-]?key|access[_-]?token|client[_-]?secret|_authToken|_password)\b\s*[=:]\s*(?:"(?:\\.|[^"])*"|'(?:\\.|[^'])*'|[^\s,;]+)"""
SOURCE_CREDENTIALS = (*CREDENTIALS[:5], r"(?i)(?:https?|ssh)://[^/@\s]+@", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----")


def sanitized(text: Column) -> Column:
    """Text fit to be shown in its full length: control characters and credentials out."""
    v = F.regexp_replace(text, r"[\x00-\x1F\x7F-\x9F]", "�")
    v = F.regexp_replace(v, to_java(SOURCE_ASSIGNMENT), r"$1=[REDACTED]")
    for pattern in SOURCE_CREDENTIALS:
        v = F.regexp_replace(v, to_java(pattern), REDACTED)
    return v


#: Bytes of a long and of a dense line, entropy of a dense one, lines from it to a call that executes.
LONG_LINE, DENSE_LINE, DENSE_ENTROPY, NEAR = 600, 80, 4.8, 3


#: Letters beyond ASCII that patterns without case take for one of ASCII.
_LIKE_ASCII, _ASCII = "\u017f\u0131\u0130\u212a", "siik"


def folded(text: Column) -> Column:
    """Text in which a pattern's ``needles`` are sought: without case, as patterns compare letters."""
    return F.lower(F.when(contains_any(text, _LIKE_ASCII), F.translate(text, _LIKE_ASCII, _ASCII)).otherwise(text))


def heuristics_apply(path: Column) -> Column:
    """Files of which lines are judged by their shape: not maps, locks and what is generated."""
    base = F.lower(base_name(inner_path(path)))
    return ~(base.endswith(".map") | base.endswith(".lock") | base.isin("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock")) & (classify_context(path) != "generated")


def is_dangerous(line: Column) -> Column:
    return contains_any(F.lower(line), DANGEROUS)


@F.pandas_udf(DoubleType())
def entropy(lines: pd.Series) -> pd.Series:
    """Shannon entropy over the bytes of each line: by row, so lines need no key and no
    shuffle.  Counting bytes is an array operation, which expressions over arrays of
    hexadecimal pairs only imitate."""

    def one(line: str | None) -> float | None:
        if line is None:
            return None
        data = np.frombuffer(line.encode(), np.uint8)
        shares = np.bincount(data, minlength=1)
        shares = shares[shares > 0] / max(1, len(data))
        return float(-(shares * np.log2(shares)).sum()) + 0.0

    return lines.map(one, na_action=None).astype("float64")


#: Not pushed into filters and so computed once.
entropy = entropy.asNondeterministic()


#: Bytes at the beginning of a file that tell whether it is text.
SAMPLE_BYTES = 8192
_CUT = ("^(C[2-9A-F]|D.|E.|F[0-4])$", "^(E.|F[0-4])[89AB].$", "^F[0-4][89AB].[89AB].$")


def looks_text(content: Column) -> Column:
    """Binary content whose first 8 KiB are UTF-8 without a zero byte; a character
    that the sample's end cuts is no fault."""
    head = F.substring(content, 1, SAMPLE_BYTES)
    valid = F.is_valid_utf8(head.cast("string"))
    for n, cut in enumerate(_CUT, 1):  # the first bytes of a character that goes on
        rest = F.hex(F.substring(content, SAMPLE_BYTES - n + 1, n)).rlike(cut)
        valid |= (F.length(content) > SAMPLE_BYTES) & rest & F.is_valid_utf8(F.substring(content, 1, SAMPLE_BYTES - n).cast("string"))
    return valid & (F.instr(head.cast("string"), "\0") == 0)


def executable_magic(content: Column) -> Column:
    """ELF, MZ, Mach-O and class files."""
    return F.hex(F.substring(content, 1, 4)).isin("7F454C46", "CFFAEDFE", "FEEDFACF", "CAFEBABE") | ((F.hex(F.substring(content, 1, 2)) == "4D5A") & (F.length(content) >= 4))
