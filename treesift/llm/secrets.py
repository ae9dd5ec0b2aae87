"""Secret scan by token efficiency.

Random strings cost a byte-pair vocabulary many tokens: a password or key of
40 characters takes twenty or more, while prose, paths and names of that length
take ten or less.  Long unbroken strings are encoded with a public rank vocabulary,
and those with few characters per token are reported, after digests of known
lengths, unique ids, numbers and fillers are taken out.  Three base patterns stand beside this:
an assignment to a secret's name, access key ids, and long hexadecimal runs.

Spans are code points, end exclusive.  Kinds: assign, access, hex (base), and
random (by token efficiency; never over a base span).

Defined results: a null or empty text has no spans.  Repeated rows give equal
results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import bound_batches, ids_and_texts, record_batch

KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: Strings of this many characters or more are tried.
MIN_RANDOM = 20
#: Random strings have fewer characters per token than this.
MAX_CHARS_PER_TOKEN = 2.2
#: The same for strings of the shape of names, which are only letters of few
#: changes of case, or groups of letters and of digits; and the letters that these need.
MAX_NAMED, MIN_LETTERS = 2.05, 8
#: Strings of fewer different characters are fillers.
LEAST_DISTINCT = 6
#: A longer string is judged piece by piece.
PIECE = 128

_NAME = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_RANDOM)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_HEX_ONLY = re.compile(r"[0-9A-Fa-f]+\Z")
_NUMBERS = re.compile(r"[0-9+/_=-]+\Z")
#: Characters of the hexadecimal digests in common use (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_CHARS = frozenset((32, 40, 56, 64, 96, 128))


class TokenCounter:
    """How many tokens a string costs under a rank file."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the three patterns; matches that fail a length are dropped."""
    out = []
    low = text.lower()
    if any(x in low for x in _NAME):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def is_identifier(text: str) -> bool:
    """Digests, unique ids, numbers and runs of few characters, which are public by nature."""
    if _NUMBERS.match(text) or _UUID.match(text) or len(set(text)) < LEAST_DISTINCT:
        return True
    return bool(_HEX_ONLY.match(text)) and len(text) in DIGEST_CHARS


def is_named(text: str) -> bool:
    """Whether a string has the shape of names: groups of one kind, or few changes of case inside words."""
    if _HEX_ONLY.match(text):
        return False
    if any(c.isdigit() for c in text):
        return all(p.isdigit() or p.isalpha() and (p.islower() or p.isupper() or p.istitle()) for p in _groups(text))
    letters = "".join(c for c in text if c.isalpha())
    changes = sum(a.islower() and b.isupper() for a, b in zip(letters, letters[1:], strict=False))
    return changes < len(letters) / 6


def _groups(text: str) -> list[str]:
    return [p for p in re.split(r"[+/_=-]", text) if p]


def is_random(text: str, count: TokenCounter, limit: float = MAX_CHARS_PER_TOKEN) -> bool:
    for i in range(0, len(text), PIECE):
        piece = text[i : i + PIECE]
        if len(piece) >= MIN_RANDOM and len(piece) >= limit * count(piece):
            return False
    return True


def is_secret(text: str, count: TokenCounter) -> bool:
    """By token efficiency; of names' shape less is enough to be one, and numbers beside
    the letters say nothing, so the letters are judged by themselves."""
    plain = text.strip("=")
    if is_identifier(plain):
        return False
    if not is_named(plain):
        return is_random(text, count)
    letters = [p for p in _groups(plain) if p.isalpha()]
    n = sum(map(len, letters))
    return is_random(text, count, MAX_NAMED) and n >= MIN_LETTERS and (n == len(plain) or n < MAX_NAMED * sum(map(count, letters)))


def all_spans(text: str, count: TokenCounter) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans)."""
    base = base_spans(text)
    more = []
    at, reach = 0, 0  # base spans that begin before the string's end, and how far they go
    for m in _LONG.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][0] < end:
            reach = max(reach, base[at][2])
            at += 1
        if reach > start:
            continue
        if is_secret(m[0], count):
            more.append((start, 3, end))
    return base, sorted(base + more) if more else base


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_spans(docs: DataFrame, rank_path: str) -> DataFrame:
    """(doc_id, spans) of every document of ``docs`` (doc_id, text): all spans by
    start, then kind as in ``KINDS``; those of kind random are the method's own."""
    bound_batches(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(rank_path)
        for batch in batches:
            found = [all_spans(t, count)[1] for t in batch.column("text").to_pylist()]
            yield record_batch(schema, batch.column("doc_id"), [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in found])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def secret_report(docs: DataFrame, rank_path: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of every document."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return find_spans(docs, rank_path).select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(F.filter("spans", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), of(KINDS[3]).alias("n_random"),
    )
