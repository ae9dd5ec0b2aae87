"""Quality rules that clean by line first.

Every line is held against three families of rules; lines that fail are taken
out, and a document that loses too much of its text so is rejected.

* punctuation: the line's signs are out of proportion to its words, it shouts
  (upper case with exclamation marks), or one word makes up most of it, or
  most of its words are the word before again;
* navigation: it is a row of short entries between separators, or a few words
  of which one is a known entry of menus, without a full stop;
* boilerplate: it repeats an earlier line, or it is a short line with a known
  notice of sites.

A line that does not end in punctuation is a weak sign, as headings, verse and
cut texts have none: a line fails only where it is very long and no word in it
is followed by any.  The document's base rules come first: at least 20
words, and at most 30 of 100 words in eight-word windows that repeat.

Defined results: a null text has no words and fails the base rules.  Repeated
rows are judged alike; an empty table gives no rows.  The report reads doc_id
and text alone; ``cleaned`` keeps all columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treesift.llm.common import bound_batches, ids_and_texts, record_batch

MIN_WORDS = 20
WINDOW_WORDS = 8
MAX_REPEAT_PERCENT = 30

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_CLOSING = re.compile(r"[.!?…。！？:;\"'”’»)\]]\s*$")
_SEPARATORS = re.compile(r"(?:^|\s)[|›»>/•·](?=\s|$)")
#: Entries of menus and notices of sites.
MENU_WORDS = frozenset("home login logout register menu search sitemap contact about next previous back subscribe share tweet print cart checkout help faq".split())
NOTICES = (
    "accept cookies", "cookie policy", "uses cookies", "enable javascript", "javascript is disabled", "privacy policy",
    "terms of use", "terms of service", "click here", "sign up for our newsletter", "follow us on", "all rights reserved",
    "lorem ipsum", "skip to content", "page not found", "add to cart", "read more",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the loss that a document may bear."""

    symbols_per_word: float = 0.25
    marks_per_word: float = 0.5
    upper_share: float = 0.5
    one_word_share: float = 0.5
    one_word_from: int = 10
    separators_per_word: float = 0.2
    notice_words: int = 25
    open_line_words: int = 200
    max_lost_percent: int = 40


def repeated_words(words: list[str], width: int = WINDOW_WORDS) -> int:
    """The words that lie in a ``width``-word window found twice or more (width: a power of two)."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    size = 1
    while size < width:  # ranks of windows of twice the words, from pairs of ranks: exact
        pairs = ids[: len(ids) - size] * (int(ids.max()) + 1) + ids[size:]
        ids = np.unique(pairs, return_inverse=True)[1]
        size *= 2
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    if not len(again):
        return 0
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + width, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def line_fails(line: str, words: list[str], rules: LineRules) -> bool:
    """Whether one line with words, held alone, breaks a rule."""
    n = len(words)
    symbols = len(_SYMBOLS.findall(line))
    if symbols > max(1, rules.symbols_per_word * n):
        return True
    marks = line.count("!")
    if marks > max(2, rules.marks_per_word * n):
        letters = sum(c.isalpha() for c in line)
        if sum(c.isupper() for c in line) > rules.upper_share * letters or marks > n:
            return True
    if n >= rules.one_word_from:
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        stutters = sum(a == b for a, b in zip(words, words[1:], strict=False))
        if max(max(counts.values()), stutters) > rules.one_word_share * n:
            return True
    closed = _CLOSING.search(line) is not None
    if len(_SEPARATORS.findall(line)) > max(1, rules.separators_per_word * n):
        return True
    low = line.lower()
    if not closed and n <= 6 and any(w.strip(".,:;|").lower() in MENU_WORDS for w in words):
        return True
    if n <= rules.notice_words and any(x in low for x in NOTICES):
        return True
    return n > rules.open_line_words and not any(w[-1] in ".!?…。！？:;" for w in words)


@dataclass(frozen=True)
class Judgement:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    lost_chars: int
    clean_text: str


def judge(text: str, rules: LineRules = LineRules()) -> Judgement:
    """All counts and verdicts of one text."""
    lines = text.split("\n")
    words_in = [[w for w in _SPACES.split(line) if w] for line in lines]
    words = [w for ws in words_in for w in ws]
    n, chars = len(words), sum(map(len, words))
    seen: set[str] = set()
    n_dup, lost, clean = 0, 0, []
    for line, ws in zip(lines, words_in, strict=True):
        if ws:
            repeated = line in seen
            n_dup += repeated
            seen.add(line)
            if repeated or line_fails(line, ws, rules):
                lost += sum(map(len, ws))
                continue
        clean.append(line)
    repeats = repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    kept = not base_failed and 100 * lost <= rules.max_lost_percent * chars
    return Judgement(n, chars, len(_SYMBOLS.findall(text)), n_dup, repeats, base_failed, kept, lost, "\n".join(clean))


def quality_report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The counts and verdicts of every document of ``docs`` (doc_id, text)."""
    bound_batches(docs.sparkSession)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in counts), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t, rules) for t in batch.column("text").to_pylist()]
            yield record_batch(schema, batch.column("doc_id"), *([getattr(j, f.name) for j in found] for f in list(schema)[1:]))

    kinds = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, lost_chars long"
    return ids_and_texts(docs).mapInArrow(run, kinds)


def cleaned(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns (names may repeat):
    ``text`` without the lines that fail, and ``n_chars``, where there is one column
    of this name and it is a whole number, the characters that are left."""
    bound_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = docs.columns.index("text")
    plain = docs.toDF(*names)
    sized = [i for i, f in enumerate(docs.schema) if f.name == "n_chars" and f.dataType.typeName() in ("long", "integer")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t or "", rules) for t in batch.column(text).to_pylist()]
            columns = list(batch.columns)
            columns[text] = pa.array([j.clean_text for j in found], batch.schema.field(text).type)
            if len(sized) == 1:
                columns[sized[0]] = pa.array([len(j.clean_text) for j in found], batch.schema.field(sized[0]).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([j.kept for j in found], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
