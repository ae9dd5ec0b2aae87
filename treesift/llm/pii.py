"""Personal data by a skip-chain conditional random field.

Four base patterns give the spans that are certain.  Beside them, every token
(unbroken by white space) with a digit or an at sign is a variable with the
labels none, email, ip, card, phone; so is a pair of tokens that a written-out
at sign joins.  A field over a document has

* node factors: the token's shape and the words before it;
* chain factors between neighbours;
* skip factors between tokens that are equal or alike wherever they stand in
  the document (equal digits, equal local part or the like), so that a number
  whose shape alone says little takes the label of its fuller twin.

All other tokens have the label none and no factor, which is exact for the
field as trained, since a token with no feature of personal data is never
labelled.  Tokens under base spans are observed with the base label.  Loopy
message passing runs over the whole document; tokens whose belief in a label
is over one half add spans.  Skip factors join each token to the one before it
with the same key, and to the first such, so a group of k tokens has fewer than
2 k of them.

The weights are trained here, by pseudo-likelihood on documents that a seeded
generator writes in full and in disguised forms; nothing of the corpus is used.

Spans are code points, end exclusive.  Defined results: a null or empty text
has no spans; repeated rows give equal results; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import bound_batches, ids_and_texts, record_batch

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
LABELS = NONE + 1
ROUNDS = 12

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_BLANK = re.compile(r"\s")
_WORD = re.compile(r"[^\W\d_]+")
_GROUP = re.compile(r" [(]?[0-9][0-9().-]*(?![^\s,;.])")
_HOST = re.compile(r"(\S+)(?:(?:\s*+[(\[{]\s*+dot\s*+[)\]}]|\s++dot\s)\s*+\S+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them, but walking from at sign to at sign, so that
    long runs without one cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    """Four parts at a time of every maximal chain of dotted numbers."""
    out = []
    for m in _CHAIN.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append((at, at + length))
            at += length + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), sorted."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(1, a, b) for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# --- the field -----------------------------------------------------------------------------------

#: Words before personal data, by kind.
CUES = {
    "email": 0, "mail": 0, "contact": 0, "write": 0, "correo": 0, "courriel": 0,
    "ip": 1, "address": 1, "host": 1, "server": 1, "addr": 1,
    "card": 2, "visa": 2, "mastercard": 2, "credit": 2, "payment": 2, "tarjeta": 2, "carte": 2, "karte": 2,
    "phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3, "telefon": 3,
}
_FEATURES = (
    "bias", "at sign", "at word", "domain", "quad", "small parts", "digits 1-6", "digits 7-9", "digits 10-12", "digits 13-19", "digits 20+",
    "letters", "luhn", "plus", "brackets", "groups", "cue email", "cue ip", "cue card", "cue phone",
)
_AT = {name: i for i, name in enumerate(_FEATURES)}
_AT_CORE = re.compile(r"at|AT|arroba")
_DOT_AFTER = re.compile(r"[A-Za-z0-9-]+(?:\s*+[(\[{]\s*+dot\s*+[)\]}]|\s++dot\s)")
_BLANKS = re.compile(r"\s*")
_AT_OR_SIGN = re.compile(r"@|\bat\b")


def at_words(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of at signs written out, with the white space around them: in brackets,
    or as a word before a host whose dot is written out.  The word is found first and then
    looked at outwards, so white space is passed over at most twice."""
    done = 0
    for m in _AT_CORE.finditer(text):
        left = m.start()
        while left > done and text[left - 1].isspace():
            left -= 1
        right = _BLANKS.match(text, m.end()).end()
        if left > done and text[left - 1] in "([{" and text[right : right + 1] in (")", "]", "}"):
            left -= 1
            while left > done and text[left - 1].isspace():
                left -= 1
            done = _BLANKS.match(text, right + 1).end()
            yield left, done
        elif left < m.start() and right > m.end() and m[0] != "arroba" and _DOT_AFTER.match(text, right):
            done = right
            yield left, done


class Token:
    """A candidate: its place, features, keys of similarity and, if known, its label."""

    __slots__ = ("start", "end", "features", "keys", "label")

    def __init__(self, text: str, start: int, end: int, label: int | None = None):
        while start < end and text[start] in " \t\n\"'“”‘’<>[]{},;:!?|*#$%&":
            start += 1
        while end > start and text[end - 1] in " \t\n\"'“”‘’<>[]{},;:!?.|*#$%&":
            end -= 1
        self.start, self.end, self.label = start, end, label
        self._describe(text)

    def _describe(self, text: str) -> None:
        word = text[self.start : self.end]
        digits = "".join(c for c in word if "0" <= c <= "9")
        n = len(digits)
        f = [0]
        low = word.lower()
        spelled = next(at_words(word), None)
        has_at = "@" in word
        if has_at:
            f.append(_AT["at sign"])
        if spelled:
            f.append(_AT["at word"])
        if re.search(r"[A-Za-z0-9-]\.[A-Za-z]{2,}\Z", word) or spelled and " dot " in f" {low} ":
            f.append(_AT["domain"])
        quad = re.fullmatch(r"[0-9]+(?:[.,:_-][0-9]+){3}", word)
        if quad:
            f.append(_AT["quad"])
            if all(int(p[:6]) <= 255 for p in re.split(r"\D", word)):
                f.append(_AT["small parts"])
        f.append(_AT["digits 1-6" if n < 7 else "digits 7-9" if n < 10 else "digits 10-12" if n < 13 else "digits 13-19" if n < 20 else "digits 20+"])
        if re.search(r"[^\W\d_]", word):
            f.append(_AT["letters"])
        if 13 <= n <= 19 and luhn(digits):
            f.append(_AT["luhn"])
        if "+" in word:
            f.append(_AT["plus"])
        if "(" in word or ")" in word:
            f.append(_AT["brackets"])
        if re.search(r"[0-9][ .-][0-9]", word):
            f.append(_AT["groups"])
        before = _WORD.findall(text[max(0, self.start - 24) : self.start].lower())[-2:]
        f += {_AT[f"cue {KINDS[CUES[w]]}"] for w in before if w in CUES}
        self.features = f
        keys = []
        if has_at or spelled:
            cut = _AT_OR_SIGN.search(low)
            local = (low[: cut.start()] if cut else low).rstrip()
            if cut and cut[0] == "at" and local.endswith(("(", "[", "{")):
                local = local[:-1]
            local = local.strip()
            if len(local) >= 4:
                keys.append("l" + local)
        elif n >= 7:
            keys.append("d" + digits[-10:] if n < 13 else "d" + digits)
            if n >= 10:
                keys.append("e" + digits[-7:] if n < 13 else "d" + digits)
            else:
                keys.append("e" + digits[-7:])
        if len(low) >= 4:
            keys.append("w" + low)
            if not has_at and n < 7:
                keys.append("l" + low)
        self.keys = list(dict.fromkeys(keys))


def tokens_of(text: str, base: list[tuple[int, int, int]]) -> list[Token]:
    """Candidates in order; base spans are tokens of known label."""
    out = [Token(text, a, b, k) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    begins, furthest = [a for a, _ in taken], [0, *accumulate((b for _, b in taken), max)]
    blanks, run, last = _BLANK.finditer(text), 0, 0
    blank, low, high, end = next(blanks, None), 0, 0, 0
    for a, b in at_words(text):
        while blank is not None and blank.end() <= a:  # where the unbroken run before it begins
            run, blank = blank.end(), next(blanks, None)
        if run < last:
            continue
        if not low <= b < high:  # the host goes on to the same place from all of an unbroken run
            tail = _HOST.match(text, b)
            if not tail:
                continue
            low, high, end = b, tail.end(1), tail.end()
        if furthest[bisect_left(begins, end)] <= run:
            out.append(Token(text, run, end))
            last = end
            taken.append((run, last))
    taken.sort()
    i, at, m = 0, 0, _MARK.search(text)
    while m:
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        blank = _BLANK.search(text, m.end())
        end = blank.start() if blank else len(text)
        # numbers written in groups are one candidate
        while (g := _GROUP.match(text, end)) and text[end - 1] in "0123456789).-":
            end = g.end()
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        pieces, p, j = [], start, i
        while j < len(taken) and taken[j][0] < end:
            pieces.append((p, taken[j][0]))
            p, j = max(p, taken[j][1]), j + 1
        pieces.append((p, max(p, end)))
        for a, b in pieces:
            if a < b and _MARK.search(text, a, b):
                t = Token(text, a, b)
                if t.start < t.end:
                    out.append(t)
        at = max(end, p)
        m = _MARK.search(text, at)
    return sorted(out, key=lambda t: (t.start, t.end))


def factors(text: str, tokens: list[Token]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain pairs, skip pairs) of places in ``tokens``."""
    chain = [(i, i + 1) for i in range(len(tokens) - 1) if text[tokens[i].end : tokens[i + 1].start].strip(",;") == " "]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    skip = set()
    for i, t in enumerate(tokens):
        for k in t.keys:
            if k in first:
                skip |= {(last[k], i), (first[k], i)}
            first.setdefault(k, i)
            last[k] = i
    return chain, sorted(skip)


@lru_cache(1)
def weights(seed: int = 7, n_docs: int = 600) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features x labels, chain labels x labels, skip labels x labels), trained
    by pseudo-likelihood on generated documents."""
    rng = random.Random(seed)
    nodes, near, far, gold = [], [], [], []
    for _ in range(n_docs):
        text, spans = _write(rng)
        certain = base_spans(text)
        tokens = tokens_of(text, certain)
        chain, skip = factors(text, tokens)
        label = [next((k for k, a, b in spans if a < t.end and t.start < b), NONE) for t in tokens]
        a, b = np.zeros((len(tokens), LABELS)), np.zeros((len(tokens), LABELS))
        for out, pairs in ((a, chain), (b, skip)):
            for i, j in pairs:
                out[i, label[j]] += 1
                out[j, label[i]] += 1
        for i, t in enumerate(tokens):
            x = np.zeros(len(_FEATURES))
            x[t.features] = 1
            nodes.append(x)
            near.append(a[i])
            far.append(np.minimum(b[i], 2))
            gold.append(label[i])
    x = np.hstack([nodes, near, far])
    y = np.eye(LABELS)[gold]
    w = np.zeros((x.shape[1], LABELS))
    step = np.zeros_like(w)
    for _ in range(400):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        step = 0.9 * step + (x.T @ (y - p)) / len(x) - 1e-4 * w
        w += 0.5 * step
    n = len(_FEATURES)
    chain, skip = w[n : n + LABELS], w[n + LABELS :]
    return w[:n], (chain + chain.T) / 2, (skip + skip.T) / 2


def _write(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated document and its true spans: some entities, each in full and
    in other forms, among words, dates, prices and codes."""
    def word() -> str:
        return "".join(rng.choice(("ba", "to", "ri", "en", "sol", "mar", "ti")) for _ in range(rng.randint(1, 3)))

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = digits(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def forms(kind: int) -> list[str]:
        if kind == 0:
            local, host = f"{word()}.{digits(2)}", f"{word()}.example.com"
            return [f"{local}@{host}", f"{local}(at){host}", f"{local} [at] {host}", f"{local}@{host.split('.')[0]}", local]
        if kind == 1:
            parts = [str(rng.randint(1, 255)) for _ in range(4)]
            return [".".join(parts), "-".join(parts), ",".join(parts)]
        if kind == 2:
            c = card()
            return [c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), ".".join(c[i : i + 4] for i in range(0, 16, 4)), "_".join(c[i : i + 4] for i in range(0, 16, 4))]
        a, b, c = digits(3), digits(3), digits(4)
        return [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}{b}{c}"]

    cues = [[c for c, k in CUES.items() if k == kind] for kind in range(4)]
    items: list[tuple[int, str]] = []
    for kind in rng.sample(range(4), rng.randint(1, 3)):
        every = forms(kind)
        items.append((kind, every[0] if rng.random() < 0.7 else rng.choice(every)))
        items += [(kind, rng.choice(every)) for _ in range(rng.randint(0, 3))]
    noise = [
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"{digits(2)}.{digits(2)}",
        lambda: digits(rng.randint(1, 5)),
        lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}",
        lambda: digits(16),
        lambda: digits(rng.randint(7, 12)),
        lambda: word() + digits(2),
        lambda: f"{digits(1)},{digits(3)},{digits(3)}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((8, 32, 40)))),
    ]
    for _ in range(rng.randint(2, 5)):
        code = rng.choice(noise)()
        items += [(NONE, rng.choice((code, code.upper()))) for _ in range(rng.choice((1, 1, 1, 2, 3)))]
    rng.shuffle(items)
    text, spans = "", []
    for kind, item in items:
        text += " ".join(word() for _ in range(rng.randint(2, 8))) + " "
        if kind < NONE and rng.random() < 0.4:
            text += rng.choice(cues[kind]) + rng.choice((" ", ": "))
        if kind < NONE:
            spans.append((kind, len(text), len(text) + len(item)))
        text += item + rng.choice((" ", ", ", ". "))
    return text, spans


def beliefs(text: str, tokens: list[Token], model) -> np.ndarray:
    """Each token's belief in each label, by loopy message passing in logarithms."""
    w, chain_w, skip_w = model
    chain, skip = factors(text, tokens)
    node = np.array([w[t.features].sum(0) for t in tokens])
    for i, t in enumerate(tokens):
        if t.label is not None:
            node[i] = -50.0
            node[i, t.label] = 0.0
    pairs = chain + skip
    if not pairs:
        logits = node
    else:
        a = np.array([p[0] for p in pairs] + [p[1] for p in pairs])
        b = np.array([p[1] for p in pairs] + [p[0] for p in pairs])
        potential = np.concatenate([np.repeat(chain_w[None], len(chain), 0), np.repeat(skip_w[None], len(skip), 0)] * 2)
        back = np.concatenate([np.arange(len(pairs), 2 * len(pairs)), np.arange(len(pairs))])
        message = np.zeros((len(a), LABELS))
        for _ in range(ROUNDS):
            total = node.copy()
            np.add.at(total, b, message)
            into = total[a] - message[back]
            z = into[:, :, None] + potential
            top = z.max(1, keepdims=True)
            new = np.log(np.exp(z - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            change = np.abs(new - message).max()
            message = 0.5 * (message + new)
            if change < 1e-3:
                break
        logits = node.copy()
        np.add.at(logits, b, message)
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def all_spans(text: str, model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), both by kind, then start."""
    base = base_spans(text)
    if not _MARK.search(text) and next(at_words(text), None) is None:
        return base, base
    tokens = tokens_of(text, base)
    if all(t.label is not None for t in tokens):
        return base, base
    more = []
    for t, p in zip(tokens, beliefs(text, tokens, model), strict=True):
        k = int(p[:NONE].argmax())
        if t.label is None and p[k] > 0.5:
            more.append((k, t.start, t.end))
    return base, sorted(base + more) if more else base


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"


def find_spans(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, text, spans) of every document of ``docs`` (doc_id, text), or without
    the text: all spans by kind as in ``KINDS``, then start; ``base`` tells the
    patterns' from the field's."""
    bound_batches(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
    text = [("text", pa.string())] if with_text else []
    schema = pa.schema([("doc_id", pa.int64()), *text, ("spans", pa.list_(span))])
    model = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(text, model)
                certain = set(base) if every else ()
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": (k, a, b) in certain} for k, a, b in every])
            yield record_batch(schema, *(batch.column(n) for n in schema.names[:-1]), out)

    return ids_and_texts(docs).mapInArrow(run, f"doc_id long, {'text string, ' if with_text else ''}spans {SPANS}")


def redacted(found: DataFrame) -> DataFrame:
    """(doc_id, text) with every span of ``find_spans`` replaced by its kind in
    brackets; of spans that overlap the one that begins first."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def clean(text: str, spans: list[dict]) -> str:
        parts, at = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
            if s["start"] >= at:
                parts += [text[at : s["start"]], f"[{s['kind']}]"]
            at = max(at, s["end"])
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield record_batch(schema, batch.column("doc_id"), [clean(t, s) for t, s in zip(texts, batch.column("spans").to_pylist(), strict=True)])

    return found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every document."""
    base = F.filter("spans", lambda s: s["base"])
    return find_spans(docs, with_text=False).select(
        "doc_id",
        *[F.size(F.filter("spans", _base_of(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )


def _base_of(kind: str):
    return lambda s: s["base"] & (s["kind"] == kind)
