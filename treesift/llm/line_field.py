"""Document quality by a linear-chain conditional random field over lines.

Every line with a word in it is a variable, good or bad, in the order of the
text.  Its factors are the line's own traits and those of the lines before and
after it (shares of symbols, marks, separators, upper case, repeated words and
so on, each in a few steps) and a chain factor to the next line.  Forward and
backward passes over the whole document give each line's marginal of being good;
the document's score is their mean, weighted by the lines' lengths.

The labels are of documents, so a line is trained with the label of its document.
Weights have the greatest conditional likelihood with an L2 penalty; that on the
chain is stronger, so that the lines' own traits decide where they are plain.

The field is fitted on a bounded sample, the first ``TRAIN_DOCS`` labelled
documents in the order of a hash of their ids, without those held out (crc32 of
the id in decimal, mod 4, is 2) and those of more than ``TRAIN_LINES`` lines.
All documents are scored.  The score reads the text alone.

Defined results: a null or empty text, or one of white space alone, counts as one
line without words, and its score is what the field has learned of such a line.
A document labelled both ways, or with a null label, teaches nothing; of repeated
rows of an id the least text teaches.  Without any label every score is 0.5.  A
null doc_id is not held out, and has no label.  Repeated rows are scored alike;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import bound_batches, ids_and_texts, record_batch

#: Bounds of the sample that the field is fitted on.
TRAIN_DOCS = 4000
TRAIN_LINES = 2000
HELD_OUT = 2
GOOD_FROM = 0.7

_SYMBOLS = re.compile(r"[#*$%&<>]")
_SEPARATORS = re.compile(r"[|›»•·]")
_DIGITS = re.compile(r"[0-9]")
#: Steps of each trait: it is as many as it is not less than.
_STEPS = {
    "words": (2, 4, 8, 16, 40, 100),
    "symbols": (0.01, 0.1, 0.3, 0.8, 2),
    "marks": (0.01, 0.1, 0.3, 0.8, 2),
    "separators": (0.01, 0.1, 0.25, 0.4),
    "upper": (0.02, 0.1, 0.3, 0.6, 0.9),
    "stutter": (0.01, 0.05, 0.2, 0.5, 0.8),
    "distinct": (0.1, 0.3, 0.5, 0.7, 0.9),
    "length": (2.5, 3.5, 4.5, 5.5, 6.5, 8, 12),
    "short": (0.02, 0.1, 0.2, 0.3, 0.45, 0.6),
    "digits": (0.01, 0.1, 0.3, 0.6),
    "end": (1, 2),
    "again": (1,),
    "edge": (1, 2, 3),
}
TRAITS = tuple(_STEPS)
#: Traits of the lines beside a line that are its own factors too.
NEAR = tuple(TRAITS.index(t) for t in ("words", "symbols", "marks", "separators", "upper", "stutter", "short", "again"))
_BOUNDS = [np.array(s, np.float64) for s in _STEPS.values()]
_SIZES = np.array([len(b) + 1 for b in _BOUNDS])
_NO_LINE = 1  # one more step for neighbours: there is none
_FIRST = np.concatenate(([0], np.cumsum(np.concatenate((_SIZES, _SIZES[list(NEAR)] + _NO_LINE, _SIZES[list(NEAR)] + _NO_LINE)))))
N_NODE = int(_FIRST[-1]) + 1  # and one for every line
N_WEIGHTS = N_NODE + 3  # and the chain: both bad, one of either, both good


def _measures(line: str, again: bool) -> tuple[float, ...]:
    words = line.split()
    n = len(words)
    if not n:
        return (0,) * (len(TRAITS) - 1)
    chars = sum(map(len, words))
    last = words[-1][-1]
    return (
        n,
        len(_SYMBOLS.findall(line)) / n,
        line.count("!") / n,
        len(_SEPARATORS.findall(line)) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        chars / n,
        sum(len(w) <= 3 for w in words) / n,
        len(_DIGITS.findall(line)) / chars,
        2 if last in ".!?…。！？" else 1 if last in ",;:)]\"'”’»" else 0,
        again,
    )


def line_factors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """For each line with a word the numbers of its factors (a row each), and its length; of an empty text one row."""
    lines = [x for x in text.split("\n") if x and not x.isspace()] or [""]
    seen: set[str] = set()
    rows = []
    for line in lines:
        rows.append(_measures(line, line in seen))
        seen.add(line)
    table = np.array(rows, np.float64)
    edge = np.zeros(len(lines))
    edge[0] += 1
    edge[-1] += 2
    steps = np.column_stack([np.searchsorted(b, c, "right") for b, c in zip(_BOUNDS, (*table.T, edge), strict=True)])
    beside = np.vstack([_SIZES[list(NEAR)], steps[:, NEAR], _SIZES[list(NEAR)]])
    factors = np.hstack([steps, beside[:-2], beside[2:]]) + _FIRST[:-1]
    return factors.astype(np.int32), np.array([len(x) + 1 for x in lines], np.float64)


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(odds: list[float], chain: tuple[float, float, float]) -> list[float]:
    """The probability of good for each line, from the log odds of its factors and the
    chain's weights: both bad, one of either, both good."""
    bad, other, good = chain
    forward, back = [0.0] * len(odds), 0.0
    message = 0.0
    for i, x in enumerate(odds):
        forward[i] = message = message + x
        message = _log_sum(message + good, other) - _log_sum(message + other, bad)
    out = [0.0] * len(odds)
    for i in range(len(odds) - 1, -1, -1):
        total = forward[i] + back
        out[i] = 1 / (1 + math.exp(-total)) if total > -700 else 0.0
        at = back + odds[i]
        back = _log_sum(at + good, other) - _log_sum(at + other, bad)
    return out


def score(text: str, weights: np.ndarray) -> float:
    """The share of a text, by length, that the field holds for good."""
    factors, lengths = line_factors(text)
    odds = weights[factors].sum(axis=1) + weights[N_NODE - 1]
    good = marginals(odds.tolist(), tuple(weights[N_NODE:].tolist()))
    return float(min(1.0, max(0.0, np.dot(good, lengths) / lengths.sum())))


def _loss(weights: np.ndarray, steps: list[tuple], sums: np.ndarray, penalty: np.ndarray) -> tuple[float, np.ndarray]:
    """Minus the log likelihood of all documents' labels, and its slope.

    ``steps`` has, for each line number, the documents that long, with factors; the longest documents come first."""
    bad, other, good = weights[N_NODE:]
    n = len(steps[0])
    forward = []  # log weights of (bad, good) up to each line
    a = np.zeros((n, 2))
    for t, factors in enumerate(steps):
        odds = weights[factors].sum(axis=1) + weights[N_NODE - 1]
        if t:
            p = a[: len(factors)]
            a = np.column_stack([np.logaddexp(p[:, 0] + bad, p[:, 1] + other), np.logaddexp(p[:, 0] + other, p[:, 1] + good)])
        a = a.copy()
        a[:, 1] += odds
        forward.append(a)
    slope, total = np.zeros(N_WEIGHTS), 0.0
    b, z = np.zeros((0, 2)), np.zeros(0)
    for t in range(len(steps) - 1, -1, -1):
        a, here = forward[t], len(steps[t])
        if len(b) < here:  # documents whose last line this is
            new = a[len(b) :]
            ends = np.logaddexp(new[:, 0], new[:, 1])
            total += ends.sum()
            z, b = np.concatenate((z, ends)), np.vstack((b, np.zeros((here - len(b), 2))))
        p_good = np.exp(a[:, 1] + b[:, 1] - z)
        np.add.at(slope, steps[t], p_good[:, None])
        slope[N_NODE - 1] += p_good.sum()
        if t:
            before = forward[t - 1][:here]
            odds = weights[steps[t]].sum(axis=1) + weights[N_NODE - 1]
            to_bad, to_good = b[:, 0], b[:, 1] + odds
            slope[N_NODE] += np.exp(before[:, 0] + bad + to_bad - z).sum()
            slope[N_NODE + 1] += np.exp(before[:, 0] + other + to_good - z).sum() + np.exp(before[:, 1] + other + to_bad - z).sum()
            slope[N_NODE + 2] += np.exp(before[:, 1] + good + to_good - z).sum()
            b = np.column_stack([np.logaddexp(bad + to_bad, other + to_good), np.logaddexp(other + to_bad, good + to_good)])
    return total - weights @ sums + 0.5 * (penalty * weights) @ weights, slope - sums + penalty * weights


def fit(documents: list[tuple[np.ndarray, int]], rounds: int = 60) -> np.ndarray:
    """The weights for documents given as (factors of their lines, label)."""
    weights = np.zeros(N_WEIGHTS)
    if not documents:
        return weights
    documents = sorted(documents, key=lambda d: -len(d[0]))
    steps = [np.array([d[t] for d, _ in documents if len(d) > t]) for t in range(len(documents[0][0]))]
    sums = np.zeros(N_WEIGHTS)
    for factors, label in documents:
        if label:
            np.add.at(sums, factors, 1)
            sums[N_NODE - 1] += len(factors)
        sums[N_NODE + 2 * label] += len(factors) - 1
    penalty = np.full(N_WEIGHTS, 1.0)
    penalty[N_NODE:] = 0.02 * sums[N_NODE:].sum() + 1
    value, slope = _loss(weights, steps, sums, penalty)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):  # limited-memory quasi-Newton steps
        way, scales = slope.copy(), []
        for s, y in reversed(past):
            scales.append((s @ way) / (s @ y))
            way -= scales[-1] * y
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(slope).sum())
        for (s, y), scale in zip(past, reversed(scales), strict=True):
            way += (scale - (y @ way) / (s @ y)) * s
        length, enough = 1.0, 1e-4 * (slope @ way)
        while length > 1e-6:
            moved = weights - length * way
            new_value, new_slope = _loss(moved, steps, sums, penalty)
            if new_value <= value - length * enough:
                break
            length /= 2
        else:
            break
        s, y = moved - weights, new_slope - slope
        if s @ y > 1e-10:
            past = [*past[-7:], (s, y)]
        done = value - new_value < 1e-6 * abs(value)
        weights, value, slope = moved, new_value, new_slope
        if done:
            break
    return weights


def remainder(doc_id: Column) -> Column:
    """crc32 of the id in decimal, mod 4."""
    return F.crc32(F.encode(doc_id.cast("long").cast("string"), "UTF-8")) % 4


def train(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS, n_lines: int = TRAIN_LINES) -> np.ndarray:
    """The field's weights from a bounded sample of the labelled documents that are not held out."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1))
    told = told.where(remainder(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).where("label = most")
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs).select("doc_id", "label")
    texts = ids_and_texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("factors", pa.binary())])
        for batch in batches:
            found = [line_factors(t)[0] for t in batch.column("text").to_pylist()]
            few = pa.array([len(f) <= n_lines for f in found], pa.bool_())
            yield record_batch(schema, batch.column("doc_id"), batch.column("label"), [f.astype(np.uint16).tobytes() for f in found]).filter(few)

    bound_batches(docs.sparkSession)
    rows = texts.mapInArrow(run, "doc_id long, label int, factors binary").collect()  # n_docs rows of n_lines lines at most
    width = len(_FIRST) - 1
    return fit([(np.frombuffer(r.factors, np.uint16).reshape(-1, width).astype(np.int32), r.label) for r in sorted(rows, key=lambda r: r.doc_id)])


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every document of ``docs`` (doc_id, text)."""
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(schema, batch.column("doc_id"), [score(t, weights) for t in batch.column("text").to_pylist()])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by a field trained on ``labels`` (doc_id, quality)."""
    found = scored(docs, train(docs, labels))
    held_out = F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
