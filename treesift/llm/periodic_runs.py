"""Runs of words that go round: maximal repetitions by a suffix tree.

A run is a stretch of words with a smallest period ``q`` (words ``q`` apart are
identical) of at least twice ``q`` and at least ``MIN_LENGTH`` words that no
neighbouring word extends.

Every document has its own suffix tree over its words.  An inner node of word
depth ``D`` stands for a passage of ``D`` words; where two of its leaves lie ``D``
apart and under different children, the passage stands twice in a row and the
word that follows breaks the repeat: a branching tandem repeat.  For each node
all leaves but those of its largest child are tried, to both sides, so that a
leaf is tried a logarithmic number of times.  A branching repeat ends where its
run ends; it is rotated to the left as long as words agree, which gives the
run's start, and repeats of one end whose word is a power of another's merge.

The tree is held as a suffix array with its common prefix lengths, and the
trees of a batch are built at once, as no word of one document equals a word of
another.  Nodes less than ``LEAST_DEPTH`` deep are not built: a run of 12 words
with a period of one to three has the multiple of it in four to six as a
branching repeat too, and its root is looked for there.  So only words that are
in a passage of four that repeats in its document are sorted any further.

Words are compared by number, one number to each distinct word: no hashes.

Defined results: a null or empty text has no words and no runs; repeated rows
give equal results; an empty table gives no rows; other columns are not read.  A
document is one task's work, with memory in proportion to its text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import bound_batches, ids_and_texts

MIN_LENGTH = 12
#: Words of depth from which nodes are built; (MIN_LENGTH / 2) // LEAST_DEPTH must be 1.
LEAST_DEPTH = 4
#: Words that are worked on at once, but for a longer single document, and leaves tried at once.
CHUNK_WORDS = 1_000_000
CHUNK_LEAVES = 2_000_000


def _ranked(codes: np.ndarray) -> np.ndarray:
    """The place of each code's first among all, sorted: equal codes have equal ranks, in order."""
    order = np.argsort(codes, kind="stable")
    in_order = codes[order]
    head = np.concatenate(([True], in_order[1:] != in_order[:-1]))
    out = np.empty(len(codes), np.int64)
    out[order] = np.maximum.accumulate(np.where(head, np.arange(len(codes)), 0))
    return out


def _sorted_suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose next four words stand elsewhere too, in the order of their
    suffixes, and a number for these four words by place.

    ``words`` ends, and every document in it ends, in a number that is nowhere else."""
    n = len(words)
    rank = words
    for h in (1, 2):
        ahead = np.zeros(n, np.int64)
        ahead[: n - h] = rank[h:]
        rank = _ranked(rank * (int(rank.max()) + n + 1) + ahead)
    four = rank.copy()
    left = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    places, h = left, 4
    while len(left):  # doubling, of groups that are still equal only
        key = rank[left] * (n + 1) + rank[left + h]
        order = np.argsort(key, kind="stable")
        left, key = left[order], key[order]
        index, old = np.arange(len(left)), rank[left]
        first = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), index, 0))
        split = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.maximum.accumulate(np.where(split, index, 0))
        rank[left] = old + head - first
        alone = split & np.concatenate((split[1:], [True]))
        left, h = left[~alone], 2 * h
    return places[np.argsort(rank[places])], four


def _shared_lengths(words: list[int], order: np.ndarray, four: np.ndarray) -> np.ndarray:
    """By place in ``order``: the words that a suffix shares with the one before it; 0 where these are fewer than four."""
    before = np.full(len(order), -1, np.int64)
    before[1:] = np.where(four[order[1:]] == four[order[:-1]], order[:-1], -1)
    by_place = np.argsort(order)
    out, shared = np.zeros(len(order), np.int64), 0
    for k, i, j in zip(by_place.tolist(), order[by_place].tolist(), before[by_place].tolist(), strict=True):
        if j < 0:
            shared = 0
            continue
        shared = max(shared - 1, LEAST_DEPTH)
        while words[i + shared] == words[j + shared]:
            shared += 1
        out[k] = shared
    return out


def _nodes(depths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of the tree as (boundary between leaves, first leaf, end of leaves):
    a node of many children is split child by child, at each boundary between two."""
    open_, at, low, high = [0], [], [0] * len(depths), [len(depths)] * len(depths)
    for k in range(1, len(depths)):
        while depths[open_[-1]] > depths[k]:
            high[open_.pop()] = k
        if depths[k]:
            low[k] = open_[-1]
            at.append(k)
            open_.append(k)
        else:
            open_ = [k]
    inner = np.array(at, np.int64)
    return inner, np.array(low, np.int64)[inner], np.array(high, np.int64)[inner]


def _branching_repeats(order: np.ndarray, depths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, words of one half) of every branching tandem repeat, from the leaves of all nodes but their larger sides'."""
    at, low, high = _nodes(depths.tolist())
    leaf_of = np.full(n, -1, np.int64)
    leaf_of[order] = np.arange(len(order))
    to_left = at - low <= high - at
    first, size = np.where(to_left, low, at), np.minimum(at - low, high - at)
    other, other_end = np.where(to_left, at, low), np.where(to_left, high, at)
    starts, halves = [], []
    chunk = np.cumsum(size) // CHUNK_LEAVES
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(chunk)) + 1):
        node = np.repeat(part, size[part])
        inside = np.arange(len(node)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        place, half = order[first[node] + inside], depths[at[node]]
        for other_place in (place + half, place - half):
            leaf = np.where((other_place >= 0) & (other_place < n), leaf_of[np.clip(other_place, 0, n - 1)], -1)
            meets = (leaf >= other[node]) & (leaf < other_end[node])
            starts.append(np.minimum(place, other_place)[meets])
            halves.append(half[meets])
    return np.concatenate(starts), np.concatenate(halves)


def _rotated(words: np.ndarray, start: int, half: int) -> int:
    """Where the run of period ``half`` begins in which a repeat at ``start`` lies."""
    step = 16
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(words[low:start] != words[low + half : start + half])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, 2 * step
    return 0


def _root(words: np.ndarray, start: int, half: int) -> int:
    """The smallest period of a repeat of few words."""
    for q in range(1, half):
        if half % q == 0 and (words[start : start + 2 * half - q] == words[start + q : start + 2 * half]).all():
            return q
    return half


def maximal_runs(documents: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each document, given as one number a word (0 and above, of one meaning inside
    a document only), its runs (start, length, period), by start and then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], np.int64)
    if sizes.sum() < MIN_LENGTH:
        return found
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    words, above = np.empty(begins[-1], np.int64), 0
    for d, begin in zip(documents, begins, strict=False):
        words[begin : begin + len(d)] = d + above
        above += int(d.max()) + 1 if len(d) else 0
    words[begins[1:] - 1] = above + np.arange(len(documents))  # the end of each document is a word of its own
    order, four = _sorted_suffixes(words)
    if not len(order):
        return found
    starts, halves = _branching_repeats(order, _shared_lengths(words.tolist(), order, four), len(words))
    merged: dict[int, list[tuple[int, int]]] = {}
    for start, half in sorted(set(zip(starts.tolist(), halves.tolist(), strict=True)), key=lambda x: x[1]):
        end = start + 2 * half
        same_end = merged.setdefault(end, [])
        if any(begin <= start for begin, _ in same_end):
            continue  # of a run that is there: the half is a power of a shorter one
        period = _root(words, start, half) if half <= MIN_LENGTH // 2 else half
        begin = _rotated(words, start, period)
        if end - begin >= max(MIN_LENGTH, 2 * period):
            same_end.append((begin, period))
    runs = sorted((begin, period, end) for end, same in merged.items() for begin, period in same)
    owner = np.searchsorted(begins, np.array([r[0] for r in runs], np.int64), "right") - 1
    for (begin, period, end), i in zip(runs, owner.tolist(), strict=True):
        found[i].append((begin - int(begins[i]), end - begin, period))
    return found


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run contains after its first period."""
    if not runs:
        return words
    marks = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]


def _numbered(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def collapsed(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document of ``docs`` (doc_id, text).

    ``runs`` are structs of start (word number), length and period, by start and then
    period; ``collapsed`` is the text's words, joined by one space, without those that
    a run contains after its first period.  ``prepare`` may change a document's words
    beforehand."""
    bound_batches(docs.sparkSession)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def batch_of(ids: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = maximal_runs([_numbered(words) for words in texts])
        kept = [b" ".join(without_repeats(w, r)) for w, r in zip(texts, runs, strict=True)]
        named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()), pa.array(named, schema.field("runs").type), pa.array(kept, pa.binary()).cast(pa.string())],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                words = text.as_py().split()  # at the bytes 9 to 13 and 32
                ids.append(doc_id)
                texts.append(prepare(doc_id, words) if prepare else words)
                held += len(words)
                if held > CHUNK_WORDS:
                    yield batch_of(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield batch_of(ids, texts)

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Plants a loop: where the checksum of the id ends in 0, the words from one place on
    are a part of them over and over.  Without an id the words stay as they are."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    again = words[start : start + period]
    return words[:start] + (again * ((n - start) // period + 1))[: n - start]


def run_report(docs: DataFrame) -> DataFrame:
    """Number and digests of each document's runs, with loops planted by ``looped``, and its longest run."""
    found = collapsed(docs, looped)
    as_text = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("minus"), r.start.alias("start"), r.period.alias("period"))))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.minus")).alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("(-1000 * longest.minus) div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(as_text, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
