"""Benchmark decontamination by a prefix-filtered set join.

A window is ten consecutive words of a benchmark item (an item of fewer, but
not none, is one window).  A document word is hit if it lies in an exact
occurrence of a window.  The join works on shingles of five words:

* A window is a set of shingles with their places in it.  A document that has
  the window has all of them, so a prefix of one shingle is necessary, and the
  best prefix is the shingle that is rarest over all documents.  The corpus is
  read once to count the shingles of the benchmark in it.
* Every occurrence of a prefix shingle in a document is a candidate.  Its place
  in the window says where the window would begin and end in the document; one
  that begins before the text or ends after it is dropped (positional and
  length bounds).
* What is left is verified word by word over the whole window.

The benchmark is a query set: it is cut into blocks of a fixed number of bytes,
and each block is broadcast and held against all documents in turn, so what is
sent to a task is bounded however large the benchmark is.  Documents are not
shuffled.

Defined results: null or wordless text: no words, not contaminated.  Null or
wordless items have no windows.  Items that repeat an item_id count once in
``n_items``; a null item_id counts as the empty one.  An empty table gives no rows (documents) or no hits (benchmark).
Each input row gives one row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import bound_batches, ids_and_texts, record_batch

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 8 << 20

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, A-Z in lower case; all others split words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STEP = 1_000_003


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


@dataclass
class BenchmarkBlock:
    """The windows of some items.  Words are numbered from 1; 0 is any other word."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[tuple[int, ...], set[str]] = field(default_factory=lambda: defaultdict(set))
    #: For each shingle length, the prefix shingles' sorted hashes, and for each hash its (window, place) pairs.
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    starts: dict[int, dict[int, list[tuple[tuple[int, ...], int]]]] = field(default_factory=dict)

    def add(self, item_id: str, text: str | None) -> None:
        words = words_of(text or "")
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
        for i in range(max(1, len(ids) - WINDOW_WORDS + 1) if ids else 0):
            self.windows[tuple(ids[i : i + WINDOW_WORDS])].add(item_id)

    def shingles(self, window: tuple[int, ...]) -> list[tuple[int, int]]:
        """(hash, place) of the window's shingles; a short window is one shingle."""
        size = min(SHINGLE_WORDS, len(window))
        hashes = rolled(np.array(window, np.int64), size)
        return [(int(h), i) for i, h in enumerate(hashes)]

    def shingle_hashes(self) -> dict[int, np.ndarray]:
        by_size = defaultdict(set)
        for w in self.windows:
            by_size[min(SHINGLE_WORDS, len(w))].update(h for h, _ in self.shingles(w))
        return {k: np.array(sorted(v), np.int64) for k, v in by_size.items()}

    def choose_prefixes(self, frequency: dict[tuple[int, int], int]) -> None:
        """Keep each window's rarest shingle as its prefix."""
        starts: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for window in self.windows:
            size = min(SHINGLE_WORDS, len(window))
            h, place = min(self.shingles(window), key=lambda x: (frequency.get((size, x[0]), 0), x[0], x[1]))
            starts[size][h].append((window, place))
        self.starts = {k: dict(v) for k, v in starts.items()}
        self.keys = {k: np.array(sorted(v), np.int64) for k, v in starts.items()}


def rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive numbers, -1 where one of them is 0."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    known = np.ones(n, bool)
    for k in range(size):
        part = ids[k : k + n]
        out = out * _STEP + part
        known &= part > 0
    out &= np.iinfo(np.int64).max
    out[~known] = -1
    return out


def _found(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in ``hashes`` whose value is one of the sorted ``keys``."""
    places = np.flatnonzero(hashes >= 0)
    at = np.searchsorted(keys, hashes[places])
    return places[keys[np.minimum(at, len(keys) - 1)] == hashes[places]]


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[BenchmarkBlock]:
    """The items in blocks of at most ``block_bytes`` (or one item) of text, one at a time."""
    block, held = BenchmarkBlock(), 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        size = len((row[1] or "").encode())
        if held and held + size > block_bytes:
            yield block
            block, held = BenchmarkBlock(), 0
        if row[0] is not None or row[1] is not None:
            block.add(row[0] or "", row[1])
        held += size
    yield block


def _numbered(block: BenchmarkBlock, text: str) -> tuple[int, np.ndarray | None]:
    """The number of words, and their numbers if any two neighbours are known."""
    words = words_of(text)
    get = block.vocabulary.get
    ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    return len(words), ids if ids.any() else None


def shingle_frequencies(docs: DataFrame, block: BenchmarkBlock) -> dict[tuple[int, int], int]:
    """How often each shingle of the block occurs in all documents."""
    hashes = block.shingle_hashes()
    shared = docs.sparkSession.sparkContext.broadcast((block.vocabulary, hashes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BenchmarkBlock(vocabulary=shared.value[0])
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                ids = _numbered(own, text)[1]
                if ids is None:
                    continue
                for size, keys in shared.value[1].items():
                    h = rolled(ids, size)
                    seen.update((size, x) for x in h[_found(h, keys)].tolist())
        schema = pa.schema([("size", pa.int32()), ("hash", pa.int64()), ("n", pa.int64())])
        yield record_batch(schema, [k[0] for k in seen], [k[1] for k in seen], list(seen.values()))

    counts = docs.select("text").mapInArrow(count, "size int, hash long, n long").groupBy("size", "hash").agg(F.sum("n").alias("n"))
    return {(r["size"], r["hash"]): r["n"] for r in counts.toLocalIterator()}


def _occurrences(block: BenchmarkBlock, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
    spans, items = [], set()
    for size, keys in block.keys.items():
        h = rolled(ids, size)
        for p in _found(h, keys).tolist():
            for window, place in block.starts[size][int(h[p])]:
                begin, end = p - place, p - place + len(window)
                if begin >= 0 and end <= len(ids) and tuple(ids[begin:end].tolist()) == window:
                    spans.append((begin, end))
                    items |= block.windows[window]
    return spans, items


def hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns of ``docs`` (doc_id, text) with n_words, spans (flat list of word
    begins and ends) and items; the blocks of the benchmark add to these in turn."""
    bound_batches(docs.sparkSession)
    out = ids_and_texts(docs).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    for block in benchmark_blocks(benchmark, block_bytes):
        block.choose_prefixes(shingle_frequencies(ids_and_texts(docs), block))
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                texts, spans, items = batch.column("text"), batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                n_words = []
                for i, text in enumerate(texts.to_pylist()):
                    n, ids = _numbered(own, text)
                    n_words.append(n)
                    if ids is not None:
                        more, of = _occurrences(own, ids)
                        spans[i] = spans[i] + [x for s in more for x in s]
                        items[i] = sorted({*items[i], *of})
                yield record_batch(batch.schema, batch.column("doc_id"), texts, n_words, spans, items)

        out = out.mapInArrow(find, out.schema)
    return out


def decontamination_report(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string()))])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, digests = [], []
            items = batch.column("items").to_pylist()
            for spans, of in zip(batch.column("spans").to_pylist(), items, strict=True):
                hit, upto = 0, 0
                for begin, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
                    hit += max(0, end - max(begin, upto))
                    upto = max(upto, end)
                n_hit.append(hit)
                digests.append(hashlib.sha256(",".join(of).encode()).hexdigest())
            yield record_batch(schema, batch.column("doc_id"), batch.column("n_words"), n_hit, [len(x) for x in items], digests, [h > 0 for h in n_hit], items)

    kinds = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    return hits(docs, benchmark, block_bytes).drop("text").mapInArrow(sum_up, kinds)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no window hits.

    The whole rows pass through the search, so no join brings text and verdict
    together.  Column names of the input may repeat."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index("text")
    key = docs.columns.index("doc_id")
    plain = docs.toDF(*names)
    held = plain.select(F.struct(*names).alias("row"), F.col(names[key]).alias("doc_id"), F.col(names[place]).alias("text"))
    bound_batches(docs.sparkSession)
    out = held.select("row", F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("hit"))
    for block in benchmark_blocks(benchmark, block_bytes):
        block.choose_prefixes(shingle_frequencies(ids_and_texts(held), block))
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                clean = []
                for text in batch.column("text").to_pylist():
                    ids = _numbered(own, text)[1]
                    clean.append(ids is None or not _occurrences(own, ids)[0])
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(find, out.schema)
    return out.select(*[F.col(f"row.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)])
