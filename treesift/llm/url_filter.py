"""URL filters by a sorted digest array.

A list entry is a host and the beginning of a path, written together
(``example.net/en/``).  It fits its host and all subdomains, if the url's path
begins with the entry's.  The list is an array of 64-bit xxhash keys in order,
with a table of the full strings beside it.  Spark deals the list out by ranges
of keys, and each task writes its part as files into the shared folder; nothing
of it goes through the driver but a line for each part.  Workers map the files
into memory, so that they touch only the pages that their probes need (from a
store that is not mounted a worker copies them first).

For a batch of urls, every string that an entry could equal is made (suffixes
of the host and beginnings of the path, of the pairs of lengths that the list
has, so that a long url makes no more than a short one), hashed, and probed in
one vectorised binary search.  A key that is found counts only if the stored
string is equal.

Rules and the block list are entries of the same array: of the rules that fit
the longest wins (then the one that sorts first); without a rule a url is
blocked if an entry of the block list fits, and else allowed.

Defined results: host and path are empty for a null url or one without
``://``; such a url is allowed.  Repeated rows give equal results, empty tables
none; other columns are not read.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow.fs import FileSystem, LocalFileSystem, copy_files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.llm.common import bound_batches, fresh_path, kept, record_batch

#: The seed of Spark's own xxhash64, so that Spark can make and sort the keys.
SEED = 42
ALLOW, BLOCK, LISTED = 0, 1, 2
#: Entries that one part of the array holds, about, and the files of a part.
ENTRIES_IN_PART = 2_000_000
KINDS_OF_FILES = ("keys", "ends", "strings")
#: The rules of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The block list of the query: sites of advertising, adult content, betting, pills and links.
BLOCK_LIST = tuple(
    f"{name}.example.{top}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")
)

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")


def host_and_path(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = _HOST_END.search(rest)
    at = end.start() if end else len(rest)
    return rest[:at].translate(_UPPER), _PATH_END.split(rest[at:], maxsplit=1)[0]


def key_of(text: str, bits: int = 64) -> int:
    value = xxhash.xxh64_intdigest(text.encode(), SEED)
    return ((value + (1 << 63)) % (1 << 64)) >> (64 - bits)  # in the order of signed numbers


@dataclass(frozen=True)
class DigestFiles:
    """Where the parts of the array are, the least key of each, and for each length of
    a host in the list the lengths of the paths beside it."""

    folder: str
    names: tuple[str, ...]
    least: tuple[int, ...]
    shapes: dict[int, tuple[int, ...]]
    bits: int = 64


def entries(spark: SparkSession, rules=RULES, block_list=BLOCK_LIST) -> DataFrame:
    """(entry, kind) of a list in memory; longer ones come as tables of these columns."""
    rows = [(e, ALLOW if v == "allow" else BLOCK) for e, v in rules] + [(e, LISTED) for e in block_list]
    return spark.createDataFrame(rows, "entry string, kind int")


def publish(table: DataFrame, bits: int = 64) -> DigestFiles:
    """Sort the list (entry, kind) by key on Spark and write it in parts to the shared folder."""
    spark = table.sparkSession
    host, path = F.substring_index("entry", "/", 1), F.expr("substring(entry, length(substring_index(entry, '/', 1)) + 1)")
    ready = table.where("entry is not null").select(F.concat(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path).alias("entry"), "kind").distinct()
    ready = kept(ready, "entries")
    shapes: dict[int, tuple[int, ...]] = {}
    for r in ready.select(F.length(host).alias("h"), F.length(path).alias("p")).distinct().orderBy("h", "p").collect():  # pairs of lengths
        shapes[r["h"]] = (*shapes.get(r["h"], ()), r["p"])
    folder = fresh_path(spark, "digests")
    parts = 1 + ready.count() // ENTRIES_IN_PART
    dealt = ready.repartitionByRange(parts, F.xxhash64("entry")).sortWithinPartitions(F.xxhash64("entry"), "entry", "kind").withColumn("part", F.spark_partition_id())
    schema = pa.schema([("part", pa.int32()), ("name", pa.string()), ("least", pa.decimal128(20, 0))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ends, strings = [], [np.zeros(1, np.int64)], []
        at, part = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            rows = [bytes([k]) + e.encode() for e, k in zip(batch.column("entry").to_pylist(), batch.column("kind").to_pylist(), strict=True)]
            keys.append(np.fromiter((key_of(r[1:].decode(), bits) for r in rows), np.uint64, len(rows)))
            ends.append(at + np.cumsum([len(r) for r in rows], dtype=np.int64))
            at += sum(map(len, rows))
            strings += rows
        if at:
            name, (store, root) = uuid.uuid4().hex, FileSystem.from_uri(folder)  # a name of its own for every attempt
            store.create_dir(root, recursive=True)
            for kind, data in zip(KINDS_OF_FILES, (np.concatenate(keys).tobytes(), np.concatenate(ends).tobytes(), b"".join(strings)), strict=True):
                with store.open_output_stream(f"{root}/{name}.{kind}") as out:
                    out.write(data)
            yield record_batch(schema, [part], [name], [int(keys[0][0])])

    written = sorted((r["part"], r["name"], int(r["least"])) for r in dealt.mapInArrow(write, "part int, name string, least decimal(20,0)").collect())
    return DigestFiles(folder, tuple(n for _, n, _ in written), tuple(k for _, _, k in written), shapes, bits)


class DigestArray:
    def __init__(self, files: DigestFiles):
        self.shapes, self.bits = files.shapes, files.bits
        self.least = np.array(files.least, np.uint64)
        store, root = FileSystem.from_uri(files.folder)
        if not isinstance(store, LocalFileSystem):
            local = tempfile.mkdtemp(prefix="digests-")  # a copy for this worker alone
            copy_files(root, local, source_filesystem=store)
            root = local
        self.parts = [tuple(np.memmap(f"{root}/{n}.{k}", t, "r") for k, t in zip(KINDS_OF_FILES, (np.uint64, np.int64, np.uint8), strict=True)) for n in files.names]

    def candidates(self, host: str, path: str) -> list[str]:
        """Every string that an entry would have to equal to fit."""
        out = []
        for length, paths in self.shapes.items():
            at = len(host) - length
            if at == 0 or at > 0 and host[at - 1] == ".":
                out += [host[at:] + path[:n] for n in paths if n <= len(path)]
        return out

    def find(self, texts: list[str]) -> list[tuple[int, int]]:
        """(place in ``texts``, kind) of every entry that equals one of them."""
        if not texts or not self.parts:
            return []
        keys = np.fromiter((key_of(t, self.bits) for t in texts), np.uint64, len(texts))
        out = []
        low, high = np.searchsorted(self.least, keys, "left"), np.searchsorted(self.least, keys, "right")
        for p, (stored_keys, ends, strings) in enumerate(self.parts):
            mine = np.flatnonzero((np.maximum(low, 1) - 1 <= p) & (p < high))  # more than one part where equal keys are dealt to several
            first, last = np.searchsorted(stored_keys, keys[mine], "left"), np.searchsorted(stored_keys, keys[mine], "right")
            for k in np.flatnonzero(last > first).tolist():
                i = int(mine[k])
                want = texts[i].encode()
                for j in range(int(first[k]), int(last[k])):  # more than one where keys collide
                    stored = strings[ends[j] : ends[j + 1]].tobytes()
                    if stored[1:] == want:
                        out.append((i, stored[0]))
        return out


_open: dict[str, DigestArray] = {}


def _array(files: DigestFiles) -> DigestArray:
    if files.folder not in _open:
        _open[files.folder] = DigestArray(files)
    return _open[files.folder]


def url_report(pages: DataFrame, files: DigestFiles) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page; ``listed`` is
    the entry of the block list that fits, whether or not a rule decides."""
    bound_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "verdict", "listed"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _array(files)
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column("url").to_pylist()]
            texts, owner = [], []
            for i, (host, path) in enumerate(parts):
                more = array.candidates(host, path)
                texts += more
                owner += [i] * len(more)
            rule: list[tuple | None] = [None] * len(parts)
            listed: list[str | None] = [None] * len(parts)
            for at, kind in array.find(texts):
                i, entry = owner[at], texts[at]
                if kind == LISTED:
                    listed[i] = max(listed[i] or "", entry, key=lambda e: (len(e), e))
                elif rule[i] is None or (-len(entry), entry, kind) < rule[i]:
                    rule[i] = (-len(entry), entry, kind)
            verdict = [("block", "allow")[r[2] == ALLOW] if r else "block" if x else "allow" for r, x in zip(rule, listed, strict=True)]
            yield record_batch(schema, batch.column("page_id"), [h for h, _ in parts], [p for _, p in parts], [r and r[1] for r in rule], verdict, listed)

    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, listed string")
