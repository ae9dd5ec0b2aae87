"""Token ids of documents as Parquet files with list columns.

Documents are dealt out by ranges of doc_id, sorted, encoded, and written by
Spark's Parquet writer with

* delta encoding of integers (version 2 pages, no dictionary) for doc_id and
  offsets, and the same for ids, whose narrow range packs into few bits,
* zstd over that, row groups and pages of controlled size,
* page indexes, which the writer adds, so a reader that asks for some doc_ids
  reads only the pages that hold them.

A file is (part, doc_id, n_tokens, start_in_part, ids); parts are in order, so
an offset over all documents needs one number per part, which is read from the
metadata columns alone.

Encoding cuts the texts of a batch at places where the tokenizer's own pattern
always begins a new word, finds the distinct pieces, and asks the tokenizer for
those whose ids it does not remember.  What is remembered is an Arrow array of
pieces beside an array of their ids, bounded in bytes; long pieces are not kept,
and those not seen for longest go first.  A text with the name of a special
token is one piece, and so is every text under a tokenizer of another pattern.

Defined results: a null text is empty; an empty text has the end id alone.
Documents with the same doc_id are put in order of their texts.  A null doc_id
comes first.  No rows: no files but an empty one, no rows.  Other columns of
the input are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treesift.llm.common import bound_batches, fresh_path, ids_and_texts, kept, record_batch

END_ID = 0
#: Writer settings: bytes of a row group and of a page.
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Bytes of text in one part, about.
PART_BYTES = 32 << 20
#: Bytes of pieces and ids that a worker remembers, and the longest piece among them.
REMEMBERED_BYTES = 24 << 20
LONGEST_REMEMBERED = 64
#: Bytes of text that a worker encodes at once; a longer text goes alone.
BYTES_AT_ONCE = 4 << 20
#: Characters of a text that decide about its part beside its doc_id, so that an id of very many rows is split.
TEXT_KEY = 64
#: Parts up to this number are broadcast with their offsets when files are read.
BROADCAST_PARTS = 1_000_000
#: Parts whose offsets are summed in one task.
PARTS_IN_BLOCK = 1024

_LETTER, _DIGIT, _SIGN, _BLANK, _LINE, _SPACE, _OTHER = range(7)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _SIGN, np.uint8)
    for b in range(128):
        out[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN
    out[128:] = _OTHER
    out[[9, 11, 12, 13, 28, 29, 30, 31]] = _SPACE
    out[32], out[10] = _BLANK, _LINE
    return out


def _border_pairs() -> np.ndarray:
    """Neighbouring classes between which a word always ends."""
    out = np.zeros((7, 7), bool)
    out[:3, :3] = ~np.eye(3, dtype=bool)
    for before in (_LETTER, _DIGIT, _SIGN, _OTHER):
        out[before, [_BLANK, _LINE]] = True
    return out.ravel()


_CLASSES, _BORDERS = _byte_classes(), _border_pairs()
#: First bytes of two-byte characters that are all letters, but for the two signs below.
_LETTER_LEADS = np.zeros(256, bool)
_LETTER_LEADS[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True
_TIMES, _DIVIDED = 0x97, 0xB7
#: The UTF-8 codes of white space outside ASCII.
_WIDE_SPACES = np.array([int.from_bytes(c.encode()) for c in "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"])
_JOINABLE = re.compile(r" ?\S+")


def classes_of(data: np.ndarray) -> np.ndarray:
    """The class of each byte; a letter of more bytes has it on each of them, and
    white space outside ASCII at least on its last."""
    out = _CLASSES[data]
    if not len(data) or data.max() < 128:
        return out
    lead = np.flatnonzero(_LETTER_LEADS[data])
    lead = lead[(data[lead] != 0xC3) | (data[lead + 1] != _TIMES) & (data[lead + 1] != _DIVIDED)]
    out[lead] = out[lead + 1] = _LETTER
    two = np.flatnonzero(data == 0xC2)
    out[two[(data[two + 1] == 0x85) | (data[two + 1] == 0xA0)] + 1] = _SPACE
    three = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
    wide = data[three].astype(np.int64) << 16 | data[three + 1].astype(np.int64) << 8 | data[three + 2]
    out[three[np.isin(wide, _WIDE_SPACES)] + 2] = _SPACE
    return out


def borders(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each place in the bytes of texts that lie one after another, and the end,
    whether the pattern of byte-level tokenizers begins a word there whatever stands
    around it.  White space before a word gives its last blank to the word and is a
    word without it; a line feed before a word stands alone."""
    n = len(data)
    out = np.zeros(n + 1, bool)
    if n:
        first = np.zeros(n + 1, bool)
        first[starts] = True
        kind = classes_of(data)
        out[1:n] = _BORDERS[kind[:-1] * np.uint8(7) + kind[1:]]
        mark = np.flatnonzero(data[:-1] == 0x27)
        out[mark[kind[mark + 1] == _LETTER] + 1] = False  # 's and the like
        space = np.flatnonzero((kind[:-1] == _BLANK) | (kind[:-1] == _LINE))
        space = space[(kind[space + 1] <= _SIGN) & ~first[space + 1]]
        before = kind[space - 1]
        out[space[(before == _BLANK) | (before == _LINE)]] = True
        out[space[kind[space] == _LINE] + 1] = True
    out[starts] = True
    return out


def _gathered(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``begins``, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class PieceEncoder:
    """Token ids of texts, by the ids of their pieces."""

    def __init__(self, path: str, remembered_bytes: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), remembered_bytes
        rules = json.loads(self.tokenizer.to_str())
        cut = rules["pre_tokenizer"] or {}
        self.cuts = not rules["normalizer"] and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_feed = self._ids("\n")
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.turn = pa.array([], pa.binary()), 0
        self.begins, self.sizes, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, sizes) of new pieces.  Words with at most a blank before them
        go to the tokenizer in rows, with line feeds between that stay alone."""
        texts = [p.decode() for p in pieces]
        row = [i for i, t in enumerate(texts) if len(t) <= LONGEST_REMEMBERED and _JOINABLE.fullmatch(t)] if self.cuts and len(self.line_feed) == 1 else []
        begins, sizes = np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int64)
        found, n = [np.zeros(0, np.uint32)], 0
        for first in range(0, len(row), 20_000):
            some = row[first : first + 20_000]
            ids = self._ids("\n".join([texts[i] for i in some]) + "\n")
            ends = np.flatnonzero(ids == self.line_feed[0])
            if len(ends) == len(some):
                starts = np.concatenate(([0], ends[:-1] + 1))
                begins[some], sizes[some] = n + starts, ends - starts
                found.append(ids)
                n += len(ids)
        for i in np.flatnonzero(sizes < 0).tolist():
            found.append(self._ids(texts[i]))
            begins[i], sizes[i] = n, len(found[-1])
            n += len(found[-1])
        return np.concatenate(found), begins, sizes

    def _remember(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Take in new pieces; over the bound, keep those seen last, up to half of it."""
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        self.used = np.concatenate([self.used, np.full(len(sizes), self.turn)])
        cost = pc.binary_length(self.pieces).to_numpy() + 4 * self.sizes + 28
        if cost.sum() <= self.limit:
            return
        newest = np.argsort(-self.used, kind="stable")
        keep = np.sort(newest[np.cumsum(cost[newest]) <= self.limit // 2])
        self.pieces, self.used = self.pieces.take(pa.array(keep)), self.used[keep]
        self.ids = _gathered(self.ids, self.begins[keep], self.sizes[keep])
        self.sizes = self.sizes[keep]
        self.begins = np.cumsum(self.sizes) - self.sizes

    def _ids_of(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, sizes): the ids of each of ``distinct``, none of them twice."""
        at = pc.index_in(distinct, value_set=self.pieces).fill_null(-1).to_numpy()
        old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        self.turn += 1
        self.used[at[old]] = self.turn
        pieces = distinct.take(pa.array(new))
        ids, begins, sizes = self._learn(pieces.to_pylist())
        all_begins, all_sizes = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        all_begins[old], all_sizes[old] = self.begins[at[old]], self.sizes[at[old]]
        all_begins[new], all_sizes[new] = begins + len(self.ids), sizes
        every = np.concatenate([self.ids, ids])
        short = np.flatnonzero(pc.binary_length(pieces).to_numpy() <= LONGEST_REMEMBERED)
        self._remember(pieces.take(pa.array(short)), _gathered(ids, begins[short], sizes[short]), sizes[short])
        return every, all_begins, all_sizes

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, how many of each), with ``end_id`` after each."""
        texts = texts.cast(pa.large_string())
        starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
        starts = starts - starts[0]
        if self.cuts:
            border = borders(data, starts)
            for name in self.special:
                for i in np.flatnonzero(pc.match_substring(texts, name).to_numpy(zero_copy_only=False)):
                    border[starts[i] + 1 : starts[i + 1]] = False
            places = np.flatnonzero(border)
        else:
            places = np.unique(starts)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        ids, begins, sizes = self._ids_of(pieces.dictionary.cast(pa.binary()))
        which = pieces.indices.to_numpy()
        flat = _gathered(ids, begins[which], sizes[which])
        before = np.concatenate(([0], np.cumsum(sizes[which])))[np.searchsorted(places, starts)]
        n_tokens = np.diff(before)
        if end_id is None:
            return flat, n_tokens
        out = np.full(len(flat) + len(texts), end_id, np.uint32)
        text = np.ones(len(out), bool)
        text[before[1:] + np.arange(len(texts))] = False
        out[text] = flat
        return out, n_tokens + 1


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each tokenizer file and worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def release_encoders() -> None:
    """Free what a worker that has encoded still holds; reading has no use for it."""
    _encoders.clear()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` again, in runs of about BYTES_AT_ONCE bytes of text, one row at least."""
    held: list[pa.RecordBatch] = []
    n_held = 0

    def flush() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
        first = 0
        while first < batch.num_rows:
            room = BYTES_AT_ONCE - n_held + (sizes[first - 1] if first else 0)
            last = int(np.searchsorted(sizes, room, "right"))
            if last == first and held:
                yield flush()
                held, n_held = [], 0
                continue
            last = max(last, first + 1)
            held.append(batch.slice(first, last - first))
            n_held += int(sizes[last - 1] - (sizes[first - 1] if first else 0))
            first = last
            if n_held >= BYTES_AT_ONCE:
                yield flush()
                held, n_held = [], 0
    if held:
        yield flush()


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write the files to the folder ``out``."""
    texts = ids_and_texts(docs)
    bound_batches(docs.sparkSession)
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(8, n_bytes / PART_BYTES))
    key = F.col("doc_id").asc_nulls_first()
    ordered = (
        texts.repartitionByRange(parts, key, F.substring("text", 1, TEXT_KEY))
        .sortWithinPartitions(key, "text")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("start_in_part", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = encoder(tokenizer_path), 0
        for batch in _slices(batches):
            ids, sizes = own.encode(batch.column("text"), end_id)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.view(np.int32)))
            yield record_batch(schema, batch.column("part"), batch.column("doc_id"), pa.array(sizes), pa.array(before + ends - sizes), lists)
            before += int(ends[-1])

    (
        ordered.mapInArrow(encode, "part int, doc_id long, n_tokens long, start_in_part long, ids array<int>")
        .write.option("parquet.enable.dictionary", "false")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.page.row.count.limit", "2000")
        .option("compression", "zstd")
        .parquet(out)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before."""
    files = spark.read.schema("part int, doc_id long, n_tokens long, start_in_part long, ids array<int>").parquet(path)
    sums = kept(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.expr(f"part div {PARTS_IN_BLOCK}")), "parts")
    so_far = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("block").agg(F.sum("n").alias("n")).select("block", so_far(Window.orderBy("block")).alias("of_blocks"))
    offsets = sums.withColumn("in_block", so_far(Window.partitionBy("block").orderBy("part"))).join(blocks, "block").select("part", (F.col("of_blocks") + F.col("in_block")).alias("before"))
    if sums.count() <= BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    return files.join(offsets, "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def with_checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read_token_files`` gives."""
    bound_batches(tokens.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4"))).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            sizes = np.diff(at).astype(np.int64)
            yield record_batch(schema, batch.column("doc_id"), batch.column("start"), pa.array(sizes), sums)

    return tokens.select("doc_id", "start", "ids").mapInArrow(add, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_report(docs: DataFrame, tokenizer_path: str, out: str | None = None) -> DataFrame:
    """Write the files, read them back, and report on every document in them."""
    out = out or fresh_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer_path, out)
    return with_checksums(read_token_files(docs.sparkSession, out))
