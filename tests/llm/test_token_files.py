import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, documents, rows, with_clashes
from treesift.llm import token_files
from treesift.llm.common import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")
PARTS = ["a", "B", " ", " ", "\n", "é", "ñ", "1", "22", ".", "!!", "'s", "don't", "\t", "漢", "😀", "\x00", "\x1c", "|", "thing", "  ", "\xa0", "<|endoftext|>", "\u0301", "\r\n"]


def encoded(own, texts):
    ids, sizes = own.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(sizes)
    return [ids[e - n : e].tolist() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def test_pieces_give_the_tokenizers_ids():
    own, plain, rng = token_files.PieceEncoder(PATH), Tokenizer.from_file(PATH), random.Random(4)
    texts = ["", " ", "a", "a\n", " a", "a  b\n\nc "] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from memory
        for text, ids, true in zip(texts, encoded(own, texts), want, strict=True):
            assert ids == true, text
    assert encoded(own, []) == [] and encoded(own, ["", ""]) == [[], []]


@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r'stanz1.,\xa0\x85\u3000\u2003éÉßяЖ×÷ªıé漢"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
@settings(max_examples=400, deadline=None)
def test_any_texts_give_the_tokenizers_ids(texts):
    plain = Tokenizer.from_file(PATH) if not hasattr(test_any_texts_give_the_tokenizers_ids, "plain") else test_any_texts_give_the_tokenizers_ids.plain
    test_any_texts_give_the_tokenizers_ids.plain = plain
    assert encoded(token_files.encoder(PATH), texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_end_id_and_tokenizers_of_other_patterns():
    own, plain = token_files.PieceEncoder(PATH), Tokenizer.from_file(PATH)
    ids, sizes = own.encode(pa.array(["a b", "", "c"]), 0)
    assert ids.tolist() == plain.encode("a b").ids + [0, 0] + plain.encode("c").ids + [0] and sizes.tolist() == [3, 1, 2]
    other = tokenizer_file("word_bpe_49k.json")
    own, plain = token_files.PieceEncoder(other), Tokenizer.from_file(other)
    texts = ["One  two, THREE\n", "", "it's 22 漢字"]
    assert not own.cuts and encoded(own, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def held_bytes(own):
    return own.pieces.nbytes + own.ids.nbytes + own.begins.nbytes + own.sizes.nbytes + own.used.nbytes


def test_memory_is_bounded_and_adapts():
    own, plain = token_files.PieceEncoder(PATH, 20_000), Tokenizer.from_file(PATH)
    for round_ in range(8):
        texts = [" ".join(f"w{round_}a{i}x{j}" for j in range(30)) for i in range(20)]
        assert encoded(own, texts) == [plain.encode(t).ids for t in texts]
        assert held_bytes(own) <= 20_000
    assert b"x29" not in own.pieces.to_pylist() and any(p.startswith(b"w") or p == b" w" for p in own.pieces.to_pylist())


def test_texts_without_blanks_are_not_remembered():
    rng = random.Random(9)
    own = token_files.PieceEncoder(PATH)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(2000)) for _ in range(1000)]
    own.encode(pa.array(texts))
    assert held_bytes(own) < 100_000


def brute(docs):
    plain, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode())):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "start", "n_tokens", "ids_crc32")


def test_query_against_brute_force(spark, sf_dir):
    from treesift.llm.queries import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(queries()["op6_token_files"](spark, sf_dir), *COLUMNS) == brute(docs)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = rows(token_files.token_file_report(with_clashes(docs), PATH), *COLUMNS)
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert token_files.token_file_report(docs.limit(0), PATH).count() == 0


def test_file_format_and_selective_read(spark, tmp_path):
    docs = documents(spark, [(i, f"text number {i} " * (i % 7)) for i in range(3000)])
    out = str(tmp_path / "ids")
    token_files.write_token_files(docs, PATH, out)
    meta = [pq.ParquetFile(f).metadata for f in (tmp_path / "ids").glob("*.parquet")]
    columns = [m.row_group(0).column(i) for m in meta if m.num_rows for i in range(m.num_columns)]
    assert all(c.has_offset_index and c.has_column_index for c in columns)
    assert all("DELTA_BINARY_PACKED" in c.encodings for c in columns) and all(c.compression == "ZSTD" for c in columns)
    some = token_files.read_token_files(spark, out).where("doc_id between 100 and 102")
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(doc_id,100)" in plan
    plain = Tokenizer.from_file(PATH)
    assert {r["doc_id"]: list(r["ids"]) for r in some.collect()} == {i: plain.encode(f"text number {i} " * (i % 7)).ids + [0] for i in (100, 101, 102)}


def test_slices_hold_every_row_once_and_few_bytes():
    most = token_files.BYTES_AT_ONCE
    schema = pa.schema([("n", pa.int64()), ("text", pa.string())])
    for sizes in ([], [0], [most + 1], [0, most, 1, most + 5, 0, 3], [most // 3] * 10, [0] * 1000):
        for step in (1, 3, 1000):
            rows_ = list(enumerate(sizes))
            batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in b]), pa.array(["x" * n for _, n in b])], schema=schema) for b in (rows_[k : k + step] for k in range(0, len(rows_), step))]
            runs = list(token_files._slices(iter(batches)))
            assert [i for r in runs for i in r.column("n").to_pylist()] == list(range(len(sizes)))
            assert all(r.num_rows == 1 or sum(sizes[i] for i in r.column("n").to_pylist()) <= most for r in runs)


def test_one_id_of_many_rows_is_split_and_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 2000)
    texts = [f"{i * 7919 % 400:04d} some words" for i in range(400)]
    out = str(tmp_path / "ids")
    token_files.write_token_files(documents(spark, [(5, t) for t in texts] + [(6, "end")]), PATH, out)
    parts = spark.read.parquet(out).where("doc_id = 5").select("part").distinct().count()
    got = [(r["start"], r["n_tokens"], list(r["ids"])) for r in token_files.read_token_files(spark, out).orderBy("start").collect()]
    plain, start = Tokenizer.from_file(PATH), 0
    assert parts > 2
    for (at, n, ids), text in zip(got, [*sorted(texts), "end"], strict=True):
        assert (at, n, ids) == (start, len(ids), plain.encode(text).ids + [0])
        start += n
