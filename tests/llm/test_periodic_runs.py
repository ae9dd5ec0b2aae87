"""Periodic runs, held against every stretch and period tried one by one."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, documents, rows, with_clashes, words
from treesift.llm import periodic_runs as p


def plain_runs(seq):
    n, found = len(seq), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if seq[i] != seq[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and seq[j] == seq[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)  # periods come in order, so the smallest stays
            i = j
    return sorted((i, j - i, q) for (i, j), q in found.items())


def plain_report(doc_id, text):
    seq = words(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and seq:
        g, n = h // 10, len(seq)
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        seq = [w if i < a else seq[a + (i - a) % period] for i, w in enumerate(seq)]
    runs = plain_runs(seq)
    kept = [w for i, w in enumerate(seq) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("letters", [1, 2, 3, 5, 40])
def test_runs_equal_brute_force(letters):
    random.seed(letters)
    docs = []
    for _ in range(150):
        seq = []
        while len(seq) < random.choice((0, 5, 12, 40, 120)):
            part = [random.randrange(letters) for _ in range(random.choice((1, 2, 3, 4, 5, 6, 9, 17)))]
            part = part * random.choice((1, 1, 2, 3, 7))
            seq += part[: max(1, len(part) - random.choice((0, 1, 2)))]
        docs.append(seq)
    found = p.maximal_runs([np.array(d, np.int64) for d in docs])
    assert found == [plain_runs(d) for d in docs]
    assert p.maximal_runs([np.array(docs[0], np.int64)]) == [plain_runs(docs[0])]


def test_words_of_fibonacci_and_powers():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    for seq in (b, [0] * 500, [0, 1] * 200, ([0] * 5 + [1]) * 30, [0, 0, 1] * 20 + [0, 0, 2] * 20):
        assert p.maximal_runs([np.array(seq, np.int64)]) == [plain_runs(seq)]


def test_query_on_a_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 6000)
    out = rows(p.run_report(docs), *COLUMNS)
    plain = sorted((plain_report(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert out == plain
    assert sum(r[1] > 0 for r in out) > 20


def test_loops_are_planted_and_taken_out(spark):
    looped = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = documents(spark, [(i, " ".join(f"w{k}" for k in range(300))) for i in looped])
    out = {r.doc_id: r for r in p.collapsed(docs, p.looped).collect()}
    assert len(out) == len(looped) > 5
    for i, r in out.items():
        n, g = 300, zlib.crc32(str(i).encode()) // 10
        start, period = g % n, 1 + (n - g % n) // (3 + g % 8)
        runs = [tuple(x) for x in r.runs]
        assert runs == ([(start, n - start, period)] if n - start >= max(12, 2 * period) else [])
        changed = [f"w{k if k < start else start + (k - start) % period}" for k in range(n)]
        assert r.collapsed.split() == (changed[: start + period] if runs else changed)


def test_awkward_documents(spark):
    docs = awkward(spark)
    plain = sorted((plain_report(r.doc_id, r.text) for r in docs.where("doc_id <> 6 or doc_id is null").collect()), key=repr)
    assert rows(p.run_report(with_clashes(docs).where("doc_id <> 6 or doc_id is null")), *COLUMNS) == plain
    long = p.run_report(docs.where("doc_id = 6")).collect()[0]
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 60_000, 1, 60_000_000)
    assert p.run_report(docs.where("false")).count() == 0


def test_long_documents_take_time_in_proportion():
    random.seed(5)
    part = [random.randrange(1000) for _ in range(50_000)]
    for seq in (part * 6, [0] * 300_000, part + [0, 1] * 100_000):
        began = time.perf_counter()
        found = p.maximal_runs([np.array(seq, np.int64)])[0]
        assert time.perf_counter() - began < 20
        assert len(found) == 1
