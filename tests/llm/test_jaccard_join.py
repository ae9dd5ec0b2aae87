import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ascii_lower, awkward, documents, rows, with_clashes, words
from treesift.llm import jaccard_join
from treesift.llm.components import components


def shingles(text):
    w = words(ascii_lower(text))
    return set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def check(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(documents(spark, list(texts.items()))).collect()}
    assert got == brute(texts)


def near_copies(seed, n, length, most):
    """Copies with up to ``most`` words changed, so that many pairs lie at the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10_000)}" for _ in range(length)]
    out = {}
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(length)] = f"x{rng.randint(0, 10_000)}"
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_at_the_threshold(spark, seed):
    texts = near_copies(seed, 60, 120, 4)
    texts |= {100 + i: t for i, t in near_copies(seed + 50, 40, 30, 2).items()}
    texts |= {200: texts[0], 201: texts[0].upper(), 202: "a b c", 203: "A  b\nc", 204: "a b", 205: None, 206: ""}
    check(spark, texts)


def test_common_passage_does_not_link(spark):
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = {i: passage + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.choice((6, 12, 60)))) for i in range(80)}
    check(spark, texts)


def test_lists_too_long_for_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 3)
    monkeypatch.setattr(jaccard_join, "PIVOT_ROUNDS", 2)
    check(spark, near_copies(9, 50, 100, 4))


def test_hot_shingles_are_one_entry_of_a_block():
    """A passage in all documents is dealt out once for each block, whatever its documents."""
    rng = np.random.default_rng(3)
    for n_docs in (50, 500):
        own = [np.unique(np.concatenate([np.arange(100, 140, dtype=np.uint64) << np.uint64(50), rng.integers(0, 1 << 60, 20, dtype=np.uint64)])) for _ in range(n_docs)]
        n = np.array([len(x) for x in own])
        rows_ = jaccard_join.block_rows(np.concatenate(own), n, np.arange(n_docs), n, 5, 96, 60).to_pylist()
        often = np.concatenate([jaccard_join.unpack_sorted(r["often"]) for r in rows_])
        runs = np.concatenate([jaccard_join.unpack(r["runs"], np.uint32) for r in rows_])
        assert len(often) == 40 and (runs == n_docs).all()
        assert sum(len(jaccard_join.unpack_sorted(r["tokens"])) for r in rows_) == 20 * n_docs
        assert sum(r["home"] is not None for r in rows_) == 1


def test_cost_of_a_block_does_not_grow_with_the_number_of_ranges():
    rng = np.random.default_rng(4)
    tokens = np.unique(rng.integers(0, 1 << 60, 200_000, dtype=np.uint64))
    n = np.full(len(tokens) // 100, 100)
    tokens = tokens[: n.sum()]
    sets = np.concatenate([np.sort(x) for x in np.split(rng.permutation(tokens), len(n))])
    took = {}
    for n_ranges in (96, 80_000, 8_000_000):
        began = time.process_time()
        batch = jaccard_join.block_rows(sets, n, np.arange(len(n)), n, 7, n_ranges, 60)
        took[n_ranges] = time.process_time() - began
        assert batch.num_rows <= min(n_ranges, len(tokens) + 1)
    assert took[8_000_000] < 20 * len(tokens) * 1e-6 + 5, took


def test_boilerplate_in_all_documents(spark, monkeypatch):
    """One shingle sequence that all share, in short and long documents, beside near copies."""
    monkeypatch.setattr(jaccard_join, "SHARE_LIST", 10)
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 4)
    rng = random.Random(8)
    boiler = " ".join(f"b{i}" for i in range(8))
    texts = {i: f"{boiler} " + " ".join(f"u{rng.randint(0, 40)}" for _ in range(rng.choice((0, 1, 2, 8)))) for i in range(70)}
    texts |= {100 + i: f"{t} {boiler}" for i, t in near_copies(3, 15, 60, 2).items()}
    check(spark, texts)


def test_query_against_brute_force(spark, sf_dir):
    from treesift.llm.queries import queries

    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries()["op2_ngram_jaccard"](spark, sf_dir).collect()}
    assert got == brute(texts)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = rows(jaccard_join.jaccard_components(with_clashes(docs)), "doc_id", "n_shingles", "component_id")
    assert len(got) == docs.count()
    assert [g for g in got if g[0] == 4] == [(4, 1, 4), (4, 1, 4)]
    assert (9, 1, 8) in got and (2, 0, 2) in got and (None, 1, None) in got
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    kept = jaccard_join.without_near_duplicates(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    assert ids == [1, 2, 3, 4, 5, 6, 7, 8, 10]


def test_one_row_of_each_component_stays(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(100)) for k in "abcdef"}
    near = {k: t + " more" for k, t in text.items()}
    docs = [
        (1, text["a"]), (7, near["a"]), (7, text["b"]), (7, text["c"]), (7, text["c"]),  # a repeated id: one row goes with 1, the others stay
        (None, text["d"]), (None, near["d"]), (None, text["d"]), (9, near["c"]),
        (None, text["e"]), (3, near["e"]), (None, text["f"]), (None, None), (None, ""), (None, ""), (8, " "), (8, " "),
    ]
    got = [(r["doc_id"], r["text"]) for r in jaccard_join.without_near_duplicates(documents(spark, docs)).collect()]
    d = [t for i, t in got if i is None and t in (text["d"], near["d"])]
    assert len(d) == 1
    want = [(1, text["a"]), (7, text["b"]), (7, text["c"]), (None, d[0]), (3, near["e"]), (None, text["f"]), (None, None), (None, ""), (None, ""), (8, " "), (8, " ")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201), (201, 202)], "a long, b long")
    got = {r["id"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(71)} | {200: 200, 201: 200, 202: 200}
    assert components(edges.limit(0)).count() == 0


def test_rows_whose_hashes_meet_stay_apart(spark):
    rows_ = [(i % 150, f"text {i % 150}") for i in range(200)]
    docs = spark.createDataFrame(rows_, "own long, text string")
    held, keys = jaccard_join._keyed(docs, F.col("own"), F.col("text"), bits=5)
    assert held.select("key", "own").distinct().count() == keys.count() == 150
    assert sorted((r["own"], r["n"]) for r in keys.collect()) == [(i, 2 if i < 50 else 1) for i in range(150)]
