"""The field over lines: passes against all labellings, slopes against differences, held-out accuracy."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, documents, rows, with_clashes
from treesift.llm import line_field as f


def weight_of(labels, odds, chain):
    return sum(o for y, o in zip(labels, odds, strict=True) if y) + sum(chain[a + b] for a, b in itertools.pairwise(labels))


def test_marginals_equal_those_over_all_labellings():
    random.seed(1)
    for n in (1, 2, 5, 9):
        odds, chain = [random.gauss(0, 2) for _ in range(n)], tuple(random.gauss(0, 1) for _ in range(3))
        weights = {ys: math.exp(weight_of(ys, odds, chain)) for ys in itertools.product((0, 1), repeat=n)}
        total = sum(weights.values())
        plain = [sum(w for ys, w in weights.items() if ys[i]) / total for i in range(n)]
        assert f.marginals(odds, chain) == pytest.approx(plain)
    assert f.marginals([-2000.0, 2000.0, 0.0], (0.0, 0.0, 0.0)) == pytest.approx([0, 1, 0.5])


def some_documents(seed=3, n=12):
    random.seed(seed)
    good, bad = "It was a plain day, and the tale went on.", "*** BUY!! | NOW!! | $$$ ###"
    return [(f.line_factors("\n".join(random.choice((good, bad) if random.random() < 0.2 else ((good,) if label else (bad,))) for _ in range(random.choice((1, 2, 6)))))[0], label) for label in (0, 1) * n]


def test_loss_and_slope():
    docs = sorted(some_documents(), key=lambda d: -len(d[0]))
    steps = [np.array([d[t] for d, _ in docs if len(d) > t]) for t in range(len(docs[0][0]))]
    rng = np.random.default_rng(2)
    weights, sums, penalty = rng.normal(0, 0.3, f.N_WEIGHTS), rng.normal(0, 1, f.N_WEIGHTS), np.ones(f.N_WEIGHTS)
    value, slope = f._loss(weights, steps, sums, penalty)
    plain = 0.0
    for d, _ in docs:
        odds = weights[d].sum(axis=1) + weights[f.N_NODE - 1]
        plain += math.log(sum(math.exp(weight_of(ys, odds, weights[f.N_NODE :])) for ys in itertools.product((0, 1), repeat=len(d))))
    assert value == pytest.approx(plain - weights @ sums + 0.5 * weights @ weights)
    for i in [*np.unique(docs[0][0])[::5], *range(f.N_NODE - 1, f.N_WEIGHTS)]:
        step = np.zeros(f.N_WEIGHTS)
        step[i] = 1e-5
        assert (f._loss(weights + step, steps, sums, penalty)[0] - f._loss(weights - step, steps, sums, penalty)[0]) / 2e-5 == pytest.approx(slope[i], abs=1e-4)


def test_lines_beside_a_line_count():
    weights = f.fit(some_documents(n=60))
    good = "It was a plain day, and the tale went on."
    alone, beside = f.score(good, weights), f.score("\n".join(["*** BUY!! | NOW!! | $$$ ###", good, "*** BUY!! | NOW!! | $$$ ###"]), weights)
    assert alone > 0.7 > beside
    assert f.score("\n".join([good] * 9 + ["*** BUY!! | NOW!! | $$$ ###"]), weights) > 0.7  # by length


def test_held_out_accuracy(spark):
    """On rows that the field was not fitted on, over a whole table."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = f.quality_scores(docs, labels)
    assert rows(out, "doc_id", "held_out") == sorted(((r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs.select("doc_id").collect()), key=repr)
    told = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in told)
    assert sum(r.predicted == r.quality for r in told) >= 0.97 * len(told)
    good = [r for r in told if r.quality == 1]
    assert sum(r.predicted for r in good) >= 0.98 * len(good)


def test_held_out_labels_and_other_columns_are_not_read(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    weights = f.train(docs, labels)
    flipped = labels.withColumn("quality", F.when(f.remainder(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0)})
    assert np.array_equal(weights, f.train(changed, flipped.withColumn("toxic", F.lit(1))))
    assert len(weights) == f.N_WEIGHTS and np.abs(weights).max() > 0.1


def test_awkward_documents(spark):
    docs = with_clashes(awkward(spark)).withColumns({c: F.lit("x") for c in ("score", "label", "quality", "factors", "predicted")})
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (6, 0, 0), (6, 0, 1), (8, None, 0), (None, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    out = f.quality_scores(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert not out.where("doc_id is null").collect()[0].held_out
    same = out.where("doc_id in (1, 2, 3)").select("score").distinct()
    assert same.count() == 1
    assert {r.score for r in f.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert f.quality_scores(docs.where("false"), labels).count() == 0


def test_long_texts():
    weights = f.fit(some_documents())
    assert 0 <= f.score("one line\n" * 300_000, weights) <= 1
    assert 0 <= f.score("word " * 2_000_000, weights) <= 1
