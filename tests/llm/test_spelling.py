"""Spelling variants, held against all pairs of words tried one by one."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import ascii_lower, awkward, documents, rows, with_clashes
from treesift.llm import spelling

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(docs, planted=True):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if planted and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def plain_groups(counts):
    by_size, nears = {}, {w: [] for w in counts}
    for w in counts:
        by_size.setdefault(len(w), []).append(w)
    for size, ws in by_size.items():
        for i, a in enumerate(ws):
            for b in ws[i + 1 :] + by_size.get(size + 1, []):
                if near(a, b):
                    nears[a].append(b)
                    nears[b].append(a)
    form = {}
    for w, others in nears.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(nears[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_query_on_documents_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = plain_counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    counts = spelling.word_counts(docs, planted=True)
    assert {r.word: r.n for r in counts.collect()} == plain
    some = {w: n for w, n in plain.items() if zlib.crc32(w[:3].encode()) % 4 == 0 or n > 20}
    table = spark.createDataFrame(list(some.items()), "word string, n long")
    assert rows(spelling.variant_groups(table), *COLUMNS) == plain_groups(some)
    whole = spelling.variant_groups(counts)
    assert whole.count() == len(plain) and whole.where("form is not null").count() > 0


def test_hot_segments_are_cut_again_and_lose_nothing(spark):
    """Thousands of words that share one half, or all but a few letters."""
    random.seed(7)
    words = set()
    for _ in range(900):
        words.add("".join(random.choice("abcd") for _ in range(random.choice((4, 5, 6)))) + "tionally")
        words.add("unthinking" + "".join(random.choice("abc") for _ in range(random.choice((3, 4, 5)))))
        words.add("".join(random.choice("abéÿ") for _ in range(random.choice((7, 8, 9)))))
    counts = {w: random.choice((2, 2, 3, 40, 500)) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    plain = plain_groups(counts)
    assert rows(spelling.variant_groups(table), *COLUMNS) == plain
    assert rows(spelling.variant_groups(table, group_words=2), *COLUMNS) == plain
    assert rows(spelling.variant_groups(table, group_words=10**9), *COLUMNS) == plain
    assert len({p[2] for p in plain}) < len(plain)


def test_forms_are_followed_and_ties_go_by_code_point(spark):
    counts = {"lettersx": 2, "letters": 30, "lettersy": 30, "xletters": 400, "oletters": 400, "xxletters": 9000, "colours": 5, "colouré": 50, "colourz": 50}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    out = rows(spelling.variant_groups(table), *COLUMNS)
    assert out == plain_groups(counts)
    by_word = {r[0]: r for r in out}
    assert by_word["lettersx"][1] == "letters" and by_word["letters"][1] == "oletters" and by_word["lettersx"][2] == "oletters"
    assert by_word["xletters"][1:3] == ("xxletters", "xxletters") and by_word["colours"][1] == "colourz"


def test_runs_and_slips(spark):
    texts = ["Straßenbahn straßenbahn STRAßENBAHN", "ÉTÉDERNIER étÉdernier", "one_two-threefour5sixseven", "×÷×÷×÷×÷", "naıvelyİstanbul", "x" * 5000]
    docs = [(i, t) for i in range(60) for t in texts]
    assert {r.word: r.n for r in spelling.word_counts(documents(spark, docs), planted=True).collect()} == plain_counts(docs)
    assert {r.word: r.n for r in spelling.word_counts(documents(spark, docs)).collect()} == plain_counts(docs, planted=False)


def test_awkward_documents(spark):
    docs = awkward(spark).unionAll(awkward(spark))
    plain = plain_groups(plain_counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    out = spelling.variant_groups(spelling.word_counts(with_clashes(docs).withColumns({c: F.lit("x") for c in ("word", "n", "run", "root", "form")}), planted=True))
    assert rows(out, *COLUMNS) == plain
    assert spelling.variant_groups(spelling.word_counts(docs.where("false"))).count() == 0
