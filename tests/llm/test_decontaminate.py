import hashlib
import random
import re

from tests.llm.helpers import ascii_lower, awkward, documents, rows, with_clashes
from treesift.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = WORD.findall(ascii_lower(text))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    out = []
    for doc, text in texts:
        w = WORD.findall(ascii_lower(text))
        hit, of = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    of |= found
        out.append((doc, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def cases(seed):
    rng = random.Random(seed)
    draw = lambda n: " ".join(rng.choice(["the", "of", "a", "Été", "x1", "go", "to"]) for _ in range(n))
    items = [(i, draw(rng.choice((1, 3, 5, 9, 10, 11, 25)))) for i in range(8)] + [(100, None), (101, "  ...  "), (102, "")]
    texts = []
    for i in range(60):
        text = draw(rng.randint(0, 40))
        if rng.random() < 0.6:
            w = rng.choice(items[:8])[1].split()
            a = rng.randrange(len(w))
            text += ", " + "-".join(w[a : a + rng.randint(1, 20)]).upper() + "! " + draw(5)
        texts.append((i, text))
    return texts, items


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts, items = cases(seed)
        got = rows(decontaminate.decontamination_report(documents(spark, texts), benchmark(spark, items)), *COLUMNS)
        assert got == brute(texts, items)


def test_small_blocks_give_the_same(spark):
    texts, items = cases(3)
    got = rows(decontaminate.decontamination_report(documents(spark, texts), benchmark(spark, items), block_bytes=120), *COLUMNS)
    assert got == brute(texts, items)
    left = decontaminate.without_contaminated(documents(spark, texts), benchmark(spark, items), block_bytes=120)
    assert rows(left, "doc_id") == sorted((r[:1] for r in brute(texts, items) if not r[-1]), key=repr)


def test_query_against_brute_force(spark, sf_dir):
    from treesift.llm.queries import queries

    read = lambda t, k: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect()]
    want = brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert rows(queries()["op4_decontaminate"](spark, sf_dir), *COLUMNS) == want


def test_awkward_rows(spark):
    docs, items = awkward(spark), benchmark(spark, [(1, "tie tie tie"), (1, "tie tie tie"), (2, None)])
    got = rows(decontaminate.decontamination_report(with_clashes(docs), items), *COLUMNS)
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [(1, "tie tie tie")])
    left = decontaminate.without_contaminated(with_clashes(docs), items)
    assert left.columns == with_clashes(docs).columns and left.count() == docs.count() - 2
    assert decontaminate.decontamination_report(docs.limit(0), items).count() == 0
    assert decontaminate.without_contaminated(docs, items.limit(0)).count() == docs.count()
