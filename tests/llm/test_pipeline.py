import collections

from tests.llm import test_decontaminate, test_jaccard_join, test_quality, test_token_files
from tests.llm.helpers import awkward, documents, rows, with_clashes


def test_stages_against_brute_force(spark, sf_dir):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = {r["doc_id"]: test_quality.plain_verdict(r["text"] or "") for r in docs.collect()}
    texts = {d: "\n".join(lines) for d, (lines, kept) in judged.items() if kept}  # without the lines that fail
    good = set(texts)
    one = p.STAGES[0][1](spark, docs, sf_dir).cache()
    assert one.columns == docs.columns and {r["doc_id"]: r["text"] for r in one.collect()} == texts

    roots = test_jaccard_join.brute({d: texts[d] for d in good})
    first = {d for d, (_, root) in roots.items() if d == root}
    two = p.STAGES[1][1](spark, one, sf_dir).cache()
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == first

    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in test_decontaminate.brute([(d, texts[d]) for d in first], items) if not r[-1]}
    three = p.STAGES[2][1](spark, two, sf_dir).cache()
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == clean

    four = p.STAGES[3][1](spark, three, sf_dir).cache()
    copies = collections.Counter(r["doc_id"] for r in four.collect())
    assert four.columns == docs.columns and set(copies) == clean and max(copies.values()) <= 2

    want = test_token_files.brute([(d, texts[d]) for d, n in copies.items() for _ in range(n)])
    got = rows(p.STAGES[4][1](spark, four, sf_dir), *test_token_files.COLUMNS)
    assert got == want
    assert rows(p.run(spark, sf_dir), *test_token_files.COLUMNS) == want


def test_awkward_documents_pass_all_stages(spark, sf_dir):
    import corpus_pipeline as p

    long = " ".join(f"w{i}" for i in range(300)) + "."
    rows_ = [(100 + i, long.replace("w1 ", f"v{i} ")) for i in range(3)] + [(100, long), (None, long), (200, "Plain words make a sentence here. " + " ".join(f"k{i}" for i in range(40)) + ".")]
    docs = with_clashes(awkward(spark).union(documents(spark, rows_)))
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert "component_id" in docs.columns
    assert p.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count() > 0
    empty = awkward(spark).limit(0)
    for _, stage in p.STAGES[:-1]:
        empty = stage(spark, empty, sf_dir)
        assert empty.columns == awkward(spark).columns and empty.count() == 0
    assert p.STAGES[-1][1](spark, empty, sf_dir).count() == 0
