import collections
import random
import re

from tests.llm.helpers import awkward, rows, with_clashes, words
from treesift.llm import quality


def brute(text):
    w = words(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(("a ", "b ", "ab\n", "c\t", "# ", "\x0b", " ", "é| ")) for _ in range(rng.randint(0, 80)))
        j = quality.judge(text)
        assert (j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed) == brute(text)


def test_query_against_brute_force_and_labels(spark, sf_dir):
    from treesift.llm.queries import queries

    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = 0
    for r in queries()["op5_quality_rules"](spark, sf_dir).collect():
        assert tuple(r[c] for c in BASE) == brute(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] in labels and not r["base_failed"]:
            right += r["kept"] == bool(labels[r["doc_id"]])
    judged = sum(not brute(texts[d])[-1] for d in labels)
    assert right >= 0.97 * judged


def test_lines_that_fail():
    good = "It was a plain sentence of some length that nobody would take out."
    fails = lambda line: quality.line_fails(line, line.split(), quality.LineRules())
    assert not fails(good) and not fails("A heading without a stop")
    for bad in ("Home | About | Contact | Help", "#### *** $$$ a b", "BUY!! NOW!! IT!! IS!! CHEAP!!", "go go go go go go go go go go go go", "Login", "We use, as everyone uses cookies. Read more here."):
        assert fails(bad), bad
    more = [" ".join(f"{w}{i}" for i in range(10)) + "." for w in ("ab", "cd", "ef")]
    text = "\n".join([good, "Home | About | Contact | Help", *more])
    j = quality.judge(text)
    assert j.kept and "Home" not in j.clean_text and good in j.clean_text
    assert not quality.judge("Home | About | Contact | Help\n" * 30).kept


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = rows(quality.quality_report(with_clashes(docs)), "doc_id", *BASE)
    assert got == sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=repr)
    assert not any(r["kept"] for r in quality.quality_report(docs).where("n_words = 0").collect())
    kept = quality.cleaned(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns
    assert quality.quality_report(docs.limit(0)).count() == 0 and quality.cleaned(docs.limit(0)).count() == 0
    assert kept.count() == quality.quality_report(docs).where("kept").count()


def plain_verdict(text):
    """(lines that stay, kept) by the rules as the module's text states them, one condition after another."""
    stay, lost, before = [], 0, set()
    for line in text.split("\n"):
        w = words(line)
        n = len(w)
        if not n:
            stay.append(line)
            continue
        letters = [c for c in line if c.isalpha()]
        bad = [
            line in before,
            sum(c in "#*$%&|<>" for c in line) > max(1, n / 4),
            line.count("!") > max(2, n / 2) and (sum(c.isupper() for c in letters) > len(letters) / 2 or line.count("!") > n),
            n >= 10 and (collections.Counter(w).most_common(1)[0][1] > n / 2 or sum(a == b for a, b in zip(w, w[1:])) > n / 2),
            sum(x in ("|", "›", "»", ">", "/", "•", "·") for x in re.split(r"\s", line)) > max(1, n / 5),
            n <= 6 and line.rstrip()[-1] not in ".!?…。！？:;\"'”’»)]" and any(x.strip(".,:;|").lower() in quality.MENU_WORDS for x in w),
            n <= 25 and any(x in line.lower() for x in quality.NOTICES),
            n > 200 and all(x[-1] not in ".!?…。！？:;" for x in w),
        ]
        before.add(line)
        if any(bad):
            lost += sum(map(len, w))
        else:
            stay.append(line)
    return stay, not brute(text)[-1] and 100 * lost <= 40 * sum(map(len, words(text)))


def test_verdicts_against_the_rules_stated_plainly(spark, sf_dir):
    from treesift.llm.queries import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {d: plain_verdict(t) for d, t in texts.items()}
    assert {r["doc_id"]: r["kept"] for r in queries()["op5_quality_rules"](spark, sf_dir).collect()} == {d: k for d, (_, k) in want.items()}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in quality.cleaned(docs).collect()}
    assert got == {d: ("\n".join(lines), len("\n".join(lines))) for d, (lines, k) in want.items() if k}
    assert any(t != texts[d] for d, (t, _) in got.items())
    rng = random.Random(12)
    parts = ["Home", "login", "|", ">", "word ", "Word. ", "WORD!! ", "# ", "go go go go go go ", "a1 b2 c3 d4 e5 f6 ", "\n", "\n", "read more ", "» ", "; "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(("", " ")) for _ in range(rng.randint(0, 60)))
        j = quality.judge(text)
        lines, keep = plain_verdict(text)
        assert (j.clean_text, j.kept) == ("\n".join(lines), keep), text
