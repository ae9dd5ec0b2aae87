import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import awkward, with_clashes
from treesift.llm import pii


def brute(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


PIECES = ["a", "b.", "@", "@@", ".", "1", "22", "300", "4111 1111 1111 1111", "-", " ", "  ", "+1", "(", "c-d", ".com", "é", "\n", "0004.1.1.1", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "+1 (243) 555-5526", " (at) "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute(text)
    base, every = pii.all_spans(text, pii.weights())
    assert set(base) <= set(every)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" * 150_000):
        pii.base_spans(text)


def test_distant_twins_take_the_label():
    m = pii.weights()
    text = "Call +1 (017) 555-7713 today. " + "Words pass by here. " * 50 + "Then 017-555-7713 answered, and x.34 (at) mail7.example.com wrote; x.34@mail7.example.com too."
    base, every = pii.all_spans(text, m)
    added = {(pii.KINDS[k], text[a:b]) for k, a, b in every if (k, a, b) not in base}
    assert ("phone", "017-555-7713") in added
    assert ("email", "x.34 (at) mail7.example.com") in added


def test_held_out_accuracy():
    rng, m = random.Random(99), pii.weights()
    found = missed = wrong = 0
    for _ in range(200):
        text, spans = pii._write(rng)
        _, every = pii.all_spans(text, m)
        hit = lambda s, among: any(s[0] == k and s[1] < b and a < s[2] for k, a, b in among)
        found += sum(hit(s, every) for s in spans)
        missed += sum(not hit(s, every) for s in spans)
        wrong += sum(not hit(s, spans) for s in every)
    assert found / (found + missed) > 0.95 and found / (found + wrong) > 0.95


def test_report(spark):
    docs = awkward(spark)
    got = pii.pii_report(with_clashes(docs)).collect()
    assert len(got) == docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty and r["spans"] == "" for r in got if r["doc_id"] in (1, 2, 3, 4))
    assert pii.pii_report(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    from treesift.llm.queries import queries

    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in queries()["op1_pii"](spark, sf_dir).collect():
        want = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == i for k, _, _ in want) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert set(filter(None, pii.joined(want).split(","))) <= set(filter(None, r["spans"].split(",")))


def test_redacted_text(spark):
    docs = spark.createDataFrame([(1, "é write x.34@mail7.example.com or +1 (243) 555-5526 now"), (2, "plain"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(pii.find_spans(docs)).collect()}
    assert got == {1: "é write [email] or [phone] now", 2: "plain", 3: ""}


def test_at_words_are_those_of_the_plain_pattern():
    plain = re.compile(r"\s*[(\[{]\s*(?:at|AT|arroba)\s*[)\]}]\s*|\s+(?:at|AT)\s+(?=[A-Za-z0-9-]+\s*(?:[(\[{]\s*dot\s*[)\]}]|\s+dot\s+))")
    random.seed(11)
    parts = ["at", "AT", "arroba", "(", ")", "[", "]", "{", "}", " ", "  ", "\n", "dot", "name", "x", "@", ".", " at ", "(at)", " dot ", "[dot]", "host"]
    for _ in range(20_000):
        text = "".join(random.choice(parts) for _ in range(random.randrange(1, 14)))
        assert list(pii.at_words(text)) == [m.span() for m in plain.finditer(text)], text


def test_all_spans_take_time_in_proportion():
    model = pii.weights()
    n = 100_000
    texts = [" " * 10 * n, "a (at)" + " " * n + "b", "x" + " " * n + "(at) host" + " " * n + "7", "(at)" * n, "x (at) " * n, "a@b.cc" + "(at)x" * n, "me at host dot " * n, "( " * n, "(" + " " * n + "at"]
    for text in texts:
        began = time.perf_counter()
        pii.all_spans(text, model)
        assert time.perf_counter() - began < 10, text[:20]
