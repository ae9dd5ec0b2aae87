import random

from tokenizers import Tokenizer, models, pre_tokenizers

from tests.llm.helpers import awkward, with_clashes
from treesift.llm import unigram_counts
from treesift.llm.common import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


def reference():
    t = Tokenizer(models.Unigram(unigram_counts.zipf_vocabulary(PATH), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    return t


def test_counts_equal_the_tokenizers():
    plain, own, rng = reference(), unigram_counts.counter(PATH), random.Random(1)
    texts = ["", "a", " a", "  a  b ", "日本語テキスト 漢字", "ünï\n\tx", "▁a ▁ b", "<unk> <s> <0x0A> x", "😀😀a😀", "a" * 40, "\x00a"]
    texts += ["".join(rng.choice("ab e▁ <>0xéß漢😀thing") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    for text in texts:
        assert own.count(text) == len(plain.encode(text, add_special_tokens=False).ids), text


def test_ties_go_as_in_the_tokenizer():
    rng = random.Random(2)
    for _ in range(200):
        pieces = ["<unk>", *{"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(12)}]
        vocabulary = [(p, float(-rng.randint(1, 3))) for p in pieces]
        plain, own = Tokenizer(models.Unigram(vocabulary, unk_id=0)), unigram_counts.UnigramCounter(vocabulary)
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            found = plain.encode(word)
            if 0 not in found.ids:
                assert own.count_word(word) == len(found.ids), (vocabulary, word)


def test_memory_is_bounded_and_long_words_count():
    own, plain, rng = unigram_counts.UnigramCounter(unigram_counts.zipf_vocabulary(PATH), 200_000), reference(), random.Random(3)
    for k in range(5):
        text = " ".join(f"w{k}x{i}" for i in range(3000))
        assert own.count(text) == len(plain.encode(text, add_special_tokens=False).ids)
        assert 0 < own.held + len(own.old) * unigram_counts.ENTRY_BYTES <= 200_000
    before = len(own.young) + len(own.old)
    for n in (3, 5_000, 60_000):
        text = "".join(rng.choice("abeing漢字テキスト") for _ in range(n)) + "😀" * n
        assert own.count(text) == len(plain.encode(text, add_special_tokens=False).ids)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(2000)) for _ in range(100)]
    assert all(own.count(t) > 0 for t in texts) and len(own.young) + len(own.old) <= before + 1


def test_query(spark, sf_dir):
    from treesift.llm.queries import queries

    plain = reference()
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in queries()["op7_token_counts"](spark, sf_dir).collect():
        text = texts[r["doc_id"]]
        assert (r["n_chars"], r["n_tokens"]) == (len(text), len(plain.encode(text, add_special_tokens=False).ids))


def test_awkward_rows(spark):
    docs, plain = awkward(spark), reference()
    got = unigram_counts.token_counts(with_clashes(docs), PATH).collect()
    want = sorted(len(plain.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect())
    assert sorted(r["n_tokens"] for r in got) == want
    assert unigram_counts.token_counts(docs.limit(0), PATH).count() == 0
