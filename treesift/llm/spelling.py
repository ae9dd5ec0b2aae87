"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word is cut into two even segments by its length.  One edit leaves one of them
as it is, so two words one edit apart share a segment: the first at the start of
both, or the second at the end of both, which in a word of one letter more stands
one place further on.  Each word is indexed under its two segments, for words of
its own length, and probes, where it is one letter longer, the index of words
one letter shorter with its substrings of these places.

A segment that many words share ("the", "-tion") would make all pairs of them
candidates.  So a group over ``GROUP_WORDS`` is not paired: the part in which its
words differ is cut into two even segments again, and so on, down to one letter.
Groups of one letter's difference hold no more words than there are letters, so
no group is paired that grows with the data, and no pair is lost.  The keys are
64-bit hashes of length and segments; a meeting of two hashes only adds
candidates, as every candidate is verified by its edit distance.

A pair whose edit stands between the two segments shares both and is found twice;
pairs found are few beside candidates, so they are made distinct after the
distance is taken, which is cheaper than a shuffle of candidates.

A word's form is its near word of largest count, if that is ``FORM_FACTOR`` times
its own at least.  Counts grow along forms, so following them ends, after a
number of steps that is at most the logarithm of the largest count; each round
doubles the steps.

Defined results: a null or empty text has no words; a null doc_id counts as an
empty one where the checksum is taken; repeated rows count each; ties of counts go
to the word first in code-point order; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import kept

MIN_LENGTH = 7
MIN_COUNT = 2
#: Words of a group up to which its pairs are tried.
GROUP_WORDS = 64
FORM_FACTOR = 10
#: Of planted slips: one run of so many loses a letter.
SLIP_EVERY = 31
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_slip(run: Column, doc_id: Column) -> Column:
    """``run`` without one letter, where the checksum of it and its document says so."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % SLIP_EVERY == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, planted: bool = False, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the maximal runs of letters of all texts, A-Z in lower case, of
    ``min_length`` letters and ``min_count`` occurrences at least.  ``planted`` puts slips in."""
    letters = rf"[A-Za-zÀ-ÿ]{{{min_length},}}"  # shorter runs are no words, with or without a slip
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(letters), F.lit(0))).alias("run"))
    lower = runs.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    words = lower.select((with_slip(F.col("run"), F.col("doc_id")) if planted else F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row (key, at, width, longer, word, n) under the two segments of the part, from
    ``at`` on and ``width`` wide, in which the words of its key may differ."""
    left = F.floor(F.col("width") / 2).cast("int")
    right = F.col("width") - left
    first = F.struct(
        F.xxhash64("key", F.lit(1), F.substring("word", F.col("at") + 1, left)).alias("key"), (F.col("at") + left).alias("at"), right.alias("width")
    )
    shifted = F.col("at") + left + F.col("longer").cast("int")
    second = F.struct(F.xxhash64("key", F.lit(2), F.substring("word", shifted + 1, right)).alias("key"), F.col("at").alias("at"), left.alias("width"))
    return rows.select(F.explode(F.array(first, second)).alias("s"), "longer", "word", "n").select("s.*", "longer", "word", "n")


def near_pairs(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(a, n_a, b, n_b): every pair of different words of ``words`` (word, n) one edit apart, once; a is not the longer."""
    size = F.length("word")
    each = words.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"), "word", "n")
    width = size - F.col("longer").cast("int")
    rows = each.select(F.xxhash64(width).alias("key"), F.lit(0).alias("at"), width.alias("width"), "longer", "word", "n").where("width >= 1")
    found = None
    rows = kept(_halved(rows), "segments")
    while True:
        sizes = rows.groupBy("key").agg(F.count_if(~F.col("longer")).alias("same"), F.count("*").alias("all"), F.max("width").alias("widest"))
        small = (F.col("all") <= group_words) | (F.col("widest") <= 1)
        sizes = kept(sizes.where("same > 0 and all > 1").select("key", small.alias("small")), "groups")
        paired = rows.join(sizes.where("small"), "key").drop("small")
        a = paired.where("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = paired.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("n_b"))
        near = a.join(b, (a["key"] == b["key"]) & (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")
        near = kept(near, "near")
        found = near if found is None else found.unionAll(near)
        large = sizes.where("not small")
        if large.isEmpty():
            return found.distinct()
        rows = kept(_halved(rows.join(large.select("key"), "key")), "segments")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): where forms lead to in the end."""
    labels = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = labels.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = kept(labels.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        labels = step.select("word", "root")
        if step.where("moved").isEmpty():
            return labels


def variant_groups(counts: DataFrame, factor: int = FORM_FACTOR, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``counts`` (word, n)."""
    words = kept(counts.select("word", "n"), "words")
    pairs = near_pairs(words, group_words)
    ends = F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )
    best = pairs.select(F.explode(ends).alias("e")).select("e.*").groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    large = -F.col("best.minus") >= factor * F.col("n")
    best = kept(best.select("word", "n_near", F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.minus")).alias("form_n")), "best")
    roots = _roots(best.where("form is not null"))
    return (
        words.join(best, "word", "left")
        .join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
