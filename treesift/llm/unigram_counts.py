"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists every piece of the vocabulary that ends at each
character; dynamic programming keeps, for each place in the text, the score of
the best segmentation up to it and how many pieces that has.  No segmentation
is built.  Ties go as in the tokenizer's own search: of two paths of equal
score the one whose last piece begins first stays, a character without a piece
of its own may be unknown at a penalty under the least score, and unknown
characters fall back to their bytes.

Words are segmented one by one, each with the blank before it, as the
tokenizer's own pre-tokenizer cuts them, so the counts of words that come again
are remembered, up to a bound in bytes; those not seen for longest go first,
and long words are not kept.  The search holds scores for as many places as the
longest piece reaches back, so a text without blanks needs little memory.

The public files have no unigram model.  So the vocabulary is that of the
public piece model, in its order, with the log of a Zipf law over the rank as
score; another vocabulary of (piece, score) can be given instead.

Defined results: a null or empty text has no tokens; repeated rows give equal
results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from treesift.llm.common import bound_batches, ids_and_texts, record_batch

BLANK = "▁"
#: How far an unknown character's score lies under the least of the vocabulary.
UNKNOWN_PENALTY = 10.0
#: Bytes of words and counts that a worker remembers, about, and the longest word among them.
REMEMBERED_BYTES = 128 << 20
LONGEST_REMEMBERED = 64
#: Bytes that an entry takes beside the word's own.
ENTRY_BYTES = 100
#: Places whose scores are held before those out of reach are dropped.
PLACES_HELD = 1 << 14


def zipf_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model in the order of ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), -math.log(i + 2.0)) for i in range(model.get_piece_size())]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], remembered_bytes: int = REMEMBERED_BYTES):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(len(p) for p, _ in vocabulary)
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        #: Counts of words: the younger half and the one before it.
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.half, self.held = remembered_bytes // 2, 0

    def count_word(self, word: str) -> int:
        """Pieces of the best segmentation of one pre-token."""
        if len(word) > PLACES_HELD:
            return self._count_long(word)
        size = len(word)
        best = [-math.inf] * (size + 1)
        count = [0] * (size + 1)
        best[0] = 0.0
        done = 0  # places up to here are final
        for last, (length, score) in self.automaton.iter(word):  # longest first at each place
            end = last + 1
            while done < last:
                done += 1
                self._settle(word, done, done, best, count)
            start = end - length
            total = best[start] + score
            if total > best[end]:
                best[end], count[end] = total, count[start] + 1
            if length == 1:
                done = end
        while done < size:
            done += 1
            self._settle(word, done, done, best, count)
        return count[size]

    def _settle(self, word: str, end: int, at: int, best: list[float], count: list[int]) -> None:
        """A character without a piece of its own may be unknown; ``at``: where its end is in the lists."""
        if word[end - 1] in self.automaton:
            return
        total = best[at - 1] + self.unknown
        if total > best[at]:
            best[at], count[at] = total, count[at - 1] + len(word[end - 1].encode())

    def _count_long(self, word: str) -> int:
        """The same with scores of the last places only, from ``base`` on."""
        size = len(word)
        best, count = [0.0], [0]
        base = done = 0

        def reach(end: int) -> None:
            nonlocal base
            if len(best) > PLACES_HELD + self.longest:
                base += len(best) - self.longest - 1
                del best[: -self.longest - 1], count[: -self.longest - 1]
            more = end - base - len(best) + 1
            if more > 0:
                best.extend([-math.inf] * more)
                count.extend([0] * more)

        for last, (length, score) in self.automaton.iter(word):
            end = last + 1
            while done < last:
                done += 1
                reach(done)
                self._settle(word, done, done - base, best, count)
            reach(end)
            start = end - length - base
            total = best[start] + score
            if total > best[end - base]:
                best[end - base], count[end - base] = total, count[start] + 1
            if length == 1:
                done = end
        while done < size:
            done += 1
            reach(done)
            self._settle(word, done, done - base, best, count)
        return count[size - base]

    def _count_known(self, word: str) -> int:
        """The count of a word that the younger half does not hold."""
        n = self.old.get(word)
        if n is None:
            n = self.count_word(BLANK + word)
        if len(word) <= LONGEST_REMEMBERED:
            self.young[word] = n
            self.held += sys.getsizeof(word) + ENTRY_BYTES
            if self.held > self.half:
                self.young, self.old, self.held = {}, self.young, 0
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", BLANK)
        if not marked.startswith(BLANK):
            marked = BLANK + marked
        total = 0
        for word in marked.split(BLANK)[1:]:
            n = self.young.get(word)
            total += self._count_known(word) if n is None else n
        return total


_counters: dict[str, UnigramCounter] = {}


def counter(model_path: str) -> UnigramCounter:
    if model_path not in _counters:
        _counters[model_path] = UnigramCounter(zipf_vocabulary(model_path))
    return _counters[model_path]


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_chars, n_tokens) of every document of ``docs`` (doc_id, text)."""
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield record_batch(schema, batch.column("doc_id"), [len(t) for t in texts], [own.count(t) for t in texts])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
