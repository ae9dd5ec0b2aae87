"""Vectorised word and shingle hashes of whole texts.

Texts of a batch lie one after another in one byte buffer.  A word's hash is a
polynomial over its bytes, taken from running sums, so the cost per byte is a
few numpy operations and no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random value for each byte, so that equal byte sums do not meet.
_BYTE_VALUES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes that one round of running sums covers, but for a longer single word.
SEGMENT = 1 << 19
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(SEGMENT, 1 << int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more for the end)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z in lower case, of all texts
    in turn, and for each text the place of its first word (one more for the end)."""
    data, starts = _buffer_of(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = _SPACES[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[starts[:-1][starts[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends_of_text = starts[1:][starts[1:] > 0] - 1
    after[ends_of_text] = True
    begin = np.flatnonzero(before & ~space)
    end = np.flatnonzero(after & ~space) + 1
    hashes = np.empty(len(begin), np.uint64)
    first = 0
    while first < len(begin):  # word by word up to SEGMENT bytes, so that tables stay small
        last = max(first + 1, int(np.searchsorted(end, begin[first] + SEGMENT, "right")))
        low, high = begin[first], end[last - 1]
        up, down = _power_tables(int(high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[_LOWER[data[low:high]]] * up[: high - low], out=sums[1:])
        b, e = begin[first:last] - low, end[first:last] - low
        hashes[first:last] = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64))
        first = last
    return hashes, np.searchsorted(begin, starts)


def shingle_sets(texts: pa.Array, width: int = 5, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``width``-word shingles of each text, as sorted hashes of
    ``bits`` bits, one text after another, and each text's place among them.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    words, at = word_hashes(texts)
    n_words = np.diff(at)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    rolled = np.zeros(len(words), np.uint64)
    odd = np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        n = len(words) - k
        if n > 0:
            rolled[:n] = rolled[:n] * odd + words[k:]
    owner = np.repeat(np.arange(len(texts)), n_words)
    place = np.arange(len(words)) - at[:-1][owner]
    whole = place + width <= n_words[owner]
    for i in np.flatnonzero((n_words > 0) & (n_words < width)):
        value = np.uint64(n_words[i])
        with np.errstate(over="ignore"):
            for w in words[at[i] : at[i + 1]]:
                value = value * odd + w
        rolled[at[i]] = value
        whole[at[i]] = True
    shingles = mix(rolled[whole]) >> np.uint64(64 - bits)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(owner[whole], minlength=len(texts)))))
    sets = [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))
