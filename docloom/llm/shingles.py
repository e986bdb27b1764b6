"""Sets of word shingles as sorted 64-bit hashes, for whole batches of texts at once.

A word's hash is two polynomials of its bytes, modulo two primes just below 2^31, mixed into 64 bits. Over a
prime field two words of n bytes meet under at most n of the bases, so words of regular structure (such as
Thue-Morse words, which meet under any polynomial modulo 2^64) are told apart like any others.

Texts are UTF-8 bytes; A-Z count as a-z; words are runs of bytes other than blanks (0x20, 0x09 to 0x0D). A
text of fewer words than a shingle has is one shingle of its own kind; one without words has none.
"""

from __future__ import annotations

import numpy as np


WORDS = 5
BLOCK = 1 << 18
_rng = np.random.default_rng(5)
PRIMES = (np.uint64((1 << 31) - 1), np.uint64((1 << 31) - 19))
_CODES = [_rng.integers(1 << 20, int(p), 256, dtype=np.uint64) for p in PRIMES]
_BASES = [int(_rng.integers(1 << 20, int(p))) for p in PRIMES]
_fields: list[np.ndarray] = []
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """n powers at least of each field's base, in order."""
    if not _fields or len(_fields[0]) < n:
        _fields[:] = []
        for base, p in zip(_BASES, PRIMES, strict=True):
            x = np.ones(1, np.uint64)
            while len(x) < max(n, 64):
                x = np.concatenate([x, x * np.uint64(pow(base, len(x), int(p))) % p])
            _fields.append(x)
    return _fields


def word_hashes(b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words b[start:stop], none of them empty; memory is that of BLOCK bytes at a time."""
    sums = np.zeros((2, len(start)), np.uint64)
    powers = _powers(int((stop - start).max())) if len(start) else []
    for s in range(0, len(b), BLOCK):
        i, j = np.searchsorted(stop, s, side="right"), np.searchsorted(start, s + BLOCK)
        if i == j:
            continue
        first = np.maximum(start[i:j], s)
        size = np.minimum(stop[i:j], s + BLOCK) - first
        begin = np.cumsum(size) - size
        # Each byte of the words in the block, and its place in its word.
        at = np.arange(int(size.sum())) + np.repeat(first - begin, size)
        place = at - np.repeat(start[i:j], size)
        at = b[at]
        for k, (p, code) in enumerate(zip(PRIMES, _CODES, strict=True)):
            sums[k, i:j] += np.add.reduceat(code[at] * powers[k][place] % p, begin)
    return mix((sums[0] % PRIMES[0]) << np.uint64(31) | sums[1] % PRIMES[1])


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles, ascending within each text, in a row; and the texts' offsets in it."""
    b = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    blank = _BLANK[b]
    blank[ends - 1] = True
    word = ~blank
    start = np.flatnonzero(word & np.append(True, blank[:-1]))
    stop = np.flatnonzero(blank & np.append(False, word[:-1]))
    words = word_hashes(_LOWER[b], start, stop)
    doc = np.searchsorted(ends, start, side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    last = np.cumsum(n_words)[doc]
    room = last - np.arange(len(words))
    full = np.flatnonzero(room >= WORDS)
    grams = np.zeros(len(full), np.uint64)
    for k in range(WORDS):
        grams += words[full + k] * _PLACE[k]
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    first = np.cumsum(n_words) - n_words
    lone = np.array([_lone(words[first[d] : first[d] + n_words[d]]) for d in short], np.uint64)
    keys = mix(np.concatenate([grams, lone]))
    owner = np.concatenate([doc[full], short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts)))).astype(np.int64)


def _lone(words: np.ndarray) -> np.uint64:
    return mix(words * _SHORT[: len(words)] + np.uint64(len(words))).sum(dtype=np.uint64)


def slices(texts: list[bytes], most: int = 1 << 19) -> list[tuple[int, int]]:
    """Ranges of texts of about so many bytes."""
    out, a, n = [], 0, 0
    for k, t in enumerate(texts):
        n += len(t) + 1
        if n >= most:
            out.append((a, k + 1))
            a, n = k + 1, 0
    return [*out, (a, len(texts))] if a < len(texts) else out
