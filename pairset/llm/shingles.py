"""Sets of word shingles as 64-bit hashes, and their MinHash sketches."""

from __future__ import annotations

import numpy as np

from pairset.llm.common import mixed

#: Words of a shingle.
WORDS = 5
#: Values of a sketch.
SKETCH = 64

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PLACES = mixed(np.arange(1, 1024)) | np.uint64(1)
_MULTIPLY = mixed(np.arange(2_000, 2_000 + SKETCH)) | np.uint64(1)
_ADD = mixed(np.arange(3_000, 3_000 + SKETCH))


def word_hashes(text: str) -> np.ndarray:
    """A hash of every word: lower-cased runs of ASCII letters and digits and of characters above ASCII."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(_WORD_BYTES) + b" ", np.uint8)
    blank = raw == 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    lengths = ends - starts
    letters = np.flatnonzero(~blank)
    place = np.arange(len(letters)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    weighted = (raw[letters].astype(np.uint64) + np.uint64(1)) * _PLACES[place % len(_PLACES)]
    return mixed(np.add.reduceat(weighted, np.concatenate([[0], np.cumsum(lengths)[:-1]])) + lengths.astype(np.uint64))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of runs of ``words`` words; a shorter text is one shingle, none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(words, len(w))
    total = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + w[k: k + len(total)]
    return np.unique(mixed(total))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """MinHash values: equal values at one place are as likely as the sets' Jaccard similarity."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at: at + 4096, None] * _MULTIPLY + _ADD).min(0))
    return (mixed(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def digest(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    a = mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mixed(hashes * np.uint64(0xD1342543DE82EF95)).sum(dtype=np.uint64)
    return a.tobytes() + b.tobytes()
