"""Sets of hashed word shingles, for many texts at once.

Words are runs of bytes other than space and the control bytes 9 to 13, with
A-Z lower-cased; a shingle is ``k`` words in a row, and a text of fewer words
is one shingle as a whole.  All of it is vector work on the texts' bytes laid
end to end; a shingle is known by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
PORTION = 1 << 20       # bytes hashed at once (about 40 bytes each); a longer text is alone


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words begin (one more entry
    than texts).  A word's hash is a difference of running polynomial sums,
    moved to the same power whatever its place."""
    flat = _LOWER[np.frombuffer(b" ".join([*texts, b""]) + b" ", np.uint8)]
    blank = _BLANK[flat]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(flat)))])
    h = mix((sums[end] - sums[begin]) * _powers(_P_INVERSE, len(flat) + 1)[begin])
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return h, np.searchsorted(begin, starts)


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; none without words."""
    out: list[np.ndarray] = []
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(coded):
        size, stop = 0, at
        while stop < len(coded) and (stop == at or size + len(coded[stop]) <= PORTION):
            size += len(coded[stop])
            stop += 1
        out += _sets(coded[at:stop], k)
        at = stop
    return out


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    words, starts = word_hashes(texts)
    n = len(words)
    h = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k if len(h) else 0):
        h = mix(h * np.uint64(3) + words[i:n - k + 1 + i])
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(h[a:b - k + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                short = mix(short * np.uint64(5) + w)
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out
