"""Word shingles of texts as sorted 64-bit numbers, many texts at once."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Bytes whose words are hashed at once.
BLOCK = 1 << 20
_U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x; one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A number for each byte, A-Z as a-z.
LETTER = mix(LOWER.astype(np.uint64) + _U(1))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_GROWN: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_GROWN.get("up", ())) < n:
        size = max(n, BLOCK + 4096)
        _GROWN["up"], _GROWN["down"] = _powers(BASE, size), _powers(INVERSE, size)
    return _GROWN["up"], _GROWN["down"]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _tables(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTER[data] * up[: len(data)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word; ends: where the texts begin in data, and the last one ends."""
    blank = IS_BLANK[data]
    word = ~blank
    start, stop = word.copy(), word.copy()
    start[1:] &= blank[:-1]
    stop[:-1] &= blank[1:]
    edges = ends[(ends > 0) & (ends < len(data))]
    start[edges] = word[edges]
    stop[edges - 1] = word[edges - 1]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    hashes, k = np.empty(len(a), np.uint64), 0
    while k < len(a):
        m = max(int(np.searchsorted(a, a[k] + BLOCK)), k + 1)
        base, top = a[k], b[m - 1]
        hashes[k:m] = _word_hashes(data[base:top], a[k:m] - base, b[k:m] - base)
        k = m
    return hashes, np.searchsorted(ends, a, side="right") - 1


def shingle_sets(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Of each text the distinct shingles, sorted; with fewer than SHINGLE words the whole text is one, without words there is none."""
    hashes, of = words(data, ends)
    n = len(ends) - 1
    first = np.searchsorted(of, np.arange(n + 1))
    code = np.zeros(max(len(hashes) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        code = code * _U(BASE) + hashes[k : k + len(code)]
    code, out = mix(code), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(code[a : b - SHINGLE + 1]))
        elif b > a:
            whole = _U(b - a)
            for h in hashes[a:b]:
                whole = mix(np.array([whole]) * _U(INVERSE) + h)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> int:
    """Jaccard similarity of two sets in whole percent, rounded down; 0 for empty ones."""
    if not len(a) or not len(b):
        return 0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common // (len(a) + len(b) - common)
