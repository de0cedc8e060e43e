"""Hashes of word shingles, in whole arrays.

A batch of texts is one byte array.  The hash of a word is a polynomial in its bytes modulo 2 ** 64, taken from running sums, so that no
word is ever a Python object; k following words give a shingle.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.isin(np.arange(256), (32, *range(9, 14)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on each input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters() -> np.ndarray:
    values = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLDEN)
    values[65:91] = values[97:123]
    return values


LETTERS = _letters()
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i < n."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 21)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * up[: len(data)], out=sums[1:])
    word = np.concatenate(([False], ~SPACE[data], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLDEN)
    limits = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
    return hashes, np.searchsorted(starts, limits)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``k`` words; of fewer words, the whole sequence is one."""
    hashes, firsts = word_hashes(texts)
    n = len(hashes)
    joined = hashes[: max(0, n - k + 1)].copy()
    for j in range(1, k):
        joined = mix(joined * BASE + hashes[j : n - k + 1 + j])
    out = []
    for a, b in zip(firsts.tolist(), firsts[1:].tolist(), strict=False):
        if b - a >= k:
            own = np.sort(joined[a : b - k + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            x = hashes[a : a + 1].copy()
            for j in range(a + 1, b):
                x = mix(x * BASE + hashes[j : j + 1])
            out.append(mix(x + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def blocks(texts: list[str | None], most: int = 1 << 21):
    """Texts as UTF-8 in blocks of about ``most`` bytes: (first row, list of bytes)."""
    block: list[bytes] = []
    first = size = 0
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if block and size + len(data) > most:
            yield first, block
            block, first, size = [], k, 0
        block.append(data)
        size += len(data) + 1
    if block:
        yield first, block
