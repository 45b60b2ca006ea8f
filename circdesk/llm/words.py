"""Hashes of words and of runs of words, for operators that work inside Python tasks."""

from __future__ import annotations

import numpy as np

_FACTOR = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20  # bytes of a text that are hashed together
_LETTER = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64)  # a fixed random number per byte
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = (_powers(base, _BLOCK) for base in (_FACTOR, pow(_FACTOR, -1, 2**64)))


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word, where words end at the six ASCII spaces and nowhere else.

    A word is the polynomial of its bytes' random numbers, taken for all words of a block at once as
    the difference of two running sums, moved to the word's own start.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        space, size = _IS_SPACE[data[at: at + _BLOCK]], _BLOCK
        while at + size < len(data) and not space.any():  # a word longer than a block
            size *= 2
            space = _IS_SPACE[data[at: at + size]]
        if at + size < len(data):
            space = space[: len(space) - int(np.argmax(space[::-1]))]
        out.append(_hashed(data[at: at + len(space)], space))
        at += len(space)
    return np.concatenate(out)


def _hashed(data: np.ndarray, space: np.ndarray) -> np.ndarray:
    up, down = _UP, _DOWN
    if len(data) > _BLOCK:
        up, down = (_powers(base, len(data)) for base in (_FACTOR, pow(_FACTOR, -1, 2**64)))
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=sums[1:])
    return scramble((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending, each value once; sorting short arrays is faster than numpy's hashed ``unique``."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words; empty if there are fewer words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, length):
        out = scramble(out * np.uint64(_FACTOR) + words[i: i + n]) if i % 4 == 3 else out * np.uint64(_FACTOR) + words[i: i + n]
    return scramble(out)


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
