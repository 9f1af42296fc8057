"""Hashed words of whole batches of texts, in numpy: the tasks' side of the operators on word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at a time; bounds the working memory of a task whatever the texts' lengths.
PIECE = 1 << 19
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _PLACE[0]
    x = (x ^ (x >> np.uint64(27))) * _PLACE[1]
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, PIECE + 4096)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            factors = np.full(n, base, dtype=np.uint64)
            factors[0] = 1
            _powers[name] = np.cumprod(factors, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut at white space."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            nexts = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(c, at + PIECE)) >= 0]
            cut = min(nexts, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def _hash(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the buffer's words and where they start."""
    data = np.frombuffer(buffer, dtype=np.uint8)
    word = np.concatenate(([False], ~_SPACE[data], [False])).astype(np.int8)
    edge = np.diff(word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    return mix((sums[end] - sums[start]) * down[start]), start


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text, the 64-bit hashes of its words in order; words end at ASCII white space."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if group:
            hashes, start = _hash(b"\n".join(group) + b"\n")
            ends = np.cumsum([len(t) + 1 for t in group])
            yield from np.split(hashes, np.searchsorted(start, ends[:-1]))
            group.clear()

    for text in texts:
        if len(text) > PIECE:
            yield from flush()
            size = 0
            yield np.concatenate([_hash(p)[0] for p in _pieces(text)])
            continue
        if size + len(text) > PIECE:
            yield from flush()
            size = 0
        group.append(text)
        size += len(text) + 1
    yield from flush()


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of width-word shingles; fewer words: their whole sequence as one; none: empty."""
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    out = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = out * _PLACE[3] + mix(words[i : n - k + 1 + i] + _PLACE[i % 5])
    return np.unique(mix(out))
