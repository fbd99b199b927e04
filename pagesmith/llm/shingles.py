"""Hashed word shingles of whole texts, vectorised over the texts of a batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
_BYTE = np.arange(256, dtype=U) + U(1)
_BYTE[65:91] += U(32)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = (x ^ (x >> U(30))) * _MIX[0]
    x = (x ^ (x >> U(27))) * _MIX[1]
    return x ^ (x >> U(31))


def _power(which: str, base: int, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        steps = np.full(max(n, PIECE + 4096), base, U)
        steps[0] = 1
        _powers[which] = np.cumprod(steps)
    return _powers[which][:n]


def _piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a piece; A-Z count as a-z."""
    buf = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[True], _BLANK[buf], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, U), start
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum(_BYTE[buf] * _power("up", _BASE, len(buf)), out=sums[1:])
    value = (sums[end] - sums[start]) * _power("down", _INVERSE, len(buf))[start]
    return scramble(value + (end - start).astype(U) * U(0xD6E8FEB86659FD93)), start


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a text of about PIECE bytes that end at a blank."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not _BLANK[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def word_hashes(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order."""
    group: list[bytes] = []
    room = PIECE

    def flush() -> Iterator[np.ndarray]:
        hashes, start = _piece(b" ".join(group))
        ends = np.cumsum([len(t) + 1 for t in group])
        yield from np.split(hashes, np.searchsorted(start, ends[:-1]))

    for text in texts:
        if len(text) > room and group:
            yield from flush()
            group, room = [], PIECE
        if len(text) > PIECE:
            yield np.concatenate([_piece(p)[0] for p in _pieces(text)])
        else:
            group.append(text)
            room -= len(text)
    if group:
        yield from flush()


def shingle_sets(texts: Iterable[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; shorter texts are one shingle."""
    factors = scramble(np.arange(1, width + 1, dtype=U)) | U(1)
    for words in word_hashes(texts):
        n = len(words)
        if n == 0:
            yield words
            continue
        k = min(n, width)
        total = np.full(n - k + 1, U(k))
        for j in range(k):
            total += words[j : n - k + 1 + j] * factors[j]
        yield np.unique(scramble(total))


def set_class(hashes: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    total = scramble(hashes ^ U(0xA0761D6478BD642F)).sum(dtype=U) + U(len(hashes))
    return int(scramble(np.array([total], U)).view(np.int64)[0])


def bitmap(hashes: np.ndarray, bits: int = 1024) -> bytes:
    """The parity of the set's elements per hashed position.

    There are ``bits`` positions, doubled until they are as many as the elements; adding the halves of a bitmap
    gives that of half the positions.
    """
    bits = max(bits, 1 << max(0, len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes % U(bits)).astype(np.int64), minlength=bits) & 1).tobytes()
