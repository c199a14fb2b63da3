"""Hashed word shingles of whole texts, computed on the bytes of many texts at once.

Words are the runs of bytes other than ASCII white space (space, 9 to 13) after A-Z became a-z. A word's
hash is position-free; a shingle's hash mixes those of its words. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes hashed at once. A longer text is hashed in pieces cut at white space.
PIECE = 1 << 18
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, PIECE + 4096)
        tables = []
        for base in (_P, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(value: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    value = (value ^ (value >> np.uint64(30))) * _K1
    value = (value ^ (value >> np.uint64(27))) * _K2
    return value ^ (value >> np.uint64(31))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _long(raw: bytes) -> np.ndarray:
    """Word hashes of one long text, taken in pieces."""
    found, start = [], 0
    while start < len(raw):
        end = min(len(raw), start + PIECE)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        found.append(_word_hashes(raw[start:end])[0])
        start = end
    return np.concatenate(found)


def words(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; a null text has none."""
    raws: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        hashes, starts = _word_hashes(b"\n".join(raws))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield hashes[a:b]

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > PIECE:
            if raws:
                yield from flush()
                raws, size = [], 0
            yield _long(raw)
            continue
        raws.append(raw)
        size += len(raw) + 1
        if size >= PIECE:
            yield from flush()
            raws, size = [], 0
    if raws:
        yield from flush()


def shingles(word: np.ndarray, width: int) -> np.ndarray:
    """The hash of every ``width``-word shingle; with fewer words, of the whole sequence; none without words."""
    width = min(width, len(word))
    if not width:
        return word
    value = word[: len(word) - width + 1]
    for k in range(1, width):
        value = mix(value * _K2 + word[k : len(word) - width + 1 + k])
    return mix(value + np.uint64(width))


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values
