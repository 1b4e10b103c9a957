"""Words of many texts at once, as arrays: boundaries, owners and 64-bit hashes.

Texts are encoded, joined with a line feed between them and handled in chunks
of about ``CHUNK`` bytes, so memory does not depend on the batch; a longer text
is a chunk of its own. A word's hash comes from running sums of byte codes
times powers of an odd number (mod 2**64), divided by the power at its start.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK = 1 << 20
_RNG = np.random.default_rng(20211105)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers


class Chunk:
    """``data``: the bytes of texts ``first`` to ``first + n``; ``edge``: where each starts, and the end."""

    def __init__(self, first: int, parts: list[bytes]):
        self.first, self.n = first, len(parts)
        self.data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
        self.edge = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])

    def sums(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = _power_tables(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
        return out, down

    def owners(self, start: np.ndarray) -> np.ndarray:
        """The first word of each text, and the number of words at the end."""
        return np.searchsorted(start, self.edge)


def chunks(texts: Sequence[str]) -> Iterator[Chunk]:
    parts, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass")
        if parts and size + len(b) > CHUNK:
            yield Chunk(first, parts)
            parts, size, first = [], 0, i
        parts.append(b)
        size += len(b)
    if parts:
        yield Chunk(first, parts)


def runs(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of equal kind other than 0; the last byte is of kind 0."""
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    bounds = np.concatenate([[0], change, [len(kind)]])
    used = kind[bounds[:-1]] != 0
    return bounds[:-1][used], bounds[1:][used]
