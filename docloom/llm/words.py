"""Vectorised tokenising and rolling hashes over Arrow string batches."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that are lower-case letters, digits or beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_TABLES = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2)]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "i" if inverse else "p"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        out = np.full(size, _RINV if inverse else _R, np.uint64)
        out[0] = 1
        have = _POWERS[key] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray):
    """Starts and ends of the runs of inside bytes, cut at bounds (n+1 text offsets), and each run's text number."""
    n = len(data)
    ok = inside[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    begin = ok.copy()
    begin[1:] &= ~ok[:-1] | first[1:n]
    end = ok.copy()
    end[:-1] &= ~ok[1:] | first[1:n]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: int = 0) -> np.ndarray:
    """A 64-bit hash of each span."""
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[table][data] * powers(len(data)), out=acc[1:], dtype=np.uint64)
    return mix((acc[ends] - acc[starts]) * powers(len(data) + 1, True)[starts] + (ends - starts).astype(np.uint64))


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: int = 0) -> np.ndarray:
    """A 64-bit hash of each span in which every eight bytes are mixed with their place before they are added, so that no pattern of
    bytes cancels out; the tables are hashes of their own."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    blocks = (size + 7) // 8
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[at]
    over = np.maximum(8 * (place + 1) - np.repeat(size, blocks), 0).astype(np.uint64) * np.uint64(8)
    eight = (eight << over) >> over
    seed = np.uint64(0xA0761D6478BD642F if table else 0xE7037ED1A0B428DB)
    mixed = mix(mix(eight ^ seed) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed)
    return mix(np.add.reduceat(mixed, first) ^ (size.astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)) ^ seed)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive hashes; windows may cross texts, which the caller masks."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    acc = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * powers(len(h)), out=acc[1:], dtype=np.uint64)
    return mix((acc[n:] - acc[:-n]) * powers(len(h) + 1, True)[: len(h) - n + 1])


def slices(texts: list, most: int = 2_000_000):
    """Lists of (first, bytes list) of at most about `most` bytes; a longer text stands alone; null is empty."""
    out, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = t if isinstance(t, bytes) else t.encode() if t else b""
        if out and size + len(b) > most:
            yield first, out
            out, size, first = [], 0, i
        out.append(b)
        size += len(b)
    if out:
        yield first, out


def joined(parts: list[bytes]):
    """One array of all bytes and the n+1 offsets."""
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    return np.frombuffer(b"".join(parts), np.uint8), bounds
