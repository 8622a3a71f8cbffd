"""Hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a text hashed at once; powers of the base that a worker keeps.
_PART = (1 << 20) - 1
_KEPT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    found = _powers
    if len(found[0]) < n:
        size, found = 1 << (n - 1).bit_length(), []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps, dtype=np.uint64))
        if size <= _KEPT:
            _powers[:] = found
    return found[0], found[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` in order."""
    if not text:
        return np.empty(0, np.uint64)
    data, at, found = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), 0, []
    while at < len(data):
        end = min(len(data), at + _PART)
        if end < len(data):  # cut at white space; one longer word stays whole
            spaces = np.flatnonzero(_SPACE[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                later = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(later[0]) + 1 if len(later) else len(data)
        part = data[at:end]
        at = end
        space = _SPACE[part]
        begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
        ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        power, inverse = _powers_to(len(part) + 1)
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], dtype=np.uint64)]
        found.append(mixed((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64)))
    return np.concatenate(found)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of hashed shingles, sorted. Fewer words than a shingle has: all of them are the only one."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(words, len(h))
    total = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - width + 1 + k]
    return np.unique(mixed(total))


def set_key(sorted_set: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return hashlib.blake2b(sorted_set.astype("<u8").tobytes(), digest_size=16).digest()


def sketch(sorted_set: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """MinHash with one 32-bit value for each odd seed (of two rows: factors and summands)."""
    out = np.full(seeds.shape[1], np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(sorted_set), 4096):
        values = (sorted_set[at : at + 4096, None] * seeds[0] + seeds[1]) >> np.uint64(32)
        out = np.minimum(out, values.min(axis=0).astype(np.uint32))
    return out


def seeds(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    found = rng.integers(0, 1 << 64, size=(2, n), dtype=np.uint64)
    found[0] |= np.uint64(1)
    return found
