"""Sets of hashed word shingles, numpy all through: a batch's texts are hashed as one buffer of bytes."""

from __future__ import annotations

import numpy as np

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
#: Bytes hashed at a time.
PART = 1 << 20


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[seed]
    x = (x ^ (x >> np.uint64(29))) * ODD[seed + 1]
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the start of each run of bytes that aren't blank."""
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = at + PART
        if end < len(raw):
            cut = max(raw.rfind(c, at, end) for c in (b" ", b"\n"))
            end = cut + 1 if cut >= at else min((p for c in (b" ", b"\n") if (p := raw.find(c, end)) >= 0), default=len(raw) - 1) + 1
        part = np.frombuffer(raw, dtype=np.uint8, offset=at, count=min(end, len(raw)) - at)
        edge = np.diff(np.concatenate([[True], BLANK[part], [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(first):
            size = last - first
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            power = np.cumprod(np.full(int(size.max()), ODD[0], dtype=np.uint64))
            used = np.repeat(first, size) + place
            sums = np.add.reduceat((part[used].astype(np.uint64) + np.uint64(1)) * power[place], np.cumsum(size) - size)
            hashes.append(mixed(sums + size.astype(np.uint64) * ODD[1]))
            starts.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[bytes | None], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct uint64 hashes of each text's runs of `size` words; of all its words if it has fewer; none without words."""
    texts = [(x or b"").translate(LOWER) for x in texts]
    words, starts = word_hashes(b"\n".join(texts))
    ends = np.cumsum([len(x) + 1 for x in texts])
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    runs = np.zeros(0, dtype=np.uint64)
    if len(words) >= size:
        n = len(words) - size + 1
        runs = words[:n] * ODD[0]
        for j in range(1, size):
            runs = mixed(runs + words[j : n + j], 1)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                whole = mixed(whole + words[k : k + 1] * ODD[3], 2)
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two int64 that name a set."""
    return int(mixed(tokens, 2).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed(tokens, 4)).view(np.int64)) if len(tokens) else 0
