"""Word shingles as 64-bit names, and SuperMinHash signatures of their sets."""

from __future__ import annotations

import numpy as np
import xxhash

GOLD, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordNames:
    """64-bit names of words, each distinct word hashed once."""

    def __init__(self, limit: int = 150_000):
        self.limit, self.known = limit, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(names: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct names of the ``k``-word shingles; fewer words make one shingle, no word none."""
    n = len(names)
    if not n:
        return names
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = mix((out ^ names[j : n - width + 1 + j]) + GOLD)
    return np.unique(out)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash: each element runs through a random permutation of the m slots; at rank j it offers j + r, r in
    [0, 1), to the slot its permutation has there. Ranks only grow, so a set is done once every slot holds less than the
    next rank: sets much larger than m take one or two rounds. All sets advance together. Values are fixed point,
    32 bits after the point; sets without elements keep the largest value."""
    out = np.full((len(sets), m), np.iinfo(np.int64).max, np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(owner):
        return out
    item = np.concatenate([s for s in sets if len(s)])
    flat, perm = out.reshape(-1), None
    for j in range(m):
        rnd = mix(item + np.uint64((j + 1) * int(GOLD) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((rnd & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            if perm is None:  # after the first round: what the first swap left
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(item), 1))
                perm[np.arange(len(item)), first] = 0
            rows = np.arange(len(item))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[rows, j] = slot
        np.minimum.at(flat, owner * m + slot, (np.int64(j) << 32) + (rnd >> np.uint64(32)).astype(np.int64))
        open_ = out.max(axis=1) >= np.int64(j + 1) << 32
        go = open_[owner]
        if not go.any():
            break
        if not go.all():
            item, owner = item[go], owner[go]
            perm = perm[go] if perm is not None else None
            k = k[go]
        first = k if j == 0 else None
    return out


def bands(sig: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """(sets × n_bands) names of the bands; the band's number is part of its name."""
    out = np.tile(np.arange(1, n_bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        out = mix((out ^ sig[:, r : n_bands * rows : rows].astype(np.uint64)) + GOLD)
    return out.astype(np.int64)
