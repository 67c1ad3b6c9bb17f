"""A minimal perfect hash of 64-bit keys by hashing, displacing and ordering, in numpy.

Keys fall into small groups; each group, the largest first, takes the first pilot that sends all
its keys to free slots of a table of exactly as many slots as keys. A lookup is one pilot and one
slot. Keys that don't belong get a slot too, so each slot stores a fingerprint.
"""

from __future__ import annotations

import numpy as np

from .words import mix

GROUP = 4
_SEED, _PILOT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _slots(h: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ (pilot.astype(np.uint64) * _PILOT + _SEED)) % np.uint64(n)).astype(np.int64)


def hash_keys(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 2 + 1))


def build(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """(pilots, seed) for distinct keys; another seed is tried if a group finds no place."""
    n = len(keys)
    if len(np.unique(keys)) < n:
        raise ValueError("keys must be distinct")
    groups = max(1, -(-n // GROUP))
    seed = 0
    while True:
        h = hash_keys(keys, seed)
        group = (h >> np.uint64(32)).astype(np.int64) % groups
        order = np.argsort(group, kind="stable")
        sizes = np.bincount(group, minlength=groups)
        ends = np.cumsum(sizes)
        pilots, taken, placed = np.zeros(groups, np.uint32), np.zeros(n, bool), True
        for g in np.argsort(-sizes, kind="stable"):
            k = int(sizes[g])
            if not k:
                break
            own, at, step = h[order[ends[g] - k : ends[g]]], 0, 64
            while at < 1 << 24:
                tries = np.arange(at, at + step, dtype=np.uint64)
                slots = _slots(own[None, :], tries[:, None], n)
                good = ~taken[slots].any(1)
                if k > 1:
                    s = np.sort(slots, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(1)
                if good.any():
                    first = int(np.argmax(good))
                    pilots[g] = at + first
                    taken[slots[first]] = True
                    break
                at += step
                step = min(step * 4, 1 << 15)
            else:
                placed = False
                break
        if placed:
            return pilots, seed
        seed += 1


def slots(keys: np.ndarray, pilots: np.ndarray, seed: int, n: int) -> np.ndarray:
    """The slot of each key, 0..n-1; distinct for the keys it was built from."""
    h = hash_keys(keys, seed)
    return _slots(h, pilots[(h >> np.uint64(32)).astype(np.int64) % len(pilots)], n)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (hash_keys(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)
