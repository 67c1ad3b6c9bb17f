"""Words of Arrow text columns as 64-bit hashes, in numpy over the column's own bytes.

A hash of bytes s..e is (P[e] - P[s]) * B^-s mod 2^64, where P are prefix sums of T[byte] * B^i:
any word, or any beginning of a word, costs two reads. Texts are handled in pieces of `PIECE`
bytes, cut between words, so memory does not grow with a text beyond 8 bytes for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
"""Separators of `[^\\x20\\x09-\\x0D]+`."""

SYMBOLS = np.ones(256, bool)
SYMBOLS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
"""Separators of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` once A-Z are lower-cased."""

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
"""Lower-cases A-Z only."""

VALUES = np.random.default_rng(20_240_901).integers(1, 1 << 64, 256, np.uint64, endpoint=False)[FOLD]
"""A random number for each byte; letters of either case share theirs."""


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of uint64 hashes over all others (a finalizer of the splitmix kind)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def prefix_sums(data: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _power(_BASE, len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(sums))[starts])


def bounds(data: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in `data`; no word crosses an offset in `at`, which begin at 0."""
    gap = separators[data]
    before, after = np.empty_like(gap), np.empty_like(gap)
    before[:1], before[1:] = True, gap[:-1]
    after[-1:], after[:-1] = True, gap[1:]
    inner = at[(at > 0) & (at < len(data))]
    before[inner], after[inner - 1] = True, True
    return np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1


def _cuts(data: np.ndarray, separators: np.ndarray, piece: int) -> list[int]:
    """Where to cut one long text: after a separator, at about each `piece` bytes; a longer word stays whole."""
    cuts = [0]
    while len(data) - cuts[-1] > piece:
        lo, hi = cuts[-1], cuts[-1] + piece
        found = np.flatnonzero(separators[data[lo:hi]])
        while not len(found) and hi < len(data):
            lo, hi = hi, min(hi + piece, len(data))
            found = np.flatnonzero(separators[data[lo:hi]])
        if not len(found):
            break
        cuts.append(lo + int(found[-1]) + 1)
    return cuts if cuts[-1] == len(data) else [*cuts, len(data)]


def groups(at: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of consecutive texts of at most `piece` bytes together, or a single longer one."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + piece, "right")) - 1)
        yield i, j
        i = j


def hashed(column: pa.Array, separators: np.ndarray, beginnings: tuple[int, ...] = (), piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts i..j: (i, j, hashes, first), where text t has the words first[t - i]..first[t - i + 1].

    hashes has a row for the words and one for each length in `beginnings`, the hash of that many
    first bytes of a word, or 0 where the word is not longer than that.
    """
    data, at = utf8(column)
    for i, j in groups(at, piece):
        block, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
        cuts = [0, len(block)] if len(block) <= piece else _cuts(block, separators, piece)
        rows, where = [], []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = block[lo:hi]
            starts, ends = bounds(part, own if len(cuts) == 2 else own[:1], separators)
            sums = prefix_sums(part)
            found = [span_hash(sums, starts, ends)]
            for k in beginnings:
                longer = ends - starts > k
                found.append(np.where(longer, span_hash(sums, starts, np.where(longer, starts + k, ends)), np.uint64(0)))
            rows.append(np.stack(found))
            where.append(starts + lo)
        hashes = rows[0] if len(rows) == 1 else np.concatenate(rows, axis=1)
        starts = where[0] if len(where) == 1 else np.concatenate(where)
        yield i, j, hashes, np.searchsorted(starts, own)
