"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set is its distinct word shingles, as sorted 64-bit hashes. Equal sets are one node.

Tiles. Two sets that link share an element among the first n - ceil(t n) + 1 of each, in any one
order of all elements, so a tile is the nodes that have an element there. In a tile, a node meets
those of its size band (sizes within the threshold of each other) only, and only those with which it
can still link if the tile's element is their first common one: as many elements as must be shared
have to follow it in both. A pair is always met in the tile of its first common element, so this
loses none.

The order. Hash order puts elements of common passages into many tiles. Elements that more than
`HEAVY` nodes have are therefore moved to the end of the order: a node's first elements are then its
first that aren't heavy. For that each node offers some more elements than it needs. A node with too
few elements that aren't heavy (one of a large group of near copies, or little but common passages)
is dense. Nodes that share an early element, in hash order, with a dense one offer all their elements
in a second pass, which finds the heavy ones among these nodes anew. So a member of a large group is
met through what it has beside the group's text, and members that miss the threshold by a little
mostly aren't met at all. Either order is the same for both nodes of a pair, so no link is lost.

Pairs. Rounds of leaders come first: each larger tile's band elects one node (that with the least of
its own before the tile's element, or one by hash), and each node meets the least leader of its tiles, which joins a large group of near copies with as many pairs as it
has nodes. What is then still apart in a tile is compared in full. All pairs are tested by bitmaps
first: a bit that only one of two sets has is an element that only it has, so bit counts bound the
overlap from above. Those that pass are verified exactly, by intersecting their sorted elements.

Links. The join needs components only and never tests two nodes that are in one component by then.
`jaccard_links` skips the leaders and compares all nodes of a tile, so it counts every link.

Scale: elements are shuffled packed as 12 bytes each, and of those that are already heavy within a
task one row goes to their range, the others elsewhere. Texts never are shuffled: sets are kept for
no text, and made again for the texts of pairs to be verified. Partitions follow the number of
elements. Tiles of common elements are split by size band, and tiles beyond `BLOCK` rows are compared
as pairs of blocks, each a task's work of its own. Nothing is collected or capped but the digests of
different sets whose 64-bit names collide, by chance sets^2 / 2^64 of them, which get other names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .storage import forget, small_batches, tidied, written
from .words import WHITE, hashed, mix

WORDS, PERCENT, HEAVY, BLOCK, LEADERS, LED, BROADCAST_ROWS = 4, 85, 64, 4096, 2, 8, 2_000_000  # rows of one key, 8 bytes each: 16 MB at most
BITS, NAME_BYTES, PART_ROWS = 4, 8, 4_000_000
TILE = ["element", "plain", "cell"]
FACTORS = np.random.default_rng(7).integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; a shorter text is one shingle, a text without words none."""
    for i, j, hashes, first in hashed(column, WHITE):
        h = hashes[0]
        full = max(0, len(h) - words + 1)
        runs = np.zeros(full, np.uint64)
        for r in range(words):
            runs += h[r : r + full] * FACTORS[r]
        runs = mix(runs)
        for t in range(j - i):
            a, b = int(first[t]), int(first[t + 1])
            if b - a >= words:
                yield np.unique(runs[a : b - words + 1])
            elif b > a:
                yield mix((h[a:b] * FACTORS[: b - a]).sum(dtype=np.uint64, keepdims=True) + FACTORS[words] * np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def first_elements(n: int, percent: int = PERCENT) -> int:
    """How many first elements of a set of n must be looked at."""
    return n - -(-percent * n // 100) + 1


def _offered(n: int, percent: int) -> int:
    p = first_elements(n, percent)
    return min(n, p + max(16, p // 4))


def bitmap(elements: np.ndarray) -> np.ndarray:
    """`BITS` bits for each element, rounded up to a power of two, at least 64."""
    bits = 1 << max(6, (BITS * len(elements) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(mix(elements) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap (or rows of them) as the narrower one that its set would have had."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def least_overlap(n, m, percent: int = PERCENT):
    """The smallest overlap of sets of n and m that link."""
    return -(-percent * (n + m) // (100 + percent))


def _digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _parts(batch: pa.RecordBatch, words: int, rows: int = 500) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[bytes]]]:
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        sets = list(shingle_sets(part["text"], words))
        yield part, sets, [_digest(x) for x in sets]


@dataclass(frozen=True)
class Names:
    """64-bit names of digests: their first bytes, or those of a digest of the digest where two sets would share one."""

    width: int
    again: dict[bytes, int]

    def of(self, digests: list[bytes]) -> np.ndarray:
        own = (hashlib.blake2b(d, digest_size=16, salt=self.again[d].to_bytes(8, "little")).digest() if d in self.again else d for d in digests)
        return np.frombuffer(b"".join(d[: self.width].ljust(8, b"\0") for d in own), np.int64)


def _features(words: int, names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, sets, digests in _parts(b, words):
                bits = [bitmap(x).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in sets]
                yield pa.record_batch({"key": part["key"], "n": pa.array(list(map(len, sets)), pa.int32()), "node": pa.array(names.of(digests)), "digest": pa.array(digests, pa.binary()), "bits": pa.array(bits, pa.list_(pa.int64()))})

    return tidied(run)


def _sets(words: int, names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, sets, digests in _parts(b, words, 200):
                yield pa.record_batch({"key": part["key"], "node": pa.array(names.of(digests)), "elements": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))})

    return tidied(run)


def _pack(element: np.ndarray, own: np.ndarray, position: np.ndarray, heavy: np.ndarray, nodes: np.ndarray, n: np.ndarray) -> bytes:
    """Rows as columns of bytes, 12 a row: elements, the numbers of their nodes in a list of those met, positions."""
    used, own = np.unique(own, return_inverse=True)
    wide = np.uint16 if max(len(used), int(position.max(initial=0))) < 1 << 16 else np.uint32
    head = np.array([len(element), len(used), np.dtype(wide).itemsize], np.int64)
    return b"".join(x.tobytes() for x in (head, nodes[used], n[used], element, own.astype(wide), position.astype(wide), np.packbits(heavy)))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element, node, at, heavy), where at = n * 2^32 + position."""
    rows, used, size = (int(x) for x in np.frombuffer(data, np.int64, 3))
    wide, at, out = np.dtype(f"u{size}"), 24, []
    for kind, k in ((np.int64, used), (np.int64, used), (np.uint64, rows), (wide, rows), (wide, rows), (np.uint8, -(-rows // 8))):
        out.append(np.frombuffer(data, kind, k, at))
        at += out[-1].nbytes
    nodes, n, element, own, position, heavy = out
    return element, nodes[own], (n[own] << 32) | position.astype(np.int64), np.unpackbits(heavy, count=rows).astype(bool)


def _elements(words: int, names: Names, percent: int, whole: bool, parts: int, limit: int, flush: int = 400_000):
    """Rows (to, data): the first elements of all texts, or all, packed for each of `parts` ranges of elements.

    Equal sets of a task are one node from here on. Of an element that more than `limit` nodes of the
    task have, one row goes to its range and says that it is heavy; the others are spread by node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        sizes: dict[int, int] = {}
        rows = 0

        def out() -> Iterator[pa.RecordBatch]:
            nodes, n = np.array(list(held), np.int64), np.array(list(sizes.values()), np.int64)
            counts = np.array([len(x) for x in held.values()])
            element = np.concatenate(list(held.values()))
            own = np.repeat(np.arange(len(nodes)), counts)
            position = np.arange(len(element)) - np.repeat(np.cumsum(counts) - counts, counts)
            order = np.argsort(element, kind="stable")
            element, own, position = element[order], own[order], position[order]
            starts = np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1])))
            several = np.diff(np.concatenate((starts, [len(element)])))
            heavy = np.repeat(several > limit, several)
            elsewhere = heavy & (np.arange(len(element)) > np.repeat(starts, several))
            to = mix(element) % np.uint64(parts)
            to[elsewhere] = mix(nodes[own[elsewhere]].view(np.uint64)) % np.uint64(parts)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(parts + 1, dtype=np.uint64))
            for k in range(parts):
                at = order[cuts[k] : cuts[k + 1]]
                if len(at):
                    yield pa.record_batch({"to": pa.array([k], pa.int32()), "data": pa.array([_pack(element[at], own[at], position[at], heavy[at], nodes, n)], pa.binary())})

        for b in batches:
            for _, sets, digests in _parts(b, words):
                for node, x in zip(names.of(digests).tolist(), sets, strict=True):
                    if len(x) and node not in held:
                        held[node], sizes[node] = x[: len(x) if whole else _offered(len(x), percent)].copy(), len(x)
                        rows += len(held[node])
                if rows >= flush:
                    yield from out()
                    held.clear()
                    sizes.clear()
                    rows = 0
        if rows:
            yield from out()

    return tidied(run)


def _met(limit: int):
    """Of each range of elements, the rows of those that two nodes have at least, with `heavy` told."""

    def met(blocks: list[tuple]) -> Iterator[pa.RecordBatch]:
        element, node, at, heavy = (np.concatenate(x) for x in zip(*blocks, strict=True))
        order = np.argsort(element, kind="stable")
        element, node, at, heavy = element[order], node[order], at[order], heavy[order]
        starts = np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1])))
        counts = np.diff(np.concatenate((starts, [len(element)])))
        keep = np.flatnonzero(np.repeat((counts > 1) | np.logical_or.reduceat(heavy, starts), counts))
        element, node, at, heavy = element[keep], node[keep], at[keep], heavy[keep]
        order = np.lexsort((node, element))  # equal sets of several tasks are one node
        element, node, at, heavy = element[order], node[order], at[order], heavy[order]
        if not len(element):
            return
        first = np.concatenate(([True], (element[1:] != element[:-1]) | (node[1:] != node[:-1])))
        starts = np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1])))
        marked = np.repeat(np.logical_or.reduceat(heavy, starts), np.diff(np.concatenate((starts, [len(element)]))))
        element, node, at, marked = element[first], node[first], at[first], marked[first]
        starts = np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1])))
        counts = np.diff(np.concatenate((starts, [len(element)])))
        heavy = np.repeat(counts > limit, counts) | marked
        keep = np.flatnonzero(np.repeat(counts > 1, counts) | marked)
        for lo in range(0, len(keep), 100_000):
            k = keep[lo : lo + 100_000]
            yield pa.record_batch({"element": pa.array(element[k].view(np.int64)), "node": pa.array(node[k]), "at": pa.array(at[k]), "heavy": pa.array(heavy[k])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, held = None, []
        for b in batches:
            for k, data in zip(b["to"].to_pylist(), b["data"], strict=True):
                if k != to and held:
                    yield from met(held)
                    held = []
                to = k
                held.append(_unpack(data.as_py()))
        if held:
            yield from met(held)

    return tidied(run)


def _tiles(percent: int, whole: bool):
    """From a node's rows, in order of position, its tiles: (element, plain, common, node, n, pos, dense).

    plain tells the tiles in plain hash order, which show who has to do with a dense node; there are
    none where nodes have offered all their elements. pos is the element's place in the order, and
    common tells tiles of a heavy element, or that may have one.
    """

    def rows(at: np.ndarray, element: np.ndarray, heavy: np.ndarray):
        n = int(at[0] >> 32)
        position = at & 0xFFFFFFFF
        need, offered = first_elements(n, percent), n if whole else _offered(n, percent)
        light = offered - int(heavy.sum())
        dense = light < need and offered < n
        if not whole:
            yield element[position < need], position[position < need], True, True, dense
        if dense:
            return
        place = position - np.cumsum(heavy) + heavy  # among those that aren't heavy
        own = ~heavy & (place < need)
        yield element[own], place[own], False, False, False
        if light < need:
            own = np.flatnonzero(heavy)[: need - light]
            yield element[own], light + np.arange(len(own)), False, True, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole(batches, "node"):
            node = np.asarray(b["node"])
            at, element, heavy = np.asarray(b["at"]), np.asarray(b["element"]), np.asarray(b["heavy"].cast(pa.int8())).astype(bool)
            starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            out: list[tuple] = []
            for a, z in zip(starts, [*starts[1:], len(node)], strict=True):
                at_, first = np.unique(at[a:z], return_index=True)
                for e, pos, plain, common, dense in rows(at_, element[a:z][first], heavy[a:z][first]):
                    if len(e):
                        out.append((e, plain, common, dense, int(node[a]), int(at[a] >> 32), pos))
            if out:
                k = [len(x[0]) for x in out]
                column = lambda c, kind: pa.array(np.repeat(np.array([x[c] for x in out], kind), k))
                yield pa.record_batch({"element": pa.array(np.concatenate([x[0] for x in out])), "plain": column(1, bool), "common": column(2, bool), "node": column(4, np.int64), "n": column(5, np.int32), "pos": pa.array(np.concatenate([x[6] for x in out]).astype(np.int32)), "dense": column(3, bool)})

    return tidied(run)


def _whole(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of a partition sorted by `column`, dealt anew so that each value's rows are in one batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        values = b[column]
        last = int(np.searchsorted(np.asarray(values), values[-1].as_py(), "left"))
        if last or (held and held[-1][column][-1] != values[-1]):
            yield pa.concat_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.concat_batches(held)


def _bound(n, m, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest overlap that bitmaps of one width allow."""
    return np.minimum(n - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), m - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))


def _may_link(percent: int):
    """Of pairs with both bitmaps, those whose overlap may suffice; pairs of like widths are tested together."""

    def rows(column: pa.Array, at: np.ndarray, width: int) -> np.ndarray:
        values, starts = np.asarray(column.values).view(np.uint64), np.asarray(column.offsets)
        return values[starts[at][:, None] + np.arange(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = np.asarray(b["n_a"]).astype(np.int64), np.asarray(b["n_b"]).astype(np.int64)
            x, y = (b[c].combine_chunks() if isinstance(b[c], pa.ChunkedArray) else b[c] for c in ("bits_a", "bits_b"))
            wide_x, wide_y = np.diff(np.asarray(x.offsets)), np.diff(np.asarray(y.offsets))
            keep = np.zeros(b.num_rows, bool)
            for w, v in {(int(w), int(v)) for w, v in zip(wide_x, wide_y, strict=True)}:
                group = np.flatnonzero((wide_x == w) & (wide_y == v))
                for lo in range(0, len(group), max(1, (1 << 20) // max(w, v))):
                    at = group[lo : lo + max(1, (1 << 20) // max(w, v))]
                    most = _bound(n[at], m[at], fold(rows(x, at, w), min(w, v)), fold(rows(y, at, v), min(w, v)))
                    keep[at] = most >= least_overlap(n[at], m[at], percent)
            yield pa.record_batch({"a": b["a"], "b": b["b"]}).filter(pa.array(keep))

    return tidied(run)


def _within(n, m, pos_n, pos_m, percent: int):
    """Whether sets of n and m may link if their first common element has these places."""
    least = least_overlap(n, m, percent)
    return (n - pos_n >= least) & (m - pos_m >= least)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, the lesser node first."""
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
    return pa.record_batch({"a": pa.array(np.ascontiguousarray(pairs[:, 0])), "b": pa.array(np.ascontiguousarray(pairs[:, 1]))})


def _paired(percent: int):
    """Of small tiles, the pairs that may link by size and place, and whose components differ (and one of which is dense, in plain tiles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole(batches, "tile"):
            tile = np.asarray(b["tile"])
            ends = np.searchsorted(tile, tile, "right")
            later = ends - np.arange(len(tile)) - 1
            a = np.repeat(np.arange(len(tile)), later)
            z = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
            n, pos, node, component = (np.asarray(b[c]).astype(np.int64) for c in ("n", "pos", "node", "component"))
            plain, dense, visitor = (np.asarray(b[c].cast(pa.int8())) > 0 for c in ("plain", "dense", "visitor"))
            fit = _within(n[a], n[z], pos[a], pos[z], percent) & (component[a] != component[z]) & (~plain[a] | dense[a] | dense[z]) & ~(visitor[a] & visitor[z])
            yield _pairs(node[a[fit]], node[z[fit]])

    return tidied(run)


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["set_a"], b["set_b"], strict=True):
                x, y = np.asarray(x.values), np.asarray(y.values)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch({"a": b["a"], "b": b["b"]}).filter(pa.array(keep, pa.bool_()))

    return tidied(run)


def _compared(percent: int):
    """Of tiles (rows with element, plain, i, j sorted together), the pairs of different components whose bitmaps allow a link."""

    def tile(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = np.asarray(b["n"]).astype(np.int64)
        order = np.argsort(n, kind="stable")
        n = n[order]
        pos, node, comp, dense, block, visitor = (np.asarray(b[c].cast(pa.int64()))[order] for c in ("pos", "node", "component", "dense", "block", "visitor"))
        lists = [np.asarray(b["bits"][int(k)].values).view(np.uint64) for k in order]
        plain, i, j = b["plain"][0].as_py(), b["i"][0].as_py(), b["j"][0].as_py()
        widths = np.array([len(x) for x in lists])
        tables: dict[int, tuple[np.ndarray, int]] = {}
        for w in np.unique(widths):
            at = np.flatnonzero((widths == w) | (widths == 2 * w))
            tables[int(w)] = (np.stack([fold(lists[k], int(w)) for k in at]), int(at[0]))
        for k in range(len(n) - 1):
            end = int(np.searchsorted(n, n[k] * 100 // percent, "right"))
            if end <= k + 1:
                continue
            s = slice(k + 1, end)
            fit = (comp[s] != comp[k]) & (visitor[s] * visitor[k] == 0) & _within(n[k], n[s], pos[k], pos[s], percent)
            if plain:
                fit &= (dense[s] | dense[k]) > 0
            if i != j:
                fit &= block[s] != block[k]
            at = np.flatnonzero(fit) + k + 1
            if len(at):
                table, first = tables[int(widths[k])]
                at = at[_bound(n[k], n[at], lists[k], table[at - first]) >= least_overlap(n[k], n[at], percent)]
                yield np.full(len(at), node[k]), node[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole(batches, "tile"):
            ids = np.asarray(b["tile"])
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            found = [x for a, z in zip(starts, [*starts[1:], len(ids)], strict=True) for x in tile(b.slice(a, z - a))]
            if found:
                yield _pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return tidied(run)


class _Join:
    """The state of one join: written tables, and the components so far."""

    def __init__(self, docs: DataFrame, key: str, text: str, words: int, percent: int):
        self.words, self.percent, self.spark = words, percent, docs.sparkSession
        self.step = 1.0001 * math.log(100 / percent)
        self.docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        self.names = Names(NAME_BYTES, {})
        while True:
            self.features = written(self.docs.mapInArrow(_features(words, self.names), "key long, n int, node long, digest binary, bits array<long>"), "features")
            digests = self.features.where("n > 0").groupBy("node").agg(F.min("key").alias("first"), F.max("n").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
            self.nodes = written(digests, "nodes")
            mixed = self.nodes.where("lo <> hi").select("node")
            if mixed.isEmpty():
                break
            twice = self.features.join(mixed, "node", "left_semi").select("digest").distinct().collect()
            self.names = Names(NAME_BYTES, self.names.again | {bytes(r[0]): self.names.again.get(bytes(r[0]), 0) + 1 for r in twice})
            forget(self.features, self.nodes)
        self.parts = self._parts(self.nodes.agg(F.sum("n")).first()[0] or 0)

    def _parts(self, rows: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))

    def _tiled(self, docs: DataFrame, whole: bool) -> DataFrame:
        """The tiles of `docs`, of which each node offers all its elements or enough first ones; written."""
        ranges = self.parts * 2
        rows = docs.mapInArrow(_elements(self.words, self.names, self.percent, whole, ranges, HEAVY), "to int, data binary")
        met = written(rows.repartition(self.parts, "to").sortWithinPartitions("to").mapInArrow(_met(HEAVY), "element long, node long, at long, heavy boolean"), "elements")
        rows = met.repartition(self.parts, "node").sortWithinPartitions("node", "at").mapInArrow(_tiles(self.percent, whole), "element long, plain boolean, common boolean, node long, n int, pos int, dense boolean")
        tiles = written(rows, "tiles")
        forget(met)
        return tiles

    def _celled(self, tiles: DataFrame) -> DataFrame:
        """Tiles of two nodes at least, plain ones only with a dense one: element, plain, cell, node, n, pos, dense, visitor.

        Common elements have a tile for each size band (its cell), which the band below visits.
        """
        band = F.floor(F.log("n") / self.step).cast("int")
        cell = lambda c, v: F.struct(c.alias("cell"), F.lit(v).alias("visitor"))
        cells = F.when(F.col("common"), F.array(cell(band, False), cell(band + 1, True))).otherwise(F.array(cell(F.lit(-1), False)))
        tiles = tiles.select("*", F.explode(cells).alias("_c")).select("element", "plain", "node", "n", "pos", "dense", "_c.cell", "_c.visitor")
        useful = tiles.groupBy(*TILE).agg(F.count("*").alias("rows"), F.max("dense").alias("any"), F.min("visitor").alias("away")).where("rows > 1 and not away and (any or not plain)")
        return tiles.join(useful.select(*TILE, "rows"), TILE)

    def texts(self, nodes: DataFrame) -> DataFrame:
        """The rows of `docs` that were first to have one of the nodes (node)."""
        own = self.nodes.join(nodes, "node", "left_semi").select(F.col("first").alias("_first"))
        own = written(own.distinct(), "members")
        own = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
        return self.docs.join(own, F.col("key").eqNullSafe(F.col("_first")), "left_semi")

    def tiles(self) -> DataFrame:
        """All tiles: those of nodes that aren't dense, and plain ones of dense nodes and whoever may link with them; written."""
        first = self._tiled(self.docs, False)
        close = written(self._celled(first.where("plain")).groupBy("node").agg(F.max("dense").alias("dense")), "close")
        tiles, own = self._celled(first.where("not plain")), [first, close]
        if not close.isEmpty():
            again = self._tiled(self.texts(close.select("node")), True)
            tiles, own = tiles.unionByName(self._celled(again.drop("dense", "plain").join(close, "node").withColumn("plain", F.lit(True)))), [*own, again]
        tiles = written(tiles, "tiles")
        forget(*own)
        return tiles

    def bounded(self, pairs: DataFrame, signatures: DataFrame) -> DataFrame:
        """The pairs (a, b) that may link by their bitmaps."""
        for end in ("a", "b"):
            pairs = pairs.join(signatures.withColumnsRenamed({"node": end, "n": f"n_{end}", "bits": f"bits_{end}"}), end)
        return pairs.mapInArrow(_may_link(self.percent), "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by their elements, which are made anew from the texts of these pairs alone; written."""
        pairs = written(pairs, "pairs")
        nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "members")
        sets = self.texts(nodes).mapInArrow(_sets(self.words, self.names), "key long, node long, elements array<long>")
        sets = written(sets.drop("key").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")
        both = pairs
        for end in ("a", "b"):
            both = both.join(sets.withColumnsRenamed({"node": end, "elements": f"set_{end}"}), end)
        links = written(both.mapInArrow(_linked(self.percent), "a long, b long").distinct(), "links")
        forget(pairs, nodes, sets)
        return links

    def joined(self, label: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after each component took the name of one that its nodes' leaders have, and that one's new name.

        Equal labels are connected, which is all that the search needs; the last step finds the rest.
        """
        for end in ("a", "b"):
            links = links.join(label.withColumnsRenamed({"node": end, "component": f"of_{end}"}), end)
        hook = written(links.where("of_a <> of_b").groupBy(F.col("of_a").alias("component")).agg(F.min("of_b").alias("leads")), "hooks")
        hook = hook.join(hook.select(F.col("component").alias("leads"), F.col("leads").alias("above")), "leads", "left").select("component", F.coalesce("above", "leads").alias("leads"))
        return written(label.join(hook, "component", "left").select("node", F.coalesce("leads", "component").alias("component")), "labels")

    def tiled(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The tiles, and of their nodes the signatures (node, n, bits) and first labels, each node its own component."""
        tiles = self.tiles()
        own = self.nodes.select("node", F.col("first").alias("_first")).join(tiles.select("node").distinct(), "node", "left_semi").withColumnRenamed("node", "_node")
        signatures = self.features.join(own, (F.col("node") == F.col("_node")) & F.col("key").eqNullSafe(F.col("_first"))).select("node", "n", "bits")
        signatures = written(signatures.dropDuplicates(["node"]), "signatures")
        return tiles, signatures, written(signatures.select("node", F.col("node").alias("component")), "labels")

    def links(self) -> DataFrame:
        """Every link (a, b) of two different nodes, once: what is compared in full is all that shares a tile."""
        tiles, signatures, label = self.tiled()
        links = self.apart(tiles, signatures, label)
        forget(tiles, signatures, label)
        return links

    def run(self) -> DataFrame:
        """(node, component) of the nodes that link with another."""
        tiles, signatures, label = self.tiled()
        links = self.spark.createDataFrame([], "a long, b long")
        tile = [*TILE, "band"]
        large = written(tiles.where(F.col("rows") >= LED).drop("rows"), "large-tiles")
        for turn in range(0 if large.isEmpty() else LEADERS):
            rows = large.join(label, "node").withColumn("band", F.when(F.col("cell") < 0, F.floor(F.log("n") / self.step + turn % 2 / 2)).otherwise(-1).cast("int"))
            place = F.lit(0) if turn % 2 else F.col("pos")  # the node with the least beside what its group shares
            own = F.struct(place.alias("place"), F.xxhash64("node", F.lit(turn)).alias("by"), "node", "component")
            led = rows.groupBy(*tile).agg(F.min(own).alias("leader"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
            pairs = rows.join(led, tile).where("component <> leader.component")
            pairs = pairs.groupBy("node").agg(F.min("leader").alias("leader")).select(F.col("node").alias("a"), F.col("leader.node").alias("b"))
            new = self.verified(self.bounded(pairs, signatures))
            links, label = links.unionByName(new), self.joined(label, new)
        found = components(written(links.unionByName(self.apart(tiles, signatures, label)), "links"))
        forget(tiles, signatures, large)
        return found

    def apart(self, tiles: DataFrame, signatures: DataFrame, label: DataFrame) -> DataFrame:
        """The links (a, b) of nodes that share a tile and whose labels differ."""
        rest = tiles.drop("rows").join(label, "node")
        apart = rest.groupBy(*TILE).agg(F.count("*").alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        rest = written(rest.join(apart.select(*TILE, "rows"), TILE).withColumn("tile", F.xxhash64(*TILE)), "apart")
        columns = ["tile", "plain", "node", "component", "n", "pos", "dense", "visitor"]
        few = rest.where(F.col("rows") <= HEAVY).select(*columns).repartition(self.parts, "tile").sortWithinPartitions("tile")
        pairs = self.bounded(few.mapInArrow(_paired(self.percent), "a long, b long").distinct(), signatures)
        many = rest.where(F.col("rows") > HEAVY).join(signatures.select("node", "bits"), "node")
        many = many.withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        many = many.withColumn("tile", F.xxhash64(*TILE, "i", "j"))
        many = many.select(*columns, "i", "j", "block", "bits").repartition(self.parts, "tile").sortWithinPartitions("tile")
        pairs = pairs.unionByName(many.mapInArrow(_compared(self.percent), "a long, b long")).distinct()
        links = self.verified(pairs)
        forget(rest)
        return links


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: key, n_shingles, component_id (the smallest key that links lead to, itself included).

    A null text, or one without words, has an empty set and links with nothing. Rows with a null key
    take part; a component of such rows alone has a null id. Rows that repeat a key are rows of
    their own. An empty table gives no rows; other columns are ignored.
    """
    with small_batches(df.sparkSession):
        join = _Join(df, key, text, words, percent)
        found = join.run()
    return _rows(join, found, key).drop("node")


def jaccard_links(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `jaccard_join` with n_links: how many other rows each row links with, those of equal sets too.

    Every link is found and verified, also those between nodes that others connect already, which
    the join passes over; so the work grows with the number of links between different sets.
    """
    with small_batches(df.sparkSession):
        join = _Join(df, key, text, words, percent)
        links = join.links()
    copies = join.features.where("n > 0").groupBy("node").agg(F.count("*").alias("copies"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(copies.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    counts = copies.join(others, "node", "left").select("node", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return _rows(join, components(links), key).join(counts, "node", "left").drop("node").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def _rows(join: _Join, label: DataFrame, key: str) -> DataFrame:
    """(node, key, n_shingles, component_id) of every input row."""
    nodes = join.nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = nodes.groupBy("component").agg(F.min("first").alias("id"))
    nodes = nodes.join(ids, "component").select("node", "id")
    rows = join.features.select("key", "n", "node")
    return rows.join(nodes, "node", "left").select("node", F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("id")).alias("component_id"))


def op9_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `op9_jaccard_join`, with the number of other rows that each row links with."""
    return jaccard_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: null and wordless texts have no shingles and are alone."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {WORDS - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - {WORDS - 1}) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
LINKS_SQL = SQL.replace("AS component_id FROM", "AS component_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id)::BIGINT AS n_links FROM")
