"""Exact deduplication over a cuckoo-filter index of live digests.

The index has buckets of digests (by the digest's own first bytes). A bucket is one row: a cuckoo
filter of 16-bit fingerprints and, beside it, the bucket's content, the full digests with the key
that stays and the number of copies. A probe asks the filter first; a hit is verified against the
content, since a fingerprint may be shared; a miss needs no look at the content at all. Deleting a
digest takes its fingerprint out of the filter. When an insertion finds no free slot, the filter is
rebuilt at twice the size from the stored digests.

Scale: digests are made by built-in functions in the scan. Each task merges equal digests of a
batch before the shuffle, so a group that holds a third of all rows arrives as one row a batch.
Buckets are bounded by their number, which follows the row count (`bucket_rows`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKET_ROWS = 50_000
SLOTS, KICKS = 4, 200


class CuckooFilter:
    """Partial-key cuckoo filter over 32-byte digests; equal digests count once in it.

    It never fails: `insert` resizes from the digests that the owner passes as `stored`.
    """

    def __init__(self, rows: int = 64, table: bytes | None = None):
        n = 1 << max(2, int(np.ceil(np.log2(max(1, rows) / (SLOTS * 0.9)))))
        self.table = np.zeros((n, SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()
        self.resized = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mask = len(self.table) - 1
        print_ = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[10:18], "little") & mask
        return print_, first, self._other(first, print_)

    def _other(self, place: int, print_: int) -> int:
        return (place ^ (print_ * 0x5BD1E995 >> 3)) & (len(self.table) - 1)

    def __contains__(self, digest: bytes) -> bool:
        print_, a, b = self._places(digest)
        return print_ in self.table[a].tolist() or print_ in self.table[b].tolist()

    def _put(self, digest: bytes) -> bool:
        print_, a, b = self._places(digest)
        undo = []
        for place in (a, b):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = print_
                return True
        place = b
        for k in range(KICKS):
            slot = k % SLOTS
            undo.append((place, slot, int(self.table[place, slot])))
            self.table[place, slot], print_ = print_, int(self.table[place, slot])
            place = self._other(place, print_)
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = print_
                return True
        for place, slot, was in reversed(undo):
            self.table[place, slot] = was
        return False

    def insert(self, digest: bytes, stored) -> None:
        """Add a digest that isn't live yet; `stored` iterates the live ones, for a resize."""
        rows = self.table.size
        while not self._put(digest):
            while True:
                rows *= 2
                self.resized += 1
                self.table = np.zeros((rows // SLOTS, SLOTS), np.uint16)
                if all(self._put(d) for d in stored):
                    break

    def delete(self, digest: bytes) -> bool:
        """Take a live digest's fingerprint out; the caller has verified that it is live."""
        print_, a, b = self._places(digest)
        for place in (a, b):
            at = np.flatnonzero(self.table[place] == print_)
            if len(at):
                self.table[place, at[0]] = 0
                return True
        return False


class Bucket:
    """A cuckoo filter with the content it stands for: digest -> [key that stays, copies]."""

    def __init__(self, rows: int = 64):
        self.filter, self.content = CuckooFilter(rows), {}

    def add(self, digest: bytes, key: int | None, copies: int) -> bool:
        """Whether the digest is new."""
        if digest in self.filter and (live := self.content.get(digest)) is not None:
            if key is not None and (live[0] is None or key > live[0]):
                live[0] = key
            live[1] += copies
            return False
        self.filter.insert(digest, self.content)
        self.content[digest] = [key, copies]
        return True

    def remove(self, digest: bytes, copies: int = 1) -> bool:
        """Take copies of a digest away; the last one leaves the filter and the content."""
        if digest not in self.filter or (live := self.content.get(digest)) is None:
            return False
        live[1] -= copies
        if live[1] <= 0:
            self.filter.delete(digest)
            del self.content[digest]
        return True

    def has(self, digest: bytes) -> bool:
        return digest in self.filter and digest in self.content


def digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest): SHA-256 of the text with A-Z lower-cased; a null text counts as empty."""
    return df.select(F.col(key).cast("long").alias("key"), F.unhex(F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER).cast("binary"), 256)).alias("digest"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal digests of a batch as one row, before the shuffle."""
    for b in batches:
        if b.num_rows:
            t = pa.table({"key": b["key"], "digest": b["digest"]}).group_by("digest").aggregate([("key", "max"), ("digest", "count")])
            yield from pa.table({"digest": t["digest"], "key": t["key_max"], "copies": t["digest_count"]}).to_batches()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of one partition, each built by insertion, as rows (digest, keep_key, copies)."""
    buckets: dict[int, Bucket] = {}
    for b in batches:
        for digest, key, copies, at in zip(*(b[c].to_pylist() for c in ("digest", "key", "copies", "bucket")), strict=True):
            if (own := buckets.get(at)) is None:
                own = buckets[at] = Bucket()
            own.add(digest, key, copies)
    for own in buckets.values():
        yield pa.record_batch({"digest": pa.array(list(own.content), pa.binary()), "keep_key": pa.array([x[0] for x in own.content.values()], pa.int64()), "copies": pa.array([x[1] for x in own.content.values()], pa.int64())})


def _bucket(n: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("bucket")


def groups(rows: DataFrame, n_rows: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(digest, keep_key, copies) of rows (key, digest), through the index."""
    n = max(1, -(-n_rows // bucket_rows))
    merged = rows.mapInArrow(_merged, "digest binary, key long, copies long").select("*", _bucket(max(n, 1024)))
    parts = max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return merged.repartition(parts, "bucket").mapInArrow(_grouped, "digest binary, keep_key long, copies long")


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal
    texts the row with the largest key stays. A null key loses to any other; if all keys of a group
    are null, keep_id is null and every such row is kept. Rows that repeat a key and text are all
    counted, and all marked kept if theirs is the key that stays. Other columns are ignored, and an
    empty table gives an empty result. Any length of text works: only its digest is moved.
    """
    rows = digests(df, key, text)
    found = groups(rows, df.select(key).count(), bucket_rows)
    return (
        rows.join(found, "digest")
        .select(F.col("key").alias(key), F.col("keep_key").alias("keep_id"), F.col("copies").alias("group_size"), F.col("key").eqNullSafe(F.col("keep_key")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )


STATE = "bucket int, buckets int, filter binary, digests array<binary>, keys array<long>, copies array<long>"


def build_index(df: DataFrame, key: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The index as a written table, a row a bucket of about `bucket_rows` digests at most: its filter and its content."""
    return update_index(None, df, None, key, text, bucket_rows)


def _buckets(index: DataFrame | None) -> int:
    return (index.agg(F.max("buckets")).first()[0] or 0) if index is not None else 0


def update_index(index: DataFrame | None, inserted: DataFrame | None, deleted: DataFrame | None, key: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`index` after insertions, then deletions, as a new written table. Deleting what isn't live does nothing.

    Once its buckets would hold more than twice `bucket_rows` on average, the index is dealt anew to
    more of them, from the digests that it stores.
    """
    live = index.agg(F.sum(F.size("digests"))).first()[0] or 0 if index is not None else 0
    need = max(1, -(-(live + (inserted.count() if inserted is not None else 0)) // bucket_rows))
    buckets = _buckets(index)
    again = 0 < 2 * buckets < need
    buckets = need if again or not buckets else buckets

    def changed(at, state: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        own = Bucket()
        for r in state.itertuples():
            own.filter = CuckooFilter(table=r.filter)
            own.content = {bytes(d): [None if pd.isna(k) else int(k), int(c)] for d, k, c in zip(r.digests, r.keys, r.copies, strict=True)}
        for r in change.sort_values("deleted").itertuples():
            k = None if pd.isna(r.key) else int(r.key)
            own.remove(bytes(r.digest), int(r.copies)) if r.deleted else own.add(bytes(r.digest), k, int(r.copies))
        live = own.content
        return pd.DataFrame({"bucket": [int(at[0])], "buckets": [buckets], "filter": [own.filter.table.tobytes()], "digests": [list(live)], "keys": [[x[0] for x in live.values()]], "copies": [[x[1] for x in live.values()]]})

    sides = [digests(d, key, text).mapInArrow(_merged, "digest binary, key long, copies long").select("*", _bucket(buckets), F.lit(flag).alias("deleted")) for d, flag in ((inserted, False), (deleted, True)) if d is not None]
    if again:
        old = index.select(F.explode(F.arrays_zip("digests", "keys", "copies")).alias("x")).select(F.col("x.digests").alias("digest"), F.col("x.keys").alias("key"), F.col("x.copies").alias("copies"))
        sides.append(old.select("*", _bucket(buckets), F.lit(False).alias("deleted")))
    if not sides:
        return index
    change = sides[0]
    for side in sides[1:]:
        change = change.unionByName(side)
    state = index if index is not None and not again else change.sparkSession.createDataFrame([], STATE)
    return written(state.groupBy("bucket").cogroup(change.groupBy("bucket")).applyInPandas(changed, STATE), "cuckoo")


def probe(index: DataFrame, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, live): whether the index has each row's text. Equal texts are asked once, so a text of very many rows is no bucket's burden."""

    def asked(at, state: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        own = Bucket()
        for r in state.itertuples():
            own.filter, own.content = CuckooFilter(table=r.filter), dict.fromkeys(map(bytes, r.digests))
        return pd.DataFrame({"digest": rows["digest"], "live": [own.has(bytes(d)) for d in rows["digest"]]})

    rows = digests(df, key, text)
    once = rows.select("digest").distinct().select("*", _bucket(max(1, _buckets(index))))
    found = index.groupBy("bucket").cogroup(once.groupBy("bucket")).applyInPandas(asked, "digest binary, live boolean")
    return rows.join(found, "digest").select(F.col("key").alias(key), "live")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document: null texts count as empty ones, rows without an id never stay where one with an id does."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
