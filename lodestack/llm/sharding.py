"""Sharding by a permutation-filled lookup table (consistent hashing of the Maglev kind).

Each shard prefers the slots of a prime-sized table in an order of its own, offset + j * skip. The
shards take turns; each claims its first free preference, until the table is full. Shards' shares
differ by one slot at most, and when a shard leaves, few slots of the others change hands.

Scale: placing a row is one hash, one remainder and one read from the broadcast table, in the scan
itself. The table has `slots` rows whatever the data's size, so its broadcast is bounded; rows are
neither shuffled nor grouped. A key with many rows can be spread by naming more key columns.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, SLOTS = 32, 4099


def _hash(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot; `slots` must be prime and at least the number of shards."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each once")
    if slots < len(shards) or any(slots % k == 0 for k in range(2, math.isqrt(slots) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    at = [_hash(f"{s}/offset") % slots for s in shards]
    skip = [_hash(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for s in range(len(shards)):
            while table[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % slots
            table[at[s]] = s
            left -= 1
            if not left:
                return table


def slot(*keys: str | Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its MD5, mod `slots`. Nulls count as empty strings."""
    text = F.concat_ws("\x1f", *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, *keys: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """`df` with `slot` and `shard`.

    Rows with equal keys, null ones too, meet in one shard; repeated rows stay. Columns of `df`
    named slot or shard are replaced. An empty table stays empty.
    """
    owners = ",".join(map(str, lookup_table(shards, slots)))
    names = F.array(*map(F.lit, shards))
    table = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "_owner"))
    table = table.select("slot", F.element_at(names, F.col("_owner").cast("int") + 1).alias("shard"))
    return df.drop("slot", "shard").withColumn("slot", slot(*keys, slots=slots)).join(F.broadcast(table), "slot")


def write_shards(df: DataFrame, path: str, *keys: str, shards: list[str], slots: int = SLOTS, **writer) -> None:
    """Write `df` as Parquet, a folder for each shard. Tasks write what they have read, so a hot shard is not one task's."""
    place(df, *keys, shards=shards, slots=slots).drop("slot").write.partitionBy("shard").parquet(path, **writer)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, by its id; rows without an id have one too, as `place` says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id", shards=[f"shard-{k:02}" for k in range(SHARDS)]).select("doc_id", "slot", "shard")


def _sql() -> str:
    """The table as DuckDB makes it: turn k of shard s takes its first preference that is still free."""
    return f"""
WITH RECURSIVE s AS (SELECT i AS s, format('shard-{{:02d}}', i) AS shard FROM range({SHARDS}) r(i)),
p AS (SELECT list((('0x' || substr(md5(shard || '/offset'), 1, 15))::BIGINT % {SLOTS})::INT ORDER BY s) AS o,
  list((('0x' || substr(md5(shard || '/skip'), 1, 15))::BIGINT % {SLOTS - 1} + 1)::INT ORDER BY s) AS k FROM s),
turns(t, used, slot, shard) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda x: false), NULL::INT, NULL::INT
  UNION ALL
  SELECT t + 1, used[:c] || [true] || used[c + 2:], c, t % {SHARDS} FROM (
    SELECT t, used, list_filter([((o[t % {SHARDS} + 1] + j * k[t % {SHARDS} + 1]) % {SLOTS})::INT FOR j IN range({SLOTS})], lambda x: NOT used[x + 1])[1] AS c
    FROM turns, p WHERE t < {SLOTS}))
SELECT doc_id, slot, s.shard FROM (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::INT AS slot FROM documents)
JOIN turns USING (slot) JOIN s ON turns.shard = s.s
"""


SQL = _sql()
