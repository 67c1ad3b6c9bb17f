"""Token ids as raw binary shards, with a minimal perfect hash index from document keys to their place.

Files of a folder:
  shard-NNNNN.ids  magic, width (2 or 4, by the vocabulary), the ids of its documents one after
                   another as little-endian unsigned integers, then documents, ids and magic again
  index-NNNNN.npz  for the keys that hash to this part: the perfect hash's pilots and, by slot, a
                   fingerprint, the shard, the offset in ids and the number of ids
  layout.json      ids of each shard, in order, and the number of index parts

Shards follow ascending keys. A key is found by one part, one pilot and one slot, whatever the
number of documents; a slot whose fingerprint differs means that the key isn't there.

Scale: texts are range-partitioned once by key (ties by the text's hash, so a key with very many
rows is spread), each task writes one shard as a stream, and index parts hold about `PART_KEYS`
keys each. The driver gets one small row per shard. Files are written under another name and
renamed, so a task that is run again replaces its own file.
"""

from __future__ import annotations

import io
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mphf
from .storage import file_system, kept, new_file, parts, put_file, shared_dir, tidied, written
from .words import PIECE, WHITE, groups, mix, utf8

MAGIC, END_ID, PART_KEYS, SLOTS, PACK, SHARD_BYTES = b"LODEIDS1", 2, 20_000, 1 << 19, 4000, 64 << 20
NO_KEY = -1 << 63
MASKS = np.zeros((25, 24), np.uint8)
MASKS[np.arange(24) < np.arange(25)[:, None]] = 0xFF
MASKS = MASKS.view(np.uint64)
"""For each number of bytes, three words that keep so many first ones."""
GRAPHIC = np.zeros(256, bool)
GRAPHIC[0x21:0x7F] = True
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True


def chunk_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where texts may be cut so that encoding the chunks gives the ids of the whole.

    The tokenizer first splits a text with a pattern whose pieces never continue from a letter,
    digit or sign into white space, nor from a letter into a digit or sign. Only bytes that are
    certain count: after a non-ASCII character that could be a white space nothing is cut.
    """
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        before, here = data[:-1], data[1:]
        wide = before >= 0x80
        if wide.any():
            b2 = np.concatenate(([0], data[:-2]))
            b3 = np.concatenate(([0, 0], data[:-3]))[: len(before)] if len(data) > 2 else np.zeros(len(before), np.uint8)
            wide &= ~((b2 == 0xC2) & ((before == 0x85) | (before == 0xA0)))
            wide &= ~((b3 >= 0xE1) & (b3 <= 0xE3) & ((b2 == 0x80) | (b2 == 0x81) | (b2 == 0x9A)))
        cut[1:] = (WHITE[here] & (GRAPHIC[before] | wide)) | (LETTER[before] & GRAPHIC[here] & ~LETTER[here])
    cut[at[at < len(data)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes whole Arrow columns; ids of short chunks met before are kept, as words repeat.

    What is kept is a table of `SLOTS` chunks of at most 24 bytes and 8 ids, some 30 MB in all. A
    chunk has one slot, in which it replaces whatever was there, and is found by all its bytes.
    """

    def __init__(self, path: str, slots: int = SLOTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side as it is
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        own = json.loads(self.tokenizer.to_str())
        split = own["pre_tokenizer"] or {}
        self.cuts = own["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        """Whether this tokenizer splits texts by the pattern that `chunk_starts` knows; else texts are encoded whole."""
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items() if self.cuts else ():
            self.bytes[i] = len(token)  # a character stands for a byte
        self.slots = slots
        self.key, self.size = np.zeros((slots, 3), np.uint64), np.zeros(slots, np.uint8)
        self.kept, self.n_kept = np.zeros((slots, 8), np.uint32), np.zeros(slots, np.uint8)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) by the tokenizer itself."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _packed(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each chunk) of short chunks, many at a time.

        Chunks that begin with a space are encoded as one text, in which each begins where texts may
        be cut; whose ids are whose then follows from the bytes that ids stand for.
        """
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        good = np.fromiter((c[0] == 0x20 for c in chunks), bool, len(chunks))
        at = np.flatnonzero(good)
        data = np.frombuffer(b"".join(chunks[k] for k in at) + b" ", np.uint8)
        good[at] = np.isin(np.cumsum(sizes[at]), chunk_starts(data, np.zeros(1, np.int64)))
        at, rest = np.flatnonzero(good), np.flatnonzero(~good)
        counts, found = np.zeros(len(chunks), np.int64), []
        for lo in range(0, len(at), PACK):
            own = at[lo : lo + PACK]
            ids, _ = self._plain([b"".join(chunks[k] for k in own).decode()])
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(sizes[own]))
            counts[own] = np.diff(ends, prepend=-1)
            found.append(ids)
        more, counts[rest] = self._plain([chunks[k].decode() for k in rest])
        out, first = np.empty(int(counts.sum()), np.uint32), np.repeat(good, counts)
        out[first], out[~first] = np.concatenate(found) if found else np.zeros(0, np.uint32), more
        return out, counts

    def _short(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each chunk) of chunks of 1 to 24 bytes."""
        padded = np.concatenate((data, np.zeros(24, np.uint8)))
        key = np.lib.stride_tricks.sliding_window_view(padded, 24)[starts].view(np.uint64)
        key &= MASKS[sizes]
        slot = (mix(key[:, 0] + mix(key[:, 1] + mix(key[:, 2] + sizes.astype(np.uint64)))) % np.uint64(self.slots)).astype(np.int64)
        hit = (self.size[slot] == sizes) & (self.key[slot] == key).all(1)
        lengths = np.where(hit, self.n_kept[slot], 0).astype(np.int64)
        missed = np.flatnonzero(~hit)
        if not len(missed):
            return self._gathered(slot, lengths, int(lengths.sum())), lengths
        whole = np.concatenate((key[missed], sizes[missed, None].astype(np.uint64)), 1)
        _, first, own = np.unique(np.ascontiguousarray(whole).view("V32").ravel(), return_index=True, return_inverse=True)
        where = missed[first]
        chunks = [data[a : a + n].tobytes() for a, n in zip(starts[where].tolist(), sizes[where].tolist(), strict=True)]
        ids, counts = self._packed(chunks) if self.cuts else self._plain([c.decode() for c in chunks])
        before = np.cumsum(counts) - counts
        lengths[missed] = counts[own]
        out = np.empty(int(lengths.sum()), np.uint32)
        of_hit = np.repeat(hit, lengths)
        out[of_hit] = self._gathered(slot[hit], lengths[hit], int(lengths[hit].sum()))
        n = lengths[missed]
        out[~of_hit] = ids[np.repeat(before[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        keep = np.flatnonzero(counts <= 8)
        place, last = np.unique(slot[where[keep]][::-1], return_index=True)  # one of those that share a slot
        keep = keep[::-1][last]
        self.key[place], self.size[place], self.n_kept[place] = key[where[keep]], sizes[where[keep]], counts[keep]
        at = before[keep, None] + np.arange(8)
        self.kept[place] = ids[np.minimum(at, len(ids) - 1)] if len(ids) else 0
        return out, lengths

    def _gathered(self, slot: np.ndarray, lengths: np.ndarray, total: int) -> np.ndarray:
        return self.kept.ravel()[np.repeat(slot * 8 - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)]

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each chunk) of the chunks, in order."""
        sizes = ends - starts
        short = sizes <= 24
        ids, lengths = self._short(data, starts[short], sizes[short])
        if short.all():
            return ids, lengths
        long_ids, long_lengths = self._plain([data[a:z].tobytes().decode() for a, z in zip(starts[~short].tolist(), ends[~short].tolist(), strict=True)])
        counts = np.empty(len(starts), np.int64)
        counts[short], counts[~short] = lengths, long_lengths
        out, of_short = np.empty(int(counts.sum()), np.uint32), np.repeat(short, counts)
        out[of_short], out[~of_short] = ids, long_ids
        return out, counts

    def column(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of texts i..j: (i, j, ids, number of ids of each text), end ids included."""
        data, at = utf8(texts)
        for i, j in groups(at):
            block, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
            starts = chunk_starts(block, own[:-1]) if self.cuts else np.unique(own[:-1][own[:-1] < len(block)])
            if self.cuts and self.marks:  # a text with an added token's string is one chunk
                raw = block.tobytes()
                if any(m in raw for m in self.marks):
                    uncut = np.array([any(m in raw[a:z] for m in self.marks) for a, z in zip(own.tolist(), own[1:].tolist(), strict=False)])
                    of = np.searchsorted(own, starts, "right") - 1
                    starts = starts[~uncut[of] | (starts == own[of])]
            ends = np.concatenate((starts[1:], [len(block)])) if len(starts) else starts
            parts, counts, k = [], [], 0
            while k < len(starts):
                z = max(k + 1, int(np.searchsorted(ends, starts[k] + PIECE, "right")))
                ids, lengths = self._encode(block[starts[k] : ends[z - 1]], starts[k:z] - starts[k], ends[k:z] - starts[k])
                parts.append(ids)
                counts.append(lengths)
                k = z
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            sums = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, np.int64)
            lasts = sums[np.searchsorted(starts, own[1:])]
            yield i, j, np.insert(ids, lasts, end_id).astype(np.uint32), np.diff(np.concatenate(([0], lasts))) + 1


def _write_shard(path: str, tokenizer: str, end_id: int):
    """Writes a partition's texts, in order, as one shard, and yields their places as it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, rows, total, last, ordinal = kept(f"encoder {tokenizer}", lambda: Encoder(tokenizer)), TaskContext.get().partitionId(), 0, 0, None, -1
        with new_file(f"{path}/shard-{shard:05}.ids") as out:
            out.write(MAGIC + own.width.to_bytes(8, "little"))
            for b in parts(batches):
                offsets, lengths = [], []
                for _, _, ids, counts in own.column(b["text"], end_id):
                    out.write(ids.astype(f"<u{own.width}").tobytes())
                    lengths.append(counts)
                    offsets.append(total + np.cumsum(counts) - counts)
                    total += len(ids)
                ordinals = []
                for k in b["key"].to_pylist():
                    last, ordinal = k, ordinal + 1 if k == last else 0
                    ordinals.append(ordinal)
                rows += b.num_rows
                yield pa.record_batch({"key": b["key"], "shard": pa.array(np.full(b.num_rows, shard, np.int32)), "ordinal": pa.array(ordinals, pa.int64()), "offset": pa.array(np.concatenate(offsets)), "n_ids": pa.array(np.concatenate(lengths))})
            out.write(rows.to_bytes(8, "little") + total.to_bytes(8, "little") + MAGIC)

    return tidied(run)


def _hash_input(key: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    key = key.astype(np.int64).view(np.uint64)
    return np.where(ordinal == 0, key, mix(key ^ mix(ordinal.astype(np.uint64)))).view(np.int64)


def _write_index(path: str):
    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        keys = _hash_input(table["key"].to_numpy(), table["ordinal"].to_numpy())
        pilots, seed = mphf.build(keys)
        place = mphf.slots(keys, pilots, seed, len(keys))
        prints = mphf.fingerprints(keys)
        by_slot = {"pilots": pilots, "seed": np.array([seed])}
        for name, values in (("print", prints), ("shard", table["shard"].to_numpy()), ("offset", table["offset"].to_numpy()), ("n_ids", table["n_ids"].to_numpy())):
            by_slot[name] = np.empty_like(values)
            by_slot[name][place] = values
        out = io.BytesIO()
        np.savez(out, **by_slot)
        put_file(f"{path}/index-{part:05}.npz", lambda f: f.write(out.getvalue()))
        return pa.table({"part": pa.array([part], pa.int32()), "keys": pa.array([len(keys)], pa.int64())})

    return run


def _part(n: int):
    return F.pmod(F.xxhash64("key", "ordinal"), F.lit(n)).cast("int").alias("part")


def write_tokens(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write shards, index and layout under `path`; returns (key, ordinal) of all documents written.

    A null text counts as empty, so its document has the end id alone; a null key sorts first. Rows
    that repeat a key are told apart by `ordinal`, 0 and up in the order of their texts' hashes.
    A special token's string in a text gives that token, as the library does by default. By default
    there are as many shards as the session has shuffle partitions, more where texts are longer than
    `SHARD_BYTES` for each. An empty table gives a folder without keys.
    """
    spark = df.sparkSession
    if not shards:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // SHARD_BYTES))
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    rows = rows.repartitionByRange(shards, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    places = written(rows.mapInArrow(_write_shard(path, tokenizer, end_id), "key long, shard int, ordinal long, offset long, n_ids long"), "token-places")
    own = places.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"), F.count("*").alias("rows"), F.min("key").alias("first"), F.max(F.struct("key", "ordinal")).alias("last")).orderBy("shard").collect()
    carried, last, upto = {}, None, 0
    for r in own:  # a key's rows may go on into the next shards
        carried[r["shard"]] = upto if r["first"] == last else 0
        upto = r["last"]["ordinal"] + 1 + (carried[r["shard"]] if r["last"]["key"] == r["first"] else 0)
        last = r["last"]["key"]
    if over := {s: n for s, n in carried.items() if n}:
        firsts = {r["shard"]: r["first"] for r in own}
        more = F.coalesce(*(F.when((F.col("shard") == s) & (F.col("key") == firsts[s]), F.lit(n)) for s, n in over.items()), F.lit(0))
        places = places.withColumn("ordinal", F.col("ordinal") + more)
    n_parts = max(1, -(-sum(r["rows"] for r in own) // PART_KEYS))
    places.select("*", _part(n_parts)).groupBy("part").applyInArrow(_write_index(path), "part int, keys long").write.parquet(shared_dir(spark, "token-parts"))
    layout = {"parts": n_parts, "shards": {str(r["shard"]): r["n_ids"] for r in own}}
    put_file(f"{path}/layout.json", lambda f: f.write(json.dumps(layout).encode()))
    return places.select("key", "ordinal")


def read_layout(path: str) -> dict:
    files, at = file_system(path)
    with files.open_input_stream(f"{at}/layout.json") as f:
        return json.loads(f.read())


def _look_up(path: str):
    def run(table: pa.Table) -> pa.Table:
        files, at = file_system(path)
        with files.open_input_stream(f"{at}/index-{table['part'][0].as_py():05}.npz") as f:
            index = np.load(io.BytesIO(f.read()))
        key, ordinal = table["key"].to_numpy(), table["ordinal"].to_numpy()
        keys = _hash_input(key, ordinal)
        n = len(index["print"])
        place = mphf.slots(keys, index["pilots"], int(index["seed"][0]), n)
        there = index["print"][place] == mphf.fingerprints(keys)
        place = place[there]
        return pa.table({"key": key[there], "ordinal": ordinal[there], "shard": index["shard"][place], "offset": index["offset"][place], "n_ids": index["n_ids"][place]})

    return run


def _read_shards(path: str, starts: dict[int, int], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = file_system(path)
        shard, source, width = None, None, 0
        for b in parts(batches):
            ids, first, crc = [], [], []
            for s, offset, n in zip(*(b[c].to_pylist() for c in ("shard", "offset", "n_ids")), strict=True):
                if s != shard:
                    if source:
                        source.close()
                    shard, source = s, files.open_input_file(f"{at}/shard-{s:05}.ids")
                    head = source.read_at(16, 0)
                    if head[:8] != MAGIC:
                        raise ValueError(f"shard {s} isn't a shard file")
                    width = int.from_bytes(head[8:], "little")
                values = np.frombuffer(source.read_at(n * width, 16 + offset * width), f"<u{width}").astype("<u4")
                if len(values) != n:
                    raise ValueError(f"shard {s} ends before id {offset + n}")
                crc.append(zlib.crc32(values))
                first.append(starts[s] + offset)
                if with_ids:
                    ids.append(values.astype(np.int64))
            out = {"key": b["key"], "ordinal": b["ordinal"], "start": pa.array(first, pa.int64()), "n_tokens": b["n_ids"], "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.record_batch(out | ({"ids": pa.array(ids, pa.list_(pa.int64()))} if with_ids else {}))

    return tidied(run)


def read_tokens(keys: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(key, ordinal, start, n_tokens, ids_crc32, ids) from the files, for the keys that are there; others give no row.

    `keys` has key and ordinal (or key alone, for the first row of each). start counts the ids of
    all documents before; ids_crc32 is over the ids as little-endian 32-bit integers.
    """
    spark, layout = keys.sparkSession, read_layout(path)
    starts, total = {}, 0
    for s, n in sorted((int(s), n) for s, n in layout["shards"].items()):
        starts[s], total = total, total + n
    if "ordinal" not in keys.columns:
        keys = keys.withColumn("ordinal", F.lit(0))
    rows = keys.select(F.coalesce(F.col("key").cast("long"), F.lit(NO_KEY)).alias("key"), F.col("ordinal").cast("long")).select("*", _part(layout["parts"]))
    rows = rows.groupBy("part").applyInArrow(_look_up(path), "key long, ordinal long, shard int, offset long, n_ids long") if starts else spark.createDataFrame([], "key long, ordinal long, shard int, offset long, n_ids long")
    rows = rows.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    kind = "key long, ordinal long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(_read_shards(path, starts, with_ids), kind).withColumn("key", F.nullif("key", F.lit(NO_KEY)))


def tokenize(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", path: str | None = None, **options) -> DataFrame:
    """Write `df` as token files and read every document back through the index: key, start, n_tokens, ids_crc32."""
    path = path or shared_dir(df.sparkSession, "tokens")
    keys = write_tokens(df, path, tokenizer, key, text, **options)
    return read_tokens(keys, path, with_ids=False).select(F.col("key").alias(key), "start", "n_tokens", "ids_crc32")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files: null texts give the end id alone, rows without an id come first."""
    return tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer())
