"""Benchmark decontamination with one Aho-Corasick automaton over the words of questions and answers.

Texts are normalised to words: A-Z lower-cased, then runs of letters, digits and non-ASCII
characters. The automaton's alphabet is the benchmark's own words; any other word sends it back to
the root. It reads each document once and reports every occurrence of every window; occurrences
are mapped back to character offsets of the original text.

Scale: documents are scanned where they lie, with no shuffle. What is broadcast is the benchmark's
text, whose size is measured first: a benchmark above `block_bytes` is scanned in several blocks,
each with an automaton of its own, and the hits of all blocks are united for each document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import kept, tidied, written

WINDOW, SHARE, BLOCK_BYTES = 13, 20, 32 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
"""A word before A-Z are lower-cased."""
NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
"""Lower-cases A-Z and makes whatever is outside words a space, byte by byte."""
HITS = "key long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def automaton(items: list[tuple[str, str | None]], window: int = WINDOW):
    """(number of each word, automaton, items of each window, words of the shortest window) of (item id, text) pairs."""
    numbers: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        own = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words(text.encode() if text else None))
        for i in range(max(1, len(own) - window + 1) if own else 0):
            windows.setdefault(own[i : i + window], set()).add(item)
    if not windows:
        return numbers, None, [], 0
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for k, w in enumerate(windows):
        found.add_word(w, (k, len(w)))
    found.make_automaton()
    return numbers, found, [sorted(x) for x in windows.values()], min(map(len, windows))


def scan(text: bytes | None, built) -> tuple[int, list[list[int]], set[str]]:
    """(number of words, ranges of words that are hit, items that occur) of one text in UTF-8.

    A word outside the benchmark resets the automaton, so it is run over the stretches between such
    words, and only over those that are as long as the shortest window.
    """
    numbers, found, items, least = built
    own, hit, seen = words(text), [], set()
    if found is not None and len(own) >= least:
        ids = np.fromiter(map(numbers.get, own, repeat(0)), np.int32, len(own))
        breaks = np.concatenate(([-1], np.flatnonzero(ids == 0), [len(ids)]))
        for k in np.flatnonzero(np.diff(breaks) > least):
            start = int(breaks[k]) + 1
            for last, (which, n) in found.iter(tuple(ids[start : breaks[k + 1]].tolist())):
                hit.append([start + last - n + 1, start + last + 1])
                seen.add(which)
    return len(own), merged(hit), {x for k in seen for x in items[k]}


def merged(ranges: list[list[int]]) -> list[list[int]]:
    """Overlapping or adjoining ranges as one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _scanned(items: Broadcast, name: str, window: int, carry: bool):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = kept(name, lambda: automaton(items.value, window))
        for batch in batches:
            earlier = batch["ranges"].to_pylist() if carry else None
            before = batch["items"].to_pylist() if carry else None
            counts, ranges, names = [], [], []
            for i, text in enumerate(batch["text"].cast(pa.binary())):
                n, hit, seen = scan(text.as_py(), built)
                if carry:
                    hit, seen = merged(hit + [list(x.values()) for x in earlier[i] or []]), seen | set(before[i] or [])
                counts.append(n)
                ranges.append([{"first": a, "last": b} for a, b in hit])
                names.append(sorted(seen))
            yield pa.record_batch({"key": batch["key"], "text": batch["text"], "n_words": pa.array(counts, pa.int64()), "ranges": pa.array(ranges, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), "items": pa.array(names, pa.list_(pa.string()))})

    return tidied(run)


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of words as spans of characters in the original text."""
    for batch in batches:
        hits, spans = [], []
        for text, ranges in zip(batch["text"], batch["ranges"].to_pylist(), strict=True):
            at = [m.span() for m in WORD.finditer(text.as_py())] if ranges else []
            hits.append(sum(r["last"] - r["first"] for r in ranges))
            spans.append([{"start": at[r["first"]][0], "end": at[r["last"] - 1][1]} for r in ranges])
        yield pa.record_batch({"key": batch["key"], "n_words": batch["n_words"], "n_hit": pa.array(hits, pa.int64()), "items": batch["items"], "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})


def _both(first, then):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from then(first(batches))

    return tidied(run)


def find_hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_words, n_hit, items, spans) for each row: the items with occurring windows and the hit stretches of the original text.

    A null or wordless text has no words and no hits; benchmark rows without an id or a word take
    no part, and rows that repeat an id are one item. Other columns of either table are ignored.
    """
    spark = docs.sparkSession
    tests = benchmark.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    for k in range(blocks):
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        own = sorted((r["item"], r["text"]) for r in part.collect())
        name = hashlib.sha256(repr((own, window)).encode()).hexdigest()
        run = _scanned(spark.sparkContext.broadcast(own), name, window, carry=k > 0)
        if k == blocks - 1:
            return rows.mapInArrow(_both(run, _mapped), HITS)
        rows = written(rows.mapInArrow(run, "key long, text string, n_words long, ranges array<struct<first:int,last:int>>, items array<string>"), "hits")
    raise AssertionError


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", share: int = SHARE, **options) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A document is contaminated when at least 1 / `share` of its words are hit, and at least one.
    Documents without words are not. Empty tables give no rows, or no hits.
    """
    return find_hits(docs, benchmark, key, text, **options).select(
        F.col("key").alias(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), "spans",
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document: null and empty texts have no words and no hits, repeated rows are found alike."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
