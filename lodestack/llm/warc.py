"""WARC files and their fixity: Merkle trees over records and ordered offset ranges.

A page is a WARC resource record; records stand in order in segment files, each a gzip member of its
own, so that any is found and read by its offset. A segment's tree has the SHA-256 of each record's
bytes as leaves and, level by level, the SHA-256 of up to `FANOUT` neighbours' hashes, each a range of
offsets, up to one root. Replicas are audited from their roots down: only the children of nodes that
differ are looked at, so the audit of an intact segment is one comparison, and a damaged record is
found in as many steps as the tree is high.

Scale: a segment is a range of ids, so records are shuffled once; a segment with more than `CROWD`
records (of an id that repeats, or of none) has several parts by the hash of the record, each a file
and a tree of its own. Nodes are tiny beside records, and each level is a join of the nodes that
differ alone.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import file_system, forget, new_file, parts, shared_dir, tidied, written

SEGMENT, CROWD, FANOUT = 1000, 10_000, 16
HEAD = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{}>\r\nWARC-Target-URI: {}\r\nContent-Type: text/html\r\nContent-Length: {}\r\n\r\n"
RECORDS = "segment long, part int, position long, offset long, length long, hash string"
FILES = "segment long, part int, position long, offset long, length long, file string, at long, size long"
TREE = ["segment", "part"]


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT, crowd: int = CROWD) -> DataFrame:
    """(segment, part, key, url, record): each page as the bytes of its WARC record; null urls and pages are empty."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.printf(F.lit(HEAD.replace("{}", "%s")), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")), F.octet_length(body).cast("string"))
    own = F.coalesce(F.floor(F.col(key) / segment), F.lit(-1)).cast("long")
    crowded = written(pages.groupBy(own.alias("segment")).agg(F.count("*").alias("n")).where(F.col("n") > crowd), "crowded")  # at most rows / crowd of them
    rows = pages.select(own.alias("segment"), F.col(key).alias("key"), F.col(url).alias("url"), F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("record"))
    rows = rows.join(F.broadcast(crowded), "segment", "left") if crowded.count() <= crowd else rows.join(crowded, "segment", "left")
    part = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("record"), F.ceil(F.col("n") / crowd)))
    return rows.select("segment", part.cast("int").alias("part"), "key", "url", "record")


def leaves(rows: DataFrame) -> DataFrame:
    """Records as leaves: segment, part, position, offset, length, hash. Equal keys stand in the order of url and hash."""
    rows = rows.select(*TREE, "key", "url", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"))
    order = Window.partitionBy(*TREE).orderBy("key", "url", "hash")
    return rows.select(*TREE, (F.row_number().over(order) - 1).cast("long").alias("position"), (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "hash")


def write_warc(rows: DataFrame, path: str, damage: Column | None = None) -> DataFrame:
    """Write each part of a segment as a compressed WARC file under `path`; returns the place of each record in them (`FILES`).

    Where `damage`, a condition on a record's key, holds, its last byte is written wrong: a replica to audit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[tuple[int, int], bytes]]:
            for b in parts(batches, 100):
                yield from zip(zip(b["segment"].to_pylist(), b["part"].to_pylist(), strict=True), b["record"].to_pylist(), strict=True)

        source = pieces()
        ahead = next(source, None)
        while ahead is not None:
            now, placed, offset, at = ahead[0], [], 0, 0
            name = f"{path}/segment-{now[0]:08}-{now[1]:05}.warc.gz"
            with new_file(name) as out:
                while ahead is not None and ahead[0] == now:
                    data = gzip.compress(ahead[1], 1, mtime=0)
                    out.write(data)
                    placed.append((offset, len(ahead[1]), at, len(data)))
                    offset, at = offset + len(ahead[1]), at + len(data)
                    ahead = next(source, None)
            n = len(placed)
            column = lambda k: pa.array([x[k] for x in placed], pa.int64())
            yield pa.record_batch({"segment": pa.array([now[0]] * n, pa.int64()), "part": pa.array([now[1]] * n, pa.int32()), "position": pa.array(range(n), pa.int64()), "offset": column(0), "length": column(1), "file": pa.array([name] * n), "at": column(2), "size": column(3)})

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.select("segment").count() // (2 * SEGMENT)))
    rows = rows.withColumn("hash", F.sha2("record", 256)).repartition(n, *TREE).sortWithinPartitions(*TREE, "key", "url", "hash")
    if damage is not None:  # once records stand in order
        rows = rows.withColumn("record", F.when(damage, F.concat(F.substring(F.col("record"), F.lit(1), F.octet_length("record") - 1), F.lit(b"?"))).otherwise(F.col("record")))
    return written(rows.select(*TREE, "record").mapInArrow(tidied(run), FILES), "warc-files")


def parse(stream: pa.NativeFile) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, the record's bytes) of each record of an uncompressed WARC stream; a damaged header ends it."""
    held, offset = b"", 0
    while True:
        while b"\r\n\r\n" not in held and (more := stream.read(1 << 16)):
            held += more
        head, mark, _ = held.partition(b"\r\n\r\n")
        if not mark:
            return
        fields = dict(line.partition(": ")[::2] for line in head.decode("utf-8", "replace").split("\r\n")[1:])
        if not head.startswith(b"WARC/") or not fields.get("Content-Length", "").isdigit():
            return
        size = len(head) + 4 + int(fields["Content-Length"]) + 4
        while len(held) < size and (more := stream.read(max(1 << 16, size - len(held)))):
            held += more
        yield offset, fields, held[:size]
        offset, held = offset + size, held[size:]


def read_warc(files: DataFrame) -> DataFrame:
    """Leaves of WARC files, from their bytes: each record at its place (`FILES`). One that can't be read has no hash; a missing file has no records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source, there = None, None, False
        for b in parts(batches):
            keep, hashes = [], []
            for file, at, size in zip(*(b[c].to_pylist() for c in ("file", "at", "size")), strict=True):
                if file != name:
                    if source:
                        source.close()
                    name, source = file, None
                    own, path = file_system(file)
                    there = own.get_file_info(path).type != fs.FileType.NotFound
                    source = own.open_input_file(path) if there else None
                keep.append(there)
                try:
                    hashes.append(hashlib.sha256(gzip.decompress(source.read_at(size, at))).hexdigest() if there else None)
                except (OSError, EOFError, zlib.error):  # a damaged member; those around it are read all the same
                    hashes.append(None)
            yield pa.record_batch([*(b[c] for c in ("segment", "part", "position", "offset", "length")), pa.array(hashes, pa.string())], ["segment", "part", "position", "offset", "length", "hash"]).filter(pa.array(keep, pa.bool_()))

    return files.repartition(*TREE).sortWithinPartitions("file", "at").mapInArrow(tidied(run), RECORDS)


def tree(own: DataFrame, height: int, fanout: int = FANOUT) -> DataFrame:
    """All nodes: segment, part, level (0: records), position, first (offset), end, n_records, hash; level `height` is the root.

    `height` must be the same for both replicas; fanout ** height should not be less than a part's records.
    """
    level = own.select(*TREE, F.lit(0).alias("level"), "position", F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("end"), F.lit(1).cast("long").alias("n_records"), F.coalesce("hash", F.lit("")).alias("hash"))
    nodes = level
    for k in range(1, height + 1):
        parent = F.floor(F.col("position") / fanout) if k < height else F.lit(0)
        kin = F.array_sort(F.collect_list(F.struct("position", "hash")))
        level = level.groupBy(*TREE, parent.cast("long").alias("up")).agg(F.min("first").alias("first"), F.max("end").alias("end"), F.sum("n_records").alias("n_records"), F.sha2(F.array_join(kin["hash"], "").cast("binary"), 256).alias("hash")).select(*TREE, F.lit(k).alias("level"), F.col("up").alias("position"), "first", "end", "n_records", "hash")
        nodes = nodes.unionByName(level)
    return nodes


def audit(a: DataFrame, b: DataFrame, height: int, fanout: int = FANOUT) -> DataFrame:
    """Where two replicas' trees differ: segment, part, position, first, end, status (changed, missing or extra in b) of each such record.

    Descends from the roots, level by level, through nodes that differ only. Records are compared by
    their position: where one is inserted or lost, all later ones of its part count as changed.
    """
    bad = None
    for k in range(height, -1, -1):
        x = a.where(F.col("level") == k).select(*TREE, "position", F.col("hash").alias("hash_a"), F.col("first").alias("first_a"), F.col("end").alias("end_a"))
        y = b.where(F.col("level") == k).select(*TREE, "position", F.col("hash").alias("hash_b"), F.col("first").alias("first_b"), F.col("end").alias("end_b"))
        if bad is not None:
            up = F.floor(F.col("position") / fanout) if k + 1 < height else F.lit(0)
            above = bad.select(*TREE, F.col("position").alias("up"))
            x, y = (z.withColumn("up", up.cast("long")).join(above, [*TREE, "up"], "left_semi").drop("up") for z in (x, y))
        bad = written(x.join(y, [*TREE, "position"], "full").where("not (hash_a <=> hash_b)"), "differing")
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return bad.select(*TREE, "position", F.coalesce("first_a", "first_b").alias("first"), F.coalesce("end_a", "end_b").alias("end"), status.alias("status"))


def height_of(own: DataFrame, fanout: int = FANOUT) -> int:
    most, k = own.agg(F.max("position")).first()[0] or 0, 1
    while fanout**k <= most:
        k += 1
    return k


def fixity(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT, damage: Column | None = None, crowd: int = CROWD) -> DataFrame:
    """Write `pages` as WARC files under `path`, read them back, and audit the files against the table.

    One row per part of a segment: segment, part, n_records, n_bytes (uncompressed), root (of the
    table), n_differing (records of the files that are changed, missing or extra). Null urls and pages
    are empty records; rows without a key are segment -1; rows that repeat a key are records of their
    own. An empty table gives no rows; other columns are ignored.
    """
    rows = records(pages, key, url, html, segment, crowd)
    own = written(leaves(rows), "leaves")
    replica = written(read_warc(write_warc(rows, path, damage)), "leaves")
    height = max(height_of(own), height_of(replica))
    a, b = written(tree(own, height), "tree"), written(tree(replica, height), "tree")
    forget(own, replica)
    differing = audit(a, b, height).groupBy(*TREE).agg(F.count("*").alias("n"))
    roots = a.where(F.col("level") == height).join(differing, TREE, "left")
    return roots.select(*TREE, "n_records", F.col("end").alias("n_bytes"), F.col("hash").alias("root"), F.coalesce("n", F.lit(0)).cast("long").alias("n_differing"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of `pages` in which the records of ids that leave 13 on division by 97 have a wrong byte."""
    return fixity(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark, "warc"), damage=F.col("key") % 97 == 13)


def _sql() -> str:
    level = "SELECT segment, p // {f} AS p, sum(n) AS n, sum(bad) AS bad, max(e) AS e, sha256(string_agg(h, '' ORDER BY p)) AS h FROM {t} GROUP BY ALL"
    return f"""
WITH r AS (SELECT coalesce(floor(page_id / {SEGMENT}), -1)::BIGINT AS segment, page_id, url,
  encode(format('WARC/1.0' || x || 'WARC-Type: resource' || x || 'WARC-Record-ID: <urn:page:{{}}>' || x || 'WARC-Target-URI: {{}}' || x || 'Content-Type: text/html' || x || 'Content-Length: {{}}' || x || x,
    coalesce(page_id::VARCHAR, ''), coalesce(url, ''), strlen(coalesce(html, ''))) || coalesce(html, '') || x || x) AS record
  FROM pages, (SELECT chr(13) || chr(10) AS x)),
l0 AS (SELECT segment, row_number() OVER o - 1 AS p, 1 AS n, CASE WHEN page_id % 97 = 13 THEN 1 ELSE 0 END AS bad, sum(octet_length(record)) OVER o AS e, sha256(record) AS h
  FROM r WINDOW o AS (PARTITION BY segment ORDER BY page_id, url, sha256(record) ROWS UNBOUNDED PRECEDING)),
top AS (SELECT max(p) AS top FROM l0),
l1 AS ({level.format(f=f"(CASE WHEN (SELECT top FROM top) < {FANOUT} THEN 1000000 ELSE {FANOUT} END)", t="l0")}),
l2 AS ({level.format(f=f"(CASE WHEN (SELECT top FROM top) < {FANOUT**2} THEN 1000000 ELSE {FANOUT} END)", t="l1")}),
l3 AS ({level.format(f="1000000", t="l2")})
SELECT segment, 0 AS part, n::BIGINT AS n_records, e::BIGINT AS n_bytes, h AS root, bad::BIGINT AS n_differing
FROM (SELECT * FROM l1 WHERE (SELECT top FROM top) < {FANOUT} UNION ALL
  SELECT * FROM l2 WHERE (SELECT top FROM top) BETWEEN {FANOUT} AND {FANOUT**2 - 1} UNION ALL
  SELECT * FROM l3 WHERE (SELECT top FROM top) >= {FANOUT**2})
"""


SQL = _sql()
