import gzip
import io

import pyarrow as pa
from pyspark.sql import functions as F

from lodestack.llm import warc as w


def test_damage_is_found_where_it_is(spark, tmp_path):
    pages = spark.range(3500).selectExpr("id as page_id", "concat('http://x/', id) as url", "concat('<p>é', id, '</p>') as html")
    rows = w.records(pages)
    files = w.write_warc(rows, f"file://{tmp_path}/a")
    own = w.leaves(rows)
    assert sorted(map(tuple, w.read_warc(files).collect())) == sorted(map(tuple, own.collect()))
    whole = gzip.decompress((tmp_path / "a" / "segment-00000001-00000.warc.gz").read_bytes())
    found = [(at, len(record)) for at, _, record in w.parse(pa.PythonFile(io.BytesIO(whole), mode="r"))]
    assert found == [(r["offset"], r["length"]) for r in own.where("segment = 1").orderBy("position").collect()]
    name = tmp_path / "a" / "segment-00000001-00000.warc.gz"
    data = bytearray(name.read_bytes())
    for position in (421, 999):
        spot = files.where(f"segment = 1 and position = {position}").first()
        data[spot["at"] + spot["size"] // 2] ^= 1
    name.write_bytes(data)
    (tmp_path / "a" / "segment-00000002-00000.warc.gz").unlink()
    short = tmp_path / "a" / "segment-00000003-00000.warc.gz"
    short.write_bytes(short.read_bytes()[:-3])
    other = w.read_warc(files)
    height = w.height_of(own)
    found = w.audit(w.tree(own, height), w.tree(other, height), height).collect()
    assert sorted((r["segment"], r["position"], r["status"]) for r in found if r["segment"] != 2) == [(1, 421, "changed"), (1, 999, "changed"), (3, 499, "changed")]
    assert sum(r["segment"] == 2 and r["status"] == "missing" for r in found) == 1000


def test_a_record_more_and_a_record_less(spark, tmp_path):
    """Later records of the same part count as changed, those before and of other parts don't."""
    pages = spark.range(2000).selectExpr("id as page_id", "'u' as url", "concat('<p>', id) as html")
    own = w.leaves(w.records(pages))
    other = w.leaves(w.records(pages.where("page_id <> 1500").unionByName(spark.createDataFrame([(400, "v", "new")], pages.schema))))
    found = w.audit(w.tree(own, 3), w.tree(other, 3), 3).collect()
    assert sorted({(r["segment"], r["status"]) for r in found}) == [(0, "changed"), (0, "extra"), (1, "changed"), (1, "missing")]
    assert min(r["position"] for r in found if r["segment"] == 0) == 401 and min(r["position"] for r in found if r["segment"] == 1) == 500


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "u", None), (5, "v", "y" * 200_000), (3, "WARC/1.0\r\n\r\n", "\r\n\r\nWARC/1.0")], "page_id long, url string, html string").withColumn("hash", F.lit(1))
    got = {r["segment"]: (r["n_records"], r["n_differing"]) for r in w.fixity(df, f"file://{tmp_path}/b").collect()}
    assert got == {-1: (1, 0), 0: (4, 0)}
    assert w.fixity(df.limit(0), f"file://{tmp_path}/c").count() == 0


def test_a_crowded_segment_has_parts(spark, tmp_path):
    df = spark.range(900).selectExpr("if(id % 3 = 0, null, id) as page_id", "'u' as url", "concat('x', id) as html")
    got = w.fixity(df, f"file://{tmp_path}/d", crowd=50, damage=F.col("key") % 97 == 13).collect()
    assert sum(r["n_records"] for r in got) == 900 and max(r["n_records"] for r in got) < 120 and len({(r["segment"], r["part"]) for r in got}) == len(got) > 10
    assert sum(r["n_differing"] for r in got) == sum(k % 97 == 13 and k % 3 != 0 for k in range(900))


def test_parse_stops_at_damage():
    good = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    read = lambda x: [(at, r) for at, _, r in w.parse(pa.PythonFile(io.BytesIO(x), mode="r"))]
    assert read(good * 2) == [(0, good), (len(good), good)] and read(good + b"junk\r\n\r\n") == [(0, good)] and read(b"") == []
