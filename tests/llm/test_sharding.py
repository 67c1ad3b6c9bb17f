import hashlib
from collections import Counter

import pytest

from lodestack.llm import sharding as s


def brute(names, slots):
    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    prefer = [[(h(f"{n}/offset") + j * (h(f"{n}/skip") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names]
    table, turn = {}, 0
    while len(table) < slots:
        own = turn % len(names)
        table[next(x for x in prefer[own] if x not in table)] = own
        turn += 1
    return [table[k] for k in range(slots)]


def test_table():
    names = [f"n{k}" for k in range(7)]
    assert s.lookup_table(names, 101) == brute(names, 101)
    assert max(Counter(s.lookup_table(names)).values()) - min(Counter(s.lookup_table(names)).values()) <= 1
    before, after = s.lookup_table(names), s.lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 6)
    assert moved < 0.1 * len(before)
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            s.lookup_table(*bad)


def test_rows(spark, odd, none, tmp_path):
    names = ["x", "y", "z"]
    got = s.place(odd, "doc_id", shards=names, slots=101)
    table = s.lookup_table(names, 101)
    rows = got.collect()
    assert len(rows) == odd.count()
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    assert s.place(none, "doc_id", shards=names, slots=101).count() == 0
    s.write_shards(odd, str(tmp_path / "out"), "doc_id", "text", shards=names, slots=101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.count()
    assert "Python" not in got._jdf.queryExecution().toString()
