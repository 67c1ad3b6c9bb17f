import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestack.llm import mphf
from lodestack.llm import tokens as t

PIECES = ["a", "B", "é", "'", "s", " ", "  ", "\n", "\t", " ", " ", "　", "\u0085", "1", "٣", ".", "—", "中", "\x1c", "\x00", "don't", "'ll", "<|endoftext|>", "​", "𝒳", "\r\n"]


@pytest.fixture(scope="module")
def plain():
    own = Tokenizer.from_file(t.public_tokenizer())
    return lambda x: own.encode(x or "", add_special_tokens=False).ids


def test_chunks_give_the_ids_of_whole_texts(plain):
    r = random.Random(5)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["x" * 300_000, "ab cd " * 60_000, None, "hello <|endoftext|> world"]
    texts += [" ".join(r.choice(["antidisestablishment", "zq" * 11, "\x00", "é" * 12, "a", "aa"]) for _ in range(40)) for _ in range(50)]
    for slots in (t.SLOTS, 8):  # with few slots chunks replace each other all the time
        own, got = t.Encoder(t.public_tokenizer(), slots), []
        for column in (texts, texts):
            for _, _, ids, counts in own.column(pa.array(column), 2):
                got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [[*plain(x), 2] for x in texts] * 2


def test_other_tokenizers_encode_whole_texts():
    path = t.public_tokenizer("word_bpe_49k.json")
    own, plain = t.Encoder(path), Tokenizer.from_file(path)
    texts = ["Hello, World  again", None, "", "don't <|endoftext|> stop"]
    got = [x.tolist() for _, _, ids, counts in own.column(pa.array(texts), 2) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [[*plain.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_perfect_hash():
    for n in (1, 2, 7, 1000):
        keys = np.random.default_rng(n).choice(1 << 40, n, replace=False)
        pilots, seed = mphf.build(keys)
        assert sorted(mphf.slots(keys, pilots, seed, n).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        mphf.build(np.array([1, 1]))


def test_round_trip(spark, odd, none, plain, tmp_path):
    path = f"file://{tmp_path}/ids"
    keys = t.write_tokens(odd, path, t.public_tokenizer(), shards=3)
    got = t.read_tokens(keys, path).collect()
    assert len(got) == odd.count()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append([*plain(r["text"]), 2])
    found = {}
    for r in sorted(got, key=lambda r: r["start"]):
        assert len(r["ids"]) == r["n_tokens"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        found.setdefault(r["key"], []).append(r["ids"])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in texts.items()}
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["key"] for r in ordered] == sorted((r["key"] for r in got), key=lambda k: (k is not None, k))
    assert [r["start"] for r in ordered] == np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1].tolist()
    missing = t.read_tokens(spark.range(1000, 1040).select(F.col("id").alias("key")), path)
    assert missing.count() == 0
    assert t.tokenize(none, t.public_tokenizer()).count() == 0


def test_a_key_with_very_many_rows(spark, plain):
    df = spark.range(4000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "concat('t ', id % 50) as text")
    got = t.tokenize(df, t.public_tokenizer(), shards=8).collect()
    assert len(got) == 4000 and len({r["start"] for r in got}) == 4000
    assert sum(r["n_tokens"] for r in got) == sum(len(plain(f"t {k % 50}")) + 1 for k in range(4000))
