"""Scoring by masked pseudo-likelihood: a window network predicts every token from both sides.

The network embeds the `SIDE` tokens on the left and on the right of a masked position and passes
them through one hidden layer. From that layer it predicts the token in steps, each a softmax over a
few choices whose logits are a learned function of the hidden layer plus a prior, the logarithm of
the choice's count in the corpus:
  a class, one of `CLASSES` or the tail; within a class, the word, one of `MEMBERS`;
  within the tail, `LEVELS` digits of the word's hash, one after the other, which end in one of
  `DIGITS` ** `LEVELS` (16.7 million) leaves.
So the probabilities of all tokens add up to 1, and each depends on both sides in every step. A
document's score is the sum over all its tokens of log P(token | both sides).

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. The `VOCABULARY` most
frequent are members of classes, by rank; all others are the tail and, as neighbours, share `TAIL`
embeddings by hash. Tail words with one leaf are one token. Counts are quantised to eighths of a
power of two; a leaf without words counts as `UNSEEN`.

Training is local gradient descent over all documents and all their tokens. Documents are dealt by
the hash of their text and key to shards and rounds, in order of that hash; each shard of a round trains from
the last round's weights, in batches that grow over the shard, and the weights of all shards, by their
number of tokens, are averaged in a tree of groups. What shards there are, and their order, follow from the rows alone, so scores don't
hang on how the input happens to be split.

Scale: counts of words cover the corpus and are merged in each batch before their shuffle; the driver
gets them as one byte for each leaf, 16 MB, and broadcasts those and some 5 MB of sums and weights,
whatever the input. Texts are shuffled once for training. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import forget, parts, tidied, written
from .words import SYMBOLS, hashed

CLASSES, MEMBERS, TAIL, DIGITS, LEVELS = 16, 64, 1024, 8, 8
VOCABULARY, LEAVES, BITS, PACKED, UNSEEN = CLASSES * MEMBERS, DIGITS**LEVELS, DIGITS.bit_length() - 1, 1 << 14, 1e-3
SIDE, EMBED, HIDDEN = 2, 8, 16
ROUNDS, BATCH, RATE, GROUP, SHARD_BYTES = 2, 8192, 1.5, 32, 8 << 20
QUANTA = np.concatenate(([UNSEEN], 2.0 ** (np.arange(255) / 8)))
"""The count that each byte of a leaf stands for."""


@dataclass
class Words:
    """The vocabulary: sorted hashes of its words and their ranks, log counts of ranks, of the tail, and of the prefixes of leaves."""

    hashes: np.ndarray
    rank: np.ndarray
    members: np.ndarray
    classes: np.ndarray
    upper: list[np.ndarray]
    leaves: np.ndarray

    @classmethod
    def of_counts(cls, hashes: np.ndarray, counts: np.ndarray, leaves: np.ndarray) -> Words:
        """From the most frequent words, in order of rank, and the bytes of all leaves."""
        members = np.full(VOCABULARY, -30.0)
        members[: len(counts)] = np.log(counts)
        level, upper = QUANTA[leaves].reshape(-1, DIGITS).sum(1), []
        tail = np.log(level.sum())
        for _ in range(LEVELS - 1):
            upper.insert(0, np.log(level).astype(np.float32).reshape(-1, DIGITS))
            level = level.reshape(-1, DIGITS).sum(1)
        members = members.reshape(CLASSES, MEMBERS)
        classes = np.append(np.log(np.exp(members).sum(1)), tail)
        order = np.argsort(hashes)
        return cls(hashes[order], order, members.astype(np.float32), classes.astype(np.float32), upper, leaves.reshape(-1, DIGITS))

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The rank of each word of the vocabulary, of others `VOCABULARY` and up, by hash."""
        other = VOCABULARY + (h >> np.uint64(40)).astype(np.int64) % TAIL
        if not len(self.hashes):
            return other
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.rank[at], other)

    def priors(self, level: int, prefix: np.ndarray) -> np.ndarray:
        """Log counts of the digits that may follow prefixes of `level` digits."""
        return self.upper[level][prefix] if level < LEVELS - 1 else LOGS[self.leaves[prefix]]


LOGS = np.log(QUANTA).astype(np.float32)


def leaf(h: np.ndarray) -> np.ndarray:
    """The leaf of each word's hash."""
    return (h & np.uint64(LEAVES - 1)).astype(np.int64)


def _softmax(z: np.ndarray) -> np.ndarray:
    """Log probabilities, in place. Logits are log counts plus a bounded function, so far from overflow; the bound only makes sure."""
    np.minimum(z, np.float32(80), out=z)
    z -= np.log(np.exp(z) @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def _order(ids: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Tokens by class and word, those of the tail by leaf, so that their priors lie side by side."""
    return np.argsort(np.where(ids < VOCABULARY, ids, VOCABULARY + leaves))


def _shares(z: np.ndarray) -> np.ndarray:
    """Probabilities, in place."""
    np.exp(np.minimum(z, np.float32(80), out=z), out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


class Network:
    """Embeddings, hidden layer and the layers of all steps in one float32 vector; the last embedding pads beyond a text's ends."""

    def __init__(self, words: Words, weights: np.ndarray | None = None, seed: int = 1):
        shapes = ((VOCABULARY + TAIL + 1, EMBED), (2 * SIDE * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES + 1), (CLASSES + 1,), (CLASSES, HIDDEN, MEMBERS), (CLASSES, MEMBERS), (LEVELS, HIDDEN, DIGITS))
        if weights is None:
            r = np.random.default_rng(seed)
            start = [r.standard_normal(shapes[0]) / 2, r.standard_normal(shapes[1]) / np.sqrt(shapes[1][0]), *map(np.zeros, shapes[2:])]
            weights = np.concatenate([x.ravel() for x in start]).astype(np.float32)
        self.words, self.weights, self.layers, at = words, weights.copy(), [], 0
        for s in shapes:
            n = int(np.prod(s))
            self.layers.append(self.weights[at : at + n].reshape(s))
            at += n

    def _hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        embed, w1, b1 = self.layers[:3]
        x = embed[context].reshape(len(context), -1)
        return x, np.tanh(x @ w1 + b1)

    def _steps(self, h: np.ndarray, ids: np.ndarray, leaves: np.ndarray, normal=_softmax) -> Iterator[tuple[str, int, slice, np.ndarray, np.ndarray]]:
        """(layer, its number, the tokens concerned, log probabilities of the choices (or what `normal` makes of logits), the token's choice) of each step; tokens stand in `_order`."""
        w2, b2, w3, b3, w4 = self.layers[3:]
        kind = np.minimum(ids // MEMBERS, CLASSES)
        yield "class", 0, slice(None), normal(h @ w2 + (b2 + self.words.classes)), kind
        cuts = np.searchsorted(kind, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            at = slice(cuts[c], cuts[c + 1])
            if cuts[c] < cuts[c + 1]:
                yield "member", c, at, normal(h[at] @ w3[c] + (b3[c] + self.words.members[c])), ids[at] % MEMBERS
        at = slice(cuts[CLASSES], len(ids))
        if cuts[CLASSES] < len(ids):
            own, tail = h[at], leaves[at]
            for level in range(LEVELS):
                prefix = tail >> BITS * (LEVELS - level)
                digit = tail >> BITS * (LEVELS - 1 - level) & DIGITS - 1
                z = self.words.priors(level, prefix)
                z += own @ w4[level]
                yield "digit", level, at, normal(z), digit

    def score(self, context: np.ndarray, ids: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """log P of each token, given by its id and leaf, under its row of context ids."""
        order = _order(ids, leaves)
        logs, out = np.zeros(len(ids)), np.empty(len(ids))
        for _, _, at, own, choice in self._steps(self._hidden(context[order])[1], ids[order], leaves[order]):
            logs[at] += own[np.arange(len(choice)), choice]
        out[order] = logs
        return out

    def learn(self, context: np.ndarray, ids: np.ndarray, leaves: np.ndarray, rate: float = RATE) -> None:
        """One step of gradient descent on a batch."""
        embed, w1, b1, w2, b2, w3, b3, w4 = self.layers
        order = _order(ids, leaves)
        context, ids, leaves = context[order], ids[order], leaves[order]
        x, h = self._hidden(context)
        n, back, steps = len(ids), np.zeros_like(h), []
        ones = np.ones(n, np.float32)
        for layer, k, at, d, choice in self._steps(h, ids, leaves, _shares):
            d[np.arange(len(d)), choice] -= 1
            if layer == "class":
                back += d @ w2.T
                steps += [(w2, h.T @ d, 1 / n), (b2, ones @ d, 1 / n)]
            elif layer == "member":
                back[at] += d @ w3[k].T
                scale = 1 / (len(d) * n) ** 0.5  # few tokens teach a class, so it moves further for each
                steps += [(w3[k], h[at].T @ d, scale), (b3[k], ones[at] @ d, scale)]
            else:
                back[at] += d @ w4[k].T
                steps.append((w4[k], h[at].T @ d, 1 / n))
        for layer, step, scale in steps:
            layer -= np.float32(rate * scale) * step
        back *= 1 - h * h
        back /= n
        dx = (back @ w1.T).reshape(-1, EMBED)
        w1 -= np.float32(rate) * (x.T @ back)
        b1 -= np.float32(rate) * (ones @ back)
        at = context.reshape(-1, 1) * EMBED + np.arange(EMBED)
        np.subtract.at(embed.reshape(-1), at.ravel(), (np.float32(rate * n**0.5) * dx).ravel())


def contexts(ids: np.ndarray, first: np.ndarray, pad: int = VOCABULARY + TAIL) -> np.ndarray:
    """For every token of texts first[t]..first[t + 1], the ids of its neighbours, none across texts."""
    n = len(ids)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((n, 2 * SIDE), pad, np.int64)
    for k, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        at = np.arange(max(0, -step), n - max(0, step))
        same = at[text[at] == text[at + step]] if len(at) else at
        out[same, k] = ids[same + step]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [h[0] for _, _, h, _ in hashed(b["text"], SYMBOLS)]
        words, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        yield pa.record_batch({"word": pa.array(words.view(np.int64)), "n": pa.array(n.astype(np.int64))})


def _packed(table: pa.Table) -> pa.Table:
    """The bytes of a range of leaves, from (range, leaf, n)."""
    counts = np.zeros(PACKED, np.int64)
    np.add.at(counts, table["leaf"].to_numpy() % PACKED, table["n"].to_numpy())
    data = np.where(counts > 0, np.minimum(1 + np.round(8 * np.log2(np.maximum(counts, 1))), 255), 0).astype(np.uint8)
    return pa.table({"range": pa.array([table["range"][0].as_py()], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})


def vocabulary(rows: DataFrame) -> Words:
    """Counts of all words of all texts: the most frequent by count and then hash, and the leaves of the others."""
    counts = written(rows.select("text").mapInArrow(tidied(_counted), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).toPandas()
    hashes, n = top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    own = F.broadcast(counts.sparkSession.createDataFrame([(int(w),) for w in hashes], "word long"))
    tail = counts.join(own, "word", "left_anti").select(F.pmod("word", F.lit(LEAVES)).alias("leaf"), "n")
    tail = tail.groupBy("leaf").agg(F.sum("n").alias("n")).select(F.floor(F.col("leaf") / PACKED).alias("range"), "leaf", "n")
    leaves = np.zeros(LEAVES, np.uint8)
    for r in tail.groupBy("range").applyInArrow(_packed, "range long, data binary").toLocalIterator():
        leaves[r["range"] * PACKED : (r["range"] + 1) * PACKED] = np.frombuffer(r["data"], np.uint8)
    forget(counts)
    return Words.of_counts(hashes.view(np.uint64), n, leaves)


def _summed(table: pa.Table) -> pa.Table:
    table = table.sort_by("id")
    total = sum((np.frombuffer(w.as_py(), np.float64) for w in table["weights"]), np.zeros(1))
    return pa.table({"id": pa.array([table["id"][0].as_py() // GROUP], pa.int64()), "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})


def batch_size(step: int) -> int:
    """Tokens of a shard's nth batch: 256 at first, twice as many every eighth step, up to `BATCH`."""
    return min(BATCH, 256 << min(step // 8, 10))


def _trained(words: Words, weights: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, weights times n) of each shard of a partition, whose rows (shard, text) stand in order."""
    shard, net, n, step = None, None, 0, 0

    def row() -> pa.RecordBatch:
        return pa.record_batch({"id": pa.array([shard], pa.int64()), "n": pa.array([n], pa.int64()), "weights": pa.array([(net.weights.astype(np.float64) * n).tobytes()], pa.binary())})

    held = np.zeros((0, 2 + 2 * SIDE), np.int64)  # what doesn't fill a batch yet

    def learn(rows: np.ndarray, last: bool = False) -> np.ndarray:
        """Full batches of a shard, whatever the pieces it comes in, and at its end the rest; the first ones are smaller. Returns what is left."""
        nonlocal step
        while len(rows) and (last or len(rows) >= batch_size(step)):
            own = rows[: batch_size(step)]
            net.learn(own[:, 2:], own[:, 0], own[:, 1], RATE * (batch_size(step) / BATCH) ** 0.25)
            rows, step = rows[len(own) :], step + 1
        return rows

    for b in parts(batches):
        shards = np.asarray(b["shard"])
        cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if shards[lo] != shard:
                if n:
                    learn(held, True)
                    yield row()
                shard, net, n, step, held = int(shards[lo]), Network(words, weights), 0, 0, held[:0]
            for _, _, h, first in hashed(b["text"].slice(lo, hi - lo), SYMBOLS):
                ids = words.ids(h[0])
                rows = np.concatenate((ids[:, None], leaf(h[0])[:, None], contexts(ids, first)), 1)
                n += len(rows)
                held = learn(np.concatenate((held, rows)))
    if n:
        learn(held, True)
        yield row()


def train(rows: DataFrame, words: Words, rounds: int = ROUNDS, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Averaged weights after `rounds` rounds, each over another part of the documents, by the hash of their text and key; all documents train once."""
    spark = rows.sparkSession
    weights = Network(words).weights
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // (rounds * shard_bytes)))
    rows = rows.where("octet_length(text) > 0").select("text", F.xxhash64("text", "key").alias("by"))
    rows = rows.select("text", "by", F.pmod("by", F.lit(rounds)).alias("turn"), F.pmod(F.shiftright("by", 8), F.lit(shards)).alias("shard"))
    n = max(1, min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((words, weights))
        part = rows.where(F.col("turn") == turn).repartition(n, "shard").sortWithinPartitions("shard", "by").select("shard", "text")
        trained = written(part.mapInArrow(tidied(lambda batches, shared=shared: _trained(*shared.value, batches)), "id long, n long, weights binary"), "weights")
        while trained.count() > GROUP:
            trained = written(trained.groupBy(F.floor(F.col("id") / GROUP).alias("group")).applyInArrow(_summed, "id long, n long, weights binary"), "weights")
        if found := trained.orderBy("id").collect():
            weights = (sum(np.frombuffer(r["weights"], np.float64) for r in found) / sum(r["n"] for r in found)).astype(np.float32)
    return weights


def score(docs: DataFrame, words: Words, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, log_likelihood, mean_log_likelihood) of every row; the mean is null without tokens, the sum 0."""
    shared = docs.sparkSession.sparkContext.broadcast((words, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, learned = shared.value
        net = Network(own, learned)
        for b in parts(batches):
            sizes, sums = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for i, j, h, first in hashed(b["text"], SYMBOLS):
                ids, leaves = own.ids(h[0]), leaf(h[0])
                context = contexts(ids, first)
                logs = np.empty(len(ids))
                for at in range(0, len(ids), 2 * BATCH):
                    s = slice(at, at + 2 * BATCH)
                    logs[s] = net.score(context[s], ids[s], leaves[s])
                upto = np.concatenate(([0.0], np.cumsum(logs)))
                sizes[i:j], sums[i:j] = np.diff(first), upto[first[1:]] - upto[first[:-1]]
            yield pa.record_batch({"key": b["key"], "n_tokens": pa.array(sizes), "log_likelihood": pa.array(sums)})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(tidied(run), "key long, n_tokens long, log_likelihood double")
    return rows.select(F.col("key").alias(key), "n_tokens", "log_likelihood", (F.col("log_likelihood") / F.nullif("n_tokens", F.lit(0))).alias("mean_log_likelihood"))


def pseudo_likelihood(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Learn from `docs`, all of them, and score every row of it, whole texts.

    Null and wordless texts have no tokens and a sum of 0. Repeated rows are scored alike and stay;
    other columns are ignored; an empty table gives no rows. The same rows, split in whatever way,
    give the same scores but for rounding.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    words = vocabulary(rows)
    return score(docs, words, train(rows, words, rounds), key, text)


def op5_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and mean_log_likelihood of every document."""
    return pseudo_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet"))
