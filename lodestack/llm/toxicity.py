"""Toxicity by a linear-chain conditional random field over tokens.

Tokens are tagged toxic or not. A token's features are its word and the word's first three to five
bytes (so inflected forms share evidence). Documents are labelled, tokens are not: tokens of toxic
documents that carry a feature of the lexicon, features found in far more toxic documents than
chance allows, count as toxic tokens, all others as clean. The field is fit to these by gradient
ascent on its conditional likelihood. Forward-backward gives each token's marginal; a document's
score is a logistic function of the expected number of toxic tokens, fit to the documents' labels,
and tokens of marginal 1/2 or more are the offending spans.

Most tokens carry no feature of the lexicon. A run of g such tokens multiplies the messages by one
2 x 2 matrix to the power g, which has a closed form, so forward-backward is exact at the cost of
the other tokens alone.

Scale: fit on a bounded sample (`TOXIC_ROWS`, `CLEAN_ROWS` labelled rows by the hash of their key).
Of these, the lexicon is the `LEXICON` features of the strongest evidence among the `CANDIDATES` that
most toxic rows have, and the chain is fit on `WINDOWS` windows, half of them of either label, around
featured tokens anywhere in the sampled texts, picked by the hash of key and position. Scoring covers
whole texts and is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import tidied, written
from .words import SYMBOLS, hashed, mix

BEGINNINGS = (3, 4, 5)
TOXIC_ROWS, CLEAN_ROWS, LEXICON, CANDIDATES, WINDOWS = 3000, 20_000, 4096, 200_000, 12_000
PURITY, AROUND, THRESHOLD = 0.5, 4, 0.3
HOLD, FOLDS = 2, 4
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_KIND = np.arange(1, len(BEGINNINGS) + 2, dtype=np.uint64)[:, None]


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HOLD


def token_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As `hashed`, with a row of features for the word and for each beginning; 0 where the word is too short."""
    for i, j, h, first in hashed(column, SYMBOLS, BEGINNINGS):
        yield i, j, np.where(h == 0, np.uint64(0), mix(h + _KIND)), first


class Lexicon:
    """Sorted features, with a bit table that rules out nearly all others."""

    def __init__(self, features: np.ndarray):
        self.features = np.sort(features.astype(np.uint64))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.features & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens that carry a feature, their feature numbers or -1 by kind) of features by kind and token."""
        likely = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)].any(0))
        own = h[:, likely]
        at = np.minimum(np.searchsorted(self.features, own), max(0, len(self.features) - 1))
        at = np.where((self.features[at] == own) & (own != 0), at, -1) if len(self.features) else np.full(own.shape, -1)
        keep = (at >= 0).any(0)
        return likely[keep], at[:, keep].T


@dataclass
class Field:
    """Weights of a two-state chain: features, the bias of the toxic state, transitions; and the document's logistic."""

    features: np.ndarray
    weight: np.ndarray
    bias: float
    step: np.ndarray
    slope: float = 0.0
    level: float = -30.0

    def emission(self, ids: np.ndarray) -> np.ndarray:
        return self.bias + np.where(ids >= 0, self.weight[ids], 0.0).sum(-1)

    def run_power(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eigenvalues and projections of the matrix of one token without features."""
        m = np.exp(self.step) * np.exp([0.0, self.bias])
        values, right = np.linalg.eig(m)
        left = np.linalg.inv(right)
        top = values.max()
        return values / top, np.outer(right[:, 0], left[0]), np.outer(right[:, 1], left[1])

    def marginals(self, docs: list[tuple[int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """For (number of tokens, positions that carry features, their feature numbers): the toxic marginal at each position."""
        out = [np.zeros(len(p)) for _, p, _ in docs]
        order = sorted((k for k in range(len(docs)) if len(docs[k][1])), key=lambda k: -len(docs[k][1]))
        if not order:
            return out
        counts = np.array([len(docs[k][1]) for k in order])
        most = int(counts[0])
        gaps, score = np.zeros((len(order), most + 1), np.int64), np.zeros((len(order), most))
        for r, k in enumerate(order):
            n, p, ids = docs[k]
            gaps[r, : len(p) + 1] = np.diff(np.concatenate(([-1], p, [n]))) - 1
            score[r, : len(p)] = self.emission(ids)
        values, one, two = self.run_power()
        step = np.exp(self.step)
        score = np.minimum(score, 50.0)

        def through(g: np.ndarray) -> np.ndarray:
            return (values[0] ** g)[:, None, None] * one + (values[1] ** g)[:, None, None] * two

        alive = np.searchsorted(-counts, -np.arange(most), "left")
        forward = np.zeros((len(order), most, 2))
        message = np.zeros((len(order), 2))
        message[:, 0] = 1.0  # the chain starts clean
        for t in range(most):
            n = int(alive[t])
            m = np.einsum("ni,nij->nj", message[:n], through(gaps[:n, t])) @ step
            m[:, 1] *= np.exp(score[:n, t])
            m /= m.sum(1, keepdims=True)
            forward[:n, t], message[:n] = m, m
        after = np.ones((len(order), 2))
        for t in range(most - 1, -1, -1):
            n = int(alive[t])
            if t == most - 1 or int(alive[t + 1]) < n:
                ends = slice(int(alive[t + 1]) if t < most - 1 else 0, n)
                after[ends] = through(gaps[ends, t + 1]).sum(2)
            both = forward[:n, t] * after[:n]
            forward[:n, t] = both / both.sum(1, keepdims=True)
            here = after[:n].copy()
            here[:, 1] *= np.exp(score[:n, t])
            back = np.einsum("nij,nj->ni", through(gaps[:n, t]), here @ step.T)
            after[:n] = back / back.sum(1, keepdims=True)
        for r, k in enumerate(order):
            out[k] = forward[r, : counts[r], 1]
        return out

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        total = np.array([m.sum() for m in marginals])
        return 1 / (1 + np.exp(-(self.level + self.slope * np.log1p(total))))


def fit_chain(features: np.ndarray, ids: np.ndarray, tags: np.ndarray, rounds: int = 120, l2: float = 1e-3) -> Field:
    """Maximise the chain's conditional likelihood over windows: ids (windows, tokens, kinds), tags (windows, tokens)."""
    n, length, _ = ids.shape
    weight, bias, step = np.zeros(len(features) + 1), -2.0, np.zeros((2, 2))
    params = np.concatenate((weight, [bias], step.ravel()))
    m, v = np.zeros_like(params), np.zeros_like(params)
    flat = np.where(ids >= 0, ids, len(features)).reshape(n * length, -1)
    wanted = np.zeros_like(params)
    np.add.at(wanted, flat.ravel(), np.repeat(tags.ravel().astype(float), flat.shape[1]))
    wanted[len(features) + 1] = tags.sum()
    for a in (0, 1):
        for b in (0, 1):
            wanted[len(features) + 2 + 2 * a + b] = ((tags[:, :-1] == a) & (tags[:, 1:] == b)).sum()
    for r in range(1, rounds + 1):
        params[len(features)] = 0.0
        e = params[flat].sum(1).reshape(n, length) + params[len(features) + 1]
        step = params[-4:].reshape(2, 2)
        log_f, log_b = np.zeros((length, n, 2)), np.zeros((length, n, 2))
        log_f[0, :, 1] = e[:, 0]
        for t in range(1, length):
            log_f[t] = np.logaddexp(log_f[t - 1, :, :1] + step[0], log_f[t - 1, :, 1:] + step[1])
            log_f[t, :, 1] += e[:, t]
        for t in range(length - 2, -1, -1):
            ahead = log_b[t + 1].copy()
            ahead[:, 1] += e[:, t + 1]
            log_b[t] = np.logaddexp(ahead[:, :1] + step[:, 0], ahead[:, 1:] + step[:, 1])
        whole = np.logaddexp(log_f[-1, :, 0], log_f[-1, :, 1])
        one = np.exp(log_f[:, :, 1] + log_b[:, :, 1] - whole).T
        expected = np.zeros_like(params)
        np.add.at(expected, flat.ravel(), np.repeat(one.ravel(), flat.shape[1]))
        expected[len(features) + 1] = one.sum()
        for a in (0, 1):
            for b in (0, 1):
                ahead = log_b[1:, :, b] + (e[:, 1:].T if b else 0.0)
                expected[len(features) + 2 + 2 * a + b] = np.exp(log_f[:-1, :, a] + step[a, b] + ahead - whole).sum()
        gradient = (wanted - expected) / n - l2 * params
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params = params + 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return Field(features, params[: len(features)], float(params[len(features) + 1]), params[-4:].reshape(2, 2))


def fit_logistic(field: Field, marginals: list[np.ndarray], labels: np.ndarray) -> None:
    """Document labels on log(1 + expected toxic tokens), by damped Newton steps with a small penalty on the slope."""
    x = np.log1p([m.sum() for m in marginals])
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    w = np.array([0.0, np.log(rate / (1 - rate))])
    a = np.stack((x, np.ones_like(x)), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.1, 0.01])
        change = np.linalg.solve(hessian, a.T @ (labels - p) - np.array([0.1, 0.01]) * w)
        w = w + change * min(1.0, 4.0 / max(1e-9, np.abs(change).max()))
        if np.abs(change).max() < 1e-6:
            break
    field.slope, field.level = float(max(0.0, w[0])), float(w[1])


def _counts(candidates: np.ndarray | None):
    """Rows (feature, n): in how many texts of a batch a feature is; of the candidates only, if given."""
    lexicon = None if candidates is None else Lexicon(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = []
            for i, j, h, first in token_features(b["text"]):
                for t in range(j - i):
                    own = h[:, first[t] : first[t + 1]]
                    if lexicon is None:
                        own = np.unique(own)
                    else:
                        at = np.unique(lexicon.find(own)[1])
                        own = lexicon.features[at[at >= 0]]
                    seen.append(own[own != 0])
            values, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
            yield pa.record_batch({"feature": pa.array(values.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return tidied(run)


def _sparse(lexicon: Lexicon, column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(tokens, positions that carry features, feature numbers) of each text."""
    out = []
    for i, j, h, first in token_features(column):
        where, ids = lexicon.find(h)
        cuts = np.searchsorted(where, first)
        out += [(int(first[t + 1] - first[t]), where[cuts[t] : cuts[t + 1]] - first[t], ids[cuts[t] : cuts[t + 1]]) for t in range(j - i)]
    return out


def _examples(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(features)
        for b in batches:
            rows = _sparse(lexicon, b["text"])
            yield pa.record_batch({"key": b["key"], "toxic": b["toxic"], "n": pa.array([r[0] for r in rows], pa.int64()), "at": pa.array([r[1].tolist() for r in rows], pa.list_(pa.int64())), "ids": pa.array([r[2].ravel().tolist() for r in rows], pa.list_(pa.int32()))})

    return tidied(run)


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """The likelihood-ratio statistic of a feature's document counts against chance, 0 where it isn't more common in toxic ones."""
    share = n_toxic / (n_toxic + n_clean)
    total = toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (toxic * np.log(toxic / (total * share)) + np.where(clean > 0, clean * np.log(clean / (total * (1 - share))), 0.0))
    return np.where(toxic > total * share, g, 0.0)


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least hashes of a text's word pairs under four orders: near copies share one of them nearly always."""
    for b in batches:
        out = []
        for i, j, h, first in hashed(b["text"], SYMBOLS):
            pairs = h[0].copy()
            pairs[1:] += h[0][:-1] * np.uint64(3)
            orders = [mix(pairs + np.uint64(k)) for k in range(1, 5)]
            out += [[int(o[first[t] : first[t + 1]].min()) >> 1 for o in orders] if first[t + 1] > first[t] else [0] * 4 for t in range(j - i)]
        yield pa.record_batch({"key": b["key"], "toxic": b["toxic"], "family": pa.array(out, pa.list_(pa.int64()))})


def distinct_rows(rows: list[tuple[int, int, list[int]]]) -> list[int]:
    """One key of each group of rows (key, label, families) of a label that share a family."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for _, label, family in rows:
        for k, f in enumerate(family):
            a, b = sorted((root((label, 0, family[0])), root((label, k, f))))
            parent[b] = a
    kept: dict = {}
    for key, label, family in sorted(rows):
        kept.setdefault(root((label, 0, family[0])), key)
    return sorted(kept.values())


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Field:
    """The field and its logistic, from labelled rows.

    At most about `toxic_rows` and `clean_rows` rows of either label are used, by the hash of the
    key, and half of `WINDOWS` windows of either, by the hash of key and position; of near copies one row, else any word of a text with many copies would pass for evidence.
    Rows without a label or a text, and labels of no document, teach nothing; of several labels of a
    key the largest counts. Without toxic or clean rows every score is the share of toxic rows.
    """
    spark = docs.sparkSession
    own = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg((F.max(toxic) > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("key", F.lit("train")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    most = F.when(F.col("toxic") == 1, toxic_rows / max(1, sizes.get(1, 0))).otherwise(clean_rows / max(1, sizes.get(0, 0)))
    picked = F.broadcast(own.where(place < most))  # some 23,000 rows of two numbers, whatever the input
    rows = written(docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(picked, "key").select("key", "text", "toxic"), "toxicity-sample")
    apart = distinct_rows([(r["key"], r["toxic"], r["family"]) for r in rows.mapInArrow(tidied(_families), "key long, toxic int, family array<long>").collect()])
    rows = rows.join(F.broadcast(spark.createDataFrame([(k,) for k in apart], "key long")), "key", "left_semi")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    empty = np.zeros(0, np.uint64)
    if not n.get(0) or not n.get(1):
        rate = min(1 - 1e-9, max(1e-9, n.get(1, 0) / max(1, sum(n.values()))))
        return Field(empty, np.zeros(0), -2.0, np.zeros((2, 2)), 0.0, float(np.log(rate / (1 - rate))))
    counted = lambda kind, of: rows.where(F.col("toxic") == kind).select("text").mapInArrow(_counts(of), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = counted(1, None).where("n >= 3").orderBy(F.desc("n"), "feature").limit(CANDIDATES).toPandas()
    names = found["feature"].to_numpy(np.int64).view(np.uint64)
    in_clean = {int(r["feature"]): int(r["n"]) for r in counted(0, names).collect()}
    clean = np.array([in_clean.get(int(f), 0) for f in found["feature"]], float)
    strength = evidence(found["n"].to_numpy(float), clean, n[1], n[0])
    best = np.argsort(-strength, kind="stable")[:LEXICON]
    enough = 2 * np.log(max(1, len(names))) + 2  # among so many features, chance passes this for less than one
    pure = found["n"].to_numpy(float) >= PURITY * (found["n"].to_numpy(float) + clean)
    names = np.sort(names[best[(strength[best] >= enough) & pure[best]]])
    found = rows.mapInArrow(_examples(names), "key long, toxic int, n long, at array<long>, ids array<int>").orderBy("key", "n").collect()
    examples = [(int(r["toxic"]), (int(r["n"]), np.array(r["at"], np.int64), np.array(r["ids"], np.int32).reshape(-1, len(BEGINNINGS) + 1))) for r in found]
    windows, tags = [], []
    for label in (1, 0):
        spots = [(mix(np.array([r["key"] * 1_000_003 + p], np.int64).view(np.uint64))[0], k, p) for k, r in enumerate(found) if r["toxic"] == label for p in r["at"] or [r["n"] // 2]]
        for _, k, p in sorted(spots)[: WINDOWS // 2]:
            _, at, ids = examples[k][1]
            w = np.full((2 * AROUND + 1, len(BEGINNINGS) + 1), -1, np.int32)
            near = np.abs(at - p) <= AROUND
            w[at[near] - p + AROUND] = ids[near]
            windows.append(w)
            tags.append(((w >= 0).any(1) & (label == 1)).astype(np.int64))
    field = fit_chain(names, np.stack(windows), np.stack(tags))
    fit_logistic(field, field.marginals([x for _, x in examples]), np.array([y for y, _ in examples], float))
    return field


def score(docs: DataFrame, field: Field, text: str = "text", key: str = "doc_id", spans: bool = False) -> DataFrame:
    """(key, score, and with `spans` the offending character ranges with their marginals) of every row, whole texts.

    Null and wordless texts are scored as texts of no toxic token.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lexicon = Lexicon(own.features)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                rows = _sparse(lexicon, part["text"])
                marginals = own.marginals(rows)
                columns = {"key": part["key"], "score": pa.array(own.score(marginals), pa.float64())}
                if spans:
                    found = []
                    for t, (_, at, _), m in zip(part["text"], rows, marginals, strict=True):
                        words = [x.span() for x in WORD.finditer(t.as_py())] if (m >= 0.5).any() else []
                        found.append([{"start": words[p][0], "end": words[p][1], "marginal": float(q)} for p, q in zip(at, m, strict=True) if q >= 0.5])
                    columns["spans"] = pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])))
                yield pa.record_batch(columns)

    schema = "key long, score double" + (", spans array<struct<start:int,end:int,marginal:double>>" if spans else "")
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(tidied(run), schema).withColumnRenamed("key", key)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted): learns from labels of rows that aren't held out, scores every row.

    Repeated rows are scored alike and stay; other columns are ignored; an empty table gives no rows.
    """
    field = train(docs, labels.where(~held_out(key)), key, text)
    return score(docs, field, text, key).select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document: null and empty texts are scored as texts of no toxic token."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
