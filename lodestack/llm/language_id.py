"""Language identification by cross-parsing entropy over suffix automata.

Each language has a suffix automaton of sampled training text: its states and transitions spell
every substring of that text. A document is parsed, once for each language, into the longest pieces
that the language's text contains; the language that needs the fewest pieces for the document's
letters wins. A parse never looks back, so only transitions are used in prediction.

Texts are normalised to lower-case letters with one space between words; whatever is no letter, a
combining mark too, ends a word, in training and in prediction alike. They are parsed in blocks
of `BLOCK` characters, each begun anew, which adds at most one piece a block for every language
alike; blocks of many documents advance together, one character at a time, in numpy.

Scale: the model is fit on a bounded sample, `SNIPPETS` snippets of `SNIPPET` characters for each
language, so the texts that are broadcast have a size bound of 32 KB a language; automata are built
on executors, once for each Python worker, as hash tables of their transitions, at most some 100,000
and 4 MB a language, whatever its characters. Prediction is a single pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import kept, tidied

BLOCK, SNIPPETS, SNIPPET, LANES, BROADCAST_ROWS = 256, 128, 256, 4096, 100_000
HOLD, FOLDS = 0, 5
NOT_LETTERS = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> str:
    """Lower-case letters, and one space for whatever stands between them; empty without letters."""
    return NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""


class SuffixAutomaton:
    """All substrings of a sequence of symbols 1..: `after(states, symbols)` are states, or 0 where there is none; 1 is the root.

    Transitions are a table of open addressing, at most a quarter full.
    """

    def __init__(self, symbols: list[int], alphabet: int):
        step: list[dict[int, int]] = [{}, {}]
        link, length = [0, 0], [0, 0]
        last = 1
        for c in symbols:
            if c == 0:  # a break between snippets: no substring goes across
                last = 1
                continue
            if (old := step[last].get(c)) is not None and length[old] == length[last] + 1:
                last = old
                continue
            new = len(step)
            step.append({})
            link.append(1)
            length.append(length[last] + 1)
            at, last = last, new
            while at and c not in step[at]:
                step[at][c] = new
                at = link[at]
            if not at:
                continue
            to = step[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
                continue
            copy = len(step)
            step.append(dict(step[to]))
            link.append(link[to])
            length.append(length[at] + 1)
            while at and step[at].get(c) == to:
                step[at][c] = copy
                at = link[at]
            link[to] = link[new] = copy
            if length[new] == length[copy]:
                last = copy
        self.alphabet, self.root = alphabet, np.zeros(alphabet, np.int64)
        for c, t in step[1].items():
            self.root[c] = t
        keys = np.array([s * alphabet + c for s, own in enumerate(step) for c in own], np.int64)
        values = np.array([t for own in step for t in own.values()], np.int32)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # those whose slot is free take it, one each; the others go on to the next
            free = self.keys[at[left]] == -1
            slots, first = np.unique(at[left[free]], return_index=True)
            own = left[free][first]
            self.keys[slots], self.values[slots] = keys[own], values[own]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def after(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        keys = states * self.alphabet + symbols
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], 0)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


class Model:
    """Automata of all languages over one alphabet of the training text's characters."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        used = sorted({c for own in texts.values() for t in own for c in normal(t)})
        self.symbol = np.zeros(max(map(ord, used), default=0) + 2, np.uint16)
        for k, c in enumerate(used):
            self.symbol[ord(c)] = k + 1
        self.automata = []
        for lang in self.languages:
            seq: list[int] = []
            for t in texts[lang]:
                seq += [0, *self.symbols(f" {normal(t)} ").tolist()]
            self.automata.append(SuffixAutomaton(seq, len(used) + 1))

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a normalised text; characters that no training text has are 0."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return self.symbol[np.minimum(code, len(self.symbol) - 1)]

    def pieces(self, texts: list[str]) -> np.ndarray:
        """How many pieces each language needs for each normalised text."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        owners, rows = [], []
        for k, t in enumerate(texts):
            s = self.symbols(f" {t} ") if t else np.zeros(0, np.uint16)
            n = -(-len(s) // BLOCK)
            if n:
                padded = np.zeros(n * BLOCK, np.uint16)
                padded[: len(s)] = s
                padded[len(s) :] = self.automata[0].alphabet if self.automata else 0
                rows.append(padded.reshape(n, BLOCK))
                owners += [k] * n
            if len(owners) >= LANES or (k == len(texts) - 1 and rows):
                self._parse(np.concatenate(rows), np.array(owners), out)
                owners, rows = [], []
        return out

    def _parse(self, blocks: np.ndarray, owners: np.ndarray, out: np.ndarray) -> None:
        end = self.automata[0].alphabet
        lengths = (blocks != end).sum(1)
        order = np.argsort(-lengths, kind="stable")
        columns = np.ascontiguousarray(blocks[order].T).astype(np.int64)
        owners, alive = owners[order], np.searchsorted(-lengths[order], -np.arange(BLOCK), "left")
        for k, automaton in enumerate(self.automata):
            state, count = np.ones(len(blocks), np.int64), np.ones(len(blocks), np.int64)
            for c in range(BLOCK):
                n = int(alive[c])
                if not n:
                    break
                symbol = columns[c, :n]
                to = automaton.after(state[:n], symbol)
                broken = np.flatnonzero(to == 0)
                if len(broken):
                    count[broken] += state[broken] != 1
                    again = automaton.root[symbol[broken]]
                    lost = again == 0  # a character that the language doesn't have is a piece of its own
                    count[broken[lost]] += 1
                    again[lost] = 1
                    to[broken] = again
                state[:n] = to
            np.add.at(out[:, k], owners, count - (state == 1))


def sample(docs: DataFrame, text: str, lang: str, key: str, snippets: int = SNIPPETS) -> dict[str, list[str]]:
    """Snippets of labelled rows for each language: about `snippets` rows by the hash of their key, one snippet a row at a place that the hash picks.

    What reaches the driver is bounded by the number of distinct labels, of which each is a language.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.lit("snippet")).alias("h"))
    share = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.broadcast(share) if share.count() <= BROADCAST_ROWS else share  # a row a language
    within = F.pmod("h", F.lit(1 << 40)) / F.lit(float(1 << 40)) < 2.0 * snippets / F.col("n")
    place = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - SNIPPET, F.lit(1))).cast("int") + 1
    found = rows.join(share, "lang").where(within).select("lang", F.substr("text", place, F.lit(SNIPPET)).alias("text"), "h")
    out: dict[str, list[tuple[int, str]]] = {}
    for r in found.collect():  # about twice `snippets` for each language
        if normal(r["text"]):
            out.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return {k: [t for _, t in sorted(v)[:snippets]] for k, v in out.items()}


def predict(docs: DataFrame, model: dict[str, list[str]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) for every row, from the text alone.

    score is 1 - (pieces of the best language) / (pieces of the second), 0 on a tie, which goes to
    the first language by name, and 1 where there is one language only. A text that is null or has
    no letter is `und` with score 0; without any training text all are.
    """
    spark = docs.sparkSession
    name = hashlib.sha256(repr(sorted(model.items())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(name, lambda: Model(shared.value))
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                texts = [normal(t.as_py()) for t in part["text"]]
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if own.languages:
                    need = own.pieces(texts)
                    best = need.argmin(1)
                    for k, t in enumerate(texts):
                        if any(map(str.isalpha, t)):
                            two = np.sort(need[k])[:2]
                            langs[k], scores[k] = own.languages[best[k]], float(1 - two[0] / two[1]) if len(two) > 1 else 1.0
                yield pa.record_batch({"key": part["key"], "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidied(run), "key long, lang_pred string, score double").withColumnRenamed("key", key)


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HOLD


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score): learns from rows that aren't held out, predicts all rows.

    Rows without a language or a text teach nothing. Repeated rows and keys are predicted alike;
    other columns are ignored; an empty table gives no rows.
    """
    model = sample(docs.where(~held_out(key)), text, lang, key)
    return predict(docs, model, text, key).select(key, held_out(key).alias("held_out"), "lang_pred", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document: null texts and those without a letter are `und`, rows without a language teach nothing."""
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
