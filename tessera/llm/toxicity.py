"""Toxicity: gradient-boosted trees over dense features with isotonic calibration.

Features of a text: densities of a lexicon of words and of word beginnings, their proximity to second-person words,
capitals, punctuation, obfuscation (letters mixed with digits or signs; folded before the lexicon is asked), and length.
The lexicon itself is learned: terms whose document frequency among toxic training rows exceeds that among clean ones
by a smoothed log-odds z-score. All is fitted on at most `MAX_TRAIN` labelled rows (the smallest hashes of doc_id), never
on held-out ones; they are read once and kept in the shared folder. For the calibration, lexicon and trees are learned on
one half and score the other. Scoring is one map over all whole texts, a few megabytes at a time.

Edge cases: null and empty texts get the features of a text without words; null labels and labels of unknown documents
are left out; repeated label rows count once (the larger label); repeated documents are scored (and learned from) each;
with no labels, or one class only, every score is that class's share and nothing else is learned; empty tables give
empty results; extra columns are kept by `toxicity`, which takes other names for its two where those are taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, byte_slices, crc_mod, spans_of, text_column, words_of

#: Labelled rows that the model is fitted on, at most.
MAX_TRAIN = 20_000
#: Lexicon entries of each kind, at most; the z-score that an entry needs.
MAX_TERMS, LEAST_Z = 4000, 2.5
#: Word beginnings looked at.
STEMS = (4, 5)
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes tus ti vosotros".split()
NEAR = 3
_TRIM = ".,;:!?\"'()[]{}<>*_-/\\|"
#: What stands for a letter in disguised words.
_FOLD = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
KINDS = ["word", *(f"stem{n}" for n in STEMS)]
FEATURES = [*(f"{k}_{x}" for k in KINDS for x in ("density", "count", "best")), "near_second", "second_density", "capitals", "punctuation", "exclaims", "digits", "obfuscated", "log_words", "mean_word"]


def folded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words as the lexicon has them, and whether each was disguised."""
    w = pc.utf8_trim(words.cast(pa.string()), _TRIM)
    odd = pc.and_(pc.match_substring_regex(w, r"[a-z][0-9@$!]|[0-9@$!][a-z]"), pc.less(pc.utf8_length(w), 24))
    plain = w
    for a, b in _FOLD.items():
        plain = pc.replace_substring(plain, a, b)
    return pc.if_else(odd, plain, w), odd.to_numpy(zero_copy_only=False)


def terms_of(words: pa.Array, kind: str) -> pa.Array:
    if kind == "word":
        return words
    n = int(kind[4:])
    return pc.if_else(pc.greater(pc.utf8_length(words), n), pc.utf8_slice_codeunits(words, 0, n), "")


_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
for _c in b".,;:?\"'()-":
    _CLASS[_c] = 2
_CLASS[ord("!")] = 3
_CLASS[48:58] = 4


def byte_counts(text: pa.Array) -> np.ndarray:
    """Capitals, punctuation, exclamation marks and digits of each text."""
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    kinds = _CLASS[data[offsets[0] : offsets[-1]]]
    at = np.flatnonzero(kinds)
    bounds = np.searchsorted(at, offsets - offsets[0])
    out = np.empty((len(text), 4))
    for k in range(1, 5):
        out[:, k - 1] = np.diff(np.concatenate([[0], np.cumsum(kinds[at] == k)])[bounds])
    return out


class Lexicon:
    """Terms with their weights, by kind."""

    def __init__(self, entries: list[tuple[str, str, float]]):
        self.terms = {k: pa.array([t for kind, t, _ in entries if kind == k], pa.string()) for k in KINDS}
        self.weights = {k: np.array([w for kind, _, w in entries if kind == k] + [0.0]) for k in KINDS}
        self.second = pa.array(SECOND_PERSON, pa.string())

    def features(self, text: pa.Array) -> np.ndarray:
        words, counts = words_of(text)
        encoded = words.dictionary_encode()
        plain, odd = folded(encoded.dictionary)
        codes = encoded.indices.to_numpy()
        n = len(text)
        offsets = spans_of(counts)
        at_least = np.maximum(counts, 1)

        def total(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0.0], np.cumsum(values)])[offsets])

        out = np.zeros((n, len(FEATURES)))
        hit = np.zeros(len(codes), bool)
        for k, kind in enumerate(KINDS):
            place = pc.fill_null(pc.index_in(terms_of(plain, kind), self.terms[kind]), -1).to_numpy(zero_copy_only=False)
            weight = self.weights[kind][place][codes]
            hits = weight > 0
            hit |= hits
            c = total(hits)
            best = np.zeros(n)
            np.maximum.at(best, np.searchsorted(offsets, np.flatnonzero(hits), side="right") - 1, weight[hits])
            out[:, 3 * k : 3 * k + 3] = np.stack([c / at_least, np.minimum(c, 50), best], 1)
        second = pc.is_in(plain, self.second).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
        spots = np.flatnonzero(second)
        doc = np.searchsorted(offsets, np.arange(0), side="right")
        places = np.flatnonzero(hit)
        doc = np.searchsorted(offsets, places, side="right") - 1
        near = np.zeros(len(places), bool)
        if len(spots):
            for side in (0, -1):
                j = np.clip(np.searchsorted(spots, places) + side, 0, len(spots) - 1)
                same = np.searchsorted(offsets, spots[j], side="right") - 1 == doc
                near |= same & (np.abs(spots[j] - places) <= NEAR)
        b = 3 * len(KINDS)
        out[:, b] = np.bincount(doc[near], minlength=n) / at_least if n else 0
        out[:, b + 1] = total(second) / at_least
        chars = np.maximum(pc.binary_length(text).to_numpy(zero_copy_only=False), 1)
        seen = byte_counts(text)
        out[:, b + 2 : b + 6] = seen / chars[:, None]
        out[:, b + 6] = total(odd[codes]) / at_least
        out[:, b + 7] = np.log1p(counts)
        out[:, b + 8] = chars / at_least
        return out


class Trees:
    """Gradient boosting on logistic loss with second-order leaf values over quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 2.0, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.penalty = rounds, depth, rate, bins, least, penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1], method="higher")) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node, tree = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                width = 1 << level
                best = [(1e-6, -1, 0)] * width
                sums = [(np.bincount(node, g, width), np.bincount(node, h, width))]
                for f in range(x.shape[1]):
                    m = len(self.edges[f]) + 1
                    key = node * m + binned[:, f]
                    gl, hl = (np.cumsum(np.bincount(key, v, width * m).reshape(width, m), 1)[:, :-1] for v in (g, h))
                    G, H = (s[:, None] for s in sums[0])
                    gain = gl**2 / (hl + self.penalty) + (G - gl) ** 2 / (H - hl + self.penalty) - G**2 / (H + self.penalty)
                    gain[(hl < self.least / 4) | (H - hl < self.least / 4)] = 0
                    for k in range(width if m > 1 else 0):
                        j = int(np.argmax(gain[k]))
                        if gain[k, j] > best[k][0]:
                            best[k] = (float(gain[k, j]), f, j)
                tree.append([(f, j) for _, f, j in best])
                feature = np.array([f for _, f, _ in best])[node]
                right = (feature >= 0) & (binned[np.arange(len(y)), np.maximum(feature, 0)] > np.array([j for _, _, j in best])[node])
                node = 2 * node + right
            leaves = -self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.penalty)
            margin = margin + leaves[node]
            self.trees.append((tree, leaves))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for tree, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in tree:
                f, j = (np.array(v)[node] for v in zip(*level))
                node = 2 * node + ((f >= 0) & (binned[rows, np.maximum(f, 0)] > j))
            out += leaves[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of the non-decreasing fit of y on x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    # shrink to half a count at the ends, so that no score is exactly 0 or 1
    value = [min(max(s / n, 0.5 / (n + 1)), (n + 0.5) / (n + 1)) for s, n, _, _ in blocks]
    value = np.maximum.accumulate(value)
    return np.array([v for s in blocks for v in s[2:]]), np.repeat(value, 2)


class Model:
    """A fitted lexicon, trees and calibration; or the share of the only class."""

    def __init__(self, lexicon: Lexicon, trees: Trees | None, knots, share: float):
        self.lexicon, self.trees, self.knots, self.share = lexicon, trees, knots, share

    def score(self, text: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(text), self.share)
        return np.interp(self.trees.margin(self.lexicon.features(text)), *self.knots)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """text, y, half of at most `most` labelled rows outside the held-out fifth; the ids are few and are broadcast."""
    picked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
        .withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("text", "y", "half")


def _term_counts(batches):
    """Rows ('rows', '', half, y, n) count documents, the others documents with a term."""
    for batch in batches:
        whole, ys, halves = text_column(batch), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
        for lo, end in byte_slices(whole):
            text, group = whole.slice(lo, end - lo), (2 * halves[lo:end] + ys[lo:end]).astype(np.int64)
            words, counts = words_of(text)
            encoded = words.dictionary_encode()
            plain, _ = folded(encoded.dictionary)
            doc = np.repeat(np.arange(len(text)), counts)
            out = [[pa.array(["rows"] * 4, pa.string()), pa.array([""] * 4, pa.string()), np.arange(4), np.bincount(group, minlength=4)]]
            for kind in KINDS:
                t = terms_of(plain, kind).dictionary_encode()
                size = max(1, len(t.dictionary))
                pairs = np.unique(doc * size + t.indices.to_numpy()[encoded.indices.to_numpy()])
                for g in range(4):
                    c = np.bincount(pairs[group[pairs // size] == g] % size, minlength=size)
                    some = np.flatnonzero(c)
                    out.append([pa.array([kind] * len(some), pa.string()), t.dictionary.take(pa.array(some)).cast(pa.string()), np.full(len(some), g), c[some]])
            for kind, term, g, n in out:
                yield pa.RecordBatch.from_arrays([kind, term, pa.array(g.astype(np.int32) // 2), pa.array(g.astype(np.int32) % 2), pa.array(n.astype(np.int64))], ["kind", "term", "half", "y", "n"])


def lexicon_of(counted: DataFrame, sizes: dict, halves: tuple) -> Lexicon:
    """The terms that stand out among the toxic rows of the halves; counted (kind, term, c00, c01, c10, c11) by half and label."""
    toxic, clean = (sum(sizes.get((h, y), 0) for h in halves) for y in (1, 0))
    a, b = (sum((F.col(f"c{h}{y}") for h in halves), F.lit(0)) for y in (1, 0))
    found = counted.select("kind", "term", (a + 0.5).alias("a"), (b + 0.5).alias("b")).where((F.col("a") >= 3.5) & (F.col("term") != ""))
    odds = F.log(F.col("a") / (toxic + 1 - F.col("a"))) - F.log(F.col("b") / (clean + 1 - F.col("b")))
    found = found.withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / F.col("a") + 1 / F.col("b"))).where((F.col("z") >= LEAST_Z) & (F.col("odds") >= 1.5))
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("z"), "term"))).where(F.col("k") <= MAX_TERMS)
    return Lexicon([(r["kind"], r["term"], r["z"]) for r in best.orderBy("kind", "k").collect()])  # at most MAX_TERMS of each kind


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Lexicon, trees and calibration; for the calibration, each half is scored by lexicon and trees of the other half only."""
    kept = Stored(training_rows(docs, labels, most), "labelled")
    rows = kept.df
    counts = rows.mapInArrow(_term_counts, "kind string, term string, half int, y int, n long").groupBy("kind", "term").agg(
        *(F.sum(F.when((F.col("half") == h) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"c{h}{y}") for h in (0, 1) for y in (0, 1))
    )
    terms = Stored(counts, "terms")
    sizes = {(h, y): r[f"c{h}{y}"] for r in terms.df.where("kind = 'rows'").collect() for h in (0, 1) for y in (0, 1)}
    toxic, clean = (sum(sizes.get((h, y), 0) for h in (0, 1)) for y in (1, 0))
    if not toxic or not clean:
        kept.drop(), terms.drop()
        return Model(Lexicon([]), None, None, float(toxic > 0))
    counted = terms.df.where("kind <> 'rows'")
    lexicons = [lexicon_of(counted, sizes, h) for h in ((0, 1), (0,), (1,))]

    def features(batches):
        for batch in batches:
            text = text_column(batch)
            for lo, end in byte_slices(text):
                x = np.concatenate([lexicon.features(text.slice(lo, end - lo)) for lexicon in lexicons], 1)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, end - lo), batch.column(2).slice(lo, end - lo), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["y", "half", "x"])

    got = rows.mapInArrow(features, "y double, half int, x array<double>").toArrow()  # at most `most` rows of numbers
    kept.drop(), terms.drop()
    y, half = got["y"].to_numpy(), got["half"].to_numpy()
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
    order = np.lexsort((*x.T, half, y))
    x, y, half = x[order], y[order], half[order]
    width = len(FEATURES)
    margin = np.zeros(len(y))
    for k in (0, 1):
        seen, own = half != k, x[:, (2 - k) * width : (3 - k) * width]  # the features of the other half's lexicon
        if seen.any():
            margin[~seen] = Trees().fit(own[seen], y[seen]).margin(own[~seen])
    return Model(lexicons[0], Trees().fit(x[:, :width], y), isotonic(margin, y), y.mean())


def toxicity(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """All columns of docs with the score and the class, under the names given (which replace columns of these names); one map, no shuffle."""
    names = docs.columns
    schema = T.StructType([f for f in docs.schema if f.name not in (score, predicted)] + [T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
    keep = [k for k, c in enumerate(names) if c not in (score, predicted)]

    def run(batches):
        for batch in batches:
            text = text_column(batch)
            for lo, end in byte_slices(text):
                p = np.clip(model.score(text.slice(lo, end - lo)), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(lo, end - lo) for k in keep] + [pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema.names)

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
