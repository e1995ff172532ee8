"""LM scoring by online logistic context mixing.

A text is a sequence of lower-cased words and an end, coded bit by bit. Words above a count threshold (the lexicon) lie in
cells of about equal mass, ordered by language class and count; a word's cell is coded by `DEPTH` binary decisions, each
predicted by several hashed contexts: the language class inferred from the words before, the two cells before, the word
before, the two words before. Their log-odds are combined by weights that a gate picks by the bit and by how often the word
contexts were seen. Inside a cell a word has its share of the cell's training count; a word below the threshold has its
share of the rare words' count, read from the distributed word table; a word never seen is spelled byte by byte by a second
mixer (the word so far, the last four, three, two and one bytes, language class). `score` is the log10 of the product;
`bits_per_byte` divides its bits by the coded bytes.

Learning goes through the training texts in order: every chunk is predicted from what was counted before, the weights take a
Newton step by their errors, and only then is the chunk counted. Tasks' counts are summed and their weights averaged by
mass. While a text is scored, the weights adapt to it: after every block of its words, an additive correction of the text's
own weights takes a step by the block's errors, so that later words are predicted by what was learned from earlier ones.
The correction starts anew with every text: a score doesn't depend on where its text lies.

What is gathered grows with the corpus: counts of all training words by class are a distributed table; the tables of the
cell contexts have fixed sizes or, for the word contexts, as many slots as there are training words, up to 2^`TOP`; the
spelling tables sum all distinct words. The lexicon holds at most `LEXICON` words (their number is checked before they are
collected); all other words keep their own counts in the distributed table.

Edge cases: null and empty texts are one end token; null doc_ids hash as the empty text and keep their rows; repeated
rows are scored (and learned from) each; null languages are a class of their own; without training rows every context is
unseen and the base is uniform; an empty table gives an empty result; extra columns are ignored. The input must read the
same twice (files, not a random sample).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE_VALUES, Stored, byte_slices, crc_mod, mix64, n_parts, settle, small_batches, spans_of, text_column, with_rid, word_hashes, words_of

#: Language classes: the most common values of `lang` in training rows, and one for all others.
CLASSES = 8
#: Words of the lexicon predictors, at most.
LEXICON = 1 << 17
#: Cells of words, binary decisions for each, cells of rare words, of the end and before a text; log2 slots of word contexts, at most.
CELLS, DEPTH, RARE, END_CELL, BEFORE, TOP = 64, 6, 0, 63, 64, 21
#: log2 slots of the spelling tables: last 4 bytes with class, word so far, last 3 and 2 bytes with class, last byte.
BITS = (20, 22, 19, 18, 16)
GATES = 32
APM_STEPS = 33
#: Log-likelihood lead that a class needs over the next.
LEAD = 1.5
END, SPACE = 0x0A, 0x20
#: The predictors other than the lexicon.
SHORT = (0, 2, 3, 4)
CHUNK, LESSON = 8192, 512
#: Tokens looked at at once: what belongs to them stays in the processor's cache.
STRIPE = 1 << 15

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


class Coded:
    """The bytes of coded words with the contexts of each byte."""

    def __init__(self, words: pa.Array, z: np.ndarray):
        self.lexicon = None
        w = words.cast(pa.large_binary())
        n = len(w)
        at = np.frombuffer(w.buffers()[1], np.int64, n + 1, w.offset * 8)
        size = np.diff(at)
        total = int(size.sum()) + n
        self.begin = spans_of(size + 1)
        self.unit = np.repeat(np.arange(n), size + 1)
        pos = np.arange(total) - self.begin[self.unit]
        self.b = np.full(total, SPACE, np.int64)
        inside = np.ones(total, bool)
        inside[self.begin[1:] - 1] = False
        if w.buffers()[2]:
            self.b[inside] = np.frombuffer(w.buffers()[2], np.uint8)[at[0] : at[-1]]
        self.b[self.begin[1:][size == 0] - 1] = END
        power = np.full(int(pos.max(initial=0)) + 1, np.uint64(0xA0761D6478BD642F))
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_VALUES[self.b] * power[pos])])
        prefix = mix64(sums[:-1] - sums[self.begin[:-1]][self.unit] + pos.astype(np.uint64))
        back = [np.where(pos >= k, np.roll(self.b, k), 256).astype(np.uint64) for k in (1, 2, 3, 4)]
        self.zz = zz = self._of_class(z)
        self.node = (-1, None)
        one = back[0]
        two = one * np.uint64(257) + back[1]
        three = two * np.uint64(257) + back[2]
        self.depth = np.array([0, 0, 1, 1, 2, 2, 2, 3], np.uint8)[np.minimum(pos, 7)]
        four = three * np.uint64(257) + back[3]
        self.contexts = [mix64(four + np.uint64(1 << 42)) ^ zz, prefix, mix64(three) ^ zz, mix64(two + np.uint64(1 << 40)) ^ zz, mix64(one + np.uint64(1 << 41))]

    def _of_class(self, z: np.ndarray) -> np.ndarray:
        return mix64((z + 1).astype(np.uint64) * _C1)[self.unit]

    def turn(self, z: np.ndarray) -> None:
        """The same words in other classes."""
        zz = self._of_class(z)
        for k in (0, 2, 3):
            self.contexts[k] ^= self.zz ^ zz
        self.zz = zz

    def slots(self, k: int, j: int) -> np.ndarray:
        """Slot of predictor k for bit j of every byte."""
        if self.node[0] != j:
            self.node = (j, ((1 << j) | (self.b >> (8 - j))).view(np.uint64) * _C1)
        h = self.contexts[k] ^ self.node[1]
        h *= _C2
        h ^= h >> np.uint64(32)
        h *= _C1
        h >>= np.uint64(64 - BITS[k])
        return h.view(np.int64)

    def bit(self, j: int) -> np.ndarray:
        return (self.b >> (7 - j)) & 1

    def along(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lexicon slots of all bits, and what `seen` has there; nothing from the word's first unseen node on."""
        slot = np.stack([self.slots(1, j) for j in range(8)], 1)
        got = seen[slot]
        where = np.arange(slot.size).reshape(slot.shape)
        first = np.minimum.reduceat(np.where(got == 0, where, slot.size).min(1), self.begin[:-1])
        got[where >= first[self.unit][:, None]] = 0
        return slot, got


def count_bits(coded: Coded, weight: np.ndarray, which, tables: dict[int, np.ndarray]) -> None:
    """Adds the weights of the units to the counts (of 0 and of 1) of the predictors' slots."""
    w = weight[coded.unit].astype(np.float32)
    for j in range(8):
        bit = coded.bit(j)
        for k in which:
            s = coded.slots(k, j)
            s += s
            s += bit
            np.add.at(tables[k], s, w)


class Model:
    """Frozen tables, gated weights and the adaptive map."""

    def __init__(self, counts: dict[int, np.ndarray]):
        self.stretch = []
        for k in range(len(BITS)):
            c = counts[k].reshape(-1, 2)
            self.stretch.append(np.log((c[:, 1] + 0.4) / (c[:, 0] + 0.4)).astype(np.float16))
        self.seen = np.minimum(np.log2(counts[1].reshape(-1, 2).sum(1) + 1), 15).astype(np.uint8)
        self.weights = self.first_weights()
        self.apm: np.ndarray | None = None

    @staticmethod
    def first_weights() -> np.ndarray:
        """Early in a word its last four bytes are all of it; later the lexicon counts for more the more it has seen."""
        gate = np.arange(GATES)
        lex = np.where(gate % 4 < 2, 0, gate // 4 / 7.5)[:, None]
        return np.concatenate([0.6 * (1 - lex), lex, 0.4 * (1 - lex), 0 * lex, 0 * lex, 0 * lex], 1)

    def inputs(self, coded: Coded, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of the predictors (and a constant), and the gate's choice, for bit j of every byte."""
        x = np.ones((len(coded.b), len(BITS) + 1), np.float32)
        if coded.lexicon is None:
            coded.lexicon = coded.along(self.seen)
        slot, seen = (v[:, j] for v in coded.lexicon)
        x[:, 1] = np.where(seen > 0, self.stretch[1][slot], 0)
        for k in SHORT:
            x[:, k] = self.stretch[k][coded.slots(k, j)]
        return x, np.minimum((seen + np.uint8(1)) >> 1, 7) * np.uint8(4) + coded.depth

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -14, 14)

    @staticmethod
    def cell(t: np.ndarray, gate: np.ndarray, j: int) -> np.ndarray:
        return ((gate.astype(np.int64) * 8 + j) * APM_STEPS) + np.clip(np.rint(t * 1.5) + APM_STEPS // 2, 0, APM_STEPS - 1).astype(np.int64)

    def learn(self, coded: Coded, weight: np.ndarray, apm: np.ndarray, state: dict) -> None:
        """An online Newton step for every bit position; the adaptive map counts what the mixer left."""
        w = weight[coded.unit]
        width = self.weights.shape[1]
        curve = state.setdefault("curve", np.zeros((GATES, width, width)))
        for j in range(8):
            x, gate = self.inputs(coded, j)
            t = self.mixed(x, gate)
            bit = coded.bit(j)
            p = 1 / (1 + np.exp(-t))
            order = np.argsort(gate, kind="stable")
            present, first = np.unique(gate[order], return_index=True)
            xs, miss, mass = x[order], ((bit - p) * w)[order, None], (p * (1 - p) * w)[order, None]
            state["n"] = state.get("n", 0) + 1
            rate = max(0.05, 0.5 / (1 + state["n"] / 32))
            for g, lo, hi in zip(present, first, np.append(first[1:], len(order))):
                part = xs[lo:hi]
                curve[g] = 0.9 * curve[g] + (part * mass[lo:hi]).T @ part
                ridge = np.eye(width) * (0.005 * np.trace(curve[g]) / width + 1e-6)
                self.weights[g] += rate * np.linalg.solve(curve[g] + ridge, (part * miss[lo:hi]).sum(0))
            np.clip(self.weights, -4, 4, out=self.weights)
            c = self.cell(t, gate, j)
            apm += np.bincount(c * 2 + bit, w, len(apm))

    def log10(self, words: pa.Array, z: np.ndarray) -> np.ndarray:
        """log10 probability of each coded word in its class."""
        out = np.zeros(len(words))
        for lo in range(0, len(words), CHUNK):
            coded = Coded(words.slice(lo, CHUNK), z[lo : lo + CHUNK])
            total = np.zeros(len(coded.b))
            for j in range(8):
                x, gate = self.inputs(coded, j)
                t = self.mixed(x, gate)
                if self.apm is not None:
                    t = 0.5 * (t + self.apm[self.cell(t, gate, j)])
                total -= np.log1p(np.exp(np.where(coded.bit(j) == 1, -t, t)))
            out[lo : lo + CHUNK] = np.add.reduceat(total, coded.begin[:-1]) / math.log(10)
        return out


_CLASS_COLUMNS = [f"k{i}" for i in range(CLASSES)]


def class_names(train: DataFrame) -> list[str]:
    if "lang" not in train.columns:
        return []
    top = train.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(CLASSES - 1).collect()
    return [r["lang"] for r in top]


def word_table(train: DataFrame, names: list[str]) -> DataFrame:
    """word, c, k0..: training counts of every word ('' is the end) by class; one shuffle of each task's distinct words."""
    lang = F.col("lang") if "lang" in train.columns else F.lit(None).cast("string")
    cls = F.lit(0)
    for i, name in enumerate(names):
        cls = F.when(lang == name, i + 1).otherwise(cls)

    def count(batches):
        for batch in batches:
            text, cls = text_column(batch), batch.column(1).to_numpy().astype(np.int64)
            words, n = words_of(text)
            e = words.dictionary_encode()
            key = e.indices.to_numpy().astype(np.int64) * CLASSES + np.repeat(cls, n)
            c = np.bincount(key, minlength=len(e.dictionary) * CLASSES)
            some = np.flatnonzero(c)
            ends = np.bincount(cls, minlength=CLASSES)
            word = pa.concat_arrays([e.dictionary.take(pa.array(some // CLASSES)).cast(pa.large_string()), pa.array([""] * CLASSES, pa.large_string())])
            yield pa.RecordBatch.from_arrays([word.cast(pa.string()), pa.array(np.append(some % CLASSES, np.arange(CLASSES)).astype(np.int32)), pa.array(np.append(c[some], ends).astype(np.int64))], ["word", "cls", "n"])

    def add(batches):
        t = [pa.Table.from_batches([b]) for b in batches if len(b)]
        if not t:
            return
        t = pa.concat_tables(t).group_by(["word", "cls"]).aggregate([("n", "sum")]).combine_chunks()
        e = t["word"].combine_chunks().cast(pa.large_string()).dictionary_encode()
        k = np.bincount(e.indices.to_numpy().astype(np.int64) * CLASSES + t["cls"].to_numpy(), t["n_sum"].to_numpy(), len(e.dictionary) * CLASSES).astype(np.int64).reshape(-1, CLASSES)
        live = k.sum(1) > 0
        words = e.dictionary.filter(pa.array(live)).cast(pa.string())
        k = k[live]
        for lo in range(0, len(words), 100_000):
            part = k[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([words.slice(lo, 100_000), pa.array(part.sum(1)), *(pa.array(np.ascontiguousarray(part[:, i])) for i in range(CLASSES))], ["word", "c", *_CLASS_COLUMNS])

    raw = train.select("text", cls.cast("int").alias("cls")).mapInArrow(count, "word string, cls int, n long")
    return raw.repartition(n_parts(train.sparkSession), "word").mapInArrow(add, "word string, c long, " + ", ".join(f"{k} long" for k in _CLASS_COLUMNS))


def lexicon_of(words: DataFrame, most: int = LEXICON) -> tuple[pa.Table, int]:
    """Words with at least the returned count; at most `most` of them (and the end). A word seen once is rare at any size."""
    level = F.floor(F.log2("c") * 8)
    rows = words.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("level")).collect()  # a few hundred levels
    total, least = 0, None
    for r in rows:
        if total + r["n"] > most:
            break
        total, least = total + r["n"], r["least"]
    least = 1 << 62 if least is None else max(2, int(least))
    return words.where((F.col("c") >= least) | (F.col("word") == "")).orderBy("word").toArrow(), least


def _class_counts(batch) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in _CLASS_COLUMNS], 1)


PIECE = 1 << 16


def _pack(k: int, table: np.ndarray):
    """Stretches of a table that hold anything; thin ones as places and values."""
    rows = [[], [], [], []]
    for at in range(0, len(table), PIECE):
        part = table[at : at + PIECE]
        some = np.flatnonzero(part)
        if len(some):
            thin = 2 * len(some) < len(part)
            for r, v in zip(rows, (k, at, some.astype(np.int32).tobytes() if thin else None, (part[some] if thin else part).tobytes())):
                r.append(v)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], ["k", "at", "i", "v"])


def _summed(parts: DataFrame) -> dict[int, dict[int, np.ndarray]]:
    """Sums of packed stretches by table and place; tasks add them up one by one, the driver gets tables of a fixed size."""

    def add(batches):
        total: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                v = np.frombuffer(r["v"], np.float32)
                t = total.setdefault((r["k"], r["at"]), np.zeros(PIECE, np.float64))
                t[np.frombuffer(r["i"], np.int32) if r["i"] is not None else slice(0, len(v))] += v
        for (k, at), t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([t.astype(np.float32).tobytes()])], ["k", "at", "v"])

    out: dict = {}
    n = n_parts(parts.sparkSession)
    got = parts.repartition(n, "k", "at").mapInArrow(add, "k int, at int, v binary").toArrow()  # tables of a fixed size
    for k, at, v in zip(got["k"].to_pylist(), got["at"].to_pylist(), got["v"]):
        out.setdefault(k, {})[at] = np.frombuffer(v.as_buffer(), np.float32)
    return out


def _table(size: int, pieces: dict[int, np.ndarray]) -> np.ndarray:
    out = np.zeros(size, np.float32)
    for at, v in pieces.items():
        out[at : at + PIECE] += v[: size - at]
    return out


_PACKED = "k int, at int, i binary, v binary"


def tables_of(words: DataFrame, lexicon: pa.Table, least: int) -> dict[int, np.ndarray]:
    """Bit counts of all spelling contexts over all distinct training words, each counted once: unseen words are like rare ones.

    Short contexts count every word in its class and without. The nodes of the word so far are those of the lexicon's words;
    other words are counted as far as they run along these nodes.
    """
    spark = words.sparkSession
    first = {1: np.zeros(2 << BITS[1], np.float32)}
    for batch in lexicon.to_batches(max_chunksize=8 * CHUNK):
        count_bits(Coded(batch.column(0), np.zeros(len(batch), np.int64)), (~kept_back(batch.column(0))).astype(np.float32), (1,), first)
    nodes = spark.sparkContext.broadcast(np.packbits(first[1].reshape(-1, 2).any(1)))

    def count(batches):
        tables = {k: np.zeros(2 << b, np.float32) for k, b in enumerate(BITS)}
        node = np.unpackbits(nodes.value).astype(bool)
        for batch in batches:
            for lo in range(0, len(batch), 2 * CHUNK):
                b = batch.slice(lo, 2 * CHUNK)
                b = b.filter(pa.array(~kept_back(b.column(0))))
                if not len(b):
                    continue
                counts, one = _class_counts(b), np.ones(len(b), np.float32)
                coded = Coded(b.column(0), counts.argmax(1) + 1)
                count_bits(coded, one, SHORT, tables)
                coded.turn(np.zeros(len(b), np.int64))
                count_bits(coded, one, (0, 2, 3), tables)
                some = (counts.sum(1) < least) & (pc.binary_length(b.column(0)).to_numpy(zero_copy_only=False) > 0)
                slot, on = coded.along(node)
                on &= some[coded.unit][:, None]
                for j in range(8):
                    at = np.flatnonzero(on[:, j])
                    np.add.at(tables[1], slot[at, j] * 2 + coded.bit(j)[at], np.float32(1))
        for k, t in tables.items():
            yield _pack(k, t)
        settle()

    few = words.coalesce(min(n_parts(spark), 12 + n_parts(spark) // 16))
    got = _summed(few.mapInArrow(count, _PACKED))
    out = {k: _table(2 << b, got.get(k, {})) for k, b in enumerate(BITS)}
    out[1] += first[1]
    nodes.unpersist()
    return out


def kept_back(words: pa.Array) -> np.ndarray:
    """The eighth of the distinct words (by hash) that no table counts: the mixer learns on them what unseen words are like."""
    return word_hashes(words.cast(pa.large_string())) % np.uint64(8) == 0


def fit_spelling(words: DataFrame, lexicon: pa.Table, least: int) -> Model:
    """Tables of seven eighths of the distinct words, then mixing weights and adaptive map, learned in every partition on the rest."""
    spark = words.sparkSession
    model = Model(tables_of(words, lexicon, least))
    held = spark.sparkContext.broadcast(model)

    def learn(batches):
        m = held.value
        m.weights = m.first_weights()
        apm, state = np.zeros(GATES * 8 * APM_STEPS * 2), {}
        mass = 0.0
        for batch in batches:
            batch = batch.filter(pa.array(kept_back(batch.column(0))))
            counts = _class_counts(batch)
            # an eighth of the words is learned without a class
            z = np.where(np.arange(len(counts)) % 8 == 7, 0, counts.argmax(1) + 1)
            for lo in range(0, len(z), LESSON):
                part = slice(lo, lo + LESSON)
                m.learn(Coded(batch.column(0).slice(lo, LESSON), z[part]), np.ones(len(z[part])), apm, state)
                mass += len(z[part])
        yield pa.RecordBatch.from_arrays([pa.array([mass]), pa.array([m.weights.ravel().tolist()]), pa.array([apm.tolist()])], ["mass", "w", "apm"])
        settle()

    few = words.coalesce(min(n_parts(spark), 24 + n_parts(spark) // 16))
    mass, weights, apm = 0.0, np.zeros((GATES, len(BITS) + 1)), np.zeros(GATES * 8 * APM_STEPS * 2)
    for r in few.mapInArrow(learn, "mass double, w array<double>, apm array<double>").toArrow().to_pylist():  # a row for each task
        mass += r["mass"]
        weights += r["mass"] * np.array(r["w"]).reshape(weights.shape)
        apm += np.array(r["apm"])
    if mass:
        model.weights = weights / mass
    c = apm.reshape(-1, 2)
    centre = np.tile((np.arange(APM_STEPS) - APM_STEPS // 2) / 1.5, GATES * 8)
    p = 1 / (1 + np.exp(-centre))
    model.apm = np.log((c[:, 1] + 20 * p) / (c[:, 0] + 20 * (1 - p)))
    held.unpersist()
    return model


class Lexicon:
    """Frequent words with their cells, their shares of the cells, and how they lean to the language classes."""

    def __init__(self, table: pa.Table, least: int):
        table = table.combine_chunks()
        words = table["word"].combine_chunks() if len(table) else pa.array([], pa.string())
        if isinstance(words, pa.ChunkedArray):
            words = pa.concat_arrays(words.chunks) if words.num_chunks else pa.array([], pa.string())
        self.words = words.cast(pa.large_string())
        counts = np.stack([table[k].to_numpy() for k in _CLASS_COLUMNS], 1) if len(table) else np.zeros((0, CLASSES), np.int64)
        self.c = counts.sum(1)
        n = len(self.c)
        end = pc.equal(pc.binary_length(self.words), 0).to_numpy(zero_copy_only=False) if n else np.zeros(0, bool)
        mass = np.where(end, 0, self.c)
        order = np.lexsort((np.arange(n), -mass, counts.argmax(1) if n else mass))
        before = np.cumsum(mass[order]) - mass[order]
        cell = np.empty(n, np.int64)
        cell[order] = 1 + before * (CELLS - 2) // max(1, int(mass.sum()))
        self.rare, self.end, self.before = n, n + 1, n + 2  # units beside the words
        self.cell = np.concatenate([cell, [RARE, END_CELL, BEFORE]])
        self.thin = np.append((self.c <= least) & ~end, [False] * 3)  # rare but for the very word that is looked at
        share = np.zeros(n + 3)
        sums = np.bincount(cell[~end], mass[~end], CELLS)
        share[:n][~end] = np.log10(mass[~end] / sums[cell[~end]])
        self.share = share
        # log-likelihood of each class given a word, against the classes' shares
        part = (counts.sum(0) + 1) / (counts.sum() + CLASSES)
        lean = np.log((counts + 0.5 * part * CLASSES / 2) / (self.c + CLASSES / 4)[:, None] / part) if n else np.zeros((0, CLASSES))
        lean[:, counts.sum(0) == 0] = -1e6
        lean[end] = 0
        self.lean = np.ascontiguousarray(np.concatenate([lean, np.zeros((3, CLASSES))]).T.astype(np.float32))  # a row for each class
        # classes without training words are all alike: one of them is as far behind as any
        live, dead = np.flatnonzero(counts.sum(0)), np.flatnonzero(counts.sum(0) == 0)
        self.classes = [*live.tolist(), *dead[: 1 if len(live) else 2].tolist()]


class Tokens:
    """The words and ends of texts in a row: units, cells, and the contexts of each."""

    def __init__(self, text: pa.Array, lexicon: Lexicon, learning: bool = False):
        """While learning, a word counts as often as it occurs elsewhere: what is rare without it is rare."""
        words, self.n = words_of(text)
        self.sizes = pc.binary_length(words).to_numpy(zero_copy_only=False)
        e = words.dictionary_encode()
        self.dictionary, self.codes = e.dictionary, e.indices.to_numpy().astype(np.int64)
        place = pc.fill_null(pc.index_in(e.dictionary, lexicon.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        k = len(text)
        self.begin = spans_of(self.n + 1)
        self.doc = np.repeat(np.arange(k), self.n + 1)
        self.pos = np.arange(len(self.doc)) - self.begin[self.doc]
        self.inner = np.flatnonzero(self.pos < self.n[self.doc])  # places of the words among words and ends
        at = place[self.codes]
        self.unit = np.full(len(self.doc), lexicon.end, np.int64)
        self.unit[self.inner] = np.where(at >= 0, at, lexicon.rare)
        if learning:
            self.unit[lexicon.thin[self.unit]] = lexicon.rare
        self.cell = lexicon.cell[self.unit]
        one, two = (np.where(self.pos >= b, np.roll(self.unit, b), lexicon.before) for b in (1, 2))
        self.z = self._classes(lexicon)
        pair = lexicon.cell[two] * (CELLS + 1) + lexicon.cell[one]
        w1 = mix64((one + 1).astype(np.uint64) * _C1)
        w2 = mix64(w1 ^ (two + 1).astype(np.uint64) * _C2)
        self.contexts = (self.z, pair, w1, w2)

    def _classes(self, lexicon: Lexicon) -> np.ndarray:
        """The class that leads by the words before each token, or 0."""
        out = np.zeros(len(self.unit), np.int64)
        k = len(self.n)
        for d in np.array_split(np.arange(k), max(1, len(self.unit) // STRIPE)):
            if not len(d):
                continue
            a, b = self.begin[d[0]], self.begin[d[-1] + 1]
            unit, start = self.unit[a:b], self.begin[self.doc[a:b]] - a
            best, next_, which, sums = np.full(b - a, -np.inf), np.full(b - a, -np.inf), np.zeros(b - a, np.int64), np.zeros(b - a + 1)
            for i in lexicon.classes:
                np.cumsum(lexicon.lean[i].take(unit), dtype=np.float64, out=sums[1:])
                s = sums[:-1] - sums.take(start)
                np.maximum(next_, np.minimum(best, s), out=next_)
                which[s > best] = i + 1
                np.maximum(best, s, out=best)
            out[a:b] = np.where(best - next_ >= LEAD, which, 0)
        return out


def sizes_of(top: int) -> tuple[int, ...]:
    """Slots of the cell contexts' tables; the last two have 2^top."""
    return ((CLASSES + 1) * CELLS, (CELLS + 1) ** 2 * CELLS, 1 << top, 1 << top)


class Cells:
    """The mixer of cells' bits. `counts` while it learns, frozen log-odds while it scores."""

    WIDTH = 5

    def __init__(self, top: int, counts: list[np.ndarray] | None = None, weights: np.ndarray | None = None):
        self.top = top
        self.weights = self.first_weights() if weights is None else weights
        self.counts = [np.zeros(2 * n, np.float32) for n in sizes_of(top)] if counts is None else None
        if counts is not None:
            pairs = [c.reshape(-1, 2) for c in counts]
            self.odds = [np.log((c[:, 1] + 0.4) / (c[:, 0] + 0.4)).astype(np.float32) for c in pairs]
            self.seen = [self.level(c.sum(1)).astype(np.uint8) for c in pairs[2:]]
        self.curve = np.zeros((16 * DEPTH, self.WIDTH, self.WIDTH))
        self.steps = 0

    @classmethod
    def first_weights(cls) -> np.ndarray:
        """What a gate starts from: word contexts count for more the more they were seen."""
        gate = np.arange(16 * DEPTH) // DEPTH
        a, b = gate // 4 / 3, gate % 4 / 3
        rest = np.clip(1 - 0.7 * a - 0.3 * b, 0.1, 1)
        return np.stack([0.7 * rest, 0.3 * rest, 0.6 * a, 0.4 * b, 0 * a], 1)

    @staticmethod
    def level(n: np.ndarray) -> np.ndarray:
        return (n >= 1).view(np.uint8) + (n >= 4).view(np.uint8) + (n >= 16).view(np.uint8)

    def slots(self, contexts, cell: np.ndarray, j: int) -> list[np.ndarray]:
        node = (1 << j) | (cell >> (DEPTH - j))
        mixed = node.astype(np.uint64) * _C1
        hashed = [(((c ^ mixed) * _C2) >> np.uint64(64 - self.top)).view(np.int64) for c in contexts[2:]]
        return [contexts[0] * CELLS + node, contexts[1] * CELLS + node, *hashed]

    def learn(self, t: Tokens) -> None:
        """Predicts a chunk from what was counted before, takes a Newton step for every gate, then counts the chunk."""
        self.steps += 1
        rate = max(0.02, 0.5 / (1 + self.steps / 4))
        curve, slope, met, todo = np.zeros_like(self.curve), np.zeros_like(self.weights), np.zeros(len(self.weights), bool), []
        for at in range(0, len(t.cell), STRIPE):
            cell, contexts = t.cell[at : at + STRIPE], [c[at : at + STRIPE] for c in t.contexts]
            for j in range(DEPTH):
                bit = (cell >> (DEPTH - 1 - j)) & 1
                slots = self.slots(contexts, cell, j)
                pairs = [c.view(np.uint64).take(s).view(np.float32) for c, s in zip(self.counts, slots)]  # both counts of a slot at once
                x = np.ones((self.WIDTH, len(bit)))
                for k, c in enumerate(pairs):
                    c = c + np.float32(0.4)
                    x[k] = np.log(c[1::2] / c[::2])
                level = [self.level(c[::2] + c[1::2]) for c in pairs[2:]]
                gate = level[0] * np.uint8(4) + level[1]
                order = np.argsort(gate, kind="stable")
                ends = np.cumsum(np.bincount(gate, minlength=16))
                groups = [(g * DEPTH + j, slice(lo, hi)) for g, (lo, hi) in enumerate(zip([0, *ends], ends)) if lo < hi]
                xs, s = x.take(order, 1), np.empty(len(bit))
                for g, part in groups:
                    s[part] = self.weights[g] @ xs[:, part]
                p = 1 / (1 + np.exp(-np.clip(s, -14, 14)))
                miss, mass = bit.take(order) - p, p * (1 - p)
                for g, part in groups:
                    own = xs[:, part]
                    met[g] = True
                    curve[g] += (own * mass[part]) @ own.T
                    slope[g] += own @ miss[part]
                todo += [(c, s * 2 + bit) for c, s in zip(self.counts, slots)]
        for g in np.flatnonzero(met):
            self.curve[g] = 0.9 * self.curve[g] + curve[g]
            ridge = np.eye(self.WIDTH) * (0.01 * np.trace(self.curve[g]) / self.WIDTH + 1)
            self.weights[g] += rate * np.linalg.solve(self.curve[g] + ridge, slope[g])
        np.clip(self.weights, -3, 3, out=self.weights)
        for c, s in todo:
            np.add.at(c, s, np.float32(1))

    def inputs(self, contexts, cell: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of the predictors (and a constant), and the gate's choice, for bit j of every cell."""
        slots = self.slots(contexts, cell, j)
        x = np.ones((self.WIDTH, len(cell)), np.float32)
        for k, (odds, s) in enumerate(zip(self.odds, slots)):
            x[k] = odds.take(s)
        return x.T, (self.seen[0].take(slots[2]) * np.uint8(4) + self.seen[1].take(slots[3])) * np.uint8(DEPTH) + np.uint8(j)

    def log10(self, t: Tokens) -> np.ndarray:
        """log10 probability of each text's cells; each text's weights adapt after each of its blocks."""
        k = len(t.n)
        total = np.zeros(k)
        own = np.zeros((DEPTH, self.WIDTH, k))
        done = np.zeros(k)
        weights = np.ascontiguousarray(self.weights.T)
        block = np.searchsorted(BLOCKS, t.pos, side="right")
        order = np.argsort(block.astype(np.uint16) if block.max(initial=0) < 1 << 16 else block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        for rows in np.split(order, cuts) if len(order) else ():
            doc, cell, contexts = t.doc[rows], t.cell[rows], [c[rows] for c in t.contexts]
            first = np.flatnonzero(np.diff(doc, prepend=-1))  # a text's rows of a block lie together
            some, n = doc[first], np.diff(np.append(first, len(doc)))
            done[some] += n
            more = (t.pos[rows[first + n - 1]] < t.n[some]).any()
            for j in range(DEPTH):
                x, gate = self.inputs(contexts, cell, j)
                mine = own[j].take(some, 1)
                s = np.zeros(len(doc))
                for i, v in enumerate(x.T):
                    s += v * (weights[i].take(gate) + np.repeat(mine[i], n))
                sign = ((cell >> (DEPTH - 1 - j)) & 1) * 2.0 - 1
                odds = np.exp(-sign * np.clip(s, -14, 14))
                total[some] -= np.add.reduceat(np.log1p(odds), first) / math.log(10)
                if more:
                    miss = sign * odds / (1 + odds)
                    step = np.stack([np.add.reduceat(v, first) for v in miss * x.T])
                    own[j][:, some] = np.clip(mine + ADAPT * step / (done[some] + 50), -0.5, 0.5)
        return total


#: Where a text's blocks begin, and the rate of its own weights.
BLOCKS = np.concatenate([[32, 64, 128, 256, 512], np.arange(1024, 1 << 22, 1024)])
ADAPT = 0.5


def fit_cells(train: DataFrame, lexicon: Lexicon, n_train: int) -> Cells:
    """Learns in every partition over its texts in order; counts are summed, weights averaged by the words learned from."""
    spark = train.sparkSession
    top = int(min(TOP, max(10, math.ceil(math.log2(n_train + 1)))))
    held = spark.sparkContext.broadcast(lexicon)

    def learn(batches):
        model, mass = Cells(top), 0.0
        for batch in batches:
            text = text_column(batch)
            for lo, end in byte_slices(text):
                t = Tokens(text.slice(lo, end - lo), held.value, learning=True)
                model.learn(t)
                mass += len(t.unit)
        for k, c in enumerate(model.counts):
            yield _pack(k, c)
        yield _pack(len(model.counts), np.append(model.weights.ravel() * mass, mass).astype(np.float32))
        settle()

    got = _summed(train.select("text").mapInArrow(learn, _PACKED))
    sizes = sizes_of(top)
    shape = Cells.first_weights().shape
    tail = _table(shape[0] * shape[1] + 1, got.get(len(sizes), {})).astype(np.float64)
    weights = (tail[:-1] / tail[-1]).reshape(shape) if tail[-1] else Cells.first_weights()
    return Cells(top, [_table(2 * n, got.get(k, {})) for k, n in enumerate(sizes)], weights)


def score(docs: DataFrame, cells: Cells, spelling: Model, lexicon: Lexicon, least: int, words: DataFrame, n_train: int, v_train: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    floor = n_train + 0.5 * (v_train + 1)
    ends = n_train - int(words.where("word <> ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    rare_words = words.where((F.col("c") < least) & (F.col("word") != ""))
    rare_mass, single = rare_words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") == 1)).first()
    # the share of words never seen among rare ones, by Good and Turing: a word seen r times was seen r - 1 times by the rest
    edge = int(lexicon.c[lexicon.thin[: len(lexicon.c)]].sum())
    unseen = min(0.999, max(1e-4, (single + 0.5) / (rare_mass + edge + 1)))
    held = spark.sparkContext.broadcast((cells, lexicon))
    spell = spark.sparkContext.broadcast(spelling)
    base_of = np.log10((np.concatenate([lexicon.c, [0, ends, 0]]) + 0.5) / floor)

    def read(batches):
        m, lex = held.value
        for batch in batches:
            whole = text_column(batch)
            for lo, stop in byte_slices(whole):
                t = Tokens(whole.slice(lo, stop - lo), lex)
                k = stop - lo
                seen = t.unit != lex.rare
                got = m.log10(t) + np.bincount(t.doc, lex.share[t.unit], k)
                base = np.bincount(t.doc[seen], base_of[t.unit[seen]], k)
                known = np.bincount(t.doc[seen & (t.unit != lex.end)], minlength=k) + (ends > 0)
                size = np.bincount(t.doc[t.inner], t.sizes + 1, k) + 1
                rare = np.flatnonzero(~seen[t.inner])
                r, doc = len(rare), t.doc[t.inner[rare]]
                rid = batch.column(0).slice(lo, k)
                with_nulls = lambda v: pa.concat_arrays([v, pa.nulls(r, v.type)])
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([rid, rid.take(pa.array(doc))]), pa.concat_arrays([pa.nulls(k, pa.string()), t.dictionary.take(pa.array(t.codes[rare])).cast(pa.string())]),
                     pa.array(np.concatenate([np.zeros(k), t.z[t.inner[rare]]]).astype(np.int32)), *(with_nulls(pa.array(v)) for v in (t.n + 1, known.astype(np.int64), base, got, size.astype(np.int64))),
                     with_nulls(batch.column(2).slice(lo, k)), with_nulls(batch.column(3).slice(lo, k))],
                    ["rid", "word", "z", "n_tokens", "n_known", "base", "got", "size", "doc_id", "held_out"],
                )

    rows = with_rid(docs).select("rid", "text", F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 5) == 1).alias("held_out"))
    schema = "rid long, word string, z int, n_tokens long, n_known long, base double, got double, size long, doc_id long, held_out boolean"
    tokens = Stored(rows.mapInArrow(read, schema), "tokens").df

    def spelled(batches):
        m = spell.value
        for batch in batches:
            e = batch.column(1).cast(pa.large_string()).dictionary_encode()
            key = e.indices.to_numpy().astype(np.int64) * (CLASSES + 1) + batch.column(2).to_numpy()
            unit, index = np.unique(key, return_inverse=True)
            got = m.log10(e.dictionary.take(pa.array(unit // (CLASSES + 1))), unit % (CLASSES + 1))[index]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["rid", "got"])

    cold = tokens.where("word IS NOT NULL").select("rid", "word", "z")
    joined = cold.join(rare_words.select("word", "c"), "word", "left")
    none = lambda t: F.lit(None).cast(t)
    # counts are summed by text before anything else travels; only unseen words are spelled
    met = joined.where("c IS NOT NULL").select("rid", F.lit(1).cast("long").alias("n_known"), F.log10((F.col("c") + 0.5) / floor).alias("base"), F.log10(F.col("c") * ((1 - unseen) / max(1, rare_mass))).alias("got"))
    new = joined.where("c IS NULL").select("rid", "word", "z").mapInArrow(spelled, "rid long, got double").select("rid", F.lit(0).cast("long").alias("n_known"), F.lit(math.log10(0.5 / floor)).alias("base"), (F.col("got") + math.log10(unseen)).alias("got"))
    late = met.unionByName(new).select("rid", none("long").alias("n_tokens"), "n_known", "base", "got", none("long").alias("size"), none("long").alias("doc_id"), none("boolean").alias("held_out"))
    # a row of a text has its number of tokens, a rare word's row has none
    every = tokens.where("n_tokens IS NOT NULL").select("rid", "n_tokens", "n_known", "base", "got", "size", "doc_id", "held_out").unionByName(late)
    total = every.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "got", "size")))
    bits = -F.col("got") / math.log10(2)
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("got").alias("score"), (bits / F.col("size")).alias("bits_per_byte"))


def lm_scores(docs: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out, scores all."""
    small_batches(docs.sparkSession)
    train = docs.where(crc_mod("doc_id", 5) != 1)
    words = Stored(word_table(train, class_names(train)), "words").df
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    table, least = lexicon_of(words)
    lexicon = Lexicon(table, least)
    spelling = fit_spelling(words, table, least)
    del table
    return score(docs, fit_cells(train, lexicon, int(n)), spelling, lexicon, least, words, int(n), int(v))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
