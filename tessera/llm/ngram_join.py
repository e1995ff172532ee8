"""N-gram Jaccard self-join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set holds the hashes of its distinct k-word shingles. Equal sets are one *class* from the start. Classes
fall into geometric size bands so that only classes of one band or of neighbouring bands can reach the threshold; a tile
is two such bands. In a tile, two sets that reach the threshold differ in at most D elements, so if hash space is cut
into more than D buckets, they agree in a whole bucket (counting only buckets in which a set has elements whenever more
than D do): classes meet where a bucket's content hashes alike. Buckets of few elements propose pairs that share a common
passage and little else, so a set that has more than D buckets of `Bands.least` elements or more sends these only: one of
them is the same in a linked set, which therefore sends it too. Nothing is lost by this, and no frequency order or cap is
needed.

Classes that meet are first tested against the least class that they meet (a star, not all pairs). Components of the links found are contracted, and only members of *different* components that still meet are compared in
blocks: bitmap signatures bound the overlap from above (elements minus bits that the other bitmap lacks), and what
survives is intersected exactly. A pair in several stars is taken at the first of them only. So families
of thousands of near copies cost links in proportion to their size.

Hashes of shingles have 48 bits where sets are stored and intersected; content hashes have 48 bits beside the number of
their piece, and only propose pairs.

Edge cases: null, empty and blank texts have no set and no links; texts with fewer than k words are one shingle; repeated
rows are one class and link; a null doc_id takes part, and its component is the least non-null doc_id reachable (null if
there is none); an empty table gives an empty result; extra columns are ignored. The input must read the same twice
(files, not a random sample).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, byte_slices, mix64, n_parts, settle, spans_of, text_column, with_rid, word_hashes, words_of
from .components import components

#: Pieces that rows are dealt out in, for each partition of the shuffle.
SPREAD = 4
#: Rows of a block when members of different components are compared.
BLOCK = 1024
#: Pairs whose keys are broadcast, at most (32 bytes each); beyond it, both sides are shuffled.
FEW = 200_000


def shingle_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and how many each has."""
    words, counts = words_of(text)
    h = word_hashes(words)
    n = np.maximum(counts - k + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(text)), n)
    at = np.arange(int(n.sum())) - np.repeat(spans_of(n)[:-1], n) + np.repeat(spans_of(counts)[:-1], n)
    width = np.repeat(np.minimum(counts, k), n)
    s = width.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    for j in range(k):
        inside = j < width
        s = np.where(inside, mix64(s ^ h[np.minimum(at + j, max(0, len(h) - 1))]) + np.uint64(j + 1), s) if len(h) else s
    s >>= np.uint64(16)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[keep], np.bincount(doc[keep], minlength=len(text))


def short(x: np.ndarray) -> bytes:
    """Six bytes of each number, which are all that 48-bit hashes have."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def set_keys(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each set."""
    offsets = spans_of(counts)
    out = np.zeros((len(counts), 2), np.int64)
    for j, salt in enumerate((np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(s ^ salt))])
        out[:, j] = mix64((sums[offsets[1:]] - sums[offsets[:-1]]) ^ counts.astype(np.uint64) * salt).view(np.int64)
    return out


class Bands:
    """Size bands and tiles for a threshold of num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ratio = num / den
        edges = [1]
        while edges[-1] < 1 << 40:
            # the next band begins at the least size that no size below this band's edge reaches
            edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * den / num)))
        self.edges = np.array(edges)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, side="right") - 1

    def most(self, band: np.ndarray) -> np.ndarray:
        """The largest size in a band."""
        return self.edges[band + 1] - 1

    def differ(self, tile: np.ndarray) -> np.ndarray:
        """The most elements in which two sets of bands tile-1 and tile can differ and still reach the threshold."""
        both = 2 * self.most(tile)
        return both * (self.den - self.num) // (self.den + self.num)

    def buckets(self, differ: np.ndarray) -> np.ndarray:
        """In how many buckets a tile's sets are cut: a quarter more than needed, so that enough of them are well filled."""
        return differ + 2 + differ // 4

    @property
    def least(self) -> int:
        """Elements of a well filled bucket: half of what a bucket of a tile holds on average."""
        return max(1, round((self.den + self.num) / (2 * (self.den - self.num)) / 1.25 / 2)) if self.den > self.num else 1

    def link(self, a: int, b: int, common: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def needed(self, a, b):
        """The least overlap of a link."""
        return -(-self.num * (a + b) // (self.den + self.num))


def bucket_rows(s: np.ndarray, counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(class index, content hash) for every bucket of both tiles of each set."""
    owners, hashes = [], []
    live = np.flatnonzero(counts)
    band = bands.of(np.maximum(counts, 1))
    sets = np.repeat(np.arange(len(counts)), counts)
    mixed = mix64(s)
    for up in (0, 1):
        tile = band + up
        most = bands.differ(tile)
        k = bands.buckets(most)
        own_k = k[sets].astype(np.uint64)
        bucket = ((mixed >> np.uint64(32)) * own_k) >> np.uint64(32)
        base = spans_of(np.where(counts > 0, k, 0))
        slot = base[sets] + bucket.astype(np.int64)
        total = int(base[-1])
        order = np.argsort(slot, kind="stable")
        value = mix64(mixed[order] ^ np.uint64(0x632BE59BD9B4E019))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value)])
        ends = np.searchsorted(slot[order], np.arange(total + 1))
        content = sums[ends[1:]] - sums[ends[:-1]]
        size = np.diff(ends)
        owner = np.repeat(live, k[live])
        number = np.arange(total) - base[owner]
        enough = lambda at_least: (np.bincount(owner[size >= at_least], minlength=len(counts)) > most)[owner]
        filled, well = size > 0, enough(bands.least)
        keep = np.where(well, size >= bands.least, np.where(enough(1), filled, True))
        h = mix64(content ^ mix64(number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tile[owner].astype(np.uint64) + (~filled).astype(np.uint64) * np.uint64(77)))
        owners.append(owner[keep])
        hashes.append(h[keep])
    return np.concatenate(owners), np.concatenate(hashes)


_MEETINGS = "part int, h binary, c binary, hi binary, lo binary"


def stars(sets_text: DataFrame, k: int, bands: Bands) -> DataFrame:
    """(ahi, alo, bhi, blo): each class with the least classes of its meetings, once. Rows travel packed by destination."""
    spark = sets_text.sparkSession
    parts = n_parts(spark)
    pieces = parts * SPREAD

    def emit(batches):
        seen: set = set()
        for batch in batches:
            text = text_column(batch)
            for lo, end in byte_slices(text):
                s, counts = shingle_sets(text.slice(lo, end - lo), k)
                keys = set_keys(s, counts)
                fresh = np.zeros(len(counts), bool)
                for i, key in enumerate(map(tuple, keys.tolist())):
                    if counts[i] and key not in seen:
                        fresh[i] = True
                        if len(seen) < 100_000:
                            seen.add(key)
                if not fresh.any():
                    continue
                s, keys, counts = s[np.repeat(fresh, counts)], keys[fresh], counts[fresh]
                owner, h = bucket_rows(s, counts, bands)
                part = (h % np.uint64(pieces)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                owner, h, part = owner[order], h[order] >> np.uint64(16), part[order]
                at = np.searchsorted(part, np.arange(pieces + 1))
                some = np.flatnonzero(np.diff(at))
                rows = [[], [], [], [], []]
                for p in some:
                    o = owner[at[p] : at[p + 1]]
                    who, index = np.unique(o, return_inverse=True)
                    for r, v in zip(rows, (p, short(h[at[p] : at[p + 1]]), index.astype(np.uint16).tobytes(), keys[who, 0].tobytes(), keys[who, 1].tobytes())):
                        r.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["part", "h", "c", "hi", "lo"])

    def meet(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        # the piece is part of a content hash: pieces lie in 16 bits above the 48
        h = np.concatenate([long(r["h"]) | np.uint64(r["part"] % 65536) << np.uint64(48) for r in rows]).view(np.int64)
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        alone = new & np.append(new[1:], True)
        shared = np.ones(len(h), bool)
        shared[order[alone]] = False
        del order, new, alone
        # of what meets nothing, classes are never looked up
        hi, lo, at = [], [], 0
        for r in rows:
            c = np.frombuffer(r["c"], np.uint16)
            c = c[shared[at : at + len(c)]]
            at += len(r["c"]) // 2
            hi.append(np.frombuffer(r["hi"], np.int64)[c])
            lo.append(np.frombuffer(r["lo"], np.int64)[c])
        del rows
        h, hi, lo = h[shared], np.concatenate(hi), np.concatenate(lo)
        order = np.lexsort((lo, hi, h))
        h, hi, lo = h[order], hi[order], lo[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        h, hi, lo = h[new], hi[new], lo[new]
        # the first of a meeting is its least class; every other class is a spoke
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        centre = np.flatnonzero(first)[np.cumsum(first) - 1] if len(h) else np.zeros(0, np.int64)
        spoke = np.flatnonzero(~first)
        rows = np.stack([hi[centre[spoke]], lo[centre[spoke]], hi[spoke], lo[spoke]])
        order = np.lexsort(rows[::-1])
        rows = rows[:, order]
        new = np.ones(len(order), bool)
        new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
        if len(order):
            yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in rows], ["ahi", "alo", "bhi", "blo"])
        settle()

    packed = sets_text.select("text").mapInArrow(emit, _MEETINGS)
    return packed.repartition(2 * parts, "part").mapInArrow(meet, "ahi long, alo long, bhi long, blo long").distinct()


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[(s >> np.uint64(9)) % np.uint64(bits)] = True
    return np.packbits(out).view(np.uint64)


def bits_for(n: int) -> int:
    """Bits of a bitmap: about four for each element of a set of the band's size, a power of two."""
    return max(256, 1 << (4 * n - 1).bit_length())


def overlap_bound(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> int:
    """The overlap is at most each side's elements less the bits that only it has; bitmaps of different length are folded."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))


def verified(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """pairs (ahi, alo, bhi, blo) whose sets reach the threshold: bitmaps first, then sorted arrays."""
    left = sets.select(F.col("hi").alias("ahi"), F.col("lo").alias("alo"), F.col("n").alias("an"), F.col("bits").alias("abits"))
    right = sets.select(F.col("hi").alias("bhi"), F.col("lo").alias("blo"), F.col("n").alias("bn"), F.col("bits").alias("bbits"))

    def by_bits(batches):
        for batch in batches:
            keep = [
                overlap_bound(np.frombuffer(r["abits"], np.uint64), r["an"], np.frombuffer(r["bbits"], np.uint64), r["bn"]) >= bands.needed(r["an"], r["bn"])
                for r in batch.select(["an", "abits", "bn", "bbits"]).to_pylist()
            ]
            yield batch.select(["ahi", "alo", "bhi", "blo"]).filter(pa.array(keep, pa.bool_()))

    def by_sets(batches):
        for batch in batches:
            keep = []
            for r in batch.select(["a", "b"]).to_pylist():
                a, b = long(r["a"]), long(r["b"])
                j = np.minimum(np.searchsorted(b, a), len(b) - 1)
                keep.append(bands.link(len(a), len(b), int((b[j] == a).sum())))
            yield batch.select(["ahi", "alo", "bhi", "blo"]).filter(pa.array(keep, pa.bool_()))

    ids = "ahi long, alo long, bhi long, blo long"
    able = (F.col("an") * bands.den >= F.col("bn") * bands.num) & (F.col("bn") * bands.den >= F.col("an") * bands.num)
    close = Stored(pairs.join(left, ["ahi", "alo"]).join(right, ["bhi", "blo"]).where(able).mapInArrow(by_bits, ids), "close").df
    few = close.count() <= FEW
    a = sets.select(F.col("hi").alias("ahi"), F.col("lo").alias("alo"), F.col("s").alias("a"))
    b = sets.select(F.col("hi").alias("bhi"), F.col("lo").alias("blo"), F.col("s").alias("b"))
    if few:  # the pairs are few: they go to the arrays, and only arrays of pairs move
        a = a.join(F.broadcast(close.select("ahi", "alo").distinct()), ["ahi", "alo"], "left_semi")
        b = b.join(F.broadcast(close.select("bhi", "blo").distinct()), ["bhi", "blo"], "left_semi")
    return close.join(a, ["ahi", "alo"]).join(b, ["bhi", "blo"]).select("ahi", "alo", "bhi", "blo", "a", "b").mapInArrow(by_sets, ids)


def _nodes(hi: str, lo: str):
    return F.struct(F.col(hi).alias("hi"), F.col(lo).alias("lo"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for links of Jaccard similarity >= num/den between sets of k-word shingles."""
    bands = Bands(num, den)
    docs = with_rid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def light(batches):
        for batch in batches:
            text = text_column(batch)
            for lo, end in byte_slices(text):
                s, counts = shingle_sets(text.slice(lo, end - lo), k)
                keys = set_keys(s, counts)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, end - lo) for c in (0, 2)), pa.array(counts, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["doc_id", "rid", "n", "hi", "lo"])

    rows = Stored(docs.mapInArrow(light, "doc_id long, rid long, n long, hi long, lo long"), "sets").df
    met = Stored(stars(docs, k, bands), "stars")
    nodes = met.df.select(F.col("ahi").alias("hi"), F.col("alo").alias("lo")).union(met.df.select("bhi", "blo")).distinct()

    # the sets of the classes that meet others: one row (by its never-null number) stands for a class; texts are dealt out once
    chosen = rows.where("n > 0").join(nodes, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.min("rid").alias("rid"))

    def full(batches):
        for batch in batches:
            text = text_column(batch)
            for lo, end in byte_slices(text, 2 << 20, 256):
                part = text.slice(lo, end - lo)
                s, counts = shingle_sets(part, k)
                at, keys = spans_of(counts), set_keys(s, counts)
                sets = [s[a:b] for a, b in zip(at, at[1:])]
                bits = [bitmap(x, bits_for(len(x))).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(counts, pa.int64()), pa.array(bits, pa.binary()), pa.array([short(x) for x in sets], pa.binary())], ["hi", "lo", "n", "bits", "s"])

    sets_text = docs.join(chosen.select("rid"), "rid").select("text")
    # one row for each class that was chosen: a set's key is that of its class
    sets = Stored(sets_text.mapInArrow(full, "hi long, lo long, n long, bits binary, s binary"), "arrays")

    links = Stored(verified(met.df, sets.df, bands), "starlinks")
    edges = links.df.select(_nodes("ahi", "alo").alias("a"), _nodes("bhi", "blo").alias("b"))
    first = Stored(components(edges), "comp")

    # stars that reach over several components: their members may link with each other
    of_class = first.df.select(F.col("node.hi").alias("hi"), F.col("node.lo").alias("lo"), "component")
    h = F.xxhash64("ahi", "alo").alias("h")
    member = met.df.select(h, F.col("bhi").alias("hi"), F.col("blo").alias("lo")).unionByName(met.df.select(h, F.col("ahi").alias("hi"), F.col("alo").alias("lo")).distinct())
    labelled = member.join(of_class, ["hi", "lo"], "left").withColumn("component", F.coalesce("component", F.struct("hi", "lo")))
    mixed = labelled.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("h")
    open_ = Stored(labelled.join(mixed, "h"), "open")
    every = edges
    if not open_.df.isEmpty():
        rest = _across(open_.df, sets.df, bands).join(met.df, ["ahi", "alo", "bhi", "blo"], "left_anti")
        more = Stored(verified(rest, sets.df, bands), "morelinks")
        every = first.df.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.df.select(_nodes("ahi", "alo").alias("a"), _nodes("bhi", "blo").alias("b")))
        comp = Stored(components(every), "comp")
        first.drop(), more.drop()
    else:
        comp = first
    for table in (met, sets, links, open_):
        table.drop()

    comp = comp.df.select(F.col("node.hi").alias("hi"), F.col("node.lo").alias("lo"), "component")
    classes = rows.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("least")).join(comp, ["hi", "lo"], "left").withColumn("component", F.coalesce("component", F.struct("hi", "lo")))
    ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = classes.join(ids, "component").select("hi", "lo", "component_id")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(labels, ["hi", "lo"], "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def _across(open_: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Pairs of members of one star but of different components that their sizes and bitmaps allow to link, each once.

    Two classes that meet are in the star of the least class of their meeting. A star is cut into blocks of `BLOCK` members;
    each two blocks are one group, so that a large star is many tasks. A member carries its open stars, which tell whether
    this one is the first that a pair shares.
    """
    own = open_.groupBy("hi", "lo").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    sized = open_.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = open_.join(sized, "h").join(own, ["hi", "lo"]).join(sets.select("hi", "lo", "n", "bits"), ["hi", "lo"])
    member = member.withColumn("block", F.pmod(F.xxhash64("hi", "lo"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    dealt = member.withColumn("tile", F.explode(others)).select("h", "tile.i", "tile.j", "block", "hi", "lo", "n", "bits", "hs", F.xxhash64("component").alias("comp"))

    def compare(key, table):
        t = table.sort_by([("hi", "ascending"), ("lo", "ascending")])
        n, comp, block = (t[c].to_numpy() for c in ("n", "comp", "block"))
        hi, lo = t["hi"].to_numpy(), t["lo"].to_numpy()
        same_tile = t["i"][0].as_py() == t["j"][0].as_py()
        turn = t["h"][0].as_py()
        hs = t["hs"].combine_chunks()
        at, hs = hs.offsets.to_numpy(), hs.values.to_numpy()
        before = [hs[x : x + int(np.searchsorted(hs[x:y], turn))] for x, y in zip(at, at[1:])]  # stars whose turn is earlier
        bits = [np.frombuffer(b, np.uint64) for b in t["bits"].to_pylist()]
        width = min(map(len, bits))
        flat = np.empty((len(bits), width), np.uint64)
        for k, b in enumerate(bits):
            while len(b) > width:
                b = b[: len(b) // 2] | b[len(b) // 2 :]
            flat[k] = b
        out: list = []
        for k in range(len(n) - 1):
            j = np.arange(k + 1, len(n))
            ok = (comp[j] != comp[k]) & (n[j] * bands.den >= n[k] * bands.num) & (n[k] * bands.den >= n[j] * bands.num)
            if not same_tile:
                ok &= block[j] != block[k]
            j = j[ok]
            if len(j):
                a = np.bitwise_count(flat[k] & ~flat[j]).sum(1).astype(np.int64)
                b = np.bitwise_count(flat[j] & ~flat[k]).sum(1).astype(np.int64)
                j = j[np.minimum(n[k] - a, n[j] - b) >= bands.needed(n[k], n[j])]
                j = j[np.array([not np.isin(before[m], before[k]).any() for m in j], bool)]
                out.append(np.stack([np.full(len(j), k), j]))
        a, b = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"ahi": hi[a], "alo": lo[a], "bhi": hi[b], "blo": lo[b]})

    # dealt by block pair: a partitioning by h alone would put all blocks of a large meeting into one task
    dealt = dealt.repartition(n_parts(open_.sparkSession), "h", "i", "j")
    return dealt.groupBy("h", "i", "j").applyInArrow(compare, "ahi long, alo long, bhi long, blo long")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=9, den=10)
