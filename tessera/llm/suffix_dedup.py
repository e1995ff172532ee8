"""Suffix-array dedup: removes every byte covered by a string of `LENGTH` bytes that also starts elsewhere.

Blockwise construction over a cover sample. Only a sample of suffixes, the *cover*, is ranked globally: a position is in
it if its q-gram is the least of some window of `WINDOW` starts, so two equal strings of `LENGTH` bytes hold the same
cover position at the same distance from their starts (what a difference cover grants by residues, granted here by
content: a cover by residues of the same window would hold about a tenth of all positions, this one holds a fiftieth).
Suffixes fall into buckets by the rank (the digest) of the `RANKED` bytes behind their cover position; buckets are
sorted one partition at a time. A suffix alone in its bucket repeats nowhere. In a bucket, the long tie behind the
cover position is already resolved by its rank; equal surroundings are resolved by one more digest, and only starts
near the ends of a match are compared by digests of their whole strings. Digests are 64 bits of polynomials over random
byte values, two independent ones together.

Rows travel packed by destination; texts are dealt out once, by row, for the open strings and for the removal alike.

Edge cases: null and empty texts have no bytes and nothing to remove; texts shorter than `LENGTH` are kept whole; strings
never cross documents; repeated rows lose whatever they share, which is all of it from `LENGTH` bytes on; null doc_ids are
kept apart by row; an empty table gives an empty result; extra columns are kept. The input must read the same twice
(files, not a random sample).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, Stored, mix64, n_parts, settle, text_column, with_rid

LENGTH = 200
WINDOW = 100
GRAM = 16
RANKED = LENGTH - WINDOW + 1
#: Bytes that are hashed at a time (a worker holds about a hundred times as many); a position fits in 24 bits.
SLICE = 512 << 10
#: Bytes of texts whose starts travel together.
PACKED = 2 << 20
SPREAD = 4
WHOLE, ENDS, WHOLE_ENDS = 0, 1, 2


def slices(batch, most: int):
    """(first row, bytes, offsets) of consecutive texts of at most `most` bytes together; a longer text comes in overlapping parts.

    A part of a long text is (row, bytes, offsets, shift): starts are counted from shift, and parts overlap by LENGTH - 1.
    """
    text = text_column(batch)
    at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(text):
        if at[row + 1] - at[row] > most:
            a, b = int(at[row]), int(at[row + 1])
            while a < b:
                c = min(b, a + most)
                yield row, data[a:c], np.array([0, c - a]), a - int(at[row])
                if c == b:
                    break
                a = c - LENGTH + 1
            row += 1
            continue
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row], 0
        row = end


def covers(data: np.ndarray, offsets: np.ndarray):
    """Document, first start, last start, cover position, rank and surroundings' digest of every run of starts."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = Rolling(data, 0)
    places = np.arange(n - GRAM + 1)
    low = (hashes.window(places, GRAM) & ~np.uint64((1 << 24) - 1)) | places.astype(np.uint64)
    width = 1
    while width * 2 <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - width)], low[WINDOW - width :])
    sizes = np.diff(offsets)
    starts_each = np.maximum(sizes - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), starts_each)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(starts_each) - starts_each, starts_each) + np.repeat(offsets[:-1], starts_each)
    if not len(start):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    cover = (low[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
    edge = np.ones(len(start), bool)
    edge[1:] = (cover[1:] != cover[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(start)) - 1
    doc, p, i0, i1 = doc[first], cover[first], start[first], start[last]
    rank = hashes.window(p, np.full(len(p), RANKED))
    around = Rolling(data, 1).window(i0, i1 - i0 + LENGTH) ^ mix64((p - i0).astype(np.uint64))
    return doc, i0 - offsets[doc], i1 - offsets[doc], p, rank, around


_PACKED = "part int, rank binary, around binary, c binary, rid binary, i0 binary, runs binary"


def _dealt(rids: np.ndarray, found: list, pieces: int) -> pa.RecordBatch:
    """Starts by destination: one row for each piece that has any."""
    row, i0, runs, rank, around = map(np.concatenate, zip(*found))
    part = (rank % np.uint64(pieces)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, row, i0, runs, rank, around = part[order], row[order], i0[order], runs[order], rank[order], around[order]
    at = np.searchsorted(part, np.arange(pieces + 1))
    rows = [[] for _ in range(7)]
    for k in np.flatnonzero(np.diff(at)):
        s = slice(at[k], at[k + 1])
        who, index = np.unique(row[s], return_inverse=True)
        for r, v in zip(rows, (k, rank[s].tobytes(), around[s].tobytes(), index.astype(np.uint32).tobytes(), rids[who].tobytes(), i0[s].tobytes(), runs[s].tobytes())):
            r.append(v)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["part", "rank", "around", "c", "rid", "i0", "runs"])


def _settled(run):
    """`run`, which gives its memory back when a task is over: a worker keeps it for the next stage otherwise."""

    def settled(batches):
        yield from run(batches)
        settle()

    return settled


def _emit(pieces: int):
    def run(batches):
        for batch in batches:
            rids = batch.column(0).to_numpy()
            found, held = [], 0
            for row, data, offsets, shift in slices(batch, SLICE):
                doc, i0, i1, _, rank, around = covers(data, offsets)
                held += len(data)
                if len(doc):
                    found.append((row + doc, i0 + shift, (i1 - i0).astype(np.uint8), rank, around))
                if found and held >= PACKED:
                    yield _dealt(rids, found, pieces)
                    found, held = [], 0
            if found:
                yield _dealt(rids, found, pieces)
            settle()

    return run


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the first most) and, in that order, the number of each row's group."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.cumsum(new) - 1


def _buckets(batches):
    """Starts that share their bucket with others: WHOLE if their surroundings repeat, ENDS if that is still open."""
    got = [[] for _ in range(5)]
    for batch in batches:
        for r in batch.to_pylist():
            c = np.frombuffer(r["c"], np.uint32)
            for g, v in zip(got, (np.frombuffer(r["rank"], np.uint64), np.frombuffer(r["around"], np.uint64), np.frombuffer(r["rid"], np.int64)[c], np.frombuffer(r["i0"], np.int64), np.frombuffer(r["runs"], np.uint8))):
                g.append(v)
    if not got[0]:
        return
    rank, around, rid, i0, runs = map(np.concatenate, got)
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    new = np.flatnonzero(np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]]))
    size = np.diff(np.append(new, len(rank)))
    keep = order[np.repeat(size > 1, size)]
    rank, around, rid, i0, runs = rank[keep], around[keep], rid[keep], i0[keep], runs[keep].astype(np.int64)
    if not len(rank):
        return
    order, group = _groups(rank, around)
    rank, rid, i0, runs = rank[order], rid[order], i0[order], runs[order]
    copies = np.bincount(group)[group]
    first = np.ones(len(group), bool)
    first[1:] = group[1:] != group[:-1]
    bucket = np.cumsum(np.concatenate([[True], rank[1:] != rank[:-1]])) - 1
    several = (np.bincount(bucket, first) > 1)[bucket]
    state = np.where(copies > 1, np.where(several & first, WHOLE_ENDS, WHOLE), ENDS).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(i0), pa.array(i0 + runs), pa.array(rank.view(np.int64)), pa.array(state)], ["rid", "i0", "i1", "rank", "state"])


def _strings(name: str):
    """Digests of the whole strings at starts that are still open."""

    def run(batches):
        for batch in batches:
            text = text_column(batch, name)
            out = [[] for _ in range(5)]
            for k, (rid, open_) in enumerate(zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())):
                if not open_:
                    continue
                data = np.frombuffer(text[k].as_buffer(), np.uint8)
                for a in range(0, len(data), SLICE):
                    mine = [r for r in open_ if a <= r["i0"] < a + SLICE]
                    if not mine:
                        continue
                    part = data[a : a + SLICE + LENGTH + WINDOW]
                    x, y = Rolling(part, 0), Rolling(part, 1)
                    i0 = np.array([r["i0"] for r in mine])
                    n = np.array([r["i1"] for r in mine]) - i0 + 1
                    at = np.repeat(i0 - a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    h = x.window(at, LENGTH) ^ (y.window(at, LENGTH) >> np.uint64(7))
                    for r, piece in zip(mine, np.split(h, np.cumsum(n)[:-1])):
                        for o, v in zip(out, (r["rank"], rid, r["i0"], r["state"] == ENDS, piece.tobytes())):
                            o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_()), pa.array(out[4], pa.binary())], ["rank", "rid", "i0", "open", "h"])

    return run


def _ends(batches):
    """Runs of open starts whose strings repeat in their bucket."""
    rank, rid, i0, open_, h = ([] for _ in range(5))
    for batch in batches:
        for r in batch.to_pylist():
            v = np.frombuffer(r["h"], np.uint64)
            n = len(v)
            h.append(v)
            rank.append(np.full(n, r["rank"]))
            rid.append(np.full(n, r["rid"]))
            i0.append(r["i0"] + np.arange(n))
            open_.append(np.full(n, r["open"]))
    if not h:
        return
    rank, rid, start, open_, h = map(np.concatenate, (rank, rid, i0, open_, h))
    order, group = _groups(rank, h)
    hit = order[(np.bincount(group)[group] > 1)]
    hit = np.sort(hit[open_[hit]])
    rid, start = rid[hit], start[hit]
    if not len(rid):
        return
    edge = np.ones(len(rid), bool)
    edge[1:] = (rid[1:] != rid[:-1]) | (start[1:] != start[:-1] + 1)
    a = np.flatnonzero(edge)
    b = np.append(a[1:], len(rid)) - 1
    yield pa.RecordBatch.from_arrays([pa.array(rid[a]), pa.array(start[a]), pa.array(start[b])], ["rid", "i0", "i1"])


def without(data: bytes, runs) -> tuple[bytes, int]:
    """The bytes that no run of starts covers, and the number of maximal removed runs."""
    kept, at, n = [], 0, 0
    for a, b in sorted(runs):
        b += LENGTH
        if a > at or not n:
            kept.append(data[at:a])
            n += 1
        at = max(at, b)
    kept.append(data[at:])
    return b"".join(kept), n


_RESULT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """docs with the kept text, n_bytes, n_removed, n_spans and kept_sha256.

    Where removal splits a character, the text has U+FFFD in place of what is left of it; the digest is of the bytes.
    """
    parts = n_parts(docs.sparkSession)
    names = docs.columns
    at = names.index("text")
    wide = [f"c{k}" for k in range(len(names))]  # names of the input clash with nothing
    rowed = with_rid(docs.toDF(*wide))
    packed = rowed.select("rid", F.col(wide[at]).alias("text")).mapInArrow(_emit(parts * SPREAD), _PACKED)
    found = packed.repartition(parts, "part").mapInArrow(_settled(_buckets), "rid long, i0 long, i1 long, rank long, state int")
    item = F.struct("i0", "i1", "rank", "state")
    of_doc = Stored(
        found.groupBy("rid").agg(
            F.collect_list(F.when(F.col("state") != ENDS, F.struct("i0", "i1"))).alias("runs"), F.collect_list(F.when(F.col("state") != WHOLE, item)).alias("open")
        ),
        "runs",
    ).df
    # both joins take the same columns of the texts, so that one exchange serves them; sides are merged, as their size follows the data
    strings = rowed.join(of_doc.where(F.size("open") > 0).select("rid", "open").hint("merge"), "rid").select("rid", *wide, "open").mapInArrow(_settled(_strings(wide[at])), "rank long, rid long, i0 long, open boolean, h binary")
    ends = strings.repartition(parts, "rank").mapInArrow(_settled(_ends), "rid long, i0 long, i1 long").groupBy("rid").agg(F.collect_list(F.struct("i0", "i1")).alias("more"))

    extra = {f.name for f in _RESULT}
    keep = [k for k, c in enumerate(names) if c not in extra]
    schema = T.StructType([docs.schema[k] for k in keep] + _RESULT)

    def finish(batches):
        for batch in batches:
            text = text_column(batch, wide[at])
            new, n, spans, digest = [], [], [], []
            for k, (runs, more) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist())):
                data = text[k].as_py().encode()
                kept, m = without(data, [(r["i0"], r["i1"]) for r in (runs or []) + (more or [])]) if runs or more else (data, 0)
                new.append(kept.decode("utf-8", "replace"))
                n.append(len(data))
                spans.append((len(data) - len(kept), m))
                digest.append(hashlib.sha256(kept).hexdigest())
            columns = [pa.array(new, pa.string()) if k == at else batch.column(k) for k in keep]
            columns += [pa.array(n, pa.int64()), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    marked = rowed.join(of_doc.select("rid", "runs").hint("merge"), "rid", "left").join(ends.hint("merge"), "rid", "left")
    return marked.select(*wide, "runs", "more").mapInArrow(_settled(finish), schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
