"""Hierarchical multi-length packing.

Documents are encoded, cut into full windows as far as they fill them, and what remains is routed to a tier by its
length. Tiers are packed from the longest to the shortest: the longest piece opens a window of its tier, gaps are filled
by the longest shorter pieces that fit, and the last gap by the head of a shorter piece, whose tail goes back to the
pool. So every window but the last of a run is full; windows of the shorter tiers are powers of two and need no padding.
Sequences of one tier form step groups of equal token counts; a task's groups go on over its runs, so all but the last of
each tier are full.

Each task packs its own documents (no shuffle); a run is at most `bpe.STEP_BYTES` of text, so memory is bounded.

Edge cases: a null or empty text is the single end id; a null doc_id gives rows with a null doc_id; repeated rows are
packed each; texts of any length are cut; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .bpe import default_tokenizer, encoder, steps
from .common import byte_slices, settle, small_batches

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
#: The id after each document.
END_ID = 1
#: Full-length windows that a step group holds the tokens of.
STEP_WINDOWS = 64
#: Bytes of text encoded at a time; a run is packed whole.
ENCODED_BYTES = 1 << 20

SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group")]
)


class Pool:
    """Pieces by length; the longest that fits is found from a bit set of the lengths present."""

    def __init__(self):
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.present = 0

    def add(self, length: int, doc: int, start: int) -> None:
        self.by.setdefault(length, []).append((doc, start))
        self.present |= 1 << length

    def longest(self, most: int) -> int:
        """The greatest length up to `most`, or 0."""
        return max(0, (self.present & ((2 << most) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.present & -self.present).bit_length() - 1

    def take(self, length: int) -> tuple[int, int]:
        items = self.by[length]
        got = items.pop()
        if not items:
            self.present &= ~(1 << length)
        return got


def pack(lengths, window: int = WINDOW, tiers=TIERS):
    """Pieces (document, start, length, sequence, offset) and each sequence's window, for documents of these lengths."""
    pieces: list[tuple[int, int, int, int, int]] = []
    windows: list[int] = []
    pool = Pool()
    for d, n in enumerate(lengths):
        n = int(n)
        for at in range(0, n - n % window, window):
            pieces.append((d, at, window, len(windows), 0))
            windows.append(window)
        if n % window:
            pool.add(n % window, d, n - n % window)
    lower = 0
    bounds = []
    for t in sorted(tiers):
        bounds.append((t, lower))
        lower = t
    for tier, least in reversed(bounds):
        while (length := pool.longest(tier)) > least:
            seq, at = len(windows), 0
            windows.append(tier)
            while length:
                doc, start = pool.take(length)
                used = min(length, tier - at)
                pieces.append((doc, start, used, seq, at))
                if used < length:
                    pool.add(length - used, doc, start + used)
                at += used
                gap = tier - at
                length = (pool.longest(gap) or (pool.shortest() if pool.present else 0)) if gap else 0
    return pieces, windows


class StepGroups:
    """Numbers of step groups: sequences of one tier in a row, as many as hold `tokens` tokens.

    Open groups go on from run to run, so a task leaves at most one part-filled group for each tier.
    """

    def __init__(self, tokens: int):
        self.tokens, self.open, self.n = tokens, {}, 0

    def add(self, windows: list[int]) -> list[int]:
        out = []
        for w in windows:
            group, left = self.open.get(w, (0, 0))
            if not left:
                group, left, self.n = self.n, max(1, self.tokens // w), self.n + 1
            self.open[w] = (group, left - 1)
            out.append(group)
        return out


def _closed(enc, text: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each with its end, and how many each has; encoded in parts, of which only the ids are kept."""
    ids, sizes = [], []
    for at, end in byte_slices(text, ENCODED_BYTES):
        got, offsets = enc.batch(text.slice(at, end - at))
        n = np.diff(offsets) + 1
        inside = np.ones(len(got) + len(n), bool)
        inside[np.cumsum(n) - 1] = False
        part = np.full(len(inside), end_id, np.uint32)
        part[inside] = got
        ids.append(part)
        sizes.append(n)
        del got, offsets, inside
        settle()
    return np.concatenate(ids), np.concatenate(sizes)


def packed(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, tiers=TIERS, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence."""
    path = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        n_seq, groups_of = 0, StepGroups(STEP_WINDOWS * window)
        with encoder(path, "merges") as enc:
            for doc_id, text in steps(batches):
                closed, sizes = _closed(enc, text, end_id)
                begin = np.concatenate([[0], np.cumsum(sizes)])
                pieces, windows = pack(sizes, window, tiers)
                groups = np.array(groups_of.add(windows), np.int64)
                doc, start, length, seq, at = np.array(pieces, np.int64).reshape(-1, 5).T
                first = begin[doc] + start
                raw = closed.astype("<u4", copy=False)
                crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(first, first + length)), np.int64, len(first))
                columns = [doc_id.take(pa.array(doc)), start, length, crc, sizes[doc], base + n_seq + seq, at, np.array(windows, np.int64)[seq], base + groups[seq]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], SCHEMA.names)
                n_seq += len(windows)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
