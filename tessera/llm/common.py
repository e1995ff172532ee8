"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go when the session names no shared folder and runs in one process (tests).
LOCAL_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; set only where it is unset, which a cluster's session must not leave it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SHARED
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Stored:
    """A table written to the shared folder: cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        small_batches(self.spark)
        self.path = f"{shared_dir(self.spark)}/tessera-{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def n_parts(spark: SparkSession) -> int:
    """Partitions of a shuffle; the session sizes them to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_rid(df: DataFrame, name: str = "rid") -> DataFrame:
    """A row number that repeats exactly for the same input files, so that null and repeated doc_ids stay apart."""
    return df.withColumn(name, F.monotonically_increasing_id())


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until it is none of the table's columns (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of an Arrow batch: batches of whole texts are held by the JVM and by a Python worker at once.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sets the rows of an Arrow batch, where the session has left Spark's default."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def settle() -> None:
    """Gives memory that a worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def crc_mod(col: str, mod: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def text_column(batch, name: str = "text") -> pa.Array:
    """The column as large strings without nulls."""
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def byte_slices(text: pa.Array, most: int = 2 << 20, rows: int = 4096):
    """(first row, end) of consecutive texts of bounded bytes and number; a longer text is a slice of its own."""
    size = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False)) if len(text) else np.zeros(0)
    at = 0
    while at < len(text):
        before = size[at - 1] if at else 0
        end = min(max(at + 1, int(np.searchsorted(size, before + most, side="right"))), at + rows)
        yield at, end
        at = end
    settle()


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+` of all texts in a row, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    cum = np.concatenate([[0], np.cumsum(full)])
    counts = cum[offsets[1:]] - cum[offsets[:-1]]
    return flat.filter(pa.array(full)), counts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE_VALUES = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407))
_INVERSE = tuple(np.uint64(pow(int(r), -1, 2**64)) for r in _RADIX)


class Rolling:
    """Prefix sums of a polynomial over bytes modulo 2^64: the hash of any substring in constant time.

    The multiplier is odd, hence invertible, and bytes are replaced by random 64-bit values.
    """

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        self.which = which
        powers = np.full(n + 1, _RADIX[which], np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * powers[:n], out=self.sums[1:])
        self.inverse = None
        self.n = n

    def window(self, start: np.ndarray, length) -> np.ndarray:
        if self.inverse is None:
            self.inverse = np.full(self.n + 1, _INVERSE[self.which], np.uint64)
            self.inverse[0] = 1
            np.multiply.accumulate(self.inverse, out=self.inverse)
        raw = self.sums[start + length] - self.sums[start]
        return mix64(raw * self.inverse[start] + np.asarray(length).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    encoded = words.dictionary_encode()
    d = encoded.dictionary.cast(pa.large_binary())
    if len(d) == 0:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(d.buffers()[1], np.int64, len(d) + 1, d.offset * 8)
    data = np.frombuffer(d.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if d.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    h = Rolling(data, seed).window(offsets[:-1], np.diff(offsets))
    return h[encoded.indices.to_numpy()]


def spans_of(counts: np.ndarray) -> np.ndarray:
    """Offsets from counts."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
