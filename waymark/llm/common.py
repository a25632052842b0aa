"""Shared helpers: scratch tables, words as numpy arrays, fixed-size key bitmaps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in runs of about this many bytes, which bounds the arrays.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the one of ``spark.checkpoint.dir``; only where that is
    unset and all runs on one machine (tests) a temporary folder is made and
    remembered. On a cluster that is an error: executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage."""
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallel_range(spark: SparkSession, n: int) -> DataFrame:
    """Ids 0 to n-1, one in each partition."""
    return spark.range(0, n, 1, max(1, n))


# --- words ------------------------------------------------------------------

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of a lower-cased word: digits, a-z, and all of a non-ASCII character.
IS_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = []
GRAM_KEYS = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        made = [np.full(size, b, dtype=np.uint64) for b in (_BASE, _BASE_INV)]
        for m in made:
            m[0] = 1
            np.multiply.accumulate(m, out=m)
        if n > 4 * CHUNK_BYTES:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = offsets_of(column)
    at, n = 0, len(column)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def offsets_of(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


class Words:
    """The words of a run of texts: ``starts``/``ends`` in ``data`` (lower-cased
    bytes), 64-bit ``hashes``, and ``first[i]:first[i+1]`` are those of text i."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("") if column.null_count else column
        offsets = offsets_of(column)
        base = int(offsets[0])
        n_bytes = int(offsets[-1]) - base
        raw = column.buffers()[2]
        raw = np.frombuffer(raw, dtype=np.uint8)[base : base + n_bytes] if raw is not None and n_bytes else np.zeros(0, np.uint8)
        self.data = LOWER[raw]
        self.bounds = offsets - base
        word = IS_WORD[self.data]
        before, after = np.empty_like(word), np.empty_like(word)
        if n_bytes:
            before[0], before[1:] = False, word[:-1]
            after[-1], after[:-1] = False, word[1:]
            cuts = self.bounds[1:-1]
            before[cuts[cuts < n_bytes]] = False
            after[cuts[cuts > 0] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        up, down = powers(n_bytes + 1)
        sums = np.zeros(n_bytes + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * up[:n_bytes], dtype=np.uint64, out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def doc_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, k: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every k consecutive words of one text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(doc[: n] == doc[k - 1 :]) if k > 1 else np.arange(n)
        total = np.full(len(at), np.uint64(k) * GRAM_KEYS[63], dtype=np.uint64)
        for i in range(k):
            total += self.hashes[at + i] * GRAM_KEYS[i]
        return at, mix(total)

    def joined(self, a: int, b: int) -> str:
        """Words a to b-1, one space between."""
        if a >= b:
            return ""
        d = self.data
        return b" ".join(d[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b])).decode()


# --- key bitmaps ------------------------------------------------------------

def key_bitmap(df: DataFrame, key: str, bits: int = 22) -> np.ndarray:
    """A bitmap of ``2**bits`` cells with those of the 64-bit keys set.

    Its size is fixed (0.5 MB for 22 bits), whatever the number of keys, so it
    may be broadcast; a set cell only lets a row through to an exact join.
    """
    cell = F.shiftrightunsigned(F.col(key), 64 - bits)
    words = (
        df.where(F.col(key).isNotNull())
        .select(F.shiftright(cell, 6).alias("w"), (cell % 64).cast("int").alias("bit"))
        .groupBy("w")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("v"))
    )
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    got = words.toPandas()
    if len(got):
        out[got["w"].to_numpy(dtype=np.int64)] = got["v"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = int(np.log2(len(bitmap) * 64))
    cell = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1
