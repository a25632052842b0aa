"""Token ids in files of canonical, length-limited Huffman codes.

A file holds documents in ascending key order:

    magic "WHUF1\0", u8 longest code, u32 number of symbols,
    per symbol: u32 id, u8 code length   (sorted by length, then id: canonical)
    blocks, each: u32 documents, u32 ids, u32 payload bytes, u32 checkpoints,
                  per document: i64 key, u8 key is null, u32 ids
                  per checkpoint: u16 bits that the last STEP ids took
                  payload: the codes, most significant bit first

Blocks are independent. Within one, every STEP ids a checkpoint tells the bit
at which decoding can start, so a block is decoded in as many lanes at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import parallel_range, scratch, stage, table
from waymark.llm.files import reading, writing
from waymark.llm.tokens import Encoder, batches, default_path

MAGIC = b"WHUF1\0"
STEP = 64
BLOCK_IDS = 1 << 18
FILE_BYTES = 64 << 20
LONGEST = 16


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code none of whose words is above ``longest`` bits (package-merge)."""
    n = len(counts)
    if n == 1:
        return np.ones(1, dtype=np.int64)
    longest = max(longest, int(np.ceil(np.log2(max(n, 2)))))
    order = np.argsort(counts, kind="stable")
    single = counts[order].astype(np.int64)
    # In each round, items and the pairs of the round before are merged; those among the first 2n-2 count.
    levels, pairs = [], np.zeros(0, dtype=np.int64)
    for _ in range(longest):
        weight = np.concatenate([single, pairs])
        by = np.argsort(weight, kind="stable")
        levels.append(by < n)
        weight = weight[by]
        m = len(weight) // 2
        pairs = weight[: 2 * m : 2] + weight[1 : 2 * m : 2]
    lengths = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for is_single in reversed(levels):
        k = int(is_single[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.zeros(n, dtype=np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, lengths and codes in canonical order."""
    if not len(ids):
        return ids, lengths, lengths
    by = np.lexsort((ids, lengths))
    ids, lengths = ids[by], lengths[by]
    room = np.left_shift(np.int64(1), lengths.max() - lengths)
    codes = np.concatenate([[0], np.cumsum(room)[:-1]]) >> (lengths.max() - lengths)
    return ids, lengths, codes


class Book:
    """A code: arrays over all ids for encoding, a table over all bit patterns for decoding."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths, codes = canonical(ids.astype(np.int64), lengths.astype(np.int64))
        top = int(self.ids.max()) + 1 if len(self.ids) else 1
        self.code, self.size = np.zeros(top, dtype=np.uint64), np.zeros(top, dtype=np.int64)
        self.code[self.ids], self.size[self.ids] = codes.astype(np.uint64), self.lengths
        self.longest = int(self.lengths.max()) if len(self.lengths) else 1
        if self.longest > 24:
            raise ValueError("codes above 24 bits aren't supported")
        room = np.left_shift(np.int64(1), self.longest - self.lengths)
        self.symbol = np.repeat(self.ids, room).astype(np.uint32)
        self.bits = np.repeat(self.lengths, room)

    def header(self) -> bytes:
        table = np.zeros(len(self.ids), dtype=[("id", "<u4"), ("n", "u1")])
        table["id"], table["n"] = self.ids, self.lengths
        return MAGIC + struct.pack("<BI", self.longest, len(self.ids)) + table.tobytes()

    @classmethod
    def read(cls, stream) -> "Book":
        if stream.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a file of Huffman codes")
        longest, n = struct.unpack("<BI", exactly(stream, 5))
        table = np.frombuffer(exactly(stream, 5 * n), dtype=[("id", "<u4"), ("n", "u1")])
        book = cls(table["id"], table["n"])
        if n and book.longest != longest:
            raise ValueError("the header's code lengths disagree")
        return book

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes of ``ids``, and the bits of every STEP of them."""
        sizes = self.size[ids]
        if len(ids) and not sizes.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ids) else 0
        out = np.zeros(total // 32 + 2, dtype=np.uint64)
        starts = ends - sizes
        word, room = starts >> 5, (np.int64(64) - (starts & 31) - sizes).astype(np.uint64)
        value = self.code[ids] << room  # within the 64 bits that begin at word * 32
        np.bitwise_or.at(out, word, value >> np.uint64(32))
        np.bitwise_or.at(out, word + 1, value & np.uint64(0xFFFFFFFF))
        steps = np.diff(np.concatenate([[0], ends[STEP - 1 :: STEP]]))
        return out.astype(">u4").tobytes()[: (total + 7) // 8], steps.astype("<u2")

    def decode(self, payload: bytes, n: int, steps: np.ndarray) -> np.ndarray:
        """``n`` ids, in lanes that begin at the checkpoints."""
        lanes = -(-n // STEP)
        at = np.concatenate([[0], np.cumsum(steps.astype(np.int64))])[:lanes]
        data = np.frombuffer(payload + bytes(8), dtype=np.uint8)
        wide = np.zeros(len(data) - 3, dtype=np.uint32)
        for i in range(4):
            wide = (wide << np.uint32(8)) | data[i : i + len(wide)]
        out = np.zeros((STEP, lanes), dtype=np.uint32)
        for k in range(min(STEP, n)):
            if k and n - (lanes - 1) * STEP <= k and lanes == len(at):
                at = at[: lanes - 1]
            shift = (32 - self.longest - (at & 7)).astype(np.uint32)
            pattern = (wide[at >> 3] >> shift) & np.uint32((1 << self.longest) - 1)
            out[k, : len(at)] = self.symbol[pattern]
            at = at + self.bits[pattern]
        return out.T.reshape(-1)[:n]


def exactly(stream, n: int) -> bytes:
    got = stream.read(n)
    if len(got) != n:
        raise ValueError("the file ends too early")
    return got


def write_block(book: Book, keys: list, parts: list[np.ndarray]) -> bytes:
    ids = np.concatenate(parts)
    payload, steps = book.encode(ids)
    rows = np.zeros(len(keys), dtype=[("key", "<i8"), ("null", "u1"), ("n", "<u4")])
    rows["key"], rows["null"], rows["n"] = [k or 0 for k in keys], [k is None for k in keys], [len(p) for p in parts]
    return struct.pack("<4I", len(keys), len(ids), len(payload), len(steps)) + rows.tobytes() + steps.tobytes() + payload


def read_blocks(stream) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """keys, ids of each, and all ids, block by block."""
    book = Book.read(stream)
    while head := stream.read(16):
        if len(head) != 16:
            raise ValueError("the file ends too early")
        docs, n, size, marks = struct.unpack("<4I", head)
        rows = np.frombuffer(exactly(stream, 13 * docs), dtype=[("key", "<i8"), ("null", "u1"), ("n", "<u4")])
        steps = np.frombuffer(exactly(stream, 2 * marks), dtype="<u2")
        if rows["n"].sum() != n:
            raise ValueError("a block's lengths disagree")
        ids = book.decode(exactly(stream, size), n, steps)
        yield [None if x else int(k) for k, x in zip(rows["key"], rows["null"])], rows["n"].astype(np.int64), ids


def encode_documents(docs: DataFrame, key: str, path: str, end_id: int) -> DataFrame:
    """key, ids (little-endian u16, or u32 if any needs it, with ``end_id``), wide."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in rows:
            for a, b, texts in batches(batch, "text"):
                ids, at = encoder.encode(texts)
                wide = bool(len(ids)) and int(ids.max()) > 0xFFFF or end_id > 0xFFFF
                kind = "<u4" if wide else "<u2"
                end, ids = np.array([end_id], dtype=kind).tobytes(), memoryview(ids.astype(kind).tobytes())
                k = int(kind[2])
                data = [b"".join((ids[k * x : k * y], end)) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(data, pa.binary()), pa.array([wide] * len(data))], ["key", "ids", "wide"])

    return docs.select(key, "text").mapInArrow(run, "key long, ids binary, wide boolean")


def id_counts(encoded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All ids that occur and how often; no more of them than the vocabulary has."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in rows:
            for wide, kind in ((False, "<u2"), (True, "<u4")):
                n = np.bincount(np.frombuffer(b"".join(x for x, w in zip(*(c.to_pylist() for c in batch.columns)) if w == wide), dtype=kind))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), dtype=np.int64)])
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    got = encoded.select("ids", "wide").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return got["id"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def write_files(encoded: DataFrame, book: Book, folder: str, parts: int) -> list[int]:
    """Files part-00000.huf ... in ascending key order; the ids in each."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        with writing(f"{folder}/part-{part:05d}.huf") as out:
            out.write(book.header())
            keys, ids, n = [], [], 0
            for batch in rows:
                for key, data, wide in zip(*(c.to_pylist() for c in batch.columns)):
                    one = np.frombuffer(data, dtype="<u4" if wide else "<u2").astype(np.uint32)
                    keys.append(key)
                    ids.append(one)
                    n += len(one)
                    if n >= BLOCK_IDS:
                        out.write(write_block(book, keys, ids))
                        keys, ids, total, n = [], [], total + n, 0
            if keys:
                out.write(write_block(book, keys, ids))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total + n], pa.int64())], ["part", "n"])

    ranged = encoded.repartitionByRange(parts, F.col("key").asc_nulls_last()).sortWithinPartitions(F.col("key").asc_nulls_last(), "ids")
    got = {r["part"]: r["n"] for r in ranged.select("key", "ids", "wide").mapInArrow(run, "part long, n long").collect()}
    return [got.get(i, -1) for i in range(max(got, default=-1) + 1)]


def read_files(spark: SparkSession, folder: str, ids_in: list[int]) -> DataFrame:
    """key, start, n_tokens, ids_crc32, from the files alone but for each file's number of ids."""
    before = np.concatenate([[0], np.cumsum(np.maximum(ids_in, 0))]).tolist()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in rows for p in batch.column(0).to_pylist()):
            if ids_in[part] < 0:
                continue
            start = before[part]
            with reading(f"{folder}/part-{part:05d}.huf") as stream:
                for keys, n, ids in read_blocks(stream):
                    ends = np.cumsum(n)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])
            if start != before[part] + ids_in[part]:
                raise ValueError(f"part {part} has lost ids")

    return parallel_range(spark, len(ids_in)).mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def store(spark: SparkSession, docs: DataFrame, folder: str, key: str = "doc_id", path: str | None = None, end_id: int = 2) -> list[int]:
    """Write the ids of all ``docs`` to files in ``folder``; returns the ids in each file.

    Null texts are empty, so their only id is ``end_id``. Rows with equal keys
    stand next to each other in the order of their ids; null keys come last.
    No rows give one file without blocks, or none.
    """
    encoded = stage(spark, encode_documents(docs, key, path or default_path(), end_id), "ids")
    ids, counts = id_counts(encoded)
    book = Book(ids, code_lengths(counts) if len(ids) else counts)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(2 * counts.sum() // FILE_BYTES) + 1)
    return write_files(encoded, book, folder, parts)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "huffman")
    written = store(spark, table(spark, sf_dir, "documents"), folder)
    return read_files(spark, folder, written).withColumnRenamed("key", "doc_id")
