"""Token counts and ids by a public byte-level BPE, in Arrow batches.

A text is cut at safe boundaries, where the tokenizer's word pattern ends one
word and begins the next whatever surrounds it: before a space that a visible
character follows, around a line end between visible characters, and between a
letter and a punctuation mark. So the pieces' tokens are the text's tokens. A run
that has none of these (letters of a script without spaces, a long number) is one word to the tokenizer
as well, so it is one piece whatever its length: 600 kB of it take 0.6 s and some 110 MB.
Short pieces are recognised with array operations in a table of fixed size; only
those not in it are encoded. The boundaries are those of the byte-level
word pattern; tokenizers with another one are refused.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import mix, offsets_of, table, text_chunks

#: Texts worked on at a time, in bytes.
BATCH_BYTES = 4 << 20
#: Slots of the table of pieces, each of up to 16 bytes; ids that it holds before it is emptied.
SLOTS, HELD_IDS = 1 << 21, 1 << 24

_B = np.arange(256)
#: First bytes of a visible character (those that may begin other white space aren't among them).
VISIBLE = ((_B >= 0x21) & (_B <= 0x7E)) | ((_B >= 0xC3) & (_B <= 0xE0)) | ((_B >= 0xE4) & (_B <= 0xF4))
ASCII_VISIBLE = (_B >= 0x21) & (_B <= 0x7E)
LETTER = ((_B >= 0x41) & (_B <= 0x5A)) | ((_B >= 0x61) & (_B <= 0x7A))
PUNCTUATION = np.isin(_B, list(b",.;:!?#$%&*"))
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_open: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts that begin at ``bounds[:-1]``."""
    n = len(data)
    begins = np.zeros(n + 1, dtype=bool)
    begins[bounds] = True
    first = begins[:n].copy()
    seen = VISIBLE[data] & ~first  # not the first of a text, so what precedes it is of the same text
    if n > 1:
        begins[: n - 1] |= (data[:-1] == 0x20) & seen[1:]
        begins[1:n] |= LETTER[data[:-1]] & PUNCTUATION[data[1:]]
    if n > 2:
        line = (data[1:-1] == 0x0A) & ~first[1:-1] & ASCII_VISIBLE[data[:-2]] & seen[2:]
        begins[1 : n - 1] |= line
        begins[2:n] |= line
    return np.flatnonzero(begins[:n])


class Encoder:
    """The tokens of texts, piece by piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        shape = json.loads(self.tokenizer.to_str())
        words = shape.get("pre_tokenizer") or {}
        if (words.get("type"), words.get("use_regex", True), words.get("add_prefix_space"), shape.get("normalizer")) != ("ByteLevel", True, False, None):
            raise ValueError("pieces are cut for the byte-level word pattern, without a normaliser or a prefix space")
        for token in self.tokenizer.get_added_tokens_decoder().values():
            data = np.frombuffer(token.content.encode(), dtype=np.uint8)
            if len(cut(data, np.array([0, len(data)]))) > 1:
                raise ValueError(f"{token.content!r} holds a boundary that isn't safe")
        self._empty()

    def _empty(self) -> None:
        self.a, self.b = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.uint64)
        self.size = np.zeros(SLOTS, dtype=np.uint8)
        self.n, self.at = np.zeros(SLOTS, dtype=np.int32), np.zeros(SLOTS, dtype=np.int64)
        self.pool, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _open:
            _open[path] = cls(path)
        return _open[path]

    def _store(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode; put the ids in the pool; their numbers and places."""
        counts, parts = [], []
        for i in range(0, len(texts), 4096):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False):
                parts.append(np.array(e.ids, dtype=np.uint32))
                counts.append(len(parts[-1]))
        n = np.array(counts, dtype=np.int64)
        total = int(n.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * total + 1024, dtype=np.uint32)])
        at = self.used + np.cumsum(n) - n
        if parts:
            self.pool[self.used : self.used + total] = np.concatenate(parts)
        self.used += total
        return n, at

    def _pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number and place of the ids of each piece, and the first piece of each text."""
        if self.used > HELD_IDS:
            self._empty()
        offsets = offsets_of(column)
        size = int(offsets[-1] - offsets[0])
        bounds = offsets - offsets[0]
        raw = np.zeros(size + 16, dtype=np.uint8)
        if size:
            raw[:size] = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        starts = cut(raw[:size], bounds)
        ends = np.append(starts[1:], size)
        length = ends - starts
        wide = np.ndarray(shape=(size + 9,), dtype="<u8", buffer=raw.data, strides=(1,))
        a = wide[starts] & _MASKS[np.minimum(length, 8)]
        b = np.where(length > 8, wide[np.maximum(ends - 8, 0)], np.uint64(0))
        h = mix(a * _K[0] + b * _K[1] + length.astype(np.uint64) * _K[2])
        slot = (h >> np.uint64(43)).astype(np.int64) & (SLOTS - 1)
        short = length <= 16
        known = short & (self.a[slot] == a) & (self.b[slot] == b) & (self.size[slot] == length)
        n, at = np.where(known, self.n[slot], 0).astype(np.int64), np.where(known, self.at[slot], 0)
        missing = np.flatnonzero(~known)
        if len(missing):
            text = raw[:size].tobytes()
            # Equal hashes stand for one piece if the pieces are the same 16 bytes; others are encoded one by one.
            _, one, which = np.unique(np.where(short[missing], h[missing], missing.astype(np.uint64)), return_index=True, return_inverse=True)
            one = missing[one]
            same = (a[one[which]] == a[missing]) & (b[one[which]] == b[missing]) & (length[one[which]] == length[missing]) & (short[missing] == short[one[which]])
            n_one, at_one = self._store([text[x:y].decode() for x, y in zip(starts[one].tolist(), ends[one].tolist())])
            n[missing], at[missing] = n_one[which], at_one[which]
            if not same.all():
                odd = missing[~same]
                n[odd], at[odd] = self._store([text[x:y].decode() for x, y in zip(starts[odd].tolist(), ends[odd].tolist())])
            keep = one[short[one]]
            s = slot[keep]
            self.a[s], self.b[s], self.size[s], self.n[s], self.at[s] = a[keep], b[keep], length[keep], n[keep], at[keep]
            # Where two pieces share a slot, the arrays hold the last of them in each.
        return n, at, np.searchsorted(starts, bounds)

    def count(self, column: pa.Array) -> np.ndarray:
        n, _, first = self._pieces(column)
        sums = np.concatenate([[0], np.cumsum(n)])
        return sums[first[1:]] - sums[first[:-1]]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each begin and end."""
        n, at, first = self._pieces(column)
        sums = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(at - sums[:-1], n) + np.arange(sums[-1])]
        return ids, sums[first]


def batches(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, pa.Array]]:
    """Row ranges of ``batch`` balanced by bytes, with their texts (null: empty)."""
    text = batch.column(batch.schema.get_field_index(column))
    text = text.fill_null("") if text.null_count else text
    for a, b in text_chunks(text, BATCH_BYTES):
        yield a, b, text.slice(a, b - a)


def token_counts(docs: DataFrame, key: str = "doc_id", path: str | None = None, limit: int = 1024) -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit of every row; lengths only leave the workers.

    Null texts are empty and have 0 tokens; repeated rows are counted each;
    other columns aren't read; an empty table gives no rows.
    """
    path = path or default_path()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in rows:
            for a, b, texts in batches(batch, "text"):
                n = encoder.count(texts)
                size = pa.array(np.diff(offsets_of(texts)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), size, pa.array(n), pa.array(n > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, "text").mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("key", key)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
