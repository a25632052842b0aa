"""Records of large JSON values, read by many tasks.

A value of many gigabytes is one line at worst. The text source splits files at
any separator, so ``}`` is taken: a task's block then begins after a ``}``, and all
that is unknown there is whether this is within a string, and how deep. A first
pass finds for either case what a block does to both; running over
the blocks of a file, a row each, gives every block its true beginning. A second pass
cuts the records out; one that crosses blocks is put together from its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators.graph import written

_QUOTE, _BACK, _OPEN, _CLOSE = ord('"'), ord("\\"), (ord("{"), ord("[")), (ord("}"), ord("]"))
_PIECES = "file string, block long, nth long, begins boolean, ends boolean, known boolean, key string, text string"
_STATES = "file string, block long, flips boolean, depth_out long, depth_in long, first string"


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: quotes that open or close strings up to and with it, and +1 or -1 where it is a bracket (strings or not)."""
    back = data == _BACK
    quote = data == _QUOTE
    if back.any():  # a quote behind an odd run of backslashes is text
        at = np.arange(len(data))
        start = np.maximum.accumulate(np.where(~back, at, -1))
        run = np.concatenate([[0], (at - start)[:-1]])
        quote &= run % 2 == 0
    step = np.isin(data, _OPEN).astype(np.int64) - np.isin(data, _CLOSE)
    return np.cumsum(quote), step


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """((file, block), rows of it, whether the last ones) as they come."""
    held = None
    for b in batches:
        files, blocks = b.column("file").to_pylist(), b.column("block").to_numpy(zero_copy_only=False)
        keys = list(zip(files, blocks.tolist()))
        edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)] if keys else [0]
        for a, z in zip(edges, edges[1:]):
            if held is not None:
                yield *held, held[0] != keys[a]
            held = (keys[a], b.slice(a, z - a))
    if held is not None:
        yield *held, True


def _bytes(rows: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"}".join([*rows.column("value").to_pylist(), b""]), dtype=np.uint8)


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: whether it flips in and out of strings, its change of depth if it begins outside or inside one, and its first byte."""
    parity, outside, inside, first = 0, 0, 0, None
    for key, rows, last in _runs(batches):
        data = _bytes(rows)
        quotes, step = _marks(data)
        odd = (quotes + parity) % 2 == 1
        outside, inside = outside + int(step[~odd].sum()), inside + int(step[odd].sum())
        parity = (parity + int(quotes[-1])) % 2
        if first is None:
            first = next((chr(c) for c in data[:65536] if c not in b" \t\r\n\xef\xbb\xbf"), None)
        if last:
            yield pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "flips": bool(parity), "depth_out": outside, "depth_in": inside, "first": first}], schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("flips", pa.bool_()), ("depth_out", pa.int64()), ("depth_in", pa.int64()), ("first", pa.string())]))
            parity, outside, inside, first = 0, 0, 0, None


def _key_before(data: np.ndarray, at: int) -> str:
    """The key of the value that begins at ``at``."""
    head = data[max(0, at - 256) : at].tobytes().decode(errors="replace")
    return head.rpartition(":")[0].rstrip().rstrip('"').rpartition('"')[2]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of blocks, and pieces of those that begin or end elsewhere; at last a row with the key that is open at the block's end."""
    now, nth = None, 0
    for key, rows, last in _runs(batches):
        if now is None:
            level = rows.column("level")[0].as_py()  # the depth that records stand at
            parity, depth = int(rows.column("inside")[0].as_py()), rows.column("depth")[0].as_py()
            now, known, kept, begun, out_key, nth = key, False, [], depth <= level, None, 0
        data = _bytes(rows)
        quotes, step = _marks(data)
        step = np.where((quotes + parity) % 2 == 0, step, 0)
        after = depth + np.cumsum(step)
        events = np.flatnonzero(step)
        before = after[events] - step[events]
        tops = events[(before == 1) & (step[events] > 0)] if level == 2 else events[:0]
        keys = [_key_before(data, int(t)) for t in tops]
        starts = set(events[(before == level) & (step[events] > 0) & (data[events] == _OPEN[0])].tolist())
        ends = set(events[(after[events] == level) & (step[events] < 0) & (data[events] == _CLOSE[0])].tolist())
        marks = dict(zip(tops.tolist(), keys))
        out, at, open_ = [], 0, bool(kept) or not begun
        for spot in sorted([*starts, *ends, *marks]):
            if spot in marks:
                known, out_key = True, marks[spot]
            elif spot in starts:
                at, open_, kept, begun = spot, True, [], True
            elif open_:
                kept.append(data[at : spot + 1].tobytes())
                out.append((nth, begun, True, known, out_key, b"".join(kept).decode(errors="replace")))
                nth, kept, open_, begun = nth + 1, [], False, True
        if open_:
            kept.append(data[at:].tobytes())
        parity, depth = (parity + int(quotes[-1])) % 2, int(after[-1])
        if last:
            if open_:
                out.append((nth, begun, False, known, out_key, b"".join(kept).decode(errors="replace")))
            out.append((1 << 40, True, True, known, out_key, None))
        if out:
            cols = list(zip(*out))
            types = (pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(out)), pa.array([now[1]] * len(out), pa.int64()), *[pa.array(list(c), t) for c, t in zip(cols, types)]], names=["file", "block", "nth", "begins", "ends", "known", "key", "text"])
        if last:
            now = None


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where it starts), value: what stands before each ``}``, in order within a block."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def json_records(spark: SparkSession, path: str, key: str) -> DataFrame:
    """file and text of the objects in the top arrays of JSON files, or in the arrays under ``key`` of their top objects.

    A file may hold several values after each other; all begin as the first does. Other
    keys of top objects are passed over. A row of what is collected for each block goes through a
    window; of records, only those that cross blocks.
    """
    read = _blocks(spark, path)
    states = read.mapInArrow(_states, _STATES)
    order = Window.partitionBy("file").orderBy("block")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.coalesce(F.sum(F.col("flips").cast("int")).over(upto), F.lit(0)) % 2 == 1
    states = states.withColumn("inside", flips).withColumn("change", F.when(F.col("inside"), F.col("depth_in")).otherwise(F.col("depth_out")))
    depth = F.coalesce(F.sum("change").over(upto), F.lit(0))
    level = F.when(F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == "{", 2).otherwise(1)
    begin = states.select(F.col("file").alias("file_"), F.col("block").alias("block_"), "inside", depth.alias("depth"), level.alias("level"))
    # A broadcast keeps the rows of blocks in their order; it holds a row for each block of some 128 MB.
    both = read.join(F.broadcast(begin), (F.col("file") == F.col("file_")) & (F.col("block") == F.col("block_")))
    pieces = written(spark, both.select("file", "block", "inside", "depth", "level", "value").mapInArrow(_cut, _PIECES), "json-pieces")
    ends = pieces.where(F.col("text").isNull())
    entry = ends.select(F.col("file").alias("file_"), F.col("block").alias("block_"), F.last(F.when(F.col("known"), F.col("key")), ignorenulls=True).over(upto).alias("entry"))
    keyed = pieces.where(F.col("text").isNotNull()).join(entry, (F.col("file") == F.col("file_")) & (F.col("block") == F.col("block_")))
    keyed = keyed.withColumn("key", F.when(F.col("known"), F.col("key")).otherwise(F.col("entry"))).drop("entry", "file_", "block_")
    whole = keyed.where("begins and ends").select("file", "key", "text")
    # Pieces: a record's first one begins it, so the count of beginnings tells records apart.
    parts = keyed.where("not (begins and ends)")
    line = Window.partitionBy("file").orderBy("block", "nth")
    parts = parts.withColumn("record", F.sum(F.col("begins").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    joined = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "nth", "key", "ends", "text"))).alias("p"))
    n = F.array_position(F.transform("p", lambda x: x["ends"]), True)  # nothing behind a record's end belongs to it
    joined = joined.where((F.col("record") > 0) & (n > 0)).select("file", F.get("p", F.lit(0))["key"].alias("key"), F.array_join(F.transform(F.slice("p", 1, n.cast("int")), lambda x: x["text"]), "").alias("text"))
    return whole.unionByName(joined).where(F.col("key").isNull() | (F.col("key") == key)).select("file", "text")
