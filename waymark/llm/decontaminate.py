"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``size`` consecutive words (a shorter
item is one window). A window is a set of word shingles with their positions.
Since a window has to be contained whole, one shingle is a sufficient prefix:
the rarest by its count over all documents. Documents are joined with windows
on that shingle; its position bounds where the window can begin and end; the
words there are then compared exactly.

Documents are read twice, as arrays of word hashes: to count the windows'
shingles, and to find the places of the chosen ones. Both times a bitmap of
fixed size decides what leaves the task, so the shuffles carry only shingles of
the benchmark. Both sides of each join may be large; Spark picks the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import Words, in_bitmap, key_bitmap, stage, table, text_chunks

SIZE = 10
SHINGLE = 3


def runs_of(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, Words]]:
    column = batch.column(at)
    column = column.fill_null("") if column.null_count else column
    for a, b in text_chunks(column):
        yield a, b, Words(column.slice(a, b - a))


def item_windows(items: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """item_id (as string), win, n, offsets and hashes of the window's shingles."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b, words in runs_of(batch, 1):
                doc = words.doc_of()
                grams = {k: dict(zip(*(x.tolist() for x in words.grams(k, doc)))) for k in range(1, shingle + 1)}
                for i in range(b - a):
                    first, end = int(words.first[i]), int(words.first[i + 1])
                    n = min(size, end - first)
                    out: list[list] = [[], [], [], []]
                    for s in range(first, end - n + 1) if n else ():
                        k = min(shingle, n)
                        out[0].append(words.joined(s, s + n))
                        out[1].append(n)
                        out[2].append(list(range(n - k + 1)))
                        out[3].append([grams[k][s + o] for o in range(n - k + 1)])
                    hashes = [np.array(x, dtype=np.uint64).view(np.int64).tolist() for x in out[3]]
                    who = pa.array([batch.column(0)[a + i].as_py()] * len(out[0]), pa.string())
                    yield pa.RecordBatch.from_arrays([who, pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))], ["item_id", "win", "n", "offsets", "hashes"])

    schema = "item_id string, win string, n int, offsets array<int>, hashes array<long>"
    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(run, schema)


def shingle_counts(docs: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """h, count over all documents, of shingles that the bitmap lets through."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for _, _, words in runs_of(batch, 0):
                doc = words.doc_of()
                for k in sizes:
                    h = words.grams(k, doc)[1]
                    h, n = np.unique(h[in_bitmap(bitmap, h)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("count"))


def places(docs: DataFrame, keys: list[str], bitmap: np.ndarray, sizes: list[int], size: int) -> DataFrame:
    """``keys``, row_ (one for each row), n_words, hits: the shingles that the
    bitmap lets through, each with the words around it."""
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b, words in runs_of(batch, len(keys) + 1):
                doc = words.doc_of()
                found: list[list] = [[] for _ in range(b - a)]
                for k in sizes:
                    at, h = words.grams(k, doc)
                    hit = in_bitmap(bitmap, h)
                    for p, x in zip(at[hit].tolist(), h[hit].view(np.int64).tolist()):
                        d = int(doc[p])
                        first = int(words.first[d])
                        left = max(first, p - size + 1)
                        found[d].append({"h": x, "pos": p - first, "left_": p - left, "around": words.joined(left, min(int(words.first[d + 1]), p + size))})
                hits = pa.array(found, pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("left_", pa.int32()), ("around", pa.string())])))
                own = [batch.column(i).slice(a, b - a) for i in range(len(keys) + 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(words.first)), hits], [*keys, "row_", "n_words", "hits"])

    rows = docs.select(*keys, F.monotonically_increasing_id().alias("row_"), "text")
    return rows.mapInArrow(run, f"{kinds}, row_ long, n_words long, hits array<struct<h: long, pos: int, left_: int, around: string>>")


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, keys: list[str] | None = None, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """``keys`` (default doc_id), n_words, n_hit, n_items, items_sha256, contaminated per row of ``docs``.

    ``items``: item_id, text. A document word inside any occurrence of a window
    is hit. Texts that are null or have no word give 0s, and items without a word
    no window; item ids that are null aren't counted. Repeated documents and
    items are each treated alike, rows with one key each on their own; other
    columns aren't read. Without items nothing is contaminated.
    """
    keys = keys or ["doc_id"]
    cut = stage(spark, item_windows(items, size, shingle), "windows")
    windows = cut.dropDuplicates(["win"]).select("win", "n", F.explode(F.arrays_zip("offsets", "hashes")).alias("s"))
    windows = windows.select("win", "n", F.col("s.offsets").alias("offset"), F.col("s.hashes").alias("h"))
    sizes = sorted({min(shingle, r["n"]) for r in cut.select("n").distinct().collect()})
    counts = shingle_counts(docs, key_bitmap(windows, "h"), sizes)
    rarity = F.struct(F.coalesce("count", F.lit(0).cast("long")).alias("count"), "h", "offset")
    prefix = windows.join(counts, "h", "left").groupBy("win", "n").agg(F.min(rarity).alias("p"))
    prefix = prefix.where("p.count > 0").select("win", "n", F.col("p.h").alias("h"), F.col("p.offset").alias("offset"))
    prefix = stage(spark, prefix, "prefix")
    rows = stage(spark, places(docs, keys, key_bitmap(prefix, "h"), sizes, size), "places")

    hits = rows.select("row_", "n_words", F.explode("hits").alias("x")).select("row_", "n_words", "x.*")
    start = F.col("pos") - F.col("offset")
    there = F.array_join(F.slice(F.split("around", " "), F.greatest(F.lit(1), F.col("left_") - F.col("offset") + 1), F.col("n")), " ")
    met = hits.join(prefix, "h").where((F.col("left_") >= F.col("offset")) & (start + F.col("n") <= F.col("n_words")) & (there == F.col("win")))
    met = stage(spark, met.select("row_", start.alias("start"), (start + F.col("n")).alias("end"), "win"), "met")

    upto = Window.partitionBy("row_").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(upto), F.lit(0))))
    hit = met.select("row_", fresh.alias("fresh")).groupBy("row_").agg(F.sum("fresh").alias("n_hit"))
    named = met.select("row_", "win").join(cut.select("win", "item_id").distinct(), "win").groupBy("row_").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = rows.drop("hits").join(hit.join(named, "row_", "left"), "row_", "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        *keys, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def without_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` in whose text no window of an item occurs, all columns as they are."""
    name, text = F.coalesce(F.col(key).cast("string"), F.lit("null")), F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.withColumns({"item_key_": name, "item_text_": text})
    found = contamination(spark, named, items, ["item_key_", "item_text_"]).where("contaminated").select("item_key_", "item_text_").distinct()
    return named.join(found, ["item_key_", "item_text_"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
i AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[s : s + least(10, len(ws)) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(ws) - 9, least(len(ws), 1)) + 1)) t(s)),
p AS (
  SELECT r, k.n, s, array_to_string(ws[s : s + k.n - 1], ' ') AS win
  FROM w, (SELECT DISTINCT n FROM i) k, unnest(range(1, len(ws) - k.n + 2)) t(s)),
m AS (SELECT r, p.n, p.s, i.item_id FROM p JOIN i ON p.win = i.win AND p.n = i.n),
h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT r, s, n FROM m)) GROUP BY r),
g AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON w.r = h.r LEFT JOIN g ON w.r = g.r
"""
