"""Product codes of vectors, by a trie over their distinct parts.

Vectors are cut into equal parts; each position of a part has a codebook, fitted
by rounds of nearest entries and means in whole numbers. Fitting works on the
distinct parts of a position with their counts, in lexicographic order: a
sorted run of them is a trie read depth first. A node of depth d stands
for the parts that begin with the same d components and holds the distances to
all entries over these components, so a common beginning is reckoned once; its
children add one component's square. Leaves take the nearest entry and add
their count and weighted components to that entry's sums.

Distinct parts are range-partitioned, sorted and written once; a round reads
them by column batches and shuffles a row for each task, position and entry.
The driver holds the codebooks alone. Codes are assigned without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import stage, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components lie below this; squares of differences, summed over a vector, then fit 64 bits.
MOST = 1 << 27


def whole_numbers(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are sound, and their components as floor(SCALE * x).

    A sound vector is neither null nor empty and holds finite numbers only.
    ``width`` is checked if given; otherwise all must be equally long.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    start = np.concatenate([[0], np.cumsum(length)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    sound = (length > 0) & (bad[start[1:]] == bad[start[:-1]])
    sizes = np.unique(length[sound])
    if len(sizes) > 1 or (width is not None and len(sizes) and sizes[0] != width):
        raise ValueError(f"vectors of {sorted({*sizes.tolist(), *([width] if width else [])})} components: one length is needed")
    if not len(sizes):
        return sound, np.zeros((0, width or 0), dtype=np.int64)
    rows = np.floor(x[np.repeat(sound, length)].reshape(-1, sizes[0]) * SCALE)
    if np.abs(rows).max() >= MOST:
        raise ValueError(f"components of {MOST // SCALE} and more can't be coded in 64 bits")
    return sound, rows.astype(np.int64)


def packed(parts: np.ndarray) -> pa.Array:
    """Rows of whole numbers as bytes whose order is that of the rows."""
    n, d = parts.shape
    data = (parts + (1 << 31)).astype(">u4").tobytes()
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 4 * d * n + 1, 4 * d, dtype=np.int32) if n else np.zeros(1, np.int32)), pa.py_buffer(data)])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=">u4")
    return data.astype(np.int64).reshape(-1, width) - (1 << 31)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lexicographically sorted ``parts``: the nearest entry of ``book`` and its squared distance; ties to the lower entry.

    Level by level, ``total`` has a row of distances to all entries for each
    node of the trie in depth-first order; ``node`` is each part's node. A
    node begins where a part differs from the one before it in the components so far.
    """
    n, d = parts.shape
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    total, node = np.zeros((1, len(book)), dtype=np.int64), np.zeros(n, dtype=np.int64)
    for j in range(d):
        new[1:] |= parts[1:, j] != parts[:-1, j]
        first = np.flatnonzero(new)
        total = total[node[first]] + (parts[first, j, None] - book[None, :, j]) ** 2
        node = np.cumsum(new) - 1
    entry = total.argmin(axis=1)
    return entry[node], total[np.arange(len(entry)), entry][node]


def _split(column: str, n_parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of vectors to rows (position, part)."""

    def run(batches):
        for b in batches:
            _, rows = whole_numbers(b.column(column))
            if rows.shape[1] % n_parts:
                raise ValueError(f"{rows.shape[1]} components can't be cut into {n_parts} equal parts")
            width = rows.shape[1] // n_parts
            for p in range(n_parts if len(rows) else 0):
                part = packed(rows[:, p * width : (p + 1) * width])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), p, np.int32)), part], names=["position", "part"])

    return run


def _sums(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of sorted distinct parts to counts and sums for each position and entry."""
    n_parts, n_entries, width = books.shape

    def run(batches):
        count, total = np.zeros((n_parts, n_entries), np.int64), np.zeros(books.shape, np.int64)
        for b in batches:
            position, weight = (np.asarray(b.column(c), dtype=np.int64) for c in ("position", "n"))
            parts = unpacked(b.column("part"), width)
            for p in np.unique(position):
                own = np.flatnonzero(position == p)
                entry, _ = nearest(parts[own], books[p])
                np.add.at(count[p], entry, weight[own])
                np.add.at(total[p], entry, parts[own] * weight[own, None])
        p, e = np.nonzero(count)
        arrays = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["position", "entry", "n", "total"])

    return run


def distinct_parts(spark: SparkSession, vectors: DataFrame, column: str, n_parts: int) -> DataFrame:
    """position, part, n: distinct parts with their counts, in sorted ranges. Copies are counted before they are shuffled."""
    parts = vectors.select(column).mapInArrow(_split(column, n_parts), "position int, part binary")
    counted = parts.groupBy("position", "part").agg(F.count(F.lit(1)).alias("n"))
    return stage(spark, counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "code-parts")


def first_entries(vectors: DataFrame, key: str, column: str, n_parts: int, entries: int) -> np.ndarray | None:
    """The parts of the ``entries`` least keys among sound vectors, at most so many; ties of keys by the vector."""
    x = F.col(column)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(sound & F.col(key).isNotNull()).select(key, x.cast("array<double>").alias("vector_")).orderBy(key, "vector_").limit(entries).collect()
    if not rows:
        return None
    _, first = whole_numbers(pa.array([r["vector_"] for r in rows], pa.list_(pa.float64())))
    if first.shape[1] % n_parts:
        raise ValueError(f"{first.shape[1]} components can't be cut into {n_parts} equal parts")
    return first.reshape(len(first), n_parts, -1).transpose(1, 0, 2).copy()


def fit(spark: SparkSession, vectors: DataFrame, key: str, column: str, n_parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks [position, entry, component] of whole numbers; None without a sound vector."""
    books = first_entries(vectors, key, column, n_parts, entries)
    if books is None:
        return None
    parts = distinct_parts(spark, vectors, column, n_parts)
    width = books.shape[2]
    for _ in range(rounds):
        sums = parts.mapInArrow(_sums(books), "position int, entry int, n long, total array<long>")
        sums = sums.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(width)])
        books = books.copy()
        for r in sums.collect():  # a row for each entry
            books[r["position"], r["entry"]] = [r[f"t{j}"] // r["n"] for j in range(width)]
    return books


def _codes(books: np.ndarray, column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    n_parts, _, width = books.shape

    def run(batches):
        for b in batches:
            sound, rows = whole_numbers(b.column(column), n_parts * width)
            code, error = np.zeros((len(rows), n_parts), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(n_parts):
                part = rows[:, p * width : (p + 1) * width]
                order = np.lexsort(part.T[::-1])
                entry, distance = nearest(part[order], books[p])
                code[order, p] = entry
                error[order] += distance
            kept = b.drop_columns([column]).filter(pa.array(sound))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=[*kept.schema.names, "code", "error"])

    return run


def encode(spark: SparkSession, vectors: DataFrame, books: np.ndarray | None, column: str, carry: list[str]) -> DataFrame:
    """``carry``, code and error of the sound vectors: two hex digits for each part, and the squared distances' sum."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*carry).schema)
    if books is None:
        return spark.createDataFrame([], f"{fields}, code string, error long")
    return vectors.select(*carry, column).mapInArrow(_codes(books, column), f"{fields}, code string, error long")


def codebooks_digest(books: np.ndarray | None) -> str:
    text = ",".join(map(str, books.ravel().tolist())) if books is not None else ""
    return hashlib.sha256(text.encode()).hexdigest()


def vector_codes(spark: SparkSession, vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", n_parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``key``, code, error, label_error and codebooks_sha256 of every sound vector.

    Null and empty vectors and those with null or non-finite components are left out. Fewer than
    ``entries`` sound vectors with a key give so many entries; without any there
    are no rows. Vectors with a null key are coded, but no first entries. Repeated
    rows and equal parts count as often as they occur; equal entries leave all to the lower
    one. Vectors of different lengths, a length that ``n_parts`` doesn't
    divide, more than 256 entries, and components of 32,768 and more are errors. Null labels count as one
    label. Other columns are neither read nor returned.
    """
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    vectors = vectors.select(F.col(key).alias("key"), F.col(column).alias("vector"), F.col(label).alias("label"))
    books = fit(spark, vectors, "key", "vector", n_parts, entries, rounds)
    coded = stage(spark, encode(spark, vectors, books, "vector", ["key", "label"]), "codes")
    sums = coded.groupBy(F.col("label").alias("label_")).agg(F.sum("error").alias("label_error"))
    both = coded.join(sums, F.col("label").eqNullSafe(F.col("label_")))
    return both.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark, table(spark, sf_dir, "embeddings"))


def _op11_sql() -> str:
    square = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i])))::BIGINT"
    nearest_of = f"""SELECT p, r, v, arg_min({{k}}, [d, k]) AS k, min(d) AS d FROM
      (SELECT parts.p, r, v, k, {square} AS d FROM parts JOIN b{{j}} b ON parts.p = b.p) GROUP BY p, r, v"""
    steps = [
        "rows AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS w FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT r, p, w[p * (len(w) // 8) + 1 : (p + 1) * (len(w) // 8)] AS v FROM rows, range(8) t(p))",
        "b0 AS MATERIALIZED (SELECT p, r - 1 AS k, v AS e FROM parts WHERE r <= 16)",
    ]
    for j in range(ROUNDS):
        steps.append(f"a{j} AS MATERIALIZED ({nearest_of.format(k='k', j=j)})")
        steps.append(f"s{j} AS (SELECT p, k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM (SELECT p, k, v, unnest(range(1, len(v) + 1)) AS i FROM a{j}) GROUP BY p, k, i)")
        steps.append(f"m{j} AS (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{j} GROUP BY p, k)")
        steps.append(f"b{j + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.e, b.e) AS e FROM b{j} b LEFT JOIN m{j} m ON b.p = m.p AND b.k = m.k)")
    steps.append(f"last AS MATERIALIZED ({nearest_of.format(k='k', j=ROUNDS)})")
    steps.append("coded AS (SELECT r, string_agg(printf('%02x', k::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY r)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM rows JOIN coded USING (r), digest"""


OP11_SQL = _op11_sql()
