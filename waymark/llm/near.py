"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's sketch has SKETCHES keys. Each comes from the LEAST smallest of
its occurrence-labelled five-word k-mers under one hash, hashed in the order
they have in the text; so it agrees with a probability that falls with edits. Texts of
few shingles have the least of these as keys besides, by which none is missed.
Documents with the same words are one node, and nodes that share a key are a
bucket. All members of a small bucket are compared with each other. Those of a
larger one are compared with one of them only, its centre, a member near to what most
of them have in common. What others may share with each other is then looked for in
how they differ from that: the shingles that a member has and most haven't, or
that it lacks and most have, rarest first, are the keys by which a bucket is split for the next
round. So neither a passage that many documents share nor the text that a
family of copies comes from is met again. No such key is shared by more than half of the
bucket, and most are by a few, so buckets end after a few rounds.

A link needs shared five-word shingles of SIMILARITY (Jaccard) or more, and an
alignment of the words within the band of 1 - SIMILARITY with as few edits.

Splitting is an exact prefix filter. Let D(b) be the shingles in which a member b and what
is common (of the shingles those that more than half of the bucket's members have) differ, and
k = (1 - SIMILARITY) / (1 + SIMILARITY). Two texts have that similarity exactly if they differ in
k times their sizes' sum at most. The centre is the member c with the least |D(c)| - k |c|. So
if b and d are similar and d isn't to the centre, D(b) and D(d) have more than
(|D(b)| - k |b| - |D(c)| + k |c|) / 2 shingles in common, which is 0 at the least; and
|D(b)| less a quarter of |b| at the least whatever the centre. A prefix of D(b), those first that
no member of another component has, then the rarest, that leaves out fewer than b must share
meets that of every partner that is still to be found. All shingles count, whatever a text's length.
Of a pair one has the lesser |D| - k size, and both must share as many as that at the least; so its
prefix may be the shorter one that leaves out fewer, and a bucket in which nobody's shorter prefix meets
is no bucket.
Not covered are texts with the same shingles in another order, which the
alignment parts: they only count as compared with the centre here.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import Words, in_bitmap, key_bitmap, mix, powers, scratch, stage, table, text_chunks

K, SIMILARITY = 5, 0.8
SKETCHES, LEAST = 20, 4
#: Members of a bucket that are all compared with each other.
SMALL = 8
#: Texts of so few distinct shingles meet all that they may be linked with: the least of their shingles are keys too.
SHORT = 20

_rng = np.random.Generator(np.random.PCG64(77))
_TURN = _rng.integers(1, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_SEAT = _rng.integers(1, 2**63, LEAST, dtype=np.uint64) | np.uint64(1)
_SPAN = 4096


def labelled(grams: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each k-mer with its number among its equals in the same text; and whether it is the first of them."""
    key = mix(grams + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(key, kind="stable")
    new = np.append(True, key[by][1:] != key[by][:-1])
    at = np.arange(len(key))
    nth = np.empty(len(key), dtype=np.uint64)
    nth[by] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return mix(grams + nth * np.uint64(0xD6E8FEB86659FD93)), nth == 0


def order_minhash(kmers: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The keys of one text: ``kmers`` in order, ``names`` their labelled hashes."""
    n = len(kmers)
    if n <= LEAST:
        least = np.tile(np.arange(n), (SKETCHES, 1)).T
    elif n <= _SPAN:
        least = np.argpartition(names[:, None] * _TURN, LEAST - 1, axis=0)[:LEAST]
    else:
        parts = []
        for a in range(0, n, _SPAN):  # the least of each span, then of those
            turned = names[a : a + _SPAN, None] * _TURN
            parts.append(a + (np.argpartition(turned, LEAST - 1, axis=0)[:LEAST] if len(turned) > LEAST else np.tile(np.arange(len(turned)), (SKETCHES, 1)).T))
        some = np.concatenate(parts)
        turned = names[some] * _TURN
        least = np.take_along_axis(some, np.argpartition(turned, LEAST - 1, axis=0)[:LEAST], axis=0)
    least = np.sort(least, axis=0)
    return mix((kmers[least] * _SEAT[: len(least), None]).sum(axis=0, dtype=np.uint64) + np.arange(SKETCHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefix_keys(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a text of few distinct shingles, one of which it shares with any that is as similar; none for a text with more than a partner of SHORT may have."""
    n = len(shingles)
    if not n or n > SHORT / similarity + 1e-9:
        return np.zeros(0, np.uint64)
    # A partner has that part of them at least, so it has one of the others and one more, and the least in common is among both prefixes.
    return np.sort(mix(shingles ^ _TURN[1]))[: n - math.ceil(similarity * n - 1e-9) + 1]


def sketches(docs: DataFrame, key: str, similarity: float = SIMILARITY) -> DataFrame:
    """key, row_, text_hash, h1 and h2 (of the words, or of a text without any), n_shingles (distinct), keys."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            column = batch.column(3)
            column = column.fill_null("") if column.null_count else column
            for a, b in text_chunks(column):
                texts = column.slice(a, b - a)
                words = Words(texts)
                doc = words.doc_of()
                place = (np.arange(len(doc)) - words.first[doc]).astype(np.uint64)
                at, grams = words.grams(K, doc)
                names, fresh = labelled(grams, doc[at])
                distinct = np.append(0, np.cumsum(fresh))
                first = np.searchsorted(at, words.first)
                h1, h2, n, keys = [], [], [], []
                own = mix(words.hashes + place * np.uint64(0xA24BAED4963EE407))
                own2 = mix(own ^ np.uint64(0x9FB21C651E98DF25))
                for i in range(b - a):
                    w0, w1, g0, g1 = int(words.first[i]), int(words.first[i + 1]), int(first[i]), int(first[i + 1])
                    if w0 == w1:
                        d = np.frombuffer(hashlib.blake2b(texts[i].as_py().encode(), digest_size=16).digest(), dtype=np.int64)
                        h1.append(int(d[0]))
                        h2.append(int(d[1]))
                    else:
                        h1.append(int(own[w0:w1].sum(dtype=np.uint64).view(np.int64)))
                        h2.append(int(own2[w0:w1].sum(dtype=np.uint64).view(np.int64)))
                    n.append(int(distinct[g1] - distinct[g0]))
                    own_keys = order_minhash(grams[g0:g1], names[g0:g1]).view(np.int64).tolist() if g1 > g0 else []
                    keys.append(own_keys + prefix_keys(grams[g0:g1][fresh[g0:g1]], similarity).view(np.int64).tolist())
                mine = [batch.column(i).slice(a, b - a) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*mine, pa.array(h1), pa.array(h2), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["key", "row_", "text_hash", "h1", "h2", "n_shingles", "keys"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.monotonically_increasing_id().alias("row_"), text_hash().alias("text_hash"), "text")
    return rows.mapInArrow(run, f"key {kind}, row_ long, text_hash long, h1 long, h2 long, n_shingles int, keys array<long>")


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance of two sequences if it is at most ``most``: furthest-reaching points of all diagonals of a band of that width at once.

    How far a diagonal's points agree is found by halving, over sums of the
    hashed words, so reordered texts cost most**2 array steps at the most, and no loop over words.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    up, _ = powers(max(n, m) + 1)
    sums_a, sums_b = np.zeros(n + 1, np.uint64), np.zeros(m + 1, np.uint64)
    np.cumsum(mix(a) * up[:n], dtype=np.uint64, out=sums_a[1:])
    np.cumsum(mix(b) * up[:m], dtype=np.uint64, out=sums_b[1:])

    def slide(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        y = x - k
        left = np.minimum(n - x, m - y)
        go = np.flatnonzero(left > 0)
        go = go[a[x[go]] == b[y[go]]]
        if not len(go):
            return x
        i, j = x[go], y[go]
        low, high = np.ones(len(go), np.int64), left[go]
        while (low < high).any():
            half = (low + high + 1) // 2
            same = (sums_a[i + half] - sums_a[i]) * up[j] == (sums_b[j + half] - sums_b[j]) * up[i]
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        x = x.copy()
        x[go] += low
        return x

    # far[k + most + 1] is the furthest x on diagonal k; x below zero: not reached.
    far = np.full(2 * most + 3, -2, dtype=np.int64)
    far[most + 1] = slide(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    for d in range(most + 1):
        if far[n - m + most + 1] >= n:
            return d
        if d == most:
            return None
        rest = most - d - 1
        k = np.arange(max(-d - 1, n - m - rest), min(d + 1, n - m + rest) + 1)
        at = k + most + 1
        x = np.maximum(np.maximum(far[at], far[at - 1]) + 1, far[at + 1])
        good = x >= np.maximum(0, k)
        k, at, x = k[good], at[good], x[good]
        nxt = np.full_like(far, -2)
        nxt[at] = slide(np.minimum(np.minimum(x, n), m + k), k)
        far = nxt
    return None


def compared(pairs: DataFrame, similarity: float) -> DataFrame:
    """a, b of those pairs (a, b, text_a, text_b) that are linked."""

    def parsed(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for x, y in text_chunks(column):
            words = Words(column.slice(x, y - x))
            doc = words.doc_of()
            at, grams = words.grams(K, doc)
            first = np.searchsorted(at, words.first)
            out += [(words.hashes[words.first[i] : words.first[i + 1]], np.unique(grams[first[i] : first[i + 1]])) for i in range(y - x)]
        return out

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                centres = batch.column(0).to_pylist()
                # Where rows of a centre stand together, it is taken apart once.
                new = [i for i, c in enumerate(centres) if not i or c != centres[i - 1]]
                texts_a = parsed(batch.column(2).take(pa.array(new)))
                of = np.cumsum(np.isin(np.arange(len(centres)), new)) - 1
                link = []
                for i, (words_b, set_b) in enumerate(parsed(batch.column(3))):
                    words_a, set_a = texts_a[of[i]]
                    same = int(np.isin(set_b, set_a, assume_unique=True).sum())
                    good = same > 0 and same >= similarity * (len(set_a) + len(set_b) - same)
                    if good:
                        good = edits_within(words_a, words_b, int((1 - similarity) * max(len(words_a), len(words_b)) + 1e-9)) is not None
                    link.append(good)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(link, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def shingled(texts: DataFrame) -> DataFrame:
    """node, groups, xs of texts (node, groups, text): the distinct shingles, sorted."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b in text_chunks(batch.column(2)):
                words = Words(batch.column(2).slice(a, b - a))
                at, grams = words.grams(K, words.doc_of())
                first = np.searchsorted(at, words.first)
                xs = [np.unique(mix(grams[first[i] : first[i + 1]]).view(np.int64)) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(xs, pa.list_(pa.int64()))], ["node", "groups", "xs"])

    return texts.select("node", "groups", "text").mapInArrow(run, "node long, groups array<long>, xs array<long>")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, comp (the least node linked with it) of the nodes of ``edges`` (a, b), but for those least ones.

    Large-star and small-star steps in turn, each written to the shared folder:
    a neighbour's least neighbour takes over, until what is left are stars. That is seen
    by one sum over the nodes, so edges that are stars from the first need no step.
    """
    edges = stage(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    while True:
        ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("below")).union(edges.select("b", F.lit(1)))
        if not ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least")).where("below > 1 or (below = 1 and least = 0)").take(1):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("comp"))
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        lower = large.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = lower.groupBy("a").agg(F.min("b").alias("m"))
        moved = lower.join(least, "a").select("m", F.col("b").alias("x")).union(least.select("m", F.col("a").alias("x")))
        edges = stage(spark, moved.where("m < x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), "edges")


def joined(spark: SparkSession, comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (node, comp; least nodes of a component aren't in it) after more links (a, b), which join components."""
    for side in ("a", "b"):
        of = comp.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_"))
        links = links.join(of, side, "left").withColumn(side, F.coalesce(f"{side}_", side)).drop(f"{side}_")
    moved = stage(spark, components(spark, links), "moved")
    to = moved.select(F.col("node").alias("comp"), F.col("comp").alias("to_"))
    return comp.join(to, "comp", "left").select("node", F.coalesce("to_", "comp").alias("comp")).union(moved.select("node", "comp"))


def _added(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """All that was written to ``path`` so far, and ``df``: one scan, however many rounds there are."""
    df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _mixed(seats: DataFrame, comp: DataFrame) -> DataFrame:
    """Seats (node, bucket) with comp and size, of buckets with nodes that aren't known to be linked, one of them by its shorter prefix; of those with the same members only one."""
    seats = seats.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sums = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    sizes = seats.groupBy("bucket").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.bool_or("lesser").alias("lesser"), *sums).where("low < high and lesser")
    sizes = sizes.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    return seats.drop("lesser").join(sizes, "bucket")


def _grouped(many: DataFrame, first: bool) -> DataFrame:
    """(group, node) of large buckets' seats. At first those with the same most central member are one group, as a family's keys give much the same bucket many times; later each is its own, a half of the one before at most."""
    if not first:
        return many.select(F.col("bucket").alias("group"), "node")
    central = many.groupBy("node").agg(F.sum("size").alias("central"))
    lead = many.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct("central", F.xxhash64("node"))).alias("group"))
    return many.join(lead, "bucket").select("group", "node").distinct()


def _members(spark: SparkSession, members: DataFrame, texts: DataFrame) -> DataFrame:
    """group, node, m (shingles), d, own and lacks of members (group, node): the shingles that a member has and most haven't, and those that it lacks and most have.

    d counts both. Of own those are left out that no other member of the group
    has: they're no key, and a bitmap of fixed size tells most of them.
    """
    wanted = members.groupBy("node").agg(F.collect_list("group").alias("groups"))
    parsed = shingled(texts.join(wanted, "node")).select(F.explode("groups").alias("group"), "node", "xs")
    size = members.groupBy("group").agg(F.count("*").alias("size"))
    parsed = stage(spark, parsed.join(size, "group"), "parsed")
    n = parsed.repartition("group", "node").select("group", "size", F.explode("xs").alias("x")).groupBy("group", "x").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    n = stage(spark, n.where("n > 1"), "counts")
    # They are twice as many as a member has on average at most; a group's other shingles don't meet.
    common = n.where("n * 2 > size").groupBy("group").agg(F.collect_list("x").alias("common"))
    salt = F.xxhash64("group")
    bitmap = key_bitmap(n.where("n * 2 <= size").select(F.col("x").bitwiseXOR(salt).alias("h")), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, salts = batch.column(5), batch.column(4).to_numpy()
            counts = np.diff(own.offsets.to_numpy())
            xs = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            keep = in_bitmap(bitmap, xs ^ np.repeat(salts, counts))
            ends = np.append(0, np.cumsum(keep))[np.append(0, np.cumsum(counts))]
            few = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(xs[keep], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), few, batch.column(6)], ["group", "node", "m", "d", "own", "lacks"])

    both = parsed.join(common, "group", "left").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))
    both = both.select("group", "node", F.size("xs").alias("m"), salt.alias("salt"), F.array_except("xs", "common").alias("own"), F.array_except("common", "xs").alias("lacks"))
    both = both.select("group", "node", "m", (F.size("own") + F.size("lacks")).alias("d"), "salt", "own", "lacks")
    return stage(spark, both.mapInArrow(run, "group long, node long, m int, d int, own array<long>, lacks array<long>"), "members")


def _mixed_differences(m: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """group, node, x of members' differences of that column; and group, x, n of those that members have which aren't known to be linked."""
    each = m.select("group", "node", "comp", F.explode(column).alias("x"))
    mixed = each.groupBy("group", "x").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return each.drop("comp"), mixed.drop("low", "high")


def _keys(members: DataFrame, centres: DataFrame, comp: DataFrame, similarity: float) -> DataFrame:
    """node, bucket, lesser (of the shorter prefix): the keys of the members (but the centre) of groups in which not all are known to be linked: prefixes of their differences from what is common.

    A difference that only members share which are known to be linked is of no
    use, and no partner that is still to be found has it. What members lack is part of what
    is common, so their counts come as one list a group (above 16 in steps of a quarter power of two, so that it
    has few parts); only what they have besides meets its count one by one. Any order that a group's members share will do.
    """
    known = centres.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("comp_a")), "a", "left").withColumn("comp_a", F.coalesce("comp_a", "a"))
    m = members.join(known, "group").where("node != a").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = m.groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("group")
    # Dealt out by member: a large group is in no one task.
    m = m.join(open_, "group").repartition("group", "node")
    each, mixed = _mixed_differences(m, "own")
    has = each.join(mixed, ["group", "x"]).groupBy("group", "node").agg(F.collect_list(F.struct("n", "x", F.lit(0).alias("side"))).alias("has"))
    _, mixed = _mixed_differences(m, "lacks")
    about = F.when(F.col("n") > 16, F.floor(F.pow(F.lit(2.0), F.floor(4 * F.log2("n")) / 4))).otherwise(F.col("n")).alias("n")
    lists = mixed.groupBy("group", about).agg(F.collect_list("x").alias("xs")).groupBy("group").agg(F.collect_list(F.struct("n", "xs")).alias("lists"))
    m = m.select("group", "node", "m", "d", "lacks", "comp", "comp_a", "x_a", "m_a").join(has, ["group", "node"], "left").join(lists, "group", "left")
    lacked = F.flatten(F.transform("lists", lambda few: F.transform(F.array_intersect("lacks", few["xs"]), lambda x: F.struct(few["n"].alias("n"), x.alias("x"), F.lit(1).alias("side")))))
    none = F.array().cast("array<struct<n: bigint, x: bigint, side: int>>")
    m = m.select("node", "group", "m", "d", "comp", "comp_a", "x_a", "m_a", F.concat(F.coalesce("has", none), F.coalesce(lacked, none)).alias("shared")).where(F.size("shared") > 0)
    k = (1 - similarity) / (1 + similarity)
    score, score_a = F.col("d") - k * F.col("m"), F.col("x_a") - k * F.col("m_a")
    # A partner of one that is linked with the centre isn't linked with it; no partner's score is below the centre's.
    other = F.when(F.col("comp") == F.col("comp_a"), F.abs(score_a)).otherwise(score_a)
    least = F.greatest(F.lit(1), F.col("d") - F.floor((1 - similarity) / similarity * F.col("m") + 1e-9), F.ceil((score + other) / 2 - 1e-9))
    # What no other component has comes first in every prefix.
    left = F.size("shared") - least + 1
    shorter = F.size("shared") - F.greatest(least, F.ceil(score - 1e-9)) + 1
    rarest = F.slice(F.sort_array("shared"), F.lit(1), F.greatest(F.lit(0), left).cast("int"))
    keys = F.transform(rarest, lambda k, i: F.struct(F.xxhash64("group", k["x"], k["side"]).alias("bucket"), (i < F.col("shorter")).alias("lesser")))
    return m.withColumn("shorter", shorter).select("node", F.explode(keys).alias("key")).select("node", "key.bucket", "key.lesser")


def _unlinked(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that aren't known to be of one component."""
    for side in ("a", "b"):
        pairs = pairs.join(comp.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_")), side, "left")
    return pairs.where(F.coalesce("a_", "a") != F.coalesce("b_", "b")).select("a", "b")


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``key``, class_id, keep, text_hash of every row: the classes that links make, as above.

    class_id is the smallest key of the class, and keep is true for one row of
    it, one with that key. Rows with the same words, in any case or
    punctuation, are one class, texts of fewer than five words being compared
    in no other way; texts without words are compared as they stand, null as
    empty. Null keys come last and name a class only if it has no other. Other
    columns aren't read.
    """
    rows = stage(spark, sketches(docs, key, similarity), "sketches")
    best = F.struct(F.col("key").isNull().alias("x"), F.col("key").alias("k"), F.col("row_").alias("r"))
    nodes = rows.groupBy("h1", "h2").agg(F.min(best).alias("best"), F.min_by("text_hash", "row_").alias("text_hash"), F.min_by("n_shingles", "row_").alias("n"), F.min_by("keys", "row_").alias("keys"))
    nodes = stage(spark, nodes.withColumn("node", F.col("best.r")), "nodes")

    texts = tried = None
    folder = scratch(spark, "rounds")
    comp = spark.createDataFrame([], "node long, comp long")
    seats = nodes.select("node", F.explode("keys").alias("bucket"), F.lit(True).alias("lesser"))
    while True:
        seats = stage(spark, _mixed(seats, comp), "seats")
        if not seats.take(1):
            break
        first = texts is None
        if first:
            texts = _texts(spark, docs, seats.select("node").distinct().join(nodes.select("node", "text_hash"), "node"))
        few, many = seats.where(F.col("size") <= SMALL), seats.where(F.col("size") > SMALL)
        other = few.select("bucket", F.col("node").alias("b"), F.col("comp").alias("comp_b"))
        pairs = few.withColumnRenamed("node", "a").join(other, "bucket").where("a < b and comp != comp_b").select("a", "b")
        members = None
        if many.take(1):
            members = _members(spark, stage(spark, _grouped(many, first), "grouped"), texts)
            best = F.min(F.struct((F.col("d") - (1 - similarity) / (1 + similarity) * F.col("m")).alias("far"), F.xxhash64("node").alias("tie"), F.col("node").alias("a"), F.col("d").alias("x_a"), F.col("m").alias("m_a"))).alias("c")
            centres = stage(spark, members.groupBy("group").agg(best).select("group", "c.a", "c.x_a", "c.m_a"), "centres")
            compare = members.select("group", F.col("node").alias("b")).join(centres, "group").where("a != b").select("a", "b")
            pairs = pairs.union(_unlinked(compare, comp))
        pairs = pairs.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(spark, pairs.select("a", "b"), "pairs")
        with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        with_both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        links = stage(spark, compared(with_both, similarity), "links")
        if links.take(1):
            comp = stage(spark, joined(spark, comp, links), "components")
        if members is None:
            break
        tried = _added(spark, pairs, f"{folder}/tried")
        seats = stage(spark, _keys(members, centres, comp, similarity), "fresh")

    named = nodes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classes = named.groupBy("comp").agg(F.min("best").alias("class"))
    of_node = named.select("node", "h1", "h2", "comp").join(classes, "comp").select("h1", "h2", "class")
    return rows.join(of_node, ["h1", "h2"]).select(F.col("key").alias(key), F.col("class.k").alias("class_id"), (F.col("row_") == F.col("class.r")).alias("keep"), "text_hash")


def _texts(spark: SparkSession, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted nodes (node, text_hash); a bitmap of fixed size lets few other texts into the shuffle."""
    wanted = stage(spark, wanted, "wanted")
    bitmap = key_bitmap(wanted, "text_hash")

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bitmap, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))

    some = docs.select(text_hash().alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(only, "text_hash long, text string")
    return stage(spark, some.groupBy("text_hash").agg(F.first("text").alias("text")).join(wanted, "text_hash").select("node", "text"), "texts")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` of each class, all columns as they are.

    Of rows that agree in key and text the one stays whose other columns come
    first as JSON text. Columns of any name, an empty table and null keys or
    texts are as in ``near_duplicates``; texts are compared whole, however long.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    kept = near_duplicates(spark, docs, key, similarity).where("keep").select(name.alias("near_key_"), F.col("text_hash").alias("near_text_"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("near_row_"), name.alias("near_key_"), text_hash().alias("near_text_"))
    others = [F.col(f"near_row_.`{c}`") for c in docs.columns if c not in (key, "text")]
    one = F.min_by("near_row_", F.to_json(F.struct(*others))) if others else F.first("near_row_")
    return named.join(kept, ["near_key_", "near_text_"], "left_semi").groupBy("near_key_", "near_text_").agg(one.alias("r")).select("r.*")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents")).drop("text_hash")
