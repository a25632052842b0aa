"""Merkle manifests of grouped rows, kept as append logs in postorder.

The leaves of a tree, in the order of their keys, are followed by levels: every
``FAN`` consecutive nodes become one of the next level, until one is left. The
log has each node directly after the last of its children, which is the order
in which nodes are complete; those of an unfinished last run come at the end. Where a node
stands follows from sizes of subtrees alone (``position``), so a proof
addresses siblings without an index.

Builders work on aligned blocks of ``FAN ** HEIGHT`` leaves, each in a group of
its own, and log the block's subtree in one go. The roots of blocks are the
leaves of the next round of builders, until each tree has one node. A second
tree, of the same making, holds the roots of all trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import stage, table
from waymark.llm.fit import fold

#: Children of a node.
FAN = 8
#: Levels that a builder adds: blocks of 4096 leaves, logs of 0.15 MB.
HEIGHT = 4

_BLOCK_TYPES = {"tree": pa.string(), "block": pa.int64(), "n": pa.int64(), "first": pa.int64(), "digests": pa.binary(), "loose_first": pa.int64(), "loose": pa.binary()}
_NODE_TYPES = {"tree": pa.string(), "n": pa.int64(), "level": pa.int32(), "rank": pa.int64(), "pos": pa.int64(), "digest": pa.string(), "root": pa.bool_()}
_ADDRESS_TYPES = {"tree": pa.string(), "block": pa.int64(), "level": pa.int32(), "at": pa.int32(), "where": pa.list_(pa.int64())}
NODES = "tree string, n long, level int, rank long, pos long, digest string, root boolean"
BLOCKS = "tree string, block long, n long, first long, digests binary, loose_first long, loose binary"
STEPS = "array<struct<at:int,others:string>>"


def hashed(digests: bytes) -> bytes:
    """H of digests: sha256 of their lowercase hex texts, concatenated."""
    return hashlib.sha256(digests.hex().encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def position(level: int, index, n: int, top: int) -> np.ndarray:
    """Where nodes ``index`` of ``level`` stand in the log of ``n`` leaves and ``top`` levels, from 0.

    A complete node over leaves up to ``e`` stands after all nodes of its own level and below that
    end by ``e``, but itself, and those of higher levels that end before ``e``.
    Unfinished nodes, one a level at most, follow all complete ones, level by level.
    """
    end = (np.asarray(index, dtype=np.int64) + 1) * FAN**level
    before = sum(end // FAN**j if j <= level else (end - 1) // FAN**j for j in range(top + 1)) - 1
    complete = sum(n // FAN**j for j in range(top + 1))
    return np.where(end <= n, before, complete + sum(n % FAN**j != 0 for j in range(1, level)))


def subtree(leaves: list[bytes], levels: int) -> list[bytes]:
    """The nodes over ``leaves`` up to ``levels`` in the order in which they are complete; the last is the root."""
    log: list[bytes] = []
    runs: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def put(node: bytes, level: int) -> None:
        log.append(node)
        runs[level].append(node)
        if level < levels and len(runs[level]) == FAN:
            close(level)

    def close(level: int) -> None:
        run, runs[level] = runs[level], []
        put(hashed(b"".join(run)), level + 1)

    for leaf in leaves:
        put(leaf, 0)
    for level in range(levels):
        if runs[level]:
            close(level)
    return log


def siblings(index: int, count: int) -> tuple[int, int, int]:
    """For node ``index`` of ``count`` on a level: its place in its run, and the bounds of the run."""
    run = index // FAN * FAN
    return index - run, run, min(run + FAN, count)


def _ordered(group: pa.Table) -> tuple[list[bytes], int, int]:
    """Digests of a builder's nodes by rank, its tree's leaves, and the first rank."""
    group = group.sort_by("rank")
    return [bytes.fromhex(x) for x in group["digest"].to_pylist()], group["n"][0].as_py(), group["rank"][0].as_py()


def _block_builder(step: int) -> Callable:
    return lambda key, group: _build_block(step, key[0].as_py(), key[1].as_py(), group)


def _build_block(step: int, tree: str, block: int, group: pa.Table) -> pa.Table:
    """The log of an aligned block of leaves; its unfinished nodes stand apart, at the end of the tree's log."""
    leaves, n, rank = _ordered(group)
    top = height(n)
    levels = min(step, top)
    log = subtree(leaves, levels)
    whole = sum(len(leaves) // FAN**j for j in range(levels + 1))
    end = int(position(1, n // FAN, n, top)) if whole < len(log) else None
    row = (tree, block, n, int(position(0, rank, n, top)), b"".join(log[:whole]), end, b"".join(log[whole:]))
    return pa.table({name: pa.array([x], t) for (name, t), x in zip(_BLOCK_TYPES.items(), row)})


def _upper_builder(step: int, level: int) -> Callable:
    return lambda key, group: _build_above(step, level, key[0].as_py(), group)


def _build_above(step: int, level: int, tree: str, group: pa.Table) -> pa.Table:
    """The nodes that a later round's builder adds over nodes of ``level``."""
    below, n, rank = _ordered(group)
    top = height(n)
    levels = min(step, top - level)
    log, out = subtree(below, levels), []
    for j in range(1, levels + 1):
        index = np.arange(-(-len(below) // FAN**j))
        here = rank // FAN**j + index
        for i, p, at in zip(here, position(level + j, here, n, top), position(j, index, len(below), levels)):
            out.append((tree, n, level + j, int(i), int(p), log[int(at)].hex(), level + j == top))
    return pa.Table.from_batches([_batch(out, _NODE_TYPES)])


def _batch(rows: list[tuple], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], names=list(types))


def _block_roots(step: int) -> Callable:
    """Nodes that stand for whole blocks."""

    def run(batches):
        for b in batches:
            rows = []
            for tree, block, n, digests, loose in zip(*(b.column(c).to_pylist() for c in ("tree", "block", "n", "digests", "loose"))):
                top = height(n)
                level = min(step, top)
                rows.append((tree, n, level, block, int(position(level, block, n, top)), (loose or digests)[-32:].hex(), level == top))
            yield _batch(rows, _NODE_TYPES)

    return run


def append_logs(spark: SparkSession, leaves: DataFrame, name: str, step: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """The logs of ``leaves`` (tree, rank, n, digest): blocks, and the nodes from level ``step`` up (a lower root too).

    ``rank`` runs from 0 to n - 1 in each tree, and a builder adds ``step`` levels. A row of the first is one block: ``digests`` are its
    nodes from position ``first`` of the tree's log on, ``loose`` its unfinished ones from ``loose_first`` on.
    """
    block = F.floor(F.col("rank") / F.lit(FAN**step))
    blocks = leaves.select("tree", block.alias("block"), "n", "rank", "digest").groupBy("tree", "block").applyInArrow(_block_builder(step), BLOCKS)
    blocks = stage(spark, blocks, f"{name}-blocks")
    most = blocks.agg(F.max("n")).first()[0] or 0
    nodes = stage(spark, blocks.mapInArrow(_block_roots(step), NODES), f"{name}-nodes")
    level, last = step, nodes
    while most > FAN**level:
        below = last.where((F.col("level") == level) & ~F.col("root")).withColumn("block", block)
        last = stage(spark, below.groupBy("tree", "block").applyInArrow(_upper_builder(step, level), NODES), f"{name}-nodes")
        nodes, level = nodes.unionByName(last), level + step
    return blocks, nodes


def _addresses(step: int) -> Callable:
    """For every block and level above it: its place in the run, and the positions of its siblings."""

    def run(batches):
        for b in batches:
            rows = []
            for tree, block, n in zip(*(b.column(c).to_pylist() for c in ("tree", "block", "n"))):
                top = height(n)
                for level in range(step, top):
                    at, low, high = siblings(block // FAN ** (level - step), -(-n // FAN**level))
                    rows.append((tree, block, level, at, [int(p) for i, p in enumerate(position(level, np.arange(low, high), n, top)) if i != at]))
            yield _batch(rows, _ADDRESS_TYPES)

    return run


def block_steps(blocks: DataFrame, nodes: DataFrame, step: int = HEIGHT) -> DataFrame:
    """tree, block, steps: the proof of each block's root, from its level up to the tree's root."""
    wanted = blocks.select("tree", "block", "n").mapInArrow(_addresses(step), "tree string, block long, level int, at int, where array<long>")
    each = wanted.select("tree", "block", "level", "at", F.posexplode_outer("where").alias("nth", "pos"))
    logged = nodes.select(F.col("tree").alias("tree_"), F.col("pos").alias("pos_"), "digest")
    found = each.join(logged, (F.col("tree") == F.col("tree_")) & (F.col("pos") == F.col("pos_")), "left")
    own = F.array_sort(F.collect_list(F.struct("level", "at", "nth", "digest")))  # a run's siblings times the levels at most
    levels = F.array_sort(F.collect_set(F.struct("level", "at")))
    both = found.groupBy("tree", "block").agg(own.alias("own"), levels.alias("levels"))
    others = lambda v: F.array_join(F.transform(F.filter("own", lambda x: x["level"] == v["level"]), lambda x: x["digest"]), "")
    return both.select("tree", "block", F.transform("levels", lambda v: F.struct(v["at"].alias("at"), others(v).alias("others"))).alias("steps"))


def _extractor(step: int) -> Callable:
    return lambda leaves, block: _extract(step, leaves, block)


def _extract(step: int, leaves: pa.Table, block: pa.Table) -> pa.Table:
    """Each leaf's proof: siblings in the block's own log by their positions, then the block's steps."""
    got = block.to_pylist()[0]
    n, low = got["n"], got["block"] * FAN**step
    left = min(FAN**step, n - low)
    levels = min(step, height(n))
    log = (got["digests"] + (got["loose"] or b"")).hex()
    runs = []
    for level in range(levels):
        count = -(-left // FAN**level)
        spots = position(level, np.arange(count), left, levels)
        runs.append(["".join(log[64 * p : 64 * p + 64] for p in spots[i : i + FAN].tolist()) for i in range(0, count, FAN)])
    above = [(s["at"], s["others"]) for s in got["steps"] or []]
    ats, others, sizes = [], [], []
    for rank in leaves["rank"].to_pylist():
        own = rank - low
        for run in runs:
            at = own % FAN
            own //= FAN
            whole = run[own]
            ats.append(at)
            others.append(whole[: 64 * at] + whole[64 * at + 64 :])
        ats.extend(a for a, _ in above)
        others.extend(o for _, o in above)
        sizes.append(levels + len(above))
    steps = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays([pa.array(ats, pa.int32()), pa.array(others, pa.string())], names=["at", "others"]))
    return leaves.drop_columns(["block", "n", "rank"]).append_column("steps", steps)


def proofs(leaves: DataFrame, blocks: DataFrame, nodes: DataFrame, step: int = HEIGHT) -> DataFrame:
    """``leaves`` (tree, rank, n, digest and more) with steps instead of rank and n: each level's place in its run and the run's others."""
    above = block_steps(blocks, nodes, step).select(F.col("tree").alias("tree_"), F.col("block").alias("block_"), "steps")
    ready = blocks.join(above, (F.col("tree") == F.col("tree_")) & (F.col("block") == F.col("block_")), "left").select("tree", "block", "n", "digests", "loose", "steps")
    rows = leaves.withColumn("block", F.floor(F.col("rank") / F.lit(FAN**step)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema if f.name not in ("rank", "n"))
    return rows.groupBy("tree", "block").cogroup(ready.groupBy("tree", "block")).applyInArrow(_extractor(step), f"{fields}, steps {STEPS}")


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(steps, digest, lambda node, s: F.sha2(F.concat(F.substr(s["others"], F.lit(1), s["at"] * 64), node, F.substr(s["others"], s["at"] * 64 + 1)).cast("binary"), 256))


def ranked(spark: SparkSession, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with rank (from 0, within its tree by ``order``) and n, the tree's rows.

    One range shuffle sorts all rows; a rank is the place in the sorted partition
    and what earlier partitions hold of the tree, so no tree meets in one task.
    """
    rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = stage(spark, rows.withColumn("seq_", F.monotonically_increasing_id()), name)
    part = F.shiftright("seq_", 33)
    counts = placed.groupBy(F.col("tree").alias("tree_"), part.alias("part_")).agg(F.count(F.lit(1)).alias("here_"), F.min("seq_").alias("first_"))
    by = Window.partitionBy("tree_")  # a row for each partition and tree in it
    before = F.coalesce(F.sum("here_").over(by.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stage(spark, counts.select("tree_", "part_", "first_", before.alias("before_"), F.sum("here_").over(by).alias("n")), f"{name}-counts")
    both = placed.join(counts, (F.col("tree") == F.col("tree_")) & (part == F.col("part_")))
    return both.withColumn("rank", F.col("before_") + F.col("seq_") - F.col("first_")).drop("tree_", "part_", "first_", "before_", "seq_")


def field(c: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def manifest(spark: SparkSession, rows: DataFrame, group: str, key: str, digest: Column, more: dict[str, Column] | None = None, step: int = HEIGHT) -> DataFrame:
    """``key``, leaf, ``more``, subroot, root and steps of every row of ``rows``.

    ``digest``: the row's leaf, lowercase hex. Leaves of a ``group`` (null is a group too) ascend by ``key``,
    null first, and rows with equal keys by leaf; equal rows are leaves each.
    Groups stand null first, then by their UTF-8 bytes. ``steps`` is the proof from
    the leaf to the root; ``folded`` goes up it. An empty table gives no rows.
    Only the columns that the expressions name are read, so others can't clash.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(tree.alias("tree"), F.col(key).alias("key_"), digest.alias("digest"), *[v.alias(f"more_{k}") for k, v in (more or {}).items()])
    leaves = ranked(spark, leaves, ["key_", "digest"], "manifest-leaves")
    blocks, nodes = append_logs(spark, leaves, "manifest", step)
    roots = nodes.where("root").select("tree", F.col("digest").alias("subroot"))
    upper = ranked(spark, roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("digest")), ["name"], "manifest-roots")
    top_blocks, top_nodes = append_logs(spark, upper, "manifest-top", step)
    top = top_nodes.where("root").select("tree", F.col("digest").alias("root"))
    ends = proofs(upper, top_blocks, top_nodes, step).join(top, "tree").select(F.col("name").alias("tree_"), F.col("digest").alias("subroot"), "root", F.col("steps").alias("last"))
    ends = stage(spark, ends, "manifest-ends")  # a row for each group
    proven = proofs(leaves, blocks, nodes, step).join(ends, F.col("tree") == F.col("tree_"))
    return proven.select(F.col("key_").alias(key), F.col("digest").alias("leaf"), *[F.col(f"more_{k}").alias(k) for k in more or {}], "subroot", "root", F.concat("steps", "last").alias("steps"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    leaf = lambda text: F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)).cast("binary"), 256)
    tampered = F.when(F.col("doc_id").isNotNull() & (fold("doc_id", 3) == 0), leaf(F.translate("text", upper, lower)))
    made = manifest(spark, docs, "lang", "doc_id", leaf(F.col("text")), {"tampered": tampered})
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: s["others"]), "").cast("binary"), 256)
    made = made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def _op12_sql(levels: int = 12, top_levels: int = 4) -> str:
    """SQL with a step for each level: trees of up to 8 ** ``levels`` leaves, 8 ** ``top_levels`` languages."""
    item = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(item(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {item(text)})"
    shift = "CASE WHEN {c} & 1 = 1 THEN xor(3988292384, {c} >> 1) ELSE {c} >> 1 END"
    parts = [
        "crc_rows AS (SELECT i, " + "8 AS k, i AS c FROM range(256) t(i)), " + ", ".join(f"crc_{k} AS (SELECT i, {shift.format(c='c')} AS c FROM crc_{k - 1 if k else 'rows'})" for k in range(8)),
        "crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_7)",
        f"""docs AS (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS changed,
           xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 3 = 0 AS bad FROM documents, crc_table)""",
        "l0 AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, leaf AS h FROM docs)",
        "p0 AS (SELECT doc_id, lang, leaf, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, CASE WHEN bad THEN changed ELSE leaf END AS f, '' AS proof FROM docs)",
    ]

    def up(j: int, by: str, l: str, p: str) -> list[str]:
        return [
            f"r{l}{j} AS MATERIALIZED (SELECT {by}, i // 8 AS r, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {l}{j} GROUP BY {by}, i // 8)",
            f"{l}{j + 1} AS MATERIALIZED (SELECT {by}, r AS i, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE 1 END AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM r{l}{j})",
            f"""{p}{j + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (i, f, proof), i // 8 AS i,
              CASE WHEN n > 1 THEN sha256(array_to_string(hs[1:i % 8], '') || f || array_to_string(hs[i % 8 + 2:], '')) ELSE f END AS f,
              CASE WHEN n > 1 THEN proof || array_to_string(hs[1:i % 8], '') || array_to_string(hs[i % 8 + 2:], '') ELSE proof END AS proof
              FROM {p}{j} p JOIN r{l}{j} r ON p.{by} IS NOT DISTINCT FROM r.{by} AND p.i // 8 = r.r)""",
        ]

    for j in range(levels):
        parts += up(j, "lang", "l", "p")
    parts.append(f"t0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, lang FROM l{levels})")
    parts.append(f"q0 AS (SELECT p.doc_id, 0 AS g, p.leaf, t.h AS subroot, t.i, p.f, p.proof FROM p{levels} p JOIN t0 t ON p.lang IS NOT DISTINCT FROM t.lang)")
    for j in range(top_levels):
        parts += up(j, "g", "t", "q")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM q{top_levels} q JOIN t{top_levels} t USING (g)"""


OP12_SQL = _op12_sql()
