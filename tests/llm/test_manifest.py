"""Merkle logs against trees built plainly in Python; SQL over the tables is the driver's."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from waymark.llm import manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def proof_of(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i // 8 * 8
        out.append((i - run, "".join(x for j, x in enumerate(nodes[run : run + 8]) if run + j != i)))
        i //= 8
    return out


def log_of(levels):
    """Nodes in the order in which they are complete: a node once all leaves below it are there, unfinished ones at the end."""
    n = len(levels[0])
    when = [((i + 1) * 8**j if (i + 1) * 8**j <= n else n + 1, j, x) for j, nodes in enumerate(levels) for i, x in enumerate(nodes)]
    return [x for _, _, x in sorted(when, key=lambda w: w[:2])]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 73, 511, 513, 600])
def test_positions_follow_from_sizes(n):
    levels = levels_of([sha(str(i)) for i in range(n)])
    log, top = log_of(levels), manifest.height(n)
    assert top == len(levels) - 1
    for j, nodes in enumerate(levels):
        assert [log[p] for p in manifest.position(j, range(len(nodes)), n, top)] == nodes
    assert [x.hex() for x in manifest.subtree([bytes.fromhex(x) for x in levels[0]], top)] == log


def rows_of(n, seed):
    rnd = random.Random(seed)
    return [(rnd.choice([None, i, i, i // 3]), rnd.choice([None, "", "x", "x", "x", "\u00e9", f"g{i % 40}"]), rnd.choice([None, "", f"t{i}", "same", "y" * 9000])) for i in range(n)]


def brute(rows):
    leaves = {}
    for key, group, text in rows:
        leaves.setdefault(group, []).append((key is not None, key or 0, sha("-" if text is None else f"{len(text.encode())}:{text}")))
    order = sorted(leaves, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(leaves[g])]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (known, key, leaf) in enumerate(sorted(leaves[g])):
            out.append((key if known else None, leaf, trees[g][-1][0], top[-1][0], proof_of(trees[g], i) + proof_of(top, k)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "levels"), [(0, 4), (1, 4), (300, 4), (700, 1), (900, 2)])
def test_proofs_of_all_leaves(spark, n, levels):
    """With builders of few levels there are several rounds of them."""
    rows = rows_of(n, n)
    docs = spark.createDataFrame([(*r, 1, "d", 2) for r in rows], "doc_id long, lang string, text string, tree int, digest string, rank int")
    made = manifest.manifest(spark, docs, "lang", "doc_id", F.sha2(manifest.field(F.col("text")), 256), step=levels)
    got = made.withColumn("folded", manifest.folded(F.col("leaf"), F.col("steps"))).collect()
    assert all(r["folded"] == r["root"] for r in got)
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["at"], s["others"]) for s in r["steps"]]) for r in got), key=repr) == brute(rows)


def test_log_is_whole_and_without_gaps(spark):
    n = 601
    digests = [sha(str(i)) for i in range(n)]
    leaves = spark.createDataFrame([("t", i, n, d) for i, d in enumerate(digests)], "tree string, rank long, n long, digest string")
    blocks, nodes = manifest.append_logs(spark, leaves, "test", 1)
    log = {}
    for b in blocks.collect():
        for first, data in ((b["first"], b["digests"]), (b["loose_first"], b["loose"])):
            for i in range(len(data or b"") // 32):
                log[first + i] = bytes(data[32 * i : 32 * i + 32]).hex()
    log |= {r["pos"]: r["digest"] for r in nodes.collect()}
    want = log_of(levels_of(digests))
    assert [log[i] for i in range(len(log))] == want


def test_changed_leaf_does_not_verify(spark):
    docs = spark.createDataFrame([(i, "l", f"t{i}") for i in range(20)], "doc_id long, lang string, text string")
    made = manifest.manifest(spark, docs, "lang", "doc_id", F.sha2(manifest.field(F.col("text")), 256))
    assert made.where(manifest.folded(F.sha2(F.lit("other"), 256), F.col("steps")) == F.col("root")).count() == 0
