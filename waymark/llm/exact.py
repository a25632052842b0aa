"""Exact duplicates by a sort of contents.

Rows are put into ranges of (leading bytes, hash of the whole text) by Spark's
sampled splitters, whose keys are short however long the texts are, and each
range is sorted externally by the bytes of the texts. Equal texts are then
neighbours, and a text starts a new run where it differs, compared in full,
from the one before it. The hash only keeps texts with a common beginning
apart; no two texts are taken for equal by it.

A text that holds more than a thousandth of all rows or bytes is dealt out
over as many sorted runs as it holds thousandths, so all such runs together
are a few thousand at most; their heads are compared once more and merged.
All steps are DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import stage, table

#: Leading bytes that the ranges are told apart by.
LEADING = 24
#: A text with more than one of so many equal shares of the rows or the bytes is split.
SHARES = 1000


def _hot(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """hot_hash, hot_runs of the hashes with more than a share: at most 2 * ``SHARES`` rows."""
    sums = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content").cast("long") + 1).alias("size"))
    sums = stage(spark, sums, "exact-hashes")
    whole = sums.agg(F.sum("n"), F.sum("size")).first()
    shares = F.greatest(F.col("n") / F.lit(whole[0] or 1), F.col("size") / F.lit(whole[1] or 1)) * SHARES
    return sums.where((F.col("n") > 1) & (shares > 1)).select(F.col("hash").alias("hot_hash"), F.ceil(shares).alias("hot_runs"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = lambda x: x, largest: bool = True) -> DataFrame:
    """``key``, keep_id, group_size, kept, text_sha256 of every row of ``docs``.

    Rows are equal whose texts are, after ``normalise``, the same bytes. Of
    equal rows that with the largest ``key`` stays (with ``largest=False`` the
    smallest); of rows that repeat this key too, one stays. A null text counts
    as empty; a null key stays only where all keys of its group are null, and
    rows without a key are not dealt out further. An empty table gives no rows,
    and other columns are neither read nor returned.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(normalise(F.col(text)), F.lit("")).alias("content")).withColumn("hash", F.xxhash64("content"))
    hot = _hot(spark, rows)
    dealt = (
        rows.join(F.broadcast(hot), F.col("hash") == F.col("hot_hash"), "left")
        .withColumn("deal", F.when(F.col("hot_runs").isNotNull(), F.pmod(F.xxhash64("key", F.lit("deal")), F.col("hot_runs"))).otherwise(F.lit(-1)).cast("long"))
        .withColumn("leading", F.substring(F.col("content").cast("binary"), 1, LEADING))
        .select("key", "content", "leading", "hash", "deal")
    )
    place = ["leading", "hash", "deal"]
    first = F.col("key").desc_nulls_last() if largest else F.col("key").asc_nulls_last()
    order = Window.partitionBy(*place).orderBy("content", first)
    run = Window.partitionBy(*place, "run")
    before = F.lag("content").over(order)
    sorted_rows = (
        dealt.repartitionByRange(*place)
        .withColumn("starts", before.isNull() | (before != F.col("content")))
        .withColumn("run", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("text_sha256", F.sha2("content", 256))
        .withColumn("head", F.when(F.col("starts") & (F.col("deal") >= 0), F.col("content")))
        .drop("content")
        .withColumn("keep_id", F.first("key").over(run.orderBy(first)))
        .withColumn("nth", F.row_number().over(run.orderBy(first)))
        .withColumn("group_size", F.count(F.lit(1)).over(run))
    )
    found = stage(spark, sorted_rows.drop("starts"), "exact-runs")
    best = F.max if largest else F.min
    heads = found.where(F.col("head").isNotNull()).select(*place, "head", "run", "keep_id", "group_size")
    same = Window.partitionBy("hash", "head")
    winner = F.row_number().over(same.orderBy(F.col("keep_id").desc_nulls_last() if largest else F.col("keep_id").asc_nulls_last(), "deal", "run")) == 1
    at = [*place, "run"]
    merged = heads.select(
        *[F.col(c).alias(f"{c}_") for c in at],
        best("keep_id").over(same).alias("all_keep"), F.sum("group_size").over(same).alias("all_size"), winner.alias("wins"),
    )
    both = found.join(F.broadcast(merged), [F.col(c) == F.col(f"{c}_") for c in at], "left")
    split = F.col("all_size").isNotNull()
    return both.select(
        F.col("key").alias(key), F.when(split, F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("all_size", "group_size").alias("group_size"),
        ((F.col("nth") == 1) & F.coalesce("wins", F.lit(True))).alias("kept"), "text_sha256",
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, table(spark, sf_dir, "documents"))


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
