"""Mixing sources to target weights by hash-threshold histograms.

Each unit (the rows of a source with the same key hash) gets a fixed 60-bit
hash. A source that has to give ``r`` more words takes its units in hash order
while the middle of the unit lies within ``r``. The order is never sorted:
words are summed by (source, hash bucket), the one bucket in which the budget
ends is refined by the next hash digits, and the resulting threshold is a filter.

All steps are DataFrame expressions. What is shuffled is one row for each
source, bucket and map task; the refinements read only the boundary buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import stage

DIGIT_BITS = 12
HASH_BITS = 60


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def key_hash(key: Column) -> Column:
    """60 bits of the md5 of the key's text; a null key counts as an empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, max_repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size -> with target: the shares of the total by weight.

    Sources by code point, null last, weigh ``weights`` in turn. No target is
    above ``max_repeat`` times its source's size; the excess goes to the others
    by weight until none is above, which is the water level ``level`` with
    target = min(cap, level * weight). One row for each source is sorted here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_repeat)
    s = s.withColumns({
        "total": F.sum("source_size").over(every), "weights": F.sum("weight").over(every),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # The level if all sources before this one are capped; right for the first one that it doesn't cap.
    s = s.withColumn("level", (F.col("total") - F.col("capped")).cast("double") / (F.col("weights") - F.col("gone")).cast("double"))
    right = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), "level"))
    s = s.withColumn("best", F.min(right).over(every)["level"])
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("best") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def thresholds(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source the first hash that is not taken once more.

    ``sized``: source, h, size. Three refinements: two hash digits, then the
    values themselves; only rows of the boundary bucket are read for the next.
    """
    size = F.nullif(F.col("source_size"), F.lit(0))
    found = sources.withColumns({
        "rest": F.coalesce(F.col("target") - F.floor(F.col("target") / size) * size, F.lit(0.0)),
        "low": F.lit(0).cast("long"), "before": F.lit(0).cast("long"),
    })
    for level in range(3):
        width = HASH_BITS - DIGIT_BITS * (level + 1) if level < 2 else 0
        span = HASH_BITS - DIGIT_BITS * level
        bound = found.select(F.col("source").alias("s_"), "rest", "low", "before")
        rows = sized.join(bound, F.col("source").eqNullSafe(F.col("s_")) & (F.shiftright("h", span) == F.shiftright("low", span)) & (F.col("rest") > 0))
        bucket = F.shiftleft(F.shiftright("h", width), width)
        sums = rows.groupBy("source", bucket.alias("low")).agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("before").alias("outer"))
        upto = Window.partitionBy("source").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("outer") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
        if width:  # the budget ends in the bucket with before <= rest < before + size
            ends = (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest"))
            found = sums.where(ends).groupBy("source").agg(F.min("low").alias("low"), F.min_by("before", "low").alias("before"), F.first("rest").alias("rest"))
        else:  # among single values, the first whose middle is beyond the budget, or else what follows the last
            beyond = F.when(2 * F.col("before") + F.col("size") > 2 * F.col("rest"), F.col("low"))
            found = sums.groupBy("source").agg(F.coalesce(F.min(beyond), F.max("low") + 1).alias("low"))
    return found.select(F.col("source").alias("s_"), F.col("low").alias("threshold"))


def plan(spark: SparkSession, sized: DataFrame, max_repeat: int, weights: tuple[int, ...]) -> DataFrame:
    """mix_source_, source_size, target, and what a source's rows are taken by: times, and once more below threshold."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stage(spark, targets(sources, max_repeat, weights), "mix-targets")
    cuts = stage(spark, thresholds(sized.select("source", "h", "size"), sources), "mix-cuts")
    times = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    return sources.join(cuts, F.col("source").eqNullSafe(F.col("s_")), "left").select(
        F.col("source").alias("mix_source_"), "source_size", "target", times.alias("mix_times_"), F.coalesce("threshold", F.lit(0).cast("long")).alias("mix_threshold_"),
    )


def copies(h: Column) -> Column:
    return F.col("mix_times_") + (h < F.col("mix_threshold_")).cast("long")


def sizes(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame:
    sized = docs.select(F.col(key), F.col("source"), word_count(F.col("text")).alias("size"), key_hash(F.col(key)).alias("h"))
    return stage(spark, sized, "mix-sizes")


def mix(spark: SparkSession, docs: DataFrame, key: str = "doc_id", max_repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``key``, source, size, source_size, target, copies of every row of ``docs``.

    ``copies`` is how often the mix takes the row: as often as the source's
    target holds the whole source, and once more below the hash threshold. The
    words taken from a source differ from its target by half a unit at most.
    Rows of one source with equal keys stand or fall together. A null text has
    no words, an empty table gives no rows, and other columns are not read.
    """
    sized = sizes(spark, docs, key)
    found = plan(spark, sized, max_repeat, weights)
    both = sized.join(found, F.col("source").eqNullSafe(F.col("mix_source_")))
    return both.select(key, "source", "size", "source_size", "target", copies(F.col("h")).alias("copies"))


def mixed(spark: SparkSession, docs: DataFrame, key: str = "doc_id", max_repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns as they are.

    Only the plan, a row for each source, meets the texts: none is shuffled.
    """
    found = plan(spark, sizes(spark, docs, key), max_repeat, weights).select("mix_source_", "mix_times_", "mix_threshold_")
    both = docs.join(found, F.col("source").eqNullSafe(F.col("mix_source_")))
    taken = F.explode(F.array_repeat(F.lit(0), copies(key_hash(F.col(key))).cast("int"))).alias("mix_copy_")
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], taken).drop("mix_copy_")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.llm.common import table

    docs = table(spark, sf_dir, "documents")
    return mix(spark, docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM s),
x AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER b, 0) AS capped, coalesce(sum(weight) OVER b, 0) AS gone,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS rn
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - capped)::DOUBLE / (weights - gone)::DOUBLE AS level FROM x),
b AS (SELECT arg_min(level, rn) AS best FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap::DOUBLE, best * weight) AS target FROM l, b),
u AS (SELECT source, h, sum(size)::BIGINT AS usize FROM d GROUP BY source, h),
c AS (SELECT source, h, usize, coalesce(sum(usize) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
k AS (SELECT t.source, t.source_size, t.target, c.h,
        floor(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) AS times,
        2 * c.before + c.usize <= 2 * (t.target - floor(t.target / nullif(t.source_size, 0)) * t.source_size) AS more
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT d.doc_id, d.size, k.source_size, k.target,
       ((k.times + CASE WHEN k.more AND k.source_size > 0 THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN k ON d.h = k.h AND d.source IS NOT DISTINCT FROM k.source
"""
