"""Joins on time and on distance, made equi-joins by buckets and cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import EARTH_RADIUS_M, haversine_m
from waymark.operators.points import micros


def points_in_intervals(intervals: DataFrame, points: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """Each interval (user_id, hint_id, start, end) with each ping inside, bounds inclusive; intervals may overlap."""
    width = bucket_s * 1_000_000
    first, last = F.floor(micros(F.col("start")) / width), F.floor(micros(F.col("end")) / width)
    spans = intervals.withColumn("bucket_", F.explode(F.sequence(first, F.greatest(first, last))))
    placed = points.withColumn("bucket_", F.floor(micros(F.col("ts")) / width))
    return spans.join(placed, ["user_id", "bucket_"]).where("ts >= start and ts <= end").drop("bucket_")


def coverage_intervals(spans: DataFrame, pad_s: int = 60) -> DataFrame:
    """Disjoint intervals of each user: spans that overlap or lie within ``pad_s`` are merged."""
    before = Window.partitionBy("user_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(before)
    new = F.when(reach.isNull() | (micros(F.col("start")) > micros(reach) + pad_s * 1_000_000), 1).otherwise(0)
    upto = Window.partitionBy("user_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    islands = spans.withColumn("new_", new).withColumn("island", F.sum("new_").over(upto))
    return islands.groupBy("user_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def points_outside_intervals(points: DataFrame, covered: DataFrame) -> DataFrame:
    """Pings that no interval of ``covered`` (disjoint) holds: one sort, no range join."""
    both = points.withColumns({"end_": F.lit(None).cast("timestamp_ntz"), "is_ping_": F.lit(True)}).unionByName(
        covered.select("user_id", F.col("start").alias("ts"), F.col("end").alias("end_"), F.lit(False).alias("is_ping_")), allowMissingColumns=True)
    w = Window.partitionBy("user_id").orderBy("ts", "is_ping_").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last("end_", ignorenulls=True).over(w)
    return both.withColumn("until_", seen).where(F.col("is_ping_") & (F.col("until_").isNull() | (F.col("ts") > F.col("until_")))).select(*points.columns)


def asof_both(left: DataFrame, right: DataFrame, values: list[str]) -> DataFrame:
    """Each left row (user_id, ts) with ``before`` (last right row at or before) and ``after`` (first one later): structs of ts and values."""
    tag = F.struct("ts", *values)
    # Each side looks back only, in one order of time or the other: a running frame costs a step a row.
    both = left.withColumns({"r_": F.lit(None).cast(right.select(tag.alias("t")).schema["t"].dataType), "is_left_": F.lit(1)}).unionByName(
        right.select("user_id", "ts", tag.alias("r_"), F.lit(0).alias("is_left_")), allowMissingColumns=True)
    back = Window.partitionBy("user_id").orderBy("ts", "is_left_", "r_").rowsBetween(Window.unboundedPreceding, 0)
    # At equal times the left row comes first, so that what is after it is later.
    ahead = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("is_left_"), F.desc("r_")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("before", F.last("r_", ignorenulls=True).over(back)).withColumn("after", F.last("r_", ignorenulls=True).over(ahead))
    return found.where("is_left_ = 1").select(*left.columns, "before", "after")


def nearest_in_time(left: DataFrame, right: DataFrame, values: list[str], tolerance_s: float) -> DataFrame:
    """Left rows (user_id, ts) with ``nearest``, the right row (ts, values) nearest in time, and ``apart_s``, where that is at most ``tolerance_s``; of two as near the earlier one."""
    both = asof_both(left, right, values)
    apart = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(micros(F.col("ts")) - micros(F.col(f"{c}.ts"))).alias("d"), F.lit(c == "after").alias("later"), F.col(c).alias("r")))
    near = both.withColumn("near_", F.least(apart("before"), apart("after"))).where(F.col("near_.d") <= tolerance_s * 1e6)
    return near.select(*left.columns, F.col("near_.r").alias("nearest"), (F.col("near_.d") / 1e6).alias("apart_s"))


def near_in_time(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, tolerance_s: int) -> DataFrame:
    """Pairs of one user within ``tolerance_s``: buckets twice as wide, the right side in its own and both neighbours'."""
    width = 2 * tolerance_s * 1_000_000
    around = F.array_distinct(F.array(*[F.floor((micros(F.col(right_ts)) + d * tolerance_s * 1_000_000) / width) for d in (-1, 1)]))
    placed = right.withColumn("bucket_", F.explode(around))
    found = left.withColumn("bucket_", F.floor(micros(F.col(left_ts)) / width)).join(placed, ["user_id", "bucket_"])
    return found.where(F.abs(micros(F.col(left_ts)) - micros(F.col(right_ts))) <= tolerance_s * 1_000_000).drop("bucket_")


def eps_pairs(points: DataFrame, eps_m: float, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """(keys, a, b) with a < b of points (keys, id, lat, lon) at most ``eps_m`` apart.

    Bands of latitude as high as eps; within one, cells wide enough for the
    band's end nearer to the pole, so neighbours lie in the 3 x 3 cells around;
    the last cell of a band is beside its first, across the date line.
    """
    step = math.degrees(eps_m / EARTH_RADIUS_M)
    row = F.floor((F.col("lat") + 90) / step)

    def cells(band):
        """How many cells the band has; one where it touches a pole."""
        edge = F.greatest(F.abs((band * step) - 90), F.abs(((band + 1) * step) - 90)) + step
        return F.when(edge >= 89.9, F.lit(1).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(360 * F.cos(F.radians(edge)) / step)))

    column = lambda n, lon: F.pmod(F.floor((lon + 180) / (360 / n)), n)
    home = points.select(*keys, F.col("id").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), row.alias("band_")).withColumn("cell_", column(cells(F.col("band_")), F.col("lon_a")))
    # The other side stands in the bands around its own, in each by that band's step, and the cells beside.
    around = points.select(*keys, F.col("id").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.explode(F.sequence(row - 1, row + 1)).alias("band_")).withColumn("n_", cells(F.col("band_")))
    beside = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(column(F.col("n_"), F.col("lon_b")) + d, F.col("n_"))))
    around = around.withColumn("cell_", F.explode(beside)).drop("n_")
    met = home.join(around, [*keys, "band_", "cell_"]).where("a < b")
    d = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return met.where(d <= eps_m).select(*keys, "a", "b", d.alias("metres")).distinct()


def without_overlap(spans: DataFrame, moves: DataFrame, key: str, bucket_s: int = 86_400) -> DataFrame:
    """Spans (user_id, ``key``, start, end) that no move of the user (start, end) overlaps; touching ends don't count."""
    width = bucket_s * 1_000_000
    buckets = F.explode(F.sequence(F.floor(micros(F.col("start")) / width), F.floor(micros(F.col("end")) / width)))
    placed = moves.withColumn("bucket_", buckets).select("user_id", "bucket_", F.col("start").alias("from_"), F.col("end").alias("to_"))
    hit = spans.withColumn("bucket_", buckets).join(placed, ["user_id", "bucket_"]).where("from_ < end and to_ > start")
    return spans.join(hit.select("user_id", key).distinct(), ["user_id", key], "left_anti")
