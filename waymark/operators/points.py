"""Operators on pings: user_id, ts, lat, lon and whatever else, ordered by (ts, tie)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.aggregates import nearest_rank
from waymark.functions.geo import centroid, haversine_m, point_dedup_key


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / 1e6


def in_order(*tie: str):
    return Window.partitionBy("user_id").orderBy("ts", *tie)


def first_stored(points: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """One ping of each dedup key: the first in ``order``. Where the source names its pings, ``keys`` are these names, and no dedup key is made: two pings of one second and place stay two."""
    if keys is None:
        # Users are in the key already; as columns they can be counted without all else. The key's bytes are half as long as its text.
        keyed, group = points.withColumn("dedup_key", F.unhex(point_dedup_key(F.col("user_id"), F.col("ts"), F.col("lat"), F.col("lon")))), ["user_id", "dedup_key"]
    else:
        keyed, group = points, keys
    rest = [c for c in (*order, *[c for c in keyed.columns if c not in order]) if c not in group]
    first = keyed.groupBy(*group).agg(F.min(F.struct(*rest)).alias("b")).select(*group, "b.*") if rest else keyed.distinct()
    return first.select(*[F.lower(F.hex(c)).alias(c) if keys is None and c == "dedup_key" else F.col(c) for c in keyed.columns])


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``existing`` and those rows of ``incoming`` whose keys are new, one of each: the first in ``order``, else any."""
    new = incoming.join(existing.select(*keys), keys, "left_anti").select(*incoming.columns)
    if order is None:
        return existing.unionByName(new.dropDuplicates(keys))
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("r_")).select("r_.*")
    return existing.unionByName(first)


def prefer_accurate(points: DataFrame, keys: list[str], load_order: str) -> DataFrame:
    """Of pings with equal keys the most accurate: measured before unknown, smaller first, then the first loaded."""
    w = Window.partitionBy(*keys).orderBy(F.col("accuracy_m").asc_nulls_last(), load_order)
    return points.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")


def split_by_gap(points: DataFrame, gap_s: float, *tie: str) -> DataFrame:
    """``run``: counts up at every gap of more than ``gap_s``."""
    w = in_order(*tie)
    new = F.coalesce((seconds_between(F.lag("ts").over(w), F.col("ts")) > gap_s).cast("int"), F.lit(0))
    return points.withColumn("new_", new).withColumn("run", F.sum("new_").over(w)).drop("new_")


def segment_speeds(points: DataFrame, *tie: str, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """speed_mps to each ping from the one before; null for the first and where no time passes."""
    w = Window.partitionBy(*keys).orderBy("ts", *tie)
    dt = seconds_between(F.lag("ts").over(w), F.col("ts"))
    d = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.withColumns({"step_m": d, "speed_mps": F.when(dt > 0, d / dt)})


def path_metrics(points: DataFrame, *tie: str, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """path_m, straightness (direct / along), median and p95 speed of each track."""
    order = F.struct("ts", *tie)
    got = segment_speeds(points, *tie, keys=keys).groupBy(*keys).agg(
        F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("path_m"), nearest_rank(F.col("speed_mps"), 0.5).alias("speed_median_mps"), nearest_rank(F.col("speed_mps"), 0.95).alias("speed_p95_mps"),
        F.min_by(F.struct("lat", "lon"), order).alias("a"), F.max_by(F.struct("lat", "lon"), order).alias("b"), F.count("*").alias("points"),
    )
    direct = haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return got.withColumn("straightness", F.when(F.col("path_m") > 0, F.least(F.lit(1.0), direct / F.col("path_m")))).drop("a", "b")


def elevation_gain(points: DataFrame, *tie: str) -> DataFrame:
    """gain_m of each user: the sum of rises between known altitudes, null where none is known."""
    last = F.last("altitude_m", ignorenulls=True).over(in_order(*tie).rowsBetween(Window.unboundedPreceding, -1))
    rise = F.greatest(F.lit(0.0), F.col("altitude_m") - last)
    rise = F.when(F.col("altitude_m").isNotNull(), F.coalesce(F.when(last.isNotNull(), rise), F.lit(0.0)))
    return points.withColumn("rise_", rise).groupBy("user_id").agg(F.sum("rise_").alias("gain_m"))


def altitude_index(points: DataFrame) -> DataFrame:
    """The greatest altitude of each user and hour."""
    hour = F.floor(micros(F.col("ts")) / 3_600_000_000).alias("hour")
    return points.groupBy("user_id", hour).agg(F.max("altitude_m").alias("altitude_m"))


def sample_evenly(rows: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """At most about ``n`` rows of each key, every so many in ``order``."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumns({"i_": F.row_number().over(w.orderBy(*order)) - 1, "n_": F.count("*").over(w)})
    return numbered.where(F.col("i_") % F.greatest(F.lit(1), F.floor(F.col("n_") / n)) == 0).drop("i_", "n_")


def centres(points: DataFrame, keys: list[str]) -> DataFrame:
    """Spherical centre, radius (the farthest member) and number of each group."""
    lat, lon = centroid(F.col("lat"), F.col("lon"))
    centre = points.groupBy(*keys).agg(lat.alias("c_lat"), lon.alias("c_lon"))
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    return points.join(centre, keys).groupBy(*keys).agg(F.first("c_lat").alias("lat"), F.first("c_lon").alias("lon"), F.max(d).alias("radius_m"), F.count("*").alias("points"))
