"""Older exports: raw point records and monthly semantic segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geo import is_valid_coord
from waymark.sources.timeline import instant

RECORDS = "locations array<struct<latitudeE7: bigint, longitudeE7: bigint, timestamp: string, timestampMs: string, accuracy: double, altitude: double>>"
_AT = "struct<latitudeE7: bigint, longitudeE7: bigint, placeId: string, name: string>"
_SPAN = "struct<startTimestamp: string, startTimestampMs: string, endTimestamp: string, endTimestampMs: string>"
SEGMENTS = (
    f"timelineObjects array<struct<placeVisit: struct<location: {_AT}, duration: {_SPAN}>, "
    f"activitySegment: struct<startLocation: {_AT}, endLocation: {_AT}, duration: {_SPAN}, distance: double, activityType: string, waypointPath: struct<waypoints: array<struct<latE7: bigint, lngE7: bigint>>>>>>"
)
#: Activity types of the segments and their travel modes.
SEGMENT_MODES = {
    "WALKING": "walk", "ON_FOOT": "walk", "HIKING": "walk", "RUNNING": "run", "CYCLING": "bike", "IN_PASSENGER_VEHICLE": "car", "IN_VEHICLE": "car", "MOTORCYCLING": "car",
    "IN_BUS": "transit", "IN_TRAIN": "transit", "IN_SUBWAY": "transit", "IN_TRAM": "transit", "IN_FERRY": "transit", "FLYING": "flight",
}


def when(text: Column, millis: Column | None = None) -> Column:
    """An instant in UTC of an ISO time, or of milliseconds written as a number."""
    ms = F.coalesce(text, millis) if millis is not None else text
    return F.when(ms.rlike(r"^\d+$"), F.timestamp_millis(ms.try_cast("bigint")).cast("timestamp_ntz")).otherwise(instant(ms))


def point_records(records: DataFrame, accuracy_max_m: float = 500.0) -> tuple[DataFrame, DataFrame]:
    """Pings of ``locations``, and why others were skipped (reason, count)."""
    r = records.select(F.explode("locations").alias("r")).select((F.col("r.latitudeE7") / 1e7).alias("lat"), (F.col("r.longitudeE7") / 1e7).alias("lon"), when(F.col("r.timestamp"), F.col("r.timestampMs")).alias("ts"), F.col("r.accuracy").alias("accuracy_m"), F.col("r.altitude").alias("altitude_m"))
    whole = F.col("ts").isNotNull() & F.coalesce(is_valid_coord(F.col("lat"), F.col("lon")), F.lit(False))
    r = r.withColumn("reason", F.when(~whole, "records_incomplete").when(F.col("accuracy_m") > accuracy_max_m, "accuracy_filtered"))
    return r.where("reason is null").drop("reason"), r.where("reason is not null").groupBy("reason").agg(F.count("*").alias("count"))


def read_point_records(spark: SparkSession, path: str, accuracy_max_m: float = 500.0) -> tuple[DataFrame, DataFrame]:
    """``point_records`` of files: one JSON object each, or lines of them, which a large one should be split into first."""
    return point_records(spark.read.schema(RECORDS).json(path, multiLine=True), accuracy_max_m)


def _spot(at: Column) -> Column:
    lat, lon = at["latitudeE7"] / 1e7, at["longitudeE7"] / 1e7
    return F.when(is_valid_coord(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))


def semantic_segments(records: DataFrame) -> dict[str, DataFrame]:
    """places, tracks and skipped (reason, count) of ``timelineObjects``.

    Two waypoints or more replace the ends of a movement, and its quality is full.
    """
    o = records.select(F.explode("timelineObjects").alias("o")).select("o.placeVisit", "o.activitySegment")
    span = lambda d: (when(d["startTimestamp"], d["startTimestampMs"]).alias("start"), when(d["endTimestamp"], d["endTimestampMs"]).alias("end"))
    v = o.where("placeVisit is not null").select(*span(F.col("placeVisit.duration")), F.col("placeVisit.location").alias("l"))
    known = F.col("l.latitudeE7").isNotNull() & F.col("l.longitudeE7").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    v = v.withColumn("at", _spot(F.col("l"))).withColumn("reason", F.when(~known, "place_visit_incomplete").when(F.col("at").isNull(), "place_visit_invalid_coord"))
    s = o.where("activitySegment is not null").select(*span(F.col("activitySegment.duration")), "activitySegment.*").drop("duration")
    way = F.filter(F.transform("waypointPath.waypoints", lambda w: F.struct((w["latE7"] / 1e7).alias("lat"), (w["lngE7"] / 1e7).alias("lon"))), lambda p: F.coalesce(is_valid_coord(p["lat"], p["lon"]), F.lit(False)))
    ends = F.filter(F.array(_spot(F.col("startLocation")), _spot(F.col("endLocation"))), lambda p: p.isNotNull())
    full = F.coalesce(F.size("way") >= 2, F.lit(False))
    s = s.withColumn("way", way).withColumns({"points": F.when(full, F.col("way")).otherwise(ends), "geom_quality": F.when(full, "full").otherwise("endpoints_only")})
    s = s.withColumn("reason", F.when(F.col("start").isNull() | F.col("end").isNull(), "segment_without_time").when(F.size("points") < 2, "segment_without_geometry"))
    modes = F.create_map(*[F.lit(x) for pair in SEGMENT_MODES.items() for x in pair])
    skipped = v.where("reason is not null").select("reason").union(s.where("reason is not null").select("reason"))
    return {
        "places": v.where("reason is null").select("start", "end", "at.lat", "at.lon", F.col("l.name").alias("name"), F.col("l.placeId").alias("provider_place_id")),
        "tracks": s.where("reason is null").select("start", "end", "points", F.when(F.col("distance") != 0, F.col("distance")).alias("distance_m"), F.coalesce(F.try_element_at(modes, F.col("activityType")), F.lit("unknown")).alias("mode"), "geom_quality"),
        "skipped": skipped.groupBy("reason").agg(F.count("*").alias("count")),
    }


def read_semantic_segments(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``semantic_segments`` of monthly files, one JSON object each."""
    return semantic_segments(spark.read.schema(SEGMENTS).json(path, multiLine=True))
