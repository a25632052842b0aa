"""Timeline exports: records of visits, activities and paths, and what is taken from each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geo import parse_latlng
from waymark.functions.text import map_activity_type
from waymark.functions.time import offset_label
from waymark.sources.json_split import json_records

_PLACE = "struct<latLng: string>"
RECORD = (
    "startTime string, endTime string, "
    f"visit struct<hierarchyLevel: int, topCandidate: struct<placeId: string, semanticType: string, probability: double, placeLocation: {_PLACE}>>, "
    f"activity struct<start: {_PLACE}, end: {_PLACE}, distanceMeters: double, topCandidate: struct<type: string>>, "
    "timelinePath array<struct<point: string, durationMinutesOffsetFromStartTime: int>>, timelineMemory struct<distanceFromOriginKms: double>"
)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Records of exports that are an array, or an object with them in semanticSegments; a file may be one value of any size, or many after each other."""
    records = json_records(spark, path, "semanticSegments")
    return records.select(F.from_json("text", RECORD).alias("r")).select("r.*")


def instant(text: Column) -> Column:
    """An ISO time with its offset as an instant in UTC; null if it isn't one."""
    return F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")


def zone_label(text: Column) -> Column:
    """UTC+09:00 of a time that was written with this offset, UTC of one in UTC; null without an offset."""
    sign, hours, minutes = (F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})$", i) for i in (1, 2, 3))
    seconds = F.when(sign == "-", -1).otherwise(1) * (hours.try_cast("int") * 3600 + minutes.try_cast("int") * 60)
    return F.when(F.endswith(text, F.lit("Z")), F.lit("UTC")).when(sign != "", offset_label(seconds))


def dispatch_records(records: DataFrame) -> dict[str, DataFrame]:
    """places, tracks, points and skipped (reason, count) of records; memories and empty paths are counted, unknown records are an error with a sample."""
    r = with_kind(records, strict=True)
    places, skipped = visits_to_hints(r)
    notes = r.where(F.col("kind").isin("memory", "empty")).select(F.when(F.col("kind") == "memory", "timeline memory").otherwise("empty path").alias("reason"))
    more = notes.groupBy("reason").agg(F.count("*").alias("count"))
    return {"places": places, "tracks": activities_to_hints(r), "points": paths_to_points(r), "skipped": skipped.unionByName(more)}


def with_kind(records: DataFrame, strict: bool = False) -> DataFrame:
    """``kind``: visit, activity, path, memory, empty or unknown; ``strict`` fails on unknown ones with a sample."""
    kind = (
        F.when(F.col("visit").isNotNull(), "visit").when(F.col("activity").isNotNull(), "activity").when(F.size("timelinePath") > 0, "path")
        .when(F.col("timelineMemory").isNotNull(), "memory").when(F.col("timelinePath").isNotNull(), "empty").otherwise("unknown")
    )
    out = records.withColumn("kind", kind)
    if strict:
        sample = F.substring(F.to_json(F.struct(*records.columns)), 1, 200)
        out = out.withColumn("kind", F.when(F.col("kind") == "unknown", F.raise_error(F.concat(F.lit("unknown record: "), sample)).cast("string")).otherwise(F.col("kind")))
    return out


def visits_to_hints(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Place hints, and reasons of skipped visits with their counts."""
    v = records.where("visit is not null").select(instant(F.col("startTime")).alias("start"), instant(F.col("endTime")).alias("end"), zone_label(F.col("startTime")).alias("tz_name"), parse_latlng(F.col("visit.topCandidate.placeLocation.latLng")).alias("at"), F.col("visit.topCandidate.semanticType").alias("semantic_type"), F.col("visit.topCandidate.placeId").alias("provider_place_id"), F.col("visit.topCandidate.probability").alias("probability"), F.col("visit.hierarchyLevel").alias("level"))
    reason = (
        F.when(F.col("start").isNull() | F.col("end").isNull(), "no time").when(F.coalesce("level", F.lit(0)) > 0, "hierarchy parent")
        .when(F.replace(F.lower("semantic_type"), F.lit("_"), F.lit(" ")) == "searched address", "searched address").when(F.col("at").isNull(), "no position")
    )
    v = v.withColumn("reason", reason)
    hints = v.where("reason is null").select("start", "end", "tz_name", "at.lat", "at.lon", "semantic_type", "provider_place_id", "probability")
    return hints, v.where("reason is not null").groupBy("reason").agg(F.count("*").alias("count"))


def activities_to_hints(records: DataFrame) -> DataFrame:
    """Track hints of two ends; a distance that isn't positive is unknown."""
    a = records.where("activity is not null").select(instant(F.col("startTime")).alias("start"), instant(F.col("endTime")).alias("end"), parse_latlng(F.col("activity.start.latLng")).alias("a"), parse_latlng(F.col("activity.end.latLng")).alias("b"), F.when(F.col("activity.distanceMeters") > 0, F.col("activity.distanceMeters")).alias("distance_m"), map_activity_type(F.col("activity.topCandidate.type")).alias("mode"))
    return a.where("start is not null and end is not null and a is not null and b is not null").select("start", "end", F.array("a", "b").alias("points"), "distance_m", "mode")


def paths_to_points(records: DataFrame) -> DataFrame:
    """A ping of every vertex: the record's start plus the vertex's minutes."""
    p = records.where("size(timelinePath) > 0").select(instant(F.col("startTime")).alias("start"), F.explode("timelinePath").alias("v"))
    at = parse_latlng(F.col("v.point"))
    return p.select((F.col("start") + F.make_dt_interval(mins=F.col("v.durationMinutesOffsetFromStartTime"))).alias("ts"), at.alias("at")).where("ts is not null and at is not null").select("ts", "at.lat", "at.lon")


def to_geojson_rows(places: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature, as text, for each place (lat, lon and the properties)."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return places.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def track_features(tracks: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature for each track (points and the properties, distance_m among them); an unknown distance stays null and is marked."""
    line = F.struct(F.lit("LineString").alias("type"), F.transform("points", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    about = F.struct(*properties, F.col("distance_m").isNull().alias("distance_unknown"))
    return tracks.select(F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), about.alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def to_gpx_rows(tracks: DataFrame) -> DataFrame:
    """One GPX track, as text, for each track (name, points of lat and lon)."""
    vertex = lambda p: F.format_string('<trkpt lat="%.6f" lon="%.6f"/>', p["lat"], p["lon"])
    name = F.replace(F.replace(F.col("name"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return tracks.select("name", F.concat(F.lit("<trk><name>"), name, F.lit("</name><trkseg>"), F.array_join(F.transform("points", vertex), ""), F.lit("</trkseg></trk>")).alias("gpx"))
