"""Photos: when and where they were taken, and the stay or trip they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import lerp_position
from waymark.functions.time import known_zone, local_date, offset_label
from waymark.operators.days import nearest_place, with_tz
from waymark.operators.intervals import asof_both, nearest_in_time
from waymark.operators.points import micros, seconds_between

link_photos_to_places = nearest_place


def infer_photo_positions(photos: DataFrame, points: DataFrame, tolerance_s: float = 1800) -> DataFrame:
    """photo_id, lat, lon, location_confidence of photos (user_id, photo_id, ts, lat, lon).

    One without a position gets one between the pings before and after it, if they are no
    more than twice ``tolerance_s`` apart, else that of a ping within a third of it (the one before
    first), else none. Own positions are measured, others inferred.
    """
    need = photos.where("lat is null or lon is null").select("user_id", "photo_id", "ts")
    both = asof_both(need, points.select("user_id", "ts", "lat", "lon"), ["lat", "lon"])
    b, a = F.col("before"), F.col("after")
    span = seconds_between(b["ts"], a["ts"])
    between = b.isNotNull() & a.isNotNull() & (span > 0) & (span <= 2 * tolerance_s)
    at = lerp_position(b["lat"], b["lon"], a["lat"], a["lon"], seconds_between(b["ts"], F.col("ts")) / span)
    close = lambda c: c.isNotNull() & (F.abs(seconds_between(c["ts"], F.col("ts"))) <= tolerance_s / 3)
    spot = F.when(between, at).when(close(b), F.struct(b["lat"].alias("lat"), b["lon"].alias("lon"))).when(close(a), F.struct(a["lat"].alias("lat"), a["lon"].alias("lon")))
    found = both.withColumn("at_", spot).select("photo_id", F.col("at_.lat").alias("lat"), F.col("at_.lon").alias("lon"), F.when(F.col("at_").isNotNull(), "inferred").alias("location_confidence"))
    own = photos.where("lat is not null and lon is not null").select("photo_id", "lat", "lon", F.lit("measured").alias("location_confidence"))
    return own.unionByName(found)


def correct_local_gps_clock(gps_utc: Column, local: Column, expected_s: Column) -> Column:
    """Satellite time, put right where a camera wrote local time in its place: it then agrees with the local time within two minutes though the zone is two minutes or more from UTC."""
    wrong = (F.abs(seconds_between(gps_utc, local)) < 120) & (F.abs(expected_s) >= 120)
    return F.when(F.coalesce(wrong, F.lit(False)), F.timestamp_micros(micros(gps_utc) - (expected_s * 1_000_000).cast("long")).cast("timestamp_ntz")).otherwise(gps_utc)


def resolve_photo_time(photos: DataFrame, tz_grid: DataFrame, points: DataFrame, default_tz: str = "UTC", tolerance_s: float = 1800) -> DataFrame:
    """user_id, photo_id, ts_utc, tz_name, tz_source of photos (user_id, photo_id, gps_utc, local, offset_s, lat, lon, mtime).

    In this order: satellite time; local time with its offset; with the zone of the
    position; with the zone of the ping (user_id, ts, tz_name) nearest in time; with the default
    zone; the file's time.
    """
    p = with_tz(photos, tz_grid, "lat", "lon", "at_tz")
    at = F.col("at_tz")
    # What the clock should differ from UTC by: the declared offset, else the zone's there and then.
    zone_offset = seconds_between(F.convert_timezone(known_zone(at), F.lit("UTC"), F.col("local")), F.col("local"))
    gps = correct_local_gps_clock(F.col("gps_utc"), F.col("local"), F.coalesce(F.col("offset_s").cast("double"), zone_offset))
    near = nearest_in_time(photos.where("gps_utc is null and offset_s is null and local is not null and (lat is null or lon is null)").select("user_id", "photo_id", F.col("local").alias("ts")), points.select("user_id", "ts", "tz_name"), ["tz_name"], tolerance_s)
    p = p.join(near.select("photo_id", F.col("nearest.tz_name").alias("near_tz")), "photo_id", "left")
    local, offset, label = F.col("local"), F.col("offset_s").cast("long"), offset_label(F.col("offset_s"))
    in_zone = lambda tz: F.convert_timezone(known_zone(tz), F.lit("UTC"), local)
    made = lambda ts, tz, source: F.struct(ts.alias("ts"), tz.cast("string").alias("tz"), source.cast("string").alias("source"))
    none = F.lit(None)
    shifted = F.timestamp_micros(micros(local) - (offset * 1_000_000).cast("long")).cast("timestamp_ntz")
    got = (
        F.when(F.col("gps_utc").isNotNull(), made(gps, F.when(offset.isNotNull(), label).otherwise(at), F.when(offset.isNotNull(), "exif_offset").when(at.isNotNull(), "gps_lookup")))
        .when(local.isNotNull() & offset.isNotNull(), made(shifted, label, F.lit("exif_offset")))
        .when(local.isNotNull() & at.isNotNull(), made(in_zone(at), at, F.lit("gps_lookup")))
        .when(local.isNotNull() & F.col("near_tz").isNotNull(), made(in_zone(F.col("near_tz")), F.col("near_tz"), F.lit("nearest_track")))
        .when(local.isNotNull(), made(in_zone(F.lit(default_tz)), F.lit(default_tz), F.lit("user_default")))
        .otherwise(made(F.col("mtime"), none, F.when(F.col("mtime").isNotNull(), "file_mtime")))
    )
    return p.withColumn("t_", got).select("user_id", "photo_id", F.col("t_.ts").alias("ts_utc"), F.col("t_.tz").alias("tz_name"), F.col("t_.source").alias("tz_source"))


def link_photos_to_trips(photos: DataFrame, trips: DataFrame) -> DataFrame:
    """user_id, photo_id, trip_id: of the trips (user_id, trip_id, start, end) whose span holds the instant, the earliest."""
    width = 86_400_000_000
    spans = trips.select("user_id", "trip_id", "start", "end").withColumn("bucket_", F.explode(F.sequence(F.floor(micros(F.col("start")) / width), F.floor(micros(F.col("end")) / width))))
    placed = photos.where("ts is not null").select("user_id", "photo_id", "ts").withColumn("bucket_", F.floor(micros(F.col("ts")) / width))
    met = placed.join(spans, ["user_id", "bucket_"]).where("ts >= start and ts <= end")
    return met.groupBy("user_id", "photo_id").agg(F.min_by("trip_id", F.struct("start", "trip_id")).alias("trip_id"))


def in_date_range(photos: DataFrame, first, last) -> DataFrame:
    """Photos (local, ts, tz_name) of local days ``first`` to ``last``; those without any time stay."""
    day = F.coalesce(F.to_date("local"), local_date(F.col("ts"), F.col("tz_name")))
    return photos.where(day.isNull() | day.between(first, last))


def cover_photos(trips: DataFrame, photos: DataFrame) -> DataFrame:
    """``trips`` (trip_id, cover_photo_id) with the earliest photo as the cover of those that have none."""
    first = photos.groupBy("trip_id").agg(F.min_by("photo_id", F.struct("ts", "photo_id")).alias("first_"))
    return trips.join(first, "trip_id", "left").withColumn("cover_photo_id", F.coalesce("cover_photo_id", "first_")).select(*trips.columns)


def dedup_photos(photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photos (user_id, photo_id, content, source_id), one of each content, and links (photo_id, source_id) that duplicates leave behind."""
    kept = photos.groupBy("user_id", "content").agg(F.min("photo_id").alias("photo_id"))
    links = photos.select("user_id", "content", "source_id").join(kept, ["user_id", "content"]).select("photo_id", "source_id").distinct()
    return kept, links
