"""Local days: which day an event is of, what a day holds, and stays that only photos tell."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import haversine_m
from waymark.functions.time import local_date
from waymark.operators.intervals import without_overlap
from waymark.operators.points import micros, seconds_between
from waymark.operators.stays import by_user, split_at_midnight
from waymark.params import Params


def ocean_zone(lon: Column) -> Column:
    """A zone by longitude alone; the sign of its name is the other way round."""
    offset = F.greatest(F.lit(-12), F.least(F.lit(14), F.floor(lon / 15.0 + 0.5).cast("int")))
    return F.when(offset == 0, F.lit("Etc/GMT")).otherwise(F.concat(F.lit("Etc/GMT"), F.when(offset > 0, "-").otherwise("+"), F.abs(offset).cast("string")))


def with_tz(rows: DataFrame, tz_grid: DataFrame, lat: str = "lat", lon: str = "lon", name: str = "tz_name") -> DataFrame:
    """``rows`` with the zone of their position: that of its cell in ``tz_grid`` (lat_q, lon_q in hundredths of a degree, tz_name), else by longitude; null without a position."""
    hundredths = lambda c: F.bround(F.col(c) * 100).cast("int")
    grid = tz_grid.select(F.bround(F.col("lat_q") * 100).cast("int").alias("lat_q_"), F.bround(F.col("lon_q") * 100).cast("int").alias("lon_q_"), F.col("tz_name").alias("zone_"))
    got = rows.withColumns({"lat_q_": hundredths(lat), "lon_q_": hundredths(lon)}).join(grid, ["lat_q_", "lon_q_"], "left")
    zone = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.coalesce("zone_", ocean_zone(F.col(lon))))
    return got.select(*[c for c in rows.columns if c != name], zone.alias(name))


def assign_days(stays: DataFrame, moves: DataFrame, tz_grid: DataFrame) -> DataFrame:
    """Events of local days: kind (stay or move), user_id, event_id, local_date, tz_name, start, end, crosses_tz.

    Stays (user_id, event_id, start, end, lat, lon, tz_name or null) are cut at each
    local midnight; moves (user_id, event_id, start, end, points) never are. A
    move's day is that of its start in the zone it departs from, and it
    crosses zones if it ends in another one.
    """
    known = stays.withColumn("own_", F.col("tz_name"))
    pieces = split_at_midnight(with_tz(known, tz_grid).withColumn("tz_name", F.coalesce("own_", "tz_name", F.lit("UTC"))).drop("own_"))
    pieces = pieces.select(F.lit("stay").alias("kind"), "user_id", "event_id", "local_date", "tz_name", "start", "end", F.lit(False).alias("crosses_tz"))
    a, b = F.get("points", F.lit(0)), F.element_at("points", -1)
    m = moves.where(F.size("points") > 0).select("user_id", "event_id", "start", "end", a["lat"].alias("la"), a["lon"].alias("lo"), b["lat"].alias("lb"), b["lon"].alias("lob"))
    m = with_tz(with_tz(m, tz_grid, "la", "lo", "tz_name"), tz_grid, "lb", "lob", "end_tz")
    tz = F.coalesce("tz_name", F.lit("UTC"))
    m = m.select(F.lit("move").alias("kind"), "user_id", "event_id", local_date(F.col("start"), tz).alias("local_date"), tz.alias("tz_name"), "start", "end", (F.coalesce("end_tz", tz) != tz).alias("crosses_tz"))
    return pieces.unionByName(m)


def trip_spans(events: DataFrame) -> DataFrame:
    """Each local day of a user: the zone of its first event, its span, its stays and moves, and whether a move crosses zones."""
    first = F.struct("start", F.when(F.col("kind") == "stay", 0).otherwise(1), "event_id")
    return events.groupBy("user_id", "local_date").agg(
        F.min_by("tz_name", first).alias("anchor_tz"), F.min("start").alias("start"), F.max("end").alias("end"), F.count_if(F.col("kind") == "stay").alias("stays"), F.count_if(F.col("kind") == "move").alias("moves"), F.bool_or("crosses_tz").alias("crosses_tz"))


def photos_to_days(photos: DataFrame, days: DataFrame) -> DataFrame:
    """user_id, photo_id, local_date of photos (user_id, photo_id, ts): the first day (user_id, local_date, start, end) whose span holds it, else its UTC date."""
    width = 86_400_000_000
    spans = days.select("user_id", F.col("local_date").alias("day_"), "start", "end").withColumn("bucket_", F.explode(F.sequence(F.floor(micros(F.col("start")) / width), F.floor(micros(F.col("end")) / width))))
    placed = photos.where("ts is not null").select("user_id", "photo_id", "ts").withColumn("bucket_", F.floor(micros(F.col("ts")) / width))
    found = placed.join(spans, ["user_id", "bucket_"]).where("ts >= start and ts <= end").groupBy("user_id", "photo_id").agg(F.min("day_").alias("day_"))
    return photos.where("ts is not null").select("user_id", "photo_id", "ts").join(found, ["user_id", "photo_id"], "left").select("user_id", "photo_id", F.coalesce("day_", F.to_date("ts")).alias("local_date"))


def kept_days(days: DataFrame, photo_days: DataFrame) -> DataFrame:
    """Days with a stay or a photo, and their photos; a day that only photos tell has no span and the zone UTC."""
    n = photo_days.groupBy("user_id", "local_date").agg(F.count("*").alias("photos"))
    both = days.join(n, ["user_id", "local_date"], "full").withColumns({"photos": F.coalesce("photos", F.lit(0)), "stays": F.coalesce("stays", F.lit(0)), "moves": F.coalesce("moves", F.lit(0)), "anchor_tz": F.coalesce("anchor_tz", F.lit("UTC"))})
    return both.where("stays > 0 or photos > 0")


_PHOTO_STAY = "user_id long, start timestamp_ntz, end timestamp_ntz, lat double, lon double, radius_m double, point_count int"


def cluster_photo_stays(photos: DataFrame, p: Params) -> DataFrame:
    """Stays of photos (user_id, ts, lat, lon): the next photo joins while it lies within the radius of the mean of those before; a single one is a stay too.

    The mean moves, so it is a fold over a user's photos in order; what is held
    is the open stay's photos.
    """
    import numpy as np

    from waymark.operators.stays import _apart, _metres

    rows = by_user(photos.where("lat is not null and lon is not null and ts is not null").select("user_id", "ts", "lat", "lon"), "ts", "lat", "lon")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, ts, lats, lons, out = None, [], [], [], []

        def close() -> None:
            a, o = sum(lats) / len(lats), sum(lons) / len(lons)
            out.append((user, ts[0], ts[-1], a, o, float(_metres(a, o, np.array(lats), np.array(lons)).max()), len(lats)))

        def made() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.timestamp("us"), pa.timestamp("us"), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in _PHOTO_STAY.split(", ")])

        s_lat = s_lon = 0.0
        for batch in batches:
            for u, t, a, o in zip(*(c.to_pylist() for c in batch.columns)):
                if u == user and _apart(s_lat / len(lats), s_lon / len(lats), a, o) <= p.radius_m:
                    ts.append(t), lats.append(a), lons.append(o)
                    s_lat, s_lon = s_lat + a, s_lon + o
                else:
                    if ts:
                        close()
                    user, ts, lats, lons, s_lat, s_lon = u, [t], [a], [o], a, o
            if out:
                yield made()
                out.clear()
        if ts:
            close()
            yield made()

    return rows.mapInArrow(run, _PHOTO_STAY)


def photo_only_stays(photos: DataFrame, stays: DataFrame, p: Params) -> DataFrame:
    """Stays of the photos (user_id, ts, lat, lon, tz_name) of local days on which no other stay (user_id, start, tz_name) begins."""
    covered = stays.select("user_id", local_date(F.col("start"), F.col("tz_name")).alias("day_")).distinct()
    alone = photos.where("lat is not null and lon is not null").withColumn("day_", local_date(F.col("ts"), F.col("tz_name"))).join(covered, ["user_id", "day_"], "left_anti")
    return cluster_photo_stays(alone, p)


def implied_moves(stays: DataFrame, moves: DataFrame, min_s: float = 60) -> DataFrame:
    """Moves of unknown length between consecutive stays (user_id, event_id, start, end, lat, lon) more than ``min_s`` apart that no move (user_id, start, end) overlaps."""
    w = Window.partitionBy("user_id").orderBy("start", "end", "event_id")
    nxt = lambda c: F.lead(c).over(w)
    spot = lambda a, o: F.struct(a.alias("lat"), o.alias("lon"))
    gaps = stays.select("user_id", "event_id", F.col("end").alias("start"), nxt("start").alias("end"), F.array(spot(F.col("lat"), F.col("lon")), spot(nxt("lat"), nxt("lon"))).alias("points"))
    gaps = gaps.where(seconds_between(F.col("start"), F.col("end")) > min_s)
    free = without_overlap(gaps, moves, "event_id")
    return free.select("user_id", "event_id", "start", "end", "points", F.lit(None).cast("double").alias("distance_m"), F.lit(True).alias("distance_unknown"), F.floor(seconds_between(F.col("start"), F.col("end"))).cast("long").alias("duration_s"), F.lit("endpoints_only").alias("geom_quality"))


def trip_stats(trips: DataFrame, places: DataFrame, tracks: DataFrame, photos: DataFrame) -> DataFrame:
    """trip_id with the distance by mode (a map), its sum, segments of unknown distance, places, tracks, photos, whether there are only photos, inferred dwells and zones.

    Each side is summed by trip before it is joined, so none multiplies another.
    """
    by_mode = tracks.where("distance_m is not null").groupBy("trip_id", "mode").agg(F.sum("distance_m").alias("m"))
    by_mode = by_mode.groupBy("trip_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "m")))).alias("distance_by_mode_m"), F.sum("m").alias("distance_total_m"))
    t = tracks.groupBy("trip_id").agg(F.count("*").alias("track_count"), F.count_if(F.col("distance_m").isNull()).alias("distance_unknown_segments"))
    p = places.groupBy("trip_id").agg(F.count("*").alias("place_count"), F.count_if("is_inferred").alias("inferred_dwell_count"), F.sort_array(F.collect_set("tz_name")).alias("timezones"))
    f = photos.groupBy("trip_id").agg(F.count("*").alias("photo_count"))
    out = trips.select("trip_id")
    for side in (by_mode, t, p, f):
        out = out.join(side, "trip_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = out.select(
        "trip_id", F.coalesce("distance_by_mode_m", F.create_map().cast("map<string,double>")).alias("distance_by_mode_m"), F.coalesce("distance_total_m", F.lit(0.0)).alias("distance_total_m"), *[zero(c) for c in ("distance_unknown_segments", "place_count", "track_count", "photo_count", "inferred_dwell_count")],
        F.coalesce("timezones", F.array().cast("array<string>")).alias("timezones"))
    return out.withColumn("photo_only", (F.col("photo_count") > 0) & (F.col("place_count") == 0) & (F.col("track_count") == 0))


def title_days(days: DataFrame) -> DataFrame:
    """Days with their plain date as a title."""
    return days.withColumn("title", F.date_format("local_date", "yyyy-MM-dd"))


def nearest_place(photos: DataFrame, places: DataFrame, radius_m: float = 150.0) -> DataFrame:
    """user_id, photo_id, place_id: of the stays that hold the instant of a photo, the nearest within ``radius_m``."""
    width = 86_400_000_000
    spans = places.select("user_id", "place_id", "start", "end", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).withColumn("bucket_", F.explode(F.sequence(F.floor(micros(F.col("start")) / width), F.floor(micros(F.col("end")) / width))))
    placed = photos.where("lat is not null and ts is not null").withColumn("bucket_", F.floor(micros(F.col("ts")) / width))
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    met = placed.join(spans, ["user_id", "bucket_"]).where("ts >= start and ts <= end").withColumn("d_", d).where(F.col("d_") <= radius_m)
    return met.groupBy("user_id", "photo_id").agg(F.min_by("place_id", F.struct("d_", "place_id")).alias("place_id"))
