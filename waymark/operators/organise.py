"""Trips, places, tracks and photos as their owner looks at them: filters, groups and tags, lists and panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import in_bbox, within_radius
from waymark.functions.text import text_search
from waymark.functions.time import overlaps


def _all(rows: DataFrame, *tests: Column | None) -> DataFrame:
    """Rows that pass every test that is given."""
    given = [t for t in tests if t is not None]
    return rows.where(reduce(lambda a, b: a & b, given)) if given else rows


def _if(value, test):
    return None if value is None else test(value)


def _with(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return rows.join(other.select(key).distinct(), key, "left_semi")


def filter_trips(trips: DataFrame, places: DataFrame | None = None, trip_tags: DataFrame | None = None, *, from_=None, to=None, group=None, tag=None, commute=None, q=None, country=None, city=None, anchor=None, cursor=None, limit: int | None = None) -> DataFrame:
    """Trips newest first, by whichever options are given; each is one more filter in the plan. An empty country or city means places without a name."""
    out = _all(
        trips, _if(from_, lambda v: F.col("local_date") >= v), _if(to, lambda v: F.col("local_date") <= v), _if(group, lambda v: F.col("group_id") == v),
        _if(commute, lambda v: F.col("commute_class") == v), _if(cursor, lambda v: F.col("local_date") < v), _if(q, lambda v: text_search(F.col("title"), v)))
    for column, value in (("geo_country", country), ("geo_city", city)):
        if value is not None:
            out = _with(out, places.where(F.coalesce(column, F.lit("")) == value), "trip_id")
    if anchor is not None:
        out = _with(out, places.where(F.col("anchor_id") == anchor), "trip_id")
    if tag is not None:
        out = _with(out, trip_tags.where(F.col("tag_id") == tag), "trip_id")
    return latest(out, "local_date", limit, "trip_id")


def filter_places(places: DataFrame, trips: DataFrame | None = None, place_tags: DataFrame | None = None, *, trip=None, from_=None, to=None, group=None, tag=None, q=None, bbox=None, centre=None, radius_m=None, limit: int | None = None) -> DataFrame:
    """Places by time, by whichever options are given; a place without a group of its own has its trip's."""
    lat, lon = F.col("lat"), F.col("lon")
    name = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("name", "geo_name", "geo_city") if c in places.columns])
    out = _all(
        places, _if(trip, lambda v: F.col("trip_id") == v), _if(from_, lambda v: F.col("end") >= v), _if(to, lambda v: F.col("start") <= v), _if(q, lambda v: text_search(name, v)),
        _if(bbox, lambda v: in_bbox(lat, lon, v)), _if(centre, lambda v: within_radius(lat, lon, *v, radius_m)))
    if group is not None:
        out = effective_group(out, trips).where(F.col("effective_group_id") == group).drop("effective_group_id")
    if tag is not None:
        out = _with(out, place_tags.where(F.col("tag_id") == tag), "place_id")
    return earliest(out, "start", limit, "place_id")


def filter_tracks(tracks: DataFrame, *, trip=None, from_=None, to=None, mode=None, source=None, commute=None, limit: int | None = None) -> DataFrame:
    """Tracks by time, by whichever options are given."""
    out = _all(
        tracks, _if(trip, lambda v: F.col("trip_id") == v), _if(from_, lambda v: F.col("end") >= v), _if(to, lambda v: F.col("start") <= v), _if(mode, lambda v: F.col("mode") == v),
        _if(source, lambda v: F.col("mode_source") == v), _if(commute, lambda v: F.col("is_commute") == v))
    return earliest(out, "start", limit, "track_id")


def filter_photos(photos: DataFrame, *, trip=None, from_=None, to=None, bbox=None, located=None, limit: int | None = None) -> DataFrame:
    """Photos by time, by whichever options are given."""
    out = _all(
        photos, _if(trip, lambda v: F.col("trip_id") == v), _if(from_, lambda v: F.col("ts") >= v), _if(to, lambda v: F.col("ts") <= v),
        _if(bbox, lambda v: in_bbox(F.col("lat"), F.col("lon"), v)), _if(located, lambda v: F.col("lat").isNotNull() == v))
    return earliest(out, "ts", limit, "photo_id")


def feature_filter(features: DataFrame, *, modes=None, sources=None, from_=None, to=None) -> DataFrame:
    """Features that a map shows (start, end, mode, source_kind): of a window of time, of these modes and sources; one without an end lasts no time."""
    return _all(
        features, _if(from_, lambda v: F.coalesce("end", "start") >= v), _if(to, lambda v: F.col("start") <= v),
        _if(modes, lambda v: F.col("mode").isin(*v)), _if(sources, lambda v: F.col("source_kind").isin(*v)))


def latest(rows: DataFrame, by: str, limit: int | None, key: str) -> DataFrame:
    got = rows.orderBy(F.desc(by), key)
    return got if limit is None else got.limit(limit)


def earliest(rows: DataFrame, by: str, limit: int | None, key: str) -> DataFrame:
    got = rows.orderBy(by, key)
    return got if limit is None else got.limit(limit)


def fences_by_last_visit(fences: DataFrame) -> DataFrame:
    """Fences, last visited first, never visited last."""
    return fences.orderBy(F.desc_nulls_last("last_visit"), "fence_id")


def list_sources(sources: DataFrame) -> DataFrame:
    """Imported files, newest first."""
    return sources.orderBy(F.desc("imported_at"), "source_id")


def search(trips: DataFrame, places: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """kind, id, name of trips by title and places by their names that contain ``q``, the newest ``limit`` of each."""
    name = F.concat_ws(" ", *[F.col(c) for c in ("name", "geo_name", "geo_city") if c in places.columns])
    t = latest(trips.where(text_search(F.col("title"), q)), "local_date", limit, "trip_id").select(F.lit("trip").alias("kind"), F.col("trip_id").alias("id"), F.col("title").alias("name"))
    p = latest(places.where(text_search(name, q)), "start", limit, "place_id").select(F.lit("place").alias("kind"), F.col("place_id").alias("id"), name.alias("name"))
    return t.unionByName(p)


# --- groups and tags -----------------------------------------------------------------

def effective_group(places: DataFrame, trips: DataFrame) -> DataFrame:
    """``places`` with effective_group_id: their own group, else their trip's."""
    t = trips.select("trip_id", F.col("group_id").alias("trip_group_"))
    return places.join(t, "trip_id", "left").withColumn("effective_group_id", F.coalesce("group_id", "trip_group_")).drop("trip_group_")


def group_counts(groups: DataFrame, trips: DataFrame, places: DataFrame) -> DataFrame:
    """group_id with the numbers of its trips and places, inherited ones too."""
    t = trips.groupBy("group_id").agg(F.count("*").alias("trip_count"))
    p = effective_group(places, trips).groupBy(F.col("effective_group_id").alias("group_id")).agg(F.count("*").alias("place_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return groups.join(t, "group_id", "left").join(p, "group_id", "left").select(*groups.columns, zero("trip_count"), zero("place_count"))


def tag_counts(tags: DataFrame, trip_tags: DataFrame, place_tags: DataFrame) -> DataFrame:
    """tag_id with the numbers of trips and places that have it."""
    out = tags
    for name, links in (("trip_count", trip_tags), ("place_count", place_tags)):
        out = out.join(links.groupBy("tag_id").agg(F.count("*").alias(name)), "tag_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def tag_lists(trips: DataFrame, trip_tags: DataFrame) -> DataFrame:
    """trip_id, tag_ids: sorted, empty where there are none."""
    lists = trip_tags.groupBy("trip_id").agg(F.array_sort(F.collect_set("tag_id")).alias("tag_ids"))
    return trips.select("trip_id").join(lists, "trip_id", "left").withColumn("tag_ids", F.coalesce("tag_ids", F.array().cast("array<long>")))


def members(trips: DataFrame, places: DataFrame, group: int) -> DataFrame:
    """kind, id, at, inherited: trips and places of a group in one list, newest first."""
    t = trips.where(F.col("group_id") == group).select(F.lit("trip").alias("kind"), F.col("trip_id").alias("id"), F.col("local_date").cast("timestamp_ntz").alias("at"), F.lit(False).alias("inherited"))
    p = effective_group(places, trips).where(F.col("effective_group_id") == group).select(F.lit("place").alias("kind"), F.col("place_id").alias("id"), F.col("start").alias("at"), F.col("group_id").isNull().alias("inherited"))
    return t.unionByName(p).orderBy(F.desc("at"), "kind", "id")


def apply_import_policy(trips: DataFrame, touched: DataFrame, trip_tags: DataFrame, group: int | None, tags: list[int]) -> tuple[DataFrame, DataFrame]:
    """Trips and tags after an import: touched trips (trip_id) without a group get the batch's, others keep theirs; its tags are added to all touched."""
    mark = touched.select("trip_id").distinct().withColumn("touched_", F.lit(True))
    own = F.coalesce("group_id", F.when(F.col("touched_"), F.lit(group).cast("long")))
    t = trips.join(mark, "trip_id", "left").withColumn("group_id", own).select(*trips.columns)
    links = mark.select("trip_id", F.explode(F.array(*[F.lit(x).cast("long") for x in tags]) if tags else F.array().cast("array<long>")).alias("tag_id"))
    return t, trip_tags.select("trip_id", "tag_id").union(links).distinct()


def bulk_assign(items: DataFrame, links: DataFrame, assignments: DataFrame, groups: DataFrame, key: str = "trip_id") -> tuple[DataFrame, DataFrame]:
    """Items (``key``, group_id) and links (``key``, tag_id) after assignments (``key``, group_id or null, add_tags, remove_tags).

    A group replaces the one before; a system group is no target, which is an error.
    """
    targets = assignments.where("group_id is not null").select("group_id").distinct()
    bad = targets.join(groups.where("kind <> 'system'").select("group_id"), "group_id", "left_anti")
    if n := bad.count():
        raise ValueError(f"{n} groups can't be assigned")
    new = assignments.select(key, F.col("group_id").alias("to_"))
    moved = items.join(new, key, "left").withColumn("group_id", F.coalesce("to_", "group_id")).select(*items.columns)
    gone = assignments.select(key, F.explode("remove_tags").alias("tag_id"))
    more = assignments.select(key, F.explode("add_tags").alias("tag_id"))
    return moved, links.select(key, "tag_id").join(gone, [key, "tag_id"], "left_anti").union(more).distinct()


# --- panels ------------------------------------------------------------------------------

def distinct_key_trip(places: DataFrame, key: str) -> DataFrame:
    """(key, trip_id), each pair once, so that what is joined by trip isn't counted for each place."""
    return places.select(key, "trip_id").distinct()


def overview(trips: DataFrame, places: DataFrame, stats: DataFrame, key: str = "geo_country") -> DataFrame:
    """Trips, photos, distance, days and cities of each country (or city); null is the unnamed one. A trip counts in each that it has a place in, a city once however many trips."""
    pairs = distinct_key_trip(places, key)
    t = trips.select("trip_id", "local_date").join(stats.select("trip_id", "photo_count", "distance_total_m"), "trip_id")
    got = pairs.join(t, "trip_id").groupBy(key).agg(
        F.count("*").alias("trip_count"), F.sum("photo_count").alias("photo_count"), F.sum("distance_total_m").alias("distance_m"), F.min("local_date").alias("first_day"), F.max("local_date").alias("last_day"))
    if key == "geo_city":
        land = places.groupBy(F.col("geo_city").alias("city_")).agg(F.min("geo_country").alias("geo_country"))
        return got.join(land, F.col("geo_city").eqNullSafe(F.col("city_"))).drop("city_")
    cities = places.where("geo_city is not null").groupBy(F.col(key).alias("land_")).agg(F.count_distinct("geo_city").alias("city_count"))
    return got.join(cities, F.col(key).eqNullSafe(F.col("land_")), "left").drop("land_").withColumn("city_count", F.coalesce("city_count", F.lit(0)))


def overview_rollup(places: DataFrame) -> DataFrame:
    """Trips of each city, each country and altogether; level tells totals from the unnamed (grouping_id)."""
    pairs = places.select("geo_country", "geo_city", "trip_id").distinct()
    return pairs.rollup("geo_country", "geo_city").agg(F.grouping_id("geo_country", "geo_city").alias("level"), F.count_distinct("trip_id").alias("trips"))


def stats_panel(trips: DataFrame, places: DataFrame, tracks: DataFrame, photos: DataFrame, from_=None, to=None, group=None) -> dict[str, DataFrame]:
    """What a user has, of chosen trips: totals, by_mode, coverage and photos, each by user_id. Tracks of unknown length are counted apart; shadows don't count."""
    t = _all(trips, _if(from_, lambda v: F.col("local_date") >= v), _if(to, lambda v: F.col("local_date") <= v), _if(group, lambda v: F.col("group_id") == v))
    ids = t.select("trip_id")
    of = lambda rows: rows.join(ids, "trip_id", "left_semi")
    counted = tracks.where("not is_shadow") if "is_shadow" in tracks.columns else tracks
    return {
        "totals": t.groupBy("user_id").agg(F.count("*").alias("trip_count"), F.min("local_date").alias("first_day"), F.max("local_date").alias("last_day")),
        "by_mode": of(counted).groupBy("user_id", "mode").agg(F.coalesce(F.sum("distance_m"), F.lit(0.0)).alias("distance_m"), F.count_if(F.col("distance_m").isNull()).alias("unknown_count"), F.count("*").alias("segment_count"), F.sum("duration_s").alias("duration_s")),
        "coverage": of(places).groupBy("user_id").agg(F.count_distinct("geo_country").alias("countries"), F.count_distinct("geo_city").alias("cities"), F.count("*").alias("place_count"), F.count_if("is_inferred").alias("inferred_dwell_count")),
        "photos": of(photos).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("location_confidence") == "inferred").alias("inferred"), F.count_if(F.col("lat").isNull()).alias("unlocated")),
    }


def daily_activity(trips: DataFrame, places: DataFrame, tracks: DataFrame, distinct_quirk: bool = False) -> DataFrame:
    """user_id, day, places, distance_m. Each side is summed by trip first; ``distinct_quirk`` counts equal lengths of a day once, as a plain SUM(DISTINCT) over the joined rows would."""
    p = places.groupBy("trip_id").agg(F.count("*").alias("places_"))
    days = trips.select("user_id", "trip_id", F.col("local_date").alias("day"))
    n = days.join(p, "trip_id", "left").groupBy("user_id", "day").agg(F.coalesce(F.sum("places_"), F.lit(0)).alias("places"))
    total = F.sum_distinct("distance_m") if distinct_quirk else F.sum("distance_m")
    m = days.join(tracks.select("trip_id", "distance_m"), "trip_id").groupBy("user_id", "day").agg(total.alias("m_"))
    return n.join(m, ["user_id", "day"], "left").select("user_id", "day", "places", F.coalesce("m_", F.lit(0.0)).alias("distance_m"))


def monthly_density(days: DataFrame) -> DataFrame:
    """user_id, month, weight of days (user_id, day, places, distance_m): places, and one more for a day with a distance; months between without any too."""
    m = days.groupBy("user_id", F.trunc("day", "month").alias("month")).agg(F.sum(F.col("places") + (F.col("distance_m") > 0).cast("int")).alias("weight"))
    every = m.groupBy("user_id").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("user_id", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return every.join(m, ["user_id", "month"], "left").select("user_id", "month", F.coalesce("weight", F.lit(0)).alias("weight"))


def trips_per_year(trips: DataFrame) -> DataFrame:
    return trips.groupBy("user_id", F.year("local_date").alias("year")).agg(F.count("*").alias("trips"))


def month_bars(trips: DataFrame, year: int) -> DataFrame:
    """user_id, month, trips: the twelve months of a year, empty ones too."""
    t = trips.where(F.col("local_date").between(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31))))
    n = [F.count_if(F.month("local_date") == m) for m in range(1, 13)]
    return t.groupBy("user_id").agg(F.array(*n).alias("bars")).select("user_id", F.posexplode("bars").alias("m_", "trips")).select("user_id", (F.col("m_") + 1).alias("month"), "trips")


def main_city(places: DataFrame) -> DataFrame:
    """trip_id, city (the one with most dwell), countries (sorted) of trips with a named place."""
    dwell = F.col("end").cast("timestamp").cast("double") - F.col("start").cast("timestamp").cast("double")
    s = places.where("geo_city is not null").groupBy("trip_id", "geo_city").agg(F.sum(dwell).alias("s"))
    city = s.groupBy("trip_id").agg(F.max_by("geo_city", F.struct("s", "geo_city")).alias("city"))
    lands = places.where("geo_country is not null").groupBy("trip_id").agg(F.array_sort(F.collect_set("geo_country")).alias("countries"))
    return city.join(lands, "trip_id", "full")


def selection_summary(trips: DataFrame, places: DataFrame, tracks: DataFrame) -> DataFrame:
    """user_id of selected trips with first and last day, known kilometres, segments of unknown length, places and the box around them."""
    ids = trips.select("trip_id")
    t = trips.groupBy("user_id").agg(F.count("*").alias("trips"), F.min("local_date").alias("first_day"), F.max("local_date").alias("last_day"))
    m = tracks.join(ids, "trip_id", "left_semi").groupBy("user_id").agg((F.sum("distance_m") / 1000).alias("known_km"), F.count_if(F.col("distance_m").isNull()).alias("unknown_segments"))
    p = places.join(ids, "trip_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("places"), *bbox("lat", "lon"))
    return t.join(m, "user_id", "left").join(p, "user_id", "left")


def bbox(lat: str, lon: str) -> list[Column]:
    """Aggregates west, south, east, north; a box without width or height is made a little wider."""
    def pair(c: str, low: str, high: str) -> list[Column]:
        thin = F.min(c) == F.max(c)
        return [(F.min(c) - F.when(thin, 1e-6).otherwise(0.0)).alias(low), (F.max(c) + F.when(thin, 1e-6).otherwise(0.0)).alias(high)]

    (w, e), (s, n) = pair(lon, "west", "east"), pair(lat, "south", "north")
    return [w, s, e, n]


def expand_trips(trips: DataFrame, places: DataFrame, tracks: DataFrame, photos: DataFrame) -> DataFrame:
    """Trips with arrays of their places, tracks and photos in order of time; one row a trip, so choose the trips first."""
    out = trips
    for name, side, at, fields in (("places", places, "start", ("place_id", "end", "lat", "lon")), ("tracks", tracks, "start", ("track_id", "end", "mode", "distance_m")), ("photos", photos, "ts", ("photo_id", "lat", "lon"))):
        rows = side.join(trips.select("trip_id"), "trip_id", "left_semi").groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct(at, *fields))).alias(name))
        out = out.join(rows, "trip_id", "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return out


def import_report(points: DataFrame, skipped: DataFrame, trips: DataFrame, cap: int = 200) -> DataFrame:
    """Each source: pings, duplicates among them, span, what was skipped by reason, days that cross zones, and its trips (the first ``cap``, as the report shows).

    points (source_id, ts, is_duplicate), skipped (source_id, reason, count), trips (source_id, trip_id, crosses_tz).
    """
    p = points.groupBy("source_id").agg(F.count("*").alias("points"), F.count_if("is_duplicate").alias("duplicates"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    s = skipped.groupBy("source_id", "reason").agg(F.sum("count").alias("n")).groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("skipped"))
    ranked = trips.withColumn("i_", F.row_number().over(Window.partitionBy("source_id").orderBy("trip_id")))
    t = ranked.groupBy("source_id").agg(F.count("*").alias("trip_count"), F.count_if("crosses_tz").alias("tz_crossing_days"), F.array_sort(F.collect_list(F.when(F.col("i_") <= cap, F.col("trip_id")))).alias("trip_ids"))
    return p.join(s, "source_id", "left").join(t, "source_id", "left").withColumn("skipped", F.coalesce("skipped", F.create_map().cast("map<string,long>")))
