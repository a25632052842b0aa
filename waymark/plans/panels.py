"""Queries on filters, groups, tags, lists and panels, over the day plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import days, organise, points
from waymark.plans.fixtures import FENCES, PLAN, PLAN_PHOTOS, PLAN_PLACES, PLAN_TRACKS, PLAN_TRIPS, fences, plan_photos, plan_places, plan_tracks, plan_trips, table
from waymark.plans.queries import query, r6

_TAGS = "trip_tags AS (SELECT trip_id, 1 AS tag_id FROM plan WHERE trip_id % 3 = 0 UNION ALL SELECT trip_id, 2 FROM plan WHERE trip_id % 5 = 0)"


def _tags(spark, sf):
    t = plan_trips(spark, sf).select("trip_id")
    return t.where("trip_id % 3 = 0").withColumn("tag_id", F.lit(1).cast("long")).union(t.where("trip_id % 5 = 0").withColumn("tag_id", F.lit(2).cast("long")))


def _day(s):
    return F.lit(s).cast("date")


def _grouped(spark, sf):
    """Places with a group of their own for some."""
    return plan_places(spark, sf).withColumn("group_id", F.when(F.col("place_id") % 7 == 0, F.col("place_id") % 4))


_GROUPED = "grouped AS (SELECT p.*, CASE WHEN place_id % 7 = 0 THEN place_id % 4 END AS own_group, coalesce(CASE WHEN place_id % 7 = 0 THEN place_id % 4 END, t.group_id) AS eff FROM plan_places p JOIN plan_trips t USING (trip_id))"


@query("B22_filter_trips", f"""WITH {PLAN_PLACES}, {PLAN_TRIPS}, {_TAGS} SELECT trip_id, local_date, title FROM plan_trips t WHERE local_date BETWEEN DATE '2024-01-05' AND DATE '2024-02-01' AND group_id = 1 AND trip_id IN (SELECT trip_id FROM trip_tags WHERE tag_id = 2)
AND trip_id IN (SELECT trip_id FROM plan_places WHERE coalesce(geo_country, '') = '') AND contains(lower(title), '01') ORDER BY local_date DESC, trip_id LIMIT 500""")
def b22(spark, sf):
    return organise.filter_trips(plan_trips(spark, sf), plan_places(spark, sf), _tags(spark, sf), from_=_day("2024-01-05"), to=_day("2024-02-01"), group=1, tag=2, country="", q="01", limit=500).select("trip_id", "local_date", "title")


@query("B22_filter_places", f"""WITH {PLAN_PLACES}, {PLAN_TRIPS}, {_GROUPED} SELECT place_id, start FROM grouped WHERE eff = 2 AND "end" >= TIMESTAMP '2024-01-03 00:00:00' AND start <= TIMESTAMP '2024-01-09 00:00:00' AND contains(lower(coalesce(geo_city, '')), 'n_1') AND lat BETWEEN 35 AND 42 AND lon BETWEEN -180 AND 180 ORDER BY start, place_id LIMIT 1000""")
def b22_places(spark, sf):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return organise.filter_places(_grouped(spark, sf), plan_trips(spark, sf), group=2, from_=at("2024-01-03 00:00:00"), to=at("2024-01-09 00:00:00"), q="N_1", bbox=(-180, 35, 180, 42), limit=1000).select("place_id", "start")


@query("B22_filter_tracks", f"""WITH {PLAN}, {PLAN_TRACKS} SELECT track_id FROM plan_tracks WHERE mode = 'bike' AND mode_source = 'google' AND "end" >= TIMESTAMP '2024-01-10 00:00:00'""")
def b22_tracks(spark, sf):
    return organise.filter_tracks(plan_tracks(spark, sf), mode="bike", source="google", from_=F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).select("track_id")


@query("B25_feature_filter", f"""WITH {PLAN}, {PLAN_TRACKS} SELECT track_id FROM plan_tracks WHERE mode IN ('car', 'walk') AND mode_source IN ('inferred') AND coalesce(CASE WHEN track_id % 3 > 0 THEN "end" END, start) >= TIMESTAMP '2024-01-20 12:00:00' AND start <= TIMESTAMP '2024-01-27 00:00:00'""")
def b25(spark, sf):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    t = plan_tracks(spark, sf).withColumnRenamed("mode_source", "source_kind").withColumn("end", F.when(F.col("track_id") % 3 > 0, F.col("end")))
    return organise.feature_filter(t, modes=["car", "walk"], sources=["inferred"], from_=at("2024-01-20 12:00:00"), to=at("2024-01-27 00:00:00")).select("track_id")


@query("B24_label", f"WITH {PLAN_PLACES} SELECT place_id, coalesce(CASE WHEN place_id % 5 = 0 THEN 'Own' END, CASE WHEN place_id % 3 = 0 THEN 'Geo' END, geo_city) AS label FROM plan_places")
def b24(spark, sf):
    name = text.label(F.when(F.col("place_id") % 5 == 0, "Own"), F.when(F.col("place_id") % 3 == 0, "Geo"), F.col("geo_city"))
    return plan_places(spark, sf).select("place_id", name.alias("label"))


@query("B30_generated", f"WITH {PLAN}, {PLAN_TRIPS} SELECT trip_id, regexp_matches(title, '^[0-9]{{4}}') OR contains(title, ' · ') AS generated FROM plan_trips")
def b30(spark, sf):
    return plan_trips(spark, sf).select("trip_id", text.looks_generated(F.col("title")).alias("generated"))


@query("B32_stats_fields", f"WITH {PLAN} SELECT trip_id, trip_id % 7 AS photo_count, (trip_id % 13)::DOUBLE AS distance_total_m, trip_id % 2 = 0 AS collapsed FROM plan")
def b32(spark, sf):
    made = plan_trips(spark, sf).select("trip_id", F.to_json(F.struct((F.col("trip_id") % 7).alias("photo_count"), (F.col("trip_id") % 13).cast("double").alias("distance_total_m"))).alias("stats"))
    return text.with_stats(made, {"photo_count": "bigint", "distance_total_m": "double"}).withColumn("stats", text.with_stat(F.col("stats"), "collapsed", F.col("trip_id") % 2 == 0)).select("trip_id", "stats.*")


@query("C14_effective_group", f"WITH {PLAN_PLACES}, {PLAN_TRIPS}, {_GROUPED} SELECT place_id, eff AS effective_group_id FROM grouped")
def c14(spark, sf):
    return organise.effective_group(_grouped(spark, sf), plan_trips(spark, sf)).select("place_id", "effective_group_id")


@query("C18_distinct_pairs", f"WITH {PLAN_PLACES} SELECT DISTINCT geo_country, trip_id FROM plan_places")
def c18(spark, sf):
    return organise.distinct_key_trip(plan_places(spark, sf), "geo_country")


@query("C9_filters", f"WITH {PLAN_PLACES}, {PLAN_TRIPS}, {_TAGS} SELECT trip_id FROM plan_trips WHERE trip_id IN (SELECT trip_id FROM trip_tags WHERE tag_id = 1) AND trip_id IN (SELECT trip_id FROM plan_places WHERE geo_city = 'NATION_12')")
def c9_filters(spark, sf):
    return organise.filter_trips(plan_trips(spark, sf), plan_places(spark, sf), _tags(spark, sf), tag=1, city="NATION_12").select("trip_id")


_STATS = """tm AS (SELECT trip_id, sum(distance_m) AS total, count(*) FILTER (WHERE distance_m IS NULL) AS unknown, count(*) AS tracks FROM plan_tracks GROUP BY trip_id),
pm AS (SELECT trip_id, count(*) AS places, count(*) FILTER (WHERE is_inferred) AS inferred, list_sort(list(DISTINCT tz_name)) AS zones FROM plan_places GROUP BY trip_id),
fm AS (SELECT trip_id, count(*) AS photos FROM plan_photos GROUP BY trip_id),
stats AS (SELECT trip_id, local_date, coalesce(total, 0) AS distance_total_m, coalesce(unknown, 0) AS distance_unknown_segments, coalesce(places, 0) AS place_count, coalesce(tracks, 0) AS track_count, coalesce(photos, 0) AS photo_count, coalesce(inferred, 0) AS inferred_dwell_count, coalesce(zones, []) AS timezones
  FROM plan_trips LEFT JOIN tm USING (trip_id) LEFT JOIN pm USING (trip_id) LEFT JOIN fm USING (trip_id))"""
_WORLD = f"{PLAN_PLACES}, {PLAN_TRIPS}, {PLAN_TRACKS}, {PLAN_PHOTOS}"


def _stats(spark, sf):
    return days.trip_stats(plan_trips(spark, sf), plan_places(spark, sf), plan_tracks(spark, sf), plan_photos(spark, sf))


@query("E9_trip_stats", f"WITH {_WORLD}, {_STATS} SELECT trip_id, distance_total_m, coalesce((SELECT sum(distance_m) FROM plan_tracks t WHERE t.trip_id = s.trip_id AND mode = 'car'), 0) AS car_m, distance_unknown_segments, place_count, track_count, photo_count, inferred_dwell_count, timezones, photo_count > 0 AND place_count = 0 AND track_count = 0 AS photo_only FROM stats s")
def e9(spark, sf):
    return _stats(spark, sf).withColumn("car_m", F.coalesce(F.try_element_at("distance_by_mode_m", F.lit("car")), F.lit(0.0))).drop("distance_by_mode_m")


def _panel(spark, sf):
    photos = plan_photos(spark, sf).withColumn("location_confidence", F.when(F.col("photo_id") % 5 == 0, "inferred").otherwise("measured"))
    return organise.stats_panel(plan_trips(spark, sf), plan_places(spark, sf), plan_tracks(spark, sf), photos, from_=_day("2024-01-03"), to=_day("2024-02-10"))


_CHOSEN = "chosen AS (SELECT * FROM plan_trips WHERE local_date BETWEEN DATE '2024-01-03' AND DATE '2024-02-10')"


@query("E10_panel_by_mode", f"WITH {_WORLD}, {_CHOSEN} SELECT user_id, mode, coalesce(sum(distance_m), 0) AS distance_m, count(*) FILTER (WHERE distance_m IS NULL) AS unknown_count, count(*) AS segment_count, sum(duration_s)::BIGINT AS duration_s FROM plan_tracks WHERE trip_id IN (SELECT trip_id FROM chosen) GROUP BY ALL")
def e10_mode(spark, sf):
    return _panel(spark, sf)["by_mode"]


@query("E10_panel_totals", f"""WITH {_WORLD}, {_CHOSEN}, c AS (SELECT user_id, count(DISTINCT geo_country) AS countries, count(DISTINCT geo_city) AS cities, count(*) AS place_count, count(*) FILTER (WHERE is_inferred) AS inferred_dwell_count FROM plan_places WHERE trip_id IN (SELECT trip_id FROM chosen) GROUP BY 1),
f AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE photo_id % 5 = 0) AS inferred, count(*) FILTER (WHERE lat IS NULL) AS unlocated FROM plan_photos WHERE trip_id IN (SELECT trip_id FROM chosen) GROUP BY 1)
SELECT * FROM (SELECT user_id, count(*) AS trip_count, min(local_date) AS first_day, max(local_date) AS last_day FROM chosen GROUP BY 1) JOIN c USING (user_id) LEFT JOIN f USING (user_id)""")
def e10_totals(spark, sf):
    p = _panel(spark, sf)
    return p["totals"].join(p["coverage"], "user_id").join(p["photos"], "user_id", "left")


@query("E11_activity", f"""WITH {_WORLD} SELECT t.user_id, t.local_date AS day, (SELECT count(*) FROM plan_places p WHERE p.trip_id = t.trip_id) AS places, coalesce((SELECT sum(distance_m) FROM plan_tracks m WHERE m.trip_id = t.trip_id), 0) AS distance_m FROM plan_trips t""")
def e11_activity(spark, sf):
    return organise.daily_activity(plan_trips(spark, sf), plan_places(spark, sf), plan_tracks(spark, sf))


@query("E11_activity_quirk", f"""WITH {_WORLD} SELECT t.user_id, t.local_date AS day, (SELECT count(*) FROM plan_places p WHERE p.trip_id = t.trip_id) AS places, coalesce((SELECT sum(DISTINCT m.duration_s::DOUBLE) FROM plan_tracks m WHERE m.trip_id = t.trip_id), 0) AS distance_m FROM plan_trips t""")
def e11_quirk(spark, sf):
    # Durations stand for lengths, as a day's two are often equal.
    return organise.daily_activity(plan_trips(spark, sf), plan_places(spark, sf), plan_tracks(spark, sf).withColumn("distance_m", F.col("duration_s").cast("double")), distinct_quirk=True)


@query("E12_density", f"""WITH {_WORLD}, d AS (SELECT t.user_id, date_trunc('month', t.local_date)::DATE AS month, (SELECT count(*) FROM plan_places p WHERE p.trip_id = t.trip_id) + CASE WHEN (SELECT sum(distance_m) FROM plan_tracks m WHERE m.trip_id = t.trip_id) > 0 THEN 1 ELSE 0 END AS w FROM plan_trips t WHERE user_id % 2 = 0 OR local_date < DATE '2024-02-01')
SELECT user_id, month, sum(w)::BIGINT AS weight FROM d GROUP BY ALL""")
def e12_density(spark, sf):
    t = plan_trips(spark, sf).where("user_id % 2 = 0 or local_date < date '2024-02-01'")
    return organise.monthly_density(organise.daily_activity(t, plan_places(spark, sf), plan_tracks(spark, sf)))


@query("E12_monthly_density", """WITH m AS (SELECT o_custkey AS user_id, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS places, count(DISTINCT o_orderdate::DATE) AS days FROM orders GROUP BY ALL),
s AS (SELECT user_id, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM m GROUP BY user_id)
SELECT user_id, month, coalesce(places + days, 0) AS weight FROM s LEFT JOIN m USING (user_id, month)""")
def e12_orders(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("places"), F.sum("o_totalprice").alias("distance_m"))
    return organise.monthly_density(o)


@query("E13_month_bars", f"WITH {PLAN}, {PLAN_TRIPS} SELECT user_id, m AS month, (SELECT count(*) FROM plan_trips t WHERE t.user_id = u.user_id AND month(local_date) = m) AS trips FROM (SELECT DISTINCT user_id FROM plan_trips) u, range(1, 13) r(m)")
def e13_bars(spark, sf):
    return organise.month_bars(plan_trips(spark, sf), 2024).withColumn("month", F.col("month").cast("long"))


@query("E14_countries", f"""WITH {_WORLD}, {_STATS}, pairs AS (SELECT DISTINCT geo_country, trip_id FROM plan_places) SELECT k.geo_country, trip_count, photo_count, distance_m, first_day, last_day, coalesce(city_count, 0) AS city_count FROM
(SELECT p.geo_country, count(*) AS trip_count, sum(photo_count)::BIGINT AS photo_count, sum(distance_total_m) AS distance_m, min(local_date) AS first_day, max(local_date) AS last_day FROM pairs p JOIN stats USING (trip_id) GROUP BY ALL) k
LEFT JOIN (SELECT geo_country, count(DISTINCT geo_city) AS city_count FROM plan_places WHERE geo_city IS NOT NULL GROUP BY ALL) c ON c.geo_country IS NOT DISTINCT FROM k.geo_country""")
def e14_countries(spark, sf):
    return organise.overview(plan_trips(spark, sf), plan_places(spark, sf), _stats(spark, sf))


@query("E14_cities", f"""WITH {_WORLD}, {_STATS}, pairs AS (SELECT DISTINCT geo_city, trip_id FROM plan_places) SELECT p.geo_city, count(*) AS trip_count, sum(photo_count)::BIGINT AS photo_count, sum(distance_total_m) AS distance_m, min(local_date) AS first_day, max(local_date) AS last_day, (SELECT min(geo_country) FROM plan_places q WHERE q.geo_city IS NOT DISTINCT FROM p.geo_city) AS geo_country FROM pairs p JOIN stats USING (trip_id) GROUP BY ALL""")
def e14_cities(spark, sf):
    return organise.overview(plan_trips(spark, sf), plan_places(spark, sf), _stats(spark, sf), "geo_city")


@query("E24_rollup", f"WITH {PLAN_PLACES} SELECT geo_country, geo_city, grouping_id(geo_country, geo_city) AS level, count(DISTINCT trip_id) AS trips FROM plan_places GROUP BY ROLLUP (geo_country, geo_city)")
def e24_rollup(spark, sf):
    return organise.overview_rollup(plan_places(spark, sf))


@query("E16_group_counts", f"WITH {PLAN_PLACES}, {PLAN_TRIPS}, {_GROUPED} SELECT g AS group_id, (SELECT count(*) FROM plan_trips WHERE group_id = g) AS trip_count, (SELECT count(*) FROM grouped WHERE eff = g) AS place_count FROM range(0, 6) r(g)")
def e16(spark, sf):
    return organise.group_counts(spark.range(6).withColumnRenamed("id", "group_id"), plan_trips(spark, sf), _grouped(spark, sf))


@query("E16_tag_counts", f"WITH {PLAN_PLACES}, {_TAGS} SELECT g AS tag_id, (SELECT count(*) FROM trip_tags WHERE tag_id = g) AS trip_count, (SELECT count(*) FROM plan_places WHERE place_id % 4 = g) AS place_count FROM range(1, 4) r(g)")
def e16_tags(spark, sf):
    p = plan_places(spark, sf).select("place_id", (F.col("place_id") % 4).alias("tag_id"))
    return organise.tag_counts(spark.range(1, 4).withColumnRenamed("id", "tag_id"), _tags(spark, sf), p)


@query("E23_tag_lists", f"WITH {PLAN}, {_TAGS} SELECT trip_id, coalesce((SELECT list_sort(list(tag_id)) FROM trip_tags t WHERE t.trip_id = p.trip_id), []) AS tag_ids FROM plan p")
def e23(spark, sf):
    return organise.tag_lists(plan_trips(spark, sf), _tags(spark, sf))


@query("E20_selection", f"""WITH {_WORLD}, sel AS (SELECT * FROM plan_trips WHERE trip_id % 4 = 1) SELECT user_id, trips, first_day, last_day, round(known_km, 6) AS known_km, unknown_segments, places, round(west, 6) AS west, round(north, 6) AS north FROM (SELECT user_id, count(*) AS trips, min(local_date) AS first_day, max(local_date) AS last_day FROM sel GROUP BY 1)
LEFT JOIN (SELECT user_id, sum(distance_m) / 1000 AS known_km, count(*) FILTER (WHERE distance_m IS NULL) AS unknown_segments FROM plan_tracks WHERE trip_id IN (SELECT trip_id FROM sel) GROUP BY 1) USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS places, min(lon) AS west, max(lat) AS north FROM plan_places WHERE trip_id IN (SELECT trip_id FROM sel) GROUP BY 1) USING (user_id)""")
def e20(spark, sf):
    got = organise.selection_summary(plan_trips(spark, sf).where("trip_id % 4 = 1"), plan_places(spark, sf), plan_tracks(spark, sf))
    return got.select("user_id", "trips", "first_day", "last_day", r6(F.col("known_km")).alias("known_km"), "unknown_segments", "places", r6(F.col("west")).alias("west"), r6(F.col("north")).alias("north"))


@query("E8_trip_boxes", f"""WITH {PLAN_PLACES}, b AS (SELECT trip_id, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM plan_places GROUP BY 1) SELECT trip_id, round(CASE WHEN w = e THEN w - 1e-6 ELSE w END, 7) AS west, round(CASE WHEN s = n THEN s - 1e-6 ELSE s END, 7) AS south, round(CASE WHEN w = e THEN e + 1e-6 ELSE e END, 7) AS east, round(CASE WHEN s = n THEN n + 1e-6 ELSE n END, 7) AS north FROM b""")
def e8_boxes(spark, sf):
    b = plan_places(spark, sf).groupBy("trip_id").agg(*organise.bbox("lat", "lon"))
    return b.select("trip_id", *[F.round(c, 7).alias(c) for c in ("west", "south", "east", "north")])


@query("E22_city_of_trips", f"""WITH {PLAN_PLACES}, s AS (SELECT trip_id, geo_city, sum(epoch_us("end") - epoch_us(start)) AS s FROM plan_places WHERE geo_city IS NOT NULL GROUP BY ALL), l AS (SELECT trip_id, list_sort(list(DISTINCT geo_country)) AS countries FROM plan_places WHERE geo_country IS NOT NULL GROUP BY 1)
SELECT trip_id, city, countries FROM (SELECT trip_id, arg_max(geo_city, (s, geo_city)) AS city FROM s GROUP BY 1) FULL JOIN l USING (trip_id)""")
def e22_trips(spark, sf):
    return organise.main_city(plan_places(spark, sf))


@query("B29_titles", f"""WITH {PLAN_PLACES}, s AS (SELECT trip_id, geo_city, sum(epoch_us("end") - epoch_us(start)) AS s FROM plan_places WHERE geo_city IS NOT NULL GROUP BY ALL), c AS (SELECT trip_id, arg_max(geo_city, (s, geo_city)) AS city FROM s GROUP BY 1),
l AS (SELECT trip_id, list_sort(list(DISTINCT geo_country)) AS k FROM plan_places WHERE geo_country IS NOT NULL GROUP BY 1)
SELECT trip_id, CASE WHEN len(k) >= 2 THEN k[1] || ' → ' || k[-1] || ' · ' || strftime(day, '%m-%d') WHEN city IS NOT NULL THEN city || ' · ' || strftime(day, '%m-%d') WHEN trip_id % 2 = 0 THEN 'Commute · ' || strftime(day, '%m-%d') ELSE strftime(day, '%Y-%m-%d') END AS title FROM plan LEFT JOIN c USING (trip_id) LEFT JOIN l USING (trip_id)""")
def b29_titles(spark, sf):
    t = plan_trips(spark, sf).join(organise.main_city(plan_places(spark, sf)), "trip_id", "left")
    made = text.make_title(F.col("local_date"), F.coalesce("countries", F.array().cast("array<string>")), F.col("city"), F.col("trip_id") % 2 == 0)
    return t.select("trip_id", made.alias("title"))


@query("E21_import_report", f"""WITH {PLAN_PLACES}, {PLAN_TRACKS}, p AS (SELECT trip_id % 5 AS source_id, start AS ts, place_id % 9 = 0 AS dup FROM plan_places), s AS (SELECT track_id % 5 AS source_id, count(*) FILTER (WHERE mode = 'walk') AS w FROM plan_tracks GROUP BY 1), t AS (SELECT trip_id % 5 AS source_id, count(*) AS trip_count, count(*) FILTER (WHERE trip_id % 8 = 0) AS tz_crossing_days, list_sort(list(trip_id))[:200] AS trip_ids FROM plan GROUP BY 1)
SELECT source_id, points, duplicates, first_ts, last_ts, nullif(w, 0) AS skipped_walk, trip_count, tz_crossing_days, trip_ids FROM (SELECT source_id, count(*) AS points, count(*) FILTER (WHERE dup) AS duplicates, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY 1) JOIN s USING (source_id) JOIN t USING (source_id)""")
def e21(spark, sf):
    p = plan_places(spark, sf).select((F.col("trip_id") % 5).alias("source_id"), F.col("start").alias("ts"), (F.col("place_id") % 9 == 0).alias("is_duplicate"))
    s = plan_tracks(spark, sf).groupBy((F.col("track_id") % 5).alias("source_id"), F.col("mode").alias("reason")).agg(F.count("*").alias("count"))
    t = plan_trips(spark, sf).select((F.col("trip_id") % 5).alias("source_id"), "trip_id", (F.col("trip_id") % 8 == 0).alias("crosses_tz"))
    got = organise.import_report(p, s, t)
    return got.withColumn("skipped_walk", F.try_element_at("skipped", F.lit("walk"))).drop("skipped")


@query("F16_import_policy", f"WITH {PLAN}, {PLAN_TRIPS} SELECT trip_id, coalesce(group_id, CASE WHEN trip_id % 4 = 0 THEN 9 END) AS group_id FROM plan_trips")
def f16(spark, sf):
    t = plan_trips(spark, sf)
    return organise.apply_import_policy(t, t.where("trip_id % 4 = 0"), _tags(spark, sf), 9, [2, 3])[0].select("trip_id", "group_id")


@query("F16_import_tags", f"WITH {PLAN}, {_TAGS} SELECT trip_id, tag_id FROM trip_tags UNION SELECT trip_id, t FROM plan, (VALUES (2), (3)) v(t) WHERE trip_id % 4 = 0")
def f16_tags(spark, sf):
    t = plan_trips(spark, sf)
    return organise.apply_import_policy(t, t.where("trip_id % 4 = 0"), _tags(spark, sf), 9, [2, 3])[1]


@query("F17_bulk_assign", f"WITH {PLAN}, {PLAN_TRIPS}, {_TAGS} SELECT trip_id, CASE WHEN trip_id % 7 = 0 THEN 2 ELSE group_id END AS group_id, coalesce((SELECT list_sort(list(DISTINCT tag_id)) FROM (SELECT tag_id FROM trip_tags x WHERE x.trip_id = t.trip_id AND NOT (t.trip_id % 7 = 0 AND tag_id = 1) UNION SELECT 3 WHERE t.trip_id % 7 = 0)), []) AS tag_ids FROM plan_trips t")
def f17(spark, sf):
    t = plan_trips(spark, sf)
    one = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    wanted = t.where("trip_id % 7 = 0").select("trip_id", F.lit(2).cast("long").alias("group_id"), one(3).alias("add_tags"), one(1).alias("remove_tags"))
    groups = spark.range(4).select(F.col("id").alias("group_id"), F.when(F.col("id") == 0, "system").otherwise("user").alias("kind"))
    items, links = organise.bulk_assign(t, _tags(spark, sf), wanted, groups)
    return items.select("trip_id", "group_id").join(organise.tag_lists(items, links), "trip_id")


@query("I2_places_in_time", f"WITH {PLAN_PLACES} SELECT place_id, start FROM plan_places ORDER BY start, place_id LIMIT 300")
def i2(spark, sf):
    return organise.earliest(plan_places(spark, sf), "start", 300, "place_id").select("place_id", "start")


@query("I4_fences_by_visit", f"WITH {FENCES} SELECT fence_id, last_visit FROM fences ORDER BY last_visit DESC NULLS LAST, fence_id")
def i4(spark, sf):
    return organise.fences_by_last_visit(fences(spark, sf)).select("fence_id", "last_visit")


@query("I5_unified_search", f"""WITH {PLAN_PLACES}, {PLAN_TRIPS} (SELECT 'trip' AS kind, trip_id AS id, title AS name FROM plan_trips WHERE contains(lower(title), 'an') ORDER BY local_date DESC, trip_id LIMIT 20) UNION ALL (SELECT 'place', place_id, geo_city FROM plan_places WHERE contains(lower(geo_city), 'an') ORDER BY start DESC, place_id LIMIT 20)""")
def i5_search(spark, sf):
    return organise.search(plan_trips(spark, sf), plan_places(spark, sf), "AN")


@query("I7_expanded", f"""WITH {_WORLD} SELECT trip_id, (SELECT list(place_id ORDER BY start, place_id) FROM plan_places p WHERE p.trip_id = t.trip_id) AS places, coalesce((SELECT list(track_id ORDER BY start, track_id) FROM plan_tracks p WHERE p.trip_id = t.trip_id), []) AS tracks, coalesce((SELECT list(photo_id) FROM plan_photos p WHERE p.trip_id = t.trip_id), []) AS photos FROM plan_trips t""")
def i7(spark, sf):
    e = organise.expand_trips(plan_trips(spark, sf), plan_places(spark, sf), plan_tracks(spark, sf), plan_photos(spark, sf))
    return e.select("trip_id", *[F.col(c).getField(k).alias(c) for c, k in (("places", "place_id"), ("tracks", "track_id"), ("photos", "photo_id"))])


@query("I8_members", f"""WITH {PLAN_PLACES}, {PLAN_TRIPS}, {_GROUPED} SELECT 'trip' AS kind, trip_id AS id, local_date::TIMESTAMP AS at, false AS inherited FROM plan_trips WHERE group_id = 3 UNION ALL SELECT 'place', place_id, start, own_group IS NULL FROM grouped WHERE eff = 3""")
def i8(spark, sf):
    return organise.members(plan_trips(spark, sf), _grouped(spark, sf), 3)


@query("I9_sources", f"WITH {PLAN} SELECT d AS source_id, max(day) AS imported_at, count(*) AS rows_read FROM plan GROUP BY d")
def i9(spark, sf):
    s = plan_trips(spark, sf).groupBy((F.col("trip_id") % 45).alias("source_id")).agg(F.max("local_date").alias("imported_at"), F.count("*").alias("rows_read"))
    return organise.list_sources(s)


@query("D17_cover_photo", f"""WITH {PLAN}, {PLAN_PHOTOS} SELECT trip_id, CASE WHEN trip_id % 18 = 0 THEN -1 ELSE photo_id END AS cover_photo_id FROM plan LEFT JOIN plan_photos USING (trip_id)""")
def d17_cover(spark, sf):
    from waymark.operators import photos

    t = plan_trips(spark, sf).select("trip_id", F.when(F.col("trip_id") % 18 == 0, F.lit(-1)).cast("long").alias("cover_photo_id"))
    return photos.cover_photos(t, plan_photos(spark, sf))


@query("C19_insert_ignore", """WITH a AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' AND event_id % 3 = 0 GROUP BY 1), b AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE user_id NOT IN (SELECT user_id FROM a)""")
def c19_new(spark, sf):
    e = table(spark, sf, "events")
    first = e.where("event_type = 'click' and event_id % 3 = 0").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    # All views come in, many for each user; the earliest of a new one stays.
    return points.insert_ignore(first, e.where("event_type = 'view'").select("user_id", "event_id"), ["user_id"], order=["event_id"])

