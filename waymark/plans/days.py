"""Queries on fused movements, modes, days and photos."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import days, fusion, incremental, intervals, photos, points, stays
from waymark.operators.graph import new_path
from waymark.plans.fixtures import LAT, LON, PINGS, PLAN, PLAN_PHOTOS, PLAN_PLACES, PLAN_TRACKS, VISITS, ZONES, hav, pick, pings, plan_photos, plan_places, plan_tracks, table, visits
from waymark.plans.fixtures import photos as event_photos
from waymark.plans.queries import P, _MERGE, _MOVES, _SCAN, moves, query, r3, r6

# Declared movements: two ends and six minutes from each click; a length for every other one.
_HINTS = """hints AS (SELECT e.user_id, e.event_id AS hint_id, e.ts AS start, e.ts + INTERVAL 6 MINUTE AS "end", CASE WHEN e.event_id % 2 = 1 THEN (e.event_id % 5000)::DOUBLE END AS declared_m, CASE e.event_id % 3 WHEN 0 THEN 'walk' WHEN 1 THEN 'car' ELSE 'unknown' END AS mode, 'google' AS mode_source,
  ([35.6, 40.7, 51.5]::DOUBLE[])[(user_id % 3 + 1)::INT] AS la, ([139.7, -74.0, -0.1]::DOUBLE[])[(user_id % 3 + 1)::INT] AS lo FROM events e WHERE event_type = 'click')"""


def _hints(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'click'")
    at, u, i = F.col("ts").cast("timestamp_ntz"), F.col("user_id"), F.col("event_id")
    la, lo = pick(u % 3, LAT), pick(u % 3, LON)
    spot = lambda d: F.struct((la + d).alias("lat"), (lo + d).alias("lon"))
    return e.select("user_id", i.alias("hint_id"), at.alias("start"), (at + F.expr("interval 6 minutes")).alias("end"), F.array(spot(0.0), spot(0.01)).alias("points"), F.when(i % 2 == 1, (i % 5000).cast("double")).alias("distance_m"), pick(i % 3, ("walk", "car", "unknown")).alias("mode"), F.lit("google").alias("mode_source"))


def _few(spark, sf):
    """Pings of two events in three: the others' movements keep their declared ends."""
    return pings(spark, sf).where("event_id % 3 <> 2")


_FUSED = f"""fp AS (SELECT h.hint_id, p.ts, p.lat, p.lon, p.event_id FROM hints h JOIN pings p ON p.user_id = h.user_id AND p.ts BETWEEN h.start AND h."end" AND p.event_id % 3 <> 2),
fs AS (SELECT *, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS dt FROM fp WINDOW w AS (PARTITION BY hint_id ORDER BY ts, lat, lon)),
fm AS (SELECT hint_id, count(*) AS n, coalesce(sum(step), 0) AS path_m, list_sort(list(step / dt) FILTER (WHERE dt > 0)) AS v FROM fs GROUP BY 1 HAVING count(*) >= 2),
fused AS (SELECT h.*, fm.n IS NOT NULL AS full_, CASE WHEN fm.n IS NOT NULL THEN path_m ELSE declared_m END AS distance_m, coalesce(fm.n, 2) AS point_count, greatest(1, (epoch_us("end") - epoch_us(start)) // 1000000) AS duration_s, v FROM hints h LEFT JOIN fm USING (hint_id)),
fuse AS (SELECT *, coalesce(v[round_even(0.5 * (len(v) - 1), 0)::INT + 1], distance_m / duration_s) AS median_mps, coalesce(v[round_even(0.95 * (len(v) - 1), 0)::INT + 1], distance_m / duration_s) AS p95_mps FROM fused)"""


@query("F1_fused_activities", f"WITH {PINGS}, {_HINTS}, {_FUSED} SELECT hint_id, CASE WHEN full_ THEN 'full' ELSE 'endpoints_only' END AS geom_quality, round(distance_m, 3) AS distance_m, distance_m IS NULL AS distance_unknown, point_count, round(median_mps, 6) AS median_mps, round(p95_mps, 6) AS p95_mps FROM fuse")
def f1(spark, sf):
    got = fusion.fuse_activities(_hints(spark, sf), _few(spark, sf))
    return got.select("hint_id", "geom_quality", r3(F.col("distance_m")).alias("distance_m"), "distance_unknown", F.col("point_count").cast("long").alias("point_count"), r6(F.col("speed_median_mps")).alias("median_mps"), r6(F.col("speed_p95_mps")).alias("p95_mps"))


_RULES = "CASE WHEN {m} IS NULL OR {p} IS NULL OR ({m} < 0.3 AND {p} < 1) THEN 'unknown' WHEN {m} < 2 AND {p} < 3.5 THEN 'walk' WHEN {m} >= 2 AND {m} < 4 AND {p} < 6.5 THEN 'run' WHEN {m} >= 2.5 AND {m} < 8.5 AND {p} < 14 THEN 'bike' WHEN {m} >= 8.5 AND {m} < 33 THEN 'car' WHEN {m} >= 33 AND {m} < 55 THEN 'transit' WHEN {m} >= 55 AND {s} > 0.9 AND {d} > 100000 THEN CASE WHEN {a} > 3000 THEN 'flight' ELSE 'transit' END ELSE 'unknown' END"


@query("F3_flights", f"""WITH t AS (SELECT event_id, (event_id % 30) * 10.0::DOUBLE AS m, (event_id % 7) * 60.0::DOUBLE AS p, (event_id % 11) * 20000.0::DOUBLE AS d, (event_id % 13) / 12.0::DOUBLE AS s, CASE WHEN event_id % 4 > 0 THEN (event_id % 9) * 1000.0::DOUBLE END AS a FROM events) SELECT event_id, {_RULES.format(m='m', p='p', s='s', d='d', a='a')} AS mode FROM t""")
def f3_flights(spark, sf):
    from waymark.functions.text import infer_mode

    i = F.col("event_id")
    m = infer_mode((i % 30) * 10.0, (i % 7) * 60.0, (i % 11) * 20000.0, (i % 13) / 12.0, F.when(i % 4 > 0, (i % 9) * 1000.0))
    return table(spark, sf, "events").select("event_id", m["mode"].alias("mode"))


@query("F4_mode_precedence", f"""WITH {PINGS}, {_HINTS}, {_FUSED} SELECT hint_id, CASE WHEN mode <> 'unknown' THEN mode ELSE {_RULES.format(m='median_mps', p='p95_mps', s='0', d='0', a='0')} END AS mode, CASE WHEN mode <> 'unknown' THEN 'google' ELSE 'inferred' END AS mode_source FROM fuse WHERE full_ OR declared_m IS NOT NULL""")
def f4(spark, sf):
    got = fusion.apply_mode(fusion.fuse_activities(_hints(spark, sf), _few(spark, sf)).where("distance_m is not null"))
    return got.select("hint_id", "mode", "mode_source")


@query("F2_declared_stays", f"""WITH {VISITS} SELECT hint_id, user_id, start, "end", round(lat, 6) + 0 AS lat, 1 AS point_count, ['google_timeline'] AS source_kinds, semantic_type FROM visits""")
def f2(spark, sf):
    return fusion.stays_from_hints(visits(spark, sf)).select("hint_id", "user_id", "start", "end", r6(F.col("lat")).alias("lat"), "point_count", "source_kinds", "semantic_type")


@query("C16_all_events", f"""WITH {PLAN_PLACES}, {PLAN_TRACKS}, {PLAN_PHOTOS} SELECT kind, user_id, count(*) AS n, min(start) AS first_start, count(tz_name) AS zones FROM (SELECT 'stay' AS kind, user_id, start, tz_name FROM plan_places UNION ALL SELECT 'move', user_id, start, NULL FROM plan_tracks UNION ALL SELECT 'photo', user_id, ts, tz_name FROM plan_photos) GROUP BY ALL""")
def c16(spark, sf):
    kind = lambda k, d: d.withColumn("kind", F.lit(k))
    e = fusion.combine_events(kind("stay", plan_places(spark, sf)), kind("move", plan_tracks(spark, sf)), kind("photo", plan_photos(spark, sf).withColumnRenamed("ts", "start")))
    return e.groupBy("kind", "user_id").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.count("tz_name").alias("zones"))


@query("C17_union_kinds", "SELECT event_id, list_sort(list_distinct(list_concat(CASE WHEN event_id % 4 > 0 THEN ['gpx', event_type] ELSE [] END, CASE WHEN event_id % 3 > 0 THEN ['gpx', 'photo'] ELSE [] END))) AS kinds FROM events")
def c17(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", fusion.union_kinds(F.when(i % 4 > 0, F.array(F.lit("gpx"), "event_type")), F.when(i % 3 > 0, F.array(F.lit("gpx"), F.lit("photo")))).alias("kinds"))


@query("C21_neighbour_stays", f"""WITH {PLAN_PLACES}, {PLAN_TRACKS} SELECT track_id, (SELECT max("end") FROM plan_places p WHERE p.user_id = t.user_id AND p."end" <= t.start) AS before_end, (SELECT min(start) FROM plan_places p WHERE p.user_id = t.user_id AND p.start >= t."end") AS after_start FROM plan_tracks t""")
def c21(spark, sf):
    got = stays.neighbour_stays(plan_tracks(spark, sf).select("user_id", "track_id", "start", "end"), plan_places(spark, sf))
    return got.select("track_id", F.col("from_.ts").alias("before_end"), F.col("to_.ts").alias("after_start"))


@query("D7_bridged_gaps", f"""WITH {PLAN_PLACES}, {PLAN_TRACKS}, n AS (SELECT user_id, place_id, "end" AS a, lead(start) OVER (PARTITION BY user_id ORDER BY start, "end", place_id) AS b FROM plan_places)
SELECT user_id, place_id AS event_id, a AS start, b AS "end", (epoch_us(b) - epoch_us(a)) // 1000000 AS duration_s FROM n WHERE epoch_us(b) - epoch_us(a) > 60000000 AND NOT EXISTS (SELECT 1 FROM plan_tracks t WHERE t.user_id = n.user_id AND t.day BETWEEN n.a::DATE - 1 AND n.b::DATE + 1 AND t.track_id % 5 > 0 AND t.start < n.b AND t."end" > n.a)""")
def d7_bridged(spark, sf):
    got = days.implied_moves(plan_places(spark, sf).withColumnRenamed("place_id", "event_id"), plan_tracks(spark, sf).where("track_id % 5 > 0"))
    return got.select("user_id", "event_id", "start", "end", "duration_s")


@query("D7_implied_moves", f"""WITH RECURSIVE {PINGS}, {_SCAN}, {_MERGE}, {_MOVES}, {VISITS}, n AS (SELECT user_id, hint_id, "end" AS a, lead(start) OVER (PARTITION BY user_id ORDER BY start, "end", hint_id) AS b FROM visits)
SELECT user_id, hint_id, a AS start, b AS "end" FROM n WHERE epoch_us(b) - epoch_us(a) > 60000000 AND NOT EXISTS (SELECT 1 FROM moves m WHERE m.distance_m >= 100 AND m.user_id = n.user_id AND m.start < n.b AND m."end" > n.a)""")
def d7_unmeasured(spark, sf):
    got = days.implied_moves(visits(spark, sf).withColumnRenamed("hint_id", "event_id"), moves(spark, sf)[1].select("user_id", "start", "end"))
    return got.select("user_id", F.col("event_id").alias("hint_id"), "start", "end")


@query("D16_thinned", f"WITH {PINGS} SELECT event_id, count(*) AS vertices FROM pings GROUP BY 1 HAVING count(*) >= 2")
def d16(spark, sf):
    # Each line with every vertex twice over, the copies 0.3 m off: thinning leaves the lines as they were.
    p = pings(spark, sf)
    near = p.withColumn("lat", F.col("lat") + 0.0000027)
    lines = p.withColumn("o", F.lit(0)).unionByName(near.withColumn("o", F.lit(1))).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("k", "o", "lat", "lon"))).alias("points"))
    return lines.select("event_id", F.size(fusion.thin_vertices(F.col("points"))).cast("long").alias("vertices"))


_GRID = "grid AS (SELECT DISTINCT round_even(lat, 2) AS lat_q, round_even(lon, 2) AS lon_q FROM plan_places WHERE user_id % 4 > 0)"


def _grid(spark, sf):
    """Zones of the cells that most users' places lie in; the rest have theirs by longitude."""
    p = plan_places(spark, sf).where("user_id % 4 > 0")
    t = plan_tracks(spark, sf).where("user_id % 4 > 0").select("user_id", F.inline("points"))
    cells = p.select("user_id", "lat", "lon").unionByName(t).select((F.bround(F.col("lat") * 100) / 100).alias("lat_q"), (F.bround(F.col("lon") * 100) / 100).alias("lon_q"), pick(F.col("user_id") % 3, ZONES).alias("tz_name"))
    return cells.groupBy("lat_q", "lon_q").agg(F.min("tz_name").alias("tz_name"))


_OCEAN = "CASE WHEN o = 0 THEN 'Etc/GMT' WHEN o > 0 THEN 'Etc/GMT-' || o ELSE 'Etc/GMT+' || -o END"
_CITY_ZONE = "['Asia/Tokyo', 'America/New_York', 'Europe/London'][(user_id % 3 + 1)::INT]"


@query("B6_zone_of_position", f"""WITH {PLAN_PLACES}, {PLAN_TRACKS}, cells AS (SELECT round_even(lat * 100, 0)::INT AS a, round_even(lon * 100, 0)::INT AS b, min({_CITY_ZONE}) AS z FROM (SELECT user_id, lat, lon FROM plan_places UNION ALL SELECT user_id, p.lat, p.lon FROM (SELECT user_id, unnest(points) AS p FROM plan_tracks)) WHERE user_id % 4 > 0 GROUP BY ALL)
SELECT place_id, coalesce(z, {_OCEAN}) AS tz_name FROM (SELECT *, greatest(-12, least(14, floor(lon / 15 + 0.5)::INT)) AS o FROM plan_places) p LEFT JOIN cells ON a = round_even(lat * 100, 0)::INT AND b = round_even(lon * 100, 0)::INT""")
def b6(spark, sf):
    return days.with_tz(plan_places(spark, sf).drop("tz_name"), _grid(spark, sf)).select("place_id", "tz_name")


def _events(spark, sf):
    """Stays with a zone for most, and moves whose zone is looked up."""
    p = plan_places(spark, sf).withColumnRenamed("place_id", "event_id").withColumn("tz_name", F.when(F.col("event_id") % 6 > 0, F.col("tz_name")))
    return days.assign_days(p.where("user_id % 4 > 0"), plan_tracks(spark, sf).where("user_id % 4 > 0").withColumnRenamed("track_id", "event_id"), _grid(spark, sf))


# Cells on the border of two users' cities don't occur: a cell's zone is that of its city.
_DAYS = f"""ev AS (SELECT 'stay' AS kind, user_id, place_id AS event_id, d AS local_date, tz_name, greatest(start, (d::TIMESTAMP AT TIME ZONE tz_name) AT TIME ZONE 'UTC') AS start, least("end", ((d + INTERVAL 1 DAY)::TIMESTAMP AT TIME ZONE tz_name) AT TIME ZONE 'UTC') AS "end", start = "end" AS still
    FROM (SELECT *, unnest(generate_series(((start AT TIME ZONE 'UTC') AT TIME ZONE tz_name)::DATE::TIMESTAMP, (("end" AT TIME ZONE 'UTC') AT TIME ZONE tz_name)::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM plan_places WHERE user_id % 4 > 0)
  UNION ALL SELECT 'move', user_id, track_id, ((start AT TIME ZONE 'UTC') AT TIME ZONE {_CITY_ZONE})::DATE, {_CITY_ZONE}, start, "end", true FROM plan_tracks WHERE user_id % 4 > 0),
assigned AS (SELECT * FROM ev WHERE start < "end" OR still)"""


@query("D9_assigned_days", f"""WITH {PLAN_PLACES}, {PLAN_TRACKS}, {_DAYS} SELECT kind, user_id, event_id, local_date, tz_name, start, "end", false AS crosses_tz FROM assigned""")
def d9(spark, sf):
    return _events(spark, sf)


@query("D10_day_spans", f"""WITH {PLAN_PLACES}, {PLAN_TRACKS}, {_DAYS} SELECT user_id, local_date, arg_min(tz_name, (start, kind = 'move', event_id)) AS anchor_tz, min(start) AS start, max("end") AS "end", count(*) FILTER (WHERE kind = 'stay') AS stays, count(*) FILTER (WHERE kind = 'move') AS moves FROM assigned GROUP BY ALL""")
def d10_spans(spark, sf):
    return days.trip_spans(_events(spark, sf)).drop("crosses_tz")


@query("D11_photo_days", f"""WITH {PLAN_PLACES}, {PLAN_TRACKS}, {PLAN_PHOTOS}, {_DAYS}, spans AS (SELECT user_id, local_date, min(start) AS a, max("end") AS b FROM assigned WHERE user_id % 8 <> 1 GROUP BY ALL)
SELECT f.user_id, f.photo_id, coalesce((SELECT min(local_date) FROM spans s WHERE s.user_id = f.user_id AND f.ts BETWEEN s.a AND s.b), f.ts::DATE) AS local_date FROM plan_photos f""")
def d11(spark, sf):
    return days.photos_to_days(plan_photos(spark, sf), days.trip_spans(_events(spark, sf)).where("user_id % 8 <> 1"))


@query("D11_kept_days", f"""WITH {PLAN_PLACES}, {PLAN_TRACKS}, {PLAN_PHOTOS}, {_DAYS}, spans AS (SELECT user_id, local_date, count(*) FILTER (WHERE kind = 'stay') AS stays, count(*) FILTER (WHERE kind = 'move') AS moves FROM assigned WHERE user_id % 8 <> 1 GROUP BY ALL),
f AS (SELECT user_id, day AS local_date, count(*) AS photos FROM plan_photos WHERE user_id % 8 = 1 GROUP BY ALL) SELECT user_id, local_date, coalesce(stays, 0) AS stays, coalesce(moves, 0) AS moves, coalesce(photos, 0) AS photos FROM spans FULL JOIN f USING (user_id, local_date) WHERE coalesce(stays, 0) > 0 OR coalesce(photos, 0) > 0""")
def d11_kept(spark, sf):
    spans = days.trip_spans(_events(spark, sf)).where("user_id % 8 <> 1")
    of = plan_photos(spark, sf).where("user_id % 8 = 1").select("user_id", "photo_id", F.col("day").alias("local_date"))
    return days.kept_days(spans, of).select("user_id", "local_date", "stays", "moves", "photos")


@query("D12_photo_only_stays", f"""WITH RECURSIVE {PLAN_PLACES}, {PLAN_PHOTOS}, cov AS (SELECT DISTINCT user_id, ((start AT TIME ZONE 'UTC') AT TIME ZONE tz_name)::DATE AS d FROM plan_places WHERE trip_id % 3 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, lat, lon) AS r FROM plan_photos f WHERE lat IS NOT NULL AND (user_id, ((ts AT TIME ZONE 'UTC') AT TIME ZONE tz_name)::DATE) NOT IN (SELECT (user_id, d) FROM cov)),
w AS (SELECT user_id, r, lat AS a, lon AS b, 1 AS n, 1 AS g FROM o WHERE r = 1 UNION ALL SELECT w.user_id, o.r, CASE WHEN near THEN a + o.lat ELSE o.lat END, CASE WHEN near THEN b + o.lon ELSE o.lon END, CASE WHEN near THEN n + 1 ELSE 1 END, CASE WHEN near THEN g ELSE g + 1 END
  FROM (SELECT w.*, o.r AS nr, {hav('a / n', 'b / n', 'o.lat', 'o.lon')} <= 150 AS near FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1) w JOIN o ON o.user_id = w.user_id AND o.r = nr)
SELECT user_id, min(ts) AS start, max(ts) AS "end", round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*)::INT AS point_count FROM o JOIN (SELECT user_id, r, g FROM w) USING (user_id, r) GROUP BY user_id, g""")
def d12(spark, sf):
    got = days.photo_only_stays(plan_photos(spark, sf), plan_places(spark, sf).where("trip_id % 3 = 0"), P)
    return got.select("user_id", "start", "end", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), "point_count")


@query("D4_photo_stays", f"""WITH RECURSIVE {PLAN}, {PLAN_PHOTOS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, lat, lon) AS r FROM plan_photos WHERE lat IS NOT NULL),
w AS (SELECT user_id, r, lat AS a, lon AS b, 1 AS n, 1 AS g FROM o WHERE r = 1 UNION ALL SELECT w.user_id, o.r, CASE WHEN near THEN a + o.lat ELSE o.lat END, CASE WHEN near THEN b + o.lon ELSE o.lon END, CASE WHEN near THEN n + 1 ELSE 1 END, CASE WHEN near THEN g ELSE g + 1 END
  FROM (SELECT w.*, o.r AS nr, {hav('a / n', 'b / n', 'o.lat', 'o.lon')} <= 250 AS near FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1) w JOIN o ON o.user_id = w.user_id AND o.r = nr)
SELECT user_id, min(ts) AS start, max(ts) AS "end", round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*)::INT AS point_count FROM o JOIN (SELECT user_id, r, g FROM w) USING (user_id, r) GROUP BY user_id, g""")
def d4(spark, sf):
    got = days.cluster_photo_stays(plan_photos(spark, sf), P.but(radius_m=250.0))
    return got.select("user_id", "start", "end", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), "point_count")


@query("D18_altitude_of_moves", f"""WITH {PINGS}, {PLAN}, {PLAN_TRACKS}, a AS (SELECT user_id, epoch_us(ts) // 3600000000 AS h, max(altitude_m) AS altitude_m FROM pings WHERE altitude_m IS NOT NULL GROUP BY ALL) SELECT track_id, altitude_m AS max_altitude_m FROM plan_tracks t LEFT JOIN a ON a.user_id = t.user_id AND h = epoch_us(start) // 3600000000""")
def d18_moves(spark, sf):
    return fusion.altitude_of_moves(plan_tracks(spark, sf), pings(spark, sf)).select("track_id", "max_altitude_m")


@query("D14_gain_with_unknown", f"""WITH {PINGS}, k AS (SELECT user_id, event_id, k, ts, CASE WHEN user_id % 5 > 0 THEN altitude_m END AS alt FROM pings), a AS (SELECT user_id, alt - lag(alt) OVER (PARTITION BY user_id ORDER BY ts, event_id, k) AS d FROM k WHERE alt IS NOT NULL), g AS (SELECT user_id, coalesce(sum(CASE WHEN d > 0 THEN d ELSE 0 END), 0) AS gain_m FROM a GROUP BY 1)
SELECT user_id, gain_m::DOUBLE AS gain_m FROM (SELECT DISTINCT user_id FROM pings) LEFT JOIN g USING (user_id)""")
def d14_unknown(spark, sf):
    return points.elevation_gain(pings(spark, sf).withColumn("altitude_m", F.when(F.col("user_id") % 5 > 0, F.col("altitude_m"))), "event_id", "k")


@query("B16_great_circle", f"""WITH {PINGS}, e AS (SELECT event_id, min_by(lat, k) AS la, min_by(lon, k) AS lo, max_by(lat, k) + event_id % 30 AS lb, max_by(lon, k) + event_id % 70 AS lob FROM pings GROUP BY event_id),
d AS (SELECT *, {hav('la', 'lo', 'lb', 'lob')} / 6371008.8 AS d FROM e), v AS (SELECT *, sin(0.75 * d) / sin(d) AS p, sin(0.25 * d) / sin(d) AS q FROM d WHERE d > 0),
x AS (SELECT *, p * cos(radians(la)) * cos(radians(lo)) + q * cos(radians(lb)) * cos(radians(lob)) AS x, p * cos(radians(la)) * sin(radians(lo)) + q * cos(radians(lb)) * sin(radians(lob)) AS y, p * sin(radians(la)) + q * sin(radians(lb)) AS z FROM v)
SELECT event_id, round(CASE WHEN d * 6371008.8 < 10000 THEN la + (lb - la) * 0.25 ELSE degrees(atan2(z, sqrt(x * x + y * y))) END, 8) + 0 AS lat, round(CASE WHEN d * 6371008.8 < 10000 THEN lo + (lob - lo) * 0.25 ELSE degrees(atan2(y, x)) END, 8) + 0 AS lon FROM x""")
def b16_far(spark, sf):
    e = pings(spark, sf).groupBy("event_id").agg(F.min_by(F.struct("lat", "lon"), "k").alias("a"), F.max_by(F.struct("lat", "lon"), "k").alias("b"))
    lb, lob = F.col("b.lat") + F.col("event_id") % 30, F.col("b.lon") + F.col("event_id") % 70
    at = geo.lerp_position(F.col("a.lat"), F.col("a.lon"), lb, lob, F.lit(0.25))
    return e.where(geo.haversine_m(F.col("a.lat"), F.col("a.lon"), lb, lob) > 0).select("event_id", (F.round(at["lat"], 8) + 0.0).alias("lat"), (F.round(at["lon"], 8) + 0.0).alias("lon"))


# --- photos ------------------------------------------------------------------------------

_NO_SPOT = "f AS (SELECT user_id, event_id AS photo_id, ts + INTERVAL 3 MINUTE AS ts FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0)"


@query("F15_inferred_positions", f"""WITH {PINGS}, {_NO_SPOT}, u AS (SELECT user_id, ts, max(lat) AS lat, max(lon) AS lon FROM pings WHERE event_id % 5 > 0 GROUP BY ALL),
b AS (SELECT f.photo_id, arg_max({{'ts': u.ts, 'lat': u.lat, 'lon': u.lon}}, u.ts) AS b FROM f JOIN u ON u.user_id = f.user_id AND u.ts <= f.ts GROUP BY 1), a AS (SELECT f.photo_id, arg_min({{'ts': u.ts, 'lat': u.lat, 'lon': u.lon}}, u.ts) AS a FROM f JOIN u ON u.user_id = f.user_id AND u.ts > f.ts GROUP BY 1),
c AS (SELECT f.*, b, a, (epoch_us(f.ts) - epoch_us(b.ts)) / 1e6 AS db, (epoch_us(a.ts) - epoch_us(f.ts)) / 1e6 AS da, {hav('b.lat', 'b.lon', 'a.lat', 'a.lon')} AS far FROM f LEFT JOIN b USING (photo_id) LEFT JOIN a USING (photo_id)),
g AS (SELECT *, db / (db + da) AS t, far / 6371008.8 AS d FROM c),
v AS (SELECT *, sin((1 - t) * d) / nullif(sin(d), 0) AS p, sin(t * d) / nullif(sin(d), 0) AS q FROM g),
x AS (SELECT *, p * cos(radians(b.lat)) * cos(radians(b.lon)) + q * cos(radians(a.lat)) * cos(radians(a.lon)) AS x, p * cos(radians(b.lat)) * sin(radians(b.lon)) + q * cos(radians(a.lat)) * sin(radians(a.lon)) AS y, p * sin(radians(b.lat)) + q * sin(radians(a.lat)) AS z FROM v)
SELECT photo_id, round(CASE WHEN db + da <= 3600 AND far >= 10000 THEN degrees(atan2(z, sqrt(x * x + y * y))) WHEN db + da <= 3600 THEN b.lat + (a.lat - b.lat) * t WHEN db <= 600 THEN b.lat WHEN da <= 600 THEN a.lat END, 6) AS lat,
  round(CASE WHEN db + da <= 3600 AND far >= 10000 THEN degrees(atan2(y, x)) WHEN db + da <= 3600 THEN b.lon + (a.lon - b.lon) * t WHEN db <= 600 THEN b.lon WHEN da <= 600 THEN a.lon END, 6) AS lon FROM x""")
def f15(spark, sf):
    f = table(spark, sf, "events").where("event_type = 'purchase' and event_id % 3 = 0").select("user_id", F.col("event_id").alias("photo_id"), (F.col("ts").cast("timestamp_ntz") + F.expr("interval 3 minutes")).alias("ts"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    u = pings(spark, sf).where("event_id % 5 > 0").groupBy("user_id", "ts").agg(F.max("lat").alias("lat"), F.max("lon").alias("lon"))
    return photos.infer_photo_positions(f, u).select("photo_id", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"))


@query("C4_photo_to_place", f"""WITH {PLAN_PLACES}, {PLAN_PHOTOS}, c AS (SELECT f.user_id, f.photo_id, p.place_id, {hav('f.lat', 'f.lon', 'p.lat', 'p.lon')} AS d FROM plan_photos f JOIN plan_places p ON p.user_id = f.user_id AND p.day BETWEEN f.day - 1 AND f.day + 1 AND f.ts BETWEEN p.start AND p."end")
SELECT user_id, photo_id, arg_min(place_id, (d, place_id)) AS place_id FROM c WHERE d <= 150 GROUP BY ALL""")
def c4(spark, sf):
    return photos.link_photos_to_places(plan_photos(spark, sf), plan_places(spark, sf))


@query("C5_photo_to_trip", f"""WITH {PLAN_PLACES}, {PLAN_PHOTOS}, t AS (SELECT user_id, trip_id, min(start) AS a, max("end") AS b FROM plan_places GROUP BY ALL) SELECT f.user_id, f.photo_id, arg_min(t.trip_id, (a, t.trip_id)) AS trip_id FROM plan_photos f JOIN t ON t.user_id = f.user_id AND f.ts BETWEEN a AND b GROUP BY ALL""")
def c5_trip(spark, sf):
    t = plan_places(spark, sf).groupBy("user_id", "trip_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return photos.link_photos_to_trips(plan_photos(spark, sf).drop("trip_id"), t)


@query("C3_both_ends", f"""WITH {PLAN_PLACES}, {PLAN_TRACKS} SELECT t.track_id, f.place_id AS from_place, g.place_id AS to_place FROM plan_tracks t JOIN plan_places f ON f.user_id = t.user_id AND f.day BETWEEN t.day - 1 AND t.day + 1 AND f."end" BETWEEN t.start - INTERVAL 5 MINUTE AND t.start + INTERVAL 5 MINUTE
JOIN plan_places g ON g.user_id = t.user_id AND g.day BETWEEN t.day - 1 AND t.day + 1 AND g.start BETWEEN t."end" - INTERVAL 5 MINUTE AND t."end" + INTERVAL 5 MINUTE""")
def c3_both(spark, sf):
    p, t = plan_places(spark, sf), plan_tracks(spark, sf).select("user_id", "track_id", "start", "end")
    left = intervals.near_in_time(t, p.select("user_id", F.col("place_id").alias("from_place"), F.col("end").alias("left_at")), "start", "left_at", 300)
    return intervals.near_in_time(left, p.select("user_id", F.col("place_id").alias("to_place"), F.col("start").alias("reached_at")), "end", "reached_at", 300).select("track_id", "from_place", "to_place")


@query("J3_photo_links", """WITH f AS (SELECT user_id % 7 AS u, event_id, event_id % 40 AS content, event_id % 3 AS source FROM events WHERE event_type = 'purchase'), k AS (SELECT u, content, min(event_id) AS photo_id FROM f GROUP BY ALL) SELECT DISTINCT photo_id, source AS source_id FROM f JOIN k USING (u, content)""")
def j3_links(spark, sf):
    f = event_photos(spark, sf).select((F.col("user_id") % 7).alias("user_id"), "photo_id", (F.col("photo_id") % 40).alias("content"), (F.col("photo_id") % 3).alias("source_id"))
    return photos.dedup_photos(f)[1]


# Cameras: some know the satellites' time, some an offset, some where they are, some were near a ping, some nothing.
_CAMERA = """cam AS (SELECT user_id, event_id AS photo_id, ts, event_id % 6 AS c, user_id % 3 AS z, event_id % 12 = 0 AS clock_is_local FROM events WHERE event_type = 'purchase')"""


@query("B7_photo_time", f"""WITH {_CAMERA}, k AS (SELECT *, {_CITY_ZONE.replace('user_id % 3', 'z')} AS zone FROM cam), l AS (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE zone AS local FROM k)
SELECT photo_id, CASE WHEN c <= 3 THEN ts WHEN c = 4 THEN local ELSE ts END AS ts_utc, CASE c WHEN 0 THEN zone WHEN 1 THEN 'UTC+09:00' WHEN 2 THEN zone WHEN 3 THEN zone WHEN 4 THEN 'UTC' END AS tz_name, CASE c WHEN 0 THEN 'gps_lookup' WHEN 1 THEN 'exif_offset' WHEN 2 THEN 'gps_lookup' WHEN 3 THEN 'nearest_track' WHEN 4 THEN 'user_default' ELSE 'file_mtime' END AS tz_source FROM l""")
def b7(spark, sf):
    from waymark.functions.time import to_local

    e = table(spark, sf, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("photo_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    c, z = F.col("photo_id") % 6, F.col("user_id") % 3
    zone = pick(z, ZONES)
    local = F.when(c == 1, F.col("ts") + F.expr("interval 9 hours")).otherwise(to_local(F.col("ts"), zone))
    # Every other satellite clock was set to local time; what the zone there and then says puts it right.
    gps = F.when(c == 0, F.when((F.col("photo_id") % 12 == 0) & (z != 2), local).otherwise(F.col("ts")))
    p = e.select("user_id", "photo_id", gps.alias("gps_utc"), F.when(c < 5, local).alias("local"), F.when(c == 1, 32400).alias("offset_s"), F.when(c.isin(0, 2), pick(z, LAT)).alias("lat"), F.when(c.isin(0, 2), pick(z, LON)).alias("lon"), F.when(c == 5, F.col("ts")).alias("mtime"))
    grid = spark.createDataFrame([(a, o, n) for a, o, n in zip(LAT, LON, ZONES)], "lat_q double, lon_q double, tz_name string")
    # A ping at the local time as it stands, of those whose camera has nothing else.
    near = p.join(e.select("photo_id", "ts"), "photo_id").where(F.col("photo_id") % 6 == 3).select("user_id", (F.col("local") + F.expr("interval 5 seconds")).alias("ts"), pick(F.col("user_id") % 3, ZONES).alias("tz_name"))
    lone = p.where("photo_id % 6 <> 4").unionByName(p.where("photo_id % 6 = 4").withColumn("user_id", -F.col("user_id")))
    return photos.resolve_photo_time(lone, grid, near).select("photo_id", "ts_utc", "tz_name", "tz_source")


@query("B8_clock_correction", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND abs(o) >= 120 THEN ts ELSE CASE WHEN event_id % 2 = 0 THEN ts + o * INTERVAL 1 SECOND ELSE ts END END AS ts_utc FROM (SELECT *, (event_id % 5 - 2) * 3600 AS o FROM events)")
def b8(spark, sf):
    i = F.col("event_id")
    o = (i % 5 - 2) * 3600
    ts = F.col("ts").cast("timestamp_ntz")
    local = ts + F.make_dt_interval(secs=o.cast("decimal(18,6)"))
    return table(spark, sf, "events").select("event_id", photos.correct_local_gps_clock(F.when(i % 2 == 0, local).otherwise(ts), local, o.cast("double")).alias("ts_utc"))


@query("B9_exif_numbers", "SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * (event_id % 90 + (event_id % 60) / 60.0::DOUBLE + (event_id % 3600) / 60 / 3600.0::DOUBLE), 6) AS degrees, CASE WHEN event_id % 4 = 1 THEN -(event_id % 500) ELSE event_id % 500 END::DOUBLE AS altitude_m, round((event_id % 300) * CASE event_id % 3 WHEN 0 THEN 1 / 3.6 WHEN 1 THEN 0.44704 ELSE 1852 / 3600.0::DOUBLE END, 6) AS mps FROM events")
def b9(spark, sf):
    i = F.col("event_id")
    dms = geo.dms_to_degrees(F.array((i % 90).cast("double"), (i % 60).cast("double"), (i % 3600) / 60.0), F.when(i % 2 == 0, "S").otherwise("N"))
    unit = pick(i % 3, ("K", "M", "N"))
    return table(spark, sf, "events").select("event_id", r6(dms).alias("degrees"), geo.signed_altitude((i % 500).cast("double"), F.when(i % 4 == 1, 1).otherwise(0)).alias("altitude_m"), r6(geo.speed_to_mps((i % 300).cast("double"), unit)).alias("mps"))


# --- incremental ------------------------------------------------------------------------------

@query("J1_new_files", "SELECT u AS user_id, h AS content_hash FROM (SELECT user_id % 9 AS u, event_id % 500 AS h, bool_or(event_id % 2 = 0) AS old FROM events GROUP BY ALL) WHERE NOT old")
def j1(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 9).alias("user_id"), (F.col("event_id") % 500).alias("content_hash"), "event_id")
    return incremental.new_files(e.where("event_id % 2 = 0"), e).select("user_id", "content_hash")


@query("J4_shadow_tracks", f"""WITH {PLAN}, {PLAN_TRACKS}, t AS (SELECT user_id, track_id, start - (track_id % 3) * INTERVAL 8 HOUR AS start, "end", CASE track_id % 3 WHEN 0 THEN 'gpx' WHEN 1 THEN 'fit' ELSE 'other' END AS k, track_id % 3 AS r FROM plan_tracks)
SELECT a.track_id, EXISTS (SELECT 1 FROM t b WHERE b.user_id = a.user_id AND (b.r, b.start, b.track_id) < (a.r, a.start, a.track_id) AND b.start < a."end" AND b."end" > a.start) AS is_shadow FROM t a""")
def j4(spark, sf):
    t = plan_tracks(spark, sf).withColumns({"start": F.col("start") - F.make_dt_interval(hours=((F.col("track_id") % 3) * 8).cast("int")), "source_kind": pick(F.col("track_id") % 3, ("gpx", "fit", "other"))})
    return incremental.mark_shadow(t, {"gpx": 0, "fit": 1}).select("track_id", "is_shadow")


def _derive(p):
    """What is derived here: a user's hours with pings."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return {"hours": p.groupBy("user_id", hour.alias("start")).agg(F.max("ts").alias("end"), F.count("*").alias("pings"))}


_HOURS = "SELECT user_id, date_trunc('hour', ts) AS start, max(ts) AS \"end\", count(*) AS pings FROM pings WHERE {} GROUP BY ALL"


@query("J5_window_recompute", f"WITH {PINGS} {_HOURS.format('event_id % 7 > 0 OR event_id % 7 = 0')}")
def j5(spark, sf):
    # Derived from six sevenths; the rest arrives, and only its windows are made anew.
    p = pings(spark, sf)
    old = _derive(p.where("event_id % 7 > 0"))
    return incremental.rederive(p, old, p.where("event_id % 7 = 0").select("user_id", "ts"), _derive)["hours"]


@query("J6_pruned_sources", f"""WITH {PLAN_PLACES}, s AS (SELECT user_id AS source_id, min(start) AS a, max("end") AS b FROM plan_places WHERE trip_id % 45 BETWEEN user_id % 40 AND user_id % 40 + 4 GROUP BY 1) SELECT source_id FROM s WHERE b >= TIMESTAMP '2024-01-20 00:00:00' AND a <= TIMESTAMP '2024-01-22 00:00:00'""")
def j6(spark, sf):
    s = plan_places(spark, sf).where("trip_id % 45 between user_id % 40 and user_id % 40 + 4").groupBy(F.col("user_id").alias("source_id")).agg(F.min("start").alias("span_start"), F.max("end").alias("span_end"))
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return incremental.prune_sources(s, at("2024-01-20 00:00:00"), at("2024-01-22 00:00:00")).select("source_id")


@query("J7_undone_source", f"WITH {PINGS} {_HOURS.format('event_id % 4 <> 1')}")
def j7(spark, sf):
    p = pings(spark, sf).withColumn("source_id", (F.col("event_id") % 4).cast("string"))
    f = event_photos(spark, sf)
    links = f.select("photo_id", (F.col("photo_id") % 4).cast("string").alias("source_id"))
    left, _, _, changed = incremental.undo_source(p, f, links, "1")
    return incremental.rederive(left, _derive(p), changed, _derive)["hours"]


@query("J9_reclustered", f"WITH {PINGS} {_HOURS.format('accuracy_m IS NULL OR accuracy_m <= 100')}")
def j9(spark, sf):
    p = pings(spark, sf)
    strict = p.where("accuracy_m is null or accuracy_m <= 100")
    return incremental.recluster(strict, event_photos(spark, sf), _derive(p), _derive)["hours"].where("pings > 0")


@query("A14_A17_replaced_window", f"""WITH {PLAN_PLACES} SELECT place_id FROM plan_places WHERE "end" >= TIMESTAMP '2024-01-10 00:00:00' AND start <= TIMESTAMP '2024-01-12 00:00:00' AND user_id IN (1, 5, 9, 40)""")
def a17(spark, sf):
    """Places written by day, those of one day replaced, and some read again."""
    path, p = new_path(spark, "derived"), plan_places(spark, sf)
    incremental.write_window(p.withColumn("place_id", F.when(F.day("day") == 11, -F.col("place_id")).otherwise(F.col("place_id"))), path, ["day"])
    incremental.write_window(p.where("day(day) = 11"), path, ["day"])
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return incremental.read_derived(spark, path, at("2024-01-10 00:00:00"), at("2024-01-12 00:00:00"), [1, 5, 9, 40]).select("place_id")
