"""More queries over the fixtures: records, joins with several sides, trips, search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.functions import geo, text
from waymark.functions import time as times
from waymark.operators import intervals, organise, points
from waymark.plans.fixtures import PHOTOS, PINGS, VISITS, hav, photos, pings, table, visits
from waymark.plans.queries import _PLACES, QUERIES, _places, query, r3, r6
from waymark.sources import timeline


def _records(spark, sf):
    """Visits as an export has them: JSON texts, some of them of kinds to skip."""
    v = visits(spark, sf)
    stamp = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    kind = F.when(F.col("hint_id") % 6 == 0, "Searched Address").otherwise(F.col("semantic_type"))
    at = F.when(F.col("hint_id") % 10 == 1, F.lit("nowhere")).otherwise(F.format_string("%.6f°, %.6f°", "lat", "lon"))
    one = F.struct(stamp("start").alias("startTime"), stamp("end").alias("endTime"), F.struct((F.col("hint_id") % 9 == 4).cast("int").alias("hierarchyLevel"), F.struct(kind.alias("semanticType"), F.struct(at.alias("latLng")).alias("placeLocation")).alias("topCandidate")).alias("visit"))
    return v.select(F.from_json(F.to_json(one), timeline.RECORD).alias("r")).select("r.*")


@query("A3_visit_hints", f"""WITH {VISITS} SELECT start, "end", round(lat, 6) + 0 AS lat, round(lon, 6) + 0 AS lon, semantic_type FROM visits WHERE hint_id % 9 <> 4 AND hint_id % 6 <> 0 AND hint_id % 10 <> 1""")
def a3(spark, sf):
    hints, _ = timeline.visits_to_hints(_records(spark, sf))
    return hints.select("start", "end", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), "semantic_type")


@query("A2_skip_notes", f"""WITH {VISITS} SELECT CASE WHEN hint_id % 9 = 4 THEN 'hierarchy parent' WHEN hint_id % 6 = 0 THEN 'searched address' ELSE 'no position' END AS reason, count(*) AS count FROM visits WHERE hint_id % 9 = 4 OR hint_id % 6 = 0 OR hint_id % 10 = 1 GROUP BY 1""")
def a2(spark, sf):
    return timeline.visits_to_hints(timeline.with_kind(_records(spark, sf), strict=True))[1]


@query("A15_geojson", f"""WITH {VISITS} SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || hint_id % 180 || ',' || hint_id % 90 || ']}},"properties":{{"hint_id":' || hint_id || ',"semantic_type":' || coalesce('"' || semantic_type || '"', 'null') || '}}}}' AS feature FROM visits""")
def a15(spark, sf):
    v = visits(spark, sf).withColumns({"lon": F.col("hint_id") % 180, "lat": F.col("hint_id") % 90})
    return timeline.to_geojson_rows(v, ["hint_id", "semantic_type"])


@query("A16_gpx", f"""WITH {PINGS} SELECT event_id::VARCHAR AS name, '<trk><name>' || event_id || '</name><trkseg>' || string_agg('<trkpt lat="' || printf('%.6f', k::DOUBLE) || '" lon="' || printf('%.6f', (k * 2)::DOUBLE) || '"/>', '' ORDER BY k) || '</trkseg></trk>' AS gpx FROM pings GROUP BY event_id""")
def a16(spark, sf):
    p = pings(spark, sf).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(F.col("k").cast("double").alias("lat"), (F.col("k") * 2).cast("double").alias("lon")))).alias("points"))
    return timeline.to_gpx_rows(p.select(F.col("event_id").cast("string").alias("name"), "points"))


@query("B16_lerp", f"""WITH {PINGS}, e AS (SELECT event_id, min_by(lat, k) AS la, min_by(lon, k) AS lo, max_by(lat, k) AS lb, max_by(lon, k) AS lob FROM pings GROUP BY event_id)
SELECT event_id, round(la + (lb - la) * 0.25, 8) + 0 AS lat, round(lo + (lob - lo) * 0.25, 8) + 0 AS lon FROM e WHERE {hav('la', 'lo', 'lb', 'lob')} < 9000""")
def b16(spark, sf):
    e = pings(spark, sf).groupBy("event_id").agg(F.min_by(F.struct("lat", "lon"), "k").alias("a"), F.max_by(F.struct("lat", "lon"), "k").alias("b"))
    near = geo.haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) < 9000
    at = geo.lerp_position(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"), F.lit(0.25))
    return e.where(near).withColumn("at", at).select("event_id", (F.round("at.lat", 8) + 0.0).alias("lat"), (F.round("at.lon", 8) + 0.0).alias("lon"))


@query("B29_title", f"""WITH {_PLACES} SELECT trip_id, CASE WHEN city IS NOT NULL THEN city || ' · ' || strftime(day, '%m-%d') WHEN trip_id % 2 = 0 THEN 'Commute · ' || strftime(day, '%m-%d') ELSE strftime(day, '%Y-%m-%d') END AS title, true AS generated FROM places""")
def b29(spark, sf):
    title = text.make_title(F.col("day"), F.array(), F.col("city"), F.col("trip_id") % 2 == 0)
    return _places(spark, sf).select("trip_id", title.alias("title")).withColumn("generated", text.looks_generated(F.col("title")))


@query("C5_photo_to_interval", f"""WITH {VISITS}, {PHOTOS} SELECT f.photo_id, arg_min(v.hint_id, (v.start, v.hint_id)) AS hint_id FROM photos f JOIN visits v ON v.user_id = f.user_id AND f.ts BETWEEN v.start AND v."end" GROUP BY f.photo_id""")
def c5(spark, sf):
    got = intervals.points_in_intervals(visits(spark, sf).select("user_id", "hint_id", "start", "end"), photos(spark, sf))
    return got.groupBy("photo_id").agg(F.min_by("hint_id", F.struct("start", "hint_id")).alias("hint_id"))


@query("C7_nearest_in_time", f"""WITH {PHOTOS}, c AS (SELECT f.photo_id, e.event_id, abs(epoch_us(e.ts) - epoch_us(f.ts)) AS d, e.ts > f.ts AS later FROM photos f JOIN events e ON e.user_id = f.user_id AND e.event_type <> 'purchase'),
n AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY d, later, event_id) AS rn FROM c)
SELECT photo_id, event_id, round(d / 1e6, 3) AS apart_s FROM n WHERE rn = 1 AND d <= 1800 * 1000000""")
def c7(spark, sf):
    e = table(spark, sf, "events").where("event_type <> 'purchase'").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")
    got = intervals.nearest_in_time(photos(spark, sf), e, ["event_id"], 1800)
    return got.select("photo_id", F.col("nearest.event_id").alias("event_id"), r3(F.col("apart_s")).alias("apart_s"))


@query("C11_attach_counts", f"""WITH {PINGS}, {VISITS}, {PHOTOS} SELECT c_custkey, (SELECT count(*) FROM pings WHERE user_id = c_custkey) AS pings, (SELECT count(*) FROM visits WHERE user_id = c_custkey) AS visits, (SELECT count(*) FROM photos WHERE user_id = c_custkey) AS photos FROM customer""")
def c11(spark, sf):
    out = table(spark, sf, "customer").select("c_custkey")
    for name, side in (("pings", pings), ("visits", visits), ("photos", photos)):  # each side is counted before it is joined
        n = side(spark, sf).groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias(name))
        out = out.join(n, "c_custkey", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def d7(spark, sf):
    """Gaps of more than a minute between a user's declared visits."""
    nxt = F.lead("start").over(Window.partitionBy("user_id").orderBy("start", "hint_id"))
    v = visits(spark, sf).withColumn("next", nxt).select("user_id", "hint_id", F.col("end").alias("start"), F.col("next").alias("end"))
    gap = points.seconds_between(F.col("start"), F.col("end"))
    return v.where(gap > 60).withColumn("duration_s", F.floor(gap).cast("long"))


@query("D7_implied_moves_unmeasured")
def d7_unmeasured(spark, sf):
    moves = QUERIES["D3_moves"](spark, sf).select("user_id", "start", "end")
    return intervals.without_overlap(d7(spark, sf), moves, "hint_id")


@query("D10_trip_spans", f"""WITH {VISITS}, l AS (SELECT *, ((start AT TIME ZONE 'UTC') AT TIME ZONE tz_name)::DATE AS local_date FROM visits)
SELECT user_id, local_date, arg_min(tz_name, start) AS anchor_tz, min(start) AS start, max("end") AS "end", count(*) AS places FROM l GROUP BY ALL""")
def d10(spark, sf):
    v = visits(spark, sf).withColumn("local_date", times.local_date(F.col("start"), F.col("tz_name")))
    return v.groupBy("user_id", "local_date").agg(F.min_by("tz_name", "start").alias("anchor_tz"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("places"))


@query("E6_anchor_aggregation", f"""WITH {VISITS}, l AS (SELECT *, isodow((start AT TIME ZONE 'UTC') AT TIME ZONE tz_name) < 6 AS weekday FROM visits)
SELECT user_id, semantic_type, count(*) AS visits, min(start) AS first_visit, max("end") AS last_visit, count(*) * 1200 AS dwell_s, round(count(*) FILTER (WHERE weekday) / count(*), 6) AS weekday_ratio FROM l GROUP BY ALL""")
def e6(spark, sf):
    dwell = points.seconds_between(F.col("start"), F.col("end"))
    weekday = times.local_weekday(F.col("start"), F.col("tz_name")) < 5
    return visits(spark, sf).groupBy("user_id", "semantic_type").agg(F.count("*").alias("visits"), F.min("start").alias("first_visit"), F.max("end").alias("last_visit"), F.sum(dwell).cast("long").alias("dwell_s"), r6(F.sum(F.when(weekday, dwell).otherwise(0.0)) / F.sum(dwell)).alias("weekday_ratio"))


@query("E11_daily_activity", f"WITH {_PLACES} SELECT day, count(*) AS trips, round(sum(metres), 2) AS metres, count(DISTINCT city) AS cities FROM places GROUP BY day")
def e11(spark, sf):
    return _places(spark, sf).groupBy("day").agg(F.count("*").alias("trips"), F.round(F.sum("metres"), 2).alias("metres"), F.count_distinct("city").alias("cities"))


def monthly_density(days):
    """month, weight of days (day, places, metres) of all users together."""
    one = days.select(F.lit(0).cast("long").alias("user_id"), "day", "places", F.col("metres").alias("distance_m"))
    return organise.monthly_density(one).drop("user_id")


@query("E12_monthly_weight", """WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS places, sum(o_totalprice) AS metres FROM orders GROUP BY 1),
m AS (SELECT date_trunc('month', day)::DATE AS month, sum(places + CASE WHEN metres > 0 THEN 1 ELSE 0 END)::BIGINT AS weight FROM d GROUP BY 1),
s AS (SELECT unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM m)
SELECT month, coalesce(weight, 0) AS weight FROM s LEFT JOIN m USING (month)""")
def e12_weight(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
    return monthly_density(o.agg(F.count("*").alias("places"), F.sum("o_totalprice").alias("metres")))


@query("E18_workdays", f"""WITH {VISITS}, l AS (SELECT user_id, (start AT TIME ZONE 'UTC') AT TIME ZONE tz_name AS t FROM visits) SELECT user_id, count(DISTINCT t::DATE) FILTER (WHERE isodow(t) < 6) AS workdays FROM l GROUP BY user_id""")
def e18(spark, sf):
    ts, tz = F.col("start"), F.col("tz_name")
    return visits(spark, sf).groupBy("user_id").agg(F.count_distinct(F.when(times.local_weekday(ts, tz) < 5, times.local_date(ts, tz))).alias("workdays"))


@query("E22_main_city", f"""WITH {_PLACES}, s AS (SELECT day, city, round(sum(metres), 2) AS dwell FROM places WHERE city IS NOT NULL GROUP BY ALL), k AS (SELECT day, list_sort(list(DISTINCT country) FILTER (WHERE country IS NOT NULL)) AS countries FROM places GROUP BY day)
SELECT day, arg_max(city, (dwell, city)) AS city, any_value(countries) AS countries FROM s JOIN k USING (day) GROUP BY day""")
def e22(spark, sf):
    p = _places(spark, sf)
    s = p.where("city is not null").groupBy("day", "city").agg(F.round(F.sum("metres"), 2).alias("dwell"))
    main = s.groupBy("day").agg(F.max_by("city", F.struct("dwell", "city")).alias("city"))
    return main.join(p.groupBy("day").agg(F.array_sort(F.collect_set("country")).alias("countries")), "day")


@query("F6_semantic_kind", f"""WITH {VISITS} SELECT user_id, CASE WHEN bool_or(semantic_type = 'Home') THEN 'home' WHEN bool_or(semantic_type = 'Work') THEN 'work' WHEN bool_or(semantic_type = 'Inferred Home') THEN 'home' WHEN bool_or(semantic_type = 'Inferred Work') THEN 'work' WHEN count(*) >= 3 THEN 'frequent' ELSE 'other' END AS kind,
  CASE WHEN bool_or(semantic_type IN ('Home', 'Work')) THEN 'confirmed' WHEN bool_or(semantic_type IN ('Inferred Home', 'Inferred Work')) THEN 'inferred' END AS kind_source FROM visits GROUP BY user_id, hint_id % 6""")
def f6(spark, sf):
    has = lambda *k: F.coalesce(F.bool_or(F.col("semantic_type").isin(*k)), F.lit(False))
    kind = F.when(has("Home"), "home").when(has("Work"), "work").when(has("Inferred Home"), "home").when(has("Inferred Work"), "work").when(F.count("*") >= 3, "frequent").otherwise("other")
    source = F.when(has("Home", "Work"), "confirmed").when(has("Inferred Home", "Inferred Work"), "inferred")
    return visits(spark, sf).groupBy("user_id", (F.col("hint_id") % 6).alias("g")).agg(kind.alias("kind"), source.alias("kind_source")).drop("g")


@query("I5_search", """(SELECT 'nation' AS kind, n_name AS name FROM nation WHERE contains(lower(n_name), 'an') ORDER BY n_name LIMIT 10) UNION ALL (SELECT 'region', r_name FROM region WHERE contains(lower(r_name), 'a') ORDER BY r_name LIMIT 10)""")
def i5(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    a = n.where(text.text_search(F.col("n_name"), "an")).orderBy("n_name").limit(10).select(F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
    return a.unionByName(r.where(text.text_search(F.col("r_name"), "a")).orderBy("r_name").limit(10).select(F.lit("region").alias("kind"), F.col("r_name").alias("name")))
