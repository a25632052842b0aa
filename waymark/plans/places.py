"""Queries on anchors and commutes, over the day plans; their SQL names an anchor by what it was made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import anchors, commute
from waymark.operators.graph import written
from waymark.plans.fixtures import FENCES, PLAN, PLAN_PHOTOS, PLAN_PLACES, PLAN_TRACKS, PLAN_TRIPS, VISITS, fences, hav, plan_photos, plan_places, plan_tracks, plan_trips, visits
from waymark.plans.queries import query, r6


#: Tables that several queries of a session begin with.
_made: dict[tuple[str, str, str], DataFrame] = {}


def once(spark, sf, name, make):
    """The table of this name, written when it is first asked for."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _made:
        _made[key] = written(spark, make(), name)
    return _made[key]


def _found(spark, sf):
    """Places with the anchors that DBSCAN finds for them."""
    return anchors.with_anchors(spark, plan_places(spark, sf).withColumnRenamed("place_id", "id"), 150.0, 3).withColumnRenamed("id", "place_id").drop("is_core")


def _anchored(spark, sf):
    """These, written for what goes over them again and again."""
    return once(spark, sf, "anchored", lambda: _found(spark, sf))


def _anchors(spark, sf):
    return anchors.aggregate_anchors(_found(spark, sf))


#: A slot's places are within 150 m of each other and of no other; three or more are one anchor, named by the first.
_ANCHORED = """anchored AS (SELECT p.*, CASE WHEN count(*) OVER w >= 3 THEN first_value(place_id) OVER (PARTITION BY user_id, slot ORDER BY start, place_id) ELSE place_id END AS anchor_id FROM plan_places p WINDOW w AS (PARTITION BY user_id, slot))"""
_LOCAL = "(start AT TIME ZONE 'UTC') AT TIME ZONE tz_name"
_ANCHORS = f"""l AS (SELECT *, {_LOCAL} AS lt, (epoch_us("end") - epoch_us(start)) // 1000000 AS s FROM anchored),
h AS (SELECT user_id, anchor_id, (extract(hour FROM lt) + o) % 24 AS hour, count(*) AS n FROM (SELECT *, unnest(range(0, greatest(1, s // 3600))) AS o FROM l) GROUP BY ALL),
hist AS (SELECT user_id, anchor_id, list(coalesce(n, 0) ORDER BY hh) AS hours FROM (SELECT k.user_id, k.anchor_id, hh, n FROM (SELECT DISTINCT user_id, anchor_id, hh FROM l, range(0, 24) t(hh)) k LEFT JOIN h ON h.user_id = k.user_id AND h.anchor_id = k.anchor_id AND h.hour = hh) GROUP BY ALL),
a0 AS (SELECT user_id, anchor_id, count(*) AS visit_count, min(start) AS first_visit, max("end") AS last_visit, sum(s)::BIGINT AS total_duration_s, coalesce(sum(s) FILTER (WHERE isodow(lt) < 6), 0) / sum(s) AS weekday_ratio,
  degrees(atan2(avg(sin(radians(lat))), sqrt(power(avg(cos(radians(lat)) * cos(radians(lon))), 2) + power(avg(cos(radians(lat)) * sin(radians(lon))), 2)))) AS lat, degrees(atan2(avg(cos(radians(lat)) * sin(radians(lon))), avg(cos(radians(lat)) * cos(radians(lon))))) AS lon,
  CASE WHEN bool_or(semantic_type = 'Home') THEN 'home' WHEN bool_or(semantic_type = 'Work') THEN 'work' WHEN bool_or(semantic_type = 'Inferred Home') THEN 'home' WHEN count(*) >= 3 THEN 'frequent' ELSE 'other' END AS kind,
  CASE WHEN bool_or(semantic_type IN ('Home', 'Work')) THEN 'confirmed' WHEN bool_or(semantic_type = 'Inferred Home') THEN 'inferred' END AS kind_source FROM l GROUP BY ALL),
anchors AS (SELECT a0.*, hours, coalesce(weekday_ratio, 0) AS wr FROM a0 JOIN hist USING (user_id, anchor_id))"""


@query("F5_dbscan", f"""WITH RECURSIVE {VISITS}, v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, hint_id) AS idx FROM visits),
e AS (SELECT a.user_id, a.idx AS a, b.idx AS b FROM v a JOIN v b ON a.user_id = b.user_id WHERE {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 2900),
core AS (SELECT user_id, a AS idx FROM e GROUP BY user_id, a HAVING count(*) >= 3),
reach AS (SELECT user_id, idx, idx AS top FROM core UNION SELECT e.user_id, e.b, reach.top FROM reach JOIN e ON e.user_id = reach.user_id AND e.a = reach.idx JOIN core ON core.user_id = e.user_id AND core.idx = e.b),
made AS (SELECT user_id, idx, min(top) AS made FROM reach GROUP BY ALL),
border AS (SELECT e.user_id, e.a AS idx, min(made.made) AS made FROM e JOIN made ON made.user_id = e.user_id AND made.idx = e.b GROUP BY ALL),
n AS (SELECT v.user_id, v.idx, v.hint_id, made.made IS NOT NULL AS is_core, CASE WHEN made.made IS NOT NULL THEN made.made WHEN border.made < v.idx THEN border.made ELSE v.idx END AS c FROM v LEFT JOIN made USING (user_id, idx) LEFT JOIN border USING (user_id, idx))
SELECT n.user_id, n.hint_id, w.hint_id AS anchor_id, n.is_core FROM n JOIN v w ON w.user_id = n.user_id AND w.idx = n.c""")
def f5(spark, sf):
    got = anchors.dbscan(spark, visits(spark, sf).withColumnRenamed("hint_id", "id"), 2900.0, 3)
    return got.select("user_id", F.col("id").alias("hint_id"), "anchor_id", "is_core")


@query("E6_anchors", f"""WITH {PLAN_PLACES}, {_ANCHORED}, {_ANCHORS} SELECT user_id, anchor_id, visit_count, first_visit, last_visit, total_duration_s, round(weekday_ratio, 6) AS weekday_ratio, round(lat, 6) AS lat, round(lon, 6) AS lon, kind, kind_source, hours AS hour_histogram FROM anchors""")
def e6_anchors(spark, sf):
    return _anchors(spark, sf).select("user_id", "anchor_id", "visit_count", "first_visit", "last_visit", "total_duration_s", r6(F.coalesce("weekday_ratio")).alias("weekday_ratio"), r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), "kind", "kind_source", "hour_histogram")


_GUESSED = """g AS (SELECT *, list_sum([hours[i + 1] FOR i IN [22, 23, 0, 1, 2, 3, 4, 5]]) AS night, list_sum([hours[i + 1] FOR i IN range(9, 18)]) AS day, max(kind = 'home') OVER (PARTITION BY user_id) AS has_home, max(kind = 'work') OVER (PARTITION BY user_id) AS has_work FROM anchors),
g1 AS (SELECT *, kind_source IS NULL AND NOT has_home AND night > 0 AND row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN kind_source IS NULL THEN night END DESC NULLS LAST, first_visit, anchor_id) = 1 AS is_home FROM g),
g2 AS (SELECT *, kind_source IS NULL AND NOT is_home AND wr >= 0.8 AS may FROM g1),
g3 AS (SELECT *, may AND NOT has_work AND day > 0 AND row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN may THEN day END DESC NULLS LAST, first_visit, anchor_id) = 1 AS is_work FROM g2),
guessed AS (SELECT * EXCLUDE (kind, kind_source), CASE WHEN is_home THEN 'home' WHEN is_work THEN 'work' ELSE kind END AS kind, CASE WHEN is_home OR is_work THEN 'heuristic' ELSE kind_source END AS kind_source FROM g3)"""


@query("F7_home_work", f"WITH {PLAN_PLACES}, {_ANCHORED}, {_ANCHORS}, {_GUESSED} SELECT user_id, anchor_id, kind, kind_source FROM guessed")
def f7(spark, sf):
    return anchors.infer_home_work(_anchors(spark, sf)).select("user_id", "anchor_id", "kind", "kind_source")


@query("F8_fence_suggestions", f"""WITH {PLAN_PLACES}, {_ANCHORED}, {_ANCHORS}, {_GUESSED}, {FENCES}
SELECT g.user_id, g.kind, g.kind_source AS confidence, round(g.lat, 6) AS lat, round(g.lon, 6) AS lon, g.visit_count, bool_or(coalesce({hav('g.lat', 'g.lon', 'f.lat', 'f.lon')} < 200, false)) AS already_fenced
FROM guessed g LEFT JOIN fences f ON f.user_id = g.user_id WHERE g.kind IN ('home', 'work') GROUP BY ALL""")
def f8(spark, sf):
    # In the fixture no two of one kind are near each other; that they merge is tested on a small one.
    got = anchors.suggest_fences(anchors.infer_home_work(_anchors(spark, sf)), fences(spark, sf))
    return got.select("user_id", "kind", "confidence", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), "visit_count", "already_fenced")


@query("F19_adopted_fences", f"""WITH {PLAN_PLACES}, {_ANCHORED}, {_ANCHORS}, {_GUESSED}, {FENCES}, near AS (SELECT DISTINCT g.user_id, g.anchor_id FROM guessed g JOIN fences f ON f.user_id = g.user_id AND {hav('g.lat', 'g.lon', 'f.lat', 'f.lon')} < 200)
SELECT user_id, kind, 500.0::DOUBLE AS radius_m, true AS enabled FROM guessed WHERE kind IN ('home', 'work') AND kind_source IN ('confirmed', 'inferred') AND (user_id, anchor_id) NOT IN (SELECT (user_id, anchor_id) FROM near)""")
def f19(spark, sf):
    made = anchors.suggest_fences(anchors.infer_home_work(_anchors(spark, sf)), fences(spark, sf))
    return anchors.adopt_fences(made, "a secret of this installation").select("user_id", "kind", "radius_m", "enabled")


@query("E15_anchor_ranking", f"""WITH {PLAN_PLACES}, {_ANCHORED} SELECT user_id, anchor_id, count(*) AS visit_count, count(DISTINCT trip_id) AS trips FROM anchored GROUP BY ALL ORDER BY visit_count DESC, user_id, anchor_id LIMIT 100""")
def e15(spark, sf):
    p = _found(spark, sf)
    return anchors.anchor_ranking(anchors.aggregate_anchors(p), p).select("user_id", "anchor_id", "visit_count", "trips")


@query("I6_to_geocode", f"""WITH {PLAN_PLACES}, {_ANCHORED} SELECT user_id, anchor_id, count(*) AS visit_count FROM anchored GROUP BY ALL HAVING anchor_id % 4 <> 0 ORDER BY visit_count DESC, user_id, anchor_id LIMIT 200""")
def i6(spark, sf):
    a = _anchors(spark, sf).withColumn("geo_name", F.when(F.col("anchor_id") % 4 == 0, "known"))
    return anchors.to_geocode(a).select("user_id", "anchor_id", "visit_count")


@query("C13_geocode_lookup", f"""WITH {PLAN_PLACES}, g AS (SELECT DISTINCT user_id, n_name, r_name FROM plan_places JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT user_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE n_name END AS geo_city, CASE WHEN user_id % 3 = 0 THEN NULL ELSE r_name END AS geo_country FROM g""")
def c13(spark, sf):
    from waymark.functions.geo import geohash
    from waymark.plans.fixtures import _home, table

    lat, lon = _home(F.col("user_id"))
    users = plan_places(spark, sf).select("user_id").distinct().withColumns({"lat": lat + F.col("user_id") * 1e-4, "lon": lon})
    n = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = users.join(n, F.col("user_id") == F.col("c_custkey")).where("user_id % 3 <> 0")
    gazetteer = names.select(geohash(F.col("lat"), F.col("lon"), 7).alias("geohash7"), F.lit(None).cast("string").alias("geo_name"), F.col("n_name").alias("geo_city"), F.col("r_name").alias("geo_country")).dropDuplicates(["geohash7"])
    return anchors.geocode_lookup(users.withColumn("anchor_id", F.col("user_id")), gazetteer).select("user_id", "geo_city", "geo_country")


@query("C12_inherit_names", f"""WITH {PLAN_PLACES}, {_ANCHORED} SELECT place_id, coalesce(geo_city, CASE WHEN anchor_id % 2 = 0 THEN 'Anchor' || anchor_id END) AS geo_city FROM anchored""")
def c12(spark, sf):
    p = _found(spark, sf).withColumn("geo_name", F.lit(None).cast("string"))
    a = p.select("user_id", "anchor_id").distinct().withColumns({"geo_name": F.lit(None).cast("string"), "geo_country": F.lit(None).cast("string"), "geo_city": F.when(F.col("anchor_id") % 2 == 0, F.concat(F.lit("Anchor"), F.col("anchor_id").cast("string")))})
    return anchors.inherit_names(p, a).select("place_id", "geo_city")


# --- commutes ------------------------------------------------------------------------------

_CELL = """(SELECT list_sort(list(DISTINCT greatest(0, ceil((p.lon + 180) / 360 * 32768)::BIGINT - 1) * 100000 + greatest(0, ceil((p.lat + 90) / 180 * 32768)::BIGINT - 1))) FROM (SELECT unnest(t.points) AS p))"""
_LEGS = f"""legs AS (SELECT t.user_id, t.track_id, t.start, f.tz_name, f.anchor_id AS from_anchor, g.anchor_id AS to_anchor, t.distance_m, {_CELL} AS cells
  FROM plan_tracks t JOIN anchored f ON f.user_id = t.user_id AND f.day >= t.day - 1 AND f.day <= t.day + 1 AND f."end" BETWEEN t.start - INTERVAL 5 MINUTE AND t.start + INTERVAL 5 MINUTE
  JOIN anchored g ON g.user_id = t.user_id AND g.day >= t.day - 1 AND g.day <= t.day + 1 AND g.start BETWEEN t."end" - INTERVAL 5 MINUTE AND t."end" + INTERVAL 5 MINUTE)"""
_OD = "user_id, from_anchor, to_anchor"
_SIMILAR = f"""pairs AS (SELECT a.user_id, a.from_anchor, a.to_anchor, len(list_intersect(a.cells, b.cells)) / len(list_distinct(list_concat(a.cells, b.cells))) AS s FROM legs a JOIN legs b ON a.user_id = b.user_id AND a.from_anchor = b.from_anchor AND a.to_anchor = b.to_anchor AND a.track_id < b.track_id),
alike AS (SELECT l.*, CASE WHEN n < 2 THEN 1.0 ELSE v[len(v) // 2 + 1] END AS jaccard FROM (SELECT {_OD}, count(*) AS n FROM legs GROUP BY ALL) l LEFT JOIN (SELECT {_OD}, list_sort(list(s)) AS v FROM pairs GROUP BY ALL) USING ({_OD}))"""


def _legs(spark, sf):
    return commute.build_legs(plan_tracks(spark, sf), _anchored(spark, sf))


@query("F9_legs", f"WITH {PLAN_PLACES}, {PLAN_TRACKS}, {_ANCHORED}, {_LEGS} SELECT user_id, track_id, from_anchor, to_anchor, len(cells) AS cells FROM legs")
def f9(spark, sf):
    from waymark.functions.geo import geohash

    cells = F.size(F.array_distinct(F.transform("points", lambda p: geohash(p["lat"], p["lon"], 6))))
    return _legs(spark, sf).select("user_id", "track_id", "from_anchor", "to_anchor", cells.cast("long").alias("cells"))


@query("F10_path_similarity", f"WITH {PLAN_PLACES}, {PLAN_TRACKS}, {_ANCHORED}, {_LEGS}, {_SIMILAR} SELECT {_OD}, round(jaccard, 6) AS path_jaccard FROM alike")
def f10(spark, sf):
    return commute.path_similarity(_legs(spark, sf)).select("user_id", "from_anchor", "to_anchor", r6(F.col("path_jaccard")).alias("path_jaccard"))


_COMMUTES = f"""hw AS (SELECT user_id, anchor_id FROM guessed WHERE kind IN ('home', 'work')),
t AS (SELECT *, {_LOCAL} AS lt FROM legs WHERE from_anchor <> to_anchor AND user_id IN (SELECT user_id FROM plan WHERE isodow(day) < 6 GROUP BY user_id HAVING count(DISTINCT day) >= 30)),
s AS (SELECT {_OD}, count(*) AS occurrence, count(DISTINCT lt::DATE) FILTER (WHERE isodow(lt) < 6) AS workdays, avg((isodow(lt) < 6)::INT) AS weekday_ratio, avg(sin((extract(hour FROM lt) + extract(minute FROM lt) / 60.0::DOUBLE) * (2 * pi() / 24))) AS si, avg(cos((extract(hour FROM lt) + extract(minute FROM lt) / 60.0::DOUBLE) * (2 * pi() / 24))) AS co, min(lt)::DATE AS first_seen, sum(distance_m) AS total_m FROM t GROUP BY ALL),
commutes AS (SELECT s.*, jaccard, sqrt(greatest(0, -2 * ln(least(1, sqrt(si * si + co * co))))) * 24 / (2 * pi()) AS sd, (user_id, from_anchor) IN (SELECT (user_id, anchor_id) FROM hw) OR (user_id, to_anchor) IN (SELECT (user_id, anchor_id) FROM hw) AS home_or_work FROM s JOIN alike USING ({_OD})
  WHERE occurrence >= 10 AND workdays >= 8 AND weekday_ratio >= 0.8 AND sd <= 1.5 AND jaccard >= CASE WHEN home_or_work THEN 0.51 ELSE 0.6 END)"""
_ALL = f"{PLAN_PLACES}, {PLAN_TRACKS}, {_ANCHORED}, {_ANCHORS}, {_GUESSED}, {_LEGS}, {_SIMILAR}, {_COMMUTES}"


def _commutes(spark, sf):
    p = _anchored(spark, sf)
    a = anchors.infer_home_work(anchors.aggregate_anchors(p))
    legs = once(spark, sf, "legs", lambda: _legs(spark, sf))
    return p, a, legs, once(spark, sf, "commutes", lambda: commute.detect_commutes(legs, a, plan_trips(spark, sf)))


@query("F11_commutes", f"WITH {_ALL} SELECT {_OD}, occurrence, workdays AS distinct_workdays, round(weekday_ratio, 6) AS weekday_ratio, round(sd, 4) AS depart_hour_circstd, round(jaccard, 6) AS path_jaccard, first_seen, home_or_work FROM commutes")
def f11(spark, sf):
    got = _commutes(spark, sf)[3]
    return got.select("user_id", "from_anchor", "to_anchor", "occurrence", "distinct_workdays", r6(F.col("weekday_ratio")).alias("weekday_ratio"), F.round("depart_hour_circstd", 4).alias("depart_hour_circstd"), r6(F.col("path_jaccard")).alias("path_jaccard"), "first_seen", "home_or_work")


@query("F12_commute_tracks", f"WITH {_ALL} SELECT t.track_id, (t.track_id IN (SELECT l.track_id FROM legs l JOIN commutes c ON c.user_id = l.user_id AND c.from_anchor = l.from_anchor AND c.to_anchor = l.to_anchor)) AS is_commute FROM plan_tracks t")
def f12(spark, sf):
    _, _, legs, ods = _commutes(spark, sf)
    return commute.mark_commute(plan_tracks(spark, sf), legs, ods).select("track_id", "is_commute")


_CLASSES = f"""marked AS (SELECT DISTINCT t.trip_id FROM plan_tracks t JOIN legs l USING (track_id) JOIN commutes c ON c.user_id = l.user_id AND c.from_anchor = l.from_anchor AND c.to_anchor = l.to_anchor),
dw AS (SELECT p.trip_id, sum(epoch_us(p."end") - epoch_us(p.start)) AS total, coalesce(sum(epoch_us(p."end") - epoch_us(p.start)) FILTER (WHERE (p.user_id, p.anchor_id) NOT IN (SELECT (user_id, anchor_id) FROM hw)), 0) AS other FROM anchored p GROUP BY ALL),
classes AS (SELECT trip_id, CASE WHEN trip_id NOT IN (SELECT trip_id FROM marked) THEN 'none' WHEN coalesce(other / total, 0) < 0.15 AND trip_id NOT IN (SELECT trip_id FROM plan_photos) THEN 'pure' ELSE 'mixed' END AS commute_class FROM plan LEFT JOIN dw USING (trip_id))"""


def _classed(spark, sf):
    p, a, legs, ods = _commutes(spark, sf)
    tracks = commute.mark_commute(plan_tracks(spark, sf), legs, ods)
    return p, tracks, commute.classify_trips(plan_trips(spark, sf), p, a, tracks, plan_photos(spark, sf))


@query("F13_trip_class", f"WITH {_ALL}, {PLAN_PHOTOS}, {_CLASSES} SELECT trip_id, commute_class FROM classes")
def f13(spark, sf):
    return _classed(spark, sf)[2]


@query("E17_commute_trips", f"""WITH {_ALL}, {PLAN_PHOTOS}, {_CLASSES} SELECT trip_id, commute_class, (SELECT count(*) FROM plan_places p WHERE p.trip_id = c.trip_id) AS place_count, (SELECT count(*) FROM plan_photos p WHERE p.trip_id = c.trip_id) AS photo_count, commute_class = 'pure' AS deletable FROM classes c WHERE commute_class <> 'none'""")
def e17(spark, sf):
    p, tracks, classes = _classed(spark, sf)
    t = plan_trips(spark, sf).join(classes, "trip_id")
    return commute.commute_trip_list(t, p, plan_photos(spark, sf), tracks).select("trip_id", "commute_class", "place_count", "photo_count", "deletable")


@query("F14_retitle", f"""WITH {PLAN_PLACES}, {PLAN_TRIPS}, c AS (SELECT trip_id, arg_max(geo_city, (s, geo_city)) AS city FROM (SELECT trip_id, geo_city, sum(epoch_us("end") - epoch_us(start)) AS s FROM plan_places WHERE geo_city IS NOT NULL GROUP BY ALL) GROUP BY trip_id),
l AS (SELECT trip_id, list_sort(list(DISTINCT geo_country)) AS lands FROM plan_places WHERE geo_country IS NOT NULL GROUP BY trip_id),
b AS (SELECT t.*, strftime(local_date, '%m-%d') AS stamp, CASE WHEN trip_id % 7 = 3 AND regexp_full_match(title, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'Commute · ' || strftime(local_date, '%m-%d') ELSE title END AS bare FROM plan_trips t)
SELECT trip_id, CASE WHEN is_auto AND (regexp_full_match(bare, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR bare LIKE '%' || stamp) AND (city IS NOT NULL OR len(lands) >= 2)
  THEN CASE WHEN len(lands) >= 2 THEN lands[1] || ' → ' || lands[-1] || ' · ' || stamp ELSE city || ' · ' || stamp END ELSE bare END AS title FROM b LEFT JOIN c USING (trip_id) LEFT JOIN l USING (trip_id)""")
def f14(spark, sf):
    t = plan_trips(spark, sf).withColumn("commute_class", F.when(F.col("trip_id") % 7 == 3, "pure").otherwise("none"))
    return commute.retitle_trips(t, plan_places(spark, sf)).select("trip_id", "title")


@query("F18_commute_actions", f"""WITH {PLAN}, {PLAN_TRIPS} SELECT trip_id, trip_id % 11 = 5 AS collapsed FROM plan_trips WHERE NOT (trip_id % 7 = 3 AND trip_id % 2 = 0)""")
def f18(spark, sf):
    t = plan_trips(spark, sf).withColumn("commute_class", F.when(F.col("trip_id") % 7 == 3, "pure").otherwise("none"))
    p, m = plan_places(spark, sf), plan_tracks(spark, sf).withColumn("is_commute", F.lit(True))
    t, p, m = commute.commute_action(t, p, m, t.where("commute_class = 'pure' and trip_id % 2 = 0"), "delete")
    return commute.commute_action(t, p, m, t.where("trip_id % 11 = 5"), "collapse")[0].select("trip_id", "collapsed")

