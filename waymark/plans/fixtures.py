"""Inputs of the queries, derived from the given tables; each with the same in SQL.

The tables have no positions: pings come from events by fixed arithmetic (a
home, a work place and others for each user, in one of three cities).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The cities' corners and zones, degrees a step by speed class.
LAT, LON = (35.6, 40.7, 51.5), (139.7, -74.0, -0.1)
ZONES = ("Asia/Tokyo", "America/New_York", "Europe/London")
STEPS = (0.00135, 0.0054, 0.0135, 0.043)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index, values):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def slot(event_id, ts):
    h = F.hour(ts)
    return F.when((h < 8) | (h >= 20), 0).when((h >= 9) & (h < 18), 1).otherwise(2 + event_id % 5)


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, k, ts, lat, lon, accuracy_m, altitude_m, tz_name."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("t0"))
    user, event, k = F.col("user_id"), F.col("event_id"), F.col("k")
    step = F.when(F.col("event_type") == "click", pick(event % 4, STEPS)).otherwise(0.0)
    s = slot(event, F.col("t0"))
    p = e.withColumns({"slot": s, "step": step, "k": F.explode(F.sequence(F.lit(0), (5 + event % 8).cast("int")))})
    return p.select(
        "user_id", "event_id", "k", F.col("t0") .__add__(F.make_dt_interval(secs=(k * 120).cast("decimal(18,6)"))).alias("ts"),
        (pick(user % 3, LAT) + (user % 97) * 0.01 + F.col("slot") * 0.03 + k * F.col("step") + ((event * 7 + k * 3) % 11 - 5) * 0.00002).alias("lat"),
        (pick(user % 3, LON) + (user % 89) * 0.01 + F.col("slot") * 0.02 + ((event * 5 + k * 7) % 13 - 6) * 0.00002).alias("lon"),
        F.when(event % 3 != 0, (5 + (event * 13 + k) % 600).cast("double")).alias("accuracy_m"),
        F.when(event % 4 == 3, ((event * 31 + k * 17) % 900).cast("double")).alias("altitude_m"),
        pick(user % 3, ZONES).alias("tz_name"),
    )


PINGS = """
e0 AS (SELECT event_id, user_id, event_type, ts AS t0, extract(hour FROM ts) AS h FROM events),
pings AS (
  SELECT user_id, event_id, k, t0 + k * INTERVAL 120 SECOND AS ts,
    ([35.6, 40.7, 51.5]::DOUBLE[])[(user_id % 3 + 1)::INT] + (user_id % 97) * 0.01::DOUBLE + slot * 0.03::DOUBLE + k * step + ((event_id * 7 + k * 3) % 11 - 5) * 0.00002::DOUBLE AS lat,
    ([139.7, -74.0, -0.1]::DOUBLE[])[(user_id % 3 + 1)::INT] + (user_id % 89) * 0.01::DOUBLE + slot * 0.02::DOUBLE + ((event_id * 5 + k * 7) % 13 - 6) * 0.00002::DOUBLE AS lon,
    CASE WHEN event_id % 3 <> 0 THEN (5 + (event_id * 13 + k) % 600)::DOUBLE END AS accuracy_m,
    CASE WHEN event_id % 4 = 3 THEN ((event_id * 31 + k * 17) % 900)::DOUBLE END AS altitude_m,
    ['Asia/Tokyo', 'America/New_York', 'Europe/London'][(user_id % 3 + 1)::INT] AS tz_name
  FROM (
    SELECT *, CASE WHEN h < 8 OR h >= 20 THEN 0 WHEN h >= 9 AND h < 18 THEN 1 ELSE 2 + event_id % 5 END AS slot,
      CASE WHEN event_type = 'click' THEN ([0.00135, 0.0054, 0.0135, 0.043]::DOUBLE[])[(event_id % 4 + 1)::INT] ELSE 0::DOUBLE END AS step,
      unnest(range(0, 6 + event_id % 8)) AS k
    FROM e0))
"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared stays: user_id, hint_id, start, end (20 minutes), lat, lon, tz_name, semantic_type; from signup events."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    at, user = F.col("ts").cast("timestamp_ntz"), F.col("user_id")
    s = slot(F.col("event_id"), at)
    kinds = F.when(F.col("event_id") % 5 < 4, pick(F.col("event_id") % 5, ("Home", "Work", "Inferred Home", "Inferred Work")))
    return e.select("user_id", F.col("event_id").alias("hint_id"), at.alias("start"), (at + F.expr("interval 20 minutes")).alias("end"), (pick(user % 3, LAT) + (user % 97) * 0.01 + s * 0.03).alias("lat"), (pick(user % 3, LON) + (user % 89) * 0.01 + s * 0.02).alias("lon"), pick(user % 3, ZONES).alias("tz_name"), kinds.alias("semantic_type"))


VISITS = """
visits AS (
  SELECT user_id, event_id AS hint_id, ts AS start, ts + INTERVAL 20 MINUTE AS "end",
    ([35.6, 40.7, 51.5]::DOUBLE[])[(user_id % 3 + 1)::INT] + (user_id % 97) * 0.01::DOUBLE + slot * 0.03::DOUBLE AS lat,
    ([139.7, -74.0, -0.1]::DOUBLE[])[(user_id % 3 + 1)::INT] + (user_id % 89) * 0.01::DOUBLE + slot * 0.02::DOUBLE AS lon,
    ['Asia/Tokyo', 'America/New_York', 'Europe/London'][(user_id % 3 + 1)::INT] AS tz_name,
    CASE WHEN event_id % 5 < 4 THEN ['Home', 'Work', 'Inferred Home', 'Inferred Work'][(event_id % 5 + 1)::INT] END AS semantic_type
  FROM (SELECT *, CASE WHEN extract(hour FROM ts) < 8 OR extract(hour FROM ts) >= 20 THEN 0 WHEN extract(hour FROM ts) BETWEEN 9 AND 17 THEN 1 ELSE 2 + event_id % 5 END AS slot FROM events WHERE event_type = 'signup'))
"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, photo_id, ts, content: from purchases, three minutes later; neighbours share a content."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select("user_id", F.col("event_id").alias("photo_id"), (F.col("ts").cast("timestamp_ntz") + F.expr("interval 3 minutes")).alias("ts"), F.sha2(F.floor(F.col("event_id") / 2).cast("string"), 256).alias("content"))


PHOTOS = """
photos AS (SELECT user_id, event_id AS photo_id, ts + INTERVAL 3 MINUTE AS ts, sha256((event_id // 2)::VARCHAR) AS content FROM events WHERE event_type = 'purchase')
"""


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The distance in SQL."""
    return (
        f"(2 * 6371008.8 * asin(least(1.0::DOUBLE, sqrt(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )


# --- day plans: what each customer does on 45 days from a Monday on ----------------

DAYS = 45
#: Degrees from a home to the places of a day, by slot (home, work, lunch, three outings).
SLOT_LAT, SLOT_LON = (0.0, 0.03, 0.0325, 0.05, 0.06, 0.07), (0.0, 0.02, 0.0225, 0.04, 0.04, 0.04)
TRACK_MODES = ("car", "bike", "walk", "transit", "unknown")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, d, trip_id, t0, weekday, dep (minute of the day), n_nationkey."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nation"))
    c = c.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "user_id")  # the days of a row are many, and the file is small
    k, d = F.col("user_id"), F.col("d")
    # Days come by a join, by which Spark reckons with as many rows; after explode it would take the table for as small as its file, and broadcast it.
    p = c.crossJoin(F.broadcast(spark.range(DAYS).select(F.col("id").cast("int").alias("d"))))
    dep = F.when(k % 4 == 3, (k * 31 + d * 577) % 1080).otherwise(480 + (k * 7 + d * 3) % 20)
    day = F.date_add(F.lit("2024-01-01").cast("date"), d)
    return p.withColumns({"trip_id": k * DAYS + d, "day": day, "weekday": d % 7 < 5, "dep": dep, "free": 600 + k % 60})


PLAN = f"""
plan AS (SELECT *, CASE WHEN user_id % 4 = 3 THEN (user_id * 31 + d * 577) % 1080 ELSE 480 + (user_id * 7 + d * 3) % 20 END AS dep FROM (
  SELECT c_custkey AS user_id, c_nationkey AS nation, d, c_custkey * {DAYS} + d AS trip_id, (DATE '2024-01-01' + d::INT) AS day, d % 7 < 5 AS weekday, 600 + c_custkey % 60 AS free
  FROM customer, range(0, {DAYS}) t(d)))
"""


def _minute(day, minutes):
    return F.timestamp_seconds(F.unix_date(day) * 86400 + minutes * 60).cast("timestamp_ntz")


def _home(user):
    return pick(user % 3, LAT) + (user % 97) * 0.01, pick(user % 3, LON) + (user % 89) * 0.01


def plan_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays: user_id, place_id, trip_id, day, slot, start, end, lat, lon, tz_name, semantic_type, is_inferred, geo_city, geo_country."""
    p = _plan(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    i, dep, free, w = F.col("i"), F.col("dep"), F.col("free"), F.col("weekday")
    third = F.col("user_id") % 3 == 0
    a = F.when(i == 0, 0).when(w & (i == 1), dep + 30).when(w & (i == 2) & third, dep + 280).when(w & (i == 4) & third, dep + 320).when(w & (i == 3), dep + 540).when(~w & (i == 1), free + 30).when(~w & (i == 3), free + 190)
    b = F.when(i == 0, F.when(w, dep).otherwise(free)).when(w & (i == 1), dep + F.when(third, 270).otherwise(510)).when(w & (i == 2), dep + 310).when(w & (i == 4), dep + 510).when(i == 3, 1440).when(~w & (i == 1), free + 150)
    slot = F.when(i.isin(0, 3), 0).when(i == 2, 2).when(w, 1).otherwise(3 + F.col("d") % 3)
    p = p.withColumns({"a": a, "b": b, "slot": slot, "place_id": F.col("trip_id") * 5 + i}).where("a < b")
    lat, lon = _home(F.col("user_id"))
    k5 = F.col("user_id") % 5
    kind = F.when((F.col("slot") == 0) & (k5 == 0), "Home").when((F.col("slot") == 0) & (k5 == 1), "Inferred Home").when((F.col("slot") == 1) & k5.isin(0, 2), "Work")
    nation = F.when(F.col("slot") >= 3, (F.col("nation") + 1 + F.col("d")) % 25).otherwise(F.col("nation"))
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = names.select(F.col("n_nationkey").alias("at_nation"), F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name")).alias("geo_city"), F.when(F.col("n_nationkey") % 7 != 0, F.col("r_name")).alias("geo_country"))
    p = p.withColumn("at_nation", nation).join(F.broadcast(names), "at_nation")  # 25 rows
    jitter = ((F.col("place_id") * 7) % 11 - 5) * 0.00002
    return p.select(
        "user_id", "place_id", "trip_id", "day", "slot", _minute(F.col("day"), F.col("a")).alias("start"), _minute(F.col("day"), F.col("b")).alias("end"),
        (lat + pick(F.col("slot"), SLOT_LAT) + jitter).alias("lat"), (lon + pick(F.col("slot"), SLOT_LON) + jitter).alias("lon"),
        pick(F.col("user_id") % 3, ZONES).alias("tz_name"), kind.alias("semantic_type"), (F.col("place_id") % 11 == 0).alias("is_inferred"), "geo_city", "geo_country")


_SQL_HOME = "([35.6, 40.7, 51.5]::DOUBLE[])[(user_id % 3 + 1)::INT] + (user_id % 97) * 0.01::DOUBLE", "([139.7, -74.0, -0.1]::DOUBLE[])[(user_id % 3 + 1)::INT] + (user_id % 89) * 0.01::DOUBLE"
_SQL_SLOTS = f"({list(SLOT_LAT)}::DOUBLE[])[(slot + 1)::INT]", f"({list(SLOT_LON)}::DOUBLE[])[(slot + 1)::INT]"

PLAN_PLACES = PLAN + f""",
plan_places AS (
  SELECT user_id, place_id, trip_id, day, slot, day::TIMESTAMP + a * INTERVAL 1 MINUTE AS start, day::TIMESTAMP + b * INTERVAL 1 MINUTE AS "end",
    {_SQL_HOME[0]} + {_SQL_SLOTS[0]} + ((place_id * 7) % 11 - 5) * 0.00002::DOUBLE AS lat, {_SQL_HOME[1]} + {_SQL_SLOTS[1]} + ((place_id * 7) % 11 - 5) * 0.00002::DOUBLE AS lon,
    ['Asia/Tokyo', 'America/New_York', 'Europe/London'][(user_id % 3 + 1)::INT] AS tz_name,
    CASE WHEN slot = 0 AND user_id % 5 = 0 THEN 'Home' WHEN slot = 0 AND user_id % 5 = 1 THEN 'Inferred Home' WHEN slot = 1 AND user_id % 5 IN (0, 2) THEN 'Work' END AS semantic_type,
    place_id % 11 = 0 AS is_inferred, CASE WHEN n_nationkey % 7 <> 0 THEN n_name END AS geo_city, CASE WHEN n_nationkey % 7 <> 0 THEN r_name END AS geo_country
  FROM (SELECT *, trip_id * 5 + i AS place_id, CASE WHEN i IN (0, 3) THEN 0 WHEN i = 2 THEN 2 WHEN weekday THEN 1 ELSE 3 + d % 3 END AS slot,
      CASE WHEN i = 0 THEN 0 WHEN weekday AND i = 1 THEN dep + 30 WHEN weekday AND i = 2 AND user_id % 3 = 0 THEN dep + 280 WHEN weekday AND i = 4 AND user_id % 3 = 0 THEN dep + 320 WHEN weekday AND i = 3 THEN dep + 540 WHEN NOT weekday AND i = 1 THEN free + 30 WHEN NOT weekday AND i = 3 THEN free + 190 END AS a,
      CASE WHEN i = 0 THEN CASE WHEN weekday THEN dep ELSE free END WHEN weekday AND i = 1 THEN dep + CASE WHEN user_id % 3 = 0 THEN 270 ELSE 510 END WHEN weekday AND i = 2 THEN dep + 310 WHEN weekday AND i = 4 THEN dep + 510 WHEN i = 3 THEN 1440 WHEN NOT weekday AND i = 1 THEN free + 150 END AS b
    FROM plan, range(0, 5) s(i)) q
  JOIN nation ON n_nationkey = CASE WHEN slot >= 3 THEN (nation + 1 + d) % 25 ELSE nation END JOIN region ON n_regionkey = r_regionkey WHERE a < b)
"""


def plan_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements: user_id, track_id, trip_id, day, start, end, points (7), distance_m, duration_s, mode, mode_source."""
    p = _plan(spark, sf_dir).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    j, dep, free, w = F.col("j"), F.col("dep"), F.col("free"), F.col("weekday")
    a = F.when(w, dep + F.when(j == 0, 0).otherwise(510)).otherwise(free + F.when(j == 0, 0).otherwise(150))
    b = a + F.when(w | (j == 0), 30).otherwise(40)
    p = p.withColumns({"a": a, "b": b, "slot": F.when(w, 1).otherwise(3 + F.col("d") % 3), "track_id": F.col("trip_id") * 2 + j}).where("b <= 1440")
    lat, lon = _home(F.col("user_id"))
    far_lat, far_lon = lat + pick(F.col("slot"), SLOT_LAT), lon + pick(F.col("slot"), SLOT_LON)
    p = p.withColumns({"la": F.when(j == 0, lat).otherwise(far_lat), "lo": F.when(j == 0, lon).otherwise(far_lon), "lb": F.when(j == 0, far_lat).otherwise(lat), "lob": F.when(j == 0, far_lon).otherwise(lon)})
    wave = lambda v: ((F.col("track_id") + v) % 5 - 2) * 0.00003
    points = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda v: F.struct((F.col("la") + (F.col("lb") - F.col("la")) * v / 6.0 + wave(v)).alias("lat"), (F.col("lo") + (F.col("lob") - F.col("lo")) * v / 6.0 + wave(v)).alias("lon")))
    t = F.col("track_id")
    return p.select(
        "user_id", "track_id", "trip_id", "day", _minute(F.col("day"), F.col("a")).alias("start"), _minute(F.col("day"), F.col("b")).alias("end"), points.alias("points"),
        F.when(t % 13 != 0, (1000 + t % 977).cast("double")).alias("distance_m"), ((F.col("b") - F.col("a")) * 60).cast("long").alias("duration_s"), pick(t % 5, TRACK_MODES).alias("mode"), F.when(t % 7 == 0, "google").otherwise("inferred").alias("mode_source"))


PLAN_TRACKS = f"""
plan_tracks AS (
  SELECT user_id, track_id, trip_id, day, day::TIMESTAMP + a * INTERVAL 1 MINUTE AS start, day::TIMESTAMP + b * INTERVAL 1 MINUTE AS "end",
    list_transform(range(0, 7), lambda v: {{'lat': la + (lb - la) * v / 6.0::DOUBLE + ((track_id + v) % 5 - 2) * 0.00003::DOUBLE, 'lon': lo + (lob - lo) * v / 6.0::DOUBLE + ((track_id + v) % 5 - 2) * 0.00003::DOUBLE}}) AS points,
    CASE WHEN track_id % 13 <> 0 THEN (1000 + track_id % 977)::DOUBLE END AS distance_m, ((b - a) * 60)::BIGINT AS duration_s,
    {list(TRACK_MODES)}[(track_id % 5 + 1)::INT] AS mode, CASE WHEN track_id % 7 = 0 THEN 'google' ELSE 'inferred' END AS mode_source
  FROM (SELECT *, a + CASE WHEN weekday OR j = 0 THEN 30 ELSE 40 END AS b, CASE WHEN j = 0 THEN h_lat ELSE f_lat END AS la, CASE WHEN j = 0 THEN h_lon ELSE f_lon END AS lo, CASE WHEN j = 0 THEN f_lat ELSE h_lat END AS lb, CASE WHEN j = 0 THEN f_lon ELSE h_lon END AS lob
    FROM (SELECT *, {_SQL_HOME[0]} AS h_lat, {_SQL_HOME[1]} AS h_lon, {_SQL_HOME[0]} + {_SQL_SLOTS[0]} AS f_lat, {_SQL_HOME[1]} + {_SQL_SLOTS[1]} AS f_lon
      FROM (SELECT *, trip_id * 2 + j AS track_id, CASE WHEN weekday THEN 1 ELSE 3 + d % 3 END AS slot, CASE WHEN weekday THEN dep + CASE WHEN j = 0 THEN 0 ELSE 510 END ELSE free + CASE WHEN j = 0 THEN 0 ELSE 150 END END AS a FROM plan, range(0, 2) s(j)))) WHERE b <= 1440)
"""


def plan_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days: user_id, trip_id, local_date, title, group_id, is_auto."""
    p = _plan(spark, sf_dir)
    t = F.col("trip_id")
    title = F.when(t % 9 == 0, "Visit to grandma").when(t % 9 == 1, F.concat(F.lit("Somewhere · "), F.date_format("day", "MM-dd"))).otherwise(F.date_format("day", "yyyy-MM-dd"))
    return p.select("user_id", "trip_id", F.col("day").alias("local_date"), title.alias("title"), F.when(t % 6 != 0, F.col("user_id") % 4).alias("group_id"), (t % 10 != 0).alias("is_auto"))


PLAN_TRIPS = """
plan_trips AS (SELECT user_id, trip_id, day AS local_date, CASE WHEN trip_id % 9 = 0 THEN 'Visit to grandma' WHEN trip_id % 9 = 1 THEN 'Somewhere · ' || strftime(day, '%m-%d') ELSE strftime(day, '%Y-%m-%d') END AS title,
  CASE WHEN trip_id % 6 <> 0 THEN user_id % 4 END AS group_id, trip_id % 10 <> 0 AS is_auto FROM plan)
"""


def plan_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, photo_id, trip_id, day, ts, lat, lon (null for some), tz_name: one on every ninth day, at half past twelve."""
    p = _plan(spark, sf_dir).where((F.col("user_id") + F.col("d")) % 9 == 0)
    lat, lon = _home(F.col("user_id"))
    known, near = F.col("d") % 4 != 0, F.col("trip_id") % 3
    slot = F.when(F.col("weekday"), 1).otherwise(3 + F.col("d") % 3)
    return p.select(
        "user_id", F.col("trip_id").alias("photo_id"), "trip_id", "day", _minute(F.col("day"), F.lit(750)).alias("ts"),
        F.when(known, lat + pick(slot, SLOT_LAT) + near * 0.0009).alias("lat"), F.when(known, lon + pick(slot, SLOT_LON)).alias("lon"), pick(F.col("user_id") % 3, ZONES).alias("tz_name"))


PLAN_PHOTOS = f"""
plan_photos AS (SELECT user_id, trip_id AS photo_id, trip_id, day, day::TIMESTAMP + INTERVAL 750 MINUTE AS ts, CASE WHEN d % 4 <> 0 THEN {_SQL_HOME[0]} + {_SQL_SLOTS[0]} + (trip_id % 3) * 0.0009::DOUBLE END AS lat,
  CASE WHEN d % 4 <> 0 THEN {_SQL_HOME[1]} + {_SQL_SLOTS[1]} END AS lon, ['Asia/Tokyo', 'America/New_York', 'Europe/London'][(user_id % 3 + 1)::INT] AS tz_name
  FROM (SELECT *, CASE WHEN weekday THEN 1 ELSE 3 + d % 3 END AS slot FROM plan WHERE (user_id + d) % 9 = 0))
"""


def fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, fence_id, kind, lat, lon, radius_m, jitter_seed, enabled, last_visit: at each home, and at the work place of even users."""
    # Two come by a join, as days do: Spark reckons with their rows, and doesn't take them for as small as the packed file.
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).crossJoin(F.broadcast(spark.range(2).select(F.col("id").cast("int").alias("n")))).where("n = 0 or user_id % 2 = 0")
    lat, lon = _home(F.col("user_id"))
    n, u = F.col("n"), F.col("user_id")
    return c.select(
        "user_id", (u * 2 + n).alias("fence_id"), F.when(n == 0, "home").otherwise("work").alias("kind"), (lat + pick(n, SLOT_LAT)).alias("lat"), (lon + pick(n, SLOT_LON)).alias("lon"),
        F.when(n == 0, 500.0).otherwise(300.0).alias("radius_m"), u.alias("jitter_seed"), (u % 10 != 0).alias("enabled"), F.when(u % 8 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (u % 45).cast("int"))).alias("last_visit"))


FENCES = f"""
fences AS (SELECT user_id, user_id * 2 + slot AS fence_id, CASE WHEN slot = 0 THEN 'home' ELSE 'work' END AS kind, {_SQL_HOME[0]} + {_SQL_SLOTS[0]} AS lat, {_SQL_HOME[1]} + {_SQL_SLOTS[1]} AS lon, CASE WHEN slot = 0 THEN 500.0::DOUBLE ELSE 300.0::DOUBLE END AS radius_m, user_id AS jitter_seed, user_id % 10 <> 0 AS enabled,
  CASE WHEN user_id % 8 <> 0 THEN DATE '2024-01-01' + (user_id % 45)::INT END AS last_visit FROM (SELECT c_custkey AS user_id, slot FROM customer, range(0, 2) t(slot)) WHERE slot = 0 OR user_id % 2 = 0)
"""
