"""Anchors: places that a user comes back to, what they are, and the fences to propose for them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.geo import EARTH_RADIUS_M, centroid, geohash, haversine_m
from waymark.functions.time import local_hour, local_weekday
from waymark.operators.graph import components, written
from waymark.operators.points import seconds_between
from waymark.operators.stays import _apart, by_user

#: Hours of the night and of work, share of a work place's time that is on weekdays.
NIGHT, WORK, WORK_SHARE = (22, 23, 0, 1, 2, 3, 4, 5), (9, 10, 11, 12, 13, 14, 15, 16, 17), 0.8


def _cells(eps_m: float):
    """Bands and cells whose diagonal is below ``eps_m``: row of a latitude, cells of a row, cell of a longitude."""
    step = math.degrees(eps_m / EARTH_RADIUS_M) / math.sqrt(2) * 0.999
    row = lambda lat: F.floor((lat + 90) / step)

    def count(band: Column) -> Column:
        """Cells of the band, at most ``step`` wide at its end nearer to the equator."""
        low = F.when(band * step - 90 >= 0, band * step - 90).when((band + 1) * step - 90 <= 0, 90 - (band + 1) * step).otherwise(F.lit(0.0))
        return F.greatest(F.lit(1).cast("long"), F.ceil(360 * F.cos(F.radians(F.least(F.lit(90.0), low))) / step))

    cell = lambda n, lon: F.pmod(F.floor((lon + 180) / (360 / n)), n)
    return step, row, count, cell


def _around(points: DataFrame, eps_m: float) -> DataFrame:
    """``points`` once for each cell, ``band_`` and ``cell_``, that a point within ``eps_m`` may lie in."""
    step, row, count, _ = _cells(eps_m)
    degrees = math.degrees(eps_m / EARTH_RADIUS_M)
    some = points.withColumn("band_", F.explode(F.sequence(row(F.col("lat") - degrees), row(F.col("lat") + degrees)))).withColumn("n_", count(F.col("band_")))
    # How far east and west that is, at the latitude within reach that is nearest to a pole.
    most = F.abs("lat") + degrees
    reach = F.when(most >= 89.9, F.lit(180.0)).otherwise(degrees / F.cos(F.radians(most)))
    width = 360 / F.col("n_")
    first, last = F.floor((F.col("lon") - reach + 180) / width), F.floor((F.col("lon") + reach + 180) / width)
    cells = F.array_distinct(F.transform(F.sequence(first, F.least(last, first + F.col("n_") - 1)), lambda c: F.pmod(c, F.col("n_"))))
    return some.withColumn("cell_", F.explode(cells)).drop("n_")


def _placed(points: DataFrame, eps_m: float) -> DataFrame:
    _, row, count, cell = _cells(eps_m)
    return points.withColumn("band_", row(F.col("lat"))).withColumn("cell_", cell(count(F.col("band_")), F.col("lon")))


_KEYS = ["user_id", "band_", "cell_"]


#: Visits of one user that a task compares all with all; users with more go by cells.
WHOLE = 4000


def first_cores(lat: np.ndarray, lon: np.ndarray, eps_m: float, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one user's visits in order of (start, id): the visit that names the anchor of each, and whether it is core. A visit without a position is near none."""
    n, p, q = len(lat), np.radians(lat), np.radians(lon)
    spot = [np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)]
    chord = (2 * math.sin(min(eps_m / (2 * EARTH_RADIUS_M), math.pi / 2))) ** 2
    near = np.empty((n, n), bool)
    for a in range(0, n, 512):
        near[a : a + 512] = sum((v[a : a + 512, None] - v[None, :]) ** 2 for v in spot) <= chord
    core = near.sum(axis=1) >= min_samples
    label = np.full(n, -1)
    for i in np.flatnonzero(core).tolist():
        if label[i] < 0:
            found = np.array([i])
            while len(found):
                label[found] = i
                found = np.flatnonzero(near[found].any(axis=0) & core & (label < 0))
    rest = np.flatnonzero(~core)
    made = np.where(near[rest] & core, label, n).min(axis=1, initial=n)
    label[rest] = np.where(made < rest, made, rest)
    return label, core


def _anchors_of(eps_m: float, min_samples: int) -> Callable[[pa.Array], pa.Array]:
    """Arrays of a user's visits (start, id, lat, lon) to arrays of anchor_id and is_core."""

    def run(visits: pa.Array) -> pa.Array:
        size = np.asarray(visits.value_lengths().fill_null(0), dtype=np.int64)
        flat, first = visits.flatten(), np.concatenate([[0], np.cumsum(size)])
        ids = flat.field("id")
        columns = pa.table({"row": np.repeat(np.arange(len(size)), size), "start": flat.field("start"), "id": ids})
        order = pc.sort_indices(columns, sort_keys=[(c, "ascending") for c in columns.column_names], null_placement="at_start").to_numpy()
        lat, lon = (np.asarray(flat.field(c).cast(pa.float64()).fill_null(np.nan), dtype=np.float64)[order] for c in ("lat", "lon"))
        at, is_core = np.empty(len(flat), np.int64), np.empty(len(flat), bool)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            label, core = first_cores(lat[a:b], lon[a:b], eps_m, min_samples)
            at[order[a:b]], is_core[order[a:b]] = order[a:b][label], core
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([ids.take(pa.array(at)), pa.array(is_core)], names=["anchor_id", "is_core"]))

    return run


def with_anchors(spark: SparkSession, visits: DataFrame, eps_m: float, min_samples: int, whole: int = WHOLE) -> DataFrame:
    """``visits`` (user_id, id, start, lat, lon and whatever else) with anchor_id and is_core, see ``dbscan``.

    A user's visits are an array, which one task compares, and nothing is written; rows that are partitioned by
    user aren't shuffled for it. Users of more than ``whole`` visits go by cells, over all tasks. The result is the same.
    """
    same = F.col("user_id").eqNullSafe(F.col("user_"))
    many = written(spark, visits.groupBy(F.col("user_id").alias("user_")).agg(F.count("*").alias("n_")).where(F.col("n_") > whole).select("user_"), "many-visits")
    some = many.limit(1).count()
    rest = [c for c in visits.columns if c != "user_id"]
    types = visits.schema
    made = f"array<struct<anchor_id: {types['id'].dataType.simpleString()}, is_core: boolean>>"
    each = (visits.join(many, same, "left_anti") if some else visits).groupBy("user_id").agg(F.collect_list(F.struct(*rest)).alias("v_"))
    run = _anchors_of(eps_m, min_samples)

    @F.arrow_udf(made)
    def found(v: pa.Array) -> pa.Array:
        return run(v)

    spots = F.transform("v_", lambda v: F.struct(v["start"].alias("start"), v["id"].alias("id"), v["lat"].alias("lat"), v["lon"].alias("lon")))
    out = each.withColumn("a_", found(spots)).select("user_id", F.inline(F.arrays_zip("v_", "a_"))).select("user_id", *[F.col(f"v_.{c}").alias(c) for c in rest], "a_.anchor_id", "a_.is_core")
    out = out.select(*visits.columns, "anchor_id", "is_core")
    if not some:
        return out
    large = visits.join(many, same, "left_semi")
    return out.unionByName(large.join(_by_cells(spark, large, eps_m, min_samples), ["user_id", "id"]))


def dbscan(spark: SparkSession, visits: DataFrame, eps_m: float, min_samples: int, whole: int = WHOLE) -> DataFrame:
    """user_id, id, anchor_id, is_core of visits (user_id, id, start, lat, lon).

    A visit is core with ``min_samples`` visits of its user within ``eps_m``,
    itself included; core visits within that of each other are one anchor, named by
    its first core visit by (start, id). Another visit joins the earliest anchor that has a
    core visit within reach, if that began before it, and else is one of its own.
    """
    return with_anchors(spark, visits.select("user_id", "id", "start", "lat", "lon"), eps_m, min_samples, whole).select("user_id", "id", "anchor_id", "is_core")


def _by_cells(spark: SparkSession, visits: DataFrame, eps_m: float, min_samples: int) -> DataFrame:
    """``dbscan`` by joins.

    All visits of a cell are within reach of each other, so a cell with enough
    of them is core without any distance; only visits of sparser cells
    are compared with what is around. Cells are then linked by their outermost
    members, and only neighbouring cells not linked by these compare all.
    """
    of = _placed(visits.select("user_id", "id", "start", "lat", "lon"), eps_m)
    of = written(spark, of.withColumn("here_", F.count("*").over(Window.partitionBy(*_KEYS))), "visits")
    sparse = _around(of.where(F.col("here_") < min_samples).drop("band_", "cell_", "here_"), eps_m)
    near = lambda a, b: haversine_m(F.col(f"{a}lat"), F.col(f"{a}lon"), F.col(f"{b}lat"), F.col(f"{b}lon")) <= eps_m
    other = of.select(*_KEYS, F.col("id").alias("o_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    met = sparse.join(other, _KEYS).where(near("", "o_")).select("user_id", "id", "o_id")
    met = written(spark, met, "met")
    counted = met.groupBy("user_id", "id").agg(F.count("*").alias("n_")).where(F.col("n_") >= min_samples).select("user_id", "id", F.lit(True).alias("more_"))
    of = of.join(counted, ["user_id", "id"], "left").withColumn("is_core", (F.col("here_") >= min_samples) | F.coalesce("more_", F.lit(False)))
    of = written(spark, of.withColumn("node_", F.xxhash64(*_KEYS)).drop("more_", "here_"), "cores")
    core = of.where("is_core")

    def links(some: DataFrame) -> DataFrame:
        """Pairs of cells with a member of ``some`` in each within reach."""
        a = _around(some.select("user_id", "lat", "lon", F.col("node_").alias("a")), eps_m)
        b = some.select(*_KEYS, F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("node_").alias("b"))
        return a.join(b, _KEYS).where((F.col("a") < F.col("b")) & near("", "o_")).select("a", "b").distinct()

    at = F.struct("lat", "lon")
    edge = core.groupBy("node_").agg(*[f(at, c).alias(f"{n}{c}") for n, f in (("a", F.min_by), ("b", F.max_by)) for c in ("lat", "lon")])
    corners = core.select("node_", *_KEYS).distinct().join(edge.select("node_", F.inline(F.array_distinct(F.array("alat", "blat", "alon", "blon")))), "node_")
    comp = components(spark, links(corners))
    # Cells that their outermost members don't link: all members of the two.
    cells = core.select("user_id", "band_", "cell_", "node_").distinct().join(comp.select(F.col("node").alias("node_"), "comp"), "node_", "left").withColumn("comp", F.coalesce("comp", "node_"))
    cells = written(spark, cells, "cells")
    members = core.select("node_", "lat", "lon", "user_id").join(cells.select("node_", F.col("comp").alias("comp_")), "node_")
    b = core.select(*_KEYS, F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("node_").alias("b")).join(cells.select(F.col("node_").alias("b"), F.col("comp").alias("o_comp")), "b")
    more = _around(members.withColumnRenamed("node_", "a"), eps_m).join(b, _KEYS).where((F.col("comp_") < F.col("o_comp")) & near("", "o_"))
    joined = components(spark, more.select(F.col("comp_").alias("a"), F.col("o_comp").alias("b")).distinct())
    cells = cells.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("to_")), "comp", "left").select("node_", F.coalesce("to_", "comp").alias("comp"))
    first = F.struct("start", "id")
    named = core.join(cells, "node_").select("user_id", "id", "start", "comp")
    named = named.join(named.groupBy("comp").agg(F.min(first).alias("made")), "comp").select("user_id", "id", "made")
    named = written(spark, named, "named")
    border = met.join(named.select("user_id", F.col("id").alias("o_id"), "made"), ["user_id", "o_id"]).groupBy("user_id", "id").agg(F.min("made").alias("made_"))
    out = of.select("user_id", "id", "start", "is_core").join(named, ["user_id", "id"], "left").join(border, ["user_id", "id"], "left")
    joins = ~F.col("is_core") & (F.col("made_") < first)
    return out.select("user_id", "id", F.when(F.col("is_core"), F.col("made.id")).when(joins, F.col("made_.id")).otherwise(F.col("id")).alias("anchor_id"), "is_core")


def aggregate_anchors(visits: DataFrame) -> DataFrame:
    """Anchors of visits (user_id, anchor_id, start, end, lat, lon, tz_name): centre, radius, numbers, dwell, share of it on weekdays, visits by local hour, kind and its source.

    The histogram has an entry for each of the hours that a visit lasts, from
    its local start on, one at least.
    """
    dwell = F.floor(seconds_between(F.col("start"), F.col("end"))).cast("long")
    v = visits.withColumns({"dwell_": dwell, "hour_": local_hour(F.col("start"), F.col("tz_name")), "work_": local_weekday(F.col("start"), F.col("tz_name")) < 5})
    v = v.withColumn("hours_", F.greatest(F.lit(1), F.floor(F.col("dwell_") / 3600)))
    lat, lon = centroid(F.col("lat"), F.col("lon"))
    at_hour = lambda h: F.sum(F.floor(F.col("hours_") / 24) + (F.pmod(F.lit(h) - F.col("hour_"), F.lit(24)) < F.col("hours_") % 24).cast("long"))
    kind, source = semantic_kind(F.col("semantic_type"))
    a = v.groupBy("user_id", "anchor_id").agg(
        lat.alias("lat"), lon.alias("lon"), F.count("*").alias("visit_count"), F.min("start").alias("first_visit"), F.max("end").alias("last_visit"), F.sum("dwell_").alias("total_duration_s"),
        F.sum(F.when(F.col("work_"), F.col("dwell_")).otherwise(0)).alias("weekday_s"), F.array(*[at_hour(h) for h in range(24)]).alias("hour_histogram"), kind.alias("kind"), source.alias("kind_source"))
    far = v.select("user_id", "anchor_id", F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon")).join(a.select("user_id", "anchor_id", "lat", "lon"), ["user_id", "anchor_id"])
    far = far.groupBy("user_id", "anchor_id").agg(F.max(haversine_m(F.col("lat"), F.col("lon"), F.col("v_lat"), F.col("v_lon"))).alias("radius_m"))
    share = F.when(F.col("total_duration_s") > 0, F.col("weekday_s") / F.col("total_duration_s"))
    # Every anchor has a radius; by a left join it is left out where nobody asks for it.
    return a.join(far, ["user_id", "anchor_id"], "left").withColumn("weekday_ratio", share).drop("weekday_s")


def semantic_kind(semantic_type: Column, frequent: int = 3) -> tuple[Column, Column]:
    """Aggregates: kind and its source, from what the visits were declared as."""
    name = F.lower(F.trim(semantic_type))
    has = lambda *k: F.coalesce(F.bool_or(name.isin(*k)), F.lit(False))
    kind = F.when(has("home"), "home").when(has("work"), "work").when(has("inferred home"), "home").when(has("inferred work"), "work").when(F.count("*") >= frequent, "frequent").otherwise("other")
    return kind, F.when(has("home", "work"), "confirmed").when(has("inferred home", "inferred work"), "inferred")


def infer_home_work(anchors: DataFrame) -> DataFrame:
    """``anchors`` with a home and a work place guessed for users who have none: of anchors without a source, the one most visited at night, and the one most visited at work hours on weekdays. Ties go to the earliest."""
    hours = lambda some: F.aggregate(F.filter("hour_histogram", lambda _, i: i.isin(*some)), F.lit(0).cast("long"), lambda a, x: a + x)
    user = Window.partitionBy("user_id")
    best = lambda score, may: F.row_number().over(user.orderBy(F.when(may, score).desc_nulls_last(), "first_visit", "anchor_id"))
    a = anchors.withColumns({"night_": hours(NIGHT), "day_": hours(WORK), "open_": F.col("kind_source").isNull(), "home_": F.max((F.col("kind") == "home").cast("int")).over(user), "job_": F.max((F.col("kind") == "work").cast("int")).over(user)})
    is_home = F.col("open_") & (F.col("home_") == 0) & (F.col("night_") > 0) & (best(F.col("night_"), F.col("open_")) == 1)
    a = a.withColumn("is_home_", is_home)
    may = F.col("open_") & ~F.col("is_home_") & (F.coalesce("weekday_ratio", F.lit(0.0)) >= WORK_SHARE)
    is_work = may & (F.col("job_") == 0) & (F.col("day_") > 0) & (best(F.col("day_"), may) == 1)
    a = a.withColumn("is_work_", is_work)
    kind = F.when(F.col("is_home_"), "home").when(F.col("is_work_"), "work").otherwise(F.col("kind"))
    source = F.when(F.col("is_home_") | F.col("is_work_"), "heuristic").otherwise(F.col("kind_source"))
    return a.withColumns({"kind": kind, "kind_source": source}).select(*anchors.columns)


_FENCE = "user_id long, kind string, confidence string, lat double, lon double, visit_count long, first_visit timestamp_ntz, last_visit timestamp_ntz"


def suggest_fences(anchors: DataFrame, fences: DataFrame, merge_m: float = 200.0, radius_m: float = 500.0) -> DataFrame:
    """Fences to propose for home and work anchors; those of one kind and source within ``merge_m`` become one, busiest first, weighted by visits. ``already_fenced``: a fence of the user lies as near.

    Anchors of different sources are different addresses and never merge.
    """
    order = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("visit_count"), F.desc_nulls_last("last_visit"), "anchor_id")).alias("order_")
    some = anchors.where(F.col("kind").isin("home", "work")).select("user_id", "kind", F.col("kind_source").alias("confidence"), "lat", "lon", "visit_count", "first_visit", "last_visit", order)
    rows = by_user(some, "order_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, made = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:8])):
                if row[0] != user:
                    if made:
                        yield out(made)
                    user, made = row[0], []
                for m in made:
                    if m[1] == row[1] and m[2] == row[2] and _apart(m[3], m[4], row[3], row[4]) <= merge_m:
                        n = m[5] + row[5]
                        w = m[5] / n
                        m[3:] = [m[3] * w + row[3] * (1 - w), m[4] * w + row[4] * (1 - w), n, min(m[6], row[6]), max(m[7], row[7])]
                        break
                else:
                    made.append(list(row))
        if made:
            yield out(made)

    def out(made: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.timestamp("us"), pa.timestamp("us")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], [c.split()[0] for c in _FENCE.split(", ")])

    merged = rows.mapInArrow(run, _FENCE)
    named = merged.withColumn("id_", F.xxhash64("user_id", "kind", "confidence", "lat", "lon"))
    near = named.join(fences.select("user_id", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon")), "user_id").where(haversine_m(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon")) < merge_m)
    return named.join(near.select("user_id", "id_").distinct().withColumn("near_", F.lit(True)), ["user_id", "id_"], "left").select(
        *merged.columns, F.lit(radius_m).alias("radius_m"), F.coalesce("near_", F.lit(False)).alias("already_fenced"))


def adopt_fences(suggestions: DataFrame, secret: str, tiers: tuple[str, ...] = ("confirmed", "inferred")) -> DataFrame:
    """The fences that a user gets who takes the suggestions of these tiers: those not fenced yet, each with a seed that only ``secret`` tells."""
    seed = F.shiftrightunsigned(F.xxhash64(F.sha2(F.concat_ws("|", F.lit(secret), "user_id", "lat", "lon"), 256)), 1)
    return suggestions.where(F.col("confidence").isin(*tiers) & ~F.col("already_fenced")).select("user_id", "kind", "lat", "lon", "radius_m", seed.alias("jitter_seed"), F.lit(True).alias("enabled"))


def anchor_ranking(anchors: DataFrame, visits: DataFrame, by: str = "visit_count", limit: int = 100) -> DataFrame:
    """The ``limit`` anchors with the highest ``by`` (visit_count or total_duration_s), and in how many trips they occur."""
    trips = visits.groupBy("user_id", "anchor_id").agg(F.count_distinct("trip_id").alias("trips"))
    return anchors.join(trips, ["user_id", "anchor_id"], "left").withColumn("trips", F.coalesce("trips", F.lit(0))).orderBy(F.desc(by), "user_id", "anchor_id").limit(limit)


def to_geocode(anchors: DataFrame, limit: int = 200) -> DataFrame:
    """Anchors without a name, busiest first."""
    return anchors.where("geo_name is null").orderBy(F.desc("visit_count"), "user_id", "anchor_id").limit(limit)


def geocode_lookup(anchors: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Names of a gazetteer (geohash7, geo_name, geo_city, geo_country) for anchors that lie in its cells; names they have stay."""
    names = ["geo_name", "geo_city", "geo_country"]
    found = gazetteer.select(F.col("geohash7").alias("cell_"), *[F.col(n).alias(f"g_{n}") for n in names])
    old = lambda n: F.col(n) if n in anchors.columns else F.lit(None).cast("string")
    got = anchors.withColumn("cell_", geohash(F.col("lat"), F.col("lon"), 7)).join(found, "cell_", "left")
    return got.select(*[c for c in anchors.columns if c not in names], *[F.coalesce(old(n), F.col(f"g_{n}")).alias(n) for n in names])


def inherit_names(places: DataFrame, anchors: DataFrame) -> DataFrame:
    """Places (user_id, anchor_id) with the names of their anchors where they have none."""
    names = ["geo_name", "geo_city", "geo_country"]
    a = anchors.select("user_id", "anchor_id", *[F.col(n).alias(f"a_{n}") for n in names])
    return places.join(a, ["user_id", "anchor_id"], "left").select(*[c for c in places.columns if c not in names], *[F.coalesce(n, f"a_{n}").alias(n) for n in names])
