"""Findings of round 4: estimates of fixtures, anchors without joins, and what they were measured by."""

import datetime
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import anchors, graph, points
from waymark.plans import QUERIES, fixtures

SF = "/root/testdata/sf0.001"
T0 = datetime.datetime(2024, 1, 1)
VISITS = "user_id long, id long, start timestamp_ntz, lat double, lon double"


def at(s):
    return T0 + datetime.timedelta(seconds=s)


def exchanges(df):
    """Shuffles of a plan as it stands before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def reckoned(df):
    """The bytes that Spark takes a table for."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


@pytest.mark.parametrize("make", [fixtures.plan_trips, fixtures.plan_tracks, fixtures.plan_photos, fixtures.plan_places])
def test_day_plans_are_reckoned_with_all_their_days(spark, tmp_path, make):
    n = 5000
    spark.range(n).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), F.lit("n").alias("n_name"), (F.col("id") % 5).cast("int").alias("n_regionkey")).write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(5).select(F.col("id").cast("int").alias("r_regionkey"), F.lit("r").alias("r_name")).write.parquet(f"{tmp_path}/region.parquet")
    assert reckoned(make(spark, str(tmp_path))) > 8 * 45 * n
    # user_id, position, radius and more of three fences for every two users
    assert reckoned(fixtures.fences(spark, str(tmp_path))) > 64 * 1.5 * n


def scattered():
    rnd, rows = random.Random(3), []
    for u in range(9):
        lat0, lon0 = rnd.choice([(35.0, 139.0), (60.0, 179.9995), (0.0, 10.0)])
        for i in range(rnd.randint(3, 80)):
            lon = lon0 + rnd.random() * 0.008
            rows.append((u, 1000 * u + i, at(rnd.randrange(10_000)), lat0 + rnd.random() * 0.008, (lon + 180) % 360 - 180))
    return rows


def test_anchors_of_users_of_many_visits_are_those_of_few(spark):
    v = spark.createDataFrame(scattered(), VISITS)
    whole, cells, both = ({(r["id"], r["anchor_id"], r["is_core"]) for r in anchors.dbscan(spark, v, 150.0, 3, n).collect()} for n in (4000, 0, 40))
    assert whole == cells == both and len({x[1] for x in whole}) < len(whole)


def test_visits_that_lie_by_user_are_not_shuffled_for_their_anchors(spark):
    v = spark.createDataFrame(scattered(), VISITS).repartition(4, "user_id").withColumn("name", F.lit("x"))
    got = anchors.with_anchors(spark, v, 150.0, 3)
    assert exchanges(got) == 1 and got.columns == [*v.columns, "anchor_id", "is_core"] and got.count() == v.count()


def test_a_visit_without_a_position_is_an_anchor_of_its_own(spark):
    rows = [(1, i, at(i), 35.0, 139.0) for i in range(3)] + [(1, i, at(i), None, None) for i in range(3, 8)]
    got = {r["id"]: r["anchor_id"] for r in anchors.dbscan(spark, spark.createDataFrame(rows, VISITS), 150.0, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, **{i: i for i in range(3, 8)}}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["A8_gpx_tracks", "A9_tcx_tracks"])
def test_documents_of_an_export_are_of_so_many_users_each(spark, name, monkeypatch):
    from waymark.plans import records

    monkeypatch.setattr(records, "DOCUMENT", 3)
    made = []
    monkeypatch.setattr(records, "new_path", lambda s, n: made.append(graph.new_path(s, n)) or made[-1])
    assert QUERIES[name](spark, SF).count() > 0
    customers = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert len(glob.glob(made[0].removeprefix("file://") + "/file=*/*.gz")) == customers // 3


@pytest.fixture
def meeting(spark, tmp_path):
    """Events of which two are of one user, second and place, and so are their pings."""
    rows = [(11, T0, 3, "view"), (11 + 8 * 11 * 13, T0, 3, "view"), (12, T0, 3, "view"), (17, T0, 4, "click")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_pings_of_one_second_and_place_stay_two_where_events_name_them(spark, meeting):
    p = fixtures.pings(spark, meeting)
    assert points.first_stored(p, ["event_id", "k"]).count() < p.count()
    got = [tuple(r) for r in QUERIES["J2_first_stored"](spark, meeting).collect()]
    assert sorted(got) == sorted(tuple(r) for r in p.select("user_id", "event_id", "k").collect())


def test_streamed_pings_of_one_second_and_place_stay_two_where_events_name_them(spark, meeting):
    got = {r["user_id"]: r["pings"] for r in QUERIES["K1_deduplicated_stream"](spark, meeting).collect()}
    assert got == {r["user_id"]: r["n"] for r in fixtures.pings(spark, meeting).groupBy("user_id").agg(F.count("*").alias("n")).collect()}


def test_first_stored_keeps_the_first_of_a_dedup_key(spark):
    p = spark.createDataFrame([(1, 5, T0, 1.0, 2.0), (1, 4, T0, 1.000001, 2.0), (2, 1, T0, 1.0, 2.0)], "user_id long, i long, ts timestamp_ntz, lat double, lon double")
    got = points.first_stored(p, ["i"])
    assert got.columns == [*p.columns, "dedup_key"] and sorted((r["user_id"], r["i"], r["lat"]) for r in got.collect()) == [(1, 4, 1.000001), (2, 1, 1.0)]
    key = geo.point_dedup_key(F.col("user_id"), F.col("ts"), F.col("lat"), F.col("lon"))
    assert got.where(F.col("dedup_key") == key).count() == 2
