"""Every query with SQL against DuckDB on the smallest tables; stays against a plain restatement of their rule."""

import datetime
import math
import os
import random

import duckdb
import pytest

from waymark.operators import intervals, stays
from waymark.params import Params
from waymark.plans import QUERIES, SQL, more

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v + 0.0:.6g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (int, str, bool, datetime.date, datetime.datetime)) else float(f"{float(v):.6g}")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    order = sorted(got.columns)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == order
    at = [want.columns.index(c) for c in order]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


T0 = datetime.datetime(2024, 1, 1)


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))


def mean(some):
    v = [(math.cos(math.radians(a)) * math.cos(math.radians(o)), math.cos(math.radians(a)) * math.sin(math.radians(o)), math.sin(math.radians(a))) for a, o in some]
    x, y, z = (sum(c) / len(v) for c in zip(*v))
    return math.degrees(math.atan2(z, math.hypot(x, y))), math.degrees(math.atan2(y, x))


def slow_scan(pts, p):
    """(first, last) second of each stay, by the rule's own words."""
    out, i = [], 0
    while i < len(pts):
        j = i
        while j + 1 < len(pts):
            gap = pts[j + 1][0] - pts[j][0]
            if gap > p.gap_s and (metres(pts[j][1:], pts[j + 1][1:]) >= p.radius_m or gap > p.longest_inferred_s):
                break
            c = mean([x[1:] for x in pts[i : j + 2]])
            if max(metres(c, x[1:]) for x in pts[i : j + 2]) > p.radius_m:
                break
            j += 1
        if pts[j][0] - pts[i][0] >= p.dwell_s and j - i + 1 >= p.min_points:
            out.append((pts[i][0], pts[j][0]))
            i = j + 1
        else:
            i += 1
    return out


def frame(spark, traces):
    rows = [(u, T0 + datetime.timedelta(seconds=t), a, o, None) for u, pts in traces.items() for t, a, o in pts]
    return spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, lat double, lon double, accuracy_m double")


def stays_of(spark, traces, p=Params()):
    got = stays.cluster_stays(frame(spark, traces), p).where("is_stay").collect()
    out = {u: [] for u in traces}
    for r in sorted(got, key=lambda r: r["start"]):
        out[r["user_id"]].append(((r["start"] - T0).total_seconds(), (r["end"] - T0).total_seconds()))
    return out


def test_stays_are_those_of_the_plain_scan(spark):
    rnd, traces = random.Random(4), {}
    for u in range(60):
        t, a, o, pts = 0, 35.0, 139.0, []
        for _ in range(rnd.randint(1, 60)):
            t += rnd.choice([60, 120, 300, 900, 5000, 100_000])
            if rnd.random() < 0.25:
                a, o = 35.0 + rnd.random() * 0.01, 139.0 + rnd.random() * 0.01
            pts.append((t, a + rnd.gauss(0, 4e-4), o + rnd.gauss(0, 4e-4)))
        traces[u] = pts
    assert stays_of(spark, traces) == {u: slow_scan(p, Params()) for u, p in traces.items()}


def test_golden_cases(spark):
    here = [(60 * i, 35.0, 139.0) for i in range(20)]
    later = lambda s, lat: [(s + 60 * i, lat, 139.0) for i in range(20)]
    got = stays_of(spark, {
        1: here + later(6 * 3600, 35.0),  # six hours in one place: one stay
        2: here + later(6 * 3600, 35.04),  # and 4 km on: two
        3: here + later(7 * 86400, 35.0),  # a week: two
        4: here[:3],  # two minutes: movement
    })
    assert [len(got[u]) for u in (1, 2, 3, 4)] == [1, 2, 2, 0]


def test_one_place_for_long_takes_little_time(spark):
    rnd = random.Random(1)
    pts = [(30 * i, 35.0 + rnd.gauss(0, 1e-4), 139.0 + rnd.gauss(0, 1e-4)) for i in range(100_000)]
    assert len(stays_of(spark, {1: pts})[1]) == 1


def test_no_time_is_lost_at_midnight(spark):
    rows = [(1, T0, T0 + datetime.timedelta(hours=60), "America/New_York"), (2, T0, T0, "UTC+09:00"), (3, T0, T0 + datetime.timedelta(hours=30), "Not/AZone")]
    d = spark.createDataFrame(rows, "user_id long, start timestamp_ntz, end timestamp_ntz, tz_name string")
    got = stays.split_at_midnight(d).collect()
    for u, start, end, _ in rows:
        assert sum((r["end"] - r["start"]).total_seconds() for r in got if r["user_id"] == u) == (end - start).total_seconds()
    assert [r["user_id"] for r in got].count(1) == 4


def test_no_implied_move_beside_a_measured_one(spark):
    rnd, at = random.Random(6), lambda s: T0 + datetime.timedelta(seconds=s)
    spans = lambda n, most: [(rnd.randrange(4), i, a := rnd.randrange(500_000) // 60 * 60, a + rnd.randint(1, most) * 60) for i in range(n)]
    gaps, moves = spans(150, 4000), spans(25, 300)
    frame = lambda rows: spark.createDataFrame([(u, i, at(a), at(b)) for u, i, a, b in rows], "user_id long, hint_id long, start timestamp_ntz, end timestamp_ntz")
    got = {r["hint_id"] for r in intervals.without_overlap(frame(gaps), frame(moves), "hint_id").collect()}
    want = {i for u, i, a, b in gaps if not any(v == u and c < b and d > a for v, _, c, d in moves)}
    assert got == want and 0 < len(want) < 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_implied_moves_leave_out_what_was_measured(spark):
    rows = lambda name: QUERIES[name](spark, SF).select("user_id", "start", "end").collect()
    gaps, moves = more.d7(spark, SF).select("user_id", "start", "end").collect(), rows("D3_moves")
    want = [g for g in gaps if not any(m[0] == g[0] and m[1] < g[2] and m[2] > g[1] for m in moves)]
    assert sorted(rows("D7_implied_moves_unmeasured")) == sorted(rows("D7_implied_moves")) == sorted(want)
    assert len(want) < len(gaps)


def test_monthly_density_of_all_days(spark):
    rows = [(datetime.date(2024, 1, 3), 2, 5.0), (datetime.date(2024, 1, 9), 4, 0.0), (datetime.date(2024, 4, 1), 1, 1.0)]
    got = more.monthly_density(spark.createDataFrame(rows, "day date, places long, metres double")).collect()
    assert sorted((r["month"].month, r["weight"]) for r in got) == [(1, 7), (2, 0), (3, 0), (4, 2)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_monthly_density_counts_every_order(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    days = orders.selectExpr("to_date(o_orderdate) as day", "o_totalprice").groupBy("day").sum("o_totalprice").where("`sum(o_totalprice)` > 0").count()
    assert sum(r["weight"] for r in QUERIES["E12_monthly_weight"](spark, SF).collect()) == orders.count() + days
