"""Operators against plain restatements of their rules, and how long they take."""

import datetime
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, text
from waymark.functions import time as times
from waymark.operators import anchors, commute, fusion, intervals, points, privacy, ranks, stays, tiles
from waymark.params import Params

T0 = datetime.datetime(2024, 1, 1)


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))


def at(s):
    return T0 + datetime.timedelta(seconds=s)


def test_asof_is_not_quadratic_and_after_is_later(spark):
    n = 40_000
    right = spark.range(n).select(F.lit(1).cast("long").alias("user_id"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).cast("timestamp_ntz").alias("ts"), "id")
    left = right.where("id % 400 = 0").select("user_id", "ts", F.col("id").alias("i"))
    t = time.time()
    got = intervals.asof_both(left, right, ["id"]).collect()
    assert time.time() - t < 20 and len(got) == 100
    assert all(r["before"]["id"] == r["i"] and r["after"]["id"] == r["i"] + 1 for r in got)


def test_an_hour_of_walking_takes_little_time():
    lat = 35.0 + np.arange(3600) * 1.26e-5
    t = time.time()
    found, upto = stays.scan(np.arange(3600) * 1_000_000, lat, np.full(3600, 139.0), Params())
    assert found == [] and upto == 3600 and time.time() - t < 2


def test_scan_in_parts_is_the_scan(spark):
    rnd = np.random.default_rng(3)
    ts = np.cumsum(rnd.choice([30, 60, 600, 5000, 100_000], 3000, p=[0.5, 0.3, 0.15, 0.04, 0.01])) * 1_000_000
    jump = rnd.random(3000) < 0.03
    lat = 35 + np.cumsum(np.where(jump, rnd.normal(0, 0.01, 3000), 0)) + rnd.normal(0, 3e-4, 3000)
    lon = np.full(3000, 139.0)
    whole, _ = stays.scan(ts, lat, lon, Params())
    parts, done, end = [], 0, 0
    while end < 3000:
        end = min(3000, end + 170)
        found, upto = stays.scan(ts[done:end], lat[done:end], lon[done:end], Params(), end == 3000)
        parts += [(a + done, b + done) for a, b, *_ in found]
        done += upto
    assert parts == [(a, b) for a, b, *_ in whole] and len(parts) > 20


def trace(n, seed):
    """A dense trace without jumps: walks and drives a step every 20 seconds between places of long and short stays."""
    rnd = np.random.default_rng(seed)
    ts, lat, lon, at, t = [], [], [], np.array([35.0, 139.0]), 1_700_000_000
    while len(ts) < n:
        for _ in range(int(rnd.integers(20, 200))):  # a stay, with a gap now and then
            t += int(rnd.choice([20, 60, 5000], p=[0.7, 0.295, 0.005]))
            ts.append(t), lat.append(at[0] + rnd.normal(0, 2e-4)), lon.append(at[1] + rnd.normal(0, 2e-4))
        way = rnd.normal(0, 1, 2) * rnd.choice([2.5e-4, 1e-3])
        for _ in range(int(rnd.integers(10, 80))):
            at, t = at + way, t + 20
            ts.append(t), lat.append(at[0]), lon.append(at[1])
    return ts[:n], lat[:n], lon[:n]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_stay_crosses_a_safe_cut(seed):
    ts, lat, lon = (np.array(x) for x in trace(3000, seed))
    ts = ts * 1_000_000
    cuts = np.flatnonzero(stays.safe_cuts(ts, lat, lon, Params()))
    whole, _ = stays.scan(ts, lat, lon, Params())
    assert len(cuts) > 100 and len(whole) > 10
    for c in cuts[:: max(1, len(cuts) // 40)]:
        before, _ = stays.scan(ts[:c], lat[:c], lon[:c], Params())
        after, _ = stays.scan(ts[c:], lat[c:], lon[c:], Params())
        assert [s[:2] for s in before] + [(s[0] + c, s[1] + c) for s in after] == [s[:2] for s in whole]


def test_long_traces_are_dealt_out_with_the_same_result(spark):
    rows = []
    for user in range(4):
        ts, lat, lon = trace(4000 if user < 2 else 150, user + 10)
        if user == 1:  # never leaves the place: no cut anywhere
            lat, lon = 35 + (np.array(lat) - 35) * 1e-6, 139 + (np.array(lon) - 139) * 1e-6
        rows += [(user, t, float(a), float(b), "gps" if i % 2 else None) for i, (t, a, b) in enumerate(zip(ts, lat, lon))]
    pings = spark.createDataFrame(rows, "user_id long, t long, lat double, lon double, source_kind string").select("user_id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "lat", "lon", F.lit(None).cast("double").alias("accuracy_m"), "source_kind")
    plain = sorted(map(repr, stays.cluster_stays(pings, Params()).collect()))
    assert sorted(map(repr, stays.cluster_stays(pings, Params(), most=300).collect())) == plain
    big = pings.select("user_id", points.micros(F.col("ts")).alias("us_"), "lat", "lon").where("user_id < 2")
    parts = {(r["user_id"], r["part"]): r["count"] for r in stays._dealt(big, 8000, Params(), 300).groupBy("user_id", "part").count().collect()}
    assert sum(u == 0 for u, _ in parts) > 8 and max(n for (u, _), n in parts.items() if u == 0) < 1500
    assert sum(u == 1 for u, _ in parts) == 1


def test_dbscan_is_that_of_the_plain_rule(spark):
    rnd, rows, eps = random.Random(8), [], 150.0
    for u in range(12):
        lat0, lon0 = rnd.choice([(35.0, 139.0), (60.0, 179.9995), (-45.0, -179.9999), (0.0, 10.0)])
        for i in range(rnd.randint(3, 60)):
            lon = lon0 + rnd.random() * 0.008
            rows.append((u, 1000 * u + i, at(rnd.randrange(10_000)), lat0 + rnd.random() * 0.008, (lon + 180) % 360 - 180))
    got = {r["id"]: r["anchor_id"] for r in anchors.dbscan(spark, spark.createDataFrame(rows, "user_id long, id long, start timestamp_ntz, lat double, lon double"), eps, 3).collect()}
    want = {}
    for u in range(12):
        v = sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1]))
        near = [[j for j, b in enumerate(v) if metres(a[3:], b[3:]) <= eps] for a in v]
        label = {}
        for i in range(len(v)):
            if i in label or len(near[i]) < 3:
                label.setdefault(i, i)
                continue
            todo = [i]
            while todo:
                j = todo.pop()
                if j in label and j != i:
                    continue
                label[j] = i
                if len(near[j]) >= 3:
                    todo += [k for k in near[j] if k not in label]
        for i, r in enumerate(v):
            want[r[1]] = v[label[i]][1]
    assert got == want and len(set(want.values())) < len(want)


def test_across_the_date_line(spark):
    p = spark.createDataFrame([(1, 1, 10.0, 179.9999), (1, 2, 10.0, -179.9999), (1, 3, 10.0, 0.0)], "user_id long, id long, lat double, lon double")
    assert [(r["a"], r["b"]) for r in intervals.eps_pairs(p, 150.0).collect()] == [(1, 2)]
    assert {r["id"] for r in p.where(geo.within_radius(F.col("lat"), F.col("lon"), 10.0, 179.9999, 100.0)).collect()} == {1, 2}


def test_duplicates_stay_in_a_join_on_time(spark):
    a = spark.createDataFrame([(1, T0)], "user_id long, l timestamp_ntz")
    b = spark.createDataFrame([(1, T0), (1, T0)], "user_id long, r timestamp_ntz")
    assert intervals.near_in_time(a, b, "l", "r", 300).count() == 2


def test_zones_that_are_and_are_not(spark):
    names = ["US/Eastern", "Japan", "Europe/Atlantis", "UTC+09:00", None, "UTC", "EST5EDT"] + times.ZONES
    got = spark.createDataFrame([(n, T0) for n in names], "z string, ts timestamp_ntz").select("z", times.to_local(F.col("ts"), F.col("z")).alias("t")).collect()
    hours = {r["z"]: (r["t"] - T0).total_seconds() / 3600 for r in got}
    assert hours["US/Eastern"] == -5 and hours["Japan"] == 9 and hours["Europe/Atlantis"] == 0 and hours["UTC+09:00"] == 9 and hours[None] == 0
    assert spark.range(1).select(times.offset_label(F.lit(0)).alias("x")).first()["x"] == "UTC"


def test_elevation_of_users_without_any(spark):
    d = spark.createDataFrame([(1, T0, None), (2, T0, 5.0), (2, at(1), None), (2, at(2), 9.0)], "user_id long, ts timestamp_ntz, altitude_m double")
    assert {r["user_id"]: r["gain_m"] for r in points.elevation_gain(d).collect()} == {1: None, 2: 4.0}


def test_titles_that_look_made(spark):
    rows = [("2024-01-02 a walk", True), ("Tokyo · 01-02", True), ("Grandma", False), (None, False)]
    got = spark.createDataFrame(rows, "t string, w boolean").select(text.looks_generated(F.col("t")).alias("g"), "w").collect()
    assert all(r["g"] == r["w"] for r in got)


def test_thinning_counts_from_the_last_kept_vertex(spark):
    line = [(35.0 + i * 3e-6, 139.0) for i in range(7)]  # a third of a metre each
    kept = [line[0]]
    for v in line[1:]:
        if metres(kept[-1], v) > 0.5:
            kept.append(v)
    d = spark.createDataFrame([([{"lat": a, "lon": o} for a, o in line],), ([{"lat": 1.0, "lon": 1.0}] * 3,)], "p array<struct<lat: double, lon: double>>")
    got = [r["k"] for r in d.select(fusion.thin_vertices(F.col("p")).alias("k")).collect()]
    assert [(p["lat"], p["lon"]) for p in got[0]] == kept and got[1] is None


# --- fences: the rules line by line, and the operator against them ------------------------------

DEGREE = math.radians(1) * geo.EARTH_RADIUS_M


def _inside(line: np.ndarray, fence: tuple[float, float, float]) -> np.ndarray:
    """For each segment of a line (lat, lon rows) the part of it that lies in the circle, from and to in 0 to 1; from 1 to 0 where none does."""
    lat, lon, r = fence
    # The plane around the centre shrinks and stretches a little; the circle is taken as much larger.
    r = r * (1 + 0.6 * r / geo.EARTH_RADIUS_M * abs(math.tan(math.radians(lat))) + 1e-6) + 0.05
    y = (line[:, 0] - lat) * DEGREE
    x = ((line[:, 1] - lon + 180) % 360 - 180) * DEGREE * math.cos(math.radians(lat))
    dx, dy = np.diff(x), np.diff(y)
    a, b, c = dx * dx + dy * dy, x[:-1] * dx + y[:-1] * dy, x[:-1] ** 2 + y[:-1] ** 2 - r * r
    root = b * b - a * c
    some, still = (a > 0) & (root > 0), (a == 0) & (c < 0)
    safe, s = np.where(a > 0, a, 1.0), np.sqrt(np.maximum(root, 0))
    t0, t1 = np.clip((-b - s) / safe, 0, 1), np.clip((-b + s) / safe, 0, 1)
    out = np.column_stack([np.where(some, t0, np.where(still, 0.0, 1.0)), np.where(some, t1, np.where(still, 1.0, 0.0))])
    return np.where((out[:, :1] < out[:, 1:]), out, [[1.0, 0.0]])


def plain_cut(line: np.ndarray, fences: list[tuple[float, float, float]]) -> list[tuple[np.ndarray, bool, bool]]:
    """The parts of a line outside of all circles (lat, lon, radius), and whether their first and last points are cuts."""
    spans = [_inside(line, f) for f in fences]
    parts: list[tuple[np.ndarray, bool, bool]] = []
    open_: list[np.ndarray] = [line[0]]
    cut_start, at_start = False, True
    for i in range(len(line) - 1):
        a, b = line[i], line[i + 1]
        within = sorted((s[i, 0], s[i, 1]) for s in spans if s[i, 0] < s[i, 1])
        u = 0.0
        for t0, t1 in within:
            if t0 > u:
                # Outside from u to t0.
                if not open_:
                    open_, cut_start = [a + (b - a) * u], True
                parts.append((np.array([*open_, a + (b - a) * t0]), cut_start, True))
                open_ = []
            elif open_ and t0 <= u == 0.0:
                # A vertex on or in the circle: what came before ends there.
                if len(open_) > 1 or not at_start:
                    parts.append((np.array(open_), cut_start, True))
                open_ = []
            u = max(u, t1)
        if u < 1.0:
            if not open_:
                open_, cut_start = [a + (b - a) * u], True
            open_.append(b)
        at_start = False
    if len(open_) > 1:
        parts.append((np.array(open_), cut_start, False))
    return [p for p in parts if len(p[0]) > 1]


def _lengths(line: np.ndarray) -> np.ndarray:
    p, q = np.radians(line[:-1]), np.radians(line[1:])
    h = np.sin((q[:, 0] - p[:, 0]) / 2) ** 2 + np.cos(p[:, 0]) * np.cos(q[:, 0]) * np.sin((q[:, 1] - p[:, 1]) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _trimmed(line: np.ndarray, head: float, tail: float) -> np.ndarray:
    """A line without its first ``head`` and last ``tail`` metres."""
    along = np.concatenate([[0.0], np.cumsum(_lengths(line))])
    a, b = head, along[-1] - tail
    at = lambda d: np.array([np.interp(d, along, line[:, 0]), np.interp(d, along, line[:, 1])])
    keep = (along > a) & (along < b)
    return np.vstack([at(a), line[keep], at(b)])


def plain_jittered(parts: list[tuple[np.ndarray, bool, bool]], radius: float, seed: int) -> list[np.ndarray]:
    """Parts with their cut ends moved back by up to privacy.JITTER of the radius; those of less than a metre, or that this uses up, go."""
    out = []
    for i, (line, first, last) in enumerate(parts, 1):
        length = float(_lengths(line).sum())
        head = radius * privacy.JITTER * privacy.unit(seed, 2 * i) if first else 0.0
        tail = radius * privacy.JITTER * privacy.unit(seed, 2 * i + 1) if last else 0.0
        if length >= 1 and head + tail < length:
            out.append(_trimmed(line, head, tail) if head or tail else line)
    return out


def _snapped(line: np.ndarray, grid_m: float) -> np.ndarray:
    step = grid_m / 111_320.0
    snapped = np.rint(line / step) * step
    new = np.append(True, (np.diff(snapped, axis=0) != 0).any(axis=1))
    return snapped[new] if new.sum() > 1 else line


def fenced_lines(lines: list[np.ndarray], action: str, fences: list[dict], jitter: bool = True, grid_m: float = privacy.GRID_M) -> list[np.ndarray]:
    """Lines after one action by the union of some fences; without ``jitter`` the ends stay where they were cut, which nobody else may see."""
    circles = [(f["lat"], f["lon"], f["radius_m"]) for f in fences]
    if action == "blur":
        hit = [any((s[:, 0] < s[:, 1]).any() for s in (_inside(x, c) for c in circles)) for x in lines]
        if not any(hit):
            return lines
        lines = [_snapped(x, grid_m) for x in lines]
    parts = [p for x in lines for p in plain_cut(x, circles)]
    if not jitter:
        return [p[0] for p in parts]
    return plain_jittered(parts, max(f["radius_m"] for f in fences), min(f["jitter_seed"] for f in fences))


def lines_and_fences(seed, n=60):
    rnd, lines, fences = random.Random(seed), [], []
    for u in range(n):
        lat, lon = rnd.uniform(-65, 65), rnd.uniform(-179, 179)
        for k in range(rnd.randint(1, 3)):
            fences.append((u, 10 * u + k, lat + rnd.uniform(-0.006, 0.006), lon + rnd.uniform(-0.006, 0.006), rnd.choice([200.0, 500.0, 900.0]), 42 + u, rnd.random() > 0.1))
        for k in range(3):
            a, o = lat + rnd.uniform(-0.03, 0.03), lon + rnd.uniform(-0.03, 0.03)
            line = []
            for _ in range(rnd.randint(2, 40)):
                a, o = a + rnd.uniform(-0.004, 0.004), o + rnd.uniform(-0.004, 0.004)
                line.append({"lat": a, "lon": o})
            lines.append((u, 100 * u + k, line))
        lines.append((u, 100 * u + 9, [{"lat": lat - 0.05, "lon": lon}, {"lat": lat + 0.05, "lon": lon}]))
    return lines, fences


LINES, FENCES = "user_id long, geom_id long, points array<struct<lat: double, lon: double>>", "user_id long, fence_id long, lat double, lon double, radius_m double, jitter_seed long, enabled boolean"


@pytest.mark.parametrize("policy", ["remove", "blur", "each"])
def test_nothing_of_a_line_lies_in_a_fence(spark, policy):
    lines, fences = lines_and_fences(5)
    g, f = spark.createDataFrame(lines, LINES), spark.createDataFrame(fences, FENCES)
    run = {"remove": lambda: privacy.fence_remove(g, f), "blur": lambda: privacy.fence_blur(g, f), "each": lambda: privacy.apply_policies(g, f, f.select("fence_id", F.lit("remove").alias("action")))}[policy]
    got = run().collect()
    assert len(got) == len(lines) and [sorted(map(str, x)) for x in (got, run().collect())][0] == sorted(map(str, got))
    of = {}
    for u, _, lat, lon, r, _, enabled in fences:
        if enabled:
            of.setdefault(u, []).append((lat, lon, r))
    inside = 0
    for r in got:
        for part in r["parts"]:
            xy = [(p["lat"], p["lon"]) for p in part]
            for a, b in zip(xy, xy[1:]):
                for t in np.linspace(0, 1, 21):
                    q = (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
                    inside += any(metres(q, c[:2]) < c[2] - 1 for c in of.get(r["user_id"], []))
    assert inside == 0


SPOTS = pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))
CIRCLES = pa.list_(pa.struct([("fence_id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("radius_m", pa.float64()), ("jitter_seed", pa.int64()), ("action", pa.string())]))


@pytest.mark.parametrize("steps", ["remove", "blur", "each"])
@pytest.mark.parametrize("jitter", [True, False])
def test_a_batch_of_lines_is_cut_as_line_by_line(steps, jitter):
    for seed in range(6):
        lines, fences = lines_and_fences(seed, 25)
        rnd, of = random.Random(seed), {}
        for u, i, lat, lon, r, s, _ in fences:
            of.setdefault(u, []).append({"fence_id": i, "lat": lat, "lon": lon, "radius_m": r, "jitter_seed": s + i % 3, "action": rnd.choice(["remove", "blur", "other"])})
        points = [p for _, _, p in lines] + [None, [], lines[0][2][:1], [{"lat": f["lat"], "lon": f["lon"]} for f in of[0][:1]] * 3]
        own = [of[u] for u, _, _ in lines] + [of[0], of[1], of[0], of[0]]
        got = privacy.fence_batch(pa.array(points, SPOTS), pa.array(own, CIRCLES), steps, jitter).to_pylist()
        for p, f, parts in zip(points, own, got):
            want = [np.array([[v["lat"], v["lon"]] for v in p])] if p and len(p) > 1 else []
            for action, some in ([(x["action"], [x]) for x in f] if steps == "each" else [(steps, f)]):
                if want and action in ("remove", "blur"):
                    want = fenced_lines(want, action, some, jitter)
            assert [len(x) for x in parts] == [len(x) for x in want]
            for x, y in zip(parts, want):
                assert np.allclose([[v["lat"], v["lon"]] for v in x], y, atol=1e-8)


def test_fences_at_the_date_line_leak_nothing(spark):
    rnd, lines, fences = random.Random(8), [], []
    for u in range(30):
        lon = rnd.choice([179.99, -179.99, 180.0, 179.9999])
        fences.append((u, u, 10.0, lon, 500.0, u, True))
        a, o, line = 10.0 + rnd.uniform(-0.02, 0.02), lon - 0.03, []
        for _ in range(30):
            a, o = a + rnd.uniform(-0.002, 0.002), o + rnd.uniform(0, 0.004)
            line.append({"lat": a, "lon": (o + 180) % 360 - 180})
        lines += [(u, u, line), (u, 100 + u, [{"lat": 10.0, "lon": 179.5}, {"lat": 10.0, "lon": -179.5}]), (u, 200 + u, [{"lat": 10.0, "lon": -179.9}, {"lat": 10.001, "lon": 179.9}])]
    g, f = spark.createDataFrame(lines, LINES), spark.createDataFrame(fences, FENCES)
    got = {r["geom_id"]: r["parts"] for r in privacy.fence_remove(g, f).collect()}
    for u, i, line in lines:
        centre = (10.0, fences[u][3])
        assert all(-180 <= v["lon"] <= 180 for part in got[i] for v in part)
        for part in got[i]:
            for a, b in zip(part, part[1:]):
                turn = (b["lon"] - a["lon"] + 180) % 360 - 180
                assert all(metres((a["lat"] + (b["lat"] - a["lat"]) * t, a["lon"] + turn * t), centre) > 499 for t in np.linspace(0, 1, 400))
        if i >= 100:
            assert len(got[i]) == 2  # the way goes on behind the fence


def test_parts_are_what_lies_outside():
    rnd = random.Random(11)
    for _ in range(300):
        line = np.array([[35 + rnd.uniform(-0.01, 0.01), 139 + rnd.uniform(-0.01, 0.01)] for _ in range(rnd.randint(2, 8))])
        circles = [(35 + rnd.uniform(-0.008, 0.008), 139 + rnd.uniform(-0.008, 0.008), rnd.choice([150.0, 400.0])) for _ in range(rnd.randint(1, 3))]
        parts = plain_cut(line, circles)
        kept = sum(_lengths(p).sum() for p, _, _ in parts)
        outside = 0.0
        for a, b in zip(line, line[1:]):
            t = (np.arange(4000) + 0.5) / 4000
            q = a + (b - a) * t[:, None]
            free = np.all([[metres(x, c[:2]) > c[2] for x in q[::40]] for c in circles], axis=0)
            outside += free.mean() * _lengths(np.array([a, b])).sum()
        assert abs(kept - outside) < 0.02 * _lengths(line).sum() + 5


def test_cut_ends_spread_and_original_ends_stay():
    line = np.array([[39.9042, 116.4074 - 0.05 + 0.0005 * i] for i in range(201)])
    ends = []
    for seed in range(20):
        parts = fenced_lines([line], "remove", [{"lat": 39.9042, "lon": 116.4074, "radius_m": 500.0, "jitter_seed": seed}])
        assert len(parts) == 2 and tuple(parts[0][0]) == tuple(line[0]) and tuple(parts[1][-1]) == tuple(line[-1])
        ends.append(metres(parts[0][-1], (39.9042, 116.4074)))
    assert min(ends) >= 499 and max(ends) - min(ends) > 20


def test_undecided_fences_are_refused(spark):
    hits = spark.createDataFrame([(1, 7, "place", 1), (1, 8, "track", 2)], "user_id long, fence_id long, kind string, id long")
    with pytest.raises(PermissionError, match="8"):
        privacy.require_decisions(hits, spark.createDataFrame([(7, "blur")], "fence_id long, action string"))


def test_fences_of_one_kind_merge_and_tiers_do_not(spark):
    rows = [(1, 1, 35.0, 139.0, 10, "home", "confirmed"), (1, 2, 35.001, 139.0, 30, "home", "confirmed"), (1, 3, 35.0005, 139.0, 5, "home", "inferred"), (1, 4, 35.0005, 139.0, 5, "work", "confirmed")]
    a = spark.createDataFrame([(*r, T0, at(9)) for r in rows], "user_id long, anchor_id long, lat double, lon double, visit_count long, kind string, kind_source string, first_visit timestamp_ntz, last_visit timestamp_ntz")
    f = spark.createDataFrame([(1, 35.0005, 139.0)], "user_id long, lat double, lon double")
    got = sorted((r["kind"], r["confidence"], r["visit_count"], round(r["lat"], 6)) for r in anchors.suggest_fences(a, f).collect())
    assert got == [("home", "confirmed", 40, 35.00075), ("home", "inferred", 5, 35.0005), ("work", "confirmed", 5, 35.0005)]


def flat(lat, lon, n):
    return (lon + 180) / 360 * n, (0.5 - math.asinh(math.tan(math.radians(lat))) / (2 * math.pi)) * n


def clipped_length(a, b, box):
    """Length of the segment in the box by Liang and Barsky's rule; None if it doesn't meet it."""
    begin, end = 0.0, 1.0
    for axis in (0, 1):
        d = b[axis] - a[axis]
        for edge, side in ((box[axis], -1), (box[axis + 2], 1)):
            q = (edge - a[axis]) * side
            if d == 0 and q < 0:
                return None
            if d * side > 0:
                end = min(end, q / (d * side))
            elif d * side < 0:
                begin = max(begin, q / (d * side))
    return (end - begin) * math.hypot(b[0] - a[0], b[1] - a[1]) if begin <= end else None


def test_lines_in_tiles(spark):
    """Cover and clips against all tiles of the box, one by one; a diagonal is in as many tiles as it is long."""
    rnd = random.Random(4)
    lines = [(1, [(35.0, 139.0), (35.5, 139.5)]), (2, [(0.0013, -0.001), (-0.001, 0.001)]), (3, [(35.0, 139.0)]), (4, []), (5, None), (6, [(10.0, 20.0)] * 3), (7, [(51.0, 0.1), (51.0, 0.4)])]
    lines += [(10 + i, [(40 + rnd.random() / 20, -74 + rnd.random() / 20) for _ in range(rnd.randint(2, 9))]) for i in range(12)]
    z, n, m = 14, 1 << 14, 64 / 4096
    df = spark.createDataFrame([(i, [{"lat": a, "lon": b} for a, b in p] if p is not None else None, "x") for i, p in lines], "id int, points array<struct<lat: double, lon: double>>, x_ string")
    cover = {(r["id"], r["x"], r["y"]) for r in tiles.tiles_of_lines(df, z).collect()}
    clips = {(r["id"], r["x"], r["y"]): r["parts"] for r in tiles.clip_to_tiles(df, z).collect()}
    for i, p in lines:
        at = [flat(a, b, n) for a, b in p or []]
        own, own_clips = {k[1:] for k in cover if k[0] == i}, {k[1:]: v for k, v in clips.items() if k[0] == i}
        if not at:
            assert not own and not own_clips
            continue
        if len(at) == 1:
            at = at * 2
        xs, ys = [math.floor(x) for x, _ in at], [math.floor(y) for _, y in at]
        want, want_clips = set(), {}
        for x in range(min(xs), max(xs) + 1):
            for y in range(min(ys), max(ys) + 1):
                if any(clipped_length(a, b, (x, y, x + 1, y + 1)) is not None for a, b in zip(at, at[1:])):
                    want.add((x, y))
                got = [v for a, b in zip(at, at[1:]) if (v := clipped_length(a, b, (x - m, y - m, x + 1 + m, y + 1 + m))) is not None]
                if got:
                    want_clips[(x, y)] = sum(got) * 4096
        assert own == want
        assert set(own_clips) == set(want_clips)
        for k, parts in own_clips.items():
            assert sum(math.hypot(b["x"] - a["x"], b["y"] - a["y"]) for p_ in parts for a, b in zip(p_, p_[1:])) == pytest.approx(want_clips[k], abs=1e-3)
            assert all(-64.001 <= v["x"] <= 4160.001 and -64.001 <= v["y"] <= 4160.001 for p_ in parts for v in p_)
    diagonal = sum(k[0] == 1 for k in cover)
    assert 40 < diagonal < 120  # the box has over 600
    shapes = tiles.tile_features(df, z).collect()
    assert shapes and all(len(p_) > 1 and all(-64 <= v["x"] <= 4160 and -64 <= v["y"] <= 4160 for v in p_) for r in shapes for p_ in r["shape"])


@pytest.mark.parametrize("block", [2000, 3])
def test_likeness_of_ways_is_that_of_all_pairs(spark, monkeypatch, block):
    """The upper median over all pairs of legs, however the ways are cut into blocks."""
    monkeypatch.setattr(commute, "BLOCK", block)
    rnd = random.Random(5)
    legs, ways = [], [[(35 + rnd.random() / 10, 139 + rnd.random() / 10) for _ in range(12)] for _ in range(4)]
    for user in (1, 2, None):
        for to in range(6):
            for _ in range([0, 1, 2, 7, 30, 31][to]):
                way = [p for p in rnd.choice(ways) if rnd.random() < 0.8] if rnd.random() < 0.9 else []
                legs.append((user, 1, None if to == 3 else to, [{"lat": a, "lon": b} for a, b in way]))
    df = spark.createDataFrame(legs, "user_id long, from_anchor long, to_anchor long, points array<struct<lat: double, lon: double>>")
    got = {tuple(r)[:3]: r["path_jaccard"] for r in commute.path_similarity(df).collect() if r["user_id"] is not None and r["to_anchor"] is not None}
    cells = {i: {(math.ceil((p["lon"] + 180) / 360 * 32768), math.ceil((p["lat"] + 90) / 180 * 32768)) for p in leg[3]} for i, leg in enumerate(legs)}
    for od in {leg[:3] for leg in legs if leg[0] is not None and leg[2] is not None}:
        own = [cells[i] for i, leg in enumerate(legs) if leg[:3] == od and leg[3]]
        scores = sorted(len(a & b) / len(a | b) for i, a in enumerate(own) for b in own[i + 1 :])
        assert got[od] == (scores[len(scores) // 2] if len(own) > 1 else float(len(own)))


def test_geohash_at_every_precision(spark):
    """Against bits interleaved one by one."""
    rnd = random.Random(6)
    spots = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(40)] + [(-90.0, -180.0), (90.0, 180.0), (0.0, 0.0)]
    df = spark.createDataFrame(spots, "lat double, lon double")
    got = df.select("lat", "lon", *[geo.geohash(F.col("lat"), F.col("lon"), n).alias(f"g{n}") for n in range(1, 13)]).collect()
    for r in got:
        for n in range(1, 13):
            i, j = max(0, math.ceil((r["lon"] + 180) / 360 * (1 << (5 * n + 1) // 2)) - 1), max(0, math.ceil((r["lat"] + 90) / 180 * (1 << 5 * n // 2)) - 1)
            bits = [(i >> ((5 * n + 1) // 2 - 1 - k // 2) if k % 2 == 0 else j >> (5 * n // 2 - 1 - k // 2)) & 1 for k in range(5 * n)]
            assert r[f"g{n}"] == "".join(geo.GEOHASH_ALPHABET[int("".join(map(str, bits[5 * p : 5 * p + 5])), 2)] for p in range(n))


def test_values_at_ranks_of_groups_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ACCURACY", 100)
    rnd, groups = random.Random(9), {}
    for key, n in (("a", 1), ("b", 2), ("c", 99), ("d", 3000), (None, 2501), ("e", 0)):
        groups[key] = [rnd.choice([rnd.gauss(0, 100), 5.0, float(rnd.randrange(4))]) for _ in range(n)]
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    wanted = {"low": ranks.nearest(0.0), "p95": ranks.nearest(0.95), "top": ranks.nearest(1.0), "mid": ranks.UPPER_MEDIAN}
    got = {r["k"]: tuple(r)[1:] for r in ranks.at_ranks(df, ["k"], "v", wanted).collect()}
    for k, vs in groups.items():
        s = sorted(vs)
        assert got[k] == ((s[0], s[round(0.95 * (len(s) - 1))], s[-1], s[len(s) // 2]) if s else (None,) * 4)
