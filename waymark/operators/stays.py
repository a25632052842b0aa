"""Stays: where a user is, and what is left over as movement.

A stay grows from a ping while all its pings lie within the radius of their
spherical mean; a long gap ends it only if its ends lie apart or it is longer
than the longest stay that may be inferred. The scan is sequential, so each
user's pings are sorted within a partition and stream through it in Arrow
batches. Two neighbours more than twice the radius apart, or parted by such a gap,
are never in one stay, and the scan starts anew behind them; where the pings of
the shortest stay already spread too far, array operations settle that none begins there.
What is held in memory is the stay that is open, and no more.

A user with more pings than one task should have is dealt out over several:
sorted ranges of the trace are cut where no stay can go across (``safe_cuts``),
and what stands in a range before its first cut goes to the range before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import EARTH_RADIUS_M, haversine_m
from waymark.functions.time import local_date, local_midnight_utc
from waymark.operators.graph import written
from waymark.operators.points import micros, seconds_between
from waymark.params import Params

_STAY = "user_id long, start long, end long, lat double, lon double, radius_m double, point_count int, inferred_s double, inferred_ratio double, source_kinds array<string>"
SCANNED = f"is_stay boolean, {_STAY}"
#: Pings of an unfinished segment that are held before it is scanned as far as it goes.
HELD = 100_000
#: Pings of one user that a task takes; traces of more are cut.
MOST = 2_000_000


def _metres(lat, lon, lats, lons):
    p, q = np.radians(lat), np.radians(lats)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _apart(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """``_metres`` of plain numbers."""
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


def scan(ts: np.ndarray, lat: np.ndarray, lon: np.ndarray, p: Params, final: bool = True) -> tuple[list[tuple], int]:
    """Stays (first, last, lat, lon, radius, inferred seconds) of one user's sorted pings, and how many pings are settled; all others of these are moving. ``ts`` in microseconds.

    Unless ``final``, more pings may follow, and what they could change isn't settled.
    Whether all members lie within the radius is settled exactly only when a
    bound no longer proves it: the farthest known distance, plus how far the
    mean has moved since, plus the new member's own distance.
    """
    n = len(ts)
    if not n:
        return [], 0
    gap = np.diff(ts) / 1e6
    step = _metres(lat[:-1], lon[:-1], lat[1:], lon[1:])
    cut = ((gap > p.gap_s) & ((step >= p.radius_m) | (gap > p.longest_inferred_s))) | (step > 2 * p.radius_m)
    # The segment of a ping ends before segment_end; from reach on, a stay that begins with it lasts long enough.
    edges = np.append(np.flatnonzero(cut) + 1, n)
    segment_end = edges[np.searchsorted(edges, np.arange(n), side="right")]
    reach = np.searchsorted(ts, ts + int(p.dwell_s * 1e6), side="left")
    if p.min_points > 1:
        reach = np.maximum(reach, np.arange(n) + p.min_points - 1)
    begins = reach < segment_end
    safe, far = np.minimum(reach, n - 1), 2 * p.radius_m
    for share in (1.0, 0.5, 0.25, 0.75):
        some = np.arange(n) + ((safe - np.arange(n)) * share).astype(np.int64)
        begins &= (_metres(lat, lon, lat[some], lon[some]) <= far) & (_metres(lat[safe], lon[safe], lat[some], lon[some]) <= far)
    open_ = reach >= n if not final else np.zeros(n, bool)
    open_ &= segment_end == n
    candidates = np.flatnonzero(begins | open_)
    rad_lat, rad_lon = np.radians(lat), np.radians(lon)
    xs, ys, zs = (np.cos(rad_lat) * np.cos(rad_lon)).tolist(), (np.cos(rad_lat) * np.sin(rad_lon)).tolist(), np.sin(rad_lat).tolist()
    lats, lons, gaps = lat.tolist(), lon.tolist(), gap.tolist()
    radius, out, i = p.radius_m, [], 0
    while True:
        at = int(np.searchsorted(candidates, i))
        if at == len(candidates):
            return out, n
        i = int(candidates[at])
        if open_[i] and not begins[i]:
            return out, i
        end, j, inferred, farthest = int(segment_end[i]), i, 0.0, 0.0
        x, y, z, c_lat, c_lon = xs[i], ys[i], zs[i], lats[i], lons[i]
        while j + 1 < end:
            k = j + 1
            nx, ny, nz = x + xs[k], y + ys[k], z + zs[k]
            m_lat, m_lon = math.degrees(math.atan2(nz, math.hypot(nx, ny))), math.degrees(math.atan2(ny, nx))
            bound = max(farthest + _apart(c_lat, c_lon, m_lat, m_lon), _apart(m_lat, m_lon, lats[k], lons[k]))
            if bound > radius:
                bound = float(_metres(m_lat, m_lon, lat[i : k + 1], lon[i : k + 1]).max())
                if bound > radius:
                    break
            if gaps[j] > p.gap_s:
                inferred += gaps[j]
            x, y, z, c_lat, c_lon, farthest, j = nx, ny, nz, m_lat, m_lon, bound, k
        if j + 1 == end == n and not final:
            return out, i
        if (ts[j] - ts[i]) / 1e6 >= p.dwell_s and j - i + 1 >= p.min_points:
            out.append((i, j, c_lat, c_lon, float(_metres(c_lat, c_lon, lat[i : j + 1], lon[i : j + 1]).max()), inferred))
            i = j + 1
        else:
            i += 1


def safe_cuts(ts: np.ndarray, lat: np.ndarray, lon: np.ndarray, p: Params) -> np.ndarray:
    """For one user's sorted pings, whether no stay holds both a ping and the one before it, whatever else precedes or follows.

    That is so across a jump of more than twice the radius or a gap that ends
    stays. It is also so while the user moves on: members of a stay lie within
    twice the radius of each other, so a stay with the ping lies between the
    nearest pings before and after that are farther off; if these leave less than
    the shortest stay, there is none. The scan always starts anew at such a ping.
    """
    n, far = len(ts), 2 * p.radius_m
    out = np.zeros(n, bool)
    if n < 2:
        return out
    gap, step = np.diff(ts) / 1e6, _metres(lat[:-1], lon[:-1], lat[1:], lon[1:])
    out[1:] = ((gap > p.gap_s) & ((step >= p.radius_m) | (gap > p.longest_inferred_s))) | (step > far)
    for share in (0.45, 0.2, 0.7):
        before = np.searchsorted(ts, ts - int(share * p.dwell_s * 1e6), side="left") - 1
        after = np.searchsorted(ts, ts + int((0.9 - share) * p.dwell_s * 1e6), side="right")
        ok = np.flatnonzero((before >= 0) & (after < n) & ~out)
        ok = ok[(_metres(lat[ok], lon[ok], lat[before[ok]], lon[before[ok]]) > far) & (_metres(lat[ok], lon[ok], lat[after[ok]], lon[after[ok]]) > far)]
        out[ok] = True
    return out


def _found(user: int, ts: np.ndarray, lat: np.ndarray, lon: np.ndarray, kinds: np.ndarray, stays: list[tuple], upto: int) -> pa.RecordBatch:
    """Stays and moving pings of the first ``upto`` pings, in the columns of SCANNED."""
    moving = np.ones(upto, bool)
    for a, b, *_ in stays:
        moving[a : b + 1] = False
    at, m = np.flatnonzero(moving), len(stays)
    first, last = np.array([s[0] for s in stays], np.int64), np.array([s[1] for s in stays], np.int64)
    some = lambda i, rest: np.concatenate([np.array([s[i] for s in stays], float), rest])
    inferred = some(5, np.zeros(len(at)))
    start, end = np.concatenate([ts[first], ts[at]]), np.concatenate([ts[last], ts[at]])
    spent = np.maximum((end - start) / 1e6, 1e-9)
    every = [np.unique(kinds[a : b + 1]).tolist() for a, b in zip(first, last)] + [[k] for k in kinds[at].tolist()]
    arrays = [pa.array(np.arange(m + len(at)) < m), pa.array(np.full(m + len(at), user)), pa.array(start), pa.array(end), pa.array(some(2, lat[at])), pa.array(some(3, lon[at])), pa.array(some(4, np.zeros(len(at)))), pa.array(np.concatenate([last - first + 1, np.ones(len(at), np.int64)]).astype(np.int32)), pa.array(inferred), pa.array(inferred / spent), pa.array([[k for k in e if k] for e in every], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCANNED.split(", ")])


def runs_of_users(batches: Iterator[pa.RecordBatch], *also: str) -> Iterator[tuple[int, pa.RecordBatch, bool]]:
    """(user, rows, whether they are the last of the run) of batches sorted by user_id, their first column, and the columns ``also``; a run has equal ones."""
    held: tuple[int, pa.RecordBatch] | None = None
    key: tuple = ()
    for batch in batches:
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in (0, *also)]
        changes = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        edges = [0, *(np.flatnonzero(changes) + 1).tolist(), len(batch)] if len(batch) else [0]
        for a, b in zip(edges, edges[1:]):
            now = tuple(k[a] for k in keys)
            if held is not None:
                yield *held, key != now
            held, key = (int(now[0]), batch.slice(a, b - a)), now
    if held is not None:
        yield *held, True


def by_user(rows: DataFrame, *order: str) -> DataFrame:
    """All rows of a user in one partition, in ``order``: one shuffle, one sort that spills."""
    return rows.repartition("user_id").sortWithinPartitions("user_id", *order)


def _heads(p: Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of sorted ranges with the range's number, and whether they stand before the first safe cut of the range's first user."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept, wait, searching, first_user = TaskContext.get().partitionId(), [], 0, True, None

        def marked(rows: pa.RecordBatch, cut: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(rows), part)), pa.array(np.arange(len(rows)) < cut)], names=[*rows.schema.names, "part", "head"])

        for user, rows, last in runs_of_users(batches):
            first_user = user if first_user is None else first_user
            if not searching or user != first_user:
                yield marked(rows, 0)
                continue
            kept.append(rows)
            if last or sum(map(len, kept)) >= wait:
                held = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                at = [held.column(i).to_numpy(zero_copy_only=False) for i in range(1, 4)]
                cuts = np.flatnonzero(safe_cuts(*at, p))
                if len(cuts) or last:
                    yield marked(held, int(cuts[0]) if len(cuts) else len(held))
                    kept, searching = [], False
                wait = 2 * len(held)

    return run


def _dealt(big: DataFrame, n: int, p: Params, most: int, *tie: str) -> DataFrame:
    """Rows of long traces with ``part``: the sorted range whose task scans them."""
    spark, order = big.sparkSession, ["user_id", "us_", *tie]
    ranges = big.repartitionByRange(max(2, -(-n // most)), *order).sortWithinPartitions(*order)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in big.schema)
    marked = written(spark, ranges.mapInArrow(_heads(p), f"{types}, part long, head boolean"), "ranges")
    # A row for each range and user in it.
    parts = marked.groupBy(F.col("user_id").alias("user_"), F.col("part").alias("part_")).agg(F.bool_or(~F.col("head")).alias("body"))
    earlier = Window.partitionBy("user_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    own = F.last(F.when(F.col("body"), F.col("part_")), ignorenulls=True).over(earlier)
    # Without a cut anywhere before, the trace's first range has the rows.
    parts = parts.withColumn("owner", F.coalesce(own, F.min("part_").over(Window.partitionBy("user_"))))
    both = marked.join(parts, (F.col("user_id") == F.col("user_")) & (F.col("part") == F.col("part_")))
    return both.withColumn("part", F.when(F.col("head"), F.col("owner")).otherwise(F.col("part"))).drop("user_", "part_", "body", "owner", "head")


def cluster_stays(points: DataFrame, p: Params, *tie: str, most: int = MOST) -> DataFrame:
    """Stays and moving pings: user_id, is_stay, start, end, lat, lon, radius_m, point_count, inferred_s, inferred_ratio, source_kinds.

    Users of more than ``most`` pings are dealt out over tasks of about so many,
    as far as their traces have safe cuts; the rest go by user. The result is the same.
    """
    points = points.where(F.col("accuracy_m").isNull() | (F.col("accuracy_m") <= p.accuracy_max_m))
    kind = F.col("source_kind") if "source_kind" in points.columns else F.lit("")
    rows = points.select("user_id", micros(F.col("ts")).alias("us_"), "lat", "lon", F.coalesce(kind, F.lit("")).alias("kind_"), *tie)

    def run(batches: Iterator[pa.RecordBatch], *also: str) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        wait = HELD
        for user, piece, last in runs_of_users(batches, *also):
            new = [piece.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)]
            kept = new if kept is None else [np.concatenate([a, b]) for a, b in zip(kept, new)]
            if last or len(kept[0]) >= wait:
                stays, upto = scan(kept[0], kept[1], kept[2], p, last)
                if upto:
                    yield _found(user, *kept, stays, upto)
                kept = None if last else [a[upto:] for a in kept]
                # What stays open is scanned again only when there is as much more of it.
                wait = HELD if last else max(HELD, 2 * len(kept[0]))

    counts = written(points.sparkSession, rows.groupBy(F.col("user_id").alias("user_")).agg(F.count("*").alias("n_")).where(F.col("n_") > most), "long-traces")
    n = counts.agg(F.sum("n_")).first()[0]
    if not n:
        got = by_user(rows, "us_", *tie).mapInArrow(run, SCANNED)
    else:
        same = F.col("user_id") == F.col("user_")
        big = _dealt(rows.join(counts.drop("n_"), same, "left_semi"), n, p, most, *tie)
        dealt = big.repartition("user_id", "part").sortWithinPartitions("user_id", "part", "us_", *tie)
        got = by_user(rows.join(counts, same, "left_anti"), "us_", *tie).mapInArrow(run, SCANNED).unionByName(dealt.mapInArrow(lambda batches: run(batches, "part"), SCANNED))
    time = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz").alias(c)
    return got.select("user_id", "is_stay", time("start"), time("end"), "lat", "lon", "radius_m", "point_count", "inferred_s", "inferred_ratio", "source_kinds")


def merge_adjacent_stays(stays: DataFrame, p: Params) -> DataFrame:
    """Consecutive stays within the longest inferred stay and the radius become one, centres weighted by pings; end, radius and inferred ratio are the greatest, source kinds those of either.

    The centre moves as stays join, so it is a fold over each user's stays in
    order; it holds one stay.
    """
    columns = [c.split()[0] for c in _STAY.split(", ")]
    rows = by_user(stays.select("user_id", micros(F.col("start")).alias("start"), micros(F.col("end")).alias("end"), *columns[3:]), "start", "end", "lat", "lon")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev: list | None = None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                s = list(row)
                if prev and prev[0] == s[0] and (s[1] - prev[2]) / 1e6 <= p.longest_inferred_s and _apart(prev[3], prev[4], s[3], s[4]) < p.radius_m:
                    n = prev[6] + s[6]
                    w = prev[6] / (n or 1)
                    prev = [s[0], prev[1], max(prev[2], s[2]), prev[3] * w + s[3] * (1 - w), prev[4] * w + s[4] * (1 - w), max(prev[5], s[5]), n, prev[7] + s[7], max(prev[8], s[8]), sorted({*prev[9], *s[9]})]
                else:
                    if prev:
                        out.append(prev)
                    prev = s
            if out:
                yield _rows(out, batch.schema)
        if prev:
            yield _rows([prev], batch.schema)

    def _rows(out: list[list], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema.names)

    time = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz").alias(c)
    return rows.mapInArrow(run, _STAY).select("user_id", time("start"), time("end"), *columns[3:])


def split_at_midnight(stays: DataFrame) -> DataFrame:
    """Pieces of stays (with tz_name), one for each local day, with local_date; no time is lost."""
    tz = F.col("tz_name")
    days = F.explode(F.sequence(local_date(F.col("start"), tz), local_date(F.col("end"), tz))).alias("local_date")
    pieces = stays.select("*", days)
    begin, end = local_midnight_utc(F.col("local_date"), tz), local_midnight_utc(F.date_add("local_date", 1), tz)
    cut = pieces.withColumns({"piece_start": F.greatest("start", begin), "piece_end": F.least("end", end)})
    return cut.where("piece_start < piece_end or start = end").drop("start", "end").withColumnsRenamed({"piece_start": "start", "piece_end": "end"})


def path_length(path: Column) -> Column:
    """Metres along an array of structs with lat and lon."""
    at = lambda i: F.get(path, i)
    steps = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: haversine_m(at(i - 1)["lat"], at(i - 1)["lon"], at(i)["lat"], at(i)["lon"]))
    return F.when(F.size(path) < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, d: a + d))


def neighbour_stays(runs: DataFrame, stays: DataFrame) -> DataFrame:
    """Runs (user_id, start, end) with ``from_``, the last stay that ended before the start, and ``to_``, the first that began after the end (structs of ts, lat, lon)."""
    from waymark.operators.intervals import asof_both

    tick = F.expr("interval 1 microsecond")
    ends = stays.select("user_id", F.col("end").alias("ts"), "lat", "lon")
    starts = stays.select("user_id", F.col("start").alias("ts"), "lat", "lon")
    # At or before the start, and at or after the end: strictly later than just before it.
    before = asof_both(runs.withColumn("ts", F.col("start")), ends, ["lat", "lon"]).withColumnRenamed("before", "from_").drop("after", "ts")
    after = asof_both(before.withColumn("ts", F.col("end") - tick), starts, ["lat", "lon"])
    return after.withColumnRenamed("after", "to_").drop("before", "ts")


def build_moves(moving: DataFrame, stays: DataFrame, p: Params) -> DataFrame:
    """Runs of moving pings (user_id, ts, lat, lon), joined to the stays before and after, of enough pings and metres."""
    from waymark.operators.points import split_by_gap

    runs = split_by_gap(moving, p.gap_s)
    spans = runs.groupBy("user_id", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_")).where(F.col("n_") >= p.move_min_points)
    # Only the ends of a run are looked up; its path is attached afterwards.
    ends = neighbour_stays(spans.drop("n_"), stays)
    paths = runs.groupBy("user_id", "run").agg(F.array_sort(F.collect_list(F.struct("ts", "lat", "lon"))).alias("pings"))
    both = ends.join(paths, ["user_id", "run"])
    spot = lambda c: F.when(F.col(c).isNotNull(), F.array(F.struct(F.col(f"{c}.lat").alias("lat"), F.col(f"{c}.lon").alias("lon")))).otherwise(F.array())
    path = F.concat(spot("from_"), F.transform("pings", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))), spot("to_"))
    return both.withColumn("path", path).withColumn("distance_m", path_length(F.col("path"))).where(F.col("distance_m") >= p.move_min_m).select(
        "user_id", "start", "end", "path", "distance_m", F.greatest(F.lit(1), F.floor(seconds_between(F.col("start"), F.col("end")))).cast("long").alias("duration_s"))
