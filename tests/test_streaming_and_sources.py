import datetime
import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.operators import incremental
from waymark.sources import json_split, timeline, tracks
from waymark.streaming import pings as stream

T = datetime.datetime(2024, 3, 1, 10)
KIND = "user_id long, ts timestamp_ntz, lat double, lon double, altitude_m double"


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(1, T, 35.0, 139.0, 5.0), (1, T, 35.0, 139.0, 5.0), (1, T + datetime.timedelta(minutes=1), 35.0, 139.0, 9.0), (2, T, 35.0, 139.0, None), (1, T + datetime.timedelta(hours=30), 35.0, 139.0, 1.0)]
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(tmp_path / "in"))
    return tmp_path


def drained(spark, df, folder, name):
    q = df.writeStream.format("parquet").option("path", str(folder / name)).option("checkpointLocation", str(folder / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(folder / name)).collect()


def test_streams(spark, folder):
    source = spark.readStream.schema(KIND).parquet(str(folder / "in"))
    assert len(drained(spark, stream.dedup_stream(source), folder, "dedup")) == 4
    hours = drained(spark, stream.hourly_altitude(source), folder, "hours")
    assert ({(r["user_id"], r["altitude_m"], r["pings"]) for r in hours}) == {(1, 9.0, 3), (2, None, 1)}
    days = []
    stream.each_affected_day(source, lambda d: days.extend(d.collect()), str(folder / "days")).awaitTermination()
    assert len([d for d in days if d["user_id"] == 1]) == 4 and len([d for d in days if d["user_id"] == 2]) == 3


def ping_rows(seed):
    rnd, rows = random.Random(seed), []
    for user in range(3):
        t = T
        for _ in range(300):
            t += datetime.timedelta(minutes=rnd.choice([5, 20, 300, 1500]))
            rows.append((user, t, 35.0 + rnd.choice([0, 0, 0, 1]) * rnd.random(), 139.0, 1.0))
    return sorted(rows, key=lambda r: r[1])


def spans_of(pings):
    """Derived rows that may go over days: runs of pings without six hours' gap."""
    w = Window.partitionBy("user_id").orderBy("ts")
    new = F.coalesce((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(w).cast("timestamp")) > 6 * 3600).cast("int"), F.lit(0))
    return pings.withColumn("run", F.sum(new).over(w)).groupBy("user_id", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("pings")).drop("run")


@pytest.mark.parametrize("n", [1, 7])
def test_kept_tables_are_the_same_in_any_number_of_batches(spark, tmp_path, n):
    """Batches come by time, each with some stragglers of the one before, over a restart each."""
    rows = ping_rows(1)
    batch = [min(n - 1, i * n // len(rows) + (i % 9 == 0)) for i in range(len(rows))]
    for b in range(n):
        spark.createDataFrame([r for r, of in zip(rows, batch) if of == b], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
        stream.incremental(source, spans_of, str(tmp_path / "kept"), late_days=400).awaitTermination()
    got = incremental.read_kept(spark, str(tmp_path / "kept/derived"), ["user_id", "start", "end", "pings"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spans_of(spark.createDataFrame(rows, KIND)).select("user_id", "start", "end", "pings").collect()))
    assert spark.read.parquet(str(tmp_path / "kept/late")).count() == 0


def test_late_pings_open_no_day(spark, tmp_path):
    rows = ping_rows(2)
    for part in ([r for i, r in enumerate(rows) if i > 5], rows[:6]):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.incremental(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), spans_of, str(tmp_path / "kept"), late_days=3).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "kept/late")).count() == 6
    assert spark.read.parquet(str(tmp_path / "kept/pings")).count() == len(rows) - 6


def test_rows_and_windows_meet_by_length(spark):
    rnd = random.Random(3)
    day = lambda n: T + datetime.timedelta(days=n, minutes=rnd.randint(-900, 900))
    rows = [(u, i, *sorted((day(a := rnd.randint(0, 400)), day(a + rnd.choice([0, 0, 1, 2, 5, 40, 300]))))) for u in range(3) for i in range(150)]
    whole = lambda n: datetime.datetime(2024, 3, 1) + datetime.timedelta(days=n)
    spans = [(u, whole(a), whole(a + rnd.choice([1, 2, 30]))) for u in range(2) for a in range(0, 400, 67)]
    r = spark.createDataFrame(rows, "user_id long, i long, start timestamp_ntz, end timestamp_ntz")
    s = spark.createDataFrame(spans, "user_id long, from_ timestamp_ntz, to_ timestamp_ntz")
    for end in ("end", "start"):
        want = {(u, i) for u, i, a, b in rows for v, x, y in spans if u == v and a < y and (b if end == "end" else a) >= x}
        assert {(g["user_id"], g["i"]) for g in incremental._overlapping(r, s, "start", end, "left_semi").collect()} == want
        assert {(g["user_id"], g["i"]) for g in incremental._overlapping(r, s, "start", end, "left_anti").collect()} == {x[:2] for x in rows} - want


def test_timeline_records(spark, tmp_path):
    records = [
        {"startTime": "2024-03-01T10:00:00+09:00", "endTime": "2024-03-01T11:00:00+09:00", "visit": {"hierarchyLevel": 0, "topCandidate": {"semanticType": "Home", "placeLocation": {"latLng": "35.1°, 139.2°"}}}},
        {"startTime": "2024-03-01T10:00:00Z", "endTime": "2024-03-01T11:00:00Z", "visit": {"topCandidate": {"semanticType": "Searched Address", "placeLocation": {"latLng": "35.1°, 139.2°"}}}},
        {"startTime": "2024-03-01T10:00:00Z", "endTime": "2024-03-01T11:00:00Z", "activity": {"start": {"latLng": "35.1°, 139.2°"}, "end": {"latLng": "geo:35.2,139.2"}, "distanceMeters": 0, "topCandidate": {"type": "IN_BUS"}}},
        {"startTime": "2024-03-01T10:00:00Z", "endTime": "2024-03-01T11:00:00Z", "timelinePath": [{"point": "35.1°, 139.2°", "durationMinutesOffsetFromStartTime": 7}, {"point": "0, 0", "durationMinutesOffsetFromStartTime": 8}]},
        {"startTime": "2024-03-01T10:00:00Z", "endTime": "2024-03-01T11:00:00Z", "timelineMemory": {"distanceFromOriginKms": 3}},
    ]
    for name, data in (("bare", records), ("wrapped", {"semanticSegments": records})):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
        r = timeline.with_kind(timeline.read_timeline(spark, str(tmp_path / f"{name}.json")), strict=True)
        assert sorted(x["kind"] for x in r.collect()) == ["activity", "memory", "path", "visit", "visit"]
        hints, skipped = timeline.visits_to_hints(r)
        assert [(x["start"], x["semantic_type"]) for x in hints.collect()] == [(datetime.datetime(2024, 3, 1, 1), "Home")]
        assert [tuple(x) for x in skipped.collect()] == [("searched address", 1)]
        assert [(x["distance_m"], x["mode"], len(x["points"])) for x in timeline.activities_to_hints(r).collect()] == [(None, "transit", 2)]
        assert [x["ts"] for x in timeline.paths_to_points(r).collect()] == [datetime.datetime(2024, 3, 1, 10, 7)]
    odd = spark.createDataFrame([("x",)], "startTime string").selectExpr("from_json('{\"startTime\": \"x\"}', '" + timeline.RECORD + "') r").select("r.*")
    with pytest.raises(Exception, match="unknown record"):
        timeline.with_kind(odd, strict=True).collect()


def odd_record(rnd, i):
    text = lambda: "".join(rnd.choice('ab{}[]"\\,: \u00e9') for _ in range(rnd.randint(0, 12)))
    return {"id": i, text() + "k": text(), "list": [{"a": text()} for _ in range(rnd.randint(0, 3))], "deep": {"x": {"y": [text(), {}]}}}


@pytest.mark.parametrize(("block", "shape"), [(401, "array"), (401, "object"), (301, "several"), (5000, "object"), (5000, "empty")])
def test_json_records_of_any_split(spark, tmp_path, block, shape):
    """Whatever bytes a task's block begins with, the records are those of the whole value."""
    rnd = random.Random(block)
    files = {}
    for f in range(2):
        records = [odd_record(rnd, 1000 * f + i) for i in range(0 if shape == "empty" else 25)]
        dump = lambda v: json.dumps(v, ensure_ascii=False, indent=rnd.choice([None, 1]))  # noqa: B023, E731
        if shape in ("array", "empty"):
            text = dump(records)
        elif shape == "object":
            text = dump({"before": [{"id": -1}], "settings": {"a": {"semanticSegments": [{"id": -2}]}}, "semanticSegments": records, "after": [[{"id": -3}], {"b": 1}]})
        else:
            text = "\n".join(json.dumps({"semanticSegments": records[i : i + 7], "x": [{"id": -4}]}, ensure_ascii=False) for i in range(0, 25, 7))
        (tmp_path / f"f{f}.json").write_text(text, encoding="utf-8")
        files[f"f{f}.json"] = records
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        got = json_split.json_records(spark, str(tmp_path / "*.json"), "semanticSegments").collect()
        tasks = json_split._blocks(spark, str(tmp_path / "*.json")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert block == 5000 or tasks > 8
    for name, want in files.items():
        own = sorted((json.loads(r["text"]) for r in got if r["file"].endswith(name)), key=lambda r: r["id"])
        assert own == want


def test_files_without_a_position_are_named(spark, tmp_path):
    point = "<Trackpoint><Time>2024-03-01T10:00:0{}Z</Time>{}</Trackpoint>"
    at = "<Position><LatitudeDegrees>35.1</LatitudeDegrees><LongitudeDegrees>139.2</LongitudeDegrees></Position>"
    body = lambda *p: '<TrainingCenterDatabase><Activities><Activity Sport="Biking"><Lap><Track>' + "".join(point.format(i, x) for i, x in enumerate(p)) + "</Track></Lap></Activity></Activities></TrainingCenterDatabase>"
    for name, text in (("good one", body(at, at)), ("indoor", body("", "")), ("empty", "<TrainingCenterDatabase/>")):
        (tmp_path / f"{name}.tcx").write_text(text)
    read = tracks.read_tcx(spark, str(tmp_path))
    assert [(r["mode"], r["mode_source"], r["mode_confidence"]) for r in read["tracks"].collect()] == [("bike", "declared", 0.95)]
    with pytest.raises(ValueError, match="empty.tcx.*indoor.tcx") as e:
        tracks.check_positions(spark, str(tmp_path), read)
    assert "good" not in str(e.value)
