"""Unbounded pings: duplicates dropped within a watermark, days recomputed batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waymark.functions.geo import haversine_m, point_dedup_key
from waymark.operators.stays import scan
from waymark.params import Params


def dedup_stream(pings: DataFrame, late: str = "2 days", keys: list[str] | None = None) -> DataFrame:
    """The first ping of each dedup key that arrives within ``late``; event time is ``ts``. Where the source names its pings, ``keys`` are these names, and no dedup key is made."""
    timed = pings.withColumn("event_time", F.col("ts").cast("timestamp"))
    if keys is None:
        timed = timed.withColumn("dedup_key", point_dedup_key(F.col("user_id"), F.col("ts"), F.col("lat"), F.col("lon")))
    return timed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(keys or ["user_id", "dedup_key"])


def hourly_altitude(pings: DataFrame, late: str = "2 hours") -> DataFrame:
    """The greatest altitude and the pings of each user and hour, once the hour is over."""
    timed = pings.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy("user_id", F.window("event_time", "1 hour")).agg(F.max("altitude_m").alias("altitude_m"), F.count("*").alias("pings"))


def sessions(pings: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Start, end and pings of each run of a user's pings without a gap of ``gap``."""
    timed = pings.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    got = timed.groupBy("user_id", F.session_window("event_time", gap)).agg(F.count("*").alias("pings"))
    return got.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "pings")


def each_affected_day(pings: DataFrame, recompute: Callable[[DataFrame], None], checkpoint: str):
    """Start a query that calls ``recompute`` with the (user_id, day) that each batch touches, one day to either side."""

    def one(batch: DataFrame, _: int) -> None:
        day = F.to_date("ts")
        recompute(batch.select("user_id", F.explode(F.sequence(F.date_sub(day, 1), F.date_add(day, 1))).alias("day")).distinct())

    return pings.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental(pings: DataFrame, derive: Callable[[DataFrame], DataFrame], folder: str, late_days: int = 2):
    """Start a query that keeps a derived table (user_id, start, end) up to date, batch by batch; ``derive`` makes it of pings.

    Under ``folder`` stand pings (in time, by batch), late (the others, by batch), derived (see
    ``incremental.keep``), progress (the newest event time after each batch) and the query's checkpoint. A ping is
    late if it is more than ``late_days`` behind the newest one of all earlier batches; it opens no day
    again. A batch that is run once more writes the same again, as it sees earlier batches only.
    """
    from waymark.operators.incremental import keep

    at = {name: f"{folder.rstrip('/')}/{name}" for name in ("pings", "late", "derived", "progress", "checkpoint")}

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            newest = None
            if number:
                newest = spark.read.parquet(at["progress"]).where(F.col("batch") < number).agg(F.max("newest")).first()[0]
            old = F.coalesce(F.col("ts") < F.lit(newest).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(late_days)), F.lit(False))
            batch.where(old).write.mode("overwrite").parquet(f"{at['late']}/batch={number}")
            batch.where(~old).write.mode("overwrite").parquet(f"{at['pings']}/batch={number}")
            after = batch.agg(F.max("ts").alias("newest")).select(F.greatest("newest", F.lit(newest).cast("timestamp_ntz")).alias("newest"))
            after.coalesce(1).write.mode("overwrite").parquet(f"{at['progress']}/batch={number}")
        finally:
            batch.unpersist()
        good = spark.read.schema(batch.schema).parquet(f"{at['pings']}/batch={number}")
        points = spark.read.schema(batch.schema).option("basePath", at["pings"]).parquet(at["pings"])
        if good.take(1):
            done = spark._jvm.org.apache.hadoop.fs.Path(at["derived"])
            first = not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
            keep(spark, at["derived"], good.select("user_id", "ts"), points, derive, derive(points.limit(0)), first)

    return pings.writeStream.foreachBatch(one).option("checkpointLocation", at["checkpoint"]).trigger(availableNow=True).start()


def fence_alerts(pings: DataFrame, fences: DataFrame) -> DataFrame:
    """user_id, fence_id, ts of pings in an enabled fence of their user: a join of the stream with a table."""
    f = fences.where("enabled").select("user_id", "fence_id", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"), "radius_m")
    return pings.join(f, "user_id").where(haversine_m(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon")) <= F.col("radius_m")).select("user_id", "fence_id", "ts")


def sliding_activity(pings: DataFrame, width: str = "1 day", step: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """The pings of each user in windows of ``width``, a new one every ``step``."""
    timed = pings.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy("user_id", F.window("event_time", width, step)).agg(F.count("*").alias("pings"))


STAYS = "user_id long, start timestamp, end timestamp, lat double, lon double, radius_m double, point_count int, inferred_s double"


class _OpenStays(StatefulProcessor):
    """A user's pings that no stay has settled, in order; a timer settles them when the user has been silent for too long."""

    def __init__(self, p: Params):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "us long, lat double, lon double")

    def _scanned(self, user: int, held: list[np.ndarray], final: bool) -> tuple[pd.DataFrame, int]:
        found, upto = scan(*held, self.p, final)
        made = [(user, held[0][a], held[0][b], lat, lon, r, b - a + 1, inferred) for a, b, lat, lon, r, inferred in found]
        out = pd.DataFrame(made, columns=[c.split()[0] for c in STAYS.split(", ")])
        for c in ("start", "end"):
            out[c] = pd.to_datetime(out[c].astype("int64"), unit="us")
        return out, upto

    def _held(self) -> list[np.ndarray]:
        rows = list(self.open.get()) if self.open.exists() else []
        return [np.array([r[i] for r in rows], kind) for i, kind in enumerate((np.int64, float, float))]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        known = len(held[0])
        for part in rows:
            us = part["event_time"].astype("datetime64[us]").astype("int64").to_numpy()
            held = [np.concatenate([a, b]) for a, b in zip(held, (us, part["lat"].to_numpy(), part["lon"].to_numpy()))]
        order = np.argsort(held[0], kind="stable")
        in_order = bool((order[:known] == np.arange(known)).all())
        held = [x[order] for x in held]
        out, upto = self._scanned(key[0], held, False)
        rest = list(zip(*(x[upto:].tolist() for x in held)))
        if upto == 0 and in_order and known:
            self.open.appendList(list(zip(*(x[known:].tolist() for x in held))))  # what is open only grows
        elif rest:
            self.open.put(rest)
        elif self.open.exists():
            self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.handle.registerTimer(max(rest[-1][0] // 1000 + self.p.longest_inferred_s * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, _ = self._scanned(key[0], self._held(), True)
        self.open.clear()
        yield out

    def close(self) -> None:
        pass


def online_stays(pings: DataFrame, p: Params, late: str = "2 hours") -> DataFrame:
    """Stays as they end: each user's open pings are a list in the state, and what a later ping settles leaves it.

    A stay ends when its user has moved on, or when by event time the user has been silent for
    longer than the longest stay that may be inferred, for which a timer stands. Pings that come later than
    ``late`` are dropped by the watermark; those in time are put in order with what is
    open, and one before what is settled already stands before the open ones. The state store must be RocksDB's.
    """
    timed = pings.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    rows = timed.select("user_id", "event_time", "lat", "lon").groupBy("user_id")
    return rows.transformWithStateInPandas(_OpenStays(p), STAYS, "Append", "eventTime")


#: What ``online_stays`` needs of a session.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
