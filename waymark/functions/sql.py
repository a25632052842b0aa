"""Functions for users of SQL: the same expressions by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from waymark.functions.geo import EARTH_RADIUS_M, GEOHASH_ALPHABET
from waymark.functions.time import ZONES


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Temporary SQL functions haversine_m, geohash, local_date and infer_mode; they are expressions, so Catalyst sees through them."""
    zone = f"CASE WHEN tz IN ({', '.join(repr(z) for z in ZONES)}) OR tz RLIKE '^UTC[+-](0[0-9]|1[0-4]):[0-5][0-9]$' THEN tz ELSE 'UTC' END"
    bits = "transform(sequence(0, 5 * p - 1), k -> CASE WHEN k % 2 = 0 THEN shiftright(greatest(0L, CAST(ceil((lon + 180D) / 360D * shiftleft(1L, (5 * p + 1) div 2)) AS BIGINT) - 1), CAST((5 * p + 1) div 2 - 1 - k div 2 AS INT)) ELSE shiftright(greatest(0L, CAST(ceil((lat + 90D) / 180D * shiftleft(1L, 5 * p div 2)) AS BIGINT) - 1), CAST(5 * p div 2 - 1 - k div 2 AS INT)) END % 2)"
    letter = f"substring('{GEOHASH_ALPHABET}', CAST(aggregate(slice(bits, 5 * c + 1, 5), 0L, (a, b) -> a * 2 + b) AS INT) + 1, 1)"
    made = {
        "haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": f"{2 * EARTH_RADIUS_M}D * asin(least(1D, sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))",
        "geohash(lat DOUBLE, lon DOUBLE, p INT) RETURNS STRING": f"(SELECT array_join(transform(sequence(0, p - 1), c -> {letter}), '') FROM (SELECT {bits} AS bits))",
        "local_date(ts TIMESTAMP_NTZ, tz STRING) RETURNS DATE": f"to_date(convert_timezone('UTC', {zone}, ts))",
        "infer_mode(median DOUBLE, p95 DOUBLE, metres DOUBLE, straight DOUBLE, altitude DOUBLE) RETURNS STRING": (
            "CASE WHEN median IS NULL OR p95 IS NULL OR (median < 0.3 AND p95 < 1) THEN 'unknown' WHEN median < 2 AND p95 < 3.5 THEN 'walk' WHEN median >= 2 AND median < 4 AND p95 < 6.5 THEN 'run' "
            "WHEN median >= 2.5 AND median < 8.5 AND p95 < 14 THEN 'bike' WHEN median >= 8.5 AND median < 33 THEN 'car' WHEN median >= 33 AND median < 55 THEN 'transit' "
            "WHEN median >= 55 AND straight > 0.9 AND metres > 100000 THEN CASE WHEN altitude > 3000 THEN 'flight' ELSE 'transit' END ELSE 'unknown' END"),
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in made]
