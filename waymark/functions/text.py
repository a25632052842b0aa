"""Labels, titles and travel modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of activity types, and the travel mode of each.
ACTIVITY_MODES = {
    "walking": "walk", "on foot": "walk", "hiking": "walk", "running": "run", "cycling": "bike",
    "in passenger vehicle": "car", "in vehicle": "car", "motorcycling": "car",
    "in bus": "transit", "in train": "transit", "in subway": "transit", "in tram": "transit", "in ferry": "transit",
    "flying": "flight", "still": "unknown", "unknown": "unknown", "unknown activity type": "unknown",
}


def map_activity_type(kind: Column) -> Column:
    """Mode of a declared activity, in any case, with spaces or underscores; else unknown."""
    name = F.trim(F.replace(F.lower(kind), F.lit("_"), F.lit(" ")))
    table = F.create_map(*[F.lit(x) for pair in ACTIVITY_MODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit("unknown"))


def text_search(text: Column, q: str) -> Column:
    """Contained in any case; the query's own % and _ are plain characters."""
    return F.contains(F.lower(text), F.lower(F.lit(q)))


def label(name: Column, geo_name: Column, city: Column) -> Column:
    return F.coalesce(name, geo_name, city)


def make_title(day: Column, countries: Column, city: Column, commute: Column) -> Column:
    """Of a trip: two countries, else the main city, else a commute, else the date."""
    return (
        F.when(F.size(countries) >= 2, F.concat(F.get(countries, F.lit(0)), F.lit(" → "), F.element_at(countries, -1), F.lit(" · "), F.date_format(day, "MM-dd")))
        .when(city.isNotNull(), F.concat(city, F.lit(" · "), F.date_format(day, "MM-dd")))
        .when(commute, F.concat(F.lit("Commute · "), F.date_format(day, "MM-dd")))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )


def looks_generated(title: Column) -> Column:
    """It begins with four digits or has a dot between spaces, so no one has written it by hand."""
    return F.coalesce(title.rlike(r"^\d{4}") | F.contains(title, F.lit(" · ")), F.lit(False))


def retitle(title: Column, made: Column, stamp: Column) -> Column:
    """``made`` in place of a bare date or of a title that ends with the day's ``stamp`` (MM-dd); any other title stays."""
    return F.when(made.isNotNull() & (title.rlike(r"^\d{4}-\d{2}-\d{2}$") | F.endswith(title, stamp)), made).otherwise(title)


#: Parts of what a file says its track is, and the travel mode of each group; the first that occurs counts.
DECLARED_WORDS = (
    (("hik", "walk", "foot", "trek", "徒步", "步行"), "walk"),
    (("run", "jog", "跑步"), "run"),
    (("cycl", "bike", "biking", "ride", "骑行", "自行车"), "bike"),
    (("driv", "car", "auto", "驾车", "汽车"), "car"),
    (("train", "bus", "subway", "transit", "地铁", "公交"), "transit"),
    (("fly", "flight", "plane", "飞行"), "flight"),
)


def declared_mode(kind: Column) -> Column:
    """Mode of a declared kind of track; null where no part is known."""
    text = F.lower(F.trim(kind))
    out = F.lit(None).cast("string")
    for parts, mode in reversed(DECLARED_WORDS):
        out = F.when(text.rlike("|".join(parts)), F.lit(mode)).otherwise(out)
    return out


def infer_mode(median: Column, p95: Column, metres: Column, straight: Column, altitude: Column) -> Column:
    """struct(mode, confidence, is_drift) of a movement's speeds in m/s; the first rule that holds."""
    rules = [  # fixed values: speeds, mode, confidence
        ((median < 2.0) & (p95 < 3.5), "walk", 0.9),
        (median.between(2.0, 4.0) & (median < 4.0) & (p95 < 6.5), "run", 0.8),
        ((median >= 2.5) & (median < 8.5) & (p95 < 14), "bike", 0.75),
        ((median >= 8.5) & (median < 33), "car", 0.5),
        ((median >= 33) & (median < 55), "transit", 0.6),
        ((median >= 55) & (straight > 0.9) & (metres > 100_000) & (altitude > 3000), "flight", 0.95),
        ((median >= 55) & (straight > 0.9) & (metres > 100_000), "transit", 0.6),
    ]
    made = lambda mode, sure, drift: F.struct(F.lit(mode).alias("mode"), F.lit(sure).cast("double").alias("confidence"), F.lit(drift).alias("is_drift"))
    out = F.when(median.isNull() | p95.isNull(), made("unknown", None, False)).when((median < 0.3) & (p95 < 1.0), made("unknown", None, True))
    for holds, mode, sure in rules:
        out = out.when(holds, made(mode, sure, False))
    return out.otherwise(made("unknown", None, False))


def with_stats(rows: DataFrame, fields: dict[str, str], column: str = "stats") -> DataFrame:
    """``rows`` with their JSON text of statistics as a struct of these fields and types; what a row's text lacks is null."""
    return rows.withColumn(column, F.from_json(column, ", ".join(f"`{k}` {t}" for k, t in fields.items())))


def with_stat(stats: Column, key: str, value: Column) -> Column:
    """The struct with one field set, new or not."""
    return stats.withField(key, value)
