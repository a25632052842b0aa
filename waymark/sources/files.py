"""Files before they are read: inventory, what kind they are, and how much there is to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.points import sample_evenly

#: Groups of formats by file ending; seconds that a photo takes.
FORMATS = {"jpeg": ("jpg", "jpeg"), "heic": ("heic", "heif"), "png": ("png",), "raw": ("dng", "arw", "cr2", "nef"), "video": ("mp4", "mov")}
PHOTO_S = 0.008
HEAD_BYTES = 65_536


def inventory_files(spark: SparkSession, path: str) -> DataFrame:
    """path, folder, kind (the ending), byte_size, content_hash of all files below ``path``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return f.select("path", folder.alias("folder"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("kind"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("content_hash"))


def directory_digests(files: DataFrame) -> DataFrame:
    """folder, files, byte_size, digest: a hash of its files' sorted hashes, the same in whatever order they were read."""
    return files.groupBy("folder").agg(F.count("*").alias("files"), F.sum("byte_size").alias("byte_size"), F.sha2(F.array_join(F.array_sort(F.collect_list("content_hash")), ""), 256).alias("digest"))


def format_group(kind: Column) -> Column:
    out = F.lit("other")
    for name, endings in FORMATS.items():
        out = F.when(F.lower(kind).isin(*endings), name).otherwise(out)
    return out


def prescan_profile(files: DataFrame, sample: int = 40) -> DataFrame:
    """source_id, files by format group (a map), share of positions in an even sample of ``sample`` files, what that makes of all, span of time, estimated seconds.

    files: source_id, file_id, kind, has_gps, ts.
    """
    g = files.withColumn("group_", format_group(F.col("kind")))
    n = g.groupBy("source_id", "group_").agg(F.count("*").alias("n")).groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("group_", "n")))).alias("files_by_group"), F.sum("n").alias("files"))
    some = sample_evenly(files, sample, ["source_id"], ["file_id"]).groupBy("source_id").agg(F.avg(F.col("has_gps").cast("int")).alias("gps_share"), F.count("*").alias("sampled"))
    t = files.groupBy("source_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    out = n.join(some, "source_id").join(t, "source_id")
    return out.withColumns({"estimated_with_gps": F.round(F.col("gps_share") * F.col("files")).cast("long"), "estimated_s": F.col("files") * PHOTO_S})


def sniff(name: Column, head: Column) -> Column:
    """struct(kind, confidence) of a file by its name and the text of its first bytes; null where nothing fits."""
    ends = lambda *e: F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*e)
    has = lambda p: F.contains(head, F.lit(p))
    json, bare = ends("json"), F.startswith(F.ltrim(head), F.lit("["))
    tests = [  # fixed values: what tells a kind, and how surely
        (json & has('"semanticSegments"'), "google_timeline", 0.95), (json & bare & (has('"startTime"') | has('"timelinePath"') | has('"visit"')), "google_timeline", 0.9),
        (json & has('"timelineObjects"'), "google_semantic", 0.95), (json & has('"locations"') & (has("latitudeE7") | has("timestampMs")), "google_records", 0.9),
        (ends("gpx", "xml") & F.contains(F.lower(head), F.lit("<gpx")), "gpx", 0.95), (ends("tcx", "xml") & has("TrainingCenterDatabase"), "tcx", 0.95),
        (F.substring(head, 9, 4) == ".FIT", "fit", 1.0), (ends("fit"), "fit", 0.6),
    ]
    best = F.array_max(F.filter(F.array(*[F.when(t, F.struct(F.lit(c).cast("double").alias("confidence"), F.lit(k).alias("kind"))) for t, k, c in tests]), lambda x: x.isNotNull()))
    return F.when(best.isNotNull(), F.struct(best["kind"].alias("kind"), best["confidence"].alias("confidence"))).otherwise(F.lit(None).cast("struct<kind: string, confidence: double>"))


def sniff_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files with the kind that fits best (path, kind, confidence), and those that none does, with a sample of their text."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.decode(F.substring("content", 1, HEAD_BYTES), "iso-8859-1")
    s = f.select("path", head.alias("head")).withColumn("s_", sniff(F.col("path"), F.col("head")))
    return s.where("s_ is not null").select("path", "s_.kind", "s_.confidence"), s.where("s_ is null").select("path", F.substring("head", 1, 200).alias("sample"))


def read_photo_meta(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """Tables of fields that were taken from photos (user_id, photo_id, gps_utc, local, offset_s, lat, lon, altitude_m, mtime), as Parquet, of local days ``first`` to ``last``; those without a time stay."""
    p = spark.read.parquet(path)
    day = F.coalesce(F.to_date("local"), F.to_date("gps_utc"))
    return p if first is None else p.where(day.isNull() | day.between(first, last))
