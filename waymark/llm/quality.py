"""Quality by compression: a Zstandard dictionary of good and one of bad text.

Both dictionaries are trained on pieces of labelled documents. All pieces of a text are
compressed with each and with none, each afresh, so that what a dictionary saves is in proportion to the text; the differences of the sizes, normalised by the text's size and by
that without a dictionary, are turned into a probability by a logistic calibration on labelled
documents that trained no dictionary. Scoring is one pass over the texts;
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import table
from waymark.llm.fit import Logistic, fold, labelled_sample

#: Bounds of the training sample: documents, bytes of text of each label (of pieces of all texts, by their hash). Bytes of a piece.
BOUND, TRAIN_BYTES, PIECE_BYTES = 12_000, 48 << 20, 2048
DICTIONARY_BYTES, LEVEL = 112 << 10, 3
FEATURES = 6


def pieces_of(text: str) -> list[bytes]:
    """The whole text, cut into what dictionaries are trained on and applied to."""
    data = text.encode()
    return [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]


def train_dictionaries(sample: DataFrame, train_bytes: int = TRAIN_BYTES) -> dict[int, bytes]:
    """A dictionary of each label; of texts too few to train one, all of them are it."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            got = [(y, p) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in pieces_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in got], pa.int32()), pa.array([p for _, p in got], pa.binary())], ["label", "piece"])

    def train(one: pd.DataFrame) -> pd.DataFrame:
        some = sorted(one["piece"])
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, some, k=512, d=8).as_bytes()
        except zstandard.ZstdError:
            made = b"".join(some)
        return pd.DataFrame({"label": [int(one["label"].iloc[0])], "made": [made]})

    distinct = sample.select("text", "label").dropDuplicates()
    pieces = distinct.mapInArrow(cut, "label int, piece binary")
    most = distinct.groupBy("label").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > train_bytes:
        pieces = pieces.where(F.pmod(F.xxhash64("piece"), F.lit(1 << 20)) < int(train_bytes / most * (1 << 20)))
    got = pieces.groupBy("label").applyInPandas(train, "label int, made binary").collect()
    return {r["label"]: bytes(r["made"]) for r in got}


class Sizes:
    """Features of texts from their compressed sizes."""

    def __init__(self, made: dict[int, bytes]):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False}
        self.press = [zstandard.ZstdCompressor(**plain)]
        for y in (0, 1):
            if made.get(y):
                d = zstandard.ZstdCompressionDict(made[y])
                d.precompute_compress(level=LEVEL)
                self.press.append(zstandard.ZstdCompressor(**plain, dict_data=d))
            else:
                self.press.append(self.press[0])

    def of(self, text: str) -> list[float]:
        """The difference of the two sizes by the text's, by its root and by the size without a dictionary; what either dictionary saves of that; and what they are measured by, how far the text shrinks without one."""
        pieces = pieces_of(text) or [b""]
        c, b, g = (sum(len(p.compress(x)) for x in pieces) for p in self.press)
        n = max(sum(map(len, pieces)), 1)
        return [(b - g) / n, (b - g) / n**0.5, (b - g) / c, (c - g) / c, (c - b) / c, c / n]


def features(docs: DataFrame, made: dict[int, bytes], keep: list[str]) -> DataFrame:
    """``keep`` and f, the features of ``text``."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(made)
        for batch in rows:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                f = [sizes.of(t or "") for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(f, pa.list_(pa.float64()))], [*keep, "f"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, f array<double>")


def scores(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", key: str = "doc_id", bound: int = BOUND) -> DataFrame:
    """``key`` and score (0 to 1) of every row of ``docs``, learned from ``label`` of the rows of ``labels`` that ``allowed`` lets in.

    Whole texts are scored; null and empty ones get the score of the empty
    text. Repeated rows score alike. With no labels, or one kind only, all
    texts get the smoothed share of label 1. Other columns aren't read.
    """
    sample = labelled_sample(docs, labels, label, allowed, bound, key)
    half = F.pmod(F.xxhash64(F.col(key), F.lit("half")), F.lit(2))
    made = train_dictionaries(sample.where(half == 0))
    rest = features(sample.where(half == 1), made, ["label"]).toPandas()
    model = Logistic(np.array(rest["f"].tolist()).reshape(len(rest), FEATURES), rest["label"].to_numpy())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(made)
        for batch in rows:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                f = np.array([sizes.of(t or "") for t in part.column(1).to_pylist()]).reshape(-1, FEATURES)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(f))], ["key", "score"])

    return docs.select(F.col(key), "text").mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return got.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
