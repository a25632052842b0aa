"""A corpus made ready for training: five stages over the documents.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of documents; the last returns what it has written.
Whole texts are read, however long. An empty table gives none, and further
columns, whatever their names, pass as they are (the last stage doesn't read them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import decontaminate, huffman, mixing, near, toxicity
from waymark.llm.common import scratch, table
from waymark.llm.fit import fold


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3, by a model learned from ``labels``.

    Null and empty texts score alike, as what has no terms; repeated rows stay or go together.
    """
    # Other columns go through under names that no score can clash with.
    aside = docs.toDF(*[c if c in ("doc_id", "text") else f"column_{i}_" for i, c in enumerate(docs.columns)])
    scored = toxicity.scores(aside, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return scored.where("score < 0.3").drop("score").toDF(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: one of all that have no words and equal texts, null as empty; of repeated rows one."""
    return near.without_near_duplicates(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no passage of the benchmark: null and empty texts have none; repeated rows stay or go together."""
    return decontaminate.without_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight takes them: a null source is one, and rows of a source with equal ids stand or fall together."""
    return mixing.mixed(spark, docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files of its ids: of a null or empty text the end id alone; repeated rows are written each."""
    folder = scratch(spark, "corpus")
    return huffman.read_files(spark, folder, huffman.store(spark, docs, folder)).withColumnRenamed("key", "doc_id")


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
    ("token ids", token_ids),
]

#: Toxicity is a trained model, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
