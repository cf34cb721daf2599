"""Corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, piece encoding.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents, the
last one doc_id, n_tokens, ids and round_trip. ``run`` stores each stage's rows as Parquet in the folder all executors share
and starts the next one from the files, so a lost executor costs tasks of one stage.

Rows without an id or text are judged as the operators say: null text counts as empty. Empty documents get and keep whatever
the classifier says of them. ``n_chars`` follows the text where lines were dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsonde.llm import bagminhash, knn, linededup, pieces, queries, tiling
from gridsonde.llm.shared import reachable, table, written

ORACLE_SQL = None  # nearest neighbours, signatures and pieces are beyond SQL; tests compare with brute force


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote does not reject; learned from the documents at hand and their labels."""
    reachable(spark)
    model = queries.quality_model(docs, table(spark, sf_dir, "labels"))
    return knn.score(docs, model).where("predicted = 1").select(docs.columns)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold."""
    reachable(spark)
    index = linededup.LineIndex.empty(spark).insert(docs)
    kept = index.drop_lines(docs, into="__kept")
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumns(new).select(docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return bagminhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    reachable(spark)
    return tiling.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return pieces.encoded_documents(docs, queries.MODEL_PATH)


STAGES = [("quality classifier", good_documents), ("line dedup", without_common_lines), ("near-dedup", one_of_near_duplicates),
          ("decontamination", decontaminated), ("piece encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
