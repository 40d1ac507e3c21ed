"""Retrieval data sets as files: corpus and queries as JSON lines, judgments as tab-separated values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _last(rows: DataFrame, *key: str) -> DataFrame:
    """The last row of each key in the order of the files: their path and the place in them."""
    order = F.struct(F.col("_file"), F.col("_at"))
    window = Window.partitionBy(*key).orderBy(order.desc())
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n", "_file", "_at")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows grow along a file within and across its splits, so the generated id orders them as the file does."""
    return rows.withColumn("_file", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """documents(doc_id, title, text); a missing title is empty; of rows with one id the last counts."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    return _last(_placed(rows).select(F.col("_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), "text", "_file", "_at"), "doc_id")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """qrels(query_id, doc_id, grade) with grade > 0; each file's first line is a header; of repeated pairs the last counts."""
    rows = spark.read.schema("query_id string, doc_id string, grade int").option("sep", "\t").option("header", True).option("enforceSchema", True).csv(path)
    return _last(_placed(rows.filter("grade > 0")), "query_id", "doc_id")


def queries(spark: SparkSession, path: str, judgments: DataFrame) -> DataFrame:
    """queries(query_id, text) that have a judgment."""
    rows = spark.read.schema("_id string, text string").json(path)
    each = _last(_placed(rows).select(F.col("_id").alias("query_id"), "text", "_file", "_at"), "query_id")
    return each.join(judgments.select("query_id").distinct(), "query_id", "left_semi")


def load(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, qrels) of a folder with corpus.jsonl, queries.jsonl and qrels/<split>.tsv. Nothing is downloaded."""
    judgments = qrels(spark, f"{folder}/qrels/{split}.tsv")
    return corpus(spark, f"{folder}/corpus.jsonl"), queries(spark, f"{folder}/queries.jsonl", judgments), judgments
