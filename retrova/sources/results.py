"""Experiment logs as JSON lines: an explicit schema, and the line each row stands in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPERIMENT = (
    "model string, chunker string, index string, k_chunks int, query_prefix string, rerank string, rerank_depth int, n_chunks long,"
    " truncated_frac double, search_p50_ms double, commit string, dirty boolean, metrics map<string,double>, `per_query_ndcg@10` map<string,double>"
)
BENCH = "n long, index string, recall double, p50_ms double, p99_ms double, qps double, scored double, build_s double, commit string, dirty boolean"


def read(spark: SparkSession, path: str, schema: str = EXPERIMENT) -> DataFrame:
    """Rows of a log with line_no, which grows along each file; blank lines are skipped."""
    text = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    rows = text.filter(F.trim("value") != "").select("line_no", F.from_json("value", schema).alias("r"))
    return rows.select("line_no", "r.*")


def per_query(rows: DataFrame, system) -> DataFrame:
    """(system, query_id, score) of the rows that hold per-query scores."""
    each = rows.filter(F.col("`per_query_ndcg@10`").isNotNull()).select(system.alias("system"), F.explode("`per_query_ndcg@10`").alias("query_id", "score"))
    return each
