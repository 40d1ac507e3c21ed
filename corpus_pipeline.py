"""A corpus pipeline over the operators of the subpackage llm: five filters, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir), and its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents; a changed text has its n_chars brought up to date.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrova.llm import decontam, langid, linededup, minhash, mixing
from retrova.llm._spark import cut, shared_folder, table
from retrova.llm.graph import few

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that was learnt; null texts and texts without a letter are `und` and go."""
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.filter_languages(_own(docs), model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages; documents of which no word is left go."""
    return linededup.filter_lines(_own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: five-word shingles, similarity of 0.8 or more.

    Rows that share an id stay or go together; of those that stay, equal rows become one and no text is lost.
    """
    rows = _own(docs)
    kept = cut(minhash.near_duplicates(rows).filter("kept and doc_id is not null").select(F.col("doc_id").alias("of")).distinct())
    again = few(rows.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"))
    stay = rows.join(kept, rows.doc_id == kept.of, "left_semi")
    several = stay.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.join(again, "doc_id", "left_anti").unionByName(several).unionByName(rows.filter("doc_id is null")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no window of a benchmark item."""
    return decontam.filter_clean(_own(docs), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many words of each (repeats counted)."""
    return mixing.op6_rows(docs).filter("taken > 0")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix)]
#: None of the stages but the last can be put in SQL; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
