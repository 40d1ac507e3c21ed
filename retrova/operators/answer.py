"""Grounded answers: prompts over numbered sources, and checked citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

NO_SOURCES = "No documents matched the question."


def prompts(sources: DataFrame) -> DataFrame:
    """(question_id, prompt) of sources(question_id, question, n, title, text), numbered by n from 1."""
    each = F.transform(F.sort_array(F.collect_list(F.struct("n", "title", "text"))), lambda s: F.struct(s["title"].alias("title"), s["text"].alias("text")))
    grouped = sources.groupBy("question_id").agg(F.first("question").alias("question"), each.alias("sources"))
    return grouped.select("question_id", X.build_prompt(F.col("question"), F.col("sources")).alias("prompt"))


def citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(question_id, at, number, doc_id) of the numbers that answers(question_id, text) cite, repeats dropped.

    `at` orders them by first mention; doc_id is null for a number that no source(question_id, n, doc_id) has.
    """
    each = answers.select("question_id", F.posexplode(X.citation_numbers("text")).alias("pos", "number"))
    first = each.groupBy("question_id", "number").agg(F.min("pos").cast("long").alias("at"))
    known = sources.select("question_id", F.col("n").cast("long").alias("number"), "doc_id")
    return first.join(known, ["question_id", "number"], "left").select("question_id", "at", "number", "doc_id")


def answer(prompted: DataFrame, complete: Callable[[list[str]], list[str]]) -> DataFrame:
    """Add `answer` by a model hook; a null prompt (no sources) gets NO_SOURCES without a call."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = pd.Series([NO_SOURCES] * len(part))
            some = part.notna()
            if some.any():
                out[some.to_numpy()] = complete(part[some].tolist())
            yield out

    return prompted.withColumn("answer", run("prompt"))
