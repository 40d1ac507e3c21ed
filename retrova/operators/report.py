"""Experiment rows: labels, selectors, the latest row of each configuration, tables and chart series."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import stats

#: What tells one configuration from another, with the value that rows from before a field existed stand for (fixed values).
KEY = {"model": None, "chunker": None, "index": "flat", "k_chunks": None, "query_prefix": "", "rerank": "", "rerank_depth": 0}


def label(model: Column, chunker: Column, index: Column, rerank: Column, depth: Column) -> Column:
    """model:chunker:index, and the re-ranker with its depth if there is one."""
    more = F.concat(F.lit(" + "), X.short_name(rerank), F.lit("@"), depth.cast("string"))
    return F.concat(X.short_name(model), F.lit(":"), chunker, F.lit(":"), index, F.when(rerank.isNotNull(), more).otherwise(F.lit("")))


def latest(rows: DataFrame, key: dict, order: Column | str = "line_no") -> DataFrame:
    """The last row of each key, with `first_seen`, the order in which keys appeared. Missing fields take their default."""
    own = [F.coalesce(F.col(c), F.lit(d)) if d is not None else F.col(c) for c, d in key.items()]
    group = Window.partitionBy(*own)
    order = F.col(order) if isinstance(order, str) else order
    ranked = rows.withColumn("_n", F.row_number().over(group.orderBy(order.desc()))).withColumn("first_seen", F.min(order).over(group))
    return ranked.filter("_n = 1").drop("_n")


def matches(selector: str) -> Column:
    """Whether a row fits model[:chunker[:index[:rerank]]]: model and re-ranker by substring in any case, the others exactly.

    `none` as the re-ranker means rows without one; an empty part fits all.
    """
    parts = (selector.split(":") + [""] * 4)[:4]
    model, chunker, index, rerank = parts
    out = F.contains(F.lower("model"), F.lit(model.lower()))
    if chunker:
        out &= F.col("chunker") == chunker
    if index:
        out &= F.coalesce("index", F.lit("flat")) == index
    if rerank == "none":
        out &= F.col("rerank").isNull()
    elif rerank:
        out &= F.coalesce(F.contains(F.lower("rerank"), F.lit(rerank.lower())), F.lit(False))
    return out


def kind(index: Column | str) -> Column:
    """The family of an index spec: all but its three numbers."""
    return F.regexp_replace(index, r"-\d+-\d+-\d+$", "")


def search_beam(index: Column | str) -> Column:
    return F.regexp_extract(index, r"-(\d+)$", 1).try_cast("long")


def graph_key(index: Column | str) -> Column:
    """What specs that share a graph have in common."""
    return F.regexp_replace(index, r"-\d+$", "")


def percentiles(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, p50, p99 (linear between ranks) and queries a second of a latency column."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.99).alias("p99"), (F.count("*") / F.sum(value)).alias("per_second"))


#: The columns of the report, and of a comparison (fixed formats).
REPORT_HEAD = "| Model | Chunking | Index | Re-rank | Chunks | Truncated | R@1 | R@10 | MRR@10 | nDCG@10 | ANN@10 | p50 ms | Commit |"
COMPARE_HEAD = "| System | nDCG@10 | Δ vs base | 95% CI of Δ | p | p (Holm) | Verdict |"


def markdown(rows: DataFrame, sort: str = "ndcg") -> DataFrame:
    """(place, line): a row of a Markdown table each, by `sort` descending; a star marks rows of a changed checkout.

    As many rows as experiments, so one window serves.
    """
    order = Window.orderBy(F.col(sort).desc(), "first_seen")
    commit = F.concat(F.coalesce("commit", F.lit("?")), F.when(F.col("dirty"), "*").otherwise(""))
    second = F.coalesce(F.concat(X.short_name("rerank"), F.lit("@"), F.col("rerank_depth").cast("string")), F.lit("-"))
    numbers = [F.col("n_chunks").cast("long"), 100 * F.col("truncated_frac"), "recall_1", "recall_10", "mrr", "ndcg", F.coalesce("ann_recall", F.lit(1.0)), "search_p50_ms"]
    line = F.format_string("| %s | %s | %s | %s | %,d | %.1f%% | %.3f | %.3f | %.3f | %.3f | %.3f | %.2f | %s |", X.short_name("model"), F.col("chunker"), F.coalesce("index", F.lit("flat")), second, *numbers, commit)
    return rows.select(F.row_number().over(order).cast("long").alias("place"), line.alias("line"))


def compared(log: DataFrame, base: str, against: str | None = None, alpha: float = 0.05, resamples: int = stats.RESAMPLES) -> DataFrame:
    """`stats.compare` over log(model, chunker, index, rerank, rerank_depth, query_id, score), systems named by their labels.

    The selector `base` must fit one system (else ValueError); it is held against those that `against` fits, by default
    those of its model. Only comparisons that are made count toward the adjustment.
    """
    named = log.withColumn("system", label(F.col("model"), F.col("chunker"), F.coalesce("index", F.lit("flat")), F.col("rerank"), F.col("rerank_depth")))
    found = [r.system for r in named.filter(matches(base)).select("system").distinct().take(2)]
    if len(found) != 1:
        raise ValueError(f"the baseline {base!r} fits {'no system' if not found else 'several systems'} with scores; it must fit one")
    kept = named.filter((F.col("system") == found[0]) | matches(against or base.split(":")[0]))
    return stats.compare(kept.select("system", "query_id", "score"), found[0], alpha, resamples)


def compare_markdown(rows: DataFrame) -> DataFrame:
    """(place, line) of compared systems, the largest gain first."""
    order = Window.orderBy(F.col("diff").desc(), "system")
    line = F.format_string("| %s | %.3f | %+.3f | [%+.3f, %+.3f] | %.3f | %.3f | %s |", "system", "mean_b", "diff", "low", "high", "p", "p_holm", "verdict")
    return rows.select(F.row_number().over(order).cast("long").alias("place"), line.alias("line"))


def of_model(part: str) -> Column:
    """Whether a model's name holds `part`, in its case."""
    return F.contains(F.col("model"), F.lit(part))


def stamp(at: Column | str | None = None) -> Column:
    """A time as rows of the log have it (default: now)."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss")


def series(rows: DataFrame, n: int) -> DataFrame:
    """Chart series of bench rows of size n: recall against median latency along the search beam, by family."""
    return rows.filter(F.col("n") == n).select(kind("index").alias("kind"), search_beam("index").alias("beam"), "recall", "p50_ms")


def by_size(rows: DataFrame, beam: int) -> DataFrame:
    """Chart series of bench rows: median latency against size, by family; graphs at one search beam, exact search as it is."""
    own = kind("index")
    return rows.filter((own == "flat") | (own.isin("hnsw", "faiss-hnsw") & (search_beam("index") == beam))).select(own.alias("kind"), "n", "p50_ms")


def append(row: DataFrame, path: str) -> None:
    """Append experiment rows as JSON lines."""
    row.write.mode("append").json(path)


def checkout(folder: str = ".") -> tuple[str | None, bool | None]:
    """Short commit, and whether tracked files outside results/ differ; (None, None) where git or a repository is missing."""
    try:
        ask = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=True).stdout.strip()
        return ask("rev-parse", "--short", "HEAD"), bool(ask("status", "--porcelain", "--untracked-files=no", "--", ".", ":!results"))
    except (OSError, subprocess.CalledProcessError):
        return None, None
