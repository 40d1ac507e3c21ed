"""Paired significance statistics over per-query scores.

Signs and draws come from md5 of the numbers of resamples and queries, so results are the same on every run and engine. They
are not rows: a task digests its queries with all resamples, tile by tile, and gives a sum for each system and resample.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digest
from .search import spread

#: As the reference has it, for signs and draws alike.
RESAMPLES = 10_000
#: Rounding slack when a resampled difference is compared with the observed one.
SLACK = 1e-12
#: Differences that are sent to the tasks at once, to be drawn from: 32 MB. More go out in turn, each time with all draws.
TABLE = 4_000_000
#: Differences that a task adds up at a time.
ADDED = 1_000_000


def paired(scores: DataFrame, base: str) -> DataFrame:
    """(system, query_id, a, b, diff) of scores(system, query_id, score): each system against `base` over equal query sets."""
    a = scores.filter(F.col("system") == base).select("query_id", F.col("score").alias("a"))
    b = scores.filter(F.col("system") != base).select("system", "query_id", F.col("score").alias("b"))
    both = b.join(a, "query_id")
    n = a.agg(F.count("*").alias("n_a"))
    sizes = b.groupBy("system").agg(F.count("*").alias("n_b")).join(both.groupBy("system").agg(F.count("*").alias("n_both")), "system").crossJoin(n)
    equal = sizes.filter("n_a = n_b and n_a = n_both").select("system")
    return both.join(equal, "system", "left_semi").select("system", "query_id", "a", "b", (F.col("b") - F.col("a")).alias("diff"))


def summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("system").agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("diff").alias("diff"))


def _systems(pairs: DataFrame) -> list[tuple]:
    """(system, number of pairs, number and mean of differences), as many rows as systems."""
    found = pairs.groupBy("system").agg(F.count("*").alias("n"), F.count("diff").alias("counted"), F.avg("diff").alias("diff"))
    return [tuple(r) for r in found.orderBy("system").collect()]


def _sums(rows: DataFrame, systems: int, resamples: int, run: Callable[[pa.RecordBatch, list[bytes], np.ndarray], None]) -> DataFrame:
    """(at, r, sum) for each system by its number and each resample: what `run` has added up over the rows of a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((resamples, systems)), False
        heads = [f"{r}:".encode() for r in range(resamples)]
        for batch in batches:
            if batch.num_rows:
                run(batch, heads, total)
                some = True
        for at in range(systems) if some else ():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(resamples, at, np.int32)), pa.array(np.arange(resamples)), pa.array(total[:, at])], ["at", "r", "sum"])

    return rows.mapInArrow(task, "at int, r long, sum double").groupBy("at", "r").agg(F.sum("sum").alias("sum"))


def _named(pairs: DataFrame, systems: list[tuple]) -> DataFrame:
    """(at, system, counted, diff): the systems by their numbers."""
    rows = [(at, name, counted, diff) for at, (name, _, counted, diff) in enumerate(systems)]
    return F.broadcast(pairs.sparkSession.createDataFrame(rows, f"at int, system {pairs.schema['system'].dataType.simpleString()}, counted long, diff double"))


def randomization(pairs: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """(system, diff, p): two-sided, by flipping the signs of the differences. A query's sign in a resample is drawn once for all systems."""
    pairs = pairs.cache()
    systems = _systems(pairs)
    numbers = pa.array([name for name, *_ in systems])
    queries = pairs.groupBy(F.col("query_id").cast("string").alias("query_id")).agg(F.collect_list(F.struct("system", "diff")).alias("of"))

    def run(batch: pa.RecordBatch, heads: list[bytes], total: np.ndarray) -> None:
        of = batch.column(1)
        own, flat = np.repeat(np.arange(len(of)), of.value_lengths().to_numpy()), of.flatten()
        diffs = np.zeros((len(of), len(numbers)))
        np.add.at(diffs, (own, pc.index_in(flat.field(0), numbers.cast(flat.field(0).type)).to_numpy()), flat.field(1).fill_null(0.0).to_numpy())
        for r, query, bits in digest.tiles(heads, [q.encode() for q in batch.column(0).to_pylist()]):
            total[r] += diffs[query].sum(axis=0) - 2 * ((bits & 1).astype(float) @ diffs[query])

    flipped = _sums(spread(queries, "query_id"), len(systems), resamples, run).join(_named(pairs, systems), "at")
    m = F.col("sum") / F.nullif("counted", F.lit(0))
    extreme = flipped.groupBy("system", "diff").agg(F.count_if(F.abs(m) >= F.abs("diff") - SLACK).alias("extreme"))
    return extreme.select("system", "diff", ((F.col("extreme") + 1) / (resamples + 1)).alias("p"))


def _drawn(numbered: DataFrame, n: int, systems: list, gaps: bool, low: int, high: int, resamples: int) -> DataFrame:
    """(system, r, sum, counted) of those of each resample's n draws that fall from place low to below high. With gaps, some differences are null."""
    spark, width = numbered.sparkSession, len(systems)
    rows = numbered.filter(F.col("system").isin(systems) & (F.col("i") >= low) & (F.col("i") < high)).select("system", "i", "diff").toArrow()
    names, diff = rows.column("system").combine_chunks(), rows.column("diff")
    at, place = pc.index_in(names, pa.array(systems).cast(names.type)).to_numpy(), rows.column("i").to_numpy() - low
    table = np.zeros((high - low, width * (1 + gaps)))
    table[place, at] = diff.fill_null(0.0).to_numpy()
    if gaps:
        table[place, width + at] = diff.is_valid().to_numpy()
    sent = spark.sparkContext.broadcast(table)

    def run(batch: pa.RecordBatch, heads: list[bytes], total: np.ndarray) -> None:
        own = sent.value
        for r, _, bits in digest.tiles(heads, [str(i).encode() for i in batch.column(0).to_pylist()]):
            place = bits.astype(np.int64) % n - low
            step = max(1, ADDED // (place.shape[1] * own.shape[1]))
            for begin in range(0, len(r), step):
                drawn = place[begin : begin + step]
                if len(own) < n:
                    inside = (drawn >= 0) & (drawn < len(own))
                    total[r[begin : begin + step]] += (own[np.where(inside, drawn, 0)] * inside[:, :, None]).sum(axis=1)
                else:
                    total[r[begin : begin + step]] += own[drawn].sum(axis=1)

    sums = _sums(spark.range(0, n, 1, 2 * spark.sparkContext.defaultParallelism), table.shape[1], resamples, run)
    own = spark.createDataFrame(list(enumerate(systems)), f"at int, system {numbered.schema['system'].dataType.simpleString()}")
    flags = F.when(F.col("at") >= width, F.col("sum")).otherwise(0.0) if gaps else F.lit(0.0 if low else float(n))
    parts = sums.select((F.col("at") % width).alias("at"), "r", F.when(F.col("at") < width, F.col("sum")).otherwise(0.0).alias("sum"), flags.alias("counted"))
    return parts.join(F.broadcast(own), "at").select("system", "r", "sum", "counted")


def bootstrap(pairs: DataFrame, resamples: int = RESAMPLES, level: float = 0.95) -> DataFrame:
    """(system, low, high): percentile interval of the mean difference, queries drawn with replacement; one draw serves all systems of n queries."""
    pairs = pairs.cache()
    order = Window.partitionBy("system").orderBy("query_id")
    numbered = pairs.select("system", "diff", (F.row_number().over(order) - 1).cast("long").alias("i")).cache()
    sized: dict[int, list] = defaultdict(list)
    for name, n, counted, _ in _systems(pairs):
        sized[n].append((name, counted < n))
    drawn = pairs.sparkSession.createDataFrame([], f"system {pairs.schema['system'].dataType.simpleString()}, r long, sum double, counted double")
    for n, own in sized.items():
        gaps = any(some for _, some in own)
        step = max(1, TABLE // (len(own) * (1 + gaps)))
        for low in range(0, n, step):
            drawn = drawn.unionByName(_drawn(numbered, n, [name for name, _ in own], gaps, low, min(n, low + step), resamples))
    means = drawn.groupBy("system", "r").agg((F.sum("sum") / F.nullif(F.sum("counted"), F.lit(0.0))).alias("m"))
    tail = (1 - level) / 2
    return means.groupBy("system").agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))


def holm(tests: DataFrame) -> DataFrame:
    """Add p_holm to (system, p): step-down adjusted for all tests at hand. As many rows as systems, so one window serves."""
    order = Window.orderBy("p", "system")
    m = tests.agg(F.count("*").alias("m"))
    step = tests.crossJoin(F.broadcast(m)).withColumn("at", F.row_number().over(order))
    step = step.withColumn("own", F.least(F.lit(1.0), (F.col("m") - F.col("at") + 1) * F.col("p")))
    return step.withColumn("p_holm", F.max("own").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("m", "at", "own")


def verdict(diff: Column, p_holm: Column, alpha: float = 0.05) -> Column:
    return F.when(p_holm < alpha, F.when(diff > 0, "better").otherwise("worse")).otherwise("no clear difference")


def compare(scores: DataFrame, base: str, alpha: float = 0.05, resamples: int = RESAMPLES) -> DataFrame:
    """One row a system: means, difference from `base`, interval, p, adjusted p and verdict."""
    if not scores.filter(F.col("system") == base).take(1):
        raise ValueError(f"no scores of the baseline {base!r}")
    pairs = paired(scores, base).cache()
    tested = holm(randomization(pairs, resamples).select("system", "p"))
    whole = summary(pairs).join(tested, "system").join(bootstrap(pairs, resamples), "system")
    return whole.withColumn("verdict", verdict(F.col("diff"), F.col("p_holm"), alpha))
