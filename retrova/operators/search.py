"""Exact nearest neighbours: query_id, rank, vec_id and score (cosine), best first, ties by the smaller id.

The queries are a stated set against all rows. `exact` is one native plan for few pairs; `batched` multiplies tiles of the
query matrix with tiles of the rows and keeps the k best of each query while a task's rows pass, so what is shuffled is k rows
a query and task at most, and what a task holds doesn't grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector as V

#: Queries of one block of the query matrix: 4,096 of 1,024 dimensions are 32 MB.
QUERY_BLOCK = 4_096
#: Queries and rows of one product: 16 MB of scores.
QUERY_TILE, ROW_TILE = 1_024, 2_048
#: Products of numbers up to which `exact` is a native plan: it sorts all pairs.
NATIVE_PRODUCTS = 100_000_000
#: Rounding slack of a product in double precision: what is within it of the k-th best is scored again.
SLACK = 1e-11
#: Pairs that are scored again at a time.
AGAIN = 16_384
#: Rows that may be broadcast to be looked for in a larger table.
BROADCAST_ROWS = 1_000_000


def ranked(scored: DataFrame, k: int, *more: str) -> DataFrame:
    """The k best rows of each query of scored(query_id, vec_id, score) with its columns `more`; Spark limits each group before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", *more, "score")


class Best:
    """The k best rows of each of n queries while batches pass; of equal scores those with the smaller ids.

    `least` has each query's k-th best score so far (minus infinity before there are k): what is below needn't be added. With
    `slack`, rows so near to the k-th best stay too, for scores that are rounded later.
    """

    def __init__(self, n: int, k: int, id_col: str, slack: float = 0.0):
        self.k, self.id_col, self.slack = k, id_col, slack
        self.least = np.full(n, -np.inf if k > 0 else np.inf)
        self.held: list[pa.Table] = []
        self.rows, self.most = 0, max(65_536, 3 * n * k)

    def add(self, query: np.ndarray, score: np.ndarray, rows: pa.RecordBatch) -> None:
        """Rows with the number of their query and their score."""
        if len(query):
            self.held.append(pa.table([*rows.columns, pa.array(query, pa.int32()), pa.array(score, pa.float64())], [*rows.schema.names, "_query", "_score"]))
            self.rows += len(query)
            if self.rows > self.most:
                self.settle()

    def settle(self) -> None:
        """Drop what is no longer among the best."""
        if not self.held:
            return
        whole = pa.concat_tables(self.held).combine_chunks().sort_by([("_query", "ascending"), ("_score", "descending"), (self.id_col, "ascending")])
        query, score = (whole.column(c).to_numpy() for c in ("_query", "_score"))
        at = np.arange(len(query))
        first = np.append(True, query[1:] != query[:-1])
        place = at - np.maximum.accumulate(np.where(first, at, 0))
        equal = at - np.maximum.accumulate(np.where(first | np.append(True, score[1:] != score[:-1]), at, 0))
        last = place == self.k - 1
        self.least[query[last]] = score[last]
        keep = (place < self.k) | ((self.slack > 0) & (equal < self.k) & (score >= self.least[query] - self.slack))
        self.held = [whole.filter(pa.array(keep))]
        self.rows = self.held[0].num_rows
        self.most = max(self.most, 2 * self.rows)

    def out(self, names: pa.Array) -> Iterator[pa.RecordBatch]:
        """(query_id, the rows' own columns, score), each query's name from `names`."""
        self.settle()
        for whole in self.held:
            for part in whole.to_batches(10_000):
                own = [part.column(c) for c in whole.schema.names[:-2]]
                yield pa.RecordBatch.from_arrays([names.take(part.column("_query")), *own, part.column("_score")], ["query_id", *whole.schema.names[:-2], "score"])


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that are multiplied with many others, dealt over all cores: adaptive execution sees few of them and would leave few tasks."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def few(rows: DataFrame) -> DataFrame:
    """Rows that are kept and counted: up to BROADCAST_ROWS they go to what they are joined with, which then stays where it is."""
    rows = rows.cache()
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def exact(queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every query against every row, in the JVM. More than NATIVE_PRODUCTS take the batched way."""
    numbers = queries.agg(F.sum(F.size(vector_col))).first()[0] or 0
    if numbers * base.count() > NATIVE_PRODUCTS:
        return batched(queries, base, k, id_col, vector_col)
    q = queries.select(F.col(id_col).alias("query_id"), V.normalize(vector_col).alias("q"))
    b = base.select(F.col(id_col).alias("vec_id"), V.normalize(vector_col).alias("v"))
    return ranked(b.crossJoin(F.broadcast(q)).select("query_id", "vec_id", V.dot("q", "v").alias("score")), k)


def _in_turn(products: np.ndarray) -> np.ndarray:
    """Each row's sum, one number after the other as an engine adds them: the same for a pair wherever it stands."""
    return products.cumsum(axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column scaled to length 1, in double precision."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    return m / np.maximum(np.sqrt(_in_turn(m * m)), V.LEAST_NORM)[:, None]


def _near(q: np.ndarray, rows: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of queries and rows that may be among the k best of a query, if its k-th best so far is `least`."""
    scores = q @ rows.T
    if 0 < k < len(rows) and np.isneginf(least).any():
        least = np.maximum(least, np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k])
    return np.nonzero(scores >= least[:, None] - SLACK)


def batched(queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """As `exact`, by matrix products over Arrow batches; the queries go out in blocks of `block`, one pass each.

    Products only find the pairs that come near: their scores are then added up as the native plan does it, so that equal
    vectors tie exactly.
    """
    rows = base.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter("v is not null")
    out = T.StructType([T.StructField("query_id", queries.schema[id_col].dataType), T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())])
    rows = spread(rows, "vec_id")
    parts, held = [], []

    def against(ids: list, vectors: list) -> DataFrame:
        q = queries.sparkSession.sparkContext.broadcast((np.array(ids), matrix(pa.array(vectors, pa.list_(pa.float64())))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, m = q.value
            best = Best(len(names), k, "vec_id")
            for batch in batches:
                for begin in range(0, batch.num_rows, ROW_TILE):
                    part = batch.slice(begin, ROW_TILE)
                    own = matrix(part.column(1))
                    for low in range(0, len(names), QUERY_TILE):
                        query, row = _near(m[low : low + QUERY_TILE], own, best.least[low : low + QUERY_TILE], k)
                        for n in range(0, len(query), AGAIN):
                            a, b = query[n : n + AGAIN] + low, row[n : n + AGAIN]
                            best.add(a, _in_turn(m[a] * own[b]), part.select([0]).take(pa.array(b)))
            yield from best.out(pa.array(names))

        return rows.mapInArrow(run, out)

    for query, vector in queries.select(id_col, vector_col).filter(F.col(vector_col).isNotNull()).toLocalIterator():
        held.append((query, vector))
        if len(held) == block:
            parts.append(against(*zip(*held, strict=True)))
            held = []
    if held:
        parts.append(against(*zip(*held, strict=True)))
    if not parts:
        return ranked(queries.sparkSession.createDataFrame([], out), k)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return ranked(whole, k)
