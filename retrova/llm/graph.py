"""Connected components and pairwise work over groups of any size, without ever holding one in a task or the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links(a, b): the smallest node reachable, itself included.

    Min-label propagation with pointer jumping, so the rounds grow with the logarithm of a component's width. A hub's links
    meet only in map-side minima and in joins that adaptive execution may split; each round is cut by a checkpoint.
    Links with a null end and loops are ignored; an empty table gives an empty table.
    """
    links = links.select("a", "b").filter("a <> b")
    both = cut(links.union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        heard = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("heard"))
        told = labels.join(heard, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("next"))
        new = cut(told.join(jump, "now", "left").select("node", "was", F.least("now", "next").alias("component")))
        labels = new.select("node", "component")
        if new.filter("component < was").isEmpty():
            return labels


def in_block_pairs(grouped: DataFrame, payload: list[str], block: int, work: Callable[[pa.Table], pa.RecordBatch], schema) -> DataFrame:
    """Run work on every pair of blocks of every group of grouped(group, id, *payload).

    A group of n rows is dealt by a hash of id into ceil(n / block) blocks. work gets the rows of one pair (i, j), i <= j, as
    an Arrow table with the column block besides: for i = j it is to compare all rows, else those of i with those of j. So
    every pair of rows of a group is met exactly once and no task holds more than about two blocks.
    """
    sizes = grouped.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = grouped.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("group", "id", "block", *payload, other).select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "block", *payload)
    return by_task(dealt, work, schema)


def by_task(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema) -> DataFrame:
    """Run work on the rows of each task (group, i, j); a worker holds the rows of one task at a time."""
    return rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(lambda batches: _each_key(batches, work), schema)


def few(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A table of small rows: written, and marked for broadcast if it has no more rows than these, else joined as any other."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def _each_key(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply work to the rows of each (group, i, j) of a sorted partition; only one key's rows and one batch are held."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        group, i, j = (batch.column(n).to_pylist() for n in ("group", "i", "j"))
        begin = 0
        for at, now in enumerate(zip(group, i, j, strict=True)):
            if now != key:
                if at > begin:
                    held.append(batch.slice(begin, at - begin))
                if held:
                    yield work(pa.Table.from_batches(held))
                held, key, begin = [], now, at
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
    if held:
        yield work(pa.Table.from_batches(held))


class Union:
    """Disjoint sets over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y
