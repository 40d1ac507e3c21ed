"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern, the set of sources that each belongs to. Word capacity flows from the
patterns to the sources' quotas; the n-th time that a pattern's words are used costs n, so repetition is convex and spread
before it deepens. The network has a node a pattern and source and is solved on the driver; the corpus only sees one
aggregate a pattern. Documents are then selected in the order of a seeded hash: its first digits are refined level by level,
256 bins a pattern each time, until the bin where a pattern's quota ends holds next to nothing. No document list is sorted,
ranked or collected; the driver gets one row a pattern, no bins.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import cut, table

SEED = 17
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: Hex digits of the seeded hash, two a level: the last bin holds about one in 16 million documents of a pattern.
LEVELS = 3
#: Patterns whose plan may be broadcast; with more the plan is joined by a shuffle.
BROADCAST_PATTERNS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> dict[str | None, float]:
    """Words wanted of each source: `share` of all words by weight, at most `repeats` times a source's size.

    Sources by code point, null last, take the weights in turn. What a source can't take is dealt to the others by weight,
    until none is above its most.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[n % len(weights)]) for n, s in enumerate(order)}
    want, full, left = {s: 0.0 for s in order}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        whole = sum(weight[s] for s in free)
        for s in free:
            want[s] = left * weight[s] / whole
        over = [s for s in free if want[s] > repeats * sizes[s]]
        if not over:
            return want
        for s in over:
            want[s] = float(repeats * sizes[s])
            full.add(s)
            left -= want[s]


def route(mass: dict[tuple, int], quota: dict[str | None, int], repeats: int = REPEATS) -> dict[tuple, dict[str | None, int]]:
    """Words of each pattern that go to each source: a flow of the greatest value, and among those of the least cost.

    Successive shortest paths over pattern and source nodes. The n-th use of a pattern's words costs n.
    """
    flow = {p: {s: 0 for s in p if s in quota} for p in mass}
    used, left = {p: 0 for p in mass}, dict(quota)
    holds: dict[str | None, list[tuple]] = {}
    for p in mass:
        for s in flow[p]:
            holds.setdefault(s, []).append(p)
    for level in range(1, repeats + 1):  # arcs of one cost at a time: a cheaper path never appears later
        room = dict(mass)
        for start in sorted(mass, key=lambda p: (len(p), str(p))):
            while room[start] > 0:
                came, queue, end = {("p", start): None}, deque([("p", start)]), None
                while queue and end is None:
                    kind, x = node = queue.popleft()
                    if kind == "p":
                        steps = [("s", s) for s in flow[x]]
                    elif left[x] > 0:
                        end = node
                        break
                    else:
                        steps = [("p", p) for p in holds[x] if flow[p][x] > 0]
                    for step in steps:
                        if step not in came:
                            came[step] = node
                            queue.append(step)
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                most = min([room[start], left[end[1]], *(flow[path[n + 1][1]][path[n][1]] for n in range(1, len(path) - 1, 2))])
                for n in range(0, len(path), 2):
                    flow[path[n][1]][path[n + 1][1]] += most
                for n in range(1, len(path) - 1, 2):
                    flow[path[n + 1][1]][path[n][1]] -= most
                left[end[1]] -= most
                room[start] -= most
                used[start] += most
    return flow


def measured(docs: DataFrame, sources, *, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pattern, size, digits): what selection needs of each document. `sources` is an array column of its sources."""
    pattern = F.to_json(F.array_sort(F.array_distinct(sources)), {"ignoreNullFields": "false"})
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 2 * LEVELS)
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    return cut(docs.select(F.col(id_col).alias("id"), pattern.alias("pattern"), size.alias("size"), digits.alias("digits")))


def _refine(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """(pattern, bound, rest): up to where a pattern's documents, in the order of their digits, fill rest(pattern, rest), and what is left.

    Level by level the bin that would overflow is opened; at the last level it stays closed. All of it is a plan: at most 256
    bins a pattern meet in a window, and the driver sees none of them.
    """
    state = cut(rest.select("pattern", F.lit("").alias("bound"), "rest", (F.col("rest") > 0).alias("open")))
    for level in range(1, LEVELS + 1):
        inside = rows.join(_small(state.filter("open")), "pattern").filter(F.substring("digits", 1, 2 * level - 2) == F.col("bound"))
        bins = inside.groupBy("pattern", "rest", F.substring("digits", 1, 2 * level).alias("bin")).agg(F.sum("size").alias("size"))
        total = F.sum("size").over(Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        over = F.min(F.when(F.col("total") > F.col("rest"), F.struct("bin", (F.col("total") - F.col("size")).alias("before"))))
        found = bins.withColumn("total", total).groupBy("pattern").agg(over.alias("over"), F.sum("size").alias("all"))
        both, spills = state.join(_small(found), "pattern", "left"), F.col("over").isNotNull()
        bound = F.when(~F.col("open"), F.col("bound")).when(spills, F.col("over.bin")).otherwise(F.rpad("bound", 2 * LEVELS, "f"))
        used = F.when(~F.col("open"), 0).when(spills, F.col("over.before")).otherwise(F.coalesce("all", F.lit(0)))
        state = cut(both.select("pattern", bound.alias("bound"), (F.col("rest") - used).alias("rest"), (F.col("open") & spills).alias("open")))
    n = 2 * LEVELS
    below = F.concat(F.substring("bound", 1, n - 1), F.char(F.ascii(F.substring("bound", n, 1)) - 1), F.lit("~"))
    return state.select("pattern", F.when(F.col("open"), below).otherwise(F.col("bound")).alias("bound"), "rest")


def select(rows: DataFrame, wanted: dict[str, int], mass: dict[str, int]) -> DataFrame:
    """Add `taken` to measured rows, so that each pattern's words come near wanted[pattern].

    Every document is taken wanted // mass times; of the rest, documents are taken once more in the order of their digits up
    to the first that doesn't fit, and then, in the same order, those of at most an eighth of the gap that this leaves.
    """
    plan = [(p, w // mass[p] if mass[p] else 0, w % mass[p] if mass[p] else 0) for p, w in wanted.items()]
    plan = rows.sparkSession.createDataFrame(plan, "pattern string, whole long, rest long")
    gap = F.col("rest")
    small = F.when(gap > 0, F.greatest(F.lit(1), F.floor(gap / 8))).otherwise(0).cast("long")
    first = _refine(rows, plan.select("pattern", "rest")).select("pattern", F.col("bound").alias("first"), small.alias("small"), "rest")
    others = rows.join(_small(first.drop("rest")), "pattern").filter("digits > first and size <= small and size > 0").select("pattern", "size", "digits")
    filled = _refine(others, first.select("pattern", "rest")).select("pattern", F.col("bound").alias("filled"))
    plan = plan.drop("rest").join(first.drop("rest"), "pattern").join(filled, "pattern")
    more = (F.col("digits") <= F.col("first")) | ((F.col("size") <= F.col("small")) & (F.col("digits") <= F.col("filled")))
    times = F.coalesce(F.col("whole"), F.lit(0)) + F.when(more, 1).otherwise(0)
    return rows.join(_small(plan), "pattern", "left").select("id", "pattern", "size", (F.col("size") * times).cast("long").alias("taken"))


def _small(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_PATTERNS else plan


def mix(docs: DataFrame, sources, quotas=None, *, repeats: int = REPEATS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict, dict, dict]:
    """(rows with id, pattern, size and taken; sizes of the sources; their targets; sources of each pattern).

    `sources` is an array column: a document may belong to several. `quotas` gives the words wanted of each source from the
    sources' sizes (default: `targets`). A null text has size 0; a null source is a source of its own; a document of no
    source is never taken; rows that share an id are selected alike; an empty table gives an empty result. Each document is
    taken `repeats` times at most, whatever the quotas. Names of other columns don't matter.
    """
    rows = measured(docs, sources, seed=seed, id_col=id_col, text_col=text_col)
    mass = {p: int(n) for p, n in rows.groupBy("pattern").agg(F.sum("size")).collect()}  # one row a pattern
    members = {p: tuple(json.loads(p)) if p else () for p in mass}
    sizes: dict[str | None, int] = {}
    for p, n in mass.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + n
    goal = (quotas or targets)(sizes) if sizes else {}
    flow = route({members[p]: n for p, n in mass.items()}, {s: round(w) for s, w in goal.items()}, repeats)
    wanted = {p: min(repeats * mass[p], sum(flow[members[p]].values())) for p in mass if p is not None}
    return select(rows, wanted, mass), sizes, goal, members


def op6_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target (of its source) and taken for documents(doc_id, source, text)."""
    rows, sizes, goal, members = mix(docs, F.array("source"))
    shape = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    facts = docs.sparkSession.createDataFrame([(p, sizes[s], goal[s]) for p, (s,) in members.items()], shape)
    return rows.join(_small(facts), "pattern", "left").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: sources weigh 3, 1, 2 in turn and share 150 % of all words."""
    return op6_rows(table(spark, sf_dir, "documents"))
