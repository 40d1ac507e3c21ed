"""Experiments: from passages and queries to one row of metrics, as one plan an index spec."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators import chunk, embed, graphindex, metrics, rank, search

#: Passages that a query's ranking starts from, before they collapse to documents.
PASSAGES = 100
#: Neighbours over which an approximate index is held against the exact one.
OVERLAP = 10


#: Characters of items that are looked for in one pass: their automaton takes some 100 bytes a character in each worker.
ITEM_CHARS = 1_000_000


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade 1) where a document(doc_id, text) holds the whole text of an item(query_id, text).

    All items of a block are found in one walk over a text; further blocks of ITEM_CHARS are further passes. An empty item is
    in every text, a null one in none.
    """
    shape = f"query_id {items.schema['query_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    out = docs.sparkSession.createDataFrame([], shape)

    def within(block: dict[str, list]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            walk = ahocorasick.Automaton()
            for text, ids in block.items():
                if text:
                    walk.add_word(text, ids)
            walk.make_automaton()
            for batch in batches:
                found = [(q, doc) for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if text is not None for q in {*block.get("", ()), *(i for _, ids in (walk.iter(text) if len(walk) else ()) for i in ids)}]
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in enumerate(types)], ["query_id", "doc_id"])

        types = [f.dataType for f in out.schema.fields]
        types = [to_arrow_type(t) for t in types]
        return docs.select("doc_id", "text").mapInArrow(run, shape)

    block, size = {}, 0
    for q, text in items.filter("text is not null").select("query_id", "text").toLocalIterator():
        if size + len(text) > ITEM_CHARS and block:
            out, block, size = out.unionByName(within(block)), {}, 0
        block.setdefault(text, []).append(q)
        size += len(text)
    if block:
        out = out.unionByName(within(block))
    return out.withColumn("grade", F.lit(1))


def passages_of(docs: DataFrame, spec: str) -> DataFrame:
    return chunk.parse_chunker(spec)(docs)


def lexical(docs: DataFrame, queries: DataFrame, spec: str, k: int = PASSAGES) -> DataFrame:
    """hits(query_id, rank, chunk_id, doc_id, score) by bag-of-words cosine over passages; queries(query_id, text)."""
    best = embed.bag_best(queries, passages_of(docs, spec), "query_id", "chunk_id", k, keep=("doc_id",))
    return best.select("query_id", "rank", F.col("vec_id").alias("chunk_id"), "doc_id", "score")


def experiment(docs: DataFrame, queries: DataFrame, qrels: DataFrame, spec: str, *, rerank_depth: int = 0) -> DataFrame:
    """One row: sizes and metrics of lexical search over passages cut by `spec`."""
    hits = lexical(docs, queries, spec)
    if rerank_depth:
        texts = passages_of(docs, spec).select("chunk_id", F.col("text").alias("passage"))
        rows = search.few(hits).join(texts, "chunk_id").join(queries.withColumnRenamed("text", "question"), "query_id")
        hits = rank.rerank(rows, rank.overlap_score(F.col("question"), F.col("passage")), rerank_depth).withColumn("rank", F.col("place"))
    scores = metrics.evaluate(rank.collapse(hits), qrels.cache())  # they are counted and joined
    sizes = passages_of(docs, spec).agg(F.count("*").alias("n_chunks"))
    return scores.crossJoin(sizes).select(F.lit(spec).alias("chunker"), "n_chunks", *scores.columns)


def grid(docs: DataFrame, queries: DataFrame, qrels: DataFrame, specs: list[str]) -> DataFrame:
    """A row a chunker spec. The loop is over configurations, each a plan of its own; the judgments are found once."""
    qrels = qrels.cache()
    out = experiment(docs, queries, qrels, specs[0])
    for spec in specs[1:]:
        out = out.unionByName(experiment(docs, queries, qrels, spec))
    return out


def index_sweep(base: DataFrame, queries: DataFrame, specs: list[str], shards: int = 1, k: int = OVERLAP) -> DataFrame:
    """(spec, found, wanted, recall, scored) of index specs; those that differ in the search beam only share one built graph."""
    truth = search.batched(queries, base, k).cache()
    n = base.count()
    graphs: dict[str, DataFrame] = {}
    out = None
    for spec in specs:
        kind, params = graphindex.parse_index(spec)
        if kind == "faiss-hnsw":
            raise RuntimeError("the optional backend of this index is not installed")
        if kind == "flat":
            row = metrics.overlap(truth, truth).withColumn("scored", F.lit(float(n)))
        else:
            key = graphindex.graph_key(spec)
            if key not in graphs:
                graphs[key] = graphindex.build(base, params, shards).cache()
            hits, scored = graphindex.search(graphs[key], queries, k, params.search_beam)
            row = metrics.overlap(hits, truth).crossJoin(scored.agg(F.avg("scored").alias("scored")))
        row = row.select(F.lit(spec).alias("spec"), "found", "wanted", "recall", "scored")
        out = row if out is None else out.unionByName(row)
    return out


def benchmark(base: DataFrame, queries: DataFrame, spec: str, shards: int = 1, k: int = OVERLAP) -> DataFrame:
    """One bench row (n, index, recall, scored, p50_ms, p99_ms, qps, build_s): the index is built and every query asked.

    Latencies are those of the walk in the shard that takes longest; qps counts queries over the wall clock of the whole search.
    """
    kind, params = graphindex.parse_index(spec)
    if kind != "hnsw":
        raise ValueError(f"no graph index is called {spec!r}")
    began = time.perf_counter()
    graph = graphindex.build(base, params, shards).cache()
    n = graph.count()
    built = time.perf_counter() - began
    hits, compared = (x.cache() for x in graphindex.search(graph, queries, k, params.search_beam))
    began = time.perf_counter()
    asked = compared.count()
    took = time.perf_counter() - began
    recall = metrics.overlap(hits, search.batched(queries, base, k)).select("recall")
    times = compared.agg(F.avg("scored").alias("scored"), F.percentile("ms", 0.5).alias("p50_ms"), F.percentile("ms", 0.99).alias("p99_ms"))
    fixed = {"n": F.lit(n).cast("long"), "index": F.lit(spec), "qps": F.lit(asked / took if took else 0.0), "build_s": F.lit(built)}
    return recall.crossJoin(times).select(fixed["n"].alias("n"), fixed["index"].alias("index"), "recall", "scored", "p50_ms", "p99_ms", fixed["qps"].alias("qps"), fixed["build_s"].alias("build_s"))


class Prepared(NamedTuple):
    """What the index specs of one chunker and model share: embedded passages and queries, each written once."""

    model: embed.Embedder
    chunker: str
    passages: DataFrame  # vec_id, chunk_id, doc_id, text, tokens, embedding
    queries: DataFrame  # vec_id, query_id, question, embedding
    n_docs: int


def _embedded(rows: DataFrame, model: embed.Embedder, id_: Column, folder: str, cache: str | None) -> DataFrame:
    """Rows numbered by the order of `id_` and embedded, written to `folder`. The numbers come from sorted partitions."""
    spark = rows.sparkSession
    rows.orderBy(id_).withColumn("part", F.spark_partition_id()).withColumn("own", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    parts = rows.groupBy("part").agg(F.min("own").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", (before - F.col("first")).alias("shift"))  # one row a partition
    numbered = rows.join(F.broadcast(starts), "part").withColumn("vec_id", F.col("own") + F.col("shift")).drop("part", "own", "shift")
    out = embed.embed_cached(numbered, model, cache)[0] if cache else embed.embed(numbered, model)
    out.withColumnRenamed("vector", "embedding").write.parquet(f"{folder}/vectors")
    return spark.read.parquet(f"{folder}/vectors")


def prepare(docs: DataFrame, queries: DataFrame, chunker: str, model: embed.Embedder, folder: str, cache: str | None = None) -> Prepared:
    """Cut documents(doc_id, text), embed passages and queries(query_id, text), the model's prefix before each query.

    What is embedded is written to `folder` (a shared one), so that every spec reads it and nothing is embedded twice; with
    `cache`, texts that it has aren't embedded at all.
    """
    model_tokens = _tokens(model)
    pieces = passages_of(docs, chunker).select("doc_id", "pos", "chunk_id", "text", model_tokens(F.col("text")).alias("tokens"))
    passages = _embedded(pieces, model, F.struct("doc_id", "pos"), f"{folder}/passages", cache)
    asked = queries.select("query_id", F.col("text").alias("question"), F.concat(F.lit(model.query_prefix), "text").alias("text"))
    return Prepared(model, chunker, passages, _embedded(asked, model, F.struct("query_id"), f"{folder}/queries", cache), docs.count())


def _tokens(model: embed.Embedder):
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(model.count_tokens(texts.fillna("").tolist()), dtype="int64")

    return count


def dense(prepared: Prepared, qrels: DataFrame, spec: str, *, k: int = PASSAGES, shards: int = 1, graphs: dict[str, tuple[DataFrame, float]] | None = None, reranker: rank.Reranker | None = None, rerank_depth: int = 50) -> tuple[DataFrame, DataFrame]:
    """(one row of an experiment, its query_id and ndcg): search over embedded passages by an index spec.

    `graphs` keeps what was built, so that specs that differ in the search beam share a graph. Times are those of the search:
    of exact search the wall clock over the queries, as it is one product; of a graph each query's own walk. The approximate
    answer is held against the exact one over OVERLAP passages.
    """
    model, base = prepared.model, prepared.passages
    graphs = {} if graphs is None else graphs
    kind, params = graphindex.parse_index(spec)
    if kind == "faiss-hnsw":
        raise RuntimeError("the optional backend of this index is not installed")
    truth = search.batched(prepared.queries, base, k).cache()
    began = time.perf_counter()
    n_queries = truth.select("query_id").distinct().count()
    wall = 1_000 * (time.perf_counter() - began)
    if kind == "flat":
        hits, built, n = truth, 0.0, base.count()
        facts = base.sparkSession.range(1).select(F.lit(float(n)).alias("scored_mean"), *(F.lit(wall / max(n_queries, 1)).alias(f"search_{p}_ms") for p in ("p50", "p99")))
    else:
        key = graphindex.graph_key(spec)
        if key not in graphs:
            began = time.perf_counter()
            graph = graphindex.build(base, params, shards).cache()
            graph.count()
            graphs[key] = graph, time.perf_counter() - began
        graph, built = graphs[key]
        hits, compared = graphindex.search(graph, prepared.queries, k, params.search_beam)
        hits, compared = hits.cache(), compared.cache()
        facts = compared.agg(F.avg("scored").alias("scored_mean"), F.percentile("ms", 0.5).alias("search_p50_ms"), F.percentile("ms", 0.99).alias("search_p99_ms"))
    head = F.col("rank") <= OVERLAP
    overlap = metrics.overlap(hits.filter(head), truth.filter(head)).select(F.col("recall").alias("ann_recall"))
    rows = search.few(hits.withColumnRenamed("query_id", "asked")).join(base.select("vec_id", "doc_id", F.col("text").alias("passage")), "vec_id")
    rows = rows.join(prepared.queries.select(F.col("vec_id").alias("asked"), "query_id", "question"), "asked").drop("asked")
    if reranker is not None:
        rows = rank.rerank_by(rows, reranker, rerank_depth).withColumn("rank", F.col("place"))
    each = metrics.per_query(rank.collapse(rows), qrels)
    names = ("recall_1", "recall_5", "recall_10", "mrr", "ndcg")
    sizes = base.agg(F.count("*").alias("n_chunks"), F.round(F.avg("tokens"), 1).alias("tokens_mean"), F.max("tokens").alias("tokens_max"), F.round(F.avg((F.col("tokens") > model.max_tokens).cast("double")), 4).alias("truncated_frac"))
    scores = each.agg(*(F.avg(c).alias(c) for c in names), F.count("*").alias("n_queries"))
    fixed = {"model": model.name, "chunker": prepared.chunker, "index": spec, "n_docs": prepared.n_docs, "dim": model.dim, "k_chunks": k, "max_tokens": model.max_tokens, "query_prefix": model.query_prefix, "build_seconds": built}
    second = {"rerank": (reranker.name if reranker else None, "string"), "rerank_depth": (rerank_depth if reranker else None, "int")}
    whole = sizes.crossJoin(scores).crossJoin(overlap).crossJoin(facts)
    row = whole.select(*(F.lit(v).alias(c) for c, v in fixed.items()), *(F.lit(v).cast(t).alias(c) for c, (v, t) in second.items()), *whole.columns)
    return row, each.select("query_id", "ndcg")
