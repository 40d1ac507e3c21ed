"""Incremental ingest into a passage store: new documents are chunked and numbered on from what is there.

A store is a folder of versions, each with what it adds as Parquet tables and a manifest written last, which names the
versions whose tables make up the store. The newest version with a manifest is the store, so a crash leaves the one before.
Adding writes only what is new; after MOST_PARTS additions a version takes in those before it. Readers hold a version; there
is one writer.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNKS = "vec_id long, chunk_id string, doc_id string, text string"
TITLES = "doc_id string, title string"


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], CHUNKS), spark.createDataFrame([], TITLES)


def deduped(docs: DataFrame) -> DataFrame:
    """docs(seq, id, title, text): of rows with one id the last value, at the first one's place."""
    own = F.max(F.struct("seq", F.coalesce("title", F.lit("")).alias("title"), "text")).alias("v")
    return docs.groupBy(F.col("id").cast("string").alias("doc_id")).agg(F.min("seq").alias("place"), own).select("place", "doc_id", "v.title", "v.text")


def added(docs: DataFrame, chunks: DataFrame, titles: DataFrame, chunker: Callable[[DataFrame], DataFrame], held: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new chunks, new titles): known documents are skipped; vec_id goes on from the largest there.

    If no new document has a passage, nothing is recorded; else those without one are recorded by their title too. Numbering
    is one running count over the new passages: partial counts by bucket of place, then an offset each, not one sorted task.
    What is new is found once and kept on disk, and its passages are counted without their texts being shuffled; `held` gets
    the frames that are kept, to be let go of when the results are written.
    """
    new = deduped(docs).join(titles, "doc_id", "left_anti").persist(StorageLevel.DISK_ONLY)
    text = F.when(F.col("title") != "", F.concat("title", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    pieces = chunker(new.select("doc_id", text.alias("text")))
    start = chunks.agg(F.coalesce(F.max("vec_id") + 1, F.lit(0)).alias("start"))
    counted = pieces.groupBy("doc_id").agg(F.count("*").alias("n"))
    per_doc = counted.join(new.select("doc_id", "place"), "doc_id").withColumn("bucket", F.floor(F.col("place") / 10_000)).persist()
    buckets = per_doc.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_doc.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(buckets.select("bucket", "before"), "bucket").select("doc_id", (F.col("own") + F.col("before")).alias("offset"))
    numbered = pieces.join(offsets, "doc_id").crossJoin(F.broadcast(start))
    some = per_doc.select("doc_id").limit(1).select(F.lit(True).alias("some"))
    out = numbered.select((F.col("start") + F.col("offset") + F.col("pos")).alias("vec_id"), "chunk_id", "doc_id", "text")
    if held is not None:
        held += [new, per_doc]
    return out, new.select("doc_id", "title").crossJoin(F.broadcast(some)).drop("some")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions of a store, oldest first: those whose manifest was written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    names = [s.getPath() for s in fs.listStatus(hadoop)]
    whole = [p.getName() for p in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "manifest/_SUCCESS"))]
    return sorted(int(n[1:]) for n in whole if n[:1] == "v" and n[1:].isdigit())


#: Versions that a store is read from at most, before one is written that holds them all.
MOST_PARTS = 50
#: Documents that `build` adds at a time.
BUILD_BATCH = 256


def _manifest(spark: SparkSession, place: str) -> dict:
    """What a version's manifest says; ValueError if it can't be read."""
    lines = [r.value for r in spark.read.text(f"{place}/manifest").collect()]
    try:
        facts = json.loads("".join(lines))
        return {**facts, "parts": [int(n) for n in facts["parts"]], "chunks": int(facts["chunks"])}
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError(f"the manifest in {place} is corrupt") from error


def _written(chunks: DataFrame, titles: DataFrame, folder: str, version: int, before: dict, **names: str) -> int | None:
    """Write a version's own tables, then its manifest. `before` has the parts and the passages that it goes on from.

    A version that adds no title to those before gets no manifest and isn't there (None).
    """
    spark, place = chunks.sparkSession, f"{folder}/v{version}"
    chunks.write.mode("overwrite").parquet(f"{place}/chunks")
    titles.write.mode("overwrite").parquet(f"{place}/titles")
    if before["parts"] and not spark.read.parquet(f"{place}/titles").take(1):
        return None
    own = spark.read.parquet(f"{place}/chunks").count()
    facts = {**names, "parts": [*before["parts"], version], "chunks": before["chunks"] + own}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}/manifest")
    return version


def save(chunks: DataFrame, titles: DataFrame, folder: str, *, embedder: str, chunker: str) -> int | None:
    """Write the next version, which holds these tables alone."""
    version = (_versions(chunks.sparkSession, folder) or [0])[-1] + 1
    return _written(chunks, titles, folder, version, {"parts": [], "chunks": 0}, embedder=embedder, chunker=chunker)


def extend(new_chunks: DataFrame, new_titles: DataFrame, folder: str, *, embedder: str, chunker: str) -> int | None:
    """Write the next version: the newest one and these rows, of which only the rows are written. None if there are none."""
    spark = new_chunks.sparkSession
    versions = _versions(spark, folder)
    if not versions:
        return save(new_chunks, new_titles, folder, embedder=embedder, chunker=chunker)
    before = _manifest(spark, f"{folder}/v{versions[-1]}")
    if len(before["parts"]) >= MOST_PARTS:
        chunks, titles = load(spark, folder, embedder=embedder, chunker=chunker)
        return save(chunks.unionByName(new_chunks), titles.unionByName(new_titles), folder, embedder=embedder, chunker=chunker)
    return _written(new_chunks, new_titles, folder, versions[-1] + 1, before, embedder=embedder, chunker=chunker)


def load(spark: SparkSession, folder: str, *, embedder: str, chunker: str) -> tuple[DataFrame, DataFrame]:
    """The newest complete version; ValueError if there is none, or it is corrupt or of another embedder or chunker."""
    versions = _versions(spark, folder)
    if not versions:
        raise ValueError(f"no complete store in {folder}")
    place = f"{folder}/v{versions[-1]}"
    facts = _manifest(spark, place)
    for name, own in (("embedder", embedder), ("chunker", chunker)):
        if facts.get(name) != own:
            raise ValueError(f"the store's {name} is {facts.get(name)!r}, not {own!r}")
    chunks, titles = (spark.read.parquet(*(f"{folder}/v{n}/{table}" for n in facts["parts"])) for table in ("chunks", "titles"))
    if chunks.count() != facts["chunks"]:
        raise ValueError(f"{place} should hold {facts['chunks']} passages")
    return chunks, titles


def add(docs: DataFrame, folder: str, chunker: Callable[[DataFrame], DataFrame], *, embedder: str, chunker_name: str, vectors: Callable[[DataFrame], DataFrame] | None = None) -> int | None:
    """Add docs(seq, id, title, text) to a store. `vectors` adds columns to the new passages, such as their embedding.

    The version, or None where no document was new: the store stays as it is.
    """
    spark = docs.sparkSession
    names = {"embedder": embedder, "chunker": chunker_name}
    chunks, titles = load(spark, folder, embedder=embedder, chunker=chunker_name) if _versions(spark, folder) else empty(spark)
    held: list[DataFrame] = []
    new_chunks, new_titles = added(docs, chunks.select("vec_id", "chunk_id", "doc_id", "text"), titles, chunker, held)
    try:
        return extend(vectors(new_chunks) if vectors else new_chunks, new_titles, folder, **names)
    finally:
        for frame in held:
            frame.unpersist()


def build(docs: DataFrame, folder: str, chunker: Callable[[DataFrame], DataFrame], *, embedder: str, chunker_name: str, vectors: Callable[[DataFrame], DataFrame] | None = None, batch: int = BUILD_BATCH, progress: Callable[[int, int], None] = lambda done, total: None) -> None:
    """Add docs in batches of `batch` sequence numbers, as a service does while it tells how far it is.

    Each batch is a version of its own, so a build that was lost goes on where it ended. For a whole corpus take one `add`.
    """
    low, high, total = docs.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    done = 0
    progress(done, total)
    for start in range(low, high + 1, batch) if total else ():
        part = docs.filter(F.col("seq").between(start, start + batch - 1))
        add(part, folder, chunker, embedder=embedder, chunker_name=chunker_name, vectors=vectors)
        done += part.count()
        progress(done, total)


def ingest_stream(stream: DataFrame, folder: str, chunker: Callable[[DataFrame], DataFrame], *, embedder: str, chunker_name: str, checkpoint: str):
    """Add a stream of docs(seq, id, title, text) to a store, a version a micro-batch, until what is available is used up.

    A micro-batch that is run again finds its documents known and adds nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        add(batch, folder, chunker, embedder=embedder, chunker_name=chunker_name)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stats(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    return titles.agg(F.count("*").alias("documents")).crossJoin(chunks.agg(F.count("*").alias("chunks")))
