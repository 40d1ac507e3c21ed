"""Near-duplicate vectors by p-stable hashing for the Euclidean distance, confirmed by exact cosines.

A hash of a normalised vector v is floor((a . v + b) / WIDTH) with a Gaussian (2-stable) direction a and a seeded shift b; a
table's key joins `k` of them. k grows with the logarithm of the number of vectors, so that about BUCKET unrelated vectors
share a bucket at every size (of 32-bit keys), and the number of tables follows from k and the wanted recall. All pairs of a bucket are
multiplied out block by block in double precision; a pair that shares several buckets counts in the first only. Equal vectors
are one class and never expanded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import cut, ship, table
from ._text import U, mix, texts_of
from .graph import Union, components, in_block_pairs

WIDTH = 2.5
BUCKET = 256
#: Of the pairs at the threshold itself, found by the tables; nearer pairs are found with far higher probability.
RECALL = 0.995
SEED = 20_240_229
BLOCK = 256


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one hash puts two points of this distance together."""
    if distance <= 0:
        return 1.0
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """Hashes of a key and number of tables for n vectors: unrelated vectors are at distance sqrt(2)."""
    k = max(1, math.ceil(math.log(max(n, 1) / BUCKET) / -math.log(collision(math.sqrt(2)))))
    near = collision(math.sqrt(max(0.0, 2 - 2 * cosine))) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near))) if near < 1 else 1


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the largest component is divided out first, so that nothing overflows."""
    m = m.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each dimension: the rows whose vectors are usable, and these."""
    if pa.types.is_null(column.type):
        return
    offsets = column.offsets.to_numpy()
    flat = column.values
    kind = flat.type.to_pandas_dtype() if pa.types.is_floating(flat.type) else np.float64
    values = flat.cast(pa.from_numpy_dtype(kind)).to_numpy(zero_copy_only=False)  # a null component becomes NaN
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        m = values[offsets[rows][:, None] + np.arange(d)]
        fine = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
        if fine.any():
            yield rows[fine], m[fine]


def _hash(k: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            digest: list = [None] * batch.num_rows
            vector: list = [None] * batch.num_rows
            keys: list = [None] * batch.num_rows
            for rows, m in _matrices(batch.column("v")):
                d = m.shape[1]
                if d not in shapes:
                    rng = np.random.default_rng([seed, d])
                    shapes[d] = rng.standard_normal((d, k * tables)), rng.uniform(0, WIDTH, k * tables)
                a, b = shapes[d]
                cells = np.floor((unit(m) @ a + b) / WIDTH).astype(np.int64).view(U).reshape(len(m), tables, k)
                h = np.full((len(m), tables), U(d))
                for n in range(k):
                    h = mix(h ^ (cells[:, :, n] * U(0x9E3779B97F4A7C15)))
                m = m + m.dtype.type(0)  # -0.0 and 0.0 are one class
                for r, v, x in zip(rows.tolist(), m, (h >> U(32)).astype(np.uint32).view(np.int32), strict=True):
                    vector[r], keys[r] = v.tobytes(), x
                    digest[r] = xxhash.xxh3_128_digest(vector[r])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digest, pa.binary()), pa.array(vector, pa.binary()), pa.array(keys, pa.list_(pa.int32()))], ["id", "digest", "vector", "keys"])

    return run


def _multiply(cosine: float, kind: np.dtype):
    """Of a pair of blocks of a bucket: how many vectors each links with (b null), and links that connect the same (n = 0)."""

    def run(rows: pa.Table) -> pa.RecordBatch:
        of = rows.schema.field("id").type
        column = {name: rows.column(name).combine_chunks() for name in rows.schema.names}
        ids = column["id"]
        block, size, here = (column[name].to_numpy() for name in ("block", "size", "nth"))
        raw = texts_of(column["vector"])
        width = np.diff(raw.offsets)
        if (width != width[0]).any():  # two dimensions under one key
            parts = [run(rows.filter(pa.array(width == w))) for w in np.unique(width)]
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        keys = column["keys"].flatten().to_numpy().reshape(len(ids), -1)
        v = unit(raw.data.view(kind).reshape(len(ids), -1))
        within = rows.column("i")[0] == rows.column("j")[0]
        left = np.arange(len(ids)) if within else np.flatnonzero(block == block.min())
        right = left if within else np.flatnonzero(block != block.min())
        near = v[left] @ v[right].T >= cosine
        if within:
            near = np.triu(near, 1)
        x, y = np.nonzero(near)
        x, y = left[x], right[y]
        if here[0]:
            new = ~(keys[x, : here[0]] == keys[y, : here[0]]).any(axis=1)
            x, y = x[new], y[new]
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, x, size[y])
        np.add.at(count, y, size[x])
        known = Union(len(ids))
        tree = [(p, q) for p, q in zip(x.tolist(), y.tolist(), strict=True) if known.join(p, q)]
        some = np.flatnonzero(count)
        a = np.concatenate([np.array([p for p, _ in tree], np.int64), some])
        b = pa.array([q for _, q in tree] + [None] * len(some), pa.int64())
        n = np.concatenate([np.zeros(len(tree), np.int64), count[some]])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(b), pa.array(n)], schema=pa.schema([("a", of), ("b", of), ("n", pa.int64())]))

    return run


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.9, recall: float = RECALL, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links (other vectors with at least this cosine that were found), component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do vectors of different
    dimensions with each other. Ties and repeated vectors link by their cosine of 1. Rows without an id are returned with no
    links; ids are expected to be distinct, and rows that share one are each returned. Other columns are ignored.
    """
    if not 0 < cosine <= 1 or not 0 < recall < 1:
        raise ValueError("cosine must be in (0, 1] and recall in (0, 1)")
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind, element = rows.schema["id"].dataType, rows.schema["v"].dataType.elementType
    k, tables = plan(rows.count(), cosine, recall)
    hashed_type = T.StructType([T.StructField("id", kind), T.StructField("digest", T.BinaryType()), T.StructField("vector", T.BinaryType()), T.StructField("keys", T.ArrayType(T.IntegerType()))])
    hashed = cut(rows.mapInArrow(_hash(k, tables, seed), hashed_type))
    usable = hashed.filter("digest is not null and id is not null")
    classes = usable.groupBy("digest").agg(F.min("id").alias("stands"), F.count("*").alias("size"))
    members = hashed.select("id", "digest").join(classes, "digest", "left").select("id", "stands", "size")
    leaders = usable.join(classes, "digest").filter("id = stands").dropDuplicates(["id"]).select("id", "size", "vector", "keys")
    group = F.shiftleft(F.col("nth").cast("long"), 32).bitwiseOR(F.col("key").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    keyed = leaders.select("*", F.posexplode("keys").alias("nth", "key")).withColumn("group", group)
    shared = leaders.select(F.posexplode("keys").alias("nth", "key")).select(group.alias("group")).groupBy("group").count().filter("count > 1").select("group")
    grouped = keyed.join(shared, "group", "left_semi")
    type_ = np.dtype(np.float32 if isinstance(element, T.FloatType) else np.float64)
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("n", T.LongType())])
    found = cut(in_block_pairs(grouped, ["size", "vector", "keys", "nth"], BLOCK, _multiply(cosine, type_), out))
    counts = found.filter("b is null").groupBy(F.col("a").alias("stands")).agg(F.sum("n").alias("others"))
    parts = components(found.filter("b is not null")).select(F.col("node").alias("stands"), "component")
    component = F.coalesce("component", "stands", "id")
    links = F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))
    return members.join(counts.join(parts, "stands"), "stands", "left").select(F.col("id").alias("vec_id"), links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of the whole table, whatever their labels: cosine of 0.9 or more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
