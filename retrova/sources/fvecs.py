"""Vector files: each row an int32 dimension and that many float32, little-endian."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(raw: bytes, most: int | None = None) -> np.ndarray:
    """The rows of a file, the first `most` at most; ValueError if a row's header differs from the first."""
    if not raw:
        return np.zeros((0, 0), np.float32)
    (dim,) = struct.unpack_from("<i", raw)
    if dim <= 0 or len(raw) % (4 * (dim + 1)):
        raise ValueError("not a vector file")
    rows = np.frombuffer(raw, "<f4").reshape(-1, dim + 1)[:most]
    if (rows[:, 0].view("<i4") != dim).any():
        raise ValueError("rows of different dimensions")
    return rows[:, 1:]


def decode(files: DataFrame, most: int | None = None) -> DataFrame:
    """vectors(file, vec_id, embedding) of files(path, content); vec_id counts from 0 in each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = parse(raw, most)
                for i in range(0, len(v), 10_000):
                    part = v[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(range(i, i + len(part)), pa.int64()), pa.array(part.tolist(), pa.list_(pa.float32()))], ["file", "vec_id", "embedding"])

    return files.select("path", "content").mapInArrow(run, "file string, vec_id long, embedding array<float>")


def read(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The vectors of a file or folder. A file is one task's work: split large sets into files."""
    return decode(spark.read.format("binaryFile").load(path), most)


def load_pair(spark: SparkSession, folder: str, name: str = "sift", most: tuple[int | None, int | None] = (None, None)) -> tuple[DataFrame, DataFrame]:
    """(base, queries) of a data set's folder: name_base.fvecs and name_query.fvecs, the first `most` rows of each."""
    return tuple(read(spark, f"{folder}/{name}_{part}.fvecs", n).select("vec_id", "embedding") for part, n in zip(("base", "query"), most, strict=True))


def encode(rows: DataFrame, file: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """files(path, content): the bytes of a vector file for each value of `file`, rows in the order of their ids.

    Choose `file` so that one file's rows fit a task.
    """
    number = lambda x: F.array_join(F.reverse(F.regexp_extract_all(x, F.lit(".."), F.lit(0))), "")
    head = number(F.lpad(F.hex(F.size(vector_col)), 8, "0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(v, "<f4").tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("id"), batch.column("head"), pa.array(raw, pa.binary())], ["path", "id", "head", "raw"])

    shape = rows.select(file.cast("string").alias("path"), F.col(id_col).cast("long").alias("id"), F.unhex(head).alias("head"), F.col(vector_col).alias("v"))
    packed = shape.mapInArrow(run, "path string, id long, head binary, raw binary")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("id", F.concat("head", "raw").alias("b")))), lambda x: x["b"])
    return packed.groupBy("path").agg(F.aggregate(parts, F.lit(b""), lambda s, b: F.concat(s, b)).alias("content"))
