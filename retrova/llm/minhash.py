"""MinHash near-duplicates with b-bit signatures.

1. Every document gets its set of word shingles (64-bit hashes), a digest of that set, band keys over 252 minima, and a
   signature that keeps two bits of each of 256 minima.
2. Equal sets are one class, stood for by its smallest id; copies are never expanded into pairs.
3. Classes that share a band key are candidates. In each bucket the smallest class is the hub: the signatures' equal bits,
   corrected for chance collisions, estimate the similarity of hub and member, and each member's smallest likely hub is
   confirmed on the full sets. Components of these links join nearly all near copies, at one comparison each.
4. What is left are buckets where several components meet: their pairs of different components are met block by block,
   likely ones confirmed on the full sets. A pair is met in its first such bucket only. Signatures are sent first, texts only
   for rows of likely pairs; no pair but a confirmed link is ever written, and no bucket is ever collected.
5. Components of all confirmed links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import cut, ship, table
from ._text import NOT_SPACE, Texts, U, blocks, mix, shingles_of, texts_of, words_of
from .graph import Union, by_task, components, few

HASHES, ROWS, BANDS, BITS = 256, 7, 36, 2
#: A pair is confirmed unless its estimate is this far below the threshold: over four standard errors.
MARGIN = 0.12
#: Rows and shingles of a block of a bucket, about; a worker holds two blocks at most.
TASK_ROWS, TASK_SHINGLES = 512, 4_000_000
_ODD = mix(np.arange(1, HASHES + 1, dtype=U)) | U(1)
_ADD = mix(np.arange(1001, HASHES + 1001, dtype=U))
_BAND = mix(np.arange(5001, ROWS + 5001, dtype=U)) | U(1)


def signatures(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(HASHES, documents) minima; every document has a shingle at least."""
    out = np.empty((HASHES, len(first) - 1), U)
    work = np.empty_like(shingles)
    for n in range(HASHES):
        np.multiply(shingles, _ODD[n], out=work)
        np.add(work, _ADD[n], out=work)
        np.minimum.reduceat(work, first[:-1], out=out[n])
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """(documents, BANDS): a key of each band of ROWS minima; the band's number is part of it."""
    keys = np.empty((minima.shape[1], BANDS), U)
    for band in range(BANDS):
        h = np.full(minima.shape[1], band + 1, U)
        for r in range(ROWS):
            h = (h ^ minima[band * ROWS + r]) * _BAND[r]
            h ^= h >> U(29)
        keys[:, band] = mix(h)
    return keys


def pack(minima: np.ndarray) -> np.ndarray:
    """(documents, HASHES * BITS / 64): BITS bits of each minimum."""
    bits = (minima >> U(24)) & U((1 << BITS) - 1)
    each = 64 // BITS
    out = np.zeros((minima.shape[1], HASHES // each), U)
    for n in range(HASHES):
        out[:, n // each] |= bits[n] << U(BITS * (n % each))
    return out


def similarity(differing: np.ndarray) -> np.ndarray:
    """Estimates from the XOR of packed signatures (last axis): the share of equal bit groups, less what chance makes equal."""
    low = U(0x5555555555555555)
    differ = np.bitwise_count((differing | (differing >> U(1))) & low).sum(axis=-1, dtype=np.int64)
    chance = 0.5**BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of each packed signature of a with each of b."""
    out = np.empty((len(a), len(b)))
    for n in range(0, len(a), 64):
        out[n : n + 64] = similarity(a[n : n + 64, None] ^ b[None])
    return out


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in blocks(texts_of(batch.column("text"))):
                shingles, first = shingles_of(words_of(texts, NOT_SPACE), shingle)
                some = np.flatnonzero(np.diff(first))
                number = np.zeros(end - begin, np.int64)
                digest: list = [None] * (end - begin)
                for d in some:
                    own = np.unique(shingles[first[d] : first[d + 1]])
                    number[d] = len(own)
                    digest[d] = xxhash.xxh3_128_digest(own.tobytes())
                keys: list = [None] * (end - begin)
                packed: list = [None] * (end - begin)
                if len(some):
                    minima = signatures(shingles, np.append(first[:-1][some], first[-1]))
                    for d, k, s in zip(some.tolist(), band_keys(minima).view(np.int64), pack(minima), strict=True):
                        keys[d], packed[d] = k, s.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(begin, end - begin), pa.array(number), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())], ["id", "n", "digest", "bands", "bits"])

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def _likely(percent: int):
    """The pairs (a, b) of rows with both signatures and sizes that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (texts_of(batch.column(c)).data.view(U).reshape(batch.num_rows, -1) for c in ("bits_a", "bits_b"))
                n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
                fine = (similarity(x ^ y) >= percent / 100 - MARGIN) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                yield batch.select(["a", "b"]).filter(pa.array(fine))

    return run


def _pairs(rows: pa.Table, percent: int) -> Iterator[tuple[int, int]]:
    """Indices of the pairs to confirm of a pair of blocks: likely ones of two components that share no smaller open key."""
    column = {c: rows.column(c).combine_chunks() for c in ("block", "bits", "n", "comp", "keys", "group", "i", "j")}
    bits, n = texts_of(column["bits"]).data.view(U).reshape(rows.num_rows, -1), column["n"].to_numpy()
    comp = column["comp"].dictionary_encode().indices.to_numpy()
    block, keys, group = column["block"].to_numpy(), column["keys"], column["group"][0].as_py()
    left = np.flatnonzero(block == column["i"][0].as_py())
    right = np.flatnonzero(block == column["j"][0].as_py())
    if not len(left) or not len(right):
        return
    near = estimate(bits[left], bits[right]) >= percent / 100 - MARGIN
    near &= 100 * np.minimum(n[left, None], n[None, right]) >= percent * np.maximum(n[left, None], n[None, right])
    near &= comp[left, None] != comp[None, right]
    for x in np.flatnonzero(near.any(axis=1)).tolist():
        own = set(keys[int(left[x])].as_py())
        for y in np.flatnonzero(near[x]).tolist():
            a, b = int(left[x]), int(right[y])
            if (a < b or column["i"][0] != column["j"][0]) and min(own.intersection(keys[b].as_py())) == group:
                yield a, b


def _involved(percent: int):
    """The rows of a pair of blocks that stand in a pair to confirm."""

    def run(rows: pa.Table) -> pa.RecordBatch:
        some = np.zeros(rows.num_rows, bool)
        for pair in _pairs(rows, percent):
            some[list(pair)] = True
        kept = rows.filter(pa.array(some)).combine_chunks().to_batches()
        return kept[0] if kept else pa.RecordBatch.from_pylist([], rows.schema)

    return run


class _Sets:
    """Sets of shingle hashes of the texts of a task, each made when it is first asked for."""

    def __init__(self, texts: pa.ChunkedArray, shingle: int):
        self.texts, self.shingle, self.have = texts_of(texts.combine_chunks()), shingle, {}

    def __getitem__(self, n: int) -> np.ndarray:
        if n not in self.have:
            a, b = self.texts.offsets[n : n + 2]
            self.have[n] = np.unique(shingles_of(words_of(Texts(self.texts.data[a:b], np.array([0, b - a])), NOT_SPACE), self.shingle)[0])
        return self.have[n]

    def linked(self, a: int, b: int, percent: int) -> bool:
        x, y = self[a], self[b]
        both = _overlap(x, y) if len(x) and len(y) else 0
        return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _links(rows: pa.Table, found: list[tuple[int, int]]) -> pa.RecordBatch:
    ids = rows.column("id").combine_chunks()
    ends = (ids.take(pa.array([p[n] for p in found], pa.int64())) for n in (0, 1))
    return pa.RecordBatch.from_arrays(list(ends), schema=pa.schema([("a", ids.type), ("b", ids.type)]))


def _confirm(shingle: int, percent: int):
    """Of a pair of blocks, confirmed links that connect all components that its confirmed pairs connect."""

    def run(rows: pa.Table) -> pa.RecordBatch:
        sets, found = _Sets(rows.column("text"), shingle), []
        known = Union(rows.num_rows)
        comp = rows.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(comp, kind="stable")
        for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            if comp[a] == comp[b]:
                known.join(a, b)
        for a, b in _pairs(rows, percent):
            if known.find(a) != known.find(b) and sets.linked(a, b, percent):
                known.join(a, b)
                found.append((a, b))
        return _links(rows, found)

    return run


def _confirm_star(shingle: int, percent: int):
    """The confirmed links of a hub (the rows that aren't members) with some of its members."""

    def run(rows: pa.Table) -> pa.RecordBatch:
        member = rows.column("member").to_numpy()
        sets = _Sets(rows.column("text"), shingle)
        hubs = np.flatnonzero(~member).tolist()
        found = []
        for b in np.flatnonzero(member).tolist():
            found += [(a, b) for a in hubs if sets.linked(a, b, percent)][:1]
            sets.have.pop(b, None)
        return _links(rows, found)

    return run


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest id reachable by links) and kept.

    Documents are linked where 100 * |A and B| >= percent * |A or B| for their sets of shingle hashes. The recall of the band
    keys at a similarity s is 1 - (1 - s**7)**36: over 0.999 at 0.8 and 0.999999 at 0.85.

    Null and empty texts have no shingles and are linked with nothing; one of fewer words than a shingle has one of all its
    words. Rows without an id are kept and linked with nothing; rows that share an id count as one document in the links, and
    each is returned. Other columns are ignored.
    """
    if shingle < 1 or not 0 < percent <= 100:
        raise ValueError("shingle must be positive and percent in 1 .. 100")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = T.StructField("id", rows.schema["id"].dataType)
    of = lambda *fields: T.StructType([T.StructField(n, t) for n, t in fields])
    sketch = of(("id", kind.dataType), ("n", T.LongType()), ("digest", T.BinaryType()), ("bands", T.ArrayType(T.LongType())), ("bits", T.BinaryType()))
    ends = of(("a", kind.dataType), ("b", kind.dataType))
    sketched = cut(rows.mapInArrow(_sketch(shingle), sketch))
    sets = sketched.filter("digest is not null and id is not null")
    copies = few(sets.groupBy("digest").agg(F.min("id").alias("stands"), F.count("*").alias("size")).filter("size > 1").select("digest", "stands"))
    whole = sets.join(copies, "digest", "left")
    facts = ["id", "n", "bits"]
    alone, lead = whole.filter("stands is null"), whole.filter("stands = id").dropDuplicates(["digest"])
    leaders = cut(alone.select(*facts, "bands").unionByName(lead.select(*facts, "bands")))
    members = sketched.select("id", "n", "digest").join(copies, "digest", "left").select("id", "n", F.when(F.col("digest").isNotNull(), F.coalesce("stands", "id")).alias("stands"))

    banded = leaders.select("id", "n", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).filter("size > 1").select("key", "hub")
    shared = cut(banded.join(hubs, "key").select("key", "hub", "id", "n"))
    links = cut(_star_links(shared, leaders.select(*facts), rows, ends, shingle, percent))
    parts = components(links)
    more = _other_links(shared, parts, leaders.select(*facts), rows, ends, shingle, percent)
    found = components(links.unionByName(more)).select(F.col("node").alias("stands"), "component")
    component = F.coalesce("component", "stands", "id")
    return members.join(found, "stands", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _star_links(shared: DataFrame, facts: DataFrame, rows: DataFrame, ends: T.StructType, shingle: int, percent: int) -> DataFrame:
    """Confirmed links of documents with the smallest hub of their buckets that is likely to be near: one a document at most."""
    star = cut(shared.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    of = lambda x: facts.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    likely = star.join(of("b"), "b").join(of("a"), "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_likely(percent), ends)
    first = cut(likely.groupBy("b").agg(F.min("a").alias("a")))
    slots = few(first.groupBy("a").agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("slots")).filter("slots > 1"))
    slot = F.pmod(F.xxhash64("b"), F.coalesce("slots", F.lit(1))).cast("int")
    dealt = first.join(slots, "a", "left").select(F.col("a").alias("group"), slot.alias("i"), F.lit(0).alias("j"), F.col("b").alias("id"), F.lit(True).alias("member"))
    heads = dealt.select("group", "i", "j").distinct().withColumn("id", F.col("group")).withColumn("member", F.lit(False))
    return by_task(dealt.unionByName(heads).join(rows, "id").select("group", "i", "j", "id", "member", "text"), _confirm_star(shingle, percent), ends)


def _other_links(shared: DataFrame, parts: DataFrame, facts: DataFrame, rows: DataFrame, ends: T.StructType, shingle: int, percent: int) -> DataFrame:
    """Confirmed links between the components that meet in a bucket.

    Of an open bucket, one of two components or more, the largest component is dealt into blocks of its own, which meet only
    the blocks of the others. Signatures go first; texts only follow for rows that stand in a likely pair.
    """
    tagged = cut(shared.join(parts, shared["id"] == parts["node"], "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp")))
    each = tagged.groupBy("key", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    each = each.groupBy("key").agg(F.max(F.struct("size", "comp", "n")).alias("main"), F.sum("size").alias("size"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    blocks_ = lambda size, n: F.greatest(F.ceil(size / TASK_ROWS), F.ceil(n / TASK_SHINGLES)).cast("int")
    main = F.col("main")
    open_ = few(each.select("key", main["comp"].alias("main"), blocks_(main["size"], main["n"]).alias("wide"), blocks_(F.col("size") - main["size"], F.col("n") - main["n"]).alias("rest")))
    inside = cut(tagged.join(open_, "key").select("key", "id", "comp", (F.col("comp") == F.col("main")).alias("large"), "wide", "rest"))
    keys = inside.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))  # BANDS at most
    block = F.pmod(F.xxhash64("id"), F.when(F.col("large"), F.col("wide")).otherwise(F.col("rest"))).cast("int") + F.when(F.col("large"), F.col("rest")).otherwise(0)
    others = F.sequence(F.lit(0), F.col("rest") + F.when(F.col("large"), 0).otherwise(F.col("wide")) - 1)
    dealt = inside.join(keys, "id").join(facts, "id").select(F.col("key").alias("group"), "id", "comp", "n", "bits", "keys", block.alias("block"), F.explode(others).alias("other"))
    dealt = dealt.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "comp", "n", "bits", "keys", "block")
    involved = cut(by_task(dealt, _involved(percent), dealt.schema))
    return by_task(involved.join(rows, "id"), _confirm(shingle, percent), ends)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, similarity of 85 % or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
