"""Line deduplication over content-defined chunks of lines.

A line ends at a line feed; paragraphs are wrapped at spaces whose neighbouring letters hash to a multiple of WRAP, or of 2
after punctuation, so that a passage inside a paragraph has lines too, of about four words. Runs of UNSPACED bytes without a
space (Chinese, Japanese, Thai) are wrapped between characters in the same way. A rolling hash over the hashes of two
neighbouring lines decides where chunks end: after a line where it is smaller than at the lines before and after. The cut
depends on four lines only, so an insertion moves no cut but those beside it. Paragraphs of PARAGRAPH words are also cut at
their own ends. Where lines are so short that no chunk is long enough (lists, code), a second division counts, whose cuts are
smaller than at RADIUS lines on either side.

1. One pass counts the hashes of all chunks of two lines and `least_words` words or more (one line, if it is a paragraph).
2. A bit table of fixed size says which hashes may be repeated; a second pass emits the bytes of those chunks only, which are
   grouped by hash and bytes: what is removed has been compared byte for byte. Where two hashes share a bit, a chunk is
   emitted in vain, no more.
3. All occurrences but the first, by id and place, go; so do the lines beside them up to the first that differs from its
   counterpart beside the first occurrence, or to the next chunk that goes: the ends of a passage that chunks don't meet. The
   lines are fetched by place, REACH of them and in further rounds the square of the last number where all were equal.
4. What goes in one run has LEAST_RUN words at least: phrases that merely recur stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import cut, release, ship, table, with_rest
from ._text import Texts, U, blocks, hash_spans, mix, spans_of, texts_of
from .graph import few

LEAST_WORDS = 8
PARAGRAPH = 20
WRAP = 6
#: Bytes of a run without a space from which it is wrapped, and one in how many of its characters ends a line.
UNSPACED, WRAP_CHARS = 64, 12
#: Lines on either side that a cut of the second division is compared with.
RADIUS = 4
#: Words of a run of lines that goes. Where spaces are rare, eight bytes count as a word.
LEAST_RUN = 20
#: Lines that are compared at first beside a chunk that goes, and at most; their number is squared while all are equal.
REACH, FARTHEST = 8, 1 << 24
#: Bytes that Spark's hash table of a list joined to the documents may take in the driver; beyond it the join shuffles.
BROADCAST_BYTES = 32_000_000
#: Binary logarithm of the most bits of the table of repeated hashes: 2**29 bits are 64 MB. It has 32 to 64 bits a hash, until
#: 16 million hashes repeat; beyond that more chunks are emitted in vain.
TABLE = 29
#: Binary logarithm of the most 64-bit words of that table that the driver holds at once: what it has fetched goes out as a
#: broadcast of its own. Executors make the table in at most 2**PIECES pieces, so no row of Spark's stands for a single word.
FETCHED, PIECES = 20, 10
_STOP = np.zeros(256, bool)
_STOP[list(b".!?,;:")] = True


class Spans(NamedTuple):
    """Where the lines of a block of texts are. Line n is the bytes start[n] .. end[n] without what follows up to the next line."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first line of each text
    words: np.ndarray


class Lines(NamedTuple):
    """Spans, and what chunks are made of."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    roll: np.ndarray  # hash of the cut after each line
    forced: np.ndarray  # whether there is a cut after it in any case
    words: np.ndarray


class Chunks(NamedTuple):
    head: np.ndarray  # first line of each chunk, and a last entry
    first: np.ndarray  # first chunk of each text
    hash: np.ndarray
    fit: np.ndarray  # chunks long enough to be removed


def _breaks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the two bytes before and after each place."""
    near = sum(data[at + by].astype(np.uint32) * np.uint32(k) for by, k in ((-2, 0x9E3779B1), (-1, 0x85EBCA6B), (1, 0xC2B2AE35), (2, 0x27D4EB2F)))
    return ((near ^ (near >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(12)


def line_spans(texts: Texts) -> Spans:
    data, n = texts.data, len(texts.data)
    solid = (data != 32) & ((data < 9) | (data > 13))  # as NOT_SPACE, without a lookup a byte
    brk = data == 10
    word, stop = spans_of(solid, texts.offsets)
    if n:
        space = data == 32
        for by in (-2, -1, 0, 1):  # the two bytes on either side are of the same text, whatever texts are beside it
            space[np.clip(texts.offsets + by, 0, n - 1)] = False
        gap = np.flatnonzero(space)
        near = _breaks(data, gap)
        brk[gap[np.where(_STOP[data[gap - 1]], near % np.uint32(2), near % np.uint32(WRAP)) == 0]] = True
        unspaced = stop - word >= UNSPACED
        for a, b in zip(word[unspaced].tolist(), stop[unspaced].tolist(), strict=True):
            char = np.flatnonzero((data[a + 3 : b - 3] & 0xC0) != 0x80) + a + 3  # characters that begin well inside
            brk[char[_breaks(data, char) % WRAP_CHARS == 0] - 1] = True
        brk[texts.offsets[1:][texts.offsets[1:] > 0] - 1] = True
    edge = np.flatnonzero(brk) + 1
    start = np.concatenate([[0], edge[:-1]]) if len(edge) else edge
    last = np.searchsorted(word, edge) - 1  # a line ends with the last word that begins before its break
    end = np.where(last >= 0, np.minimum(np.append(stop, 0)[last], edge), 0)
    full = end > start
    start, end = start[full], end[full]
    words = np.maximum(np.diff(np.searchsorted(word, np.append(start, n))), (end - start) // 8)
    return Spans(start, end, np.searchsorted(start, texts.offsets), words)


def lines_of(texts: Texts) -> Lines:
    data = texts.data
    start, end, first, words = line_spans(texts)
    h = hash_spans(data, start, end)
    final = first[1:][first[1:] > first[:-1]] - 1
    roll = mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
    roll = np.append(roll, U(0)) if len(h) else h
    # paragraphs: runs of lines without a line feed or the end of a text between
    feed = data == 10
    feed[texts.offsets[1:][texts.offsets[1:] > 0] - 1] = True
    feeds = np.searchsorted(np.flatnonzero(feed), start)
    ends = np.append(feeds[1:] != feeds[:-1], True) if len(h) else np.zeros(0, bool)
    forced = np.zeros(len(h), bool)
    if len(h):
        tail = np.flatnonzero(ends)
        begin = np.concatenate([[0], tail[:-1] + 1])
        long = np.add.reduceat(words, begin) >= PARAGRAPH
        forced[tail[long]] = True
        forced[begin[long & (begin > 0)] - 1] = True
        forced[final] = True
    return Lines(start, end, first, h, roll, forced, words)


def _cut_at(ends: np.ndarray, lines: Lines, least_words: int) -> Chunks:
    head = np.concatenate([[0], np.flatnonzero(ends) + 1])
    size = np.diff(head)
    if not len(size):
        return Chunks(head, np.searchsorted(head[:-1], lines.first), lines.hash, np.zeros(0, bool))
    place = np.arange(len(ends)) - np.repeat(head[:-1], size)
    total = np.add.reduceat(mix(lines.hash ^ mix(place.astype(U) + U(1))), head[:-1])
    words = np.add.reduceat(lines.words, head[:-1])
    fit = (words >= least_words) & ((size > 1) | (words >= PARAGRAPH))
    return Chunks(head, np.searchsorted(head[:-1], lines.first), mix(total + size.astype(U)), fit)


def divisions(lines: Lines, least_words: int = LEAST_WORDS) -> Iterator[Chunks]:
    """The chunks of the lines, and those of the second division that hold no chunk that fits."""
    roll, n = lines.roll, len(lines.roll)
    ends = lines.forced.copy()
    if n > 2:
        low = (roll[1:-1] < roll[:-2]) & (roll[1:-1] < roll[2:])
        ends[1:-1] |= low & ~lines.forced[:-2] & ~lines.forced[2:]  # no chunk of one line beside a forced cut
    chunks = _cut_at(ends, lines, least_words)
    yield chunks
    covered = np.repeat(chunks.fit, np.diff(chunks.head)) if n else np.zeros(0, bool)
    if n <= 2 * RADIUS or covered.all():
        return
    low = np.ones(n, bool)
    for by in range(1, RADIUS + 1):
        low[by:] &= (roll[by:] < roll[:-by]) & ~lines.forced[:-by]
        low[:-by] &= (roll[:-by] < roll[by:]) & ~lines.forced[by:]  # so that no text's cuts depend on the next text
    low[:RADIUS] = low[-RADIUS:] = False
    wide = _cut_at(low | lines.forced, lines, least_words)
    yield wide._replace(fit=wide.fit & ~np.maximum.reduceat(covered, wide.head[:-1]))


def _listed(least_words: int):
    """The hashes of chunks long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in blocks(texts_of(batch.column("text"))):
                lines = lines_of(texts)
                for c in divisions(lines, least_words):
                    yield pa.RecordBatch.from_arrays([pa.array(c.hash[c.fit].view(np.int64))], ["hash"])

    return run


def _may_repeat(bits: list[Broadcast], hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes have their bit in the table, whose parts are of equal size."""
    each = len(bits[0].value).bit_length() - 1
    at = hashes >> U(64 - (len(bits).bit_length() - 1 + each + 6))
    word, out = at >> U(6), np.zeros(len(hashes), bool)
    for n, part in enumerate(bits):
        here = np.flatnonzero(word >> U(each) == U(n))
        out[here] = (part.value[word[here] & U((1 << each) - 1)] >> (at[here] & U(63))) & U(1)
    return out


def _fetched(bits: list[Broadcast], least_words: int):
    """The bytes of the chunks that may be repeated, with the line each begins at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in blocks(texts_of(batch.column("text"))):
                lines = lines_of(texts)
                raw = texts.data.tobytes()
                line = lambda n: raw[lines.start[n] : lines.end[n]]  # noqa: B023, E731
                for c in divisions(lines, least_words):
                    fit = np.flatnonzero(c.fit)
                    some = fit[_may_repeat(bits, c.hash[fit])]
                    text = np.searchsorted(c.first, some, "right") - 1
                    body = []
                    for n in some.tolist():
                        body.append(b"\n".join(line(x) for x in range(int(c.head[n]), int(c.head[n + 1]))))
                    at, size = c.head[some] - lines.first[text], np.diff(c.head)[some]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i).take(pa.array(text)), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(c.hash[some].view(np.int64)), pa.array(body, pa.binary())], ["id", "at", "size", "hash", "body"])

    return run


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that `asked` (place, number times the step of -1 or 1, kind, and so on) names, those nearest to the place first."""
    for batch in batches:
        whole = batch.column("asked")
        for i, j, texts in blocks(texts_of(batch.column("text"))):
            lines, asked = line_spans(texts), whole.slice(i, j - i).to_pylist()
            raw = texts.data.tobytes()
            text, place, step, kind, out = [], [], [], [], []
            for d in range(j - i):
                low, high = int(lines.first[d]), int(lines.first[d + 1])
                for p, number, k in zip(asked[d][::3], asked[d][1::3], asked[d][2::3], strict=True):
                    at = low + p
                    some = range(at - 1, max(low, at + number) - 1, -1) if number < 0 else range(at, min(high, at + number))
                    text.append(d), place.append(p), step.append(-1 if number < 0 else 1), kind.append(k), out.append([raw[lines.start[x] : lines.end[x]] for x in some])
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i).take(pa.array(text, pa.int64())), pa.array(place, pa.int32()), pa.array(step, pa.int32()), pa.array(kind, pa.int32()), pa.array(out, pa.list_(pa.binary()))], ["of", "place", "step", "kind", "lines"])


def _pieces(size: int, piece: int):
    """The pieces of 2**piece words, of a table of 2**size bits, that hold the bits of hashes: number and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.sort(batch.column("hash").to_numpy().view(U) >> U(64 - size))
            if not len(at):
                continue
            begin = np.flatnonzero(np.append(True, at[1:] >> U(6) != at[:-1] >> U(6)))
            bits, word = np.bitwise_or.reduceat(U(1) << (at & U(63)), begin), (at[begin] >> U(6)).astype(np.int64)
            of, first = np.unique(word >> piece, return_index=True)
            for n, a, b in zip(of.tolist(), first, np.append(first[1:], len(word)), strict=True):
                held.setdefault(n, np.zeros(1 << piece, U))[word[a:b] - (n << piece)] |= bits[a:b]
        for n, words in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([words.tobytes()], pa.binary())], ["piece", "bits"])

    return run


def _table(repeated: DataFrame) -> list[Broadcast]:
    """The bit table of hashes, its size by their number, in parts of 2**FETCHED words: the driver holds no more at once."""
    size = min(TABLE, max(7, repeated.count().bit_length() + 5))
    part = min(FETCHED, size - 6)
    piece = min(part, max(0, size - 6 - PIECES))
    number = F.shiftright(F.shiftrightunsigned("hash", 64 - size), 6 + piece)
    pieces = cut(repeated.repartition(number).mapInArrow(_pieces(size, piece), "piece long, bits binary"))
    out = []
    for n in range(1 << (size - 6 - part)):
        words = np.zeros(1 << part, U)
        some = pieces.filter(F.shiftright("piece", part - piece) == n).toArrow()
        for at, held in zip(some["piece"].to_pylist(), some["bits"], strict=True):
            begin = (at << piece) - (n << part)
            words[begin : begin + (1 << piece)] = np.frombuffer(held.as_buffer(), U)
        out.append(repeated.sparkSession.sparkContext.broadcast(words))
    return out


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without the lines that `gone` (first line, number, and so on) names."""
    for batch in batches:
        rest = ["rest"] * ("rest" in batch.schema.names)
        whole = batch.column("text")
        for i, j, texts in blocks(texts_of(whole)):
            lines, gone = line_spans(texts), batch.column("gone").slice(i, j - i).to_pylist()
            out, removed = whole.slice(i, j - i).to_pylist(), np.zeros(j - i, np.int64)
            for d in range(j - i):
                low, high = int(lines.first[d]), int(lines.first[d + 1])
                drop = np.zeros(high - low, bool)
                if not gone[d]:
                    continue
                for a, number in zip(gone[d][::2], gone[d][1::2], strict=True):
                    drop[a : a + number] = True
                for a, b in zip(*(x.tolist() for x in spans_of(drop, np.array([0, len(drop)]))), strict=True):
                    drop[a:b] = lines.words[low + a : low + b].sum() >= LEAST_RUN
                if drop.any():
                    edge = np.append(lines.start[low:high], texts.offsets[d + 1])
                    edge[0] = texts.offsets[d]
                    out[d] = b"".join(texts.data[edge[x] : edge[x + 1]].tobytes() for x in np.flatnonzero(~drop)).decode()
                    removed[d] = drop.sum()
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(out, pa.string()), pa.array(np.diff(lines.first).astype(np.int64)), pa.array(removed), *(batch.column(x).slice(i, j - i) for x in rest)], ["id", "text", "n_lines", "n_removed", *rest])


def _alike(a: str, b: str) -> Column:
    """How many entries two arrays have in common from their first on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    other = F.array_position(same, F.lit(False))
    return F.when(other > 0, other - 1).otherwise(F.size(same)).cast("int")


def _attached(rows: DataFrame, each: DataFrame, entries: str = "gone", how: str = "left") -> DataFrame:
    """Join each(of, entries: array<int>), one row an id, to the documents by id: broadcast if it is small, else by a shuffle.

    The driver holds a broadcast table several times over while it builds it, so only BROADCAST_BYTES may go through it.
    """
    size = each.agg(F.sum(F.length(F.col("of").cast("string")) + F.size(entries) * 4 + 96)).first()[0] or 0
    if size > BROADCAST_BYTES:
        release(rows.sparkSession)  # the texts are about to be shuffled
    return rows.join(F.broadcast(each) if size <= BROADCAST_BYTES else each.hint("shuffle_hash"), rows["id"] == each["of"], how).drop("of")


def _runs(gone: DataFrame) -> DataFrame:
    """(of, gone) of the lines gone(id, from, number): an id's runs as first line and number, one after the other.

    Runs that touch or overlap are one, so the list is as long as the removed passages are many, not their chunks.
    """
    order = Window.partitionBy("id").orderBy("from", "number")
    end = F.col("from") + F.col("number")
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    told = gone.withColumn("new", F.when(F.col("from") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    runs = told.groupBy("id", "run").agg(F.min("from").alias("from"), F.max(end).alias("end"))
    return runs.groupBy(F.col("id").alias("of")).agg(F.flatten(F.collect_list(F.array("from", F.col("end") - F.col("from")))).alias("gone"))


def _ends(rows: DataFrame, later: DataFrame, shared: DataFrame | None) -> Iterator[DataFrame]:
    """The lines (id, from, number) beside the chunks later(id, at, size, fid, fat) that equal those beside (fid, fat).

    A side ends where the next chunk that goes begins, so the sides of a document share no lines to compare. Rows that share an
    id (`shared` names these ids, if any) may differ: only what they agree on counts.
    """
    order = Window.partitionBy("id").orderBy("at", "size")
    room = later.withColumn("above", F.col("at") - F.lag(F.col("at") + F.col("size")).over(order)).withColumn("below", F.lead("at").over(order) - F.col("at") - F.col("size"))
    side = lambda step, add, space: F.struct(F.lit(step).alias("step"), (F.col("at") + add).alias("place"), (F.col("fat") + add).alias("fplace"), F.col(space).alias("room"))
    sides = room.select("id", "fid", F.inline(F.array(side(-1, F.lit(0), "above"), side(1, F.col("size"), "below"))))
    sides = cut(sides.filter("room is null or room > 0"))
    del room
    reach, spark, number_type = REACH, rows.sparkSession, T.IntegerType()
    fields = T.StructType([T.StructField("of", rows.schema["id"].dataType), *(T.StructField(n, number_type) for n in ("place", "step", "kind")), T.StructField("lines", T.ArrayType(T.BinaryType()))])
    while sides.take(1):
        number = F.least(F.coalesce("room", F.lit(reach)), F.lit(reach)).alias("number")
        # kind has a bit for lines that are a side's own, and one for those of a first occurrence: each join gets its own kind only
        asked = sides.select(F.col("id").alias("of"), "place", "step", number, F.lit(1).alias("kind")).unionByName(sides.select(F.col("fid").alias("of"), F.col("fplace").alias("place"), "step", number, F.lit(2).alias("kind")))
        asked = asked.groupBy("of", "place", "step").agg(F.max("number").alias("number"), F.bit_or("kind").alias("kind"))
        asked = cut(asked.groupBy("of").agg(F.flatten(F.collect_list(F.array("place", F.col("number") * F.col("step"), "kind"))).alias("asked")))
        release(spark)
        found = cut(_attached(rows, asked, "asked", "inner").mapInArrow(_beside, fields))
        if shared is not None:
            several = found.join(shared, found["of"] == shared["id"], "left_semi").groupBy("of", "place", "step", "kind").agg(F.min("lines").alias("lines"), F.max("lines").alias("most"))
            found = cut(found.join(shared, found["of"] == shared["id"], "left_anti").unionByName(several.filter("lines = most").drop("most")))
            del several
        del asked
        release(spark)
        own = found.filter("kind & 1 > 0").select(F.col("of").alias("id"), "place", "step", F.col("lines").alias("a"))
        first = found.filter("kind & 2 > 0").select(F.col("of").alias("fid"), F.col("place").alias("fplace"), "step", F.col("lines").alias("b"))
        both = sides.join(own, ["id", "place", "step"]).join(first, ["fid", "fplace", "step"])
        same = F.least(_alike("a", "b"), number)
        grown = cut(both.select("id", "fid", "step", "place", "fplace", "room", same.alias("same")).filter("same > 0"))
        on = grown.filter((F.col("same") == reach) & (F.col("room").isNull() | (F.col("room") > reach)))
        sides = on.select("id", "fid", "step", *((F.col(p) + F.col("step") * F.col("same")).alias(p) for p in ("place", "fplace")), (F.col("room") - reach).alias("room"))
        del found, own, first, both
        release(spark)
        yield grown.select("id", F.when(F.col("step") > 0, F.col("place")).otherwise(F.col("place") - F.col("same")).alias("from"), F.col("same").alias("number"))
        reach = min(reach * reach, FARTHEST)


def dedupe(docs: DataFrame, *, least_words: int = LEAST_WORDS, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, text (what is left of it), n_lines and n_removed (lines).

    Null texts stay null, empty ones empty; rows without an id are left as they are. Rows that share an id count as one
    document: they lose what stands in an earlier one. Of a chunk that ties with itself inside a text the first stays. Other
    columns are ignored, but `carry` names some to return as struct `rest`. Every line removed still stands somewhere earlier in the order of ids and places.
    """
    ship(docs.sparkSession)
    rows = with_rest(docs, id_col, text_col)
    kind = T.StructField("id", rows.schema["id"].dataType)
    of = lambda *fields: T.StructType([kind, *(T.StructField(n, t) for n, t in fields)])
    key, number = ("hash", T.LongType()), T.IntegerType()
    some = rows.filter("id is not null and text is not null")
    hashes = some.select("text").mapInArrow(_listed(least_words), "hash long")
    bits = _table(cut(hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")))
    fetched = cut(some.mapInArrow(_fetched(bits, least_words), of(("at", number), ("size", number), key, ("body", T.BinaryType()))))
    for part in bits:
        part.destroy()
    release(docs.sparkSession)
    # written, so that the join meets two shuffles as they are and a very common chunk can be split
    firsts = cut(fetched.groupBy("hash", "body").agg(F.min(F.struct("id", "at")).alias("f"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    later = fetched.join(firsts, ["hash", "body"]).filter(F.struct("id", "at") > F.struct("f.id", "f.at"))
    later = cut(later.select("id", "at", "size", F.col("f.id").alias("fid"), F.col("f.at").alias("fat")))
    del hashes, fetched, firsts  # what nothing refers to can be released
    shared = few(rows.filter("id is not null").groupBy("id").count().filter("count > 1").select("id"))
    release(docs.sparkSession)
    gone = later.select("id", F.col("at").alias("from"), F.col("size").alias("number"))
    for more in _ends(some, later, shared if shared.take(1) else None):
        gone = gone.unionByName(more)
    gone = cut(_runs(gone))
    del later
    rows = with_rest(docs, id_col, text_col, carry)
    out = of(("text", T.StringType()), ("n_lines", T.LongType()), ("n_removed", T.LongType()))
    return _attached(rows, gone).mapInArrow(_applied, T.StructType(out.fields + rows.schema.fields[2:]))


def filter_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of docs, all columns, with what line deduplication leaves of their texts.

    Documents that lost lines and keep no letter or digit go: what words they held stand in earlier ones.
    """
    carry = tuple(c for c in docs.columns if c != text_col)
    now = F.length("text")
    out = dedupe(docs, carry=carry, id_col=id_col, text_col=text_col)
    out = out.filter((F.col("n_removed") == 0) | F.rlike("text", F.lit(r"[\p{L}\p{N}]")))
    column = lambda c: F.col("text") if c == text_col else F.when(F.col("n_removed") > 0, now.cast("long")).otherwise(F.col(f"rest.`{c}`")) if c == chars_col else F.col(f"rest.`{c}`")
    return out.select(*(column(c).alias(c) for c in docs.columns))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication leaves of every document: a digest of the text, its length, and how many lines went."""
    out = dedupe(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256"))
