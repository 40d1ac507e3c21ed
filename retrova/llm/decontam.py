"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item becomes windows of `window` consecutive words (an item of fewer words is one window). A window is held
whole by a document only if the document holds every shingle of it, so the *necessary prefix* of a window, its shingles
ordered by rarity in the corpus, is its single rarest shingle. Documents probe that prefix; a probe survives the length and
positional bounds (the words the window needs before and after the shingle exist) and is then verified exactly, word by
word on the bytes, over the item-sized window.

Both passes are map-only over the documents. The index goes to the workers in blocks of at most `index_words` benchmark
words; a larger benchmark is handled block after block, each with passes of its own over what the one before has written, and
the hits are unioned. Only each document's own hits are ever grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import cut, ship, table, with_rest
from ._text import ALNUM, LOWER, Texts, U, Words, blocks, hash_spans, mix, spans_of, texts_of, words_of

WINDOW = 10
SHINGLE = 3
#: Words of benchmark text that one block of the index holds at most; about 460 bytes a word, measured, so some 115 MB.
INDEX_WORDS = 250_000


def item_words(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    start, end = spans_of(ALNUM[data], np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def _hash_words(words: list[bytes]) -> np.ndarray:
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    return hash_spans(np.frombuffer(b"".join(words), np.uint8), end - size, end)


def _roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes."""
    if len(h) < k:
        return np.zeros(0, U)
    run = np.zeros(len(h) - k + 1, U)
    for j in range(k):
        run = (run + h[j : len(h) - k + 1 + j]) * U(0xFF51AFD7ED558CCD)
        run ^= run >> U(29)
    return mix(run)


class Windows:
    """The distinct windows of some items, with the items that hold each."""

    def __init__(self, items: list[tuple], window: int, shingle: int):
        self.window, self.shingle = window, shingle
        seen: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            words = item_words(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                seen.setdefault(tuple(words[i : i + size]), set()).add(item)
        self.words = list(seen)
        self.items = [sorted(x) for x in seen.values()]
        self.shingles = []  # per window: its shingles' hashes; those of k words are told from those of fewer by k
        for words in self.words:
            k = min(shingle, len(words))
            self.shingles.append((k, _roll(_hash_words(list(words)), k)))

    def keys(self) -> dict[int, np.ndarray]:
        """Sorted distinct shingle hashes for each shingle length."""
        return {k: np.unique(np.concatenate([s for j, s in self.shingles if j == k])) for k in {k for k, _ in self.shingles}}


def _count_rarity(windows: Windows):
    """For each batch of documents, how many hold each benchmark shingle."""
    keys = windows.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(v), np.int64) for k, v in keys.items()}
        for batch in batches:
            for _, _, texts in blocks(texts_of(batch.column(0))):
                words = words_of(texts, ALNUM)
                for k, known in keys.items():
                    at = _lookup(known, _roll(words.hash, k))
                    hit = np.flatnonzero(at >= 0)
                    doc = np.searchsorted(words.first, hit, "right") - 1
                    pair = np.unique(doc * len(known) + at[hit])
                    np.add.at(total[k], pair % len(known), 1)
        for k, v in total.items():
            some = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(keys[k][some].view(np.int64)), pa.array(v[some])], ["k", "shingle", "docs"])

    return run


def _lookup(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted `known`, or -1. A bit table turns away nearly all others before the search."""
    out = np.full(len(h), -1, np.int64)
    if not len(known) or not len(h):
        return out
    bits = max(16, int(len(known)).bit_length() + 5)
    shift = U(64 - bits)
    table_ = np.zeros(1 << bits, bool)
    table_[known >> shift] = True
    maybe = np.flatnonzero(table_[h >> shift])
    at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
    same = known[at] == h[maybe]
    out[maybe[same]] = at[same]
    return out


def _prefixes(windows: Windows, rarity: dict[tuple[int, int], int]):
    """For each shingle length: sorted prefix hashes, and for each the windows it stands for with its place in them."""
    index: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for w, (k, shingles) in enumerate(windows.shingles):
        order = [(rarity.get((k, int(s.view(np.int64))), 0), int(s), i) for i, s in enumerate(shingles)]
        rare, key, place = min(order)
        if rare:  # a shingle that no document holds: neither does any hold the window
            index.setdefault(k, {}).setdefault(key, []).append((w, place))
    return {k: (np.array(sorted(v), U), [v[x] for x in sorted(v)]) for k, v in index.items()}


def _probe(windows: Windows, prefixes, last: bool):
    """Hits of one block of the benchmark, unioned with those that earlier blocks left in runs and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.zeros(batch.num_rows, np.int64)
            earlier = "runs" in batch.schema.names
            runs = batch.column("runs").to_pylist() if earlier else [[] for _ in range(batch.num_rows)]
            found = batch.column("items").to_pylist() if earlier else [[] for _ in range(batch.num_rows)]
            for begin, _, texts in blocks(texts_of(batch.column("text"))):
                words = words_of(texts, ALNUM)
                count = np.diff(words.first)
                number[begin : begin + len(count)] = count
                for d, each in _verified(windows, prefixes, texts, words).items():
                    mark = np.zeros(int(count[d]) + 1, np.int64)
                    for a, b in zip(runs[begin + d][::2], runs[begin + d][1::2], strict=True):
                        mark[a] += 1
                        mark[b] -= 1
                    for w, starts in each.items():
                        for s in starts:
                            mark[s - int(words.first[d])] += 1
                            mark[s - int(words.first[d]) + len(windows.words[w])] -= 1
                    inside = np.cumsum(mark[:-1]) > 0
                    runs[begin + d] = np.stack(spans_of(inside, np.array([0, len(inside)])), 1).ravel().tolist()
                    found[begin + d] = sorted({*found[begin + d], *(str(i) for w in each for i in windows.items[w])})
            passed = [x for x in ("id", "text", "rest") if x in batch.schema.names and not (last and x == "text" and "rest" not in batch.schema.names)]
            columns = {x: batch.column(x) for x in passed}
            columns |= {"n_words": pa.array(number), "runs": pa.array(runs, pa.list_(pa.int64())), "items": pa.array(found, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _verified(windows: Windows, prefixes, texts: Texts, words: Words) -> dict[int, dict[int, set[int]]]:
    """text -> window -> first words (in the block) of its occurrences."""
    hits: dict[int, dict[int, set[int]]] = {}
    raw = None
    for k, (known, stand) in prefixes.items():
        at = _lookup(known, _roll(words.hash, k))
        where = np.flatnonzero(at >= 0)
        docs = np.searchsorted(words.first, where, "right") - 1
        for p, d in zip(where.tolist(), docs.tolist(), strict=True):
            low, high = int(words.first[d]), int(words.first[d + 1])
            for w, place in stand[int(at[p])]:
                want, s = windows.words[w], p - place
                if s < low or s + len(want) > high or s in hits.get(d, {}).get(w, ()):  # positional and length bounds
                    continue
                raw = LOWER[texts.data].tobytes() if raw is None else raw
                if all(raw[words.start[s + i] : words.end[s + i]] == x for i, x in enumerate(want)):
                    hits.setdefault(d, {}).setdefault(w, set()).add(s)
    return hits


def _benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, index_words: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, streamed to the driver block by block."""
    block, size = [], 0
    for item, text in benchmark.select(item_col, text_col).toLocalIterator():
        n = (len(text) + 1) // 2 if text else 0
        if block and size + n > index_words:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE, index_words: int = INDEX_WORDS, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, runs (flat [start, end) word positions that are hit) and items (sorted as strings).

    Null and empty texts have no words, no runs and no items; other columns of either table are ignored, so clashing names
    do no harm (`carry` names some of docs to return, with the text, as struct `rest`); repeated rows each give a row; an empty benchmark hits nothing. Ties in rarity go to the smaller hash.
    """
    if window < 1 or shingle < 1:
        raise ValueError("window and shingle must be positive")
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    rows = with_rest(docs, id_col, text_col, carry)
    kept = rows.schema.fields
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    pending = _benchmark_blocks(benchmark, item_col, item_text_col, index_words)
    block = next(pending, [])
    while True:
        after = next(pending, None)
        windows, rarity = Windows(block, window, shingle), {}
        if windows.words:
            counted = texts.mapInArrow(_count_rarity(windows), "k int, shingle long, docs long").groupBy("k", "shingle").agg(F.sum("docs").alias("docs"))
            rarity = {(k, s): n for k, s, n in counted.collect()}  # at most the shingles of one block
        last = after is None
        rows = rows.mapInArrow(_probe(windows, _prefixes(windows, rarity), last), T.StructType(kept[:1] + (kept[1:] if carry or not last else []) + added))
        if last:
            return rows
        rows, block = cut(rows), after  # written, so that no task and no driver holds the windows of two blocks


def filter_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no window of the benchmark occurs."""
    carry = tuple(c for c in docs.columns if c != text_col)
    clean = find(docs, benchmark, carry=carry, id_col=id_col, text_col=text_col).filter(F.size("runs") == 0)
    return clean.select(*(F.col("text" if c == text_col else f"rest.`{c}`").alias(c) for c in docs.columns))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document: the words inside an occurrence of any window, and the items such windows come from."""
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.sequence(F.lit(1), (F.size("runs") / 2).cast("int")), F.lit(0).cast("long"), lambda s, i: s + F.get("runs", 2 * i - 1) - F.get("runs", 2 * i - 2))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.when(F.size("runs") > 0, hit).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )
