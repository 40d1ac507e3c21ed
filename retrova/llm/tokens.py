"""Token counts by byte-pair merging with a heap over a linked list; no token identifiers are made.

A word starts as its UTF-8 bytes. The adjacent pair of lowest rank (ties: the leftmost) is popped from the heap and merged in
the list, its new neighbours are pushed, and entries whose symbols have changed are skipped. Every merge takes one symbol
away, so a word's count is its bytes less its merges, after O(n log n) steps. Short words are remembered per worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import ship, table
from ._text import texts_of

#: How byte-level vocabularies of this kind split a text into words (fixed value).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers at most, and their longest length.
REMEMBERED, SHORT = 400_000, 48


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where visible, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


def _newer_letters() -> str:
    """Characters that the regex module takes for letters or digits and the tokenizers library, of an older Unicode, doesn't.

    Only the library can tell; without it texts that hold them would be counted wrong, so its absence is an error.
    """
    try:
        from tokenizers.pre_tokenizers import ByteLevel
    except ImportError as error:
        raise RuntimeError("the driver needs the tokenizers library, whose counts are to be matched") from error
    cut, wide = ByteLevel(add_prefix_space=False), regex.compile(r"[\p{L}\p{N}]")
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return "".join(c for c in wide.findall(every) if len(cut.pre_tokenize_str("!" + c)) == 1)


class Merges:
    """The merge table of a byte-level BPE file: pair of symbols -> (rank, merged symbol); bytes are symbols 0 to 255."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, cut = whole["model"], whole["pre_tokenizer"]
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or whole["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        symbol: dict[str, int] = _byte_letters()
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            new = symbol.setdefault(left + right, len(symbol))
            self.pairs.setdefault((symbol[left], symbol[right]), (rank, new))
        self.unknown = _newer_letters()
        self.special = sorted((t["content"] for t in whole["added_tokens"] if t["special"]), key=len, reverse=True)


def count_word(word: bytes, pairs: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Tokens of one word."""
    n = len(word)
    if n < 2:
        return n
    symbol: list[int] = list(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        found = pairs.get((symbol[i], symbol[i + 1]))
        if found:
            heap.append((found[0], i, symbol[i], symbol[i + 1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != a or j >= n or symbol[j] != b:
            continue
        symbol[i], symbol[j] = pairs[a, b][1], -1
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = pairs.get((symbol[i], symbol[k]))
            if found:
                heapq.heappush(heap, (found[0], i, symbol[i], symbol[k]))
        h = before[i]
        if h >= 0:
            found = pairs.get((symbol[h], symbol[i]))
            if found:
                heapq.heappush(heap, (found[0], h, symbol[h], symbol[i]))
    return n - merges


class _Remembered(dict):
    """word -> tokens, computed when first asked for."""

    def __init__(self, pairs):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, word: str) -> int:
        n = count_word(word.encode(), self.pairs)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


class Counter:
    def __init__(self, merges: Merges):
        self.words = regex.compile(WORD)
        self.first_unknown = min(merges.unknown, default=chr(0x10FFFF))
        odd = f"[{regex.escape(merges.unknown)}]" if merges.unknown else r"[^\s\S]"
        self.odd = regex.compile(odd)
        without = WORD.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|{odd})+").replace(r"\p{L}+", rf"(?:(?!{odd})\p{{L}})+").replace(r"\p{N}+", rf"(?:(?!{odd})\p{{N}})+")
        self.words_without = regex.compile(without)
        self.special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
        self.known = _Remembered(merges.pairs)

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token, as the library takes it by default."""
        find = self.words.findall
        if not text.isascii() and max(text) >= self.first_unknown and self.odd.search(text):
            find = self.words_without.findall
        parts = self.special.split(text) if self.special is not None else [text]
        return len(parts) - 1 + sum(sum(map(self.known.__getitem__, find(p))) for p in parts)


def count_tokens(docs: DataFrame, path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens).

    Null and empty texts have 0 bytes and tokens; repeated rows give a row each; other columns are ignored. The driver reads
    the vocabulary at `path` and ships its merge table, whose size is that of the vocabulary.
    """
    ship(docs.sparkSession)
    merges = docs.sparkSession.sparkContext.broadcast(Merges(path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges.value)
        for batch in batches:
            text = batch.column("text")
            size = np.diff(texts_of(text).offsets)
            tokens = np.zeros(batch.num_rows, np.int64)
            for n in range(batch.num_rows):
                if size[n]:
                    tokens[n] = counter.count(text[n].as_py())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    out = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return rows.mapInArrow(run, out)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document under the byte-level vocabulary of 50,257 entries."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
