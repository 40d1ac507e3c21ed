"""Language identification: script ranges narrow the candidates, a Viterbi pass labels the words, runs of words are spans.

A word is a run of letters; its script is that of its first letter. Letter trigrams, with word edges, score a word under each
language that the labelled rows show in that script; the path of labels through a text maximises the sum of word scores less
SWITCH for each change of language. The text's language is the one with most letters on the path.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import ship, table, with_rest
from ._text import Texts, blocks, texts_of

#: Labelled rows that train a language, in expectation: of n rows each is kept with probability TRAINED / n, by a hash.
TRAINED = 4_000
LANGUAGES = 512
BUCKETS = 1 << 16
#: Cost of changing the language between two words, in nats of word score.
SWITCH = 8.0
#: Trigrams overlap, so their log-likelihoods are damped.
DAMP = 0.5
FORBIDDEN = -60.0
BLOCK = 1 << 21

#: First code points of the ranges whose letters tell the script (fixed values); what lies between belongs to the one before.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "asian"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"),
)
NAMES = sorted({n for _, n in SCRIPTS})
_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 0, or 1 + its script if it is a letter; and its lower case."""
    if not _tables:
        script, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
        alpha = np.array([chr(c).isalpha() for c in range(0x110000)])
        starts = [s for s, _ in SCRIPTS] + [0x110000]
        for n, (_, name) in enumerate(SCRIPTS):
            script[starts[n] : starts[n + 1]] = 1 + NAMES.index(name)
        script[~alpha] = 0
        for c in np.flatnonzero(alpha[:0x2000]).tolist():
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
        _tables.extend((script, lower))
    return _tables[0], _tables[1]


class Letters(NamedTuple):
    """Words of a block of texts, over its code points."""

    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    first: np.ndarray  # of each text's words
    at: np.ndarray  # of each text's code points
    feature: np.ndarray  # a trigram bucket a letter, words one after the other
    head: np.ndarray  # of each word's letters


def _words(texts: Texts) -> Letters:
    script_of, lower = _letters()
    code = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])[texts.offsets]
    script = script_of[code]
    inside = np.concatenate([[False], script > 0, [False]])
    begin = inside[1:-1] & ~inside[:-2]
    begin[at[:-1][at[:-1] < len(code)]] = inside[1:-1][at[:-1][at[:-1] < len(code)]]
    finish = inside[1:-1] & ~inside[2:]
    stop = at[1:][at[1:] > 0] - 1
    finish[stop] = inside[1:-1][stop]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    place = np.flatnonzero(inside[1:-1])
    c = lower[code[place]]
    head = np.concatenate([[0], np.cumsum(end - start)])[:-1]
    left, right = np.empty_like(c), np.empty_like(c)
    if len(c):
        left[1:], right[:-1] = c[:-1], c[1:]
        left[head], right[np.append(head[1:], len(c)) - 1] = 32, 32
    h = (left * np.uint32(0x9E3779B1)) ^ (c * np.uint32(0x85EBCA6B)) ^ (right * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return Letters(start, end, script[start].astype(np.int64) - 1, np.searchsorted(start, at), at, (h >> np.uint32(16)).astype(np.int32), head)


class Model(NamedTuple):
    languages: list[str]
    score: np.ndarray  # (languages, BUCKETS) damped log-probabilities
    allowed: np.ndarray  # (scripts, languages)


def _tally(languages: list[str]):
    place = {x: n for n, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(languages), BUCKETS + len(NAMES)), np.int64)
        for batch in batches:
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for i, j, texts in blocks(texts_of(batch.column("text"))):
                w = _words(texts)
                word = np.repeat(lang[i:j], np.diff(w.first))
                np.add.at(seen, (np.repeat(word, w.end - w.start), w.feature), 1)
                np.add.at(seen, (word, BUCKETS + w.script), 1)
        lang, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(seen[lang, bucket])], ["lang", "bucket", "n"])

    return run


def train(labelled: DataFrame, *, rows: int = TRAINED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows that have text and a language; about `rows` of each language, chosen by a hash of the id.

    What reaches the driver is one count a language and trigram bucket. More than LANGUAGES languages are refused.
    """
    ship(labelled.sparkSession)
    known = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    number = dict(known.groupBy("lang").count().limit(LANGUAGES + 1).collect())
    if len(number) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(number)
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((len(NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows / number[k]))])
    draw = F.conv(F.substring(F.md5(F.coalesce("id", F.lit(""))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    sample = known.filter(draw < F.element_at(share, F.col("lang"))).select("text", "lang")
    counted = sample.mapInArrow(_tally(languages), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((len(languages), BUCKETS + len(NAMES)))
    seen[counted["lang"].to_numpy(int), counted["bucket"].to_numpy(int)] = counted["n"].to_numpy(float)
    grams, scripts = seen[:, :BUCKETS] + 0.1, seen[:, BUCKETS:]
    score = DAMP * np.log(grams / grams.sum(axis=1, keepdims=True))
    allowed = scripts >= np.maximum(1, 0.001 * scripts.sum(axis=1, keepdims=True))
    return Model(languages, score.astype(np.float32), allowed.T)


def word_scores(w: Letters, model: Model) -> np.ndarray:
    """(words, languages): damped log-likelihoods; languages that the word's script rules out get FORBIDDEN less than the rest."""
    out = np.empty((len(w.start), len(model.languages)), np.float32)
    for n in range(len(model.languages)):
        out[:, n] = np.add.reduceat(model.score[n][w.feature], w.head) if len(w.head) else 0
    may = model.allowed[w.script]
    none = ~may.any(axis=1)
    out = np.where(may, out, out.min(axis=1, keepdims=True, initial=0) + FORBIDDEN)
    out[none] = 0
    return out


def viterbi(score: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word; texts are words first[i] .. first[i + 1]. All texts of a block advance together."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")
    back = np.empty(score.shape, np.int16)
    own = np.arange(score.shape[1], dtype=np.int16)
    best = np.zeros((len(size), score.shape[1]), np.float32)
    for t in range(steps):
        m = active[t]
        at, now = begin[:m] + t, best[:m]
        top = now.argmax(axis=1)
        leap = now[np.arange(m), top] - switch
        change = leap[:, None] > now
        back[at] = np.where(change, top[:, None].astype(np.int16), own)
        best[:m] = np.where(change, leap[:, None], now) + score[at]
    label = np.empty(len(score), np.int64)
    state = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        label[at] = state[:m]
        state[:m] = back[at, state[:m]]
    return label


def _identify(model, switch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            rest = ["text", "rest"] if "rest" in batch.schema.names else []
            for i, j, texts in blocks(texts_of(batch.column("text")), BLOCK):
                n, count = j - i, len(m.languages)
                best, sure = np.full(n, count), np.zeros(n)
                offsets, values = np.zeros(n + 1, np.int32), [np.zeros(0, np.int64)] * 2 + [np.zeros(0, object)]
                w = _words(texts)
                if count and len(w.start):
                    score = word_scores(w, m)
                    label = viterbi(score, w.first, switch)
                    text = np.repeat(np.arange(n), np.diff(w.first))
                    letters = np.zeros((n, count))
                    np.add.at(letters, (text, label), w.end - w.start)
                    some = np.flatnonzero(letters.any(axis=1))
                    best[some] = letters[some].argmax(axis=1)
                    mine = label == best[text]
                    like = np.stack([np.bincount(text[mine], score[mine, k], n) for k in range(count)], 1)
                    like -= like.max(axis=1, keepdims=True)
                    odds = np.exp(like)
                    odds /= odds.sum(axis=1, keepdims=True)
                    sure[some] = letters[some, best[some]] / letters[some].sum(axis=1) * odds[some, best[some]]
                    turn = np.flatnonzero((np.diff(label, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
                    last = np.append(turn[1:], len(label)) - 1
                    offsets = np.searchsorted(text[turn], np.arange(n + 1)).astype(np.int32)
                    values = [w.start[turn] - w.at[text[turn]], w.end[last] - w.at[text[turn]], names[label[turn]]]
                spans = pa.StructArray.from_arrays([pa.array(values[0], pa.int64()), pa.array(values[1], pa.int64()), pa.array(values[2], pa.string())], ["start", "end", "lang"])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, n), pa.array(names[best], pa.string()), pa.array(np.clip(sure, 0, 1)), pa.ListArray.from_arrays(pa.array(offsets), spans), *(batch.column(x).slice(i, n) for x in rest)], ["id", "lang_pred", "score", "spans"] + rest)

    return run


def identify(docs: DataFrame, model: Model, *, switch: float = SWITCH, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, lang_pred, score (0 to 1) and spans of one language (start and end in code points, end exclusive).

    `und`, score 0 and no spans for null texts, texts without letters, and every text if no row was labelled. The score is the
    share of letters on the path in that language times its odds on those words. Ties go to the language first in order.
    Repeated rows give a row each; other columns are ignored, but `carry` names some to return, with the text, as struct `rest`.
    """
    ship(docs.sparkSession)
    rows = with_rest(docs, id_col, text_col, carry)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span)), *rows.schema.fields[1 if carry else 2 :]])
    return rows.mapInArrow(_identify(docs.sparkSession.sparkContext.broadcast(model), switch), out)


def filter_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text is in a language of the model."""
    carry = tuple(c for c in docs.columns if c != text_col)
    known = identify(docs, model, carry=carry, id_col=id_col, text_col=text_col).filter("lang_pred <> 'und'")
    return known.select(*(F.col("text" if c == text_col else f"rest.`{c}`").alias(c) for c in docs.columns))


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, learnt from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return identify(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
