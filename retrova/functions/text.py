"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point that Unicode counts as white space for splitting (fixed values).
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Between two sentences stands white space after an end mark and before what may open the next (fixed values).
SENTENCE_END, SENTENCE_START = r"(?<=[.!?])", r"(?=[A-Z0-9\"'(\[])"
SENTENCE_GAP = f"{SENTENCE_END}{SPACE}+{SENTENCE_START}"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: Column | str) -> Column:
    """Words between white space; none for null or blank text."""
    return F.coalesce(F.filter(F.split(_col(text), SPACE + "+"), lambda w: w != ""), F.array().cast("array<string>"))


def word_count(text: Column | str) -> Column:
    return F.size(words(text)).cast("long")


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"\A{SPACE}+|{SPACE}+\z", "")


def sentences(text: Column | str) -> Column:
    """Sentences, stripped, without blank ones. `Yes. e.g. this.` stays whole."""
    parts = F.transform(F.split(_col(text), SENTENCE_GAP), strip)
    return F.coalesce(F.filter(parts, lambda s: s != ""), F.array().cast("array<string>"))


def full_text(title: Column | str, text: Column | str) -> Column:
    """Title, a blank line and the text; the text alone without a title."""
    title, text = F.coalesce(_col(title), F.lit("")), F.coalesce(_col(text), F.lit(""))
    return F.when(title != "", F.concat(title, F.lit("\n\n"), text)).otherwise(text)


def prefixed(prefix: str, text: Column | str) -> Column:
    """What a model embeds of a query; documents and re-rankers never see the prefix."""
    return F.concat(F.lit(prefix), _col(text))


def _length_bytes(value: Column) -> Column:
    """The UTF-8 length of a string as eight little-endian bytes."""
    digits = F.lpad(F.hex(F.octet_length(value).cast("long")), 16, "0")
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit(".."), F.lit(0))), ""))


def cache_key(model: Column, texts: Column) -> Column:
    """SHA-256 of a model's name and texts in order, each with its length in front, so that no two lists collide."""
    part = lambda x: F.concat(_length_bytes(x), F.encode(x, "utf-8"))
    return F.sha2(F.concat(part(model), F.aggregate(texts, F.lit(b""), lambda s, x: F.concat(s, part(x)))), 256)


def safe_name(name: Column | str) -> Column:
    return F.regexp_replace(_col(name), r"[^A-Za-z0-9._-]", "_")


def short_name(name: Column | str) -> Column:
    return F.element_at(F.split(_col(name), "/"), -1)


def build_prompt(question: Column, sources: Column) -> Column:
    """A prompt over an ordered array of sources (title, text), numbered from 1."""
    each = F.transform(sources, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["title"], F.lit("\n"), s["text"]))
    return F.concat(F.lit("Sources:\n\n"), F.array_join(each, "\n\n"), F.lit("\n\nQuestion: "), question)


def citation_numbers(answer: Column | str) -> Column:
    """The numbers cited as [n], in the order of the text."""
    found = F.regexp_extract_all(_col(answer), F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.transform(found, lambda n: n.try_cast("long"))
