"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Protected entities are the values that four fixed forms match (see FORMS). Corpus co-occurrence then estimates how strongly
other terms reveal them: for a term t in the surroundings of an entity e, disclosure is p(e | t) = docs with both / docs with
t, and its information is log2(p(e | t) / p(e)) bits. A term that at least SUPPORT documents tie to an entity, and whose
information reaches BITS, is removed wherever it stands if its disclosure reaches REMOVE, and generalised from GENERALISE.

Plan: one pass finds entities and the terms around them; pairs and the documents of each term are counted with map-side
combining; a third pass keeps the documents of the disclosing terms, which are few; the last one finds every span. Text is
shuffled only if those documents don't fit a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._fold import collected, let, running
from ._spark import cut, table

#: Kinds in the order in which spans are listed: the base forms, then removed and generalised terms.
KINDS = ("email", "ip", "card", "phone", "term", "hint")
#: The fixed forms. Possessive repeats and the look-behinds only spare the engine hopeless starts and deep recursion: a run of
#: an address's or number's first part is tried once, from its start or from the end of the match before.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A row can match a form only if it matches this.
MAYBE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}[\p{L}\p{N}]{3,}+"
#: Characters on either side of an entity that count as its surroundings.
AROUND = 60
SUPPORT, BITS, REMOVE, GENERALISE = 3, 3.0, 0.5, 0.25
#: Code points of a piece of a text.
PIECE = 4096
#: Characters of a table that may be broadcast.
BROADCAST_CHARS = 8_000_000


_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _located(text: Column, form: str | Column, kind: str, fine: Callable[[Column], Column] | None = None) -> Column:
    """Matches of a form, leftmost and non-overlapping, as structs (kind, start, end, value); offsets in code points.

    Where `fine` is given, matches whose value fails it are dropped. Places are running sums over what stands between and in
    all matches, so the work grows with the matches as they are.
    """
    form = F.lit(form) if isinstance(form, str) else form
    gaps = F.transform(F.split(text, form, -1), F.length)

    def spans(values: Column) -> Column:
        ends = running(F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda gap, value: gap + F.length(value)))
        span = lambda value, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))
        found = F.zip_with(values, ends, span)
        return F.when(F.size(values) > 0, found if fine is None else F.filter(found, lambda m: fine(m["value"]))).otherwise(_none())

    return let(F.regexp_extract_all(text, form, F.lit(0)), spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))
    digit = lambda i: F.substring(back, i + 1, F.lit(1)).cast("int")
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), F.length(back) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, digit(i)).otherwise(twice(digit(i)))) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """What a match must satisfy besides its form."""
    number = F.length(_digits(value))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when((number >= 13) & (number <= 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return (number >= 9) & (number <= 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The spans of the four base forms as structs (kind, start, end, value), by kind as listed and then start."""
    each = []
    for kind, form in FORMS.items():
        maybe = F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit(MAYBE[kind]))
        each.append(F.when(maybe, _located(text, form, kind, None if kind == "email" else partial(_holds, kind))).otherwise(_none()))
    return F.concat(*each)


def _entity(m: Column) -> Column:
    """What an entity is counted under: its kind and its value without case or separators."""
    return F.concat_ws(":", m["kind"], F.when(m["kind"].isin("card", "phone"), _digits(m["value"])).otherwise(F.lower(m["value"])))


def _pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points: to cut a place out of a whole text, all that stands before is walked over."""
    return F.split(text, rf"(?s)(?<=\G.{{{PIECE}}})")


def _cutout(pieces: Column, start: Column, end: Column) -> Column:
    i, j = (F.floor(x / PIECE).cast("int") for x in (start, end))
    piece = lambda n: F.coalesce(F.get(pieces, n), F.lit(""))
    across = F.concat(F.substring(piece(i), start - i * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(piece(j), 1, end - j * PIECE))
    return F.when(i == j, F.substring(piece(i), start - i * PIECE + 1, end - start)).otherwise(across)


def _near(pieces: Column, m: Column) -> Column:
    """Distinct terms around a span; words that the window cuts are left out."""
    before = _cutout(pieces, F.greatest(m["start"] - AROUND, F.lit(0)), m["start"])
    after = _cutout(pieces, m["end"], m["end"] + AROUND)
    before = F.when(m["start"] > AROUND, F.regexp_replace(before, r"^[\p{L}\p{N}]+", "")).otherwise(before)
    after = F.when(F.length(after) == AROUND, F.regexp_replace(after, r"[\p{L}\p{N}]+$", "")).otherwise(after)
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", before, after)), F.lit(TERM), F.lit(0)))


def _fits(df: DataFrame, chars: Column) -> DataFrame:
    """The table marked for broadcast if its characters are few enough; else joined as any other."""
    return F.broadcast(df) if (df.agg(F.sum(chars + 32)).first()[0] or 0) <= BROADCAST_CHARS else df


def disclosing_terms(docs: DataFrame, *, support: int = SUPPORT, bits: float = BITS, generalise: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """((id, terms) for the documents that hold disclosing terms, (term, disclosure, bits)) of docs(id, text)."""
    hits = docs.select("id", "text", base_spans(F.col("text")).alias("found")).filter(F.size("found") > 0).select("found", _pieces(F.col("text")).alias("pieces"))
    pair = lambda m: let(_entity(m), lambda e: F.transform(_near(F.col("pieces"), m), lambda t: F.concat_ws("\x01", e, t)))  # noqa: E731  strings are told apart by hashing, structs one by one
    pairs = F.array_distinct(F.flatten(F.transform("found", pair)))
    seen = cut(hits.select(F.array_distinct(F.transform("found", _entity)).alias("entities"), pairs.alias("pairs")))
    entities = seen.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    tied = seen.select(F.explode("pairs").alias("p")).groupBy("p").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= support)
    tied = tied.select(F.substring_index("p", "\x01", 1).alias("entity"), F.substring_index("p", "\x01", -1).alias("term"), "n_both")
    tied = cut(tied.join(entities, "entity"))
    words = docs.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    number = F.lit(docs.count())
    information = F.log2(F.col("n_both") * number / (F.col("n_term") * F.col("n_entity")))
    shown = tied.join(words.groupBy("term").agg(F.count("*").alias("n_term")), "term").select("term", (F.col("n_both") / F.col("n_term")).alias("disclosure"), information.alias("bits"))
    shown = cut(shown.filter((F.col("bits") >= bits) & (F.col("disclosure") >= generalise)).groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.max("bits").alias("bits")))
    marked = words.join(_fits(shown, F.length("term")), "term").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("term", "disclosure"))).alias("terms"))
    return marked, shown


def _any_of(terms: Column) -> Column:
    """A pattern for whole-word occurrences of the terms, whatever their case (letters and digits need no escape)."""
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))


def sanitise(docs: DataFrame, *, support: int = SUPPORT, bits: float = BITS, remove: float = REMOVE, generalise: float = GENERALISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, spans (kind, start, end, value; code points) and `sanitised`, the text without them.

    Base spans become <EMAIL>, <IP>, <CARD> and <PHONE>; removed terms vanish into <TERM>, generalised ones keep their first
    letter. Null and empty texts have no spans (sanitised: as they were). Repeated rows give a row each; rows that share an
    id, or have none, share their disclosing terms, each marked where it stands; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked, _ = disclosing_terms(rows, support=support, bits=bits, generalise=generalise)
    marked = _fits(cut(marked), F.size("terms") * 24)
    whole = rows.join(marked.withColumnRenamed("id", "of"), rows.id.eqNullSafe(F.col("of")), "left")
    terms = lambda f: F.transform(F.filter("terms", f), lambda t: t["term"])
    for kind, keep in (("term", lambda t: t["disclosure"] >= remove), ("hint", lambda t: t["disclosure"] < remove)):
        whole = whole.withColumn(kind, terms(keep))
    text = F.col("text")
    added = [F.when(F.size(k) > 0, _located(text, _any_of(F.col(k)), k)).otherwise(_none()) for k in ("term", "hint")]
    spans = F.coalesce(F.concat(base_spans(text), *added), _none())
    return whole.select("id", "text", spans.alias("spans")).withColumn("pieces", F.when(F.size("spans") > 0, _pieces(text))).select("id", "spans", _replaced(text, F.col("spans")).alias("sanitised"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text (also in the column pieces) with its spans replaced; of overlapping ones the first to start, and among those the first listed."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    mask = lambda s: F.when(s["kind"] == "hint", F.concat(F.substring(s["value"], 1, 1), F.lit("."))).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    pieces = F.col("pieces")

    def step(at: Column, s: Column) -> Column:
        taken = F.array(_cutout(pieces, at, s["start"]), mask(s))
        return F.when(s["start"] < at, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))).otherwise(F.struct(s["end"].alias("at"), taken.alias("out")))

    whole = let(collected(order, F.lit(0), step, "string"), lambda done: F.concat(F.array_join(done["out"], ""), _cutout(pieces, done["at"], F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document, and the terms that disclose it."""
    found = sanitise(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda *kinds: F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds))).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:4]))
    return found.select(F.col("id").alias("doc_id"), *(number(k).alias(f"n_{k}") for k in KINDS[:4]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), number("term", "hint").alias("n_terms"))
