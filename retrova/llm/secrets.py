"""Secret scan: fixed forms by pattern, unknown ones by the entropy of a sliding window.

Three base forms are matched leftmost and non-overlapping (see BASE). Besides, every candidate string, a run of ENTROPY_WINDOW
or more characters that secrets are made of, is slid over once a character class: the window's counts change by one character
in and one out, and so does the sum of c * log2(c) that its Shannon entropy needs. Windows at or above the class's threshold
are merged into spans of the kind `entropy`, unless an allow-list pattern covers the candidate or base spans cover the span.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import ship, table
from ._text import Texts, blocks, spans_of, texts_of

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
BASE = {
    "assign": re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
ENTROPY_WINDOW = 20
#: Bits of entropy of a window from which it counts, by character class.
THRESHOLDS = {"hex": 3.0, "base64": 3.9}
#: Candidates that are never secrets: identifiers, dates, placeholders, plain words and numbers, dashes and other rules.
ALLOWED = (
    rb"(?i)\A[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z",
    rb"\A[0-9T:+Z_-]+\Z",
    rb"(?i)example|placeholder|changeme|dummy|lorem",
    rb"\A[A-Z]?[a-z]+(?:[/_=-]+[A-Z]?[a-z]+)*\Z",
    rb"\A[A-Z]+(?:[/_=-]+[A-Z]+)*\Z",
)

_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_CLASS = {"hex": frozenset(b"0123456789abcdefABCDEF"), "base64": frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")}
_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[list(_CLASS["base64"])] = True


def windows_above(text: bytes, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows of `window` bytes whose Shannon entropy is at least `bits`."""
    count = [0] * 256
    plogp = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = window * (math.log2(window) - bits) + 1e-9  # entropy = log2(window) - sum(c log2 c) / window
    total, found = 0.0, []
    for i, new in enumerate(text):
        total += plogp[count[new] + 1] - plogp[count[new]] if count[new] < window else 0
        count[new] += 1
        if i >= window:
            old = text[i - window]
            count[old] -= 1
            total += plogp[count[old]] - plogp[min(count[old] + 1, window)]
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


class Scanner:
    def __init__(self, window: int = ENTROPY_WINDOW, thresholds: dict[str, float] | None = None, allowed=ALLOWED):
        self.window, self.thresholds = window, THRESHOLDS if thresholds is None else thresholds
        self.allowed = [re.compile(x) for x in allowed]

    def entropy_spans(self, candidate: bytes) -> list[tuple[int, int]]:
        if any(x.search(candidate) for x in self.allowed):
            return []
        found: list[tuple[int, int]] = []
        for name, bits in self.thresholds.items():
            inside = [c in _CLASS[name] for c in candidate]
            begin = None
            for i, own in enumerate([*inside, False]):
                if own and begin is None:
                    begin = i
                elif not own and begin is not None:
                    part = candidate[begin:i]
                    kinds = sum(bool(re.search(x, part)) for x in (rb"[a-z]", rb"[A-Z]", rb"[0-9]"))
                    if len(part) >= self.window and kinds >= 2:
                        found += [(begin + a, begin + b) for a, b in windows_above(part, self.window, bits)]
                    begin = None
        return _merged(found)

    def scan(self, texts: Texts) -> dict[int, list[tuple[int, int, int]]]:
        """text -> (start, kind, end) in code points, sorted."""
        n = len(texts.offsets) - 1
        raw = b"\n".join([texts.text(i) for i in range(n)])  # no pattern crosses a line feed
        begin = texts.offsets + np.arange(n + 1)
        found: list[tuple[int, int, int]] = []
        for kind, pattern in BASE.items():
            for m in pattern.finditer(raw):
                a, b = m.span(m.lastindex or 0)
                if b - a >= LEAST[kind]:
                    found.append((m.start(), KINDS.index(kind), m.end()))
        data = np.frombuffer(raw, np.uint8)
        edges = np.array([0, len(data)])
        a, b = spans_of(_HEX[data], edges)
        long = b - a >= LEAST["hex"]
        found += [(x, 2, y) for x, y in zip(a[long].tolist(), b[long].tolist(), strict=True)]
        base = _merged((x, y) for x, _, y in found)
        a, b = spans_of(_CANDIDATE[data], edges)
        long = b - a >= self.window
        for x, y in zip(a[long].tolist(), b[long].tolist(), strict=True):
            for s, e in self.entropy_spans(raw[x:y]):
                at = bisect_right(base, (x + s, len(data))) - 1
                if at < 0 or base[at][1] < x + e:  # the base spans don't cover it together
                    found.append((x + s, 3, x + e))
        if not found:
            return {}
        point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        out: dict[int, list[tuple[int, int, int]]] = {}
        for x, kind, y in sorted(found):
            d = int(np.searchsorted(begin, x, "right")) - 1
            shift = int(point[begin[d]])
            out.setdefault(d, []).append((int(point[x]) - shift, kind, int(point[y]) - shift))
        return out


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans in place of those that overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, *, window: int = ENTROPY_WINDOW, thresholds: dict[str, float] | None = None, allowed=ALLOWED, redact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id and spans (kind, start, end in code points, end exclusive), by start and then kind.

    With redact=True also `redacted`, the text with each span (overlapping ones together) replaced by <SECRET>. Null and empty
    texts have no spans (redacted: as they were); repeated rows give a row each; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scanner = Scanner(window, thresholds, allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in blocks(texts_of(batch.column("text"))):
                found = scanner.scan(texts)
                flat = [(KINDS[k], s, e) for d in range(j - i) for s, k, e in found.get(d, ())]
                kind, start, end = zip(*flat, strict=True) if flat else ((), (), ())
                spans = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["kind", "start", "end"])
                offsets = np.concatenate([[0], np.cumsum([len(found.get(d, ())) for d in range(j - i)])]).astype(np.int32)
                columns = {"id": batch.column("id").slice(i, j - i), "spans": pa.ListArray.from_arrays(pa.array(offsets), spans)}
                if redact:
                    whole = batch.column("text").slice(i, j - i).to_pylist()
                    columns["redacted"] = pa.array([_redacted(t, found.get(d, ())) for d, t in enumerate(whole)], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = [T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", T.ArrayType(span))]
    return rows.mapInArrow(run, T.StructType(out + [T.StructField("redacted", T.StringType())] * redact))


def _redacted(text: str | None, spans) -> str | None:
    if not spans:
        return text
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], "<SECRET>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document."""
    found = scan(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(F.col("id").alias("doc_id"), *(number(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), number("entropy").alias("n_entropy"))
