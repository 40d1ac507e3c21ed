"""What a search service decides about a request, as column expressions: gates, validation and cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Limits of a request (fixed values).
MAX_BODY = 10 * 1024 * 1024
ID_CHARS, TITLE_CHARS, TEXT_CHARS, QUERY_CHARS = 200, 1_000, 200_000, 2_000
MAX_DOCUMENTS, MAX_K = 1_000, {"query": 100, "answer": 10}
DEFAULT_K = {"query": 10, "answer": 5}
#: Tokens that a request takes from its client's bucket.
COSTS = {"query": 1, "query_rerank": 5, "documents": 10, "answer": 20}
OPEN = ("/health", "/livez", "/")


def document_valid(doc_id: Column, title: Column, text: Column) -> Column:
    title = F.coalesce(title, F.lit(""))
    out = F.length(doc_id).between(1, ID_CHARS) & (F.length(title) <= TITLE_CHARS) & F.length(text).between(1, TEXT_CHARS) & (strip(text) != "")
    return F.coalesce(out, F.lit(False))


def query_valid(text: Column, k: Column, endpoint: str = "query") -> Column:
    k = F.coalesce(k, F.lit(DEFAULT_K[endpoint]))
    return F.coalesce(F.length(text).between(1, QUERY_CHARS) & (strip(text) != "") & k.between(1, MAX_K[endpoint]), F.lit(False))


def cost(endpoint: Column, rerank: Column) -> Column:
    name = F.when((endpoint == "query") & F.coalesce(rerank, F.lit(False)), "query_rerank").otherwise(endpoint)
    out = F.lit(None).cast("double")
    for key, value in COSTS.items():
        out = F.when(name == key, F.lit(float(value))).otherwise(out)
    return out


def gate(path: Column, size: Column, ready: Column, key_known: Column) -> Column:
    """The first status that stops a request before its body is read: 413, 503, 401; null if none does."""
    exempt = path.isin(*OPEN)
    return F.when(size > MAX_BODY, 413).when(~exempt & ~ready, 503).when(~exempt & ~key_known, 401).cast("long")


def status(stopped: Column, endpoint: Column, valid: Column, allowed: Column, wants_rerank: Column, has_rerank: Column, can_answer: Column, read_only: Column) -> Column:
    """The status of a request in the order in which the checks are made.

    Queries are charged (429) before the missing re-ranker is noticed (400); answers and new documents are refused (400, 403)
    before they are charged.
    """
    return (
        F.when(stopped.isNotNull(), stopped)
        .when(~valid, 422)
        .when((endpoint == "answer") & ~can_answer, 400)
        .when((endpoint == "documents") & read_only, 403)
        .when(~allowed, 429)
        .when((endpoint == "query") & wants_rerank & ~has_rerank, 400)
        .otherwise(200)
        .cast("long")
    )
