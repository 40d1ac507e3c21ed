"""Experiments over embedded passages, judgments by containment, and comparisons of systems."""

import numpy as np
import pytest

from retrova.operators import embed, rank, report
from retrova.plans import experiment as E

#: No two of them that share a word with a query are equally near: an approximate index may break ties otherwise.
DOCS = [(n, f"{a} {b}" + n * " x") for n, (a, b) in enumerate((x, y) for x in ("red", "blue", "green", "grey") for y in ("car", "sky", "sea", "ash"))]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    queries = spark.createDataFrame([("q1", "red sky"), ("q2", "grey sea"), ("q3", "car")], "query_id string, text string")
    qrels = spark.createDataFrame([("q1", 1, 1), ("q2", 14, 2), ("q2", 2, 1), ("q3", 0, 1)], "query_id string, doc_id long, grade int")
    return docs, queries, qrels


def by_hand(model, queries, k):
    """The ranking in numpy: cosine, ties by the number of the passage."""
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(model.embed(queries).astype(float)) @ unit(model.embed([t for _, t in DOCS]).astype(float)).T
    return [sorted(range(len(DOCS)), key=lambda d: (-round(s[d], 9), d))[:k] for s in scores]


def test_dense_rows(spark, tables, tmp_path):
    docs, queries, qrels = tables
    model = embed.HashedWords(64, max_tokens=2)
    prepared = E.prepare(docs, queries, "whole", model, str(tmp_path / "p"), str(tmp_path / "cache"))
    assert [r.vec_id for r in prepared.passages.orderBy("doc_id").collect()] == list(range(16))
    row, each = E.dense(prepared, qrels, "flat", k=4)
    row, each = row.first(), {r.query_id: r.ndcg for r in each.collect()}
    want = by_hand(model, ["red sky", "grey sea", "car"], 4)
    assert (row.n_docs, row.n_chunks, row.n_queries, row.tokens_max, row.truncated_frac, row.ann_recall, row.scored_mean) == (16, 16, 3, 17, 0.9375, 1.0, 16.0)
    assert row.recall_1 == pytest.approx(np.mean([1 in want[0][:1], len({2, 14} & set(want[1][:1])) / 2, 0 in want[2][:1]]))
    assert each["q1"] == pytest.approx(1 / np.log2(want[0].index(1) + 2)) and row.rerank is None
    graphs = {}
    near = [E.dense(prepared, qrels, spec, k=4, graphs=graphs)[0].first() for spec in ("hnsw-8-32-16", "hnsw-8-32-32")]
    assert len(graphs) == 1 and all(r.ann_recall == 1 and r.build_seconds > 0 and 0 < r.search_p50_ms <= r.search_p99_ms for r in near)
    again, _ = E.dense(prepared, qrels, "flat", k=4, reranker=rank.WordOverlap(), rerank_depth=5)
    assert again.first().rerank == "word-overlap" and again.first().rerank_depth == 5
    with pytest.raises(RuntimeError):
        E.dense(prepared, qrels, "faiss-hnsw-8-32-16")


def test_containing_against_all_pairs(spark, monkeypatch):
    items = [("a", "sky"), ("b", "sky"), ("c", "red"), ("d", ""), ("e", None), ("f", "red sky"), ("g", "y r"), ("h", "absent")]
    docs = [*DOCS, (100, None), (101, ""), (102, "sky red")]
    want = sorted((q, d) for q, i in items if i is not None for d, t in docs if t is not None and i in t)
    for most in (1_000_000, 6):
        monkeypatch.setattr(E, "ITEM_CHARS", most)
        got = E.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id string, text string"))
        assert sorted((r.query_id, r.doc_id) for r in got.collect()) == want
    assert E.containing(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "query_id string, text string")).count() == 0


def test_comparison_of_selected_systems(spark):
    rows = [(m, c, None, None, None, f"q{n}", s + n / 10) for m, c, s in (("m/one", "whole", 0.1), ("m/one", "fixed-9-0", 0.4), ("m/two", "whole", 0.2)) for n in range(5)]
    log = spark.createDataFrame(rows, "model string, chunker string, index string, rerank string, rerank_depth int, query_id string, score double")
    got = report.compared(log, "one:whole", resamples=50).collect()
    assert [r.system for r in got] == ["one:fixed-9-0:flat"] and got[0].diff == pytest.approx(0.3)
    lines = report.compare_markdown(report.compared(log, "one:whole", against="M/", resamples=50)).orderBy("place").collect()
    assert [x.line.split(" | ")[:3] for x in lines] == [["| one:fixed-9-0:flat", "0.600", "+0.300"], ["| two:whole:flat", "0.400", "+0.100"]]
    for base in ("m/", "absent"):
        with pytest.raises(ValueError):
            report.compared(log, base)
