import math

import numpy as np
import pytest

from retrova.operators import metrics, rank, report, search, stats


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_metrics_by_hand(spark):
    ranked = rows(spark, [("q1", 1, "a"), ("q1", 2, "b"), ("q1", 3, "c"), ("q2", 1, "x")], "query_id string, rank long, doc_id string")
    qrels = rows(spark, [("q1", "b", 2), ("q1", "z", 1), ("q2", "y", 1), ("q3", "a", 1), ("q1", "a", 0)], "query_id string, doc_id string, grade int")
    each = {r.query_id: r for r in metrics.per_query(ranked, qrels).collect()}
    assert each["q1"].recall_1 == 0 and each["q1"].recall_5 == 0.5 and each["q1"].mrr == 0.5
    assert each["q1"].ndcg == pytest.approx((2 / 1.584962500721156) / (2 + 1 / 1.584962500721156))
    assert each["q2"].ndcg == 0 and each["q3"].mrr == 0
    assert metrics.evaluate(ranked, qrels).first().n_queries == 3


def test_many_judgments_are_counted_by_grade(spark, monkeypatch):
    """Gains of many judgments of few grades as over all of them in order; no sort of the judgments, and the hits go to them."""
    data = [(q, d, (d * 7 + q) % 4) for q in range(3) for d in range(40 + q)] + [(9, 1, 3)]
    ranked = rows(spark, [(q, n + 1, (n * 11 + q) % 40) for q in range(3) for n in range(20)], "query_id long, rank long, doc_id long")
    qrels = rows(spark, data, "query_id long, doc_id long, grade int")
    want = {}
    for q in (0, 1, 2, 9):
        own = {d: g for k, d, g in data if k == q and g}
        ideal = sum(g / math.log2(n + 2) for n, g in enumerate(sorted(own.values(), reverse=True)[:10]))
        want[q] = sum(own.get((n * 11 + q) % 40, 0) / math.log2(n + 2) for n in range(10)) / ideal if q < 9 else 0.0
    for most in (1_000_000, 3):
        monkeypatch.setattr(search, "BROADCAST_ROWS", most)
        each = metrics.per_query(ranked, qrels)
        assert {r.query_id: r.ndcg for r in each.collect()} == pytest.approx(want)
        plan = each._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" not in plan and ("strategy=broadcast" in plan) == (most > 3)


def test_collapse_and_rerank(spark):
    hits = rows(spark, [("q", 1, "d1", 0.9, "x"), ("q", 2, "d1", 0.8, "q y"), ("q", 3, "d2", 0.7, "q"), ("q", 4, "d3", 0.6, "q")], "query_id string, rank long, doc_id string, score double, text string")
    assert [(r.rank, r.doc_id, r.score) for r in rank.collapse(hits).orderBy("rank").collect()] == [(1, "d1", 0.9), (2, "d2", 0.7), (3, "d3", 0.6)]
    assert rank.collapse(hits, 2).count() == 2
    from pyspark.sql import functions as F

    again = rank.rerank(hits, rank.overlap_score(F.col("query_id"), F.col("text")), 3)
    assert [(r.rank, r.place) for r in again.orderBy("place").collect()] == [(3, 1), (2, 2), (1, 3), (4, 4)]


def test_holm_and_randomization(spark):
    tests = rows(spark, [("a", 0.04), ("b", 0.01), ("c", 0.02)], "system string, p double")
    assert {r.system: round(r.p_holm, 6) for r in stats.holm(tests).collect()} == {"a": 0.04, "b": 0.03, "c": 0.04}
    scores = rows(spark, [(s, str(q), v) for q in range(20) for s, v in (("base", 0.0), ("up", 1.0), ("same", 0.0))], "system string, query_id string, score double")
    pairs = stats.paired(scores, "base").cache()
    p = {r.system: r.p for r in stats.randomization(pairs, 200).collect()}
    assert p["same"] == 1.0 and p["up"] < 0.05
    ends = {r.system: (r.low, r.high) for r in stats.bootstrap(pairs, 50).collect()}
    assert ends["up"] == (1.0, 1.0) and ends["same"] == (0.0, 0.0)
    assert {r.system: r.verdict for r in stats.compare(scores, "base", resamples=200).collect()} == {"up": "better", "same": "no clear difference"}
    short = scores.filter("not (system = 'up' and query_id = '3')")
    assert {r.system for r in stats.paired(short, "base").select("system").distinct().collect()} == {"same"}
    with pytest.raises(ValueError):
        stats.compare(scores, "none")


def test_resamples_are_those_of_the_reference(spark):
    import inspect

    assert all(inspect.signature(f).parameters["resamples"].default == 10_000 for f in (stats.randomization, stats.bootstrap, stats.compare))
    scores = rows(spark, [(s, str(q), v) for q in range(20) for s, v in (("base", 0.0), ("up", 1.0), ("down", -1.0))], "system string, query_id string, score double")
    assert {r.system: round(r.p * 10_001) for r in stats.randomization(stats.paired(scores, "base")).collect()} == {"up": 1, "down": 1}


def by_hand(scores, n, resamples):
    """p and the ends of the interval by hashlib, a resample after the other; scores is a list of (query, difference or None)."""
    import hashlib

    bits = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    mean = lambda v: sum(x for x in v if x is not None) / sum(x is not None for x in v)
    seen = mean([d for _, d in scores])
    flips = [mean([d if d is None else d * (1 - 2 * (bits(f"{r}:{q}") % 2)) for q, d in scores]) for r in range(resamples)]
    drawn = [mean([scores[bits(f"{r}:{i}") % n][1] for i in range(n)]) for r in range(resamples)]
    return (sum(abs(m) >= abs(seen) - 1e-12 for m in flips) + 1) / (resamples + 1), np.percentile(drawn, 2.5), np.percentile(drawn, 97.5)


@pytest.mark.parametrize("table", [4_000_000, 50])
def test_resampling_by_hand_and_without_rows(spark, monkeypatch, table):
    """Signs and draws as hashlib gives them, for ids of all lengths, systems of two sizes, nulls, and a table that goes out in parts; nothing is a row a draw."""
    monkeypatch.setattr(stats, "TABLE", table)
    rng, resamples = np.random.default_rng(7), 130
    ids = sorted(f"q{n}" if n % 9 else "\u00e9" * n for n in range(1, 64))
    diffs = {s: [(q, None if s == "gap" and n % 5 == 0 else float(rng.normal(0.3))) for n, q in enumerate(ids[:size])] for s, size in (("one", 63), ("gap", 63), ("few", 20))}
    pairs = rows(spark, [(s, q, d) for s, own in diffs.items() for q, d in own], "system string, query_id string, diff double").repartition(3)
    tests, ends = stats.randomization(pairs, resamples), stats.bootstrap(pairs, resamples)
    p, ends_of = {r.system: r.p for r in tests.collect()}, {r.system: (r.low, r.high) for r in ends.collect()}
    for system, own in diffs.items():
        want = by_hand(own, len(own), resamples)
        assert (p[system], *ends_of[system]) == pytest.approx(want, abs=1e-12)
    assert not any("CartesianProduct" in x or "NestedLoop" in x for x in (d._jdf.queryExecution().executedPlan().toString() for d in (tests, ends)))


def test_latest_and_selectors(spark):
    schema = "line_no long, model string, chunker string, index string, k_chunks int, query_prefix string, rerank string, rerank_depth int"
    log = rows(spark, [(1, "a/m", "whole", None, 10, None, None, None), (2, "a/m", "whole", "flat", 10, "", None, None), (3, "a/M2", "whole", "flat", 10, "", "x/CE", 50)], schema)
    assert sorted((r.line_no, r.first_seen) for r in report.latest(log, report.KEY).collect()) == [(2, 1), (3, 3)]
    count = lambda s: log.filter(report.matches(s)).count()
    assert (count("M"), count("m2"), count("m:whole:flat:none"), count("m:::ce"), count("m:fixed")) == (3, 1, 2, 1, 0)
