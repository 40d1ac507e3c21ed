import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from retrova.operators import embed, graphindex, metrics, search
from retrova.plans import experiment as E


def vectors(spark, m):
    return spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(m)], "vec_id long, embedding array<float>")


def test_exact_and_batched_agree_with_numpy(spark):
    m = np.random.default_rng(0).normal(size=(300, 16)).astype(np.float32)
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    base = vectors(spark, m)
    queries = base.filter("vec_id % 50 = 0")
    want = {q: np.argsort(-(u @ u[q]))[:5].tolist() for q in range(0, 300, 50)}
    for rows in (search.exact(queries, base, 5), search.batched(queries, base, 5), search.batched(queries, base, 5, block=2)):
        got = {}
        for r in rows.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want


def test_ties_zero_vectors_and_small_tables(spark):
    base = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 6)) for r in search.batched(base.filter("vec_id = 3"), base, 10).orderBy("rank").collect()]
    assert got == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert search.batched(base.filter("vec_id > 9"), base, 3).count() == 0


def test_equal_vectors_tie_wherever_they_stand(spark, monkeypatch):
    """Copies over several tiles have one score each, so ties go by the id; few pairs and many agree to the last bit."""
    m = np.random.default_rng(3).normal(size=(7, 33)).astype(np.float32)
    base = spark.createDataFrame([(n, m[n % 7].tolist()) for n in range(500)], "vec_id long, embedding array<float>").repartition(3)
    queries = base.filter("vec_id < 7")
    rows = lambda x: sorted((r.query_id, r.rank, r.vec_id, r.score) for r in x.collect())
    native = rows(search.exact(queries, base, 9))
    assert [r[2] for r in native[:9]] == list(range(0, 63, 7))
    monkeypatch.setattr(search, "ROW_TILE", 64)
    monkeypatch.setattr(search, "QUERY_TILE", 3)
    assert rows(search.batched(queries, base, 9)) == native
    monkeypatch.setattr(search, "NATIVE_PRODUCTS", 1_000)
    many = search.exact(queries, base, 9)
    assert rows(many) == native and "NestedLoop" not in many._jdf.queryExecution().executedPlan().toString()


def test_a_task_gives_the_best_of_all_its_batches(spark):
    """What leaves a task is k rows a query, not k rows a query and batch."""
    m = np.random.default_rng(4).normal(size=(400, 8)).astype(np.float32)
    base = vectors(spark, m)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        whole = search.batched(base.filter("vec_id < 3"), base, 5)
        plan = whole._jdf.queryExecution().toString()
        assert "MapInArrow" in plan
        best = search.Best(3, 5, "vec_id")
        rng = np.random.default_rng(5)
        for n in range(300):
            query, score = rng.integers(0, 3, 1_000), rng.integers(0, 50, 1_000).astype(float)
            best.add(query, score, pa.record_batch([pa.array(range(n * 1_000, n * 1_000 + 1_000))], ["vec_id"]))
            assert best.rows <= best.most + 1_000
        got = [r for b in best.out(pa.array(["a", "b", "c"])) for r in b.to_pylist()]
        assert len(got) == 15 and all(r["score"] == 49 for r in got)
        assert whole.count() == 15
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def bag_ranks(items, passages, k):
    bags = lambda rows: {n: Counter((t or "").lower().split()) for n, t in rows}
    length = lambda b: math.sqrt(sum(n * n for n in b.values()))
    out = []
    for q, a in bags(items).items():
        scored = [(-round(d / (length(a) * length(b)), 9), p) for p, b in bags(passages).items() if (d := sum(n * b[w] for w, n in a.items()))]
        out += [(q, n + 1, p, -s) for n, (s, p) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_best_passages_by_words_against_all_pairs(spark, monkeypatch):
    """The ranking by all pairs, over blocks of queries and runs of passages; ties at the last place go by the id as text."""
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(rng.choice(["a", "B", "b", "c", "d", "\u00c9", "\u00e9"], n))
    passages = [(f"{n}#0", text(rng.integers(1, 5))) for n in range(300)] + [("x", None), ("y", " ")]
    items = [(n, text(rng.integers(1, 4))) for n in range(9)] + [(20, None), (21, ""), (22, "absent")]
    rows = spark.createDataFrame(passages, "chunk_id string, text string").repartition(3)
    asked = spark.createDataFrame(items, "query_id long, text string")
    for pairs, block in ((1_000_000, 4_096), (20, 4)):
        monkeypatch.setattr(embed, "PAIRS", pairs)
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        best = embed.bag_best(asked, rows, "query_id", "chunk_id", 12, keep=("text",))
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in best.collect()) == bag_ranks(items, passages, 12)


def test_lexical_search_shuffles_no_words(spark):
    """Neither words nor pairs of texts are joined: there is no join in the plan, and k rows a query and task are shuffled."""
    docs = spark.createDataFrame([(n, f"the word {n} of the text") for n in range(200)], "doc_id long, text string")
    hits = E.lexical(docs, spark.createDataFrame([(1, "the text 7")], "query_id long, text string"), "fixed-3-1", 2)
    assert "Join" not in hits._jdf.queryExecution().executedPlan().toString()
    assert [(r.rank, r.chunk_id) for r in hits.orderBy("rank").collect()] == [(1, "0#2"), (2, "1#2")]


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(0).normal(size=(1_000, 16)).astype(np.float32)


def test_graph_recall_limits_and_same_seed(cloud):
    params = graphindex.Params(8, 64, 32)
    g = graphindex.Graph(16, params)
    g.add(cloud)
    u = cloud / np.linalg.norm(cloud, axis=1, keepdims=True)
    queries = np.random.default_rng(1).normal(size=(30, 16)).astype(np.float32)
    found = 0
    for q in queries:
        ids, scores, scored = g.search(q, 10)
        found += len(set(ids.tolist()) & set(np.argsort(-(u @ q))[:10].tolist()))
        assert (np.diff(scores) <= 0).all() and scored < 1_000
    assert found >= 0.95 * 300
    for node in range(1_000):
        for layer, links in enumerate(g.links_of(node)):
            assert node not in links and len(set(links)) == len(links) <= (8 if layer else 16) and (g.level[links] >= layer).all()
    other = graphindex.Graph(16, params)
    other.add(cloud[:1])
    other.add(cloud[1:])  # batches draw on where the one before stopped
    assert (other.links == g.links).all() and other.entry == g.entry == int(np.argmax(g.level))
    with pytest.raises(ValueError):
        g.add(cloud[:, :3])


def test_a_wider_beam_leaves_a_dead_end():
    # points on a paraboloid: the inner product with (2x, 2y, -1) orders them by distance; C is a dead end on the way to F
    points = np.array([[1, 0], [0.9, 0.3], [0.8, 0.5], [0.4, 0.7], [0.3, 0.9], [0, 1]], np.float32)
    empty = graphindex.Graph(2, graphindex.Params(2, 4, 1))
    empty.entry = 0
    g = graphindex.Graph.of(points, [[[1, 3]], [[0, 2]], [[1]], [[0, 4]], [[3, 5]], [[4]]], empty.facts())
    query = np.array([0.1, 1], np.float32)
    assert g.search(query, 1, beam=1)[0].tolist() == [4] or g.search(query, 1, beam=1)[0].tolist() == [5]
    assert 5 in g.search(query, 6, beam=6)[0].tolist()


def test_graph_tables_persist_and_grow(spark, cloud, tmp_path):
    params = graphindex.Params(8, 64, 32)
    base = vectors(spark, cloud[:400])
    graph = graphindex.build(base.filter("vec_id < 300"), params, 1).cache()
    graphindex.save(graph, str(tmp_path / "graph"))
    stored = graphindex.load(spark, str(tmp_path / "graph"))
    queries = base.filter("vec_id % 50 = 0")
    answers = lambda g: sorted((r.query_id, r.rank, r.vec_id) for r in graphindex.search(g, queries, 5)[0].collect())
    assert answers(graph) == answers(stored)
    whole = graphindex.build(base, params, 1).cache()
    rows = lambda g: sorted((r.node, r.vec_id, r.links, r.facts) for r in g.collect())
    assert rows(graphindex.append(stored, base.filter("vec_id >= 300"))) == rows(whole)  # parameters and draws are those stored
    truth = search.batched(queries, base, 5)
    assert metrics.overlap(graphindex.search(whole, queries, 5)[0], truth).first().recall >= 0.9


def test_an_empty_graph_is_written_read_and_grown(spark, cloud, tmp_path):
    base, params = vectors(spark, cloud[:60]), graphindex.Params(4, 32, 16)
    empty = graphindex.build(base.limit(0), params)
    graphindex.save(empty, str(tmp_path / "none"))
    stored = graphindex.load(spark, str(tmp_path / "none"))
    assert stored.count() == 0 and graphindex.search(stored, base, 3)[0].count() == 0
    assert graphindex.search(graphindex.append(stored, base, params), base.filter("vec_id < 5"), 3)[0].count() == 15
    assert graphindex.search(stored, base.limit(0), 3)[0].count() == 0


def test_a_walk_takes_few_steps_and_keys_sort_as_scores(spark, cloud, monkeypatch):
    score, node = np.array([-1.5, 0.25, 0.25, -0.1, 3e-9], np.float32), np.array([7, 1, 2**30, 0, 5], np.int32)
    keys = graphindex._keys(score, node)
    assert np.argsort(-keys).tolist() == np.lexsort((-node, -score)).tolist()
    assert graphindex._told(keys)[0].tolist() == node.tolist() and graphindex._told(keys)[1].tolist() == score.tolist()
    g = graphindex.Graph(16, graphindex.Params(8, 64, 64))
    g.add(cloud)
    steps, made = [], graphindex._keys
    monkeypatch.setattr(graphindex, "_keys", lambda *x: steps.append(1) or made(*x))
    found, scores, scored = g.search(cloud[3], 10)
    assert found[0] == 3 and len(set(found.tolist())) == 10 and (np.diff(scores) <= 0).all()
    assert len(steps) <= 24 and scored < 1_000  # 64 nodes are looked at, 8 at once
    base = vectors(spark, cloud[:90])
    graph = graphindex.build(base, graphindex.Params(4, 32, 16), 2).cache()
    rows = lambda: sorted((r.query_id, r.rank, r.vec_id) for r in graphindex.search(graph, base, 3)[0].collect())
    whole = rows()
    monkeypatch.setattr(graphindex, "QUERY_NUMBERS", 200)
    assert rows() == whole and len(whole) == 270


def test_specs():
    assert graphindex.parse_index("flat")[0] == "flat"
    assert graphindex.parse_index("hnsw-16-200-50") == ("hnsw", graphindex.Params(16, 200, 50))
    assert graphindex.graph_key("hnsw-16-200-50") == "hnsw-16-200" == graphindex.graph_key("hnsw-16-200-9")
    for bad in ("hnsw", "hnsw-1-2", "tree-1-2-3", "hnsw-1-2-3"):
        with pytest.raises(ValueError):
            graphindex.parse_index(bad)
