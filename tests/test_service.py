import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrova.functions import requests as R
from retrova.operators import answer, chunk, embed, models, rank
from retrova.sources import beir, fvecs, results
from retrova.streaming import bucket, ingest, microbatch


def test_bucket_arithmetic():
    b = bucket.Bucket(2, 4)
    got = [b.allow(t, c)[0] for t, c in ((0, 3), (0, 3), (1, 3), (100, 4), (100, 5))]
    assert got == [True, False, True, True, False] and b.allow(100, 5) == (False, None)
    assert bucket.retry_after(None) is None and bucket.retry_after(0.2) == 1 and bucket.retry_after(2.6) == 3
    with pytest.raises(ValueError):
        bucket.Bucket(0, 1)


def test_bucket_batch_and_stream_agree(spark, tmp_path):
    rows = [(f"c{n % 3}", n, float(n), 1.0 + n % 4) for n in range(60)]
    df = spark.createDataFrame(rows, "client string, event_id long, seconds double, cost double")
    want = sorted((r.event_id, r.allowed, r.tokens) for r in bucket.limit(df, 0.5, 5.0).collect())
    for n in range(3):
        df.filter((F.col("event_id") >= 20 * n) & (F.col("event_id") < 20 * n + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = bucket.limit_stream(stream, 0.5, 5.0).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.event_id, r.allowed, r.tokens) for r in spark.table("limited").collect()) == want


def test_citations_and_prompt(spark):
    answers = spark.createDataFrame([(1, "Yes [2]. Also [1][2]. And [7].")], "question_id long, text string")
    sources = spark.createDataFrame([(1, "q?", 1, "d1", "T1", "x"), (1, "q?", 2, "d2", "T2", "y")], "question_id long, question string, n int, doc_id string, title string, text string")
    got = [(r.number, r.doc_id) for r in answer.citations(answers, sources).orderBy("at").collect()]
    assert got == [(2, "d2"), (1, "d1"), (7, None)]
    assert answer.prompts(sources).first().prompt == "Sources:\n\n[1] T1\nx\n\n[2] T2\ny\n\nQuestion: q?"
    asked = spark.createDataFrame([("a",), (None,)], "prompt string")
    assert sorted(r.answer for r in answer.answer(asked, lambda p: [x.upper() for x in p]).collect()) == ["A", answer.NO_SOURCES]


def test_gates_in_order(spark):
    t, f = F.lit(True), F.lit(False)
    first = lambda c: spark.range(1).select(c).first()[0]
    assert first(R.gate(F.lit("/query"), F.lit(R.MAX_BODY + 1), f, f)) == 413
    assert first(R.gate(F.lit("/query"), F.lit(1), f, f)) == 503 and first(R.gate(F.lit("/query"), F.lit(1), t, f)) == 401
    assert first(R.gate(F.lit("/health"), F.lit(1), f, f)) is None
    none = F.lit(None).cast("long")
    assert first(R.status(none, F.lit("query"), t, f, t, f, t, f)) == 429 and first(R.status(none, F.lit("query"), t, t, t, f, t, f)) == 400
    assert first(R.status(none, F.lit("answer"), t, f, f, f, f, f)) == 400 and first(R.status(none, F.lit("documents"), t, f, f, f, t, t)) == 403
    assert first(R.cost(F.lit("query"), t)) == 5 and first(R.cost(F.lit("answer"), f)) == 20
    assert first(R.query_valid(F.lit(" "), F.lit(3))) is False and first(R.query_valid(F.lit("x"), F.lit(None).cast("int"))) is True


def test_request_batches():
    assert np.bincount(embed.batch_numbers([1] * 8, most_texts=3)).tolist() == [3, 3, 2]
    assert np.bincount(embed.batch_numbers([3, 2, 4, 1], most_tokens=5)).tolist() == [2, 2]
    with pytest.raises(ValueError):
        embed.batch_numbers([9_000])


def test_embedding_cache(spark, tmp_path):
    model = embed.BagOfWords(["apple", "cherry"])
    docs = spark.createDataFrame([("a", "apple apple"), ("b", "cherry"), ("c", "cherry")], "id string, text string")
    rows, missed = embed.embed_cached(docs, model, str(tmp_path))
    assert missed == 2 and {r.id: r.vector for r in rows.collect()} == {"a": [2.0, 0.0], "b": [0.0, 1.0], "c": [0.0, 1.0]}
    assert embed.embed_cached(docs, model, str(tmp_path))[1] == 0
    with pytest.raises(ValueError):
        embed.embed_cached(docs, embed.BagOfWords(["apple"]), str(tmp_path))
    with pytest.raises(ValueError):
        models.make_model("absent")


def test_data_set_files(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps(x) for x in ({"_id": "1", "title": "t", "text": "a"}, {"_id": "2", "text": "b"}, {"_id": "1", "title": "u", "text": "c"})))
    (tmp_path / "queries.jsonl").write_text("\n".join(json.dumps({"_id": i, "text": i}) for i in ("q1", "q2", "q3")))
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\t1\t1\nq2\t2\t0\nq1\t1\t2\n")
    docs, queries, qrels = beir.load(spark, str(tmp_path))
    assert sorted(map(tuple, docs.collect())) == [("1", "u", "c"), ("2", "", "b")]
    assert [r.query_id for r in queries.collect()] == ["q1"] and [tuple(r) for r in qrels.collect()] == [("q1", "1", 2)]


def test_vector_files(spark, tmp_path):
    m = np.arange(12, dtype="<f4").reshape(3, 4)
    raw = b"".join(np.int32(4).tobytes() + v.tobytes() for v in m)
    (tmp_path / "x.fvecs").write_bytes(raw)
    got = fvecs.read(spark, str(tmp_path / "x.fvecs"), 2).orderBy("vec_id").collect()
    assert [r.embedding for r in got] == m[:2].tolist()
    with pytest.raises(ValueError):
        fvecs.parse(raw[:20] + np.int32(9).tobytes() + raw[24:])


def test_results_skip_blank_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"model": "m", "metrics": {"a": 1.0}}\n\n{"model": "n", "per_query_ndcg@10": {"q": 0.5}}\n')
    rows = results.read(spark, str(tmp_path / "log.jsonl"))
    assert [r.model for r in rows.orderBy("line_no").collect()] == ["m", "n"]
    assert [tuple(r) for r in results.per_query(rows, F.col("model")).collect()] == [("n", "q", 0.5)]


def test_ingest_versions_and_recovery(spark, tmp_path):
    cut = lambda rows: chunk.fixed(rows, 2, 0)
    schema, folder, names = "seq long, id string, title string, text string", str(tmp_path / "s"), {"embedder": "e", "chunker": "c"}
    first = spark.createDataFrame([(0, "a", "", "x y z"), (1, "b", None, "w"), (2, "a", "", "q")], schema)
    chunks, titles = ingest.added(first, *ingest.empty(spark), cut)
    assert sorted((r.vec_id, r.chunk_id, r.text) for r in chunks.collect()) == [(0, "a#0", "q"), (1, "b#0", "w")]
    ingest.save(chunks, titles, folder, **names)
    (tmp_path / "s/v2/chunks").mkdir(parents=True)  # a crash before the manifest
    chunks, titles = ingest.load(spark, folder, **names)
    more, new = ingest.added(spark.createDataFrame([(0, "b", "", "again"), (1, "c", "t", "m n o")], schema), chunks, titles, cut)
    assert sorted((r.vec_id, r.text) for r in more.collect()) == [(2, "t m"), (3, "n o")] and new.count() == 1
    blank, none = ingest.added(spark.createDataFrame([(0, "z", "", " ")], schema), chunks, titles, cut)
    assert blank.count() == 0 and none.count() == 0
    with pytest.raises(ValueError):
        ingest.load(spark, folder, embedder="other", chunker="c")
    (tmp_path / "s/v1/manifest/part-x.txt").write_text("{")
    with pytest.raises(ValueError):
        ingest.load(spark, folder, **names)


def test_micro_batches(spark):
    events = spark.range(70).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 40)).alias("ts"))
    assert sorted(r.n for r in microbatch.batches(events).collect()) == [8, 30, 32]
    assert tuple(microbatch.mean_batch(microbatch.batches(events)).first()) == (70, 3, 23.33)


def test_store_grows_by_what_is_new(spark, tmp_path, monkeypatch):
    cut, folder = (lambda rows: chunk.fixed(rows, 2, 0)), str(tmp_path / "s")
    names, schema = {"embedder": "e", "chunker_name": "c"}, "seq long, id string, title string, text string"
    docs = spark.createDataFrame([(n, f"d{n}", "", f"a b c{n}") for n in range(7)], schema)
    model, told = embed.HashedWords(8), []
    ingest.build(docs, folder, cut, vectors=lambda rows: embed.embed(rows, model), batch=3, progress=lambda *x: told.append(x), **names)
    assert told == [(0, 7), (3, 7), (6, 7), (7, 7)]
    chunks, titles = ingest.load(spark, folder, embedder="e", chunker="c")
    rows = chunks.orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(14)) and titles.count() == 7
    assert rows[3].vector == model.embed([rows[3].text])[0].tolist()
    assert spark.read.parquet(f"{folder}/v3/chunks").count() == 2  # only its own
    assert ingest.add(docs, folder, cut, **names) is None and ingest.load(spark, folder, embedder="e", chunker="c")[0].count() == 14
    monkeypatch.setattr(ingest, "MOST_PARTS", 3)
    more = spark.createDataFrame([(0, "x", "t", "y")], schema)
    ingest.add(more, folder, cut, vectors=lambda rows: embed.embed(rows, model), **names)
    assert spark.read.parquet(f"{folder}/v4/chunks").count() == 15
    assert ingest.load(spark, folder, embedder="e", chunker="c")[0].count() == 15
    ingest.build(docs.limit(0), str(tmp_path / "none"), cut, **names)


def test_new_documents_are_cut_twice_and_kept_only_meanwhile(spark, tmp_path):
    """Once to count their passages and once to write them, however many tables are written."""
    seen, before = spark.sparkContext.accumulator(0), spark.sparkContext._jsc.getPersistentRDDs().size()

    def noted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(n, f"d{n % 40}", "", f"a b c{n}") for n in range(50)], "seq long, id string, title string, text string")
    cut = lambda rows: chunk.fixed(rows.mapInArrow(noted, rows.schema), 2, 0)
    ingest.add(docs, str(tmp_path / "s"), cut, embedder="e", chunker_name="c")
    assert seen.value == 80 and spark.sparkContext._jsc.getPersistentRDDs().size() == before
    chunks, titles = ingest.load(spark, str(tmp_path / "s"), embedder="e", chunker="c")
    assert [r.vec_id for r in chunks.orderBy("vec_id").collect()] == list(range(80)) and titles.count() == 40


def test_hosted_models(spark):
    class Backwards:
        """A hosted client that answers in reverse order and notes the size of its requests."""

        sizes: list = []

        def embeddings(self, model, texts):
            self.sizes.append(len(texts))
            return [(n, [float(len(t))] * 1_536) for n, t in reversed(list(enumerate(texts)))]

        def complete(self, model, system, user):
            return f" {system}:{user} "

    hosted = models.HostedEmbedder(client=Backwards, count=lambda texts: [len(t) for t in texts])
    assert hosted.embed(["a", "bbb", "cc"])[:, 0].tolist() == [1, 3, 2] and Backwards.sizes == [3]
    hosted.embed(["x" * 8_000] * 40)
    assert Backwards.sizes[1:] == [31, 9] and hosted.embed([]).shape == (0, 1_536)
    with pytest.raises(ValueError):
        hosted.embed(["x" * 9_000])
    with pytest.raises(ValueError):
        models.HostedEmbedder("absent", client=Backwards)
    prompts = spark.createDataFrame([("q",), (None,)], "prompt string")
    got = answer.answer(prompts, models.HostedAnswerer("m", "s", client=Backwards)).collect()
    assert sorted(r.answer for r in got) == [answer.NO_SOURCES, "s:q"]


@pytest.mark.parametrize("name", ["minilm", "openai-small"])
def test_models_without_their_library_say_so(name, monkeypatch):
    monkeypatch.setattr(models.importlib.util, "find_spec", lambda _: None)
    with pytest.raises(RuntimeError, match="isn't installed"):
        models.make_model(name)


def test_rerank_by_a_model(spark):
    rows = [(1, 1, "a", "x"), (1, 2, "b", "red car"), (1, 3, "c", None), (1, 4, "d", "red car too"), (2, 1, "e", "red"), (2, 2, "f", "blue sky")]
    hits = spark.createDataFrame([(q, r, d, 1.0 / r, {1: "red car", 2: "blue"}[q], p) for q, r, d, p in rows], "query_id long, rank long, doc_id string, score double, question string, passage string")
    got = rank.rerank_by(hits, rank.WordOverlap(), 3).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.doc_id, r.score) for r in got] == [(1, "b", 2.0), (1, "a", 0.0), (1, "c", 0.0), (1, "d", 0.25), (2, "f", 1.0), (2, "e", 0.0)]


def test_base_and_query_vectors(spark, tmp_path):
    for name, n in (("sift_base", 5), ("sift_query", 2)):
        (tmp_path / f"{name}.fvecs").write_bytes(b"".join(np.int32(2).tobytes() + np.array([n, i], "<f4").tobytes() for i in range(n)))
    base, queries = fvecs.load_pair(spark, str(tmp_path), most=(4, None))
    assert [r.embedding for r in base.orderBy("vec_id").collect()] == [[5.0, float(i)] for i in range(4)] and queries.count() == 2


def test_over_limit_texts_have_no_request(spark):
    rows = spark.createDataFrame([("l", n, t) for n, t in enumerate([3, 9_000, 2, None])], "lane string, doc_id long, n_tokens long")
    assert [r.request for r in embed.request_batches(rows, most_tokens=4).orderBy("doc_id").collect()] == [0, None, 1, None]
