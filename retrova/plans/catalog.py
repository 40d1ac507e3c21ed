"""The registry: each query applies an operator to whole tables, and most have the same rows as SQL for a second engine."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import requests as R
from ..functions import text as X
from ..functions import vector as V
from ..operators import answer, chunk, embed, graphindex, metrics, rank, report, search, stats
from ..sources import beir, fvecs, results
from ..streaming import bucket, ingest
from ..streaming import microbatch as waiting
from . import experiment as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SIZE, OVERLAP, K = 100, 20, 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL where it has any."""

    def note(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return note


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder for files that a query writes and reads again: the shared one that the cluster names, or on one machine a temporary one."""
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not shared and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    shared = shared or tempfile.mkdtemp(prefix="retrova-")
    return f"{shared}/{uuid.uuid4().hex}"


# ---- scalar functions over text -------------------------------------------------------------------------------------

WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query("SELECT doc_id, CASE WHEN coalesce(source, '') <> '' THEN source || chr(10) || chr(10) || text ELSE text END AS full_text FROM documents")
def proj_full_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.full_text("source", "text").alias("full_text"))


@query(f"SELECT doc_id, md5(array_to_string({WORDS}, ' ')) AS words_md5 FROM documents")
def words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(X.words("text"), " ")).alias("words_md5"))


@query(f"SELECT doc_id, CAST(len({WORDS}) AS BIGINT) AS n_words FROM documents")
def word_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.word_count("text").alias("n_words"))


SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)),
  lambda s: regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '')), lambda s: s <> '')"""


@query(f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENTENCES} AS s FROM documents))")
def sentences(spark, sf):
    out = table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences("text")).alias("pos", "sentence"))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query(f"SELECT item_id, '{embed.QUERY_PREFIX}' || text AS prefixed FROM benchmark")
def query_prefix(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.prefixed(embed.QUERY_PREFIX, "text").alias("prefixed"))


@query(
    "WITH p AS (SELECT doc_id, text, 'bag-of-words' AS m FROM documents), l AS (SELECT *, printf('%016x', CAST(octet_length(encode(m)) AS BIGINT)) AS hm, printf('%016x', CAST(octet_length(encode(text)) AS BIGINT)) AS ht FROM p)"
    " SELECT doc_id, sha256(unhex(array_to_string(list_reverse(regexp_extract_all(hm, '..')), '')) || encode(m) || unhex(array_to_string(list_reverse(regexp_extract_all(ht, '..')), '')) || encode(text)) AS key FROM l"
)
def cache_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", embed.text_key("bag-of-words", "text").alias("key"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM pages")
def safe_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.safe_name("url").alias("safe"))


@query("SELECT page_id, string_split(url, '/')[-1] AS short FROM pages")
def short_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.short_name("url").alias("short"))


# ---- experiment rows, made of events --------------------------------------------------------------------------------

RUNS = """runs AS (SELECT event_id AS line_no, 'lab/' || event_type AS model, 'fixed-' || (100 + 50 * (user_id % 3)) || '-20' AS chunker,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'hnsw-' || (8 + 8 * (user_id % 2)) || '-100-' || (16 * (1 + event_id % 4)) END AS "index", 100 AS k_chunks,
  CASE WHEN user_id % 5 = 0 THEN 'lab/cross' END AS rerank, CASE WHEN user_id % 5 = 0 THEN 50 END AS rerank_depth, value AS score FROM events)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a log of experiments: the same rows as RUNS."""
    user, event = F.col("user_id"), F.col("event_id")
    index = F.concat(F.lit("hnsw-"), (8 + 8 * (user % 2)).cast("string"), F.lit("-100-"), (16 * (1 + event % 4)).cast("string"))
    return table(spark, sf, "events").select(
        event.alias("line_no"),
        F.concat(F.lit("lab/"), "event_type").alias("model"),
        F.concat(F.lit("fixed-"), (100 + 50 * (user % 3)).cast("string"), F.lit("-20")).alias("chunker"),
        F.when(user % 4 != 0, index).alias("index"),
        F.lit(100).alias("k_chunks"),
        F.lit("").alias("query_prefix"),
        F.when(user % 5 == 0, "lab/cross").alias("rerank"),
        F.when(user % 5 == 0, 50).alias("rerank_depth"),
        F.col("value").alias("score"),
    )


@query(
    f"WITH {RUNS} SELECT line_no, string_split(model, '/')[-1] || ':' || chunker || ':' || coalesce(\"index\", 'flat') || CASE WHEN rerank IS NOT NULL THEN ' + ' || string_split(rerank, '/')[-1] || '@' || rerank_depth ELSE '' END AS label FROM runs"
)
def labels(spark, sf):
    return runs(spark, sf).select("line_no", report.label(F.col("model"), F.col("chunker"), F.coalesce("index", F.lit("flat")), F.col("rerank"), F.col("rerank_depth")).alias("label"))


@query(
    f"WITH {RUNS} SELECT line_no, regexp_replace(\"index\", '-\\d+-\\d+-\\d+$', '') AS kind, CAST(regexp_extract(\"index\", '-(\\d+)$', 1) AS BIGINT) AS beam, regexp_replace(\"index\", '-\\d+$', '') AS graph FROM runs WHERE \"index\" IS NOT NULL"
)
def spec_parse(spark, sf):
    rows = runs(spark, sf).filter(F.col("index").isNotNull())
    return rows.select("line_no", report.kind("index").alias("kind"), report.search_beam("index").alias("beam"), report.graph_key("index").alias("graph"))


@query(
    f"WITH {RUNS} SELECT model, chunker, coalesce(\"index\", 'flat') AS \"index\", line_no, first_seen, round(score, 6) AS score FROM (SELECT *, row_number() OVER (w ORDER BY line_no DESC) AS n, min(line_no) OVER w AS first_seen FROM runs WINDOW w AS (PARTITION BY model, chunker, coalesce(\"index\", 'flat'), k_chunks, coalesce(rerank, ''), coalesce(rerank_depth, 0))) WHERE n = 1"
)
def report_latest(spark, sf):
    out = report.latest(runs(spark, sf), report.KEY)
    return out.select("model", "chunker", F.coalesce("index", F.lit("flat")).alias("index"), "line_no", "first_seen", F.round("score", 6).alias("score"))


@query("WITH b AS (SELECT event_id AS line_no, user_id AS n, event_type AS \"index\", value FROM events) SELECT n, \"index\", line_no, round(value, 6) AS value FROM b QUALIFY row_number() OVER (PARTITION BY n, \"index\" ORDER BY line_no DESC) = 1")
def bench_latest(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("line_no"), F.col("user_id").alias("n"), F.col("event_type").alias("index"), "value")
    return report.latest(rows, {"n": None, "index": None}).select("n", "index", "line_no", F.round("value", 6).alias("value"))


@query(f"WITH {RUNS} SELECT line_no, 'a' AS selector FROM runs WHERE contains(lower(model), 'click') AND chunker = 'fixed-150-20' AND rerank IS NULL UNION ALL SELECT line_no, 'b' FROM runs WHERE contains(lower(model), 'view') AND coalesce(\"index\", 'flat') = 'flat' AND contains(lower(rerank), 'cross')")
def selector(spark, sf):
    rows = runs(spark, sf)
    one = rows.filter(report.matches("CLICK:fixed-150-20::none")).select("line_no", F.lit("a").alias("selector"))
    return one.unionByName(rows.filter(report.matches("view::flat:Cross")).select("line_no", F.lit("b").alias("selector")))


@query(f"WITH {RUNS} SELECT regexp_replace(\"index\", '-\\d+-\\d+-\\d+$', '') AS kind, CAST(regexp_extract(\"index\", '-(\\d+)$', 1) AS BIGINT) AS beam, round(score / 1000, 6) AS recall, round(score, 6) AS p50_ms FROM runs WHERE \"index\" IS NOT NULL AND k_chunks = 100")
def plot_series(spark, sf):
    rows = runs(spark, sf).filter(F.col("index").isNotNull()).select(F.col("k_chunks").cast("long").alias("n"), "index", F.round(F.col("score") / 1000, 6).alias("recall"), F.round("score", 6).alias("p50_ms"))
    return report.series(rows, 100)


# ---- chunkers -------------------------------------------------------------------------------------------------------

def fixed_sql(size: int, overlap: int) -> str:
    """SQL for chunks(doc_id, pos, chunk_id, text) in fixed windows."""
    step = size - overlap
    return f"""w AS (SELECT doc_id, {WORDS} AS w FROM documents),
chunks AS (SELECT doc_id, CAST(i AS BIGINT) AS pos, doc_id || '#' || i AS chunk_id, array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') AS text
  FROM (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= {size} THEN 1 ELSE CAST(ceil((len(w) - {size}) / {step}.0) AS BIGINT) + 1 END)) AS i FROM w))"""


FIXED = fixed_sql(SIZE, OVERLAP)
WHOLE = r"""chunks AS (SELECT doc_id, CAST(0 AS BIGINT) AS pos, doc_id || '#0' AS chunk_id, t AS text FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM documents) WHERE t <> '')"""


@query(f"WITH {WHOLE} SELECT * FROM chunks")
def chunk_whole(spark, sf):
    return chunk.whole(table(spark, sf, "documents"))


@query(f"WITH {FIXED} SELECT * FROM chunks")
def chunk_fixed(spark, sf):
    return chunk.fixed(table(spark, sf, "documents"), SIZE, OVERLAP)


@query(f"WITH {FIXED} SELECT doc_id, count(*) AS n_chunks, string_agg(chunk_id, ',' ORDER BY pos) AS ids FROM chunks GROUP BY doc_id")
def chunk_ids(spark, sf):
    rows = chunk.fixed(table(spark, sf, "documents"), SIZE, OVERLAP)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]), ",")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), ids.alias("ids"))


def packed_sql(units: str) -> str:
    """SQL for chunks(doc_id, pos, chunk_id, text) that pack the units of u(doc_id, u: list of texts)."""
    return f"""WITH RECURSIVE {units},
p AS (SELECT doc_id, u, len(u) AS n, list_concat([0], list_transform(range(1, len(u) + 1), lambda i: list_sum(list_transform(u[1:i], lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')))))) AS p FROM u WHERE len(u) > 0),
r AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS s, list_min(list_filter(range(1, n + 1), lambda e: e = n OR p[e + 2] - p[1] > {SIZE})) AS e FROM p
  UNION ALL
  SELECT doc_id, pos + 1, s2, list_min(list_filter(range(e + 1, n + 1), lambda x: x = n OR p[x + 2] - p[s2 + 1] > {SIZE})) FROM (
    SELECT r.doc_id, r.pos, r.e, p.n, p.p, list_min(list_filter(range(r.s, r.e + 1), lambda j: p.p[r.e + 1] - p.p[j + 1] <= {OVERLAP})) AS s2 FROM r JOIN p USING (doc_id) WHERE r.e < p.n))
SELECT doc_id, pos, doc_id || '#' || pos AS chunk_id, array_to_string(u[s + 1 : e], ' ') AS text FROM r JOIN p USING (doc_id)"""


@query(packed_sql(f"u AS (SELECT doc_id, {SENTENCES} AS u FROM documents)"))
def chunk_sentence(spark, sf):
    return chunk.sentence(table(spark, sf, "documents"), SIZE, OVERLAP)


def _pieces_sql(name: str, of: str, pieces: str, level: int) -> str:
    """SQL for name(doc_id, path, text, n): the pieces of those texts of `of` that have too many words."""
    return f"""{name} AS (SELECT doc_id, list_append(path[1:{level}], i) AS path, x[i] AS text, len(list_filter(regexp_split_to_array(x[i], '\\s+'), lambda w: w <> '')) AS n
  FROM (SELECT doc_id, path, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, path, {pieces} AS x FROM {of} WHERE n > {SIZE})))"""


ATOMS = ", ".join(
    (
        f"t0 AS (SELECT doc_id, CAST([] AS BIGINT[]) AS path, text, {SIZE + 1} AS n FROM documents)",
        _pieces_sql("t1", "t0", r"regexp_split_to_array(text, '\n\s*\n')", 0),
        _pieces_sql("t2", "t1", "string_split(text, chr(10))", 1),
        _pieces_sql("t3", "t2", SENTENCES, 2),
        _pieces_sql("t4", "t3", f"list_transform(range(0, CAST(ceil(n / {SIZE}.0) AS BIGINT)), lambda m: array_to_string({WORDS}[m * {SIZE} + 1 : m * {SIZE} + {SIZE}], ' '))", 3),
        r"u AS (SELECT doc_id, list(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') ORDER BY path) AS u FROM (FROM t1 UNION ALL FROM t2 UNION ALL FROM t3 UNION ALL FROM t4)"
        f" WHERE n BETWEEN 1 AND {SIZE} GROUP BY doc_id)",
    )
)


@query(packed_sql(ATOMS))
def chunk_recursive(spark, sf):
    return chunk.recursive(table(spark, sf, "documents"), SIZE, OVERLAP)


@query(f"WITH {FIXED}, t AS (SELECT len(string_split(text, ' ')) AS n FROM chunks) SELECT round(avg(n), 1) AS tokens_mean, CAST(max(n) AS BIGINT) AS tokens_max, round(avg(CASE WHEN n > 80 THEN 1.0 ELSE 0.0 END), 4) AS truncated_frac FROM t")
def token_stats(spark, sf):
    n = chunk.fixed(table(spark, sf, "documents"), SIZE, OVERLAP).select(X.word_count("text").alias("n"))
    return n.agg(F.round(F.avg("n"), 1).alias("tokens_mean"), F.max("n").alias("tokens_max"), F.round(F.avg((F.col("n") > 80).cast("double")), 4).alias("truncated_frac"))


#: Ids of one sender that share a lane.
LANE = 100_000


@query(f"""WITH RECURSIVE w AS (SELECT source || '/' || doc_id // {LANE} AS lane, doc_id, CAST(len({WORDS}) AS BIGINT) AS n FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY doc_id) AS i FROM w WHERE n <= {embed.TEXT_TOKENS}),
r AS (SELECT lane, doc_id, n, i, CAST(0 AS BIGINT) AS request, CAST(1 AS BIGINT) AS texts, n AS total FROM t WHERE i = 1
  UNION ALL SELECT t.lane, t.doc_id, t.n, t.i, r.request + CASE WHEN b THEN 1 ELSE 0 END, CASE WHEN b THEN 1 ELSE r.texts + 1 END, CASE WHEN b THEN t.n ELSE r.total + t.n END
    FROM (SELECT t.*, r.request AS request0, r.texts = 32 OR r.total + t.n > 4000 AS b FROM t JOIN r ON t.lane = r.lane AND t.i = r.i + 1) t JOIN r ON t.lane = r.lane AND t.i = r.i + 1)
SELECT lane, doc_id, n AS n_tokens, request FROM r UNION ALL SELECT lane, doc_id, n, NULL FROM w WHERE n > {embed.TEXT_TOKENS}""")
def token_batches(spark, sf):
    lane = F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / LANE).cast("string"))
    rows = table(spark, sf, "documents").select(lane.alias("lane"), "doc_id", X.word_count("text").alias("n_tokens"))
    return embed.request_batches(rows, most_texts=32, most_tokens=4_000)


# ---- vectors and search ---------------------------------------------------------------------------------------------

UNIT = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM e)"""
KNN = f"""{UNIT}, s AS (SELECT q.vec_id AS query_id, b.vec_id, list_dot_product(q.v, b.v) AS score FROM u q, u b WHERE q.vec_id % 50 = 0),
knn AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= {K})"""
QRELS = "qrels AS (SELECT q.vec_id AS query_id, b.vec_id AS doc_id, 1 + b.vec_id % 3 AS grade FROM embeddings q JOIN embeddings b ON q.label = b.label AND q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0)"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return table(spark, sf, "embeddings").filter(F.col("vec_id") % 50 == 0)


def knn(spark: SparkSession, sf: str) -> DataFrame:
    return search.batched(asked(spark, sf), table(spark, sf, "embeddings"), K)


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return knn(spark, sf).select("query_id", "rank", F.col("vec_id").alias("doc_id"))


def judgments(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of one label are relevant to each other, with grades of 1 to 3.

    A few labels hold all pairs, so few queries go to the vectors, which are dealt over all cores.
    """
    q = asked(spark, sf).select(F.col("vec_id").alias("query_id"), "label")
    b = search.spread(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    return b.join(search.few(q), "label").filter("query_id <> doc_id").select("query_id", "doc_id", (1 + F.col("doc_id") % 3).alias("grade"))


@query(f"WITH {UNIT} SELECT vec_id, round(v[1], 6) AS first, round(list_sum(v), 6) AS total, round(list_dot_product(v, v), 6) AS squared FROM u")
def normalize(spark, sf):
    v = V.normalize("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(v[0], 6).alias("first"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(V.dot(v, v), 6).alias("squared"))


@query(f"WITH {UNIT}, c AS (SELECT label, min_by(v, vec_id) AS c FROM u GROUP BY label) SELECT vec_id, round(list_dot_product(v, c), 6) AS score FROM u JOIN c USING (label)")
def cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    return e.join(F.broadcast(first), "label").select("vec_id", F.round(V.cosine("embedding", "c"), 6).alias("score"))


@query(f"WITH {KNN} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM knn")
def knn_exact(spark, sf):
    return search.exact(asked(spark, sf), table(spark, sf, "embeddings"), K).withColumn("score", F.round("score", 6))


@query(f"WITH {KNN} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM knn")
def knn_batch(spark, sf):
    return knn(spark, sf).withColumn("score", F.round("score", 6))


@query(
    f"WITH {UNIT}, m AS (SELECT max(vec_id) + 1 AS n FROM u), z AS (SELECT CAST(floor(n * f) AS BIGINT) AS n FROM m, (VALUES (0.25), (0.5), (1.0)) AS t(f)), s AS (SELECT z.n, q.vec_id AS query_id, b.vec_id, list_dot_product(q.v, b.v) AS score FROM z, u q, u b WHERE q.vec_id % 50 = 0 AND b.vec_id < z.n)"
    f" SELECT n, query_id, row_number() OVER (PARTITION BY n, query_id ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY rank <= {K}"
)
def knn_by_size(spark, sf):
    base = table(spark, sf, "embeddings")
    whole = base.agg(F.max("vec_id")).first()[0] + 1
    parts = [search.batched(asked(spark, sf), base.filter(F.col("vec_id") < n), K).select(F.lit(n).cast("long").alias("n"), "query_id", "rank", "vec_id", F.round("score", 6).alias("score")) for n in (int(whole * f) for f in (0.25, 0.5, 1.0))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT label, count(*) AS n, CAST(min(vec_id) AS BIGINT) AS low, CAST(max(vec_id) AS BIGINT) AS high FROM embeddings GROUP BY label")
def union_add(spark, sf):
    e = table(spark, sf, "embeddings")
    cut = e.agg(F.avg("vec_id")).first()[0]
    both = e.filter(F.col("vec_id") < cut).unionByName(e.filter(F.col("vec_id") >= cut))
    return both.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.max("vec_id").alias("high"))


@query(f"WITH {KNN} SELECT query_id, rank, vec_id, label FROM knn JOIN embeddings USING (vec_id)")
def join_chunk_lookup(spark, sf):
    return knn(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id").select("query_id", "rank", "vec_id", "label")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 1000)")
def join_semi(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").filter("n_chars > 1000"), "doc_id", "left_semi")


# ---- metrics --------------------------------------------------------------------------------------------------------

PER_QUERY = f"""{KNN}, {QRELS}, h AS (SELECT knn.query_id, rank, grade FROM knn JOIN qrels ON knn.query_id = qrels.query_id AND knn.vec_id = qrels.doc_id),
g AS (SELECT query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, count(*) AS h10, min(rank) AS first, sum(grade / log2(rank + 1)) AS dcg FROM h GROUP BY query_id),
i AS (SELECT query_id, sum(grade / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM qrels) WHERE r <= {K} GROUP BY query_id),
n AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY query_id),
m AS (SELECT query_id, coalesce(h1 / n, 0.0) AS recall_1, coalesce(h5 / n, 0.0) AS recall_5, coalesce(h10 / n, 0.0) AS recall_10, coalesce(1.0 / first, 0.0) AS mrr, coalesce(dcg / ideal, 0.0) AS ndcg FROM n LEFT JOIN g USING (query_id) JOIN i USING (query_id))"""


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes if not names or c in names))


@query(f"WITH {PER_QUERY} SELECT query_id, round(recall_1, 6) AS recall_1, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10 FROM m")
def recall(spark, sf):
    return _rounded(metrics.per_query(ranked(spark, sf), judgments(spark, sf)), "query_id", "recall_1", "recall_5", "recall_10")


@query(f"WITH {PER_QUERY} SELECT query_id, round(mrr, 6) AS mrr FROM m")
def mrr(spark, sf):
    return _rounded(metrics.per_query(ranked(spark, sf), judgments(spark, sf)), "query_id", "mrr")


@query(f"WITH {PER_QUERY} SELECT query_id, round(ndcg, 6) AS ndcg FROM m")
def per_query_ndcg(spark, sf):
    return _rounded(metrics.per_query(ranked(spark, sf), judgments(spark, sf)), "query_id", "ndcg")


@query(f"WITH {PER_QUERY} SELECT round(avg(ndcg), 6) AS ndcg FROM m")
def ndcg(spark, sf):
    return _rounded(metrics.evaluate(ranked(spark, sf), judgments(spark, sf)), "ndcg")


@query(f"WITH {PER_QUERY} SELECT round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) AS n_queries FROM m")
def metrics_all(spark, sf):
    return _rounded(metrics.evaluate(ranked(spark, sf), judgments(spark, sf)))


@query()
def ann_recall(spark, sf):
    """How much of the exact answer the graph index over all rows finds; a test holds it above a floor."""
    return _rounded(metrics.overlap(hnsw_knn(spark, sf), knn(spark, sf)))


# ---- lexical search, collapsing, re-ranking -------------------------------------------------------------------------

LOWER_WORDS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"


def _bag(passages: str, key: str) -> str:
    """SQL for (query_id, passage, score) by bag-of-words cosine of benchmark items with passages(key, text)."""
    return f"""qt AS (SELECT item_id AS query_id, unnest({LOWER_WORDS}) AS term FROM benchmark), q AS (SELECT query_id, term, count(*) AS n FROM qt GROUP BY ALL),
pt AS (SELECT {key} AS passage, unnest({LOWER_WORDS}) AS term FROM {passages}), p AS (SELECT passage, term, count(*) AS n FROM pt GROUP BY ALL),
lq AS (SELECT query_id, sqrt(sum(n * n)) AS l FROM q GROUP BY query_id), lp AS (SELECT passage, sqrt(sum(n * n)) AS l FROM p GROUP BY passage),
d AS (SELECT query_id, passage, sum(q.n * p.n) AS d FROM q JOIN p USING (term) GROUP BY ALL),
scored AS (SELECT query_id, passage, round(d / (lq.l * lp.l), 9) AS score FROM d JOIN lq USING (query_id) JOIN lp USING (passage))"""


def _bag_hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return embed.bag_best(table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "doc_id", k).withColumnRenamed("vec_id", "doc_id")


@query(f"WITH {_bag('documents', 'doc_id')} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage) AS rank, passage AS doc_id, round(score, 6) AS score FROM scored QUALIFY rank <= {K}")
def bow_cosine(spark, sf):
    return _bag_hits(spark, sf, K).withColumn("score", F.round("score", 6))


def collapsed_sql(chunks: str) -> str:
    """SQL for docs(query_id, rank, doc_id): lexical hits over the given chunks, collapsed."""
    return f"""{chunks}, {_bag('chunks', 'chunk_id')}, hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage) AS rank, passage AS chunk_id, score FROM scored QUALIFY rank <= {E.PASSAGES}),
firsts AS (SELECT query_id, doc_id, min(rank) AS head FROM hits JOIN chunks USING (chunk_id) GROUP BY ALL),
docs AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY head) AS rank, doc_id FROM firsts)"""


def _lexical_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _containing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold an item's whole text are relevant to it (test judgments)."""
    return E.containing(table(spark, sf, "documents"), _lexical_queries(spark, sf))


@query(f"WITH {collapsed_sql(FIXED)} SELECT query_id, rank, doc_id FROM docs")
def collapse_docs(spark, sf):
    hits = E.lexical(table(spark, sf, "documents"), _lexical_queries(spark, sf), f"fixed-{SIZE}-{OVERLAP}")
    return rank.collapse(hits).select("query_id", "rank", "doc_id")


def experiment_sql(spec: str, chunks: str) -> str:
    """SQL for one experiment row."""
    return f"""WITH {collapsed_sql(chunks)}, j AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
h AS (SELECT query_id, rank FROM docs JOIN j USING (query_id, doc_id)), g AS (SELECT query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, min(rank) FILTER (rank <= 10) AS first, sum(1 / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM h GROUP BY query_id),
n AS (SELECT query_id, count(*) AS n FROM j GROUP BY query_id), m AS (SELECT query_id, coalesce(h1 / n, 0.0) AS recall_1, coalesce(h5 / n, 0.0) AS recall_5, coalesce(h10 / n, 0.0) AS recall_10, coalesce(1.0 / first, 0.0) AS mrr, coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))), 0.0) AS ndcg FROM n LEFT JOIN g USING (query_id))
SELECT '{spec}' AS chunker, (SELECT count(*) FROM chunks) AS n_chunks, round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) AS n_queries FROM m"""


@query(experiment_sql(f"fixed-{SIZE}-{OVERLAP}", FIXED))
def experiment(spark, sf):
    return _rounded(E.experiment(table(spark, sf, "documents"), _lexical_queries(spark, sf), _containing(spark, sf), f"fixed-{SIZE}-{OVERLAP}"))


@query(" UNION ALL ".join(f"SELECT * FROM ({experiment_sql(spec, chunks)})" for spec, chunks in (("whole", WHOLE), ("fixed-200-40", fixed_sql(200, 40)), (f"fixed-{SIZE}-{OVERLAP}", FIXED))))
def grid(spark, sf):
    return _rounded(E.grid(table(spark, sf, "documents"), _lexical_queries(spark, sf), _containing(spark, sf), ["whole", "fixed-200-40", f"fixed-{SIZE}-{OVERLAP}"]))


@query(
    f"WITH {_bag('documents', 'doc_id')}, hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage) AS rank, passage AS doc_id FROM scored QUALIFY rank <= 20),"
    f" w AS (SELECT item_id AS query_id, {LOWER_WORDS}[1] AS word FROM benchmark), x AS (SELECT query_id, rank, hits.doc_id, CASE WHEN rank <= 10 THEN CASE WHEN list_contains({LOWER_WORDS}, word) THEN 1.0 / len({LOWER_WORDS}) ELSE 0.0 END END AS new FROM hits JOIN documents USING (doc_id) JOIN w USING (query_id))"
    " SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank <= 10 DESC, new DESC NULLS LAST, rank) AS place, doc_id FROM x"
)
def rerank(spark, sf):
    first = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), X.words(F.lower("text"))[0].alias("word"))
    rows = search.few(_bag_hits(spark, sf, 20)).join(table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text")), "doc_id").join(first, "query_id")
    return rank.rerank(rows, rank.overlap_score(F.col("word"), F.col("text")), 10).select("query_id", "place", "doc_id")


@query(
    f"WITH {UNIT}, s AS (SELECT q.vec_id AS query_id, b.vec_id, b.vec_id // 3 AS doc_id, list_dot_product(q.v, b.v) AS score FROM u q, u b WHERE q.vec_id % 50 = 0), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 100),"
    " f AS (SELECT query_id, doc_id, min(rank) AS head, min_by(score, rank) AS score FROM h GROUP BY ALL), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY head) AS rank, doc_id, score FROM f)"
    " SELECT query_id, rank, r.doc_id, round(score, 4) AS score, coalesce(source, '') AS title FROM r LEFT JOIN documents ON r.doc_id = documents.doc_id WHERE rank <= 10"
)
def service_query(spark, sf):
    """Search as the service does it: 100 passages, three to a document, collapsed, the best 10 documents with their titles."""
    hits = search.batched(asked(spark, sf), table(spark, sf, "embeddings"), E.PASSAGES).withColumn("doc_id", F.floor(F.col("vec_id") / 3).cast("long"))
    titles = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    return rank.collapse(hits, 10).join(titles, "doc_id", "left").select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"), F.coalesce("title", F.lit("")).alias("title"))


@query(
    f"WITH {UNIT}, s AS (SELECT q.vec_id AS query_id, b.vec_id, b.vec_id // 3 AS doc_id, list_dot_product(q.v, b.v) AS score FROM u q, u b WHERE q.vec_id % 50 = 0), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 100),"
    " f AS (SELECT query_id, doc_id, min(rank) AS head FROM h GROUP BY ALL), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY head) AS rank, doc_id FROM f)"
    " SELECT query_id, '{\"query\":' || query_id || ',\"results\":[' || string_agg('{\"doc_id\":' || r.doc_id || ',\"title\":\"' || coalesce(source, '') || '\",\"score\":\"' || rank || '\"}', ',' ORDER BY rank) || ']}' AS body FROM r LEFT JOIN documents ON r.doc_id = documents.doc_id WHERE rank <= 10 GROUP BY query_id"
)
def service_json(spark, sf):
    """The answers of service_query as JSON texts, with the rank in place of the score, so that two engines print the same."""
    return rank.responses(service_query(spark, sf).withColumn("score", F.col("rank").cast("string")))


@query(
    f"WITH {_bag('documents', 'doc_id')}, hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage) AS rank, passage AS doc_id FROM scored QUALIFY rank <= 20),"
    f" w AS (SELECT item_id AS query_id, {LOWER_WORDS} AS words FROM benchmark), x AS (SELECT query_id, rank, hits.doc_id, CASE WHEN rank <= 10 THEN len(list_filter(words, lambda q: list_contains({LOWER_WORDS}, q))) END AS new FROM hits JOIN documents USING (doc_id) JOIN w USING (query_id))"
    " SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank <= 10 DESC, new DESC NULLS LAST, rank) AS place, doc_id FROM x"
)
def rerank_model(spark, sf):
    """The head of each ranking in the order of a model that is sent question and passages."""
    plain = F.array_join(X.words(F.lower("text")), " ")
    asked_ = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), plain.alias("question"))
    rows = search.few(_bag_hits(spark, sf, 20)).join(table(spark, sf, "documents").select("doc_id", plain.alias("passage")), "doc_id").join(asked_, "query_id")
    return rank.rerank_by(rows, rank.WordOverlap(), 10).select("query_id", "place", "doc_id")


def _prepared(spark: SparkSession, sf: str) -> E.Prepared:
    return E.prepare(table(spark, sf, "documents"), _lexical_queries(spark, sf), f"fixed-{SIZE}-{OVERLAP}", embed.HashedWords(), scratch(spark))


@query()
def experiment_dense(spark, sf):
    """Experiment rows over embedded passages: exact search, a graph at two search beams, and a re-ranked head."""
    prepared, judged, graphs = _prepared(spark, sf), _containing(spark, sf).cache(), {}
    rows = [E.dense(prepared, judged, spec, shards=4, graphs=graphs)[0] for spec in ("flat", "hnsw-16-100-64", "hnsw-16-100-128")]
    rows.append(E.dense(prepared, judged, "flat", reranker=rank.WordOverlap(), rerank_depth=10)[0])
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


# ---- answers --------------------------------------------------------------------------------------------------------

ANSWERS = "a AS (SELECT conv_id * 1000 + turn AS question_id, conv_id, turn, text || ' Yes [2]. Also [1][2]. And [7].' AS text FROM conversations WHERE role = 'assistant'), src AS (SELECT a.question_id, c.turn + 1 AS n, c.conv_id || '#' || c.turn AS doc_id, c.role AS title, c.text FROM a JOIN conversations c ON a.conv_id = c.conv_id AND c.turn < a.turn)"


def _answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf, "conversations")
    own = turns.filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "conv_id", F.col("turn").alias("at"), F.concat("text", F.lit(" Yes [2]. Also [1][2]. And [7].")).alias("text"))
    before = own.select("question_id", "conv_id", "at").join(turns, "conv_id").filter("turn < at")
    sources = before.select("question_id", (F.col("turn") + 1).alias("n"), F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), F.col("role").alias("title"), "text")
    return own.select("question_id", "text"), sources


@query(f"WITH {ANSWERS}, f AS (SELECT question_id, unnest(regexp_extract_all(text, '\\[(\\d+)\\]', 1)) AS s, unnest(range(0, len(regexp_extract_all(text, '\\[(\\d+)\\]', 1)))) AS pos FROM a), g AS (SELECT question_id, CAST(s AS BIGINT) AS number, min(pos) AS head FROM f GROUP BY ALL) SELECT g.question_id, head AS \"at\", number, doc_id FROM g LEFT JOIN src ON g.question_id = src.question_id AND g.number = src.n")
def citations(spark, sf):
    return answer.citations(*_answers(spark, sf))


@query(f"WITH {ANSWERS} SELECT question_id, 'Sources:' || chr(10) || chr(10) || string_agg('[' || n || '] ' || title || chr(10) || src.text, chr(10) || chr(10) ORDER BY n) || chr(10) || chr(10) || 'Question: q' || question_id AS prompt FROM src GROUP BY question_id")
def prompt(spark, sf):
    _, sources = _answers(spark, sf)
    return answer.prompts(sources.withColumn("question", F.concat(F.lit("q"), F.col("question_id").cast("string"))))


# ---- statistics -----------------------------------------------------------------------------------------------------

SCORES = "scores AS (SELECT event_type AS system, CAST(user_id AS VARCHAR) AS query_id, avg(value) AS score FROM events GROUP BY ALL)"
BASE = "view"
PAIRS = f"""{SCORES}, a AS (SELECT query_id, score AS a FROM scores WHERE system = '{BASE}'), bs AS (SELECT system, query_id, score AS b FROM scores WHERE system <> '{BASE}'),
ok AS (SELECT system FROM bs LEFT JOIN a USING (query_id) GROUP BY system HAVING count(*) = (SELECT count(*) FROM a) AND count(a.a) = count(*)),
pairs AS (SELECT system, query_id, a, b, b - a AS diff FROM bs JOIN a USING (query_id) WHERE system IN (SELECT system FROM ok))"""
BITS = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
TESTS = f"""fl AS (SELECT system, r, avg(diff * (1 - 2 * ({BITS.format("r || ':' || query_id")} % 2))) AS m FROM pairs, range({stats.RESAMPLES}) t(r) GROUP BY ALL), o AS (SELECT system, avg(diff) AS diff FROM pairs GROUP BY system),
tests AS (SELECT system, o.diff, (count(*) FILTER (abs(m) >= abs(o.diff) - 1e-12) + 1) / {stats.RESAMPLES + 1} AS p FROM fl JOIN o USING (system) GROUP BY system, o.diff)"""
HOLM = "hm AS (SELECT system, diff, p, max(least(1.0, (n - i + 1) * p)) OVER (ORDER BY p, system ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p, system) AS i, count(*) OVER () AS n FROM tests))"
BOOT = f"""nb AS (SELECT system, diff, row_number() OVER (PARTITION BY system ORDER BY query_id) - 1 AS i, count(*) OVER (PARTITION BY system) AS n FROM pairs),
dr AS (SELECT system, r, {BITS.format("r || ':' || i")} % n AS i FROM nb, range({stats.RESAMPLES}) t(r)), bm AS (SELECT system, r, avg(diff) AS m FROM dr JOIN nb USING (system, i) GROUP BY ALL),
boot AS (SELECT system, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bm GROUP BY system)"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("system"), F.col("user_id").cast("string").alias("query_id")).agg(F.avg("value").alias("score"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return stats.paired(scores(spark, sf), BASE)


@query(f"WITH {PAIRS} SELECT system, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(diff), 6) AS diff FROM pairs GROUP BY system")
def paired_diff(spark, sf):
    return _rounded(stats.summary(pairs(spark, sf)))


@query(f"WITH {PAIRS}, {TESTS} SELECT system, round(diff, 6) AS diff, round(p, 6) AS p FROM tests")
def randomization(spark, sf):
    return _rounded(stats.randomization(pairs(spark, sf)))


@query(f"WITH {PAIRS}, {BOOT} SELECT system, round(low, 6) AS low, round(high, 6) AS high FROM boot")
def bootstrap(spark, sf):
    return _rounded(stats.bootstrap(pairs(spark, sf)))


@query(f"WITH {PAIRS}, {TESTS}, {HOLM} SELECT system, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM hm")
def holm(spark, sf):
    return _rounded(stats.holm(stats.randomization(pairs(spark, sf)).select("system", "p")))


VERDICT = "CASE WHEN p_holm < 0.05 THEN CASE WHEN diff > 0 THEN 'better' ELSE 'worse' END ELSE 'no clear difference' END"


@query(f"WITH {PAIRS}, {TESTS}, {HOLM} SELECT system, {VERDICT} AS verdict FROM hm")
def verdict(spark, sf):
    tested = stats.holm(stats.randomization(pairs(spark, sf)))
    return tested.select("system", stats.verdict(F.col("diff"), F.col("p_holm")).alias("verdict"))


@query(f"WITH {PAIRS}, {TESTS}, {HOLM}, {BOOT}, sm AS (SELECT system, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b FROM pairs GROUP BY system) SELECT system, n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(diff, 6) AS diff, round(p, 6) AS p, round(p_holm, 6) AS p_holm, round(low, 6) AS low, round(high, 6) AS high, {VERDICT} AS verdict FROM sm JOIN hm USING (system) JOIN boot USING (system)")
def compare(spark, sf):
    return _rounded(stats.compare(scores(spark, sf), BASE))


COMPARED = f"""{SCORES}, named AS (SELECT system || ':whole:flat' AS system, query_id, score FROM scores WHERE system = '{BASE}' OR contains(system, 'c')),
a AS (SELECT query_id, score AS a FROM named WHERE system = '{BASE}:whole:flat'), bs AS (SELECT system, query_id, score AS b FROM named WHERE system <> '{BASE}:whole:flat'),
ok AS (SELECT system FROM bs LEFT JOIN a USING (query_id) GROUP BY system HAVING count(*) = (SELECT count(*) FROM a) AND count(a.a) = count(*)),
pairs AS (SELECT system, query_id, a, b, b - a AS diff FROM bs JOIN a USING (query_id) WHERE system IN (SELECT system FROM ok))"""


@query(
    f"WITH {COMPARED}, {TESTS}, {HOLM}, {BOOT}, sm AS (SELECT system, avg(b) AS mean_b FROM pairs GROUP BY system) SELECT row_number() OVER (ORDER BY diff DESC, system) AS place,"
    f" '| ' || system || ' | ' || printf('%.3f', mean_b) || ' | ' || printf('%+.3f', diff) || ' | [' || printf('%+.3f', low) || ', ' || printf('%+.3f', high) || '] | ' || printf('%.3f', p) || ' | ' || printf('%.3f', p_holm) || ' | ' || {VERDICT} || ' |' AS line FROM sm JOIN hm USING (system) JOIN boot USING (system)"
)
def compare_table(spark, sf):
    """The comparison's Markdown lines: the systems that a selector fits against one baseline."""
    none = {"rerank": "string", "rerank_depth": "int", "index": "string"}
    log = scores(spark, sf).select(F.col("system").alias("model"), F.lit("whole").alias("chunker"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()), "query_id", "score")
    return report.compare_markdown(report.compared(log, f"{BASE}:whole", against="C"))


# ---- the service's requests -----------------------------------------------------------------------------------------

@query(
    "SELECT 'd' || doc_id AS id, coalesce(length('d' || doc_id) BETWEEN 1 AND 200 AND length(coalesce(source, '')) <= 1000 AND length(text) BETWEEN 1 AND 200000 AND regexp_replace(text, '\\s+', '', 'g') <> '', false) AS valid FROM documents"
    " UNION ALL SELECT 'q' || (conv_id * 1000 + turn), coalesce(length(text) BETWEEN 1 AND 2000 AND regexp_replace(text, '\\s+', '', 'g') <> '' AND turn * 20 BETWEEN 1 AND 100, false) FROM conversations"
)
def validate(spark, sf):
    own = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    docs = table(spark, sf, "documents").select(own.alias("id"), R.document_valid(own, F.col("source"), F.col("text")).alias("valid"))
    asks = table(spark, sf, "conversations").select(F.concat(F.lit("q"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string")).alias("id"), R.query_valid(F.col("text"), F.col("turn") * 20).alias("valid"))
    return docs.unionByName(asks)


REQUESTS = """rq AS (SELECT event_id, CASE WHEN user_id % 9 = 0 THEN '/health' ELSE '/query' END AS path, value * 100000 AS size, user_id % 10 <> 0 AS ready, k.user_id IS NOT NULL AS known,
  CASE event_id % 3 WHEN 0 THEN 'query' WHEN 1 THEN 'answer' ELSE 'documents' END AS endpoint, event_id % 7 <> 0 AS valid, event_id % 11 <> 0 AS allowed, event_id % 2 = 0 AS rr, user_id % 4 = 0 AS has_rr, user_id % 6 <> 0 AS can_answer, user_id % 8 = 0 AS read_only
  FROM events LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') k USING (user_id))"""


@query(
    f"WITH {REQUESTS}, g AS (SELECT *, CASE WHEN size > 10485760 THEN 413 WHEN path = '/health' THEN NULL WHEN NOT ready THEN 503 WHEN NOT known THEN 401 END AS stop FROM rq)"
    " SELECT event_id, CAST(CASE WHEN stop IS NOT NULL THEN stop WHEN NOT valid THEN 422 WHEN endpoint = 'answer' AND NOT can_answer THEN 400 WHEN endpoint = 'documents' AND read_only THEN 403 WHEN NOT allowed THEN 429 WHEN endpoint = 'query' AND rr AND NOT has_rr THEN 400 ELSE 200 END AS BIGINT) AS status FROM g"
)
def gate(spark, sf):
    events = table(spark, sf, "events")
    keys = events.filter("event_type = 'purchase'").select("user_id").distinct().withColumn("known", F.lit(True))
    user, event = F.col("user_id"), F.col("event_id")
    rows = events.join(keys, "user_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    stopped = R.gate(F.when(user % 9 == 0, "/health").otherwise("/query"), F.col("value") * 100_000, user % 10 != 0, F.col("known"))
    endpoint = F.when(event % 3 == 0, "query").when(event % 3 == 1, "answer").otherwise("documents")
    return rows.select("event_id", R.status(stopped, endpoint, event % 7 != 0, event % 11 != 0, event % 2 == 0, user % 4 == 0, user % 6 != 0, user % 8 == 0).alias("status"))


RATE, CAPACITY, COSTS = 20 / 86_400, 30.0, {"purchase": 20.0, "click": 5.0}


@query(f"""WITH RECURSIVE ev AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, CASE event_type WHEN 'purchase' THEN 20.0 WHEN 'click' THEN 5.0 ELSE 1.0 END AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT user_id, i, event_id, s, true AS allowed, CAST({CAPACITY} - cost AS DOUBLE) AS tokens FROM ev WHERE i = 1
  UNION ALL SELECT user_id, i, event_id, s, t >= cost, CASE WHEN t >= cost THEN t - cost ELSE t END FROM (SELECT ev.user_id, ev.i, ev.event_id, ev.s, ev.cost, least(CAST({CAPACITY} AS DOUBLE), b.tokens + greatest(CAST(0 AS DOUBLE), ev.s - b.s) * (CAST(20 AS DOUBLE) / 86400)) AS t FROM b JOIN ev ON ev.user_id = b.user_id AND ev.i = b.i + 1))
SELECT CAST(user_id AS VARCHAR) AS client, event_id, allowed, round(tokens, 5) AS tokens FROM b""")
def token_bucket(spark, sf):
    out = bucket.limit(bucket.from_events(table(spark, sf, "events"), COSTS), RATE, CAPACITY)
    return out.select("client", "event_id", "allowed", F.round("tokens", 5).alias("tokens"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(count(*) / sum(value), 6) AS per_second FROM events GROUP BY event_type")
def latency_pct(spark, sf):
    return _rounded(report.percentiles(table(spark, sf, "events"), "value", "event_type"))


@query("WITH l AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 429 WHEN event_id % 17 = 0 THEN 500 ELSE 200 END AS status FROM events) SELECT event_type, count(*) AS requests, count(*) FILTER (status = 200) AS ok, count(*) FILTER (status = 429) AS limited, count(*) FILTER (status NOT IN (200, 429)) AS errors, round(quantile_cont(value, 0.5) FILTER (status = 200), 6) AS p50, round(quantile_cont(value, 0.99) FILTER (status = 200), 6) AS p99 FROM l GROUP BY event_type")
def loadtest(spark, sf):
    event = F.col("event_id")
    log = table(spark, sf, "events").withColumn("status", F.when(event % 5 == 0, 429).when(event % 17 == 0, 500).otherwise(200))
    ok = F.when(F.col("status") == 200, F.col("value"))
    out = log.groupBy("event_type").agg(F.count("*").alias("requests"), F.count(ok).alias("ok"), F.count_if(F.col("status") == 429).alias("limited"), F.count_if(~F.col("status").isin(200, 429)).alias("errors"), F.percentile(ok, 0.5).alias("p50"), F.percentile(ok, 0.99).alias("p99"))
    return _rounded(out)


@query("WITH w AS (SELECT date_trunc('day', ts) AS d, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS i FROM events), b AS (SELECT d, (i - 1) // 32 AS b, count(*) AS n FROM w GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS texts, count(*) AS batches, round(sum(n) / count(*), 2) AS mean_batch FROM b")
def microbatch(spark, sf):
    return waiting.mean_batch(waiting.batches(table(spark, sf, "events"), window="1 day"))


# ---- sources and stores ---------------------------------------------------------------------------------------------

@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(source, '') AS title, text FROM documents")
def src_corpus(spark, sf):
    """The corpus, written as JSON lines and read by the data-set reader."""
    folder = scratch(spark)
    docs = table(spark, sf, "documents")
    docs.select(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), "text").write.json(folder)
    return beir.corpus(spark, folder)


def _written_qrels(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark)
    rows = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").alias("grade"))
    rows.write.option("sep", "\t").option("header", True).csv(folder)
    return beir.qrels(spark, folder)


@query("SELECT CAST(doc_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS INTEGER) AS grade FROM labels WHERE quality > 0")
def src_qrels(spark, sf):
    return _written_qrels(spark, sf)


@query("SELECT CAST(doc_id AS VARCHAR) AS query_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality > 0)")
def src_queries(spark, sf):
    folder = scratch(spark)
    table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("_id"), "text").write.json(folder)
    return beir.queries(spark, folder, _written_qrels(spark, sf))


@query("SELECT file, row_number() OVER (PARTITION BY file ORDER BY vec_id) - 1 AS vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, CAST(len(embedding) AS BIGINT) AS dim FROM (SELECT *, CAST(label AS VARCHAR) AS file FROM embeddings)")
def src_fvecs(spark, sf):
    """The vectors, as the bytes of one vector file a label, and read back."""
    back = fvecs.decode(fvecs.encode(table(spark, sf, "embeddings"), F.col("label")))
    return back.select("file", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.size("embedding").cast("long").alias("dim"))


@query(f"WITH {FIXED}, n AS (SELECT c.*, row_number() OVER (ORDER BY c.doc_id, c.pos) - 1 AS i FROM chunks c JOIN documents USING (doc_id) WHERE lang <> 'en') SELECT (SELECT count(*) FROM chunks JOIN documents USING (doc_id) WHERE lang = 'en') + i AS vec_id, chunk_id, CAST(doc_id AS VARCHAR) AS doc_id FROM n")
def ingest_new(spark, sf):
    """All documents come in while the English ones are there: the others are cut and numbered on."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), F.lit("").alias("title"), "text", "lang")
    cut = lambda rows: chunk.fixed(rows, SIZE, OVERLAP)
    chunks, titles = ingest.added(docs.filter("lang = 'en'"), *ingest.empty(spark), cut)
    new, _ = ingest.added(docs, chunks, titles, cut)
    return new.select("vec_id", "chunk_id", "doc_id")


@query(f"WITH {FIXED} SELECT chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5 FROM chunks")
def stream_ingest(spark, sf):
    """All documents as a stream of files into a store, and what the store then holds."""
    source, store, marks = scratch(spark), scratch(spark), scratch(spark)
    table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"), F.lit("").alias("title"), "text").repartition(3, "seq").write.parquet(source)
    stream = spark.readStream.schema("seq long, id string, title string, text string").option("maxFilesPerTrigger", 2).parquet(source)
    ingest.ingest_stream(stream, store, lambda rows: chunk.fixed(rows, SIZE, OVERLAP), embedder="bag-of-words", chunker_name=f"fixed-{SIZE}-{OVERLAP}", checkpoint=marks)
    chunks, _ = ingest.load(spark, store, embedder="bag-of-words", chunker=f"fixed-{SIZE}-{OVERLAP}")
    return chunks.select("chunk_id", "doc_id", F.md5("text").alias("text_md5"))


@query(f"WITH {FIXED} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks")
def store_stats(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), F.lit("").alias("title"), "text")
    return ingest.stats(*ingest.added(docs, *ingest.empty(spark), lambda rows: chunk.fixed(rows, SIZE, OVERLAP)))


@query('SELECT CAST(0 AS BIGINT) AS "round", count(DISTINCT text) AS missed FROM benchmark UNION ALL SELECT 1, 0')
def embed_cache(spark, sf):
    """Embed the benchmark twice through one cache: the first round embeds its distinct texts, the second none."""
    items, folder = table(spark, sf, "benchmark"), scratch(spark)
    model = embed.BagOfWords(["the", "and", "of", "de", "la", "und"])
    first = [embed.embed_cached(items, model, folder)[1] for _ in range(2)]
    return spark.createDataFrame([(n, missed) for n, missed in enumerate(first)], "round long, missed long")


@query()
def hnsw_knn(spark, sf):
    """Approximate search over four shards; tests hold its recall against the exact answer."""
    graph = graphindex.build(table(spark, sf, "embeddings"), graphindex.Params(16, 100, 64), 4)
    hits, _ = graphindex.search(graph, asked(spark, sf), K)
    return hits.withColumn("score", F.round("score", 5))


@query()
def hnsw_ef_sweep(spark, sf):
    return E.index_sweep(table(spark, sf, "embeddings"), asked(spark, sf), ["flat", "hnsw-8-64-16", "hnsw-8-64-64"], shards=2)


#: Every query of k hits gets its k hits again, with the same scores.
SAME = f"SELECT CAST(vec_id AS BIGINT) AS query_id, CAST(r AS BIGINT) AS rank, true AS same FROM embeddings, range(1, {K + 1}) t(r) WHERE vec_id % 50 = 0"


@query(SAME)
def hnsw_persist(spark, sf):
    """A graph written and read again gives the answers of the one that was built, hit by hit."""
    folder = scratch(spark)
    graph = graphindex.build(table(spark, sf, "embeddings"), graphindex.Params(8, 64, 32), 2).cache()
    graphindex.save(graph, folder)
    built, _ = graphindex.search(graph, asked(spark, sf), K)
    again, _ = graphindex.search(graphindex.load(spark, folder), asked(spark, sf), K)
    again = again.withColumn("same", F.lit(True))
    return built.join(again, built.columns, "left").select("query_id", "rank", F.coalesce("same", F.lit(False)).alias("same"))


@query(SAME)
def hnsw_grow(spark, sf):
    """A graph of half of the rows that was written, read and then given the others answers as one that got both in turn."""
    folder, rows = scratch(spark), table(spark, sf, "embeddings")
    first, more = rows.filter("vec_id % 4 < 2"), rows.filter("vec_id % 4 >= 2")
    half = graphindex.build(first, graphindex.Params(8, 64, 32), 2).cache()
    graphindex.save(half, folder)
    direct, _ = graphindex.search(graphindex.append(half, more, shards=2), asked(spark, sf), K)
    stored, _ = graphindex.search(graphindex.append(graphindex.load(spark, folder), more, shards=2), asked(spark, sf), K)
    stored = stored.withColumn("same", F.lit(True))
    return direct.join(stored, direct.columns, "left").select("query_id", "rank", F.coalesce("same", F.lit(False)).alias("same"))


@query(f"WITH {KNN} SELECT 'flat' AS \"index\", (SELECT count(*) FROM u) AS n, count(*) AS found, count(*) AS wanted, CAST(1 AS DOUBLE) AS recall, CAST((SELECT count(*) FROM u) AS DOUBLE) AS scored FROM knn")
def bench_row(spark, sf):
    """A bench row of the batched search: its size, recall against the native plan, and vectors compared a query.

    Beyond search.NATIVE_PRODUCTS, which the native plan would take hours to sort, the truth comes the batched way too.
    """
    base = table(spark, sf, "embeddings")
    truth, found, n = search.exact(asked(spark, sf), base, K), knn(spark, sf), base.count()
    return metrics.overlap(found, truth).select(F.lit("flat").alias("index"), F.lit(n).cast("long").alias("n"), "found", "wanted", "recall", F.lit(float(n)).alias("scored"))


@query()
def bench_graph(spark, sf):
    """The bench row of a graph index with its times: build, latency a query, queries a second."""
    return E.benchmark(table(spark, sf, "embeddings"), asked(spark, sf), "hnsw-16-100-64", shards=2)


@query(
    f"WITH {RUNS}, k AS (SELECT *, row_number() OVER (w ORDER BY line_no DESC) AS n, min(line_no) OVER w AS first_seen FROM runs WINDOW w AS (PARTITION BY model, chunker, coalesce(\"index\", 'flat'), k_chunks, coalesce(rerank, ''), coalesce(rerank_depth, 0)))"
    " SELECT row_number() OVER (ORDER BY score DESC, first_seen) AS place, '| ' || string_split(model, '/')[-1] || ' | ' || chunker || ' | ' || coalesce(\"index\", 'flat') || ' | ' || coalesce(string_split(rerank, '/')[-1] || '@' || rerank_depth, '-') || ' | ' || format('{:,}', line_no * 37) || ' | ' || printf('%.1f', 100 * (line_no % 1000 / 1000.0::DOUBLE)) || '% | '"
    " || printf('%.3f', score / 7) || ' | ' || printf('%.3f', score / 11) || ' | ' || printf('%.3f', score / 13) || ' | ' || printf('%.3f', score / 17) || ' | ' || printf('%.3f', coalesce(score / 19, 1.0)) || ' | ' || printf('%.2f', score / 23) || ' | abc1234' || CASE WHEN line_no % 2 = 0 THEN '*' ELSE '' END || ' |' AS line FROM k WHERE n = 1"
)
def report_table(spark, sf):
    """The report's Markdown lines, best first."""
    shares = {"recall_1": 7, "recall_10": 11, "mrr": 13, "ndcg": 17, "ann_recall": 19, "search_p50_ms": 23}
    rows = report.latest(runs(spark, sf), report.KEY).select("*", *((F.col("score") / n).alias(c) for c, n in shares.items()), (F.col("line_no") * 37).alias("n_chunks"), (F.col("line_no") % 1000 / 1000).alias("truncated_frac"))
    return report.markdown(rows.withColumn("commit", F.lit("abc1234")).withColumn("dirty", F.col("line_no") % 2 == 0), "score")


@query(f"WITH {RUNS} SELECT line_no, model FROM runs WHERE contains(model, 'lic')")
def report_model(spark, sf):
    return runs(spark, sf).filter(report.of_model("lic")).select("line_no", "model")


@query(f"WITH {RUNS} SELECT regexp_replace(i, '-\\d+-\\d+-\\d+$', '') AS kind, line_no AS n, round(score, 6) AS p50_ms FROM (SELECT *, coalesce(\"index\", 'flat') AS i FROM runs) WHERE i = 'flat' OR regexp_extract(i, '-(\\d+)$', 1) = '32'")
def size_series(spark, sf):
    """Latency against size: exact search, and graphs at one search beam."""
    rows = runs(spark, sf).select(F.coalesce("index", F.lit("flat")).alias("index"), F.col("line_no").alias("n"), F.round("score", 6).alias("p50_ms"))
    return report.by_size(rows, 32)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM events")
def stamps(spark, sf):
    return table(spark, sf, "events").select("event_id", report.stamp("ts").alias("stamp"))


@query(f'WITH {RUNS} SELECT model, chunker, "index", CAST(k_chunks AS INTEGER) AS k_chunks, rerank, CAST(coalesce(rerank_depth, 0) AS INTEGER) AS rerank_depth FROM runs')
def results_log(spark, sf):
    """Experiment rows appended as JSON lines and read with their line numbers."""
    folder = scratch(spark)
    report.append(runs(spark, sf).drop("line_no", "score"), folder)
    return results.read(spark, folder).select("model", "chunker", "index", "k_chunks", "rerank", F.coalesce("rerank_depth", F.lit(0)).alias("rerank_depth"))
