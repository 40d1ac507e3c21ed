"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: every operator defines a result."""

import time

import pytest
from pyspark.sql import functions as F

from retrova.llm import chat, decontam, langid, linededup, minhash, mixing, pii, secrets, tokens, vecdedup

LONG = " ".join(f"word{n % 977}" for n in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, rest string, hash int, spans int"
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta. Eta theta iota", "en", "s1", 9, "x", "y", 1, 2),
    (1, "alpha beta gamma delta epsilon zeta. Eta theta iota", "en", "s1", 9, "x", "y", 1, 2),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", None, 0, None, None, None, None),
    (None, "no identifier here", None, "s2", None, None, None, None, None),
    (4, LONG, "en", "s2", len(LONG), None, None, None, None),
    (5, "ü 日本語 😀", "de", "s1", 3, None, None, None, None),
    (6, " \n\t ", "en", "s1", 4, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_secrets(docs, none):
    out = secrets.scan(docs, redact=True)
    assert out.count() == 8 and all(r.spans == [] for r in out.collect())
    assert by_id(out)[2].redacted is None and by_id(out)[5].redacted == "ü 日本語 😀"
    assert secrets.scan(none).count() == 0


def test_pii(docs, none):
    out = by_id(pii.sanitise(docs))
    assert len(out) == 7 and out[2].spans == [] and out[2].sanitised is None and out[4].sanitised == LONG
    assert pii.sanitise(docs).count() == 8 and pii.sanitise(none).count() == 0


def test_tokens(docs, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = by_id(tokens.count_tokens(docs, path), "doc_id")
    assert (out[2].n_bytes, out[2].n_tokens, out[3].n_tokens) == (0, 0, 0) and out[4].over_limit
    assert tokens.count_tokens(docs, path).count() == 8 and tokens.count_tokens(none, path).count() == 0


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([("i1", "beta GAMMA", 1), ("i2", None, 1), ("i3", "", 2), ("i4", "日本語", 3)], "item_id string, text string, doc_id int")
    out = by_id(decontam.find(docs, bench))
    assert out[1].items == ["i1"] and out[1].runs == [1, 3] and out[5].items == ["i4"] and out[2].n_words == 0
    blocks = by_id(decontam.find(docs, bench, index_words=1))
    assert {k: (r.runs, r.items) for k, r in out.items()} == {k: (r.runs, r.items) for k, r in blocks.items()}
    assert decontam.find(none, bench).count() == 0
    assert all(r.runs == [] for r in decontam.find(docs, bench.limit(0)).collect())
    kept = decontam.filter_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 5


def test_languages(docs, none):
    model = langid.train(docs)
    out = by_id(langid.identify(docs, model))
    assert out[2].lang_pred == out[3].lang_pred == out[6].lang_pred == "und" and out[1].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0
    kept = langid.filter_languages(docs, model)
    assert kept.columns == docs.columns and kept.count() == 5


def test_lines(docs, none):
    out = linededup.dedupe(docs)
    assert out.count() == 8 and by_id(out)[2].text is None and by_id(out)[3].text == "" and by_id(out)[1].n_removed == 0
    assert linededup.dedupe(none).count() == 0
    kept = linededup.filter_lines(docs)
    assert kept.columns == docs.columns and kept.count() >= 7


def test_minhash(docs, none):
    out = minhash.near_duplicates(docs, shingle=3, percent=85)
    assert out.count() == 8 and all(r.component_id == r.doc_id and r.kept for r in out.collect())
    assert by_id(out, "doc_id")[2].n_shingles == 0 and by_id(out, "doc_id")[5].n_shingles == 1
    assert minhash.near_duplicates(none).count() == 0


def test_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int, keys string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [1e300, 1e299])]
    out = by_id(vecdedup.near_duplicates(spark.createDataFrame([(*r, 1, "k") for r in rows], schema)), "vec_id")
    assert (out[1].n_links, out[2].n_links, out[9].n_links, out[11].n_links) == (3, 3, 3, 3) and out[9].component_id == 1
    assert all(out[n].n_links == 0 and out[n].kept for n in (3, 4, 5, 6, 7, 8, 10))
    assert vecdedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_mixing(docs, none):
    rows, sizes, goal, _ = mixing.mix(docs, F.array("source"))
    out = rows.collect()
    assert len(out) == 8 and sizes == {"s1": 21, "s2": 30_003, None: 0} and goal[None] == 0
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out) and sum(r.taken for r in out if r.id == 1) % 18 == 0
    assert mixing.mix(none, F.array("source"))[0].count() == 0


def test_pipeline_stages(spark, docs, none):
    """Nulls, empty and long texts, repeated rows, an id of two texts and other columns pass through every stage."""
    import corpus_pipeline as P

    more = [(7, f"one text of an id that two texts share and number {n} of them is quite unlike the other {n * 7919}", "en", "s1", 9, "x", "y", 1, 2) for n in (1, 2)]
    rows = docs.unionByName(spark.createDataFrame(more, SCHEMA)).cache()
    kept = {name: stage(spark, rows, "/root/testdata/sf0.001") for name, stage in P.STAGES}
    texts = {name: sorted((r.doc_id or 0, r.text or "") for r in out.collect()) for name, out in kept.items() if name != "mix"}
    assert all(kept[name].columns == list(P.COLUMNS) for name in texts)
    every = sorted({(r[0] or 0, r[1] or "") for r in [*ROWS, *more]})
    assert sorted(set(texts["near_duplicates"])) == every and len(texts["near_duplicates"]) == len(every)
    assert sorted(set(texts["decontaminate"])) == every
    assert [x for x in every if x[0] != 4] == sorted({x for x in texts["lines"] if x[0] != 4})  # 4 repeats itself
    assert max(len(t) for d, t in texts["lines"] if d == 4) < len(LONG)
    assert {d for d, _ in texts["language"]} == {0, 1, 4, 5, 7}
    assert all(0 < r.taken <= 2 * r["size"] for r in kept["mix"].collect())
    assert all(stage(spark, none, "/root/testdata/sf0.001").count() == 0 for _, stage in P.STAGES)


def test_chat(spark):
    schema = "conv_id long, message long, seq long, kind string, role string, text string"
    events = spark.createDataFrame([(1, 0, 0, None, None, None), (None, 0, 0, "delta", "user", "x"), (1, 0, 0, None, None, None)], schema)
    out = by_id(chat.format_conversations(events), "conv_id")
    assert out[1].formatted == "### role=: </turn>\n" and out[None].formatted == "### User: x</turn>\n"
    assert chat.format_conversations(events.limit(0)).count() == 0


def test_secrets_of_slugs_and_lists(spark):
    """What is long and regular takes time in proportion: slugs that end in a digit, lists of digests."""
    slug, digests = "/".join(["ab"] * 60) + "7", "\n".join(f"{n:032x}" for n in range(100_000))
    began = time.monotonic()
    out = by_id(secrets.scan(spark.createDataFrame([(1, slug), (2, digests), (3, "secret" + " " * 100_000)], "doc_id long, text string")))
    assert time.monotonic() - began < 60 and out[1].spans == [] == out[3].spans
    assert [tuple(s) for s in out[2].spans if s.kind != "entropy"] == [("hex", 33 * n, 33 * n + 32) for n in range(100_000)]


def test_pii_of_lists(spark):
    ips, figures = " ".join(["10.20.30.40"] * 30_000), " ".join(["1234567"] * 100_000)
    began = time.monotonic()
    out = by_id(pii.sanitise(spark.createDataFrame([(1, ips), (2, figures)], "doc_id long, text string")))
    assert time.monotonic() - began < 120
    assert [tuple(s)[:3] for s in out[1].spans] == [("ip", 12 * n, 12 * n + 11) for n in range(30_000)]
    assert out[1].sanitised == " ".join(["<IP>"] * 30_000) and out[2].sanitised == figures
