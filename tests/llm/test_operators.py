"""Each operator against a brute-force version, an exact round trip or held-out accuracy, over small whole tables."""

import hashlib
import itertools
import random
import re
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrova.llm import chat, decontam, langid, linededup, minhash, mixing, pii, queries, secrets, tokens, vecdedup
from retrova.llm._spark import release
from retrova.llm._text import Texts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_chat_is_the_same_as_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    key = lambda df: sorted(map(tuple, df.values.tolist()))
    got = chat.op1_chat(spark, SF).toPandas()
    assert key(got) == key(con.execute(queries.oracle_sql()["op1_chat"]).df()[list(got.columns)])
    assert got[got.conv_id == -7].loss_chars.tolist() == [len(chat.PROBE[1][3])]


def test_equal_rows_are_turns_of_their_own(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    turns = [(1, 0, "user", "ok")] * 2 + [(1, 1, "assistant", "yes")] * 3 + [(2, None, None, "x"), (2, None, "", "x"), (2, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    key = lambda df: sorted(map(tuple, df.values.tolist()))
    got = chat.op1_chat(spark, str(tmp_path)).toPandas()
    assert key(got) == key(con.execute(queries.oracle_sql()["op1_chat"]).df()[list(got.columns)])
    assert got[got.conv_id == 1].n_turns.tolist() == [5]


@pytest.mark.parametrize("text", ["", "\\", "</turn>", "<\\/turn>", "### User: x</turn>\n", "a\\\\#</turn></turn>\n\\", "\\### Assistant: </turn> ok", "<</turn>", "#" * 7])
def test_chat_round_trip(spark, text):
    turns = [(r, text) for r in ("user", "assistant", "role=x: y", "User", "cri:tic\\")]
    df = spark.createDataFrame([(turns,)], chat.TURN.join(["turns ", ""])).select("turns", chat.render(F.col("turns")).alias("f"))
    out = df.select("turns", chat.parse(F.col("f")).alias("back"), "f", chat.loss_spans(F.col("f")).alias("mask")).first()
    assert out.back == out.turns
    assert [out.f[s.start : s.end] for s in out.mask] == [spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t"))).first()[0]]


def test_chat_folds_events(spark):
    e = [(1, 0, 1, "delta", "user", "Hel"), (1, 0, 2, "delta", None, "lo"), (1, 1, 3, "delta", "assistant", "Hi"), (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "Hey"), (1, 1, 6, "delta", None, "!"), (1, 0, 7, "edit", None, "Bye"), (1, 0, 8, "delta", None, "?")]
    random.Random(1).shuffle(e)
    df = spark.createDataFrame(e, "conv_id long, message long, seq long, kind string, role string, text string")
    assert chat.format_conversations(df).first().formatted == "### User: Bye?</turn>\n### Assistant: Hey!</turn>\n"


SECRET = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password")
FORMS = {
    "assign": re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else "_?" if c == "_" else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key")) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def base_secrets(text):
    found = [(m.start(), n, m.end()) for n, (kind, form) in enumerate(FORMS.items()) for m in form.finditer(text) if len(m[2] if kind == "assign" else m[0]) >= secrets.LEAST[kind]]
    return sorted(found)


def test_secrets_against_plain_patterns(spark, rows):
    rng = random.Random(2)
    pieces = ["password=", "Token : ", "é", "api-key", "API_KEY='", "secret\"= \"", "AKIA" + "Q" * 17, "deadbeef" * 4, "ab", "0" * 24, " ", "\n", "x" * 9, "ſecret=abcdefg", "=", "toKen=abcdefgh"]
    texts = dict(rows) | {-n: "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for n in range(1, 300)}
    out = secrets.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(out) == len(texts)
    for r in out:
        want = [(secrets.KINDS[k], a, b) for a, k, b in base_secrets(texts[r.id])]
        assert [tuple(s) for s in r.spans if s.kind != "entropy"] == want, (texts[r.id], want)


def test_entropy_windows_against_counting_anew():
    rng = random.Random(3)
    for _ in range(300):
        text = bytes(rng.choice(b"abcdefgh0123ABCD") for _ in range(rng.randint(5, 60)))
        w, bits = 10, 2.9
        inside = set()
        for i in range(len(text) - w + 1):
            n = Counter(text[i : i + w]).values()
            if -sum(c / w * np.log2(c / w) for c in n) >= bits - 1e-12:
                inside |= set(range(i, i + w))
        assert {x for a, b in secrets.windows_above(text, w, bits) for x in range(a, b)} == inside


def test_entropy_finds_keys_and_spares_the_allowed(spark):
    key, uuid = "kJ8dPq2LrX9vTz4WmYb7Nc3Fh6Gs1Ae", "123e4567-e89b-12d3-a456-426614174000"
    df = spark.createDataFrame([(1, f"é see {key} there"), (2, f"{uuid} documentation_of_everything EXAMPLEkJ8dPq2LrX9vTz4WmY"), (3, f"token={key}")], "doc_id long, text string")
    out = {r.id: r for r in secrets.scan(df, redact=True).collect()}
    assert [s.kind for s in out[1].spans] == ["entropy"] and out[1].redacted == "é see <SECRET> there"
    assert out[2].spans == [] and [s.kind for s in out[3].spans] == ["assign"]


def luhn(digits):
    each = [int(c) for c in digits][::-1]
    return sum(c if n % 2 == 0 else 2 * c - 9 * (c > 4) for n, c in enumerate(each)) % 10 == 0


PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_personal(text):
    out = []
    for kind, form in PERSONAL.items():
        for m in re.finditer(form, text):
            n = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(n) <= 19 and luhn(n) or kind == "phone" and 9 <= len(n) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_against_plain_patterns(spark, rows):
    rng = random.Random(4)
    pieces = ["a.b", "@", "x-1.org", "c@d.e_f@g.h", "1.2.3.4", "256.1.1.1", ".", "4111 1111 1111 1111", "5500-0000-0000-0004", "+49 (0) 30 123456", "+", " ", "-", "007.8.9.10.11", "é😀", "9" * 25, "\n", "0"]
    texts = dict(rows) | {-n: "".join(rng.choice(pieces) for _ in range(rng.randint(1, 10))) for n in range(1, 400)}
    texts[-1_000] = "1 " * 20_000 + "a" * 20_000
    out = pii.sanitise(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(out) == len(texts)
    for r in out:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.KINDS[:4]] == base_personal(texts[r.id]), texts[r.id]


def test_disclosing_terms(spark):
    texts = ["Dr Zorblatt wrote to joe@x.org today", "see zorblatt joe@x.org 😀 zorblatt", "Zorblatt, joe@x.org", "only zorblatt here", *["nothing to see today"] * 40]
    out = {r.id: r for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[1].sanitised == "see <TERM> <EMAIL> 😀 <TERM>" and out[3].sanitised == "only <TERM> here" and out[9].sanitised == texts[9]


def test_tokens_are_those_of_the_library(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(5)
    pool = [*range(0x20, 0x250), 9, 10, 13, 0x85, 0xA0, 0x558, 0x1C89, 0x2028, 0x3000, 0x4E00, 0x1F600, 0x301, 0x200B]
    texts = dict(rows) | {-n: "".join(chr(rng.choice(pool)) for _ in range(40)) + "<|endoftext|>" * (n % 3) for n in range(1, 200)} | {-500: "x" * 5_000}
    out = tokens.count_tokens(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path).collect()
    for r in out:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_tokens_without_the_library_are_an_error(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setitem(sys.modules, "tokenizers.pre_tokenizers", None)  # importing it fails
    with pytest.raises(RuntimeError, match="tokenizers"):
        tokens.count_tokens(spark.createDataFrame([(1, "a\u1c89b")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination_against_all_windows(spark, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(9_001, "Short, item"), (9_002, "one")]
    rng = random.Random(6)
    extra = [(-n, " ".join(rng.choice(items)[1].split()[rng.randint(0, 5) :]) + rng.choice([" one", " short item!", ""])) for n in range(1, 60)]
    texts = rows + extra
    got = {r.doc_id: r for r in decontam.op8_decontaminate(_Tables(spark, documents=texts, benchmark=items), "x").collect()}
    windows = {}
    for i, t in items:
        w = words_of(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    for d, t in texts:
        w, hit, found = words_of(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


class _Tables:
    """A session whose read.parquet gives tables made here."""

    def __init__(self, spark, **tables):
        names = {"documents": "doc_id long, text string", "benchmark": "item_id long, text string"}
        self._made = {f"x/{k}.parquet": spark.createDataFrame(v, names[k]) for k, v in tables.items()}
        self.read = self

    def parquet(self, path):
        return self._made[path]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op9_language(spark, "/root/testdata/sf0.01").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) >= 0.97


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(7)
    first = np.array([0, 5, 5, 8, 12])
    score = rng.normal(size=(12, 3)).astype(np.float32) * 3
    label = langid.viterbi(score, first, 2.0)
    value = lambda path, s: sum(s[n, x] for n, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
    import itertools

    for a, b in zip(first, first[1:]):
        best = max((value(p, score[a:b]) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert value(label[a:b].tolist(), score[a:b]) == pytest.approx(best, abs=1e-4)


def test_mixed_text_has_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {x: docs.filter((F.col("lang") == x) & (F.length("text") > 400)).orderBy("doc_id").first().text[:300] for x in ("fr", "de")}
    both = spark.createDataFrame([(1, text["fr"] + " " + text["de"])], "doc_id long, text string")
    spans = langid.identify(both, langid.train(docs)).first().spans
    assert [s.lang for s in spans][:1] == ["fr"] and [s.lang for s in spans][-1:] == ["de"] and len(spans) <= 4


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[n : n + k]) for n in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, rows, k, percent):
    rng = random.Random(8)
    base = [t for _, t in rows if len(t.split()) > 60][:12]
    texts = list(rows)
    for n in range(160):  # copies with a few words changed: similarities on both sides of the threshold, more than a block
        w = base[n % 2 if n < 100 else n % 12].split()
        for _ in range(rng.randint(0, max(1, len(w) // 60))):
            w[rng.randrange(len(w))] = f"z{n}"
        texts.append((10_000 + n, " ".join(w)))
    sets, up = {d: shingles(t, k) for d, t in texts}, {d: d for d, _ in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    out = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle=k, percent=percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out} == {(d, len(sets[d]), find(d), find(d) == d) for d in ids}


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 1 << 63, 3_000).astype(np.uint64)
    a, b = pool[:2_000], pool[1_000:]
    bits = minhash.pack(minhash.signatures(np.concatenate([a, b]), np.array([0, 2_000, 4_000])))
    assert abs(minhash.estimate(bits[:1], bits[1:])[0, 0] - 1 / 3) < 0.12


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(40, 24))
    m = np.concatenate([base, *(base[:10] + rng.normal(size=(10, 24)) * s for s in (0.05, 0.2, 0.3, 0.4)), np.repeat(base[:1], 30, 0) + rng.normal(size=(30, 24)) * 0.1, base[:5]])
    u = vecdedup.unit(m)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(m))
    for _ in range(len(m)):
        label = np.minimum(label, np.where(near, label[None, :], len(m)).min(axis=1))
    out = {r.vec_id: r for r in vecdedup.near_duplicates(spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(m)], "vec_id long, embedding array<double>")).collect()}
    links = np.array([out[n].n_links for n in range(len(m))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.98 * near.sum()
    assert np.mean([out[n].component_id == label[n] for n in range(len(m))]) >= 0.98


def test_lines_lose_repeated_passages_only(spark, rows):
    rng = random.Random(11)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    passages = [fresh(rng.randint(55, 110)) for _ in range(20)]
    texts = []
    for n in range(100):
        gap = "\n" if n % 2 else " "
        texts.append((n, fresh(rng.randint(20, 200)) + gap + passages[n % 20] + gap + fresh(rng.randint(20, 200))))
    clean = [(1_000 + n, fresh(200)) for n in range(50)]
    out = {r.id: r for r in linededup.dedupe(spark.createDataFrame(texts + clean, "doc_id long, text string")).collect()}
    assert all(out[d].n_removed == 0 and out[d].text == t for d, t in clean + texts[:20])
    caught = sum(out[n].n_removed > 0 for n in range(20, 100))
    assert caught >= 0.95 * 80
    left = sum(len(set(zip(*(out[n].text.split()[i:] for i in range(8)))) & set(zip(*(passages[n % 20].split()[i:] for i in range(8))))) for n in range(20, 100))
    whole = sum(max(0, len(passages[n % 20].split()) - 7) for n in range(20, 100))
    assert left <= 0.1 * whole
    kept = linededup.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    every = {line for _, t in rows for line in t.split("\n")}
    assert {line for r in kept for line in (r.text or "").split("\n") if r.n_removed == 0} <= every


def _passage(seed, words, per_line=None):
    rng = random.Random(seed)
    w = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(words)]
    return " ".join(w) if per_line is None else "\n".join(" ".join(w[n : n + per_line]) for n in range(0, words, per_line))


def naive_lines(rows):
    """Which lines go, by plain loops: id -> (lines, set of line numbers)."""
    told, seen = {}, []
    for d, text in sorted(rows):
        texts = Texts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        lines = linededup.lines_of(texts)
        raw = text.encode()
        told[d] = [raw[a:b] for a, b in zip(lines.start, lines.end)], lines.words
        for c in linededup.divisions(lines):
            seen += [((d, int(c.head[n])), int(c.head[n + 1] - c.head[n])) for n in range(len(c.fit)) if c.fit[n]]
    first, later = {}, []
    for (d, at), size in sorted(seen):
        key = tuple(told[d][0][at : at + size])
        if first.setdefault(key, (d, at)) != (d, at):
            later.append((d, at, size, *first[key]))
    gone = {d: set() for d in told}
    for d, at, size, _, _ in later:
        gone[d] |= set(range(at, at + size))
    taken = {d: set(x) for d, x in gone.items()}
    for d, at, size, fd, fat in later:  # on either side to the first line that differs or goes with a chunk
        for x, y, step in ((at - 1, fat - 1, -1), (at + size, fat + size, 1)):
            while 0 <= x < len(told[d][0]) and 0 <= y < len(told[fd][0]) and x not in gone[d] and told[d][0][x] == told[fd][0][y]:
                taken[d].add(x)
                x, y = x + step, y + step
    for d, x in taken.items():
        for n in sorted(x):
            if n - 1 not in x:
                run = [n]
                while run[-1] + 1 in x:
                    run.append(run[-1] + 1)
                if told[d][1][run].sum() < linededup.LEAST_RUN:
                    taken[d] = taken[d] - set(run)
    return {d: (len(told[d][0]), taken[d]) for d in told}


def test_lines_against_plain_loops(spark, rows):
    rng = random.Random(12)
    shared = [_passage(70, 60), _passage(71, 90, 1), _passage(72, 40, 7), "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(300)), _passage(73, 9)]
    mixed = [(10_000 + n, rng.choice(["\n", " "]).join(x for m in range(4) for x in (_passage(100 + 5 * n + m, rng.randint(5, 40)), rng.choice(shared)))) for n in range(60)]
    texts = [*rows, *mixed]
    want = naive_lines(texts)
    out = {r.id: r for r in linededup.dedupe(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {d: (r.n_lines, r.n_removed) for d, r in out.items()} == {d: (n, len(x)) for d, (n, x) in want.items()}
    assert sum(len(x) for _, x in want.values()) > 500


@pytest.mark.parametrize("kind", ["unspaced", "one word a line"])
def test_passages_without_words_between_spaces_go(spark, kind):
    rng = random.Random(13)
    make = {"unspaced": lambda n: "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(n)), "one word a line": lambda n: "\n" + _passage(rng.random(), n, 1) + "\n"}[kind]
    shared = make(300)
    texts = [(n, make(200) + shared + make(200)) for n in range(20)]
    out = {r.id: r.text for r in linededup.dedupe(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out[0] == texts[0][1]
    assert np.mean([len(out[n]) < len(texts[n][1]) - 0.8 * len(shared) for n in range(1, 20)]) >= 0.95


def test_ends_of_passages_go_to_the_first_unequal_line(spark):
    shared = "\n".join([_passage(1, 100, 1), _passage(2, 25), _passage(3, 100, 1)])
    texts = [(n, f"{_passage(10 + n, 30)}\n{shared}\n{_passage(20 + n, 30)}") for n in range(3)]
    out = {r.id: r.text.split("\n") for r in linededup.dedupe(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert "\n".join(out[0]) == texts[0][1]
    assert all(out[n] == [_passage(10 + n, 30), _passage(20 + n, 30)] for n in (1, 2))


def test_a_full_bit_table_changes_no_result(spark, monkeypatch):
    shared = "\n".join([_passage(4, 12, 2), _passage(5, 25), _passage(6, 12, 2)])
    texts = [(n, f"{_passage(30 + n, 80, 5)}\n{shared}\n{_passage(40 + n, 80, 5)}") for n in range(4)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = {(r.id, r.text) for r in linededup.dedupe(docs).collect()}
    monkeypatch.setattr(linededup, "TABLE", 7)
    assert {(r.id, r.text) for r in linededup.dedupe(docs).collect()} == want
    assert all(t.split("\n") == _passage(30 + n, 80, 5).split("\n") + _passage(40 + n, 80, 5).split("\n") for n, t in want if n)


def test_a_removed_passage_is_one_run_and_lists_may_be_shuffled(spark, monkeypatch):
    copy = "\n".join(_passage(60 + n, 25) for n in range(12))
    docs = spark.createDataFrame([(n, copy if n < 3 else f"{_passage(80 + n, 30)}\n{copy}\n{_passage(90 + n, 30)}") for n in range(6)], "doc_id long, text string")
    listed, attached = {}, linededup._attached

    def spied(rows, each, entries="gone", how="left"):
        listed.setdefault(entries, []).extend(len(r[entries]) for r in each.collect())
        return attached(rows, each, entries, how)

    monkeypatch.setattr(linededup, "_attached", spied)
    want = {(r.id, r.text, r.n_lines, r.n_removed) for r in linededup.dedupe(docs).collect()}
    assert sum(not t for _, t, _, _ in want) == 2 and listed["gone"] == [2] * 5  # first line and number, however many chunks
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(linededup, "FETCHED", 0)  # the bit table a word at a time
    shuffled = linededup.dedupe(docs)
    assert "BroadcastHashJoin" not in shuffled._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.text, r.n_lines, r.n_removed) for r in shuffled.collect()} == want


def test_the_driver_gets_the_bit_table_as_a_few_pieces(spark, monkeypatch):
    from pyspark.sql import DataFrame

    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(-(2**63), 2**63, 70_000))
    rows = []  # that the driver gets: a row a word took over 400 MB for 2**20 words
    for name in ("toArrow", "toPandas", "collect"):
        monkeypatch.setattr(DataFrame, name, lambda self, *a, f=getattr(DataFrame, name): rows.append(len(out := f(self, *a))) or out)
    monkeypatch.setattr(linededup, "FETCHED", 14)
    bits = linededup._table(spark.createDataFrame([(int(x),) for x in h], "hash long"))
    assert sum(rows) <= 1 << linededup.PIECES and len(bits) > 1 and all(len(b.value) <= 1 << 14 for b in bits)
    size = (sum(len(b.value) for b in bits) * 64).bit_length() - 1
    want = np.zeros(1 << (size - 6), np.uint64)
    at = h.view(np.uint64) >> np.uint64(64 - size)
    np.bitwise_or.at(want, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    assert (np.concatenate([b.value for b in bits]) == want).all()
    assert linededup._may_repeat(bits, h.view(np.uint64)).all()
    other = rng.integers(0, 2**63, 10_000).view(np.uint64)
    assert linededup._may_repeat(bits, other).mean() < 0.1


def test_shuffles_and_lists_of_lines_do_not_pile_up(spark, monkeypatch):
    copy = "\n".join(_passage(160 + n, 25) for n in range(4))
    docs = spark.createDataFrame([(n, f"{_passage(180 + n, 30)}\n{copy}\n{_passage(190 + n, 30)}") for n in range(6)], "doc_id long, text string")
    held, attached = [], linededup._attached

    def alive():
        return spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()

    def spied(rows, each, entries="gone", how="left"):
        end = time.time() + 5  # the cleaner is a thread of its own
        while alive() > before + 6 and time.time() < end:
            time.sleep(0.1)
        held.append(alive() - before)
        return attached(rows, each, entries, how)

    release(spark)
    time.sleep(1)
    before = alive()
    monkeypatch.setattr(linededup, "_attached", spied)
    out = {r.id: r.n_removed for r in linededup.dedupe(docs).collect()}
    assert out[0] == 0 and all(out[n] for n in range(1, 6))
    assert len(held) > 1 and max(held) <= 6


def test_rows_that_share_an_id_lose_the_ends_of_a_passage_too(spark):
    shared = "\n".join([_passage(1, 100, 1), _passage(2, 25), _passage(3, 100, 1)])
    text = f"{_passage(10, 30)}\n{shared}\n"
    rows = [(0, text + _passage(20, 30)), (1, text + _passage(21, 30)), (1, text + _passage(22, 30))]
    out = {}
    for r in linededup.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out.setdefault(r.id, set()).add(r.text)
    assert out[0] == {rows[0][1]}
    assert out[1] == {_passage(21, 30), _passage(22, 30)}


def test_lines_of_a_text_depend_on_no_other_text():
    texts = [f"one two three four five {x}" for x in "abcdefghijklmnopqrstuvwxyz"] * 8
    rng = random.Random(14)
    rng.shuffle(texts)
    alone = [len(linededup.lines_of(Texts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))).start) for t in texts]
    together = linededup.lines_of(Texts(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])))
    assert np.diff(together.first).tolist() == alone


def test_documents_keep_their_own_words_beside_a_shared_passage(spark):
    shared = _passage(7, 170)
    texts = [(0, shared), (1, f"{_passage(50, 30)}\n{shared}"), (2, shared)]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in texts], "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text.strip(), r.n_chars) for r in linededup.filter_lines(docs).collect()}
    assert set(out) == {0, 1} and out[0][0] == shared and out[1][0] == _passage(50, 30) and out[1][1] < 400


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.op6_rows(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    size = {d: len(re.findall(mixing.WORD, t or "")) for d, t in ((r.doc_id, r.text) for r in docs.collect())}
    assert (out["size"] == out.doc_id.map(size)).all() and (out.taken <= 2 * out["size"]).all()
    by = out.groupby("source").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.told).all() and abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 and (by.target <= 2 * by["size"] + 1e-6).all()
    assert ((by.taken - by.target).abs() <= 0.05 * by.target).all()
    again = mixing.op6_rows(docs.repartition(7)).toPandas().set_index("doc_id").taken
    assert (again.sort_index() == out.set_index("doc_id").taken.sort_index()).all()


def test_targets_and_flow():
    assert mixing.targets({"a": 10, "b": 10, None: 100}) == {"a": 20.0, "b": 20.0, None: 140.0}
    flow = mixing.route({("a",): 100, ("b",): 50, ("a", "b"): 30}, {"a": 160, "b": 100})
    assert sum(f.get("a", 0) for f in flow.values()) == 160 and sum(f.get("b", 0) for f in flow.values()) == 100
    assert sum(flow[("a", "b")].values()) >= 30  # nothing is used twice before all is used once
    assert sum(mixing.route({("a",): 10}, {"a": 500})[("a",)].values()) == 20


def _optimum(mass, quota, repeats):
    """(most words, least cost at that) over all flows of a small network; the n-th use of a pattern's words costs n."""
    arcs = [(p, s) for p in mass for s in p if s in quota]
    cost = lambda p, n: sum(min(max(n - u * mass[p], 0), mass[p]) * (u + 1) for u in range(repeats))
    best = (0, 0)
    for flow in itertools.product(*(range(min(repeats * mass[p], quota[s]) + 1) for p, s in arcs)):
        used, got = dict.fromkeys(mass, 0), dict.fromkeys(quota, 0)
        for (p, s), n in zip(arcs, flow, strict=True):
            used[p] += n
            got[s] += n
        if all(used[p] <= repeats * mass[p] for p in mass) and all(got[s] <= quota[s] for s in quota):
            best = max(best, (sum(flow), -sum(cost(p, n) for p, n in used.items())))
    return best[0], -best[1]


def test_flow_against_all_flows():
    draw = random.Random(5)
    for _ in range(60):
        patterns = draw.sample([("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "b", "c")], draw.randint(1, 3))
        mass, quota = {p: draw.randint(0, 3) for p in patterns}, {s: draw.randint(0, 6) for s in "abc"}
        flow = mixing.route(mass, quota, 2)
        used = {p: sum(f.values()) for p, f in flow.items()}
        got = {s: sum(f.get(s, 0) for f in flow.values()) for s in quota}
        assert all(n >= 0 for f in flow.values() for n in f.values()) and all(used[p] <= 2 * mass[p] for p in mass) and all(got[s] <= quota[s] for s in quota)
        cost = sum(min(n, mass[p]) + 2 * max(n - mass[p], 0) for p, n in used.items())
        assert (sum(used.values()), cost) == _optimum(mass, quota, 2)


def _selected(rows, wanted):
    """How often each of rows(id, size, digits) is taken, by a walk over one sorted list."""
    mass, order = sum(n for _, n, _ in rows), sorted(rows, key=lambda r: r[2])
    times, rest = dict.fromkeys((r[0] for r in rows), wanted // mass if mass else 0), wanted % mass if mass else 0
    at = 0
    while rest and at < len(order) and order[at][1] <= rest:
        times[order[at][0]] += 1
        rest -= order[at][1]
        at += 1
    small = max(1, rest // 8) if rest else 0
    for own, n, _ in order[at:]:
        if rest and 0 < n <= small:
            if n > rest:
                break
            times[own] += 1
            rest -= n
    return times


def test_selection_against_one_sorted_list(spark):
    draw = random.Random(6)
    rows = [(n, f'["{"xyz"[n % 3]}"]', draw.choice([0, 1, 2, 9, 40, 300]), f"{draw.getrandbits(24):06x}") for n in range(600)]
    mass = {p: sum(r[2] for r in rows if r[1] == p) for p in {r[1] for r in rows}}
    wanted = {'["x"]': mass['["x"]'] // 3, '["y"]': mass['["y"]'] + 777, '["z"]': 2 * mass['["z"]']}
    got = mixing.select(spark.createDataFrame(rows, "id long, pattern string, size long, digits string"), wanted, mass)
    times = {k: v for p in mass for k, v in _selected([(i, n, d) for i, q, n, d in rows if q == p], wanted[p]).items()}
    assert {r.id: r.taken for r in got.collect()} == {i: n * times[i] for i, _, n, _ in rows}


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        if name != "mix":
            assert docs.columns == list(P.COLUMNS)
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
        if name == "language":
            assert gone == {r.doc_id for r in before.collect() if not any(c.isalpha() for c in r.text or "")}
        if name == "near_duplicates":
            groups = minhash.near_duplicates(before).collect()
            assert gone == {r.doc_id for r in groups if not r.kept}
        if name == "decontaminate":
            hits = decontam.find(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
            assert gone == {r.id for r in hits if r.runs}
    assert docs.filter("taken <= 0").count() == 0 and P.run(spark, SF).count() == docs.count()
