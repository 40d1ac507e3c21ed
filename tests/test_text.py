import hashlib
import struct

from pyspark.sql import functions as F

from retrova.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_words_split_at_every_unicode_space(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    text = "a" + "".join(f"{s}b" for s in spaces)
    assert one(spark, text, X.words) == text.split()
    assert one(spark, None, X.words) == [] == one(spark, " \n", X.words)


def test_strip_and_sentences(spark):
    assert one(spark, "　 a b\x1c", X.strip) == "a b"
    assert one(spark, "Yes. e.g. this. \"No\" he said! (So) it ends?  ", X.sentences) == ["Yes. e.g. this.", '"No" he said!', "(So) it ends?"]


def test_full_text(spark):
    df = spark.createDataFrame([("T", "x"), ("", "x"), (None, "x")], "title string, text string")
    assert [r[0] for r in df.select(X.full_text("title", "text")).collect()] == ["T\n\nx", "x", "x"]


def test_cache_key_has_lengths(spark):
    def key(model, texts):
        h = hashlib.sha256()
        for part in [model, *texts]:
            raw = part.encode()
            h.update(struct.pack("<q", len(raw)) + raw)
        return h.hexdigest()

    df = spark.createDataFrame([(["é", "b"],), (["éb"],)], "t array<string>")
    got = [r[0] for r in df.select(X.cache_key(F.lit("m"), F.col("t"))).collect()]
    assert got == [key("m", ["é", "b"]), key("m", ["éb"])] and got[0] != got[1]


def test_names(spark):
    assert one(spark, "a/b c:d", X.safe_name) == "a_b_c_d"
    assert one(spark, "org/model", X.short_name) == "model" == one(spark, "model", X.short_name)
