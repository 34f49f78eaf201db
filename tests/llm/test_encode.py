import random

import pytest
from codequarry.llm.encode import VOCABULARIES, _let, count_tokens, decode, encode, merged, merged_on_heap, rank_table, vocabulary
from pyspark.sql import functions as F

TEXTS = [
    None, "", " ", "plain words, it's 2024!", "  two  blanks \n\n\tand\ttabs  ", "naïve café ünïcödé", "版本8.10.9修复了；其他没有变化", "การสแกนไฟล์", "🧪🔑👩\u200d💻" * 40, "=" * 700, "a" * 3000, "xqzjkvbw" * 400, "ab" * 900 + "c", "\u00a0\u200b\u3000x\x01\x02",
    "antidisestablishmentarianism pneumonoultramicroscopic", "<|endoftext|> is ordinary", "x = 'y'\r\n" * 30, "ﬁ\u0301\u0327 ｆｕｌｌ", "don't WON'T 'tis I'll", "٣٤٥ ١٢",
]


@pytest.fixture(scope="module")
def encoded(spark):
    rows = [(i, t, "clash", [1]) for i, t in enumerate(TEXTS)]
    return encode(spark.createDataFrame(rows, "doc_id int, text string, k string, ids array<int>"), "doc_id", "text")


def test_ids_equal_the_librarys(encoded):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}


def test_round_trip(encoded):
    assert {r.doc_id: r.text for r in decode(encoded, "doc_id").collect()} == {i: x or "" for i, x in enumerate(TEXTS)}


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id int, text string"), "doc_id", "text").count() == 0


def test_other_vocabulary(spark):
    df = spark.createDataFrame([(1, "Wörter größer")], "doc_id int, text string")
    e = encode(df, "doc_id", "text", "byte_bpe_multi_50k")
    assert decode(e, "doc_id", name="byte_bpe_multi_50k").first().text == "Wörter größer"


def test_count_is_the_length_of_the_ids(spark, encoded):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id int, text string, n string"), "doc_id", "text").collect()
    assert {r.doc_id: r.tokens for r in got} == {r.doc_id: len(r.ids) for r in encoded.collect()}
    assert count_tokens(spark.createDataFrame([], "doc_id int, text string"), "doc_id", "text").count() == 0


def test_long_words_take_the_same_merges(spark):
    """Fold and heap agree, and a run of a hundred thousand letters ends soon."""
    r = random.Random(9)
    words = ["".join(r.choices(a, k=n)) for a in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "\xe4\xb8\xad\xe6") for n in (2, 3, 17, 200)]
    ranks = rank_table(spark)
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.struct(ranks.alias("ranks"), "w").alias("x"))
    folded = {x.w: x.ids for x in rows.select("w", _let(F.col("x"), lambda x: merged(x["ranks"], x["w"])).alias("ids")).collect()}
    assert folded == {w: merged_on_heap(w, vocabulary()) for w in words}
    long = "".join(r.choices("etaoinshrdlu", k=100_000))
    tokens = {v: k for k, v in vocabulary().items()}
    assert "".join(tokens[i] for i in merged_on_heap(long, vocabulary())) == long
