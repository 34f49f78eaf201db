"""Encoding of a whole corpus with a public byte-level BPE vocabulary, inside the JVM.

A text is cut into words by the vocabulary's pattern, once. Words that are a token themselves get their id from a
constant rank map in place. Of all others the *distinct* ones of the corpus are encoded once each: a fold over
the array of the word's bytes that merges, at every step, the first adjacent pair of the lowest rank. Bytes are
written as the characters U+0000 to U+00FF, so that Spark's string functions can work on them.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.session import written

#: Folder of the vocabulary files and the vocabulary used where none is named.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

#: Words of a text: contractions, letters, digits, other marks (each with one blank before it), white space.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Buckets of the rank map: a map constant is searched entry by entry, so each one is kept to a few.
BUCKETS = 16384

#: A position times this plus an id is one long.
PLACE = 2**31

#: No rank; bytes of a word from which on its merges are done on a heap, in time that grows with its length times its logarithm.
NONE, LONG_WORD = 2**31 - 1, 256


@cache
def vocabulary(name: str = VOCABULARY, folder: str = VOCABULARIES) -> dict[str, int]:
    """Token, its bytes as characters, to id."""
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    pairs = (line.split() for line in lines if line.strip())
    return {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in pairs}


@cache
def _rank_json(name: str, folder: str, whole_words: bool) -> str:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in vocabulary(name, folder).items():
        if whole_words:
            try:
                token = token.encode("latin-1").decode()
            except UnicodeDecodeError:  # part of a character, so no word
                continue
        buckets[zlib.crc32(token.encode()) % BUCKETS][token] = rank
    return json.dumps(buckets)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def _constant(spark: SparkSession, text: str, kind: str) -> Column:
    """A table of one value, given as JSON, as a scalar subquery.

    A literal of a whole vocabulary would be printed into every description of the plan that Spark keeps on the
    driver; the subquery's value is shipped in the same way, but not printed. Its size is that of the vocabulary.
    """
    return spark.createDataFrame([(text,)], "j string").select(F.from_json("j", kind).alias("t")).scalar()


def rank_table(spark: SparkSession, name: str = VOCABULARY, folder: str = VOCABULARIES, whole_words: bool = False) -> Column:
    """The rank map of one vocabulary, a constant. Lambdas get it as an argument, see :func:`_let`.

    Its keys are tokens as byte strings, or as texts the tokens that are whole words.
    """
    return _constant(spark, _rank_json(name, folder, whole_words), "array<map<string,int>>")


def rank_of(ranks: Column, token: Column) -> Column:
    """The id of a token, or null."""
    bucket = F.pmod(F.crc32(token.cast("binary")), F.lit(BUCKETS)).cast("int")
    return F.try_element_at(F.get(ranks, bucket), token)


def merged(ranks: Column, word: Column) -> Column:
    """The ids of a word of at least two bytes, by folding ranked merges over its bytes.

    The fold's state is an array of pieces, each with the rank of it and the next one together; a step merges the
    first of the lowest rank and looks up the two ranks that this changes.
    """

    def rank(token: Column) -> Column:
        return F.coalesce(rank_of(ranks, token), F.lit(NONE))

    def piece(p: Column, r: Column) -> Column:
        return F.struct(p.alias("p"), r.alias("r"))

    def merge(state: Column, at: Column) -> Column:
        def around(x: Column) -> Column:
            joined = F.concat(x["a"], x["b"])
            before = F.when(x["before"].isNotNull(), F.array(piece(x["before"], rank(F.concat(x["before"], joined))))).otherwise(F.slice(state, 1, 0))
            here = piece(joined, F.when(x["after"].isNull(), F.lit(NONE)).otherwise(rank(F.concat(joined, x["after"]))))
            return F.concat(F.slice(state, F.lit(1), F.greatest(at - 1, F.lit(0))), before, F.array(here), F.slice(state, at + 3, F.size(state)))

        neighbours = F.struct(
            F.get(state, at - 1)["p"].alias("before"), F.get(state, at)["p"].alias("a"), F.get(state, at + 1)["p"].alias("b"), F.get(state, at + 2)["p"].alias("after")
        )
        return _let(neighbours, around)

    def step(state: Column, _: Column) -> Column:
        lowest = F.array_min(F.transform(state, lambda x, i: F.struct(x["r"].alias("r"), i.alias("i"))))
        return _let(lowest, lambda low: F.when(low["r"] == NONE, state).otherwise(merge(state, low["i"])))

    start = F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: piece(F.substring(word, i, F.lit(1)), F.when(i == F.length(word), F.lit(NONE)).otherwise(rank(F.substring(word, i, F.lit(2))))),
    )
    return F.transform(F.aggregate(F.sequence(F.lit(2), F.length(word)), start, step), lambda x: rank_of(ranks, x["p"]))


def merged_on_heap(word: str, ranks: dict[str, int]) -> list[int]:
    """The same merges for one long word: linked pieces, and a heap of their pairs by rank and place."""
    pieces: list[str | None] = list(word)
    following, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(r, i, 2) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, length = heappop(heap)
        j = following[i]
        if pieces[i] is None or j >= len(word) or len(pieces[i]) + len(pieces[j]) != length:
            continue  # one of the two has been merged since
        pieces[i] += pieces[j]
        pieces[j] = None
        following[i] = k = following[j]
        if k < len(word):
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < len(word) and (r := ranks.get(pieces[a] + pieces[b])) is not None:
                heappush(heap, (r, a, len(pieces[a]) + len(pieces[b])))
    return [ranks[p] for p in pieces if p is not None]


def _encoded_words(rare: DataFrame, ranks: Column, name: str, folder: str) -> DataFrame:
    """``w, ids`` of the distinct words ``w``; only here are words written as bytes."""
    distinct = rare.select("w").distinct().repartition(tasks(rare.sparkSession), "w").select("w", byte_string(F.col("w")).alias("b"))
    folded = distinct.where(F.length("b") < LONG_WORD).select("w", F.struct(ranks.alias("ranks"), "b").alias("x")).select(
        "w", _let(F.col("x"), lambda x: merged(x["ranks"], x["b"])).alias("ids")
    )

    @F.pandas_udf("array<int>")
    def on_heap(words: pd.Series) -> pd.Series:
        known = vocabulary(name, folder)
        return words.map(lambda w: merged_on_heap(w, known))

    return folded.unionByName(distinct.where(F.length("b") >= LONG_WORD).select("w", on_heap("b").alias("ids")))


def tasks(spark: SparkSession) -> int:
    """Partitions for work that is small in bytes but long in CPU, which AQE would otherwise fold into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def byte_string(text: Column) -> Column:
    """The UTF-8 bytes of a text as characters."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _cut(documents: DataFrame, key: str, text: str, name: str, folder: str) -> DataFrame:
    """``k, words, ids`` of every text: its words in order, and the id of each that is a token, else null."""
    ranks = rank_table(documents.sparkSession, name, folder, whole_words=True)
    cut = F.coalesce(F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))
    words = documents.select(F.col(key).alias("k"), cut.alias("words")).select("k", "words", F.struct(ranks.alias("ranks"), "words").alias("x"))
    return words.select("k", "words", _let(F.col("x"), lambda x: F.transform(x["words"], lambda w: rank_of(x["ranks"], w))).alias("ids"))


def encode(documents: DataFrame, key: str, text: str, name: str = VOCABULARY, folder: str = VOCABULARIES) -> DataFrame:
    """``key, ids``: every text as its list of token ids, without special tokens.

    Null and empty texts have the empty list. Keys are taken as unique; null keys are allowed. Words of any
    length are encoded whole. The cut texts are written to the shared folder once: tokens in place as one long
    each, place and id, and the words that aren't tokens, whose distinct ones are encoded and then joined back.
    """
    ranks = rank_table(documents.sparkSession, name, folder)
    at = lambda i: F.get("words", i)
    cut = written(
        _cut(documents, key, text, name, folder).select(
            "k",
            F.array_compact(F.transform("ids", lambda r, i: i.cast("long") * PLACE + r)).alias("packed"),
            F.array_compact(F.transform("ids", lambda r, i: F.when(r.isNull(), F.struct(i.alias("at"), at(i).alias("w"))))).alias("rare"),
        )
    )
    rare = cut.select("k", F.explode("rare").alias("x")).select("k", "x.at", "x.w")
    found = rare.join(_encoded_words(rare, ranks, name, folder), "w").groupBy("k").agg(F.collect_list(F.struct("at", "ids")).alias("got"))
    whole = cut.select("k", "packed", F.lit(None).cast("array<struct<at:int,ids:array<int>>>").alias("got"))
    looked_up = found.select("k", F.lit(None).cast("array<bigint>").alias("packed"), "got")
    together = whole.unionByName(looked_up).groupBy("k").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("packed", "got")])
    tokens = F.transform(
        "packed", lambda x: F.struct(F.shiftright(x, 31).cast("int").alias("at"), F.array((x % PLACE).cast("int")).alias("ids"))
    )
    ordered = F.sort_array(F.concat(tokens, "got"))
    return together.select(F.col("k").alias(key), F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def count_tokens(documents: DataFrame, key: str, text: str, name: str = VOCABULARY, folder: str = VOCABULARIES) -> DataFrame:
    """``key, tokens``: the length of every text in tokens, 0 for null and empty ones. Keys as for :func:`encode`.

    Tokens in place are counted where they are; only the words that aren't tokens meet their number of ids, and
    only numbers are shuffled by key.
    """
    ranks = rank_table(documents.sparkSession, name, folder)
    cut = written(
        _cut(documents, key, text, name, folder).select(
            "k",
            F.size(F.array_compact("ids")).cast("long").alias("n"),
            F.array_compact(F.transform("ids", lambda r, i: F.when(r.isNull(), F.get("words", i)))).alias("rare"),
        )
    )
    rare = cut.select("k", F.explode("rare").alias("w"))
    lengths = _encoded_words(rare, ranks, name, folder).select("w", F.size("ids").cast("long").alias("n"))
    more = rare.join(lengths, "w").select("k", "n")
    return cut.select("k", "n").unionByName(more).groupBy("k").agg(F.sum("n").alias("tokens")).withColumnRenamed("k", key)


def decode(encoded: DataFrame, key: str, ids: str = "ids", name: str = VOCABULARY, folder: str = VOCABULARIES) -> DataFrame:
    """``key, text``: the binary pieces of the ids, concatenated. The empty list gives the empty text, null gives null.

    Ids that the vocabulary doesn't have add nothing.
    """
    tokens = vocabulary(name, folder)
    pieces: list[str] = [""] * (max(tokens.values()) + 1)
    for token, rank in tokens.items():
        pieces[rank] = token
    table = _constant(encoded.sparkSession, json.dumps(pieces), "array<string>")
    joined = _let(
        F.col("x"),
        lambda x: F.array_join(F.transform(x["ids"], lambda i: F.coalesce(F.get(x["pieces"], i), F.lit(""))), ""),
    )
    return encoded.select(key, F.struct(table.alias("pieces"), F.col(ids).alias("ids")).alias("x")).select(key, F.encode(joined, "ISO-8859-1").cast("string").alias("text"))
