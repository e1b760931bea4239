"""Token counts against the library on whole texts, and what the cache holds."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuespark.llm import tokens
from cuespark.llm.queries import QUERIES

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(PATH, tokens.version(PATH))


PIECES = ["<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", "it's", "'S", "Σας", "É", "é", "J̌", "́", "\u0085", " ", " ",
          "\x1c", "\t", "\n", "\x0b", "  ", "12", "½", "…", "don't.", "A-B", "\U0001F600", "İ", "ẞ", "한국", "한", "x<|endoftext|>y", "\x00"]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=5)), max_size=25).map("".join))
def test_sum_of_segments_is_the_library_count(library, counter, text):
    assert counter.count([text.encode()]) == [library(text)]


def test_normalised_texts_have_the_same_count(spark, library):
    texts = [f"{a}{b} {c}" for a in PIECES for b in ("", " \n\t ", "Word") for c in PIECES[:12]] + ["", " ", "\n A  b\t"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tokens.normalised("text").alias("norm")).collect()
    assert all(library(r.text) == library(r.norm) for r in rows)
    assert spark.createDataFrame([("\n A  b\t",)], "text string").select(tokens.normalised("text")).first()[0] == "a b"


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_tokens"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = library(texts[r.doc_id])
        assert tuple(r) == (r.doc_id, len((texts[r.doc_id] or "").encode()), n, n > 2048)


def test_edges(spark, library, tmp_path):
    long = "palabra larga, " * 40_000 + "1" * 5_000 + "é" * 50_000
    rows = [(1, None, 5, "x"), (2, "", 5, "x"), (3, "Same  text", 5, "x"), (3, "Same  text", 5, "x"), (None, "same text ", 5, "x"), (4, long, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, __content string").withColumn("content", F.lit(1)).withColumn("tokenizer", F.lit(2))
    got = tokens.count_tokens(docs, PATH, str(tmp_path / "cache"))
    assert got.columns == ["doc_id", "text", "__content", "content", "tokenizer", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_bytes, r.over_limit) for r in got.collect()) == sorted(
        (d or 0, library(t), len((t or "").encode()), library(t) > 2048) for d, t, *_ in rows)
    assert tokens.count_tokens(docs.limit(0), PATH, str(tmp_path / "none")).collect() == []


def test_cache(spark, library, tmp_path):
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "one two"), (2, "One   two"), (3, "three")], "doc_id int, text string")
    tokens.count_tokens(first, PATH, cache).collect()
    held = spark.read.parquet(cache)
    assert held.count() == 2 and {r.tokenizer for r in held.collect()} == {tokens.version(PATH)}
    # stored counts are used, not made anew: a planted one comes back
    planted = spark.createDataFrame([(1, "planted text")], "doc_id int, text string")
    (planted.select(F.sha2(tokens.normalised("text"), 256).alias("content"), F.lit(77).cast("long").alias("n_tokens"), F.lit(tokens.version(PATH)).alias("tokenizer"))
     .write.mode("append").partitionBy("tokenizer").parquet(cache))
    more = first.unionByName(planted).unionByName(spark.createDataFrame([(5, "four")], "doc_id int, text string"))
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(more, PATH, cache).collect()}[1] in (library("one two"), 77)
    assert spark.read.parquet(cache).count() == 4
    # rows written twice do not double documents; another tokenizer's counts are not taken
    held = spark.read.parquet(cache).collect()
    spark.createDataFrame(held).write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert tokens.count_tokens(more, PATH, cache).count() == more.count()
    other = str(tmp_path / "other.json")
    with open(PATH, "rb") as a, open(other, "wb") as b:
        b.write(a.read() + b"\n")
    assert {r.n_tokens for r in tokens.count_tokens(planted, other, cache).collect()} == {library("planted text")}


def test_another_file_on_an_executor_is_refused():
    with pytest.raises(ValueError, match="another tokenizer"):
        tokens.Counter(PATH, "0" * 64)
