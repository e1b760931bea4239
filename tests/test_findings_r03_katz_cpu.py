"""op6_katz: what tasks hold of words and contexts, and what is made row by row."""

import re

import numpy as np
import pyarrow as pa

from cuespark.llm import katz, katz_trigrams

TEXTS = [b"", b" \t\n", b"One", b"one two", b"\x0b ONE\x0ctwo\r", "Straße É 日本".encode(), b"a\x00 a", b"x" * 8 + b" " + b"x" * 9 + b" " + b"x" * 16,
         b"y" * 2000 + b" z", b"end ", b"", b"end"]


def test_words_are_hashed_together_as_one_by_one():
    texts = pa.array([b"before", *TEXTS], pa.binary()).slice(1)
    hashes, n = katz.WordHashes().of_all(texts)
    words = [w.lower() for t in TEXTS for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    assert n.tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", t)) for t in TEXTS]
    assert hashes.tolist() == [int(katz.WordHashes().of(w)[0]) for w in words]
    assert len(set(hashes.tolist())) == len(set(words))
    often = np.array([katz.WordHashes().of(w)[0] for w in (b"one", b"two")])
    codes, _ = katz_trigrams.Words(often).of_all(texts)
    assert [int(c) for c in codes if c < katz_trigrams.ESCAPE] == [{b"one": 2, b"two": 3}[w] for w in words if w in (b"one", b"two")]


def test_orders_and_lookups():
    x = np.random.default_rng(0).integers(0, 1 << 62, 5000).astype(np.uint64)
    x = np.concatenate([x, x[:100], x[:100] + np.uint64(1), x[:100] - np.uint64(1)])       # differ in bits that the packed order leaves out
    assert (x[katz.in_order(x)] == np.sort(x)).all()
    at, known = katz._lookup(np.sort(x[:50]), x[40:60])
    assert known.tolist() == [True] * 10 + [False] * 10 and (np.sort(x[:50])[at[:10]] == x[40:50]).all()


def test_contexts_are_a_row_per_bucket_and_frequent_words_are_not_joined(spark):
    docs = spark.range(400).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(0, 99), i -> concat('w', (id * 100 + i) % 997))) as text")
    model = katz_trigrams.train(docs)
    assert model.contexts.count() <= 2 * model.plan.deal.buckets                # before: one for each word
    asked = model.ngrams.mapInArrow(katz_trigrams._followers, "bucket int, w bigint")
    assert len(model.plan.often) and asked.where(f"w between 0 and {katz_trigrams.ESCAPE}").count() == 0
    assert int(model.often.sum()) + (model.unigrams.where(f"not w between 0 and {katz_trigrams.ESCAPE}").selectExpr("coalesce(sum(c), 0)").first()[0]) == model.tokens
