"""Collocation mining against a plain count of all phrases."""

import collections
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuespark.llm import phrases

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in PIECE.split((text or "").translate(UPPER)):
            w = WORD.findall(piece)
            total[lang or "und"] += len(w)
            for n in (1, 2, 3, 4):
                f[lang or "und"].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, of in f.items():
        c = {p: a for p, a in of.items() if a >= least and len(p) > 1}
        found = []
        for p, a in c.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in c.items()):
                continue
            score, k = min((2000000 * a // (of[p[:k]] + of[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), " ".join(p), of[p[:k]], of[p[k:]]))
        for rank, (score, a, _, phrase, l, r) in enumerate(sorted(found)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase, -a, l, r, total[lang], -score))
    return sorted(out)


@settings(deadline=None, max_examples=100)
@given(st.text(alphabet="aB é\t\n\r\x0b\x0c\x00\x1c .,;:!?-"))
def test_words_and_breaks(text):
    want = []
    for piece in PIECE.split(text.translate(UPPER)):
        want += WORD.findall(piece) + ["."]
    got = ["." if w == phrases.BREAK else w.decode() for w in phrases.fold_words(text.encode())]
    assert got == want[:-1]


def test_filter_has_no_false_negatives(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 2**63, 20_000).astype(np.uint64)
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key bigint").repartition(3)
    filter_ = phrases._filter(df.mapInArrow(phrases._key_slots, "slot bigint, bits bigint"))
    assert phrases.has(filter_, keys).all()
    assert phrases.has(filter_, rng.integers(1, 2**63, 20_000).astype(np.uint64)).mean() < 0.01


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    names = ["The", "the", "of", "new", "york", "times", "éa", "z", "x\x00", "zz"]
    rows = [(None, "en"), ("", "en"), (" \t\n", None), ("...", "fr"), ("hot pair of words. " * 400, "en"), ("hot pair of words. " * 400, "en")]
    for _ in range(150):
        words = [names[min(9, int(rng.exponential(2.5)))] + " .,"[int(rng.choice(3, p=[.8, .1, .1]))] for _ in range(rng.integers(0, 60))]
        rows.append((" ".join(words), ["en", "fr", None][rng.integers(3)]))
    return rows


@pytest.mark.parametrize("least, top, budget, chunk", [(5, 2000, 10**6, 10**6), (5, 30, 10**6, 500), (3, 2000, 50, 200), (30, 5, 300, 1000)])
def test_equal_to_brute_force(spark, corpus, least, top, budget, chunk):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(corpus)], "doc_id int, text string, lang string").repartition(4)
    got = phrases.mine(docs, least=least, top=top, budget=budget, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == brute(corpus, least, top)


def test_edges(spark):
    rows = [(1, "a b", "en"), (1, "a b", "en"), (None, "a b", "en"), (2, None, None), (3, "", "en"), (4, "lang word " * 100_000 + "x" * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string").withColumns({c: F.lit(1) for c in ("w1", "n", "word", "key", "bucket", "phrase")})
    got = phrases.mine(docs, least=3)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = {r.lang: tuple(r) for r in got.collect() if r.rank == 1}
    assert rows["en"] == ("en", 1, "a b", 3, 3, 3, 6, 1_000_000)
    assert rows["und"][1:4] == (1, "lang word lang word", 99_999)
    assert phrases.mine(docs.limit(0)).collect() == [] and phrases.mine(docs, least=10**9).collect() == []
