import collections
import math
import re
import zlib

import pytest

from cuespark.llm import katz, katz_trigrams

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, trained):
    """Probabilities of Katz backoff of order 3, word by word."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = {d: WORD.findall((t or "").translate(low)) + ["\n"] for d, t in texts.items()}
    uni, grams = collections.Counter(), (collections.Counter(), collections.Counter())
    for d in trained:
        w = ["\t", "\t", *toks[d]]
        uni.update(toks[d])
        grams[0].update(zip(w[1:], w[2:]))
        grams[1].update(zip(w, w[1:], w[2:]))
    base = sum(uni.values()) + 0.1 * (len(uni) + 1)
    disc = [[*katz.good_turing(collections.Counter(g.values())), 1.0] for g in grams]
    contexts = {}

    def p(gram):
        if len(gram) == 1:
            return (uni[gram[0]] + 0.1) / base
        g, d, h = grams[len(gram) - 2], disc[len(gram) - 2], contexts.get(gram[:-1])
        if h is None:
            return p(gram[1:])
        return d[min(g[gram], 6)] * g[gram] / h[0] if gram in g else h[1] * p(gram[1:])

    for g, d in zip(grams, disc):
        sums = collections.defaultdict(lambda: [0, 0.0, 0.0])
        for gram, c in g.items():
            for i, x in enumerate((c, d[min(c, 6)] * c, p(gram[1:]))):
                sums[gram[:-1]][i] += x
        for h, (c, kept, below) in sums.items():
            whole = c if kept < c else c + 1
            contexts[h] = whole, (1 - kept / whole) / (1 - below)
    for h in [h for h in contexts if len(h) == 2][:40]:             # exactly normalised, with one unknown word
        assert sum(p((*h, w)) for w in [*uni, "unknown word"]) == pytest.approx(1.0, abs=1e-9)
    return toks, uni, base, p


def compare(spark, texts, trained):
    toks, uni, base, p = brute(texts, trained)
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    model = katz_trigrams.train(d.where(d.doc_id.isin(list(trained))))
    rows = katz_trigrams.score(d, model).collect()
    assert len(rows) == len(texts) and model.tokens == sum(uni.values()) and model.vocabulary == len(uni)
    for r in rows:
        w = toks[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(w), sum(x in uni for x in w))
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 0.1) / base) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(g)) for g in zip(["\t", "\t", *w], ["\t", *w], w)))
    return model


@pytest.mark.parametrize("bucket, chunk, codes", [(4_000_000, 2_000_000, 65_000), (3000, 1000, 20)])
def test_order_three(spark, monkeypatch, bucket, chunk, codes):
    monkeypatch.setattr(katz, "BUCKET", bucket)
    monkeypatch.setattr(katz_trigrams, "CODES", codes)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    compare(spark, texts, [d for d in texts if zlib.crc32(str(d).encode()) % 10])


def test_contexts_of_split_words(spark):
    """Contexts of two words whose second one is split are summed over buckets, and known in buckets that never saw them."""
    texts = {i: f"p{i % 3} often c{i % 7} d{i % 11} often then e" for i in range(400)}
    texts |= {1000 + i: f"p{i % 4} often new{i} p1 often c{i} x often then y" for i in range(60)}
    model = compare(spark, texts, range(400))
    assert len(model.plan.deal.split) and model.pairs.count()


def test_empty(spark):
    d = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id bigint, text string")
    model = katz_trigrams.train(d.limit(0))
    assert katz_trigrams.score(d.limit(0), katz_trigrams.train(d)).collect() == []
    assert {r.doc_id: r.n_known for r in katz_trigrams.score(d, model).collect()} == {1: 0, 2: 0}
