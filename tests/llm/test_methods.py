"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from cuespark.llm import chat, decontaminate, graph, katz, langid, licenses, mixing, neardup, pii, quality, urls, weak
from cuespark.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")


# --- benchmark decontamination

@settings(deadline=None, max_examples=60)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=14), max_size=4))
def test_wu_manber(text, items):
    text, items = [w.encode() for w in text], [[w.encode() for w in x] for x in items]
    patterns = collections.defaultdict(set)
    for i, item in enumerate(items):
        for w in decontaminate.windows(item, 10):
            patterns[w].add(i)
    hits, names = set(), set()
    for p, of in patterns.items():
        for k in range(len(text) - len(p) + 1):
            if tuple(text[k:k + len(p)]) == p:
                hits |= set(range(k, k + len(p)))
                names |= of
    found = set()
    spans = decontaminate.search(text, decontaminate.matchers(patterns), [], found)
    assert {k for a, b in zip(spans[::2], spans[1::2]) for k in range(a, b)} == hits and found == names
    assert all(b < a for b, a in zip(spans[1::2], spans[2::2]))


def test_pattern_blocks_give_the_same(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontaminate.digest(decontaminate.find_items(docs, bench))
    many = decontaminate.digest(decontaminate.find_items(docs, bench, block_words=3000))
    assert sorted(one.collect()) == sorted(many.collect())


# --- near duplicates

def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    links, root = collections.Counter(), {d: d for d in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            A, B = sets[a], sets[b]
            if A and B and 5 * len(A & B) >= 4 * len(A | B):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (top(d), links[d]) for d in ids}


def made_texts():
    words, texts = [f"w{i}" for i in range(400)], {}
    for g in range(6):
        base = [words[(g * 61 + 7 * k) % 400] for k in range(60)]
        for v in range(12):
            t = list(base)
            for c in range(v % 4):
                t[(13 * v + 29 * c) % 60] = f"x{g}{v}{c}"
            texts[g * 100 + v] = " ".join(t)
    return texts | {900: "", 901: "a b", 902: "a b", 903: "a b c"}


@pytest.mark.parametrize("block", [400_000, 500])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "NODE", 1)
    texts = made_texts()
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_classes(texts)


def test_near_duplicates_of_the_tables(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_classes(texts)
    kept = {r.doc_id for r in neardup.keep_one(docs).collect()}
    assert kept == {c for c, _ in got.values()}


def test_forest_recall():
    assert neardup.found_share(0.8, neardup.LEAST_DEPTH) > 0.99999 > neardup.found_share(0.8, neardup.DEPTH) > 0.999


def test_weak_links_are_found_beside_a_hot_group(spark):
    """Texts at 0.8 that share no full label, beside a group of near copies whose links are all found."""
    texts = {}
    for g, s in enumerate((2351, 2643, 6342)):
        a = [f"p{s}q{k}" for k in range(40)]
        texts |= {2 * g: " ".join(a), 2 * g + 1: " ".join(a[:36] + [f"r{s}q{k}" for k in range(4)])}
    base = [f"w{k}" for k in range(120)]
    texts |= {100 + v: " ".join([*base, f"x{v}"]) for v in range(60)}
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_classes(texts)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 0.95])
def test_the_weakest_link_meets_the_target(threshold):
    assert neardup.found_share(threshold, neardup.depth_for(threshold, 0.9999)) >= 0.9999
    with pytest.raises(ValueError):
        neardup.depth_for(0.1, 0.9999)


@settings(deadline=None, max_examples=8)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


# --- mixing

@pytest.mark.parametrize("bucket_rows", [4096, 7])
def test_mix(docs, bucket_rows):
    got = mixing.mix(docs, bucket_rows=bucket_rows).collect()
    sources = sorted({r.source for r in got})
    size = {s: sum(r["size"] for r in got if r.source == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    want, total = {}, 1.5 * sum(size.values())
    while True:
        rest = [s for s in sources if s not in want]
        share = {s: (total - sum(want.values())) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > 2 * size[s]]
        if not above:
            break
        want |= {s: 2.0 * size[s] for s in above}
    want |= share
    longest = max(r["size"] for r in got)
    for s in sources:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == size[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= longest
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    assert sorted(got, key=str) == sorted(mixing.mix(docs.repartition(3), bucket_rows=bucket_rows).collect(), key=str)


def test_pivot_is_fair(spark):
    """Copies follow their probabilities over many seeds, whatever the sizes."""
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = collections.Counter()
    for seed in range(8):
        for r in mixing.mix(d, seed=seed, bucket_rows=8).collect():
            taken[r.source] += r.taken
    assert taken["a"] / 8 == pytest.approx(2 * sum(len(t.split()) for _, t, s in rows if s == "a"), rel=0.35)


# --- language identification

def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).where(langid.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    again = {r.doc_id: r.score for r in langid.identify(d.repartition(5)).where(langid.held_out()).collect()}
    assert max(abs(again[r.doc_id] - r.score) for r in got) < 1e-9


def test_language_of_few_copied_texts_is_learned(spark, docs):
    """A language of two texts in many copies is sampled whatever the hash of its texts, and the sample never exceeds its bound."""
    base = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    for k in range(6):
        said = [f"zwqk{k} vexu{k} jyppo qquzz wyzzk {k} xuvvo" + " qyzzu vuxxe" * n for n in (2, 5)]
        d = spark.createDataFrame(base + [(100_000 + i, said[i % 2], "zz") for i in range(2000)], "doc_id bigint, text string, lang string")
        got = langid.identify(d).where("doc_id >= 100000").groupBy("lang_pred").agg({"score": "min"}).collect()
        assert [r.lang_pred for r in got] == ["zz"] and got[0][1] >= 0.5


def test_language_sample_is_bounded(spark, docs, monkeypatch):
    seen = []
    fit = langid.fit_weights
    monkeypatch.setattr(langid, "fit_weights", lambda rows, *a: seen.extend(r[0] for r in rows) or fit(rows, *a))
    few = [(100_000 + i, "same text again and again", "zz") for i in range(500)]
    model = langid.train(docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(few, "doc_id bigint, text string, lang string")), per_language=10)
    assert [seen.count(i) for i in range(len(model.languages))] == [8 if x != "zz" else 1 for x in model.languages]


def test_penalty_makes_weights_sparse(docs):
    model = langid.train(docs)
    assert 0 < (model.weights != 0).mean() < 0.5 and 0.01 < model.temperature < 25


# --- language model

def brute_katz(texts, trained):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = {d: WORD.findall((t or "").translate(low)) + ["\n"] for d, t in texts.items()}
    uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for d in trained:
        w = toks[d]
        prev = ["\t", *w[:-1]]
        uni.update(w)
        bi.update(zip(prev, w))
        ctx.update(prev)
    base = sum(uni.values()) + 0.1 * (len(uni) + 1)
    disc = [*katz.good_turing(collections.Counter(bi.values())), 1.0]
    kept, below = collections.Counter(), collections.Counter()
    for (h, w), c in bi.items():
        kept[h] += disc[min(c, 6)] * c
        below[h] += (uni[w] + 0.1) / base
    whole = {h: c if kept[h] < c else c + 1 for h, c in ctx.items()}

    def p(h, w):
        c = bi.get((h, w))
        if c:
            return disc[min(c, 6)] * c / whole[h]
        low = (uni[w] + 0.1) / base
        return (1 - kept[h] / whole[h]) / (1 - below[h]) * low if h in ctx else low

    for h in list(ctx)[:40]:            # exactly normalised, with one unknown word
        assert sum(p(h, w) for w in [*uni, "unknown word"]) == pytest.approx(1.0, abs=1e-9)
    return toks, uni, base, p


@pytest.mark.parametrize("bucket, chunk", [(4_000_000, 2_000_000), (3000, 1000)])
def test_katz(spark, docs, monkeypatch, bucket, chunk):
    monkeypatch.setattr(katz, "BUCKET", bucket)
    texts = {r.doc_id: r.text for r in docs.collect()}
    trained = [d for d in texts if zlib.crc32(str(d).encode()) % 10]
    toks, uni, base, p = brute_katz(texts, trained)
    model = katz.train(docs.where(docs.doc_id.isin(trained)))
    assert model.tokens == sum(uni.values()) and model.vocabulary == len(uni)
    for r in katz.score(docs, model).collect():
        w = toks[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(w), sum(x in uni for x in w))
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 0.1) / base) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(h, x)) for h, x in zip(["\t", *w[:-1]], w)))


def test_katz_split_context_is_known_everywhere(spark):
    """A frequent context with a single follower is split; bigrams of it that training has not seen land in other buckets."""
    texts = {i: f"often then c{i % 7} d{i % 11}" for i in range(400)} | {1000 + i: f"often new{i} often c{i} x" for i in range(60)}
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    toks, uni, base, p = brute_katz(texts, range(400))
    model = katz.train(d.where("doc_id < 1000"))
    often = katz.WordHashes().of(b"often")[0]
    assert model.deal.parts[list(model.deal.split).index(often)] > 1
    for r in katz.score(d, model).collect():
        w = toks[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(w), sum(x in uni for x in w))
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 0.1) / base) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(h, x)) for h, x in zip(["\t", *w[:-1]], w)))


def test_katz_splits_the_contexts_of_copies(spark, monkeypatch):
    """All copies of a text are sampled like other rows: the words of a text that fills a third of the table are dealt over many buckets."""
    monkeypatch.setattr(katz, "BUCKET", 22_000)
    texts = spark.range(20_000).selectExpr("id as doc_id", "'the hot text has ten words and comes again now' as text").unionByName(
        spark.range(40_000).selectExpr("id + 20000 as doc_id", "concat_ws(' ', transform(sequence(1, 10), x -> concat('w', hash(id, x) % 5000))) as text"))
    model = katz.train(texts)
    hot = katz.WordHashes().of(b"the hot text has ten words and comes again now")
    parts = dict(zip(model.deal.split.tolist(), model.deal.parts.tolist()))
    assert model.deal.buckets >= 25 and all(parts.get(h, 1) > 1 for h in hot.tolist())
    assert model.tokens == 660_000
    seen = katz.score(texts.where("doc_id < 20000"), model).selectExpr("min(n_known) a", "max(score) - min(score) b", "count(*) c").first()
    assert seen.a == 11 and abs(seen.b) < 1e-9 and seen.c == 20_000


# --- personal data

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        c = int(c) * (1 + i % 2)
        total += c - 9 if c > 9 else c
    return total % 10 == 0


def brute_base(t):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


PIECES = ["a@b.c", "@", "x.y%z@", "d-e.f.g", "_", " ", "\n", "\U0001F600", "é", "1.2.3.4", ".5", "255.255.255.256", "0000001.1.1.1", "+1 (234) 555-0100", "+",
          "4111 1111 1111 1111", "4111111111111112", "-", "(", "+491701234567", "12", "token = \"0123456789abcdef0123\"", "me [at] x [dot] org", "(212) 555-0199"]


@settings(deadline=None, max_examples=1)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=300, max_size=300))
def test_base_spans(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in pii.digest(pii.find(d)).collect():
        want = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k) for k in ("email", "ip", "card", "phone")]


def test_secrets_are_added_and_masked(spark, docs):
    own = [(10_000 + i, f'words {i} before token = "{hashlib.sha1(bytes([i])).hexdigest()}" and after, card 4539 5787 6362 1487', "en", "s") for i in range(20)]
    docs = docs.unionByName(spark.createDataFrame(own, docs.schema))
    found = pii.find(docs).collect()
    kinds = collections.Counter(s.kind for r in found for s in r.spans)
    assert kinds["secret"] > 0
    for r in found:
        assert all(r.text[s.start:s.end] == s.piece for s in r.spans)
    left = pii.mask(docs).collect()
    assert not any(brute_base(r.text) for r in left) and len(left) == len(found)


def test_long_secrets_and_addresses_are_whole(spark, docs):
    """However long the value is, the span is all of it and nothing of it stays in the text."""
    long = [hashlib.sha512(bytes([i])).hexdigest() * 8 for i in range(20)]                 # 1024 characters
    texts = [f"words {i} before token={v} and after" for i, v in enumerate(long)]
    texts += [f"contact a{v[:80]} [at] host{i}{' [dot] sub' * 11} [dot] org today" for i, v in enumerate(long)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    wide = {r.doc_id: [(s.kind, s.piece) for s in r.wide] for r in d.select("doc_id", pii.wide_spans(d.text, pii.base_spans(d.text)).alias("wide")).collect()}
    for i, v in enumerate(long):
        assert wide[i] == [("secret", f"token={v}")]
        assert wide[20 + i] == [("email", texts[20 + i][len("contact "):-len(" today")])]
    own = [(10_000 + i, t, "en", "s") for i, t in enumerate(texts)]
    left = {r.doc_id: r.text for r in pii.mask(docs.unionByName(spark.createDataFrame(own, docs.schema))).collect()}
    assert all(left[10_000 + i] == f"words {i} before [SECRET] and after" for i in range(20))


# --- quality

def test_quality_measures(docs):
    for r in quality.judge(docs, keep_text=True).collect():
        w = WORD.findall(r.text or "")
        seen = collections.defaultdict(list)
        for i in range(len(w) - 4):
            seen[tuple(w[i:i + 5])].append(i)
        covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_quality_against_labels(spark):
    """Labels are never seen by the model; it must tell most bad documents and keep the good ones."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    label = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judge(d).select("doc_id", "kept").join(label, "doc_id").collect()
    kept = collections.Counter((r["quality"], r.kept) for r in rows)
    assert kept[0, True] < 0.2 * kept[0, False] and kept[1, False] < 0.05 * kept[1, True]


def test_estimate_finds_reliable_voters():
    votes = [((1, 1, 1), 800), ((0, 0, 1), 90), ((0, 0, 0), 90), ((1, 1, 0), 100), ((2, 2, 2), 5)]
    r = weak.estimate(votes, 3)
    assert r.posterior((0, 0, 1)) < 0.5 < r.posterior((1, 1, 0)) and r.posterior((2, 2, 2)) == pytest.approx(r.prior)


# --- licences, URLs, chats

def test_license_rules(spark):
    texts = ["Licensed under the Apache License, Version 2.0 (the \"License\");\nYou may not use this file except in compliance with the License.\n"
             "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in "
             "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
             "or implied. See the License for the specific language governing permissions and limitations under the License.",
             "Released under the MIT License. Licensed under CC BY-NC 4.0. Released under the MIT License.", "a licence of my own", "You may obtain a copy of the License at"]
    got = licenses.digest(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == ["Apache-2.0", "MIT,CC-BY-NC-4.0", "", ""]
    assert [r.rest for r in got] == ["", "", "", "ApacheAt"]
    assert all(any(t in s for t in licenses.TRIGGERS) for s in licenses.SENTENCES)


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("comment", ["", "# ", " * ", "// ", "-- "])
def test_wrapped_licenses(spark, comment, end):
    def written(text):
        return end.join((comment + line).rstrip() for line in text.split("\n"))

    texts = [MIT, BSD, BSD3, GPL, "words before\n" + MIT[MIT.index("Permission"):], "Released under the MIT License\nand some words\nLicensed under CC BY 4.0",
             "released under\n\nthe MIT License", "it was Released under the\nMIT License"]
    d = spark.createDataFrame([(i, written(t)) for i, t in enumerate(texts)], "doc_id int, text string")
    got = licenses.digest(licenses.scan(d)).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == ["MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0-or-later", "MIT", "MIT,CC-BY-4.0", "", ""]
    assert [r.rest for r in got] == ["", "", "", "", "", "", "MITtitle", "MITtitle"]


def brute_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_url_rules(spark):
    from cuespark.llm.queries import QUERIES
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    for r in QUERIES["op3_urls"](spark, SF).collect():
        rest = pages[r.page_id].split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        assert (r.host, r.path) == (host.lower(), re.match(r"[^?#]*", rest[len(host):])[0])
        rule = brute_rule(r.host, r.path)
        assert r.rule == (rule.name if rule else None) and (rule is None or r.verdict == rule.verdict)


def test_template_tree(spark):
    rows = [(i, f"http://h.net/good/{i}") for i in range(20)] + [(i, f"http://h.net/bad/{i}.html") for i in range(20)]
    rows += [(i, f"http://h.net/user/{n}") for i, n in enumerate("ann bob cy dee eve flo gus hal ivy joe".split() * 3)]
    pages = spark.createDataFrame(rows, "page_id int, url string").distinct()
    from pyspark.sql import functions as F
    label = F.when(F.col("path").contains("/good/1"), True).when(F.col("path").contains("/bad/1"), False)
    got = {(r.template, r.verdict) for r in urls.filter_urls(pages, [], label).collect()}
    assert ("/good/{n}", "allow") in got and ("/bad/{n}.html", "block") in got and any(t.startswith("/user/") for t, _ in got)


def test_page_evidence_tells_templates_of_open_hosts(spark):
    from pyspark.sql import functions as F
    prose, junk = "<script>x###</script><p>" + "plain words of text " * 20, "<p>" + "junk%%% *** $$$ " * 20
    rows = [(i, f"http://open.net/{t}/{i}", h) for t, h in (("news", prose), ("tags", junk)) for i in range(12)] + [(99, "http://open.net/new", None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {(r.template, r.verdict) for r in urls.filter_urls(pages, [], urls.page_evidence(F.col("html"))).collect()}
    assert got == {("/news/{n}", "allow"), ("/tags/{n}", "block"), ("/new", "allow")}
    one = spark.createDataFrame([("<p>" + "a b c d e " * 4,), (None,), ("<p>few",), ("",)], "html string")
    assert [r[0] for r in one.select(urls.page_evidence(F.col("html"))).collect()] == [None, None, False, False]


def test_query_labels_vary_within_open_hosts(spark, tmp_path):
    from cuespark.llm.queries import QUERIES
    prose, junk = "<p>" + "plain words of text " * 20, "<p>" + "junk%%% *** $$$ " * 20
    rows = [(i, f"http://open.net/{t}/{i}", h) for t, h in (("news", prose), ("tags", junk)) for i in range(12)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {(r.template, r.verdict) for r in QUERIES["op3_urls"](spark, str(tmp_path)).collect()} == {("/news/{n}", "allow"), ("/tags/{n}", "block")}


def test_hot_bad_host_leaves_unlabelled_pages_alone(spark):
    """A blocked host with most of the rows and templates decides nothing about hosts without labels."""
    from pyspark.sql import functions as F
    rows = [(i, f"http://bad.net/{'abcdefghij'[i % 10]}/{i}") for i in range(300)] + [(1000 + i, f"http://good{i}.net/a/{i}") for i in range(3)]
    rows += [(2000 + i, f"http://open{i}.org/b/{i}") for i in range(5)]
    label = F.when(F.col("host") == "bad.net", False).when(F.col("host").startswith("good"), True)
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id int, url string"), [], label).collect()
    assert {r.verdict for r in got if r.host == "bad.net"} == {"block"} and {r.verdict for r in got if r.host != "bad.net"} == {"allow"}
    assert {round(r.purity, 6) for r in got if r.host.startswith("open")} == {round(4 / 6, 6)}


@settings(deadline=None, max_examples=100)
@given(st.lists(st.tuples(st.text(max_size=8), st.text("<|>end[]/\\INSTlbr\r\n x", max_size=20)), max_size=6))
def test_chat_round_trip(turns):
    out, spans = chat.trace(turns, chat.marked)
    assert chat.read_marked(out) == turns
    for (_, text), s in zip(turns, spans):
        assert not s["rewrites"] and chat.unescape(out[s["text_start"]:s["text_end"]]) == text
    assert "".join(out[s["start"]:s["end"]] for s in spans) == out


def test_rewriting_template():
    def last_only(turns):               # keeps a mark on the newest turn only
        return "".join(f"[{r}]{t}" + ("*" if k == len(turns) - 1 else "") for k, (r, t) in enumerate(turns))

    _, spans = chat.trace([("u", "a"), ("v", "b"), ("u", "c")], last_only)
    assert [s["rewrites"] for s in spans] == [False, True, True] and spans[1]["start"] == 4


@pytest.mark.parametrize("template", [
    chat.marked, lambda t: "<s>" + chat.marked(t), lambda t: f"{len(t)} turns" + chat.marked(t),
    lambda t: "".join(f"#{k}{r}{x}" for k, (r, x) in enumerate(t)), lambda t: chat.marked(t[-40:])])
def test_windows_give_what_prefixes_give(template):
    turns = [(("user", "assistant")[k % 2], f"text {k} [x]") for k in range(90)]
    assert chat.trace(turns, template, 16) == chat._prefixes(turns, template)


# --- the pipeline

def test_pipeline(spark):
    d = corpus_pipeline.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in d.collect()}
        after = corpus_pipeline.settle(stage(spark, d, SF), name)
        rows = after.collect()
        if name == "language":
            assert {r.doc_id for r in rows} == {i for i, t in before.items() if any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            assert {r.doc_id for r in rows} == {c for c, _ in brute_classes(before).values()} and len(rows) == len({r.doc_id for r in rows})
        elif name == "decontaminate":
            words = {i: decontaminate.fold_words(t.encode()) for i, t in before.items()}
            wins = {w for r in corpus_pipeline.table(spark, SF, "benchmark").collect() for w in decontaminate.windows(decontaminate.fold_words(r.text.encode()))}
            hit = {i for i, w in words.items() if any(tuple(w[k:k + n]) in wins for n in {len(x) for x in wins} for k in range(len(w) - n + 1))}
            assert {r.doc_id for r in rows} == set(before) - hit
        elif name == "personal_data":
            assert {r.doc_id for r in rows} == set(before) and not any(brute_base(r.text) for r in rows)
        else:
            longest = max(r["size"] for r in rows)
            for s in {r.source for r in rows}:
                own = [r for r in rows if r.source == s]
                assert abs(sum(r["size"] for r in own) - own[0].target) <= longest
        d = after
