"""Every operator and pipeline stage on empty tables, nulls, empty and long texts, repeats and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuespark.llm import chat, decontaminate, katz, langid, licenses, mixing, neardup, pii, quality, urls

# columns named like results, which must be replaced or left alone but never break anything
CLASH = ("n_words bigint, n_hit bigint, items string, spans string, base string, size bigint, target double, copies bigint, "
         "p double, coin double, bucket int, mark bigint, lang_pred string, score double, class_id bigint, n_links bigint, "
         "label bigint, kept boolean, licenses string, rest string, `__w` int, host string, template string, "
         # and like what operators name their own helpers
         "ratio double, s string, unit int, last_p double, weight double, rank int, at_doc bigint, at_mark bigint, `rows` int, node bigint, "
         "`__wide` int, `__own_base` int, `__words` int, `__lines` int, `__hashes` int, `__done` int, `__end` int, `__mark` int, c0 int, ruled string, judged string")
N_CLASH = CLASH.count(",") + 1
LONG = "palabra larga " * 60_000 + "1" * 100_000 + " " + "a." * 50_000 + " (" * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four five six seven eight nine ten eleven. mail me@x.org", "en", "a"), (2, "", "en", "a"), (3, None, None, None),
            (None, "one two three four five six seven eight nine ten eleven. mail me@x.org", None, "b"), (4, " \n\t ", "fr", "b"), (5, LONG, "es", None),
            (6, "same row", "en", "a"), (6, "same row", "en", "a"), (6, "other text under the same id", "fr", "a"), (7, "12345 !!! ###", "de", "b"),
            (8, "\U0001F600 ünï cödé \U0001F600 ünï", "de", "b"), (None, None, None, None)]
    return spark.createDataFrame([(*r, *[None] * N_CLASH) for r in rows], f"doc_id bigint, text string, lang string, source string, {CLASH}")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven mail"), (2, "same ROW"), (3, None), (4, ""), (None, "same row")],
                                 "item_id bigint, text string")


def by_doc(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=str)


def operators(bench):
    return {
        "licenses": lambda d: licenses.digest(licenses.scan(d)),
        "decontaminate": lambda d: decontaminate.digest(decontaminate.find_items(d, bench)),
        "langid": lambda d: langid.identify(d),
        "mix": lambda d: mixing.mix(d, bucket_rows=2),
        "katz": lambda d: katz.score(d, katz.train(d), blocks=2),
        "pii": lambda d: pii.digest(pii.find(d)),
        "quality": lambda d: quality.judge(d),
        "quality_with_text": lambda d: quality.judge(d, keep_text=True),
        "neardup": lambda d: neardup.near_duplicates(d),
    }


@pytest.mark.parametrize("name", sorted(operators(None)))
def test_one_row_each_and_none_from_none(docs, bench, name):
    op = operators(bench)[name]
    assert len(op(docs).collect()) == docs.count()
    assert op(docs.limit(0)).collect() == []


def test_decontaminate_results(docs, bench):
    got = decontaminate.find_items(docs, bench).select("doc_id", "n_words", "n_hit", "items").collect()
    of = {(r.doc_id, r.n_words): (r.n_hit, r["items"]) for r in got}
    assert of[1, 15] == of[None, 15] == (11, ["1"])
    assert of[6, 2] == (2, ["2", "null"]) and of[6, 6] == (0, [])
    assert of[2, 0] == of[3, 0] == of[4, 0] == (0, [])
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert decontaminate.remove_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_langid_results(docs):
    got = langid.identify(docs).select("doc_id", "text", "lang_pred", "score").collect()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(none).collect()} == {"und"}


def test_neardup_results(docs):
    got = by_doc(neardup.near_duplicates(docs).collect(), "doc_id", "class_id", "n_links")
    assert (1, 1, 1) in got and (None, 1, 1) in got            # copies, one of them without id
    assert got.count((6, 6, 1)) == 2 and got.count((6, 6, 0)) == 1
    assert (2, 2, 0) in got and (3, 3, 0) in got and (4, 4, 0) in got and (None, None, 0) in got
    kept = neardup.keep_one(docs).collect()
    assert len(kept) == docs.count() - 2                        # a copy without id, and a repeated row


RESULTS = {"licenses": {"licenses", "rest"}, "mix": {"size", "target", "copies"}, "pii": {"base", "spans"},
           "quality": {"n_words", "kept"}, "quality_with_text": {"n_words", "kept"}}


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_other_columns_keep_their_values(docs, name):
    marked = docs.select("doc_id", "text", "lang", "source", *[
        F.lit("1").cast(t).alias(c) for c, t in docs.dtypes if c not in ("doc_id", "text", "lang", "source")])
    op = {"licenses": licenses.scan, "mix": lambda d: mixing.mix(d, bucket_rows=2), "pii": pii.find, "quality": quality.judge,
          "quality_with_text": lambda d: quality.judge(d, keep_text=True)}[name]
    own = [c for c in marked.columns if c not in RESULTS[name] | {"text"}]
    left, right = op(marked).select(own), marked.select(own)
    assert left.exceptAll(right).count() == right.exceptAll(left).count() == 0


def test_quality_results(docs):
    got = {r.doc_id: r for r in quality.judge(docs).collect() if r.doc_id in (1, 2, 3, 5)}
    assert got[2].base_failed and got[3].base_failed and not got[3].kept and got[3].n_words == 0
    assert got[5].n_repeat_words > 119_000 and got[5].base_failed


def test_pii_results(docs):
    got = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect() if r.doc_id in (1, 3, 5)}
    assert got[1].n_email == 1 and got[1].spans == "email:62:70" and got[3].spans == ""
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[1].endswith("mail [EMAIL]") and masked[3] is None and masked[5] == LONG


def test_mix_results(docs):
    got = mixing.mix(docs, bucket_rows=2).collect()
    assert all(r.copies <= 2 and r.taken == r.copies * r["size"] for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))


def test_chat_edges(spark):
    rows = [(1, 1, "user", None), (1, 2, None, "x"), (None, 0, "assistant", ""), (2, 5, "assistant", "tie"), (2, 5, "assistant", "tie"), (1, None, "system", "s")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn int, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("system", "s"), ("user", ""), ("", "x")]
    assert got[2].loss == "tietie" and got[None].loss == "" and len(got[None].turns) == 1
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, ""), (4, "http://"), (5, "x://HOST?q"), (6, "a://b/c//d/#e"), (6, "a://b/c//d/#e"),
                                   (7, "a://b/" + "s/" * 5000)], "page_id int, url string").withColumn("template", F.lit("own")).withColumn("host", F.lit(1))
    pages = pages.withColumn("ruled", F.lit("mine")).withColumn("judged", F.lit(2)).withColumn("good_url", F.lit(3))
    kept = urls.filter_urls(pages, [urls.Rule("b", "/c/", "block")]).select("ruled", "judged", "good_url").distinct().collect()
    assert [tuple(r) for r in kept] == [("mine", 2, 3)]
    got = by_doc(urls.filter_urls(pages, [urls.Rule("b", "/c/", "block")]).collect(), "page_id", "host", "path", "rule", "verdict")
    assert [g[1:3] for g in got[:5]] == [("", "")] * 4 + [("host", "")]
    assert got[5] == got[6] == (6, "b", "/c//d/", "b/c/", "block") and got[7][4] in ("allow", "block")
    assert urls.filter_urls(pages.limit(0), []).collect() == []
    assert {r.verdict for r in urls.filter_urls(pages, []).collect()} == {"allow"}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(docs, tmp_path, bench, spark, name, stage):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = stage(spark, docs, str(tmp_path))
    n = len(got.collect())
    if name == "mix":
        assert set(docs.columns) <= set(got.columns)
    else:
        assert set(got.columns) - {"n_chars"} == set(docs.columns) and n <= docs.count()
    empty = docs.limit(0)
    assert stage(spark, empty, str(tmp_path)).collect() == []
