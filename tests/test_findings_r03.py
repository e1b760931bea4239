"""Cases from the review of round 3."""

import random
import time

import pyarrow as pa
import pytest

from cuespark.functions import chunks
from cuespark.functions.python_text import edit_distance
from cuespark.operators import prompts, quality, rerank
from cuespark.sources import subtitles, writers
from cuespark.streaming import streams


def test_ascii_words_of_penalty(spark):
    """A term next to a letter outside ASCII: its own word in SQL, part of the longer word in Unicode."""
    d = spark.createDataFrame([(0, "see SSö ok", "see ssö ok", "fr"), (1, "see SS ok", "see ss ok", "fr"), (2, "éGitHub", "égithub", "fr")],
                              "i int, s string, o string, t string").orderBy("i")
    p = d.select(rerank.penalty("s", "o", "t", ascii_words=True), rerank.penalty("s", "o", "t")).collect()
    assert [tuple(r) for r in p] == [(0.05, 0.0), (0.05, 0.05), (0.05, 0.0)]


def test_ascii_words_of_adjusted_similarity(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], "see SSö ok", "see ssö ok", "fr")],
                              "source_vec array<double>, out_vec array<double>, source_text string, text string, target string")
    assert [rerank.adjusted_similarity(d, ascii_words=a).first().score for a in (True, False)] == [0.95, 1.0]


def test_ascii_words_of_translation_prompt(spark):
    d = spark.createDataFrame([("see SSö ok", "en", "ur")], "s string, a string, b string")
    prompts = d.select(*[rerank.translation_prompt("s", "a", "b", ascii_words=x) for x in (True, False)]).first()
    assert ["SS translates to SS\n" in p for p in prompts] == [True, False]


@pytest.mark.parametrize("fmt", ["srt", "vtt", "sbv", "ass"])
def test_long_words_come_back_whole(spark, fmt):
    """Words longer than a line, alone and among others, filled and balanced; next to two words of the same lengths."""
    texts = ["el ción arrara gaarosciónmentega un,", "el ción arrara gaarosció nmentega un,", "gaarosciónmentegaaa", "gaarosciónmentegaaa un"]
    cues = spark.createDataFrame([(0, i, float(i), i + 0.5, x, "ja") for i, x in enumerate(texts)],
                                 "track_id long, id long, start double, end double, text string, language string")
    docs = writers.WRITERS[fmt](cues, whole_words=True).selectExpr("track_id as path", "document as value")
    assert [r.text for r in subtitles.parse(docs, fmt).orderBy("id").collect()] == texts


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_against_a_plain_loop():
    rnd = random.Random(3)
    texts = ["", "a"] + ["".join(rnd.choices("abcé𝄞", k=rnd.choice((1, 3, 20, 63, 64, 65, 130)))) for _ in range(60)]
    pairs = [(a, b) for a in texts for b in rnd.sample(texts, 8)] + [(t, t + t) for t in texts] + [(t.replace("a", ""), t) for t in texts]
    assert [edit_distance(*p) for p in pairs] == [plain_distance(*p) for p in pairs]


def test_long_transcripts_take_no_square_of_their_length(spark):
    """40 lines of 100,000 letters, their e dropped: 10 billion cells each if every cell is filled in."""
    d = spark.range(40).selectExpr("id", "repeat('the seven men ', 8000) as ref", "'en' as language").selectExpr("*", "replace(ref, 'e', '') as hyp")
    begun = time.monotonic()
    assert {round(r.cer, 9) for r in quality.speech_errors(d).select("cer").collect()} == {round(4 / 11, 9)}
    assert time.monotonic() - begun < 60


def test_null_and_empty_transcripts(spark):
    d = spark.createDataFrame([(0, None, "ab", "en"), (1, "ab", None, "en"), (2, None, "", "en"), (3, "", "", "en"), (4, "x", "", "en"), (5, "ab", "ba", None)],
                              "i int, hyp string, ref string, language string")
    got = [(r.cer, r.extra) for r in quality.speech_errors(d).orderBy("i").collect()]
    assert got == [(None, 0.0), (None, 0.0), (1.0, 0.0), (0.0, 0.0), (1.0, 1.0), (1.0, 0.0)]


def test_gram_totals_of_batches():
    """Texts of few letters, of many (which do not fit a number), empty ones, and chunks of one and of many rows."""
    rnd = random.Random(5)
    few = ["".join(rnd.choices("ab é𝄞", k=n)) for n in (0, 1, 3, 6, 40, 300) for _ in range(8)]
    many = ["".join(map(chr, rnd.choices(range(0x4E00, 0x9000), k=3000))) for _ in range(4)]
    for texts in (few, few + many, [""] * 3, []):
        others = [t[::2] + t for t in texts]
        assert quality.all_gram_totals(texts, others, 6) == [quality.gram_totals(*p, 6) for p in zip(texts, others)]
        assert quality.all_gram_totals(others, texts, 6) == [quality.gram_totals(*p, 6) for p in zip(others, texts)]
    old, quality.GRAM_CHUNK = quality.GRAM_CHUNK, 1
    try:
        assert quality.all_gram_totals(few, few[::-1], 6) == [quality.gram_totals(*p, 6) for p in zip(few, few[::-1])]
    finally:
        quality.GRAM_CHUNK = old


def test_pieces_leave_in_small_batches(spark):
    """No batch of pieces holds much more text than AT_ONCE, however many rows come in at once."""
    sizes = []

    class Rows:
        columns = ["k", "text"]
        schema = spark.range(1).selectExpr("id as k").schema

        def select(self, *names):
            return self

        def mapInArrow(self, fn, schema):
            texts = ["one two. " * 20_000, None, "", *["three, four. " * 2000] * 200]
            batch = pa.RecordBatch.from_pydict({"k": range(len(texts)), "text": texts})
            out = list(fn([batch]))
            sizes.extend(sum(map(len, b.column("piece").to_pylist())) for b in out)
            return [r for b in out for r in b.to_pylist()], texts

    rows, texts = chunks.chunk_punctuation(Rows(), 200, 20)
    assert max(sizes) <= chunks.AT_ONCE and len(sizes) > 4
    want = [(k, i, p) for k, t in enumerate(texts) for i, p in enumerate(chunks.punctuation_chunks(t or "", 200, 20))]
    assert [(r["k"], r["piece_no"], r["piece"]) for r in rows] == want


def test_voice_prompt_moves_words_once(spark):
    words = spark.range(10).selectExpr("id div 4 as track_id", "id % 2 as speaker", "id as clip_no", "1.0D as start", "1.2D as end", "3.6D as clip_seconds", "' a' as word")
    plan = prompts.voice_prompt(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_arrivals_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.srt").write_text(str(i))
    spark.conf.unset(streams.LISTING)
    spark.sparkContext.setJobGroup("arrivals", "")
    tracker, seen = spark.sparkContext.statusTracker(), set()
    stream = streams.file_arrival_stream(spark, str(tmp_path), "*.srt")
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    for job in tracker.getJobIdsForGroup(str(query.runId)):
        for stage in tracker.getJobInfo(job).stageIds:
            info = tracker.getStageInfo(stage)
            seen.add(info.numTasks if info else 0)
    assert query.lastProgress is not None and seen and max(seen) <= 40


def test_build_cues_shuffles_words_once(spark, monkeypatch):
    """segments are dealt once, to where their cues are built."""
    from cuespark.operators import build
    plans, settle = [], build.settle

    def watched(df, name):
        if name == "built":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, name)

    monkeypatch.setattr(build, "settle", watched)
    schema = ("track_id long, id long, start double, end double, text string, "
              "words array<struct<word:string,start:double,end:double>>, language string")
    rows = [(t, i, 0.0, 1.0, " a b", [(" a", 0.0 + i, 0.2 + i), (" b", 0.3 + i, 0.5 + i)], "en") for t in range(3) for i in range(9)]
    d = spark.createDataFrame(rows, schema)
    whole = build.build_cues(d, timing=False).orderBy("track_id", "id").collect()
    assert plans[0].count("Exchange hashpartitioning") + plans[0].count("Exchange SinglePartition") == 1
    assert build.build_cues(d, timing=False, block=2).orderBy("track_id", "id").collect() == whole      # stretches over many blocks


def test_routes_are_sorted_once(spark):
    """one sort for all hops; the choice is joined by number, not by text."""
    from pyspark.sql import functions as F

    from cuespark.operators import infer
    rows = [(t, i, "ur", f"text {i}", ["fr-en", "en-ur"] if t % 2 else ["en-ur"]) for t in range(2) for i in range(5)]
    d = spark.createDataFrame(rows, "track_id long, unit_id long, target string, text string, legs array<string>")

    def run(m, x):
        return [f"{m} {y}" for y in x]

    plan = infer.infer_route(d, lambda k: k, run)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
    out = infer.infer_route(d, lambda k: k, run, candidates=lambda m, x: [[f" {y} ", f"{m} {y}"] for y in x],
                            score=lambda o: o.withColumn("score", F.length("text").cast("double")))
    assert {(r.track_id, r.unit_id): r.translated for r in out.collect()} == {
        (t, i): f"en-ur fr-en text {i}" if t else f"en-ur text {i}" for t in range(2) for i in range(5)}
