import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from cuespark import session
from cuespark.operators import build, files, infer, jobs, rerank, routing, units
from cuespark.functions.text import ends_sentence
from cuespark.plans import stream_queries as sq, tables, workflow as wf
from cuespark.sources import results, subtitles, writers
from cuespark.sources.folders import FolderReader
from cuespark.streaming import streams

SF = "/root/testdata/sf0.001"
NAMES = {"movie_ur.srt": "ur", "Movie_EN.vtt": "en", "movie.srt": "", "movie_xx.srt": "", "my_movie.srt": "",
         "movie_tr_ur_roman.srt": "", "movie.en.srt": "en", "movie-ja.vtt": "ja", "movie ko.ass": "ko",
         "movie [es].srt": "es", "Movie (Urdu).srt": "ur", "movie_english.srt": "en", "movie.eng.srt": "en",
         "movie.fre.srt": "fr", "movie_pt-BR.srt": "pt", "movie.zh-Hans.srt": "zh", "movie-en-US.srt": "en",
         "movie.en.forced.srt": "en", "movie.en.sdh.srt": "en", "movie.forced.srt": "", "en.srt": "",
         "english.srt": "", "the-boy.srt": "", "movie 2020.srt": ""}


def test_languages_in_names(spark):
    d = spark.createDataFrame([(i, "dir/" + n) for i, n in enumerate(NAMES)], "file_id long, path string")
    got = files.split_language(d).orderBy("file_id").collect()
    assert [r.language for r in got] == list(NAMES.values())
    assert {r.path: r.base_path for r in got}["dir/movie.en.forced.srt"] == "dir/movie.srt"


def test_scan(spark, tmp_path):
    for p in ("b.SRT", "a.srt", "Sub/c.srt", "sub2/d.txt", "x.mp4"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("hello")
    got = files.scan_files(spark, [str(tmp_path)], [".srt", ".mp4"]).collect()
    assert [r.path.replace(str(tmp_path) + "/", "") for r in got] == ["a.srt", "b.SRT", "x.mp4", "Sub/c.srt"]
    assert {r.bytes for r in got} == {5}


def test_walk_of_many_folders(spark, tmp_path):
    """Links are not followed, folders that can't be read are told, every subtree is walked once whatever the split."""
    for d in range(40):
        for k in range(d % 4):
            p = tmp_path / f"root/d{d % 7}/e{d}/f{k}"
            p.mkdir(parents=True, exist_ok=True)
            (p / f"x{k}.SRT").write_text("x" * k)
            (p / "skip.txt").write_text("no")
    (tmp_path / "root/own.srt").write_text("own")
    os.symlink(tmp_path / "root/d1", tmp_path / "root/link")
    os.symlink(tmp_path / "root/own.srt", tmp_path / "root/alias.srt")
    want = sorted((str(p), p.stat().st_size) for p in (tmp_path / "root").rglob("*") if p.suffix.lower() == ".srt" and "link" not in p.parts)
    for split in (1, 6, 256):
        reader = FolderReader([str(tmp_path / "root")], split)
        rows = [r for p in reader.partitions() for r in reader.read(p) if r[0].lower().endswith(".srt")]
        assert sorted(r[:2] for r in rows) == want
    rows = files.walk_folders(spark, [str(tmp_path / "root"), f"file://{tmp_path}/missing"], ["srt"]).collect()
    assert sorted((r.path, r.bytes) for r in rows if r.error is None) == want
    assert [r.error for r in rows if r.error] == [f"Skipped {tmp_path}/missing: No such file or directory"]


def test_paths(spark):
    d = spark.createDataFrame([("/a/./b//c/../d.srt",), ("x/../../y",), ("/q",)], "path string")
    assert [r[0] for r in d.select(files.normal_path("path")).collect()] == ["/a/b/d.srt", "../y", "/q"]


def test_routes(spark):
    p = spark.createDataFrame([("en", "ur"), ("zh", "ur"), ("hi", "ur"), ("ko", "fr"), ("en", "ja")], "source string, target string")
    legs = routing.leg_table(spark)
    r = {(x.source, x.target): (x.legs, x.error) for x in routing.translation_routes(p, legs).collect()}
    assert r[("en", "ur")][0] == ["en-ur"] and r[("zh", "ur")][0] == ["zh-en", "en-ur"]
    assert r[("ko", "fr")] == (None, "no model from 'ko' to 'en'") and r[("en", "ja")][0] is None
    m = routing.models_for(routing.translation_routes(p, legs), legs).where("source = 'hi'").orderBy("position").collect()
    assert [x.model for x in m] == ["inc-en", "en-iir"]


def test_results(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"engine": "x", "chrf": 42.5, "meaning": {"mean": 0.7}}')
    (tmp_path / "b.json").write_text('{"engine": "y", "unsupported": "no"}')
    rows = {r.engine: r for r in results.load_results(spark, str(tmp_path / "*.json")).collect()}
    assert rows["x"].meaning.mean == 0.7 and rows["y"].chrf is None
    (tmp_path / "u.tsv").write_text('1\tf1\t"raw\tn\tl\t0\tMALE\n2\tf1\tagain\tn\tl\t0\tMALE\n3\tf2\tz\tn\tl\t0\tFEMALE\n')
    u = results.read_utterances(spark, str(tmp_path / "u.tsv")).orderBy("n").collect()
    assert [(r.file, r.text, r.gender) for r in u] == [("f1", '"raw', "MALE"), ("f2", "z", "FEMALE")]


@pytest.mark.parametrize("fmt", sorted(writers.WRITERS))
def test_a_track_is_one_document_whatever_its_ids(spark, fmt):
    c = spark.createDataFrame([(1, 5, 1.0, 2.0, "first words"), (1, 70000, 3.0, 4.0, "second words")],
                              'track_id int, id long, start double, `end` double, text string')
    got = writers.WRITERS[fmt](c).collect()
    assert len(got) == 1 and got[0].n_cues == 2
    name = f"a.{fmt}"
    docs = spark.createDataFrame([(name, got[0].document)], "path string, value string")
    cues, errors = subtitles.read_subtitles(docs)
    back = [(r.start, r.text) for r in cues.orderBy("id").collect()]
    assert [b[1] for b in back] == ["first words", "second words"] and errors.count() == 0


SEGMENTS = ("track_id int, id long, start double, `end` double, text string, words array<struct<word:string,start:double,`end`:double>>, "
            "language string, final boolean, at int, n_words int")


def piece(seg, at=0, upto=20, n=20, last=9, track=1):
    """Words at..upto of a segment of n."""
    w = [(f" w{seg}x{i}", seg * 60.0 + i * 0.3, seg * 60.0 + i * 0.3 + 0.2) for i in range(at, upto)]
    return (track, seg, seg * 60.0, seg * 60.0 + 5, "", w, "en", seg == last, at, n)


def streamed(spark, batches, **options):
    """The rows that each batch of segments gives, batch after batch."""
    path, known = session.fresh_path(spark, "pieces"), set()
    for i, rows in enumerate(batches, 1):
        spark.createDataFrame(rows, SEGMENTS).coalesce(1).write.mode("append").parquet(path)
        for f in set(glob.glob(f"{path}/part-*")) - known:         # the source takes files by age
            os.utime(f, (i, i))
            known.add(f)
    schema = spark.createDataFrame([], SEGMENTS).schema
    return streams.drain(streams.cue_builder_stream(streams.stream_table(spark, path, schema, 1), **options), "b", "append").orderBy("id").collect()


@pytest.fixture
def one_partition(spark):
    """Each partition of a stream's state starts Python for every batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def texts(rows):
    return " ".join(r.text for r in rows).split()


def every(*segs, n=20):
    return [f"w{s}x{i}" for s in segs for i in range(n)]


def test_segment_over_two_batches_keeps_all_words(spark, one_partition):
    got = streamed(spark, [[piece(0, 0, 8)], [piece(0, 8, 20), piece(1, last=1)]])
    assert texts(got) == every(0, 1) and [r.id for r in got] == list(range(len(got)))
    # pieces out of order, repeated, and behind a later segment
    got = streamed(spark, [[piece(1, 12, 20, last=1)], [piece(0, 8, 20), piece(1, 0, 12, last=1)], [piece(0, 8, 20)], [piece(0, 0, 8)]])
    assert texts(got) == every(0, 1)


def test_shuffled_arrival_equals_batch(spark, one_partition):
    rows = [piece(s, at, at + 10, last=7, track=t) for t in (1, 2) for s in range(8) for at in (0, 10)]
    random.Random(4).shuffle(rows)
    got = streamed(spark, [rows[i:i + 11] for i in range(0, len(rows), 11)])
    whole = spark.createDataFrame([piece(s, last=7, track=t)[:7] for t in (1, 2) for s in range(8)], SEGMENTS.split(", final")[0])
    want = build.build_cues(whole, timing=False).select("track_id", "id", "start", "end", "text").collect()
    assert sorted((r.track_id, r.id, r.start, r.end, r.text) for r in got) == sorted(map(tuple, want))


def test_late_copies_after_the_end_are_refused(spark, one_partition):
    got = streamed(spark, [[piece(0), piece(1, last=1)], [piece(0), piece(1, last=1)], [piece(2, last=2)]])
    assert texts(got) == every(0, 1)


def test_silence_gives_up_what_is_missing(spark, one_partition):
    """Segment 1 and the first words of segment 3 never come."""
    path = session.fresh_path(spark, "pieces")
    spark.createDataFrame([piece(0), piece(2), piece(3, 8, 20)], SEGMENTS).coalesce(1).write.parquet(path)
    s = streams.cue_builder_stream(streams.stream_table(spark, path, spark.createDataFrame([], SEGMENTS).schema), timeout_ms=1500, ttl_ms=3_600_000)
    q = s.writeStream.format("memory").queryName("given_up").outputMode("append").trigger(processingTime="300 milliseconds").option(
        "checkpointLocation", session.fresh_path(spark, "state")).start()
    try:
        until = time.time() + 60
        while time.time() < until and len(texts(spark.table("given_up").collect())) < 52:
            time.sleep(0.5)
    finally:
        q.stop()
    got = spark.table("given_up").orderBy("id").collect()
    assert texts(got) == every(0, 2) + every(3)[8:]
    assert [r.text.split()[0] for r in got if r.gap] == ["w2x0", "w3x8"]


def test_missing_number_is_given_up():
    state = {"next": 1, "unit": None, "len": 0, "end": 0.0, "wait": {}}
    rows = [(n, 10 * n, float(n), n + 0.9, 5, False) for n in (1, 2, 5, 4)]
    assert streams._units_step(state, rows, False) == [(10, 10), (20, 10)]
    assert streams._units_step(state, [], True) == [(40, 40), (50, 40)] and not state["wait"]


def test_infer_isolates_bad_rows(spark):
    def run(model, texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [t.upper() for t in texts]
    d = spark.createDataFrame([(0, "a"), (1, "bad"), (2, ""), (3, "c")], "i int, text string")
    got = {r.i: (r.output, r.error) for r in infer.infer(d, lambda k: k, run, model="m").collect()}
    assert got == {0: ("A", None), 1: (None, "ValueError: no"), 2: ("", None), 3: ("C", None)}


@pytest.mark.parametrize("choose", [False, True])
def test_route_asks_every_model_once(spark, tmp_path, choose):
    """Each text goes to the model of each of its legs once, whatever else the route does."""
    log = str(tmp_path / "asked")

    def ask(model, texts):
        if any("bad" in x for x in texts):
            raise ValueError("no")
        with open(log, "a") as f:
            f.writelines(f"{model}|{x}\n" for x in texts)
        return [f"{model}({x})" for x in texts]

    def options(model, texts):
        return [[x, x + "!"] for x in ask(model, texts)]

    rows = [(0, 0, "a", ["x-y"]), (0, 1, "b", ["x-y", "y-z"]), (0, 2, " ", ["x-y", "y-z"]), (0, 3, "bad", ["x-y", "y-z"]), (0, 4, "c", None),
            (0, 5, "d", ["x-y", "y-z", "z-u"]), (0, 6, None, ["x-y"])]
    df = spark.createDataFrame(rows, "track_id int, unit_id int, text string, legs array<string>").withColumn("target", F.lit("fr"))
    out = infer.infer_route(df.repartition(3), lambda k: k, ask, **({"candidates": options, "score": lambda o: o.withColumn("score", F.length("text"))} if choose else {}))
    got = {r.unit_id: (r.translated, r.error) for r in out.collect()}
    mark = "!" if choose else ""
    assert got == {0: ("x-y(a)" + mark, None), 1: ("y-z(x-y(b))" + mark, None), 2: ("", None), 3: (None, "ValueError: no"), 4: ("c", None),
                   5: (None, "the route has 1 more legs than hops"), 6: ("", None)}
    with open(log) as f:
        assert sorted(f.read().split()) == sorted(["x-y|a", "x-y|b", "y-z|x-y(b)", "x-y|d", "y-z|x-y(d)"])


def test_workflow_keeps_and_rejects_tracks(spark):
    c = tables.cues(spark, SF)
    n = c.where("language = 'fr'").count()
    src = c.withColumn("language", F.expr("if(track_id = 0, '', language)"))
    r = wf.run_workflow(src, [wf.Translate("fr", lambda u: u.withColumn("translated", F.upper("text")))])
    assert {x.track_id for x in r.errors[0].collect()} == {0}
    assert r.steps[0].join(c.where("language = 'fr'").select("track_id", "id", "text"), ["track_id", "id", "text"]).count() == n


def test_status_stream_equals_batch(spark):
    e = tables.job_events(spark, SF)
    got = streams.latest_rows(streams.drain(streams.job_status_stream(sq.staged(e, "e", 3)), "s", "update"), ["job"])
    assert sorted(map(str, got.collect())) == sorted(map(str, jobs.job_status(e).select(got.columns).collect()))


def test_unit_stream_equals_batch(spark):
    c = rerank.cue_positions(tables.cues(spark, SF).where("track_id < 4")).select(
        "track_id", "id", "number", "start", "end", F.length("text").alias("n"), ends_sentence("text").alias("ends"), "text")
    want = units.sentence_units(c).select("track_id", "id", "unit_id")
    got = streams.drain(streams.sentence_unit_stream(sq.staged(c.drop("text"), "c", 5)), "u", "append").drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("chunk", ["10", "10000"])
def test_cue_stream_equals_batch(spark, chunk):
    """Also where segments lie across Arrow chunks."""
    s = tables.segments(spark, SF).where("track_id < 30")
    last = s.groupBy("track_id").agg(F.max("id").alias("last"))
    s = s.join(last, "track_id").withColumn("final", F.col("id") == F.col("last")).drop("last")
    want = build.build_cues(s.drop("final"), timing=False).select("track_id", "id", "start", "end", "text")
    w = sq.staged(s, "s", 6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
    try:
        got = streams.drain(streams.cue_builder_stream(w), "b", "append").select("track_id", "id", "start", "end", "text").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_seen_paths_are_forgotten(spark, tmp_path, one_partition):
    """The state holds the paths of the last while only."""
    for i in range(6):
        (tmp_path / f"{i}.srt").write_text("x")
        os.utime(tmp_path / f"{i}.srt", (1_700_000_000 + i * 86_400,) * 2)
    s = streams.file_arrival_stream(spark, str(tmp_path), "*.srt", files_per_batch=1, forget="1 day")
    q = s.writeStream.format("memory").queryName("seen").option("checkpointLocation", session.fresh_path(spark, "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 6
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_file_stream(spark, tmp_path):
    for p in ("a.srt", "b/c.mp4"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    got = streams.drain(streams.file_arrival_stream(spark, str(tmp_path)), "f", "append").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.kind) for r in got) == [("a.srt", "subtitle"), ("c.mp4", "video")]


@pytest.mark.parametrize("shuffle", ["1", "16"])
def test_results_do_not_depend_on_partitions(spark, shuffle):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    base = sorted(map(tuple, units.sentence_units(tables.cues(spark, SF)).select("track_id", "id", "unit_id").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        mixed = tables.cues(spark, SF).orderBy(F.hash("id"))
        got = sorted(map(tuple, units.sentence_units(mixed).select("track_id", "id", "unit_id").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == base
