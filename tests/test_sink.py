"""The sink: names, contents, and what failures leave behind."""

import os

import pytest
from pyspark.sql import functions as F

from cuespark.plans import tables
from cuespark.sources import results, sink, subtitles, writers

SF = "/root/testdata/sf0.001"


def files_in(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)


def test_tracks_are_written_under_their_names_and_read_back(spark, tmp_path):
    cues = tables.cues(spark, SF).where("track_id < 6")
    tracks = cues.select("track_id").distinct().select("track_id", F.format_string(f"{tmp_path}/in/film %d_en.srt", "track_id").alias("path"))
    named = sink.write_tracks(cues, tracks, ["srt", "vtt", "lrc"], suffix="_ur").collect()
    n = tracks.count()
    assert len(named) == 3 * n and not any(r.error for r in named)
    assert files_in(tmp_path) == sorted(os.path.relpath(r.output, tmp_path) for r in named)
    assert {os.path.basename(r.output) for r in named if r.track_id == 0} <= {"film 0_ur.srt", "film 0_ur.vtt", "film 0_ur.lrc"}
    back, errors = subtitles.read_subtitles(subtitles.read_documents(spark, f"{tmp_path}/in/*.srt"))
    want = {r.track_id: r.n for r in cues.where("trim(text) <> ''").groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = sorted(r["n"] for r in back.groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect())
    assert got == sorted(want.values()) and errors.count() == 0
    with open(next(r.output for r in named if r.track_id == 0 and r.format == "srt"), encoding="utf-8") as f:
        assert f.read() == writers.write_srt(cues.where("track_id = 0")).first().document


def test_lines_are_short_where_words_have_no_spaces(spark):
    text = "一二三四五六七八九十一二三四五六七八九十"
    c = spark.createDataFrame([(1, 0, 1.0, 2.0, text, "ja", None), (2, 0, 1.0, 2.0, text, "en", None), (3, 0, 1.0, 2.0, text, "en", "zh"), (4, 0, 1.0, 2.0, text, None, "")],
                              "track_id int, id int, start double, `end` double, text string, language string, script string")
    lines = {r.track_id: len(r.document.strip().split("\n")) - 2 for r in writers.write_srt(c).collect()}
    assert lines == {1: 2, 2: 1, 3: 2, 4: 1}
    assert len(writers.write_srt(c.drop("language", "script").where("track_id = 1")).first().document.strip().split("\n")) == 3


def test_inputs_are_not_overwritten(spark, tmp_path):
    cues = spark.createDataFrame([(k, 0, 1.0, 2.0, "x") for k in (1, 2, 3)], "track_id int, id int, start double, `end` double, text string")
    tracks = spark.createDataFrame([(1, f"{tmp_path}/a.srt"), (2, f"{tmp_path}/b_en.srt"), (3, f"{tmp_path}/b_fr.srt")], "track_id int, path string")
    named = {(r.track_id, r.format): r.error for r in sink.write_tracks(cues, tracks, ["srt", "vtt"]).collect()}
    assert "overwrite" in named[1, "srt"] and named[1, "vtt"] is None and "Several" in named[2, "vtt"] and "Several" in named[3, "srt"]
    assert files_in(tmp_path) == ["a.vtt"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "kept.srt").write_text("old")

    def burst(x):
        if x == 7:
            raise RuntimeError("lost")
        return f"text {x}"

    rows = spark.range(0, 10, 1, 5).select(F.concat(F.lit(f"{tmp_path}/out/"), F.when(F.col("id") == 0, "kept").otherwise(F.col("id").cast("string")), F.lit(".srt")).alias("output"),
                                           F.udf(burst)("id").alias("document"))
    with pytest.raises(Exception, match="lost"):
        sink.save_files(rows, str(tmp_path / "staging"))
    assert files_in(tmp_path / "out") == ["kept.srt"] and (tmp_path / "out" / "kept.srt").read_text() == "old"
    sink.save_files(rows.where("output not like '%7.srt'"), str(tmp_path / "staging"))
    assert len(files_in(tmp_path / "out")) == 9 and (tmp_path / "out" / "kept.srt").read_text() == "text 0"


def test_two_rows_of_one_name_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/out/a.srt", "1"), (f"{tmp_path}/out/a.srt", "2")], "output string, document string").repartition(2)
    with pytest.raises(Exception, match="several rows write"):
        sink.save_files(rows, str(tmp_path / "staging"))
    assert files_in(tmp_path) == []
    sink.save_files(rows.limit(0), str(tmp_path / "staging"))
    assert files_in(tmp_path) == []


def test_results_are_stored_once(spark, tmp_path):
    """A job's rows are replaced, other jobs' rows stay, failures are left to run again."""
    path, schema = str(tmp_path / "results"), "engine string, count int, score double"

    def rows(*values):
        return spark.createDataFrame(list(values), schema + ", failure string")

    results.append_results(rows(("a", 1, 0.5, None), ("a", 1, 0.7, None), ("b", 1, None, "download failed"), (None, 2, 0.1, None)), path, ["engine", "count"])
    results.append_results(rows(("a", 1, 0.5, None), ("a", 1, 0.7, None), ("b", 1, 0.9, None)), path, ["engine", "count"])
    results.append_results(rows(("c", 3, None, "no model")), path, ["engine", "count"])
    got = sorted(map(tuple, results.stored_results(spark, path, schema).collect()), key=str)
    assert got == sorted([("a", 1, 0.5), ("a", 1, 0.7), ("b", 1, 0.9), (None, 2, 0.1)], key=str)
