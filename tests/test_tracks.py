"""Ordered operators against plain loops, with blocks so small that every boundary case occurs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuespark import constants as K
from cuespark.functions.text import ends_sentence
from cuespark.operators import build, frames as fr, layout, quality, rerank, speakers, timing, units
from cuespark.operators.ordered import ordered, runs

CUE = "track_id long, id long, start double, end double, text string, language string, speaker int"


def track(n, seed, marks=0.2, track_id=0):
    r, t, out = random.Random(seed), 0.0, []
    for i in range(n):
        words = " ".join("w" * r.randint(1, 9) for _ in range(r.randint(1, 8)))
        text = words + ("." if r.random() < marks else "")
        out.append((track_id, i * 3 + r.randint(0, 2), t, t + r.uniform(0.2, 4), text, "en", r.randint(0, 1)))
        t += r.choice([0.5, 1.0, 3.0, 3.0, 7.0])
    return out


@pytest.mark.parametrize("block", [2, 7, 65536])
def test_ordered_looks_past_block_edges(spark, block):
    rows = track(60, 1) + track(5, 2, track_id=9)
    d = ordered(spark.createDataFrame(rows, CUE), lead={"nx": F.col("start")}, lag={"pv": F.col("id")},
                sums={"before": F.col("id")}, maxs={"top": F.col("speaker")}, block=block)
    got = {(r.track_id, r.id): (r.nx, r.pv, r.before, r.top) for r in d.collect()}
    for tr in (0, 9):
        own = [x for x in rows if x[0] == tr]
        for i, x in enumerate(own):
            assert got[(tr, x[1])] == (
                own[i + 1][2] if i + 1 < len(own) else None, own[i - 1][1] if i else None,
                sum(y[1] for y in own[:i]), max((y[6] for y in own[:i]), default=None))


@pytest.mark.parametrize("block", [2, 5, 65536])
def test_runs(spark, block):
    rows = track(80, 3)
    d = runs(spark.createDataFrame(rows, CUE), {"s": F.col("speaker")}, lambda p, c: p("s") != c("s"), "run", block=block)
    got = {r.id: r.run for r in d.collect()}
    first = None
    for i, x in enumerate(rows):
        if i == 0 or x[6] != rows[i - 1][6]:
            first = x[1]
        assert got[x[1]] == first


@pytest.mark.parametrize("block, marks, limit", [(3, 0.2, 300), (4, 0.0, 300), (9, 0.0, 60), (65536, 0.05, 120), (2, 0.02, 40)])
def test_sentence_units_match_a_loop(spark, block, marks, limit):
    rows = track(150, 5, marks)
    df = spark.createDataFrame(rows, CUE)
    ends = {r.id: r.e for r in df.select("id", ends_sentence("text").alias("e")).collect()}
    got = {r.id: r.unit_id for r in units.sentence_units(df, max_chars=limit, block=block).collect()}
    unit, used, last = None, 0, None
    for x in rows:
        if unit is not None and (x[2] - last > K.UNIT_MAX_GAP_SECONDS or used + len(x[4]) > limit):
            unit = None
        if unit is None:
            unit, used = x[1], 0
        assert got[x[1]] == unit
        used, last = used + len(x[4]) + 1, x[3]
        if ends[x[1]]:
            unit = None


def test_timing(spark):
    cases = [([(0.0, 3.0, "a b c"), (2.0, 4.0, "d")], lambda e: e[0] == 2.0),
             ([(0.0, 0.4, "A reasonably long line to read")], lambda e: e[0] > 1.5),
             ([(0.0, 0.4, "A reasonably long line to read"), (0.9, 2.0, "next")], lambda e: e[0] == 0.9),
             ([(5.0, 4.0, "x")], lambda e: e[0] >= 5.0)]
    rows = [(i, j, a, b, t) for i, (cs, _) in enumerate(cases) for j, (a, b, t) in enumerate(cs)]
    out = timing.finalize_timing(spark.createDataFrame(rows, "track_id long, id long, start double, end double, text string"))
    ends = {}
    for r in out.orderBy("track_id", "id").collect():
        ends.setdefault(r.track_id, []).append(r.end)
    assert all(check(ends[i]) for i, (_, check) in enumerate(cases))


def test_spread(spark):
    cues = [(0, 4, 0.0, 2.0, "I went to the market", "en", 0), (0, 5, 2.0, 3.0, "with my friend.", "en", 0),
            (1, 0, 0.0, 1.0, "Yes", "en", 0), (1, 1, 1.0, 2.0, "indeed", "en", 0), (1, 2, 2.0, 3.0, "absolutely", "en", 0)]
    u = units.join_units(units.sentence_units(spark.createDataFrame(cues, CUE)))
    u = u.withColumn("translated", F.expr("if(track_id = 0, 'fui al mercado con mi amigo.', 'Sí')"))
    rows = sorted(units.spread_translation(u, "es").collect(), key=lambda r: (r.track_id, r.id))
    a, b = [r for r in rows if r.track_id == 0], [r for r in rows if r.track_id == 1]
    assert [r.id for r in a] == [4, 5] and a[0].start == 0.0 and a[1].end == 3.0
    assert " ".join(r.translated for r in a) == "fui al mercado con mi amigo."
    assert [(r.translated, r.start, r.end) for r in b] == [("Sí", 0.0, 3.0)]


# --- building cues --------------------------------------------------------------------------------

SEG = ("track_id long, id long, start double, end double, text string, "
       "words array<struct<word:string,start:double,end:double>>, language string")


def words(text, start=0.0, step=0.3, gaps=None):
    t, out = start, []
    for i, w in enumerate(text.split()):
        t += (gaps or {}).get(i, 0.0)
        out.append((f" {w}", t, t + step * 0.9))
        t += step
    return out


def built(spark, segments, layout=build.Layout(), **kw):
    rows = [(0, i, s[1][0][1] if s[1] else 2.0, s[1][-1][2] if s[1] else 5.0, s[0], s[1], "en") for i, s in enumerate(segments)]
    return [r.text for r in build.build_cues(spark.createDataFrame(rows, SEG), layout, **kw).orderBy("id").collect()]


def test_build_literals(spark):
    text = "Welcome to the show. Today we are going to talk about how subtitles are made on your own computer"
    assert built(spark, [("", words(text))])[0] == "Welcome to the show."
    text = "Then a speech recognition model listens to every word and writes it down with precise timestamps."
    assert built(spark, [("", words(text))]) == [
        "Then a speech recognition model listens to every word", "and writes it down with precise timestamps."]
    assert built(spark, [("", words("before the pause after the pause", gaps={3: 2.0}))]) == ["before the pause", "after the pause"]
    assert built(spark, [("", words("Subtitles made on your")), ("", words("own computer, without uploads.", 1.2))]) == [
        "Subtitles made on your own computer, without uploads."]
    assert built(spark, [("", words("and then")), ("", words("much later.", 5.0))]) == ["and then", "much later."]
    assert built(spark, [("  No words here ", []), ("   ", [])]) == ["No words here"]
    text = "This is the first sentence here. And this second one keeps going for quite a while longer"
    assert built(spark, [("", words(text))], build.Layout(line=30))[0] == "This is the first sentence here."
    assert len(built(spark, [("", words("one two three four five six", step=1.0))], build.Layout(max_duration=3.0))) == 2


def test_build_in_stretches_equals_one_pass(spark):
    r = random.Random(8)
    segs, t = [], 0.0
    for i in range(60):
        toks = " ".join("x" * r.randint(1, 8) + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(1, 14)))
        ws = words(toks, t, gaps={r.randint(0, 5): r.choice([0, 0, 1.0])}) if r.random() > 0.1 else []
        t = (ws[-1][2] if ws else t + 1) + r.choice([0.0, 0.1, 1.5])
        segs.append((0, i, t, t + 1, toks, ws, "en"))
    df = spark.createDataFrame(segs, SEG)
    got = [(c.start, c.text) for c in build.build_cues(df, timing=False, block=2).orderBy("id").collect()]
    want, b = [], build.Builder(build.Layout())
    for _, i, start, end, text, ws, lang in segs:
        want += b.add(i * build.SEGMENT_SPAN, *map(list, zip(*ws)), lang) if ws else b.alone(i * build.SEGMENT_SPAN, start, end, text, lang)
    want += b.flush()
    assert got == [(c[1], c[3]) for c in want if c[3]]


# --- speech ----------------------------------------------------------------------------------------

def place(lines, rate, top):
    """The layout rules as one loop over a whole track."""
    written, out = 0, []
    for line, start, slot_end, samples, media in lines:
        media = None if media is None else round(media * 48000)
        s = max(round(start * 48000), written)
        if media is not None and s >= media:
            out.append((line, 0, True))
            continue
        slot = max(round(slot_end * 48000) - s, 1)
        room = slot + 48000
        if media is not None:
            room = min(room, media - s)
            slot = min(slot, room)
        size = max(1, round(samples * 48000 / rate))
        if size > slot and top > 1.0:
            size = max(1, round(int(samples / min(size / slot, top)) * 48000 / rate))
        out.append((line, s, size > room))
        written = s + min(size, room)
    return out


@pytest.mark.parametrize("seed, dense", [(1, 1.0), (2, 2.5), (3, 0.4)])
def test_layout_matches_a_loop(spark, seed, dense):
    r, t, lines = random.Random(seed), 0.0, []
    for i in range(120):
        lines.append([i, t, 0.0, int(r.uniform(0.2, 3) * dense * 24000), 170.0])
        t += r.choice([0.3, 1.0, 2.0, 5.0])
    for a, b in zip(lines, lines[1:]):
        a[2] = b[1]
    lines[-1][2] = t
    df = spark.createDataFrame([(0, *x) for x in lines], "track_id long, line_no long, start double, slot_end double, samples long, media_end double")
    got = sorted((x.line_no, x.start_frame if x.spoken else 0, x.trimmed) for x in layout.layout_track(df).collect())
    assert got == place(lines, 24000, K.MAX_SPEEDUP)


def test_layout_literals(spark):
    def lay(rows, top=1.35):
        d = spark.createDataFrame([(0, i, s, e, int(n * 0.1 * 24000), m) for i, (s, e, n, m) in enumerate(rows)],
                                  "track_id long, line_no long, start double, slot_end double, samples long, media_end double")
        return layout.layout_track(d, max_speedup=top).orderBy("line_no").collect()
    [a] = lay([(1.0, 3.0, 3, None)])
    assert (a.start_frame, a.n_frames, a.speed) == (48000, int(0.3 * 48000), 1.0)
    assert lay([(0.0, 1.0, 12, None), (1.0, 3.0, 2, None)])[0].speed == pytest.approx(1.2)
    assert lay([(0.0, 1.0, 30, None), (1.0, 3.0, 2, None)])[0].trimmed
    b = lay([(0.0, 0.2, 4, None), (0.2, 3.0, 2, None)], 1.0)
    assert not b[0].trimmed and b[1].start_frame == int(0.4 * 48000)
    c = lay([(0.0, 2.0, 2, 2.0), (3.0, 5.0, 2, 2.0)])
    assert c[1].trimmed and not c[1].spoken


def voices(spark, spans, vecs):
    rows = [(0, i, float(a), float(b), vecs[v]) for i, ((a, b), v) in enumerate(spans)]
    return spark.createDataFrame(rows, "track_id long, id long, start double, end double, vector array<double>")


@pytest.mark.parametrize("spans, most, want", [
    ([((0, 2), 1), ((2, 4), 2), ((4, 6), 1), ((6, 8), 2), ((8, 10), 1), ((10, 12), 2)], 6, [0, 1, 0, 1, 0, 1]),
    ([((0, 3), 1), ((3, 6), 1), ((6, 9), 1)], 6, [0, 0, 0]),
    ([((0, 3), 1), ((3, 3.5), 2), ((10, 13), 2), ((13, 17), 2), ((17, 19), 1)], 6, [0, 0, 1, 1, 0]),
    ([((0, 3), 1), ((3, 6), 1), ((6, 7.5), 2), ((7.5, 11), 1)], 6, [0, 0, 0, 0]),
    ([((0, 5), 1), ((5, 10), 2), ((10, 12), 3), ((12, 17), 2)], 6, [0, 1, 0, 1]),
])
def test_assign_speakers(spark, spans, most, want):
    vecs = {1: [1.0, 0.0, 0.0], 2: [0.0, 1.0, 0.0], 3: [0.45, 0.0, 0.89]}
    got = speakers.assign_speakers(voices(spark, spans, vecs), most).orderBy("id").collect()
    assert [r.speaker for r in got] == want


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    data = {"a": rng.exponential(size=5000), "b": np.repeat([1.0, 2.0, 5.0], [4000, 3, 1]), "c": np.array([7.0]),
            "d": rng.integers(0, 5, 37).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    qs = {"lo": 0.01, "mid": 0.5, "hi": 0.9, "top": 1.0}
    for r in quality.exact_quantiles(df, ["k"], "v", qs).collect():
        assert [r[n] for n in qs] == pytest.approx([np.quantile(data[r.k], q) for q in qs.values()])


@pytest.mark.parametrize("least, step", [(3, 1), (5, 2), (4, 3)])
def test_silence_matches_a_loop(spark, monkeypatch, least, step):
    monkeypatch.setattr(fr, "BLOCK_MS", 8)
    rng = np.random.default_rng(least)
    power = rng.choice([1.0, 1.0, 1.0, 400.0], 101)
    df = spark.createDataFrame([(0, i, float(p), 1) for i, p in enumerate(power)], "track_id long, ms long, sumsq double, n int")
    starts = list(range(0, 101 - least + 1, step))
    starts += [101 - least] if (101 - least) % step else []
    quiet = [s for s in starts if np.sqrt(power[s:s + least].mean()) <= 8.0]
    want = []
    for s in quiet:
        if want and (s == want[-1][2] + step or s <= want[-1][2] + least):
            want[-1][1:] = [s + least, s]
        else:
            want.append([s, s + least, s])
    got = sorted((r.start, r.end) for r in fr.silence_ranges(df, least, 8.0, step).collect())
    assert got == [(a, b) for a, b, _ in want]


def ranges_by_loop(power, least, step, limit, end):
    """Silences and sounds of one track; `power` holds the frames there are."""
    starts = sorted({*range(0, end - least + 1, step), *([end - least] if end >= least else [])})
    runs = []
    for s in starts:
        there = [power[k] for k in range(s, s + least) if k in power]
        if there and np.sqrt(np.mean(there)) > limit:
            continue
        if runs and (s == runs[-1][1] + step or s <= runs[-1][1] + least):
            runs[-1][1] = s
        else:
            runs.append([s, s])
    silent = [(a, b + least) for a, b in runs]
    edges = [0, *[x for r in silent for x in r], end]
    return silent, [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]


@pytest.mark.parametrize("least, step, block", [(3, 1, 8), (4, 3, 8), (11, 2, 8), (5, 4, 16), (3, 1, 65536)])
def test_silence_and_sound_of_many_tracks(spark, monkeypatch, least, step, block):
    """Loud, quiet and mixed tracks, some with missing frames, in blocks shorter than a window too."""
    monkeypatch.setattr(fr, "BLOCK_MS", block)
    rng = np.random.default_rng(least + step)
    tracks = {k: {i: float(p) for i, p in enumerate(rng.choice([1.0, 0.1 * k, 400.0], 40 + k, p=[.7, .2, .1])) if k % 3 or i == 0 or rng.random() > .05} for k in range(12)}
    tracks |= {20: dict.fromkeys(range(50), 1.0), 21: dict.fromkeys(range(50), 900.0), 22: {0: 1.0}, 23: {0: 900.0}}
    df = spark.createDataFrame([(t, i, p, 1) for t, of in tracks.items() for i, p in of.items()], "track_id long, ms long, sumsq double, n int")
    silent = {(r.track_id, r.start, r.end) for r in fr.silence_ranges(df, least, 8.0, step).collect()}
    sounds = fr.sounding_ranges(df, least, 8.0, step, silent_tracks=True)
    heard = [(r.track_id, r.start, r.end) for r in sounds.where("start is not null").collect()]
    want = {t: ranges_by_loop(of, least, step, 8.0, max(of) + 1) for t, of in tracks.items()}
    assert silent == {(t, *x) for t, w in want.items() for x in w[0]}
    assert sorted(heard) == sorted((t, *x) for t, w in want.items() for x in w[1])
    assert {r.track_id for r in sounds.where("start is null").collect()} == {t for t, w in want.items() if not w[1]}
    assert {r.track_id for r in fr.split_point(sounds, None, 20, 5, 10).collect()} == set(tracks)


def test_frames_are_read_once(spark, tmp_path):
    spark.range(200).selectExpr("0L as track_id", "id as ms", "double(id % 7) as sumsq", "1 as n").write.parquet(str(tmp_path / "f"))
    f = spark.read.parquet(str(tmp_path / "f"))

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count("FileScan")

    assert scans(fr.silence_ranges(f, 3, 2.0)) == scans(fr.sounding_ranges(f, 3, 2.0)) == 1
    assert scans(fr.split_point(fr.sounding_ranges(f, 3, 2.0, silent_tracks=True))) == 1
    assert scans(fr.trim_edges(f, 2.0)) <= 3


@pytest.mark.parametrize("n, most", [(1, 6), (2, 1), (40, 6), (41, 1), (60, 100)])
def test_merging_is_average_linkage(n, most):
    """Against the mean over all pairs of members, looked up anew before every merge."""
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 5)) + 2 * rng.normal(size=(4, 5))[rng.integers(4, size=n)]
    v[n // 2:] = v[:n - n // 2] if n % 2 else v[n // 2:]              # ties
    v /= np.linalg.norm(v, axis=1)[:, None]
    groups = [[i] for i in range(n)]
    while len(groups) > 1:
        pairs = [(round(-float(np.mean(v[a] @ v[b].T)), 9), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        s, i, j = min(pairs)
        if len(groups) <= most and -s < 0.5:
            break
        groups[i] += groups.pop(j)
    want = np.empty(n, int)
    for k, g in enumerate(groups):
        want[g] = k
    assert (speakers.merge_most_similar(v, most) == want).all()


def test_line_errors(spark):
    rows = [("میرا نام ابھیشیک ہے", "میرا نام Abhishek ہے", "ur"), ("یہاں تر نتا مدس", "میرا نام Abhishek ہے اور خوش آمدید", "ur"),
            ("ایم ایل آپس", "ML Ops", "ur"), ("یہاں تر نتا", "بھی جوڑے ہیں", "ur"),
            ("hello there and then some more words", "hello there", "en"), ("hello world", "Hello, World!", "en"), ("", "abc", "en")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, hyp string, ref string, language string")
    e = [r.line_error for r in quality.line_errors(d).orderBy("i").collect()]
    assert e[0] == 0.0 and e[1] >= 0.5 and e[2] == 0.0 and e[3] >= 0.5 and e[4] >= 0.5 and e[5] == 0.0 and e[6] == 1.0


def test_penalties(spark):
    rows = [("Good links", "Good links", "ur"), ("Good links", "Bons liens", "fr"),
            ("Open our GitHub page", "ہمارا صفحہ کھولیں", "ur"), ("A long sentence about many things", "ہاں", "ur")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, o string, t string")
    p = [r[0] for r in d.orderBy("i").select(rerank.penalty("s", "o", "t")).collect()]
    assert p[0] >= 0.3 and p[1] == 0 and p[2] == pytest.approx(0.05) and p[3] >= 0.15


def test_choose_candidate(spark):
    def pick(scores, **kw):
        d = spark.createDataFrame([(0, "ur", i, "a" * 20, x, s) for i, (x, s) in enumerate(scores)],
                                  "sentence_id long, target string, cand_ix int, source_text string, text string, score double")
        return rerank.choose_candidate(d, **kw).first().text[0]
    assert pick([("b" * 40, 0.90), ("c" * 18, 0.88)]) == "b"
    assert pick([("b" * 40, 0.90), ("c" * 18, 0.88)], spoken_from="en") == "c"
    assert pick([("b" * 40, 0.90), ("c" * 18, 0.70)], spoken_from="en") == "b"


def test_guard_runaway(spark):
    def guard(*sizes):
        d = spark.createDataFrame([(0, 0, i, int(s * 24000), 13) for i, s in enumerate(sizes)],
                                  "track_id long, line_no long, attempt int, n_samples long, n_chars int")
        return rerank.guard_runaway(d).first()
    assert (guard(1.2).attempt, guard(1.2).ran_on) == (0, False)
    assert (guard(6.0, 1.3).attempt, guard(6.0, 1.3).ran_on) == (1, False)
    r = guard(7.0, 5.0, 6.0)
    assert r.attempt == 1 and r.ran_on and 24000 <= r.kept_samples <= 1.8 * 24000


def test_tracks_may_have_names(spark):
    rows = [("movie.srt", *x[1:]) for x in track(40, 4, 0.0)]
    df = spark.createDataFrame(rows, CUE.replace("track_id long", "track_id string"))
    u = units.sentence_units(df, max_chars=50, block=6)
    assert {r.track_id for r in u.collect()} == {"movie.srt"}
    lines = units.slot_ends(units.spoken_lines(u)).withColumn("samples", F.lit(30000)).withColumnRenamed("line_id", "line_no")
    assert layout.layout_track(lines).where("track_id = 'movie.srt'").count() == lines.count()
    segs = [("a.mp4", 0, 0.0, 1.0, "", words("Hello there. And more"), "en")]
    built = build.build_cues(spark.createDataFrame(segs, SEG.replace("track_id long", "track_id string")))
    assert [r.track_id for r in built.collect()] == ["a.mp4"]
