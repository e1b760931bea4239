"""Queries on speakers, spoken lines, signal frames and cue building."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import weights as wt
from ..operators import build, frames as fr, layout, prompts, speakers as sp, units
from ..operators.ordered import ordered
from ..operators.rerank import unit_vector
from ..session import settle
from . import tables as t
from .registry import query

ELIGIBLE = """, el as (select * from d2 where "end" - "start" >= 1.0 qualify row_number() over (partition by track_id order by "end" - "start" desc, id) <= 300),
lb as (select track_id, id, "start", "end", start_ms, end_ms, voice as label, list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))) as u from el)
"""


def labelled(spark, sf):
    """Eligible cues labelled by their true voice: the input of the steps after clustering."""
    e = sp.eligible_cues(t.vectors(spark, sf))
    return e.select("track_id", "id", "start", "end", "start_ms", "end_ms", F.col("voice").cast("bigint").alias("label"), unit_vector("vector").alias("unit"))


@query("eligible_cues", needs=("d2",), sql=ELIGIBLE + "select track_id, id, label from lb")
def q_eligible(spark, sf):
    return sp.eligible_cues(t.vectors(spark, sf)).select("track_id", "id", F.col("voice").alias("label"))


@query("cluster_vectors")
def q_cluster(spark, sf):
    e = sp.eligible_cues(t.vectors(spark, sf)).withColumn("unit", unit_vector("vector"))
    return sp.cluster_vectors(e)


@query("speaker_totals", needs=("d2",), sql=ELIGIBLE + """
select track_id, label, round(sum("end" - "start"), 6) as seconds, round(sum("end" - "start"), 6) < 4.0 as small from lb group by all""")
def q_totals(spark, sf):
    return sp.speaker_totals(labelled(spark, sf)).select("track_id", "label", F.round("seconds", 6).alias("seconds"), "small")


CENTROIDS = ELIGIBLE + """, big as (select track_id, label from lb group by all having sum(end_ms - start_ms) >= 4000),
dm as (select track_id, label, i, avg(u[i]) as x from lb, (select unnest(range(1, 65)) as i) r group by all),
ce as (select track_id, label, list(x order by i) as v from dm group by all),
cn as (select track_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as c from ce)
"""


@query("speaker_centroids", needs=("d2",), sql=CENTROIDS + """
select track_id, label, i, round(c[i], 6) as x from cn, (select unnest(range(1, 65)) as i) r""")
def q_centroids(spark, sf):
    c = sp.speaker_centroids(labelled(spark, sf))
    return c.select("track_id", "label", F.posexplode("centroid").alias("i", "x")).select(
        "track_id", "label", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


ABSORBED = CENTROIDS + """, sc as (select a.track_id, a.id, c.label, list_dot_product(a.u, c.c) as s from lb a join cn c using (track_id) semi join big b on b.track_id = c.track_id and b.label = c.label),
mx as (select track_id, id, arg_max(label, (s, -label)) as near from sc group by all),
ab as (select a.track_id, a.id, a."start", a."end", case when b.label is not null then a.label else coalesce(m.near, 0) end as label
  from lb a left join big b using (track_id, label) left join mx m using (track_id, id))
"""


@query("absorb_small", needs=("d2",), sql=ABSORBED + "select track_id, id, label from ab")
def q_absorb(spark, sf):
    return sp.absorb_small(labelled(spark, sf)).select("track_id", "id", "label")


NEAREST = ELIGIBLE + """, nr as (select a.track_id, a.id, arg_min(b.label, (case when a.id = b.id then -1.0 else abs((b."start" + b."end") / 2 - (a."start" + a."end") / 2) end, b.id)) as label
  from d2 a join lb b using (track_id) group by all)
"""


@query("nearest_speaker", needs=("d2",), sql=NEAREST + "select track_id, id, label from nr")
def q_nearest(spark, sf):
    return sp.nearest_speaker(t.vectors(spark, sf).select("track_id", "id", "start", "end"), labelled(spark, sf)).select("track_id", "id", "label")


@query("renumber_speakers", needs=("d2",), sql="""
, f as (select track_id, voice, min(id) as first from d2 group by all), r as (select *, dense_rank() over (partition by track_id order by first) - 1 as speaker from f)
select track_id, id, speaker from d2 join r using (track_id, voice)""")
def q_renumber(spark, sf):
    return sp.renumber_speakers(t.vectors(spark, sf).select("track_id", "id", "voice"), "voice").select("track_id", "id", "speaker")


@query("assign_speakers")
def q_assign(spark, sf):
    return sp.assign_speakers(t.vectors(spark, sf))


# --- spoken lines ------------------------------------------------------------------------------

def lines(spark, sf):
    u = settle(units.sentence_units(t.cues(spark, sf)), "units")
    l = settle(units.spoken_lines(u), "lines")
    l = units.slot_ends(l, 600.0)
    return l.select("track_id", F.col("line_id").alias("line_no"), "start", "slot_end",
                    (F.length("text") * 1560).alias("samples"), F.lit(600.0).alias("media_end"))


@query("layout_track")
def q_layout(spark, sf):
    return layout.layout_track(lines(spark, sf))


@query("fit_speed", needs=("d6",), sql="""
, x as (select *, greatest(n_samples * 2 % 400000, 1)::double as slot, case when line_no % 3 = 0 then null else n_chars * 0.05::double end as planned from d6),
f as (select *, case when planned is not null then least(greatest(planned * 48000.0::double / slot, 1.0), 1.35::double) else 1.0::double end as f1 from x),
s as (select *, round_even(n_samples * 2 / f1, 0) as size from f)
select track_id, line_no, attempt, round(case when size > slot and 1.35::double > f1 then least(f1 * size / slot, 1.35::double) else f1 end, 9) as speed from s""")
def q_speed(spark, sf):
    d = t.takes(spark, sf).withColumn("slot", F.expr("cast(greatest(n_samples * 2 % 400000, 1) as double)")).withColumn(
        "planned", F.expr("if(line_no % 3 = 0, null, n_chars * 0.05D)"))
    return d.select("track_id", "line_no", "attempt", F.round(
        layout.fit_speed(F.col("planned"), F.col("n_samples") * 2, F.col("slot")), 9).alias("speed"))


BLOCK_SQL = ", bl as (select * from (values " + ", ".join(
    f"({a}, {b}, {w}::double)" for a, b, w in [
        (0 if i == 0 else K.WEIGHT_BLOCKS[i - 1][0] + 1, last, K.WEIGHTS[kind]) for i, (last, kind) in enumerate(K.WEIGHT_BLOCKS)]) + ") v(a, b, w))"
WEIGHT_SQL = BLOCK_SQL + r"""
, ch as (select track_id, id, unnest(string_split(text, '')) as ch from d0),
dc as (select distinct ch from ch where ch <> ''),
cw as (select ch, coalesce(case when regexp_matches(ch, '^[A-Za-z]$') then 1.0::double when ch = ' ' then 0.2::double when ch = 'ـ' then 0.0::double when regexp_matches(ch, '^\p{M}$') then 0.0::double
  when regexp_matches(ch, '^[\p{P}\p{S}]$') then 0.5::double when regexp_matches(ch, '^\p{Z}$') then 0.2::double when regexp_matches(ch, '^\p{N}$') then 3.5::double end, w, 1.0) as weight
  from dc left join bl on unicode(ch) between a and b),
tw as (select track_id, id, coalesce(sum(weight), 0.0) as weight from ch left join cw using (ch) group by all)
"""


@query("char_weights", needs=("d0",), sql=WEIGHT_SQL + "select ch, weight from cw")
def q_chars(spark, sf):
    c = t.cues(spark, sf).select(F.explode(F.filter(F.split("text", ""), lambda x: x != "")).alias("ch"))
    return wt.char_weights(c)


@query("text_weight", needs=("d0",), sql=WEIGHT_SQL + "select track_id, id, round(weight, 6) as weight from tw")
def q_weight(spark, sf):
    return wt.text_weights(t.cues(spark, sf), ["track_id", "id"]).select("track_id", "id", F.round("weight", 6).alias("weight"))


@query("estimate_duration", needs=("d0",), sql=WEIGHT_SQL + """
, e as (select track_id, id, round(weight, 6) / (12.7::double / 25) as p from tw)
select track_id, id, cast(greatest(1, floor(case when p < 50.0::double then 50.0::double * pow(p / 50.0::double, 1.0::double / 3.0::double) else p end)) as bigint) as tokens
from e""")
def q_duration(spark, sf):
    w = wt.text_weights(t.cues(spark, sf), ["track_id", "id"])
    tokens = wt.estimate_duration(F.round("weight", 6), F.lit(12.7), F.lit(25.0), F.lit(1.0))
    return w.select("track_id", "id", tokens.alias("tokens"))


# --- building cues -----------------------------------------------------------------------------------

@query("build_cues")
def q_build(spark, sf):
    return build.build_cues(t.segments(spark, sf))


@query("voice_prompt")
def q_prompt(spark, sf):
    w = t.words(spark, sf)
    w = w.select("track_id", F.expr("i div 600").alias("speaker"), F.expr("(i % 600) div 12").alias("clip_no"),
                 (((F.col("i") % 12) * 300) / 1000.0).alias("start"), (((F.col("i") % 12) * 300 + 270) / 1000.0).alias("end"),
                 F.lit(3.6).alias("clip_seconds"), "word")
    return prompts.voice_prompt(w)


# --- frames -------------------------------------------------------------------------------------------

RMS = """, ln as (select track_id, max(ms) + 1 as length from d4 group by all),
wr as (select track_id, ms, sqrt(sum(sumsq) over w / 3) as rms, count(*) over w as c from d4 window w as (partition by track_id order by ms rows between current row and 2 following)),
st as (select track_id, ms from wr where c = 3 and rms <= 30),
br as (select *, case when lag(ms) over w is null or (ms <> lag(ms) over w + 1 and ms > lag(ms) over w + 3) then 1 else 0 end as b from st window w as (partition by track_id order by ms)),
ig as (select *, sum(b) over (partition by track_id order by ms) as g from br),
sl as (select track_id, min(ms) as "start", max(ms) + 3 as "end" from ig group by track_id, g),
hd as (select track_id, coalesce(lag("end") over (partition by track_id order by "start"), 0) as s, "start" as e, lag("end") over (partition by track_id order by "start") is null as first from sl),
la as (select track_id, max("end") as last from sl group by all),
ns as (select track_id, s as "start", e as "end" from hd where not (first and e = 0)
  union all select ln.track_id, coalesce(last, 0), length from ln left join la using (track_id) where last is null or last <> length)
"""


def sounding(spark, sf):
    return fr.sounding_ranges(t.frames(spark, sf), 3, 30.0)


@query("frame_energy", sql="""
, x as (select user_id as track_id, row_number() over (partition by user_id order by event_id) - 1 as i, value / 400.0 as x from events),
k as (select unnest(generate_series(0, (select max(i) // 16 from x))) as ms)
select track_id, ms, round(sum(pow(least(greatest(x * 32768.0, -32768.0), 32767.0), 2)), 3) as sumsq, count(*) as n
from x join k on i >= ms * 16000 // 1000 and i < (ms + 1) * 16000 // 1000
group by track_id, ms having count(*) >= (ms + 1) * 16000 // 1000 - ms * 16000 // 1000""".replace(", x as", "with x as", 1))
def q_energy(spark, sf):
    e = t.read(spark, sf, "events").select(F.col("user_id").alias("track_id"), "event_id", (F.col("value") / 400.0).alias("x"))
    s = ordered(e, sums={"i": F.lit(1).cast("bigint")}, order="event_id")       # samples of a track are consecutive
    return fr.frame_energy(s).select("track_id", "ms", F.round("sumsq", 3).alias("sumsq"), "n")


@query("silence_ranges", needs=("d4",), sql=RMS + 'select track_id, "start", "end" from sl')
def q_silence(spark, sf):
    return fr.silence_ranges(t.frames(spark, sf), 3, 30.0, 1)


@query("silence_ranges_stepped", needs=("d4",), sql="""
, ln as (select track_id, max(ms) + 1 as length from d4 group by all),
wr as (select track_id, ms, sqrt(sum(sumsq) over w / 5) as rms, count(*) over w as c from d4 window w as (partition by track_id order by ms rows between current row and 4 following)),
st as (select track_id, ms from wr join ln using (track_id) where c = 5 and rms <= 40 and (ms % 2 = 0 or ms = length - 5)),
br as (select *, case when lag(ms) over w is null or (ms <> lag(ms) over w + 2 and ms > lag(ms) over w + 5) then 1 else 0 end as b from st window w as (partition by track_id order by ms)),
ig as (select *, sum(b) over (partition by track_id order by ms) as g from br)
select track_id, min(ms) as "start", max(ms) + 5 as "end" from ig group by track_id, g""")
def q_silence2(spark, sf):
    return fr.silence_ranges(t.frames(spark, sf), 5, 40.0, 2)


@query("nonsilent_ranges", needs=("d4",), sql=RMS + 'select track_id, "start", "end" from ns')
def q_nonsilent(spark, sf):
    return sounding(spark, sf).drop("length")


@query("keep_ranges", needs=("d4",), sql=RMS + """, k as (select track_id, "start" - 2 as s, "end" + 2 as e, lag("end" + 2) over w as pe, lead("start" - 2) over w as nx from ns window w as (partition by track_id order by "start"))
select track_id, greatest(case when pe > s then (pe + s) // 2 else s end, 0) as "start", least(case when nx < e then (e + nx) // 2 else e end, length) as "end"
from k join (select track_id, max(ms) + 1 as length from d4 group by all) using (track_id)""")
def q_keep(spark, sf):
    return fr.keep_ranges(settle(sounding(spark, sf), "ranges"), 2)


@query("trim_edges", needs=("d4",), sql="""
, ln as (select track_id, max(ms) + 1 as length from d4 group by all),
c1 as (select track_id, ms // 5 as c, sqrt(sum(sumsq) / count(*)) as rms from d4 group by all),
q1 as (select track_id, least(coalesce(min(c * 5) filter (rms >= 35), any_value(length)), any_value(length)) as quiet, any_value(length) as length from c1 join ln using (track_id) group by track_id),
s1 as (select track_id, greatest(quiet - 3, 0) as s, length from q1),
c2 as (select track_id, (length - 1 - ms) // 5 as c, sqrt(sum(sumsq) / count(*)) as rms, any_value(length - s) as len from d4 join s1 using (track_id) where ms >= s group by all),
q2 as (select track_id, least(coalesce(min(c * 5) filter (rms >= 35), any_value(len)), any_value(len)) as quiet from c2 group by track_id)
select s1.track_id, s as "start", length - greatest(coalesce(quiet, 0) - 4, 0) as "end" from s1 left join q2 using (track_id)""")
def q_trim(spark, sf):
    return fr.trim_edges(t.frames(spark, sf), 35.0, 3, 4, 5)


@query("split_point", needs=("d4",), sql=RMS + """, lt as (select track_id, min("start") as stop from ns where "end" > 40 group by all),
b as (select ns.track_id, max("start") filter ("start" <= 40 and "start" <= coalesce(stop, 1000000)) as best from ns left join lt using (track_id) group by all)
select ln.track_id, case when length <= 20 or b.track_id is null then length when coalesce(best, 0) < 5 then least(40, length) else best end as cut from ln left join b using (track_id)""")
def q_split(spark, sf):
    return fr.split_point(fr.sounding_ranges(t.frames(spark, sf), 3, 30.0, silent_tracks=True), None, 40, 5, 20)


@query("loud_span", needs=("d4",), sql="""
, c as (select track_id, ms // 4 as f, 20 * log10(sqrt(sum(sumsq) / count(*)) + 1e-9) as level, count(*) as w from d4 group by all having count(*) = 4),
l as (select *, max(level) over (partition by track_id) as top, count(*) over (partition by track_id) as n from c)
select track_id, greatest(min(f) - 2, 0) * 4 as "start", least(any_value(n), max(f) + 3) * 4 as "end" from l where level > top - 6 group by track_id""")
def q_loud(spark, sf):
    return fr.loud_span(t.frames(spark, sf), 6.0, 4)


CUT = """, cu as (select distinct user_id as track_id, k as id, (k * 7 + user_id % 5) / 1000.0::double as "start", (k * 7 + user_id % 5 + 6 + k % 12) / 1000.0::double as "end" from (select user_id, unnest(generate_series(0, (count(*) - 1) // 7)) as k from events group by user_id)),
cf as (select d4.track_id, id, ms, sumsq, n from d4 join cu on cu.track_id = d4.track_id and ms >= greatest(0, trunc(("start" - 0.002::double) * 1000)::bigint) and ms < greatest(0, trunc(("end" + 0.002::double) * 1000)::bigint)),
cs as (select track_id, id, sum(n)::bigint as n_samples, sum(n) * sqrt(sum(sumsq) / sum(n)) as score from cf group by all)
"""


def frame_cues(spark, sf):
    """A cue every 7 ms over the whole of each track."""
    u = t.read(spark, sf, "events").groupBy(F.col("user_id").alias("track_id")).agg(F.count("*").alias("n"))
    u = u.select("track_id", F.explode(F.expr("sequence(0L, (n - 1) div 7)")).alias("id"))
    return u.select("track_id", "id", ((F.col("id") * 7 + F.col("track_id") % 5) / 1000.0).alias("start"),
                    ((F.col("id") * 7 + F.col("track_id") % 5 + 6 + F.col("id") % 12) / 1000.0).alias("end"),
                    (F.col("id") % 3).alias("speaker"))


@query("cut_frames", needs=("d4",), sql=CUT + "select track_id, id, ms from cf")
def q_cut(spark, sf):
    return fr.cut_frames(t.frames(spark, sf), frame_cues(spark, sf), 0.002).select("track_id", "id", "ms")


@query("clip_scores", needs=("d4",), sql=CUT + "select track_id, id, n_samples, round(score, 6) as score from cs")
def q_clip(spark, sf):
    c = fr.clip_scores(fr.cut_frames(t.frames(spark, sf), frame_cues(spark, sf), 0.002))
    return c.select("track_id", "id", "n_samples", F.round("score", 6).alias("score"))


@query("reference_clips", needs=("d4",), sql=CUT + """, rk as (select *, id % 3 as speaker, row_number() over w as rank, coalesce(sum(n_samples) over (partition by track_id, id % 3 order by score desc, id rows between unbounded preceding and 1 preceding), 0) as before
  from cs window w as (partition by track_id, id % 3 order by score desc, id))
select track_id, speaker, rank, id, n_samples from rk where before < 20""")
def q_refs(spark, sf):
    cues = frame_cues(spark, sf)
    s = fr.clip_scores(fr.cut_frames(t.frames(spark, sf), cues, 0.002))
    return fr.reference_clips(s, cues, 1000, 0.02).select("track_id", "speaker", "rank", "id", "n_samples")
