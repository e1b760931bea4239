"""Queries on file queues, routes, voices, jobs and stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import files as fl, jobs as jb, routing as rt
from ..operators.timing import latest_cues
from ..session import fresh_path
from ..sources import results as rs, sink, writers
from ..sources.folders import local_path
from . import tables as t
from .cue_queries import LINES_SQL, SRT_DOCUMENTS_SQL, TIMED_SQL, timed
from .registry import query
from .tables_sql import quoted

KIND = f"""case when ext in ({quoted(K.VIDEO_EXTENSIONS)}) then 'video' when ext in ({quoted(K.SUBTITLE_EXTENSIONS)}) then 'subtitle' else 'audio' end"""
EXT = r", x8 as (select *, lower(regexp_extract(path, '\.([^./]*)$', 1)) as ext, replace(path, '/./', '/') as norm from d8)"


@query("classify_files", needs=("d8",), sql=EXT + f" select file_id, case when ext = '' then 'FILE' else upper(ext) end as ext, {KIND} as kind from x8")
def q_classify(spark, sf):
    return fl.classify(t.files(spark, sf)).select("file_id", "ext", "kind")


@query("dedupe_files", needs=("d8",), sql=EXT + """
select norm as path, min(file_id) as file_id from x8 where norm not in (select norm from x8 where file_id < 20) group by norm""")
def q_dedupe(spark, sf):
    f = t.files(spark, sf)
    return fl.dedupe_files(f, f.where("file_id < 20")).select("path", "file_id")


@query("split_language", needs=("d8",), sql=r"""
select file_id, case when path like '%\_en.SRT' escape '\' then 'en' else '' end as language,
  case when path like '%\_en.SRT' escape '\' then replace(path, '_en.SRT', '.SRT') else path end as base_path from d8""")
def q_split_language(spark, sf):
    return fl.split_language(t.files(spark, sf)).select("file_id", "language", "base_path")


@query("effective_language", needs=("d8",), sql=r"""
select file_id, case when chosen_language <> '' then chosen_language when path like '%\_en.SRT' escape '\' then 'en' else '' end as text_language from d8""")
def q_effective(spark, sf):
    return fl.effective_language(fl.split_language(t.files(spark, sf))).select("file_id", "text_language")


@query("runnable_files", needs=("d8",), sql="""
select file_id, status from d8 where status <> 'done' or not exists (select 1 from d8 where status <> 'done')""")
def q_runnable(spark, sf):
    return fl.runnable_files(t.files(spark, sf)).select("file_id", "status")


@query("queue_totals", needs=("d8",), sql="""
select count(*) as files, sum(bytes)::bigint as bytes, count(*) filter (status = 'done') as done, count(*) filter (status = 'error') as failed,
 case when count(*) filter (status <> 'done') > 0 then count(*) filter (status <> 'done') else count(*) end as runnable from d8""")
def q_totals(spark, sf):
    return fl.queue_totals(t.files(spark, sf))


PAIRS = EXT + r""", m as (select lower(regexp_replace(norm, '\.[^./]*$', '')) as k, arg_min(norm, file_id) as media_path from x8 where ext in ('mp4', 'mp3') group by all),
pr as (select s.file_id, s.norm as path, 'en' as language, m.media_path from x8 s left join m on m.k = lower(replace(s.norm, '_en.SRT', '')) where s.ext = 'srt')
"""


def pairs(spark, sf):
    f = t.files(spark, sf).withColumn("path", fl.normal_path("path"))
    kinds = fl.classify(f)
    return fl.pair_companions(kinds.where("kind = 'subtitle'"), kinds.where("ext in ('MP4', 'MP3')"))


@query("pair_companions", needs=("d8",), sql=PAIRS + "select file_id, path, language, media_path from pr")
def q_pairs(spark, sf):
    return pairs(spark, sf).select("file_id", "path", "language", "media_path")


@query("unpaired", needs=("d8",), sql=PAIRS + "select path, language from pr where media_path is null")
def q_unpaired(spark, sf):
    return fl.unpaired(pairs(spark, sf))


@query("output_paths", needs=("d8",), sql=EXT + r""", u as (select norm as path, min(file_id) as file_id from x8 group by norm),
o as (select u.*, f.format, concat(regexp_replace(replace(path, '_en.SRT', '.SRT'), '\.[^./]*$', ''), '_en.', f.format) as output from u, (select unnest(['srt', 'SRT']) as format) f),
n as (select *, count(*) over (partition by output) as n from o)
select file_id, format, output, case when output in (select path from u) then concat('Writing ', regexp_extract(output, '[^/]*$'), ' would overwrite the input file.')
  when n > 1 then 'Several inputs would write this file.' end as error from n""")
def q_output(spark, sf):
    f = fl.dedupe_files(t.files(spark, sf)).select("path", "file_id")
    return fl.output_paths(f, ["srt", "SRT"], "_en").select("file_id", "format", "output", "error")


# --- routes -------------------------------------------------------------------------------------

LEG_SQL = ", lg as (select * from (values " + ", ".join(f"('{a}', '{b}', '{m}')" for a, b, m, _ in K.LEGS) + ") v(source, target, model))"
ROUTES = LEG_SQL + """, dp as (select doc_id, lang as source, (['ur', 'en', 'ja', 'fr', 'hi', 'ko'])[doc_id % 6 + 1] as target from documents where lang <> (['ur', 'en', 'ja', 'fr', 'hi', 'ko'])[doc_id % 6 + 1]),
rp as (select source, target, count(*) as n from dp group by all),
rr as (select rp.*, exists (select 1 from lg where lg.source = rp.source and lg.target = rp.target) as d,
  exists (select 1 from lg where lg.source = rp.source and lg.target = 'en') as a, exists (select 1 from lg where lg.source = 'en' and lg.target = rp.target) as b from rp),
ro as (select *, case when d or source = 'en' or target = 'en' then concat(source, '-', target) else concat(source, '-en,en-', target) end as legs,
  case when d then null when source = 'en' or target = 'en' then concat('no model from ''', source, ''' to ''', target, '''')
   when not a then concat('no model from ''', source, ''' to ''en''') when not b then concat('no model from ''en'' to ''', target, '''') end as error from rr)
"""


def language_pairs(spark, sf):
    d = t.read(spark, sf, "documents").select("lang", F.expr(
        "element_at(array('ur', 'en', 'ja', 'fr', 'hi', 'ko'), cast(doc_id % 6 as int) + 1)").alias("target"))
    return d.where("lang <> target").groupBy(F.col("lang").alias("source"), "target").agg(F.count(F.lit(1)).alias("n"))


@query("translation_routes", sql=ROUTES.replace(", lg", "with lg", 1) + "select source, target, n, case when error is null then legs end as legs, error from ro")
def q_routes(spark, sf):
    r = rt.translation_routes(language_pairs(spark, sf), rt.leg_table(spark))
    return r.select("source", "target", "n", F.array_join("legs", ",").alias("legs"), "error")


@query("models_for", sql=ROUTES.replace(", lg", "with lg", 1) + """, l as (select source, target, unnest(string_split(legs, ',')) as leg, unnest(range(0, len(string_split(legs, ',')))) as pos from ro where error is null),
m as (select l.source, l.target, lg.model, min(pos) as pos from l join lg on concat(lg.source, '-', lg.target) = leg group by all)
select source, target, row_number() over (partition by source, target order by pos) - 1 as position, model from m""")
def q_models(spark, sf):
    legs = rt.leg_table(spark)
    return rt.models_for(rt.translation_routes(language_pairs(spark, sf), legs), legs)


@query("pick_engine", sql=ROUTES.replace(", lg", "with lg", 1) + """
select source, target, n, case when target in ('ja', 'ko', 'zh') or source in ('ja', 'ko') or error is not null then 'direct' else 'routed' end as engine from ro""")
def q_pick(spark, sf):
    return rt.pick_engine(language_pairs(spark, sf), rt.leg_table(spark))


@query("script_for_language", sql=f"""
select doc_id, case when l in ({quoted(K.LATIN_SCRIPT_LANGUAGES)}) then 'roman' when l in ({quoted(K.SCRIPT_CODES)}) then l else '' end as script
from (select doc_id, case doc_id % 4 when 0 then 'hi' when 1 then 'xx' else lang end as l from documents)""")
def q_script(spark, sf):
    d = t.read(spark, sf, "documents").select("doc_id", F.expr("case doc_id % 4 when 0 then 'hi' when 1 then 'xx' else lang end").alias("l"))
    return d.select("doc_id", rt.script_for_language("l").alias("script"))


@query("pair_supported", sql=f"""
select doc_id, s <> g and case when e = 'rule' then s in ({quoted(K.SCRIPT_CODES)}) and g in ({quoted(K.SCRIPT_CODES)})
   when e = 'neural' then (s in ('hi', 'pa') and g = 'ur') or (s = 'ur' and g = 'roman') or (s = 'roman' and g = 'ur') else false end as supported,
  case when s = 'ur' and g = 'roman' then 'ur-roman' when s = 'roman' and g = 'ur' then 'roman-ur' when s in ('hi', 'pa') and g = 'ur' then 'hi-ur' end as model
from (select doc_id, (['rule', 'neural', 'other'])[doc_id % 3 + 1] as e, (['hi', 'roman', 'pa', 'ur', 'xx'])[doc_id % 5 + 1] as s, (['ur', 'roman', 'bn', 'hi'])[(doc_id // 5) % 4 + 1] as g from documents)""")
def q_supported(spark, sf):
    d = t.read(spark, sf, "documents").select(
        "doc_id", F.expr("element_at(array('rule', 'neural', 'other'), cast(doc_id % 3 as int) + 1)").alias("e"),
        F.expr("element_at(array('hi', 'roman', 'pa', 'ur', 'xx'), cast(doc_id % 5 as int) + 1)").alias("s"),
        F.expr("element_at(array('ur', 'roman', 'bn', 'hi'), cast((doc_id div 5) % 4 as int) + 1)").alias("g"))
    return d.select("doc_id", rt.pair_supported("e", "s", "g").alias("supported"), rt.model_key("s", "g").alias("model"))


VOICES = [("clone1", "x", "en", None, False, 0), ("clone1", "x", "fr", None, False, 1), ("clone1", "x", "de", None, False, 2),
          ("stock1", "s1", "en", "C", False, 3), ("stock1", "s2", "en", "A", False, 4), ("stock1", "s3", "fr", "B", False, 5),
          ("stock2", "t1", "en", None, False, 6), ("stock2", "t2", "es", None, False, 7), ("stock2", "t3", "es", None, True, 8)]


@query("resolve_voice", sql="""
with r as (select doc_id, case when doc_id % 10 = 9 then 'xx' else lang end as language, (['clone1', 'stock1', 'stock2'])[doc_id % 3 + 1] as engine,
  case when doc_id % 7 = 0 then 's3' else 'auto' end as voice, doc_id % 2 = 0 as can_clone from documents),
b as (select * from (values ('clone1', 'en', 'x'), ('clone1', 'fr', 'x'), ('clone1', 'de', 'x'), ('stock1', 'en', 's2'), ('stock1', 'fr', 's3'), ('stock2', 'en', 't1'), ('stock2', 'es', 't3')) v(engine, language, best)),
j as (select r.*, o.best as own, case when s1.best is not null then 'stock1' when s2.best is not null then 'stock2' end as fe, coalesce(s1.best, s2.best) as fb, c.best as cl from r
  left join b o on o.engine = r.engine and o.language = r.language left join b s1 on s1.engine = 'stock1' and s1.language = r.language
  left join b s2 on s2.engine = 'stock2' and s2.language = r.language left join b c on c.engine = 'clone1' and c.language = r.language),
k as (select *, own is not null and (engine <> 'clone1' or can_clone) as ok from j),
e as (select *, ok and voice <> 'auto' and engine <> 'clone1' as named, case when not ok and fe is null then
   case when own is not null then concat(engine, ' needs a recording to clone: no stock voice speaks ''', language, '''.')
        when cl is not null then concat(engine, ' can''t speak ''', language, '''; choose voice cloning (clone1).') else concat('No voice speaks ''', language, '''.') end
   when ok and voice <> 'auto' and engine = 'stock2' then concat('Unknown stock2 voice: ', voice, '.')
   when ok and voice <> 'auto' and engine = 'stock1' and language <> 'fr' then concat('The voice s3 speaks ''fr'', not ''', language, '''.') end as error from k)
select doc_id, case when error is null then case when ok then engine else fe end end as used_engine,
 case when error is null then case when named then voice when ok then own else fb end end as used_voice,
 case when error is null and not ok then concat(engine, ' ', case when engine = 'clone1' and own is not null then 'has no original voice to clone' else concat('can''t speak ''', language, '''') end, ', so ', fe, ' was used instead.') end as warning, error from e""")
def q_voice(spark, sf):
    r = t.read(spark, sf, "documents").select(
        "doc_id", F.expr("if(doc_id % 10 = 9, 'xx', lang)").alias("language"),
        F.expr("element_at(array('clone1', 'stock1', 'stock2'), cast(doc_id % 3 as int) + 1)").alias("engine"),
        F.expr("if(doc_id % 7 = 0, 's3', 'auto')").alias("voice"), F.expr("doc_id % 2 = 0").alias("can_clone"))
    v = spark.createDataFrame(VOICES, "engine string, voice_id string, language string, grade string, preferred boolean, ord int")
    out = rt.resolve_voice(r, v, [("clone1", True), ("stock1", False), ("stock2", False)])
    return out.select("doc_id", "used_engine", "used_voice", "warning", "error")


# --- jobs -------------------------------------------------------------------------------------------

STATUS = """
select job, arg_max(message, seq) filter (event = 'status') as message, arg_max(step, seq) filter (event in ('status', 'progress')) as step,
 arg_max(case when total > 0 then least(1.0, done / total) else -1.0 end, seq) filter (event = 'progress') as stage_progress,
 count(*) filter (event = 'segment') as segments, bool_or(event = 'finished') as finished, bool_or(event = 'error') as failed, max(seq) as last_seq from d5 group by job"""


@query("job_status", needs=("d5",), sql=STATUS)
def q_status(spark, sf):
    return jb.job_status(t.job_events(spark, sf))


@query("progress_fraction", needs=("d5",), sql="""
, p as (select job, step, max(case when event = 'progress' then case when total > 0 then least(1.0, done / total) else -1.0 end else 0.0 end) as f, max(seq) as seq, max(steps) as steps
  from d5 where event in ('status', 'progress') group by all),
l as (select * from p qualify row_number() over (partition by job order by seq desc) = 1)
select job, step, round(least(1.0, (step + greatest(f, 0.0)) / greatest(steps, 1)), 9) as fraction from l""")
def q_progress(spark, sf):
    return jb.progress_fraction(t.job_events(spark, sf)).select("job", "step", F.round("fraction", 9).alias("fraction"))


@query("latest_cues", needs=("d5",), sql="""
select job, cue, arg_max(done, seq) as done, max(seq) as seq from d5 where event = 'segment' group by all""")
def q_latest(spark, sf):
    e = t.job_events(spark, sf).where("event = 'segment'").select("job", "cue", "done", "seq")
    return latest_cues(e, ("job", "cue"))


@query("recent_results", needs=("d5",), sql="""
, r as (select job, max(seq) as finished_at from d5 where event = 'finished' group by job) select * from r order by finished_at desc limit 100""")
def q_recent(spark, sf):
    r = t.job_events(spark, sf).where("event = 'finished'").groupBy("job").agg(F.max("seq").alias("finished_at"))
    return jb.recent_results(r)


@query("run_summary", needs=("d5",), sql="""
, r as (select job % 10 as run, seq, case event when 'finished' then 'ok' when 'error' then 'failed' else 'cancelled' end as state, case when seq % 5 = 0 then message end as warning from d5 where event in ('finished', 'error', 'segment'))
select run, count(*) filter (state = 'ok') as ok, count(*) filter (state = 'failed') as failed, count(*) filter (state = 'cancelled') as cancelled,
 concat(arg_min(warning, seq) filter (warning is not null), case when count(warning) > 1 then concat(' (+', count(warning) - 1, ' more)') else '' end) as note from r group by run""")
def q_run(spark, sf):
    e = t.job_events(spark, sf).where("event in ('finished', 'error', 'segment')").select(
        F.expr("job % 10").alias("run"), F.col("seq").alias("position"),
        F.expr("case event when 'finished' then 'ok' when 'error' then 'failed' else 'cancelled' end").alias("state"),
        F.expr("if(seq % 5 = 0, message, null)").alias("warning"))
    return jb.run_summary(e)


@query("read_utterances", needs=("d7",), sql="""
, l as (select clip_id as n, concat('rec', clip_id % 40, '.wav') as file, regexp_replace(ref, '[\\t\\n]', ' ', 'g') as text, gender from d7)
select file, arg_min(text, n) as text, arg_min(gender, n) as gender from l group by file""".replace("\\\\", "\\"))
def q_utterances(spark, sf):
    c = t.clips(spark, sf)
    lines = c.select(F.col("clip_id").alias("n"), F.concat_ws(
        "\t", F.lit("id"), F.concat(F.lit("rec"), (F.col("clip_id") % 40).cast("string"), F.lit(".wav")),
        F.regexp_replace("ref", "[\t\n]", " "), F.lit("n"), F.lit("l"), F.lit("0"), "gender").alias("value"))
    return rs.parse_utterances(lines).select("file", "text", "gender")


@query("scan_files", needs=("d0",), sql=TIMED_SQL + LINES_SQL + f"""
, dc as ({SRT_DOCUMENTS_SQL})
select concat('Season ', track_id % 5, '/track', track_id, '.srt') as path, strlen(document) as bytes, 'SRT' as ext, 'subtitle' as kind from dc""")
def q_scan(spark, sf):
    """Subtitle files of all tracks, written to folders of the shared folder and found again."""
    path = local_path(fresh_path(spark, "library"))
    name = F.concat(F.lit(f"{path}/Season "), (F.col("track_id") % 5).cast("string"), F.lit("/track"), F.col("track_id").cast("string"), F.lit(".srt"))
    sink.save_files(writers.write_srt(timed(spark, sf)).select(name.alias("output"), "document"))
    found = fl.classify(fl.scan_files(spark, [path], [".srt", ".MP4"]))
    return found.select(F.substring("path", len(path) + 2, 1000).alias("path"), "bytes", "ext", "kind")


@query("load_results", needs=("d7",), sql="""
select engine, language, count(*) as count, round(avg(length(ref)), 6) as chrf, case when engine = 'beta' then 'no such pair' end as unsupported from d7 group by engine, language""")
def q_results(spark, sf):
    """Results stored as JSON lines and loaded again under the result schema."""
    path = fresh_path(spark, "results")
    c = t.clips(spark, sf).groupBy("engine", "language").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg(F.length("ref")), 6).alias("chrf"))
    c.withColumn("unsupported", F.when(F.col("engine") == "beta", "no such pair")).write.json(path)
    return rs.load_results(spark, path, multi_line=False).select("engine", "language", "count", "chrf", "unsupported")
