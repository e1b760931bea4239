"""Queries on scripts, speech text, inference, workflows and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunks, scripts
from ..functions import script_tables as S
from ..functions.text import ends_sentence
from ..operators import infer as inf, rerank as rr, routing as rt, units
from ..session import fresh_path, settle
from ..sources import sink, writers
from ..sources.folders import local_path
from ..streaming import streams
from . import tables as t, workflow as wf
from .file_queries import STATUS
from .cue_queries import LINES_SQL, SRT_DOCUMENTS_SQL, TIMED_SQL, UNITS_SQL, timed
from .quality_queries import PENALTY
from .registry import query

# Tokens of the given texts stand for Urdu words by their place in the word list.
URDU = list(S.URDU_ROMAN_WORDS)


def urdu_texts(spark, sf):
    """Every cue with its words exchanged for Urdu words, marks and digits kept."""
    words = F.array(*[F.lit(w) for w in URDU])
    tokens = F.transform(F.split("text", " "), lambda x: F.concat(
        F.element_at(words, (F.length(x) * 7 + F.ascii(x)) % len(URDU) + 1), F.when(x.endswith("."), "۔").when(x.endswith(","), "،").otherwise("")))
    return t.cues(spark, sf).select("track_id", "id", F.array_join(tokens, " ").alias("text"))


PAIR_SQL = ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(S.URDU_ROMAN_WORDS.items()))
URDU_SQL = f""", wd as (select * from (values {PAIR_SQL}) v(u, r, i)),
tk as (select track_id, id, p, x, (length(x) * 7 + case when x = '' then 0 else unicode(x) end) % {len(URDU)} as i, case when x like '%.' then 1 when x like '%,' then 2 else 0 end as m
  from (select track_id, id, unnest(string_split(text, ' ')) as x, unnest(range(0, len(string_split(text, ' ')))) as p from d0)),
ut as (select track_id, id, string_agg(concat(u, case m when 1 then '۔' when 2 then '،' else '' end), ' ' order by p) as urdu,
  string_agg(concat(r, case m when 1 then '.' when 2 then ',' else '' end), ' ' order by p) as roman from tk join wd using (i) group by track_id, id)
"""


@query("urdu_to_roman", needs=("d0",), sql=URDU_SQL + "select track_id, id, roman as converted from ut")
def q_urdu_roman(spark, sf):
    return urdu_texts(spark, sf).select("track_id", "id", scripts.urdu_to_roman("text").alias("converted"))


@query("roman_to_urdu", needs=("d0",), sql=URDU_SQL + "select track_id, id, urdu as converted from ut")
def q_roman_urdu(spark, sf):
    return urdu_texts(spark, sf).select("track_id", "id", scripts.roman_to_urdu(scripts.urdu_to_roman("text")).alias("converted"))


@query("urdu_to_devanagari")
def q_devanagari(spark, sf):
    return scripts.urdu_to_devanagari(urdu_texts(spark, sf))


@query("indic_convert")
def q_indic(spark, sf):
    c = t.cues(spark, sf).select("track_id", "id", scripts.roman_to_devanagari("text").alias("hi"))
    return c.select("track_id", "id", "hi", *[scripts.indic_convert("hi", "hi", k).alias(k) for k in ("bn", "gu", "ta", "ur", "roman")])


@query("spell_numbers")
def q_numbers(spark, sf):
    c = t.cues(spark, sf).select("track_id", "id", F.concat("text", F.lit(" "), F.col("start_ms").cast("string")).alias("text"))
    return scripts.spell_numbers(c, "hi").withColumnRenamed("converted", "hi").join(
        scripts.spell_numbers(c, "ja").withColumnRenamed("converted", "ja"), ["track_id", "id"])


@query("chunk_for_speech")
def q_chunk(spark, sf):
    return chunks.chunk_for_speech(t.read(spark, sf, "documents").select("doc_id", "text"), 250)


@query("chunk_punctuation")
def q_chunk_punct(spark, sf):
    return chunks.chunk_punctuation(t.read(spark, sf, "documents").select("doc_id", "text"), 200, 20)


# --- inference ---------------------------------------------------------------------------------------

def toy_load(key):
    return key


def toy_run(model, texts):
    """A stand-in model: marks each text with the model's name."""
    return [f"[{model}] {x.lower()}" for x in texts]


def toy_options(model, texts):
    return [[f"[{model}] {x.lower()}", x[::-1], x] for x in texts]


@query("infer", needs=("d0",), sql="""
, m as (select track_id, id, case when id % 9 = 0 then ' ' else text end as text, concat('m', track_id % 3) as model from d0)
select track_id, id, case when trim(text) = '' then '' else concat('[', model, '] ', lower(trim(text))) end as output from m""")
def q_infer(spark, sf):
    c = t.cues(spark, sf).select("track_id", "id", F.expr("if(id % 9 = 0, ' ', text)").alias("text"),
                                 F.concat(F.lit("m"), (F.col("track_id") % 3).cast("string")).alias("model"))
    return inf.infer(c, toy_load, toy_run).select("track_id", "id", "output")


def routed_units(spark, sf):
    c = t.cues(spark, sf).withColumn("language", F.expr("element_at(array('en', 'fr', 'zh'), cast(track_id % 3 as int) + 1)"))
    u = units.join_units(units.sentence_units(c)).withColumn("target", F.lit("ur"))
    pairs = u.select(F.col("language").alias("source"), "target").distinct()
    routes = rt.translation_routes(pairs, rt.leg_table(spark)).select(F.col("source").alias("language"), "target", "legs")
    return u.join(routes, ["language", "target"])


# The languages of the routed units are en, fr and zh by turns; only the last is written without blanks.
ROUTED_SQL = UNITS_SQL + """
, ru as (
  select w.track_id, w.unit_id, case when w.track_id % 3 = 2 then string_agg(trim(d0.text), '' order by d0.id) else string_agg(trim(d0.text), ' ' order by d0.id) end as text
  from walk w join d0 using (track_id, id) group by w.track_id, w.unit_id),
rl as (
  select *, case track_id % 3 when 0 then 'en-ur' when 1 then 'fr-en,en-ur' else 'zh-en,en-ur' end as legs,
    case track_id % 3 when 0 then trim(text) when 1 then concat('[fr-en] ', lower(trim(text))) else concat('[zh-en] ', lower(trim(text))) end as cur from ru)
"""


@query("infer_route", needs=("islands",), sql=ROUTED_SQL + """
select track_id, unit_id, legs, case when trim(text) = '' then '' else concat('[en-ur] ', lower(cur)) end as translated, cast(null as varchar) as error from rl""")
def q_route(spark, sf):
    u = settle(routed_units(spark, sf), "routed")
    out = inf.infer_route(u, toy_load, toy_run)
    return out.select("track_id", "unit_id", F.array_join("legs", ",").alias("legs"), "translated", "error")


@query("infer_route_reranked", needs=("islands",), sql=ROUTED_SQL + f"""
, op as (
  select track_id, unit_id, 'ur' as target, text as src, 0 as cand_ix, concat('[en-ur] ', lower(cur)) as out from rl where trim(text) <> ''
  union all select track_id, unit_id, 'ur', text, 1, reverse(cur) from rl where trim(text) <> ''
  union all select track_id, unit_id, 'ur', text, 2, cur from rl where trim(text) <> ''),
sc as (select *, 1.0::double - abs(length(out) - length(src) - 3) / 100.0::double - {PENALTY} as score from op),
bt as (select * from sc qualify row_number() over (partition by track_id, unit_id order by score desc, cand_ix) = 1)
select track_id, unit_id, coalesce(trim(out), '') as translated, cast(null as varchar) as error from rl left join bt using (track_id, unit_id)""")
def q_route_rerank(spark, sf):
    u = settle(routed_units(spark, sf), "routed")

    def score(options):
        return options.withColumn("score", 1.0 - F.abs(F.length("text") - F.length("source_text") - 3) / 100.0
                                  - rr.penalty("source_text", "text", "target", ascii_words=True))

    out = inf.infer_route(u, toy_load, toy_run, candidates=toy_options, score=score)
    return out.select("track_id", "unit_id", "translated", "error")


@query("run_workflow")
def q_workflow(spark, sf):
    """Translate every track into French, then write the result in upper case."""
    src = t.cues(spark, sf).withColumn("language", F.expr("if(track_id % 7 = 0, '', language)"))

    def model(u):
        return inf.infer(u, toy_load, toy_run, model="toy", out="translated").drop("error")

    r = wf.run_workflow(src, [wf.Translate("fr", model), wf.Transliterate("roman", lambda x, s: F.upper(x), input=0)])
    return r.steps[1].select("track_id", "id", "start", "end", "text", "language", "script")


# --- streams ----------------------------------------------------------------------------------------------

def staged(df, name, parts=8):
    """Store a table as several files and stream it back."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.repartition(parts).write.parquet(path)
    return streams.stream_table(spark, path, df.schema)


@query("job_status_stream", needs=("d5",), sql=STATUS)
def q_status_stream(spark, sf):
    s = streams.job_status_stream(staged(t.job_events(spark, sf), "events"))
    return streams.latest_rows(streams.drain(s, "status", "update"), ["job"])


@query("live_cues_stream", needs=("d5",), sql="""
select job, cue, arg_max(done, seq) as done, max(seq) as seq from d5 where event = 'segment' group by all""")
def q_live(spark, sf):
    e = t.job_events(spark, sf).where("event = 'segment'").select("job", "cue", "done", "seq")
    return streams.latest_rows(streams.drain(streams.live_cues_stream(staged(e, "cues")), "live", "update"), ["job", "cue"])


@query("cue_builder_stream")
def q_build_stream(spark, sf):
    """Cues of conversation turns as segments, built as they arrive."""
    c = t.read(spark, sf, "conversations").select("conv_id", "turn", F.expr(r"filter(split(text, '[ \n\t]+'), x -> x <> '')").alias("tk"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    c = c.join(last, "conv_id").withColumn("words", F.expr(
        "transform(tk, (x, i) -> struct(concat(' ', x) as word, turn * 600.0D + i * 0.3D as start, turn * 600.0D + i * 0.3D + 0.27D as `end`))"))
    s = c.select(F.col("conv_id").alias("track_id"), F.col("turn").alias("id"), (F.col("turn") * 600.0).alias("start"),
                 (F.col("turn") * 600.0 + 1).alias("end"), F.array_join("tk", " ").alias("text"), "words", F.lit("en").alias("language"),
                 (F.col("turn") == F.col("last")).alias("final"))
    return streams.drain(streams.cue_builder_stream(staged(s, "segments")), "built", "append").drop("batch", "pos", "gap")


@query("sentence_unit_stream", needs=("islands",), sql=UNITS_SQL + "select track_id, id, unit_id from walk")
def q_unit_stream(spark, sf):
    c = rr.cue_positions(t.cues(spark, sf)).select(
        "track_id", "id", "number", "start", "end", F.length("text").alias("n"), ends_sentence("text").alias("ends"))
    return streams.drain(streams.sentence_unit_stream(staged(c, "cues")), "units", "append").drop("batch")


@query("file_arrival_stream", needs=("d0",), sql=TIMED_SQL + LINES_SQL + f"""
, dc as ({SRT_DOCUMENTS_SQL})
select concat('track', track_id, '.srt') as path, strlen(document) as bytes, 'SRT' as ext, 'subtitle' as kind from dc""")
def q_files_stream(spark, sf):
    """Subtitle files of all tracks, as they are found in the folder they were written to."""
    path = local_path(fresh_path(spark, "arrivals"))
    name = F.concat(F.lit(f"{path}/track"), F.col("track_id").cast("string"), F.lit(".srt"))
    sink.save_files(writers.write_srt(timed(spark, sf)).select(name.alias("output"), "document"))
    f = streams.drain(streams.file_arrival_stream(spark, path, "*.srt", forget="1 day"), "files", "append")
    return f.select(F.substring("path", len(path) + 2, 1000).alias("path"), "bytes", "ext", "kind")
