"""Queries on cue tracks: timing, units, filters and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions.wrap import wrap_text
from ..operators import timing, units
from ..operators.ordered import attach
from ..session import settle
from ..sources import subtitles, writers
from . import tables as t
from .registry import query
from .tables_sql import END, ends_sentence_sql, quoted


def translated(cues):
    """A stand-in translation of every cue, used where an operator takes translated text."""
    return F.concat(F.lit("tr: "), F.lower("text"))


@query("finalize_timing", needs=("d0",), sql="""
, n as (select *, coalesce(lead("start") over (partition by track_id order by id), 'infinity'::double) as nx, greatest("end", "start") as e1 from d0),
e as (select *, case when e1 > nx and nx > "start" then nx else e1 end as e2,
   "start" + least(greatest(0.5::double, length(text) / 17.0::double), 7.0::double) as wanted from n)
select track_id, id, "start", case when e2 < wanted then greatest(e2, least(wanted, nx)) else e2 end as "end", text from e""")
def q_finalize_timing(spark, sf):
    return timing.finalize_timing(t.cues(spark, sf)).select("track_id", "id", "start", "end", "text")


@query("drop_empty_cues", needs=("d0",), sql="""
, m as (select track_id, id, case when id % 6 = 5 then '' else text end as text from d0)
select track_id, row_number() over (partition by track_id order by id) - 1 as id, text from m where text <> ''""")
def q_drop_empty(spark, sf):
    c = t.cues(spark, sf).withColumn("text", F.expr("if(id % 6 = 5, '', text)"))
    return timing.drop_empty_cues(c).select("track_id", "id", "text")


@query("ends_sentence", needs=("d0",), sql=f"""
select track_id, id, {ends_sentence_sql('text')} as ends from d0""")
def q_ends(spark, sf):
    return t.cues(spark, sf).select("track_id", "id", T.ends_sentence("text").alias("ends"))


@query("sentence_islands", needs=("islands",), sql="""select track_id, id, island from islands""")
def q_islands(spark, sf):
    return units.sentence_islands(t.cues(spark, sf)).select("track_id", "id", "island")


# First-fit packing follows the previous cue, so the check is a recursive walk along each island.
UNITS_SQL = """
, nb as (select track_id, id, island, length(text) as n, row_number() over (partition by track_id order by id) as rn,
   case when lag(island) over (partition by track_id order by id) = island then 0 else 1 end as fresh from islands),
walk as (
  select track_id, id, rn, n + 1 as cur, id as unit_id from nb where rn = 1
  union all
  select b.track_id, b.id, b.rn,
    case when b.fresh = 1 or w.cur + b.n > 300 then b.n + 1 else w.cur + b.n + 1 end,
    case when b.fresh = 1 or w.cur + b.n > 300 then b.id else w.unit_id end
  from walk w join nb b on b.track_id = w.track_id and b.rn = w.rn + 1)
"""


@query("sentence_units", needs=("islands",), sql=UNITS_SQL + "select track_id, id, unit_id from walk")
def q_units(spark, sf):
    return units.sentence_units(t.cues(spark, sf)).select("track_id", "id", "unit_id")


def joiner(lang="d0.language"):
    return f"case when {lang} in ({quoted(K.NO_SPACE_LANGUAGES)}) then '' else ' ' end"


@query("join_units", needs=("islands",), sql=UNITS_SQL + f"""
select w.track_id, w.unit_id, count(*) as n_cues, min(d0."start") as "start", max_by(d0."end", d0.id) as "end",
  case when {joiner()} = '' then string_agg(trim(d0.text), '' order by d0.id) else string_agg(trim(d0.text), ' ' order by d0.id) end as text
from walk w join d0 using (track_id, id) group by w.track_id, w.unit_id, {joiner()}""")
def q_join_units(spark, sf):
    u = units.join_units(units.sentence_units(t.cues(spark, sf)))
    return u.select("track_id", "unit_id", F.size("members").cast("bigint").alias("n_cues"), "start", "end", "text")


@query("spoken_units", needs=("islands",), sql=UNITS_SQL + """
, s as (select d0.track_id, d0.id, w.unit_id, d0.speaker,
  lag(w.unit_id) over v as pu, lag(d0.speaker) over v as ps
  from walk w join d0 using (track_id, id) where trim(d0.text) <> ''
  window v as (partition by d0.track_id order by d0.id)),
f as (select *, case when pu is null or pu <> unit_id or ps <> speaker then id end as fs from s)
select track_id, id, max(fs) over (partition by track_id order by id) as line_id from f""")
def q_spoken(spark, sf):
    return units.spoken_units(settle(units.sentence_units(t.cues(spark, sf)), "units")).select("track_id", "id", "line_id")


@query("slot_ends", needs=("islands",), sql=UNITS_SQL + """
, s as (select d0.*, w.unit_id, lag(w.unit_id) over v as pu, lag(d0.speaker) over v as ps
  from walk w join d0 using (track_id, id) where trim(d0.text) <> ''
  window v as (partition by d0.track_id order by d0.id)),
f as (select *, max(case when pu is null or pu <> unit_id or ps <> speaker then id end) over (partition by track_id order by id) as line_id from s),
l as (select track_id, line_id, min_by("start", id) as "start", max_by("end", id) as "end" from f group by all)
select track_id, line_id, coalesce(lead("start") over (partition by track_id order by line_id), least("end" + 1.0::double, 100.0::double)) as slot_end from l""")
def q_slots(spark, sf):
    lines = settle(units.spoken_lines(settle(units.sentence_units(t.cues(spark, sf)), "units")), "lines")
    return units.slot_ends(lines, 100.0).select("track_id", "line_id", "slot_end")


@query("spread_translation")
def q_spread(spark, sf):
    u = units.join_units(units.sentence_units(t.cues(spark, sf)))
    u = u.withColumn("translated", F.regexp_replace("text", "th", "t h")).withColumn("target_lang", F.col("language"))
    return units.spread_translation(u)


@query("keep_same_language", needs=("d0",), sql="""
select track_id, id, case when language = 'fr' then text else concat('tr: ', lower(text)) end as text,
  case when language = 'fr' then 'The text is already in French, so it was kept as it is.' end as note from d0""")
def q_same(spark, sf):
    kept, rest = timing.keep_same_language(t.cues(spark, sf), "fr")
    done = rest.withColumn("text", translated(rest)).withColumn("note", F.lit(None).cast("string"))
    return timing.union_tracks(kept, done).select("track_id", "id", "text", "note")


@query("unchanged_tracks", needs=("d0",), sql=r"""
, x as (select track_id, regexp_replace(text, '[^\p{L}]', '', 'g') as a,
  regexp_replace(case when track_id % 3 = 0 then replace(text, '.', '۔') else lower(text) end, '[^\p{L}]', '', 'g') as b from d0)
select track_id from x group by track_id having bool_or(a <> '') and bool_and(a = b)""")
def q_unchanged(spark, sf):
    c = t.cues(spark, sf).withColumn(
        "transliterated", F.expr("if(track_id % 3 = 0, replace(text, '.', '۔'), lower(text))"))
    return timing.unchanged_tracks(c)


@query("unknown_language", needs=("d0",), sql="""
, tr as (select distinct track_id, case when track_id % 2 = 0 then 'auto' else 'de' end as source_lang,
  case when track_id % 5 = 0 then '' else language end as language from d0)
select track_id, case when source_lang <> 'auto' then source_lang when language <> '' then language end as source,
  case when source_lang = 'auto' and language = '' then 'Can''t tell which language the track is in. Choose the source language.' end as error
from tr""")
def q_unknown(spark, sf):
    tr = t.cues(spark, sf).select(
        "track_id", F.expr("if(track_id % 2 = 0, 'auto', 'de')").alias("source_lang"),
        F.expr("if(track_id % 5 = 0, '', language)").alias("language")).distinct()
    return timing.unknown_language(tr).select("track_id", "source", "error")


@query("reject_rows", needs=("d0",), sql="""
, tr as (select track_id, count(*) as n, any_value(language) as language from d0 group by track_id)
select track_id, 'ok' as status, n from tr where not (track_id % 2 = 0 and track_id % 5 = 0)
union all select track_id, 'rejected', n from tr where track_id % 2 = 0 and track_id % 5 = 0""")
def q_reject(spark, sf):
    tr = t.cues(spark, sf).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.min("language").alias("language"))
    tr = tr.withColumn("source_lang", F.expr("if(track_id % 2 = 0, 'auto', 'de')"))
    tr = tr.withColumn("language", F.expr("if(track_id % 5 = 0, '', language)"))
    good, bad = timing.split_rejected(timing.unknown_language(tr))
    return good.select("track_id", F.lit("ok").alias("status"), "n").unionByName(
        bad.select("track_id", F.lit("rejected").alias("status"), "n"))


@query("union_tracks", needs=("d0",), sql="""
select track_id, id, text, 'source' as step from d0 union all select track_id, id, lower(text), 'translate' from d0""")
def q_union(spark, sf):
    c = t.cues(spark, sf).select("track_id", "id", "text")
    return timing.union_tracks(c.withColumn("step", F.lit("source")),
                               c.withColumn("text", F.lower("text")).withColumn("step", F.lit("translate")))


@query("layout_for_language", needs=("d0",), sql="""
select distinct track_id, language, case when language in ('zh','ja','th','my','lo','km') then 16 else 42 end as max_line_length,
  case when language in ('zh','ja','th','my','lo','km') then 32 else 84 end as max_chars from d0""")
def q_layout(spark, sf):
    return timing.layout_for_language(t.cues(spark, sf).select("track_id", "language").distinct())


# --- functions -------------------------------------------------------------------------------

@query("to_seconds", needs=("d0",), sql=r"""
, s as (select track_id, id, case id % 5 when 0 then concat(start_ms // 3600000, ':', (start_ms // 60000) % 60, ':', (start_ms // 1000) % 60, ',', start_ms % 1000)
   when 1 then concat(start_ms // 60000, ':', (start_ms // 1000) % 60, '.', start_ms % 1000)
   when 2 then concat(start_ms // 1000, '.', start_ms % 1000) when 3 then 'a:b:c' else '1:2:3:4' end as stamp from d0),
p as (select *, string_split(replace(stamp, ',', '.'), ':') as p from s)
select track_id, id, coalesce(case len(p) when 3 then try_cast(p[1] as bigint) * 3600 + try_cast(p[2] as bigint) * 60 + try_cast(p[3] as double)
  when 2 then try_cast(p[1] as bigint) * 60 + try_cast(p[2] as double) when 1 then try_cast(p[1] as double) end, 0.0::double) as seconds from p""")
def q_to_seconds(spark, sf):
    stamp = F.expr("""case id % 5 when 0 then concat(start_ms div 3600000, ':', (start_ms div 60000) % 60, ':', (start_ms div 1000) % 60, ',', start_ms % 1000)
       when 1 then concat(start_ms div 60000, ':', (start_ms div 1000) % 60, '.', start_ms % 1000)
       when 2 then concat(start_ms div 1000, '.', start_ms % 1000) when 3 then 'a:b:c' else '1:2:3:4' end""")
    return t.cues(spark, sf).select("track_id", "id", T.to_seconds(stamp).alias("seconds"))


@query("cue_text", needs=("d0",), sql="""
select track_id, id, trim(coalesce(case when id % 3 = 0 then concat(' ', lower(text), ' ') end, text)) as shown from d0""")
def q_cue_text(spark, sf):
    c = t.cues(spark, sf).withColumn("transliterated", F.expr("if(id % 3 = 0, concat(' ', lower(text), ' '), null)"))
    return c.select("track_id", "id", T.cue_text(c.columns).alias("shown"))


def clock_sql(x, scale, hours):
    ms = f"round_even({x} * {scale}.0::double, 0)::bigint"
    width = 3 if scale == 1000 else 2
    if not hours:
        return f"printf('%02d:%02d.%0{width}d', {ms} // {60 * scale}, ({ms} // {scale}) % 60, {ms} % {scale})"
    return (f"printf('{hours}:%02d:%02d.%0{width}d', {ms} // {3600 * scale}, ({ms} // {60 * scale}) % 60, "
            f"({ms} // {scale}) % 60, {ms} % {scale})")


@query("time_formats", needs=("d0",), sql=f"""
select track_id, id, replace({clock_sql('"end"', 1000, '%02d')}, '.', ',') as srt, {clock_sql('"end"', 1000, '%02d')} as vtt,
  {clock_sql('"end"', 1000, '%d')} as sbv, {clock_sql('"end"', 100, '')} as lrc, {clock_sql('"end"', 100, '%d')} as ass from d0""")
def q_times(spark, sf):
    return t.cues(spark, sf).select(
        "track_id", "id", T.srt_time("end").alias("srt"), T.vtt_time("end").alias("vtt"), T.sbv_time("end").alias("sbv"),
        T.lrc_time("end").alias("lrc"), T.ass_time("end").alias("ass"))


@query("finish_sentence", needs=("d0",), sql=r"""
select track_id, id, case when trim(text) = '' or regexp_matches(trim(text), '[.!?…。！？؟।۔,;:،，、"'')\]»”’]$') then trim(text)
  else concat(trim(text), case language when 'hi' then '।' when 'ur' then '۔' when 'ja' then '。' when 'zh' then '。' else '.' end) end as spoken from d0""")
def q_finish(spark, sf):
    return t.cues(spark, sf).select("track_id", "id", T.finish_sentence("text", "language").alias("spoken"))


@query("add_punctuation", sql=r"""
select conv_id, turn, case when trim(text) = '' or regexp_matches(trim(text), '[;:,.!?…)\]}"''“”‘’；：，。！？、）】]$') then trim(text)
  else concat(trim(text), case when regexp_matches(text, '[一-鿿]') then '。' else '.' end) end as closed
from (select conv_id, turn, case when turn % 2 = 0 then rtrim(text, '.') else text end as text from conversations)""")
def q_punct(spark, sf):
    c = t.read(spark, sf, "conversations").withColumn("text", F.expr("if(turn % 2 = 0, rtrim('.', text), text)"))
    return c.select("conv_id", "turn", T.add_punctuation("text").alias("closed"))


@query("strip_tags", sql=r"""
select page_id, trim(regexp_replace(regexp_replace(html, '</?(?:[a-zA-Z][^<>]*|\d[\d:.]*)>|\{\\[^}]*\}', '', 'g'), '\s+', ' ', 'g')) as plain from pages""")
def q_strip_tags(spark, sf):
    return t.read(spark, sf, "pages").select("page_id", T.strip_tags("html").alias("plain"))


@query("strip_markup")
def q_strip_markup(spark, sf):
    from ..functions.python_text import html_unescape
    p = t.read(spark, sf, "pages").select("page_id", F.regexp_replace("html", T.MARKUP, "").alias("p"))
    return p.select("page_id", T.collapse(html_unescape("p")).alias("plain"))


@query("strip_ass", needs=("d0",), sql=r"""
select track_id, id, trim(regexp_replace(regexp_replace(concat('{\an8}', replace(text, ' th', '\Nth'), '{x}'), '\{.*?\}', '', 'g'), '\\[Nnh]', ' ', 'g')) as plain from d0""")
def q_strip_ass(spark, sf):
    c = t.cues(spark, sf).withColumn("raw", F.concat(F.lit("{\\an8}"), F.replace("text", F.lit(" th"), F.lit("\\Nth")), F.lit("{x}")))
    return c.select("track_id", "id", T.strip_ass("raw").alias("plain"))


# --- documents -----------------------------------------------------------------------------------

def timed(spark, sf):
    return timing.finalize_timing(t.cues(spark, sf))


TIMED_SQL = """
, n as (select *, coalesce(lead("start") over (partition by track_id order by id), 'infinity'::double) as nx, greatest("end", "start") as e1 from d0),
e as (select *, case when e1 > nx and nx > "start" then nx else e1 end as e2,
   "start" + least(greatest(0.5::double, length(text) / 17.0::double), 7.0::double) as wanted from n),
tm as (select track_id, id, "start", case when e2 < wanted then greatest(e2, least(wanted, nx)) else e2 end as "end", trim(text) as text, language,
   row_number() over (partition by track_id order by id) as num from e where trim(text) <> ''),
"""
def lines_sql(table: str, keys: str, limit: str) -> str:
    """`ln`: the rows of a table with `w`, the display lines of `text`: one that fits, even pieces of an unbroken text, the best two
    balanced ones, or lines filled word by word, long words in even pieces."""
    size = "cast(ceil(length({0}) / ceil(length({0}) / lim::double)) as bigint)"
    pieces = f"list_transform(generate_series(1, length({{0}}), {size}), lambda i: substr({{0}}, i, {size}))"
    word = f"case when length(x) > lim then array_to_string({pieces.format('x')}, chr(10)) else x end"
    return f"""lm as (select *, {limit} as lim from {table}),
k as (select {keys}, text, lim, unnest(range(1, len(string_split(text, ' ')))) as k from lm where length(text) > lim and length(text) <= 2 * lim + 1),
s as (select *, array_to_string(string_split(text, ' ')[1:k], ' ') as top, array_to_string(string_split(text, ' ')[k+1:], ' ') as bottom from k),
sc as (select *, abs(length(top) - length(bottom))::double - case when regexp_matches(top, '[.,?!;:]$') then lim * 0.25::double else 0.0 end
  + case when length(top) > length(bottom) then 2.0 else 0.0 end as score from s where length(top) <= lim and length(bottom) <= lim),
b as (select {keys}, arg_min([top, bottom], (score, k)) as two from sc group by all),
ln as (select lm.*, case when text = '' then [] when length(text) <= lim then [text] when not contains(text, ' ') then {pieces.format('text')} when two is not null then two
  else string_split(list_reduce(list_transform(string_split(text, ' '), lambda x: {word}),
    lambda y, x: case when length(string_split(y, chr(10))[-1]) + 1 + length(x) <= lim then concat(y, ' ', x) else concat(y, chr(10), x) end), chr(10)) end as w
  from lm left join b using ({keys}))
"""


LINES_SQL = lines_sql("tm", "track_id, id", f"case when language in ({quoted(K.NO_SPACE_LANGUAGES)}) then 16 else 42 end")


SRT_DOCUMENTS_SQL = f"""select track_id, count(*) as n_cues, string_agg(concat(num, chr(10), replace({clock_sql('"start"', 1000, '%02d')}, '.', ','), ' --> ',
  replace({clock_sql('"end"', 1000, '%02d')}, '.', ','), chr(10), array_to_string(w, chr(10)), chr(10)), chr(10) order by id) as document
from ln group by track_id"""


@query("write_srt", needs=("d0",), sql=TIMED_SQL + LINES_SQL + SRT_DOCUMENTS_SQL)
def q_srt(spark, sf):
    return writers.write_srt(timed(spark, sf)).select("track_id", "n_cues", "document")


@query("write_vtt", needs=("d0",), sql=TIMED_SQL + LINES_SQL + f"""
select track_id, count(*) as n_cues, concat('WEBVTT', chr(10), chr(10), string_agg(concat({clock_sql('"start"', 1000, '%02d')}, ' --> ',
  {clock_sql('"end"', 1000, '%02d')}, chr(10), replace(replace(replace(array_to_string(w, chr(10)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10)), chr(10) order by id)) as document
from ln group by track_id""")
def q_vtt(spark, sf):
    return writers.write_vtt(timed(spark, sf)).select("track_id", "n_cues", "document")


@query("write_lrc", needs=("d0",), sql=TIMED_SQL + LINES_SQL + f"""
select track_id, count(*) as n_cues, string_agg(concat('[', {clock_sql('"start"', 100, '')}, ']', text), chr(10) order by id) as document
from ln group by track_id""")
def q_lrc(spark, sf):
    return writers.write_lrc(timed(spark, sf)).select("track_id", "n_cues", "document")


@query("write_ass", needs=("d0",), sql=TIMED_SQL + LINES_SQL + f"""
select track_id, count(*) as n_cues, concat('{chr(10).join(writers.ASS_HEADER)}', chr(10), string_agg(concat('Dialogue: 0,', {clock_sql('"start"', 100, '%d')}, ',',
  {clock_sql('"end"', 100, '%d')}, ',Default,,0,0,0,,', array_to_string(w, '\\N')), chr(10) order by id)) as document
from ln group by track_id""")
def q_ass(spark, sf):
    return writers.write_ass(timed(spark, sf)).select("track_id", "n_cues", "document")


@query("write_sbv", needs=("d0",), sql=TIMED_SQL + LINES_SQL + f"""
select track_id, count(*) as n_cues, string_agg(concat({clock_sql('"start"', 1000, '%d')}, ',',
  {clock_sql('"end"', 1000, '%d')}, chr(10), array_to_string(w, chr(10)), chr(10)), chr(10) order by id) as document
from ln group by track_id""")
def q_sbv(spark, sf):
    return writers.write_sbv(timed(spark, sf)).select("track_id", "n_cues", "document")


def documents(spark, sf, fmt, cues=None):
    kept = {} if fmt == "lrc" else {"whole_words": True}      # LRC has one line a cue
    d = writers.WRITERS[fmt](timed(spark, sf) if cues is None else cues, **kept)
    return d.select(F.concat(F.lit("/tracks/"), F.col("track_id").cast("string"), F.lit("." + fmt)).alias("path"),
                    F.col("document").alias("value"))


def read_back_sql(fmt, scale):
    end = {"lrc": 'coalesce(lead(s) over (partition by track_id order by id), s + 4.0::double)'}.get(fmt, "e")
    return TIMED_SQL.rstrip().rstrip(",") + f"""
, r as (select track_id, id, num, text, round_even("start" * {scale}.0::double, 0) / {scale}.0::double as s,
  round_even("end" * {scale}.0::double, 0) / {scale}.0::double as e from tm)
select concat('/tracks/', track_id, '.{fmt}') as path, num - 1 as id, round(s, 3) as "start", round({end}, 3) as "end", text from r"""


def _read_back(spark, sf, fmt):
    return subtitles.parse(documents(spark, sf, fmt), fmt).select(
        "path", "id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


for _fmt, _scale in (("srt", 1000), ("vtt", 1000), ("sbv", 1000), ("lrc", 100), ("ass", 100)):
    query(f"read_{_fmt}", needs=("d0",), sql=read_back_sql(_fmt, _scale))(
        lambda spark, sf, fmt=_fmt: _read_back(spark, sf, fmt))


@query("read_subtitles", needs=("d0",), sql=TIMED_SQL.rstrip().rstrip(",") + """
, c as (select track_id % 4 as kind, count(*) as n from tm group by all)
select case kind when 0 then 'srt' when 1 then 'vtt' when 2 then 'broken' else 'unknown' end as kind,
  case when kind < 2 then n else (select count(distinct track_id) from tm where track_id % 4 = kind) end as n from c""")
def q_read_subtitles(spark, sf):
    """Cue counts of readable files, and counts of files rejected as broken or unknown."""
    cues = settle(timed(spark, sf), "timed")         # a track is written in the one form it is read in
    srt, vtt = documents(spark, sf, "srt", cues.where("track_id % 4 <> 1")), documents(spark, sf, "vtt", cues.where("track_id % 4 = 1"))
    num = F.regexp_extract("path", r"(\d+)\.", 1).cast("bigint") % 4
    bad = srt.where(num == 2).select("path", F.concat("value", F.lit("\n\n99\n00:00:01,000 -->\nx\n")).alias("value"))
    odd = srt.where(num == 3).select(F.regexp_replace("path", "srt$", "doc").alias("path"), "value")
    docs = settle(srt.where(num == 0).unionByName(vtt).unionByName(bad).unionByName(odd), "documents")     # told apart by extension, branch by branch
    cues, errors = subtitles.read_subtitles(docs)
    good = cues.groupBy(subtitles.extension("path").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    wrong = errors.groupBy(F.when(F.col("message").startswith("Unsupported"), "unknown").otherwise("broken").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"))
    return good.unionByName(wrong)


@query("wrap_text", sql="with tx as (select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from conversations), "
       + lines_sql("tx", "conv_id, turn", "42") + "select conv_id, turn, array_to_string(w, chr(10)) as wrapped from ln")
def q_wrap(spark, sf):
    c = t.read(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(wrap_text("text"), "\n").alias("wrapped"))


@query("wrap_balanced", needs=("d0",), sql=", tm as (select track_id, id, trim(text) as text from d0), " + lines_sql("tm", "track_id, id", "8 + id % 17")
       + "select track_id, id, array_to_string(w, chr(10)) as wrapped from ln")
def q_wrap_balanced(spark, sf):
    """Every cue at limits from 8 to 24: balanced lines, filled ones and words that are longer than a line."""
    return t.cues(spark, sf).select("track_id", "id", F.array_join(wrap_text("text", (8 + F.col("id") % 17).cast("int")), "\n").alias("wrapped"))


@query("hard_to_read", needs=("d0",), sql=TIMED_SQL + lines_sql("tm", "track_id, id", "42") + """
select track_id, count(*) filter (length(text) / ("end" - "start") > 17.0::double or len(w) > 2) as hard_cues, count(*) as n_cues from ln group by track_id""")
def q_hard(spark, sf):
    """How many cues of each track stay too fast or too tall after timing repair."""
    c = timed(spark, sf).where("trim(text) <> ''").withColumn("w", F.size(wrap_text("text")))
    fast = F.length(F.trim("text")) / (F.col("end") - F.col("start")) > 17.0
    return c.groupBy("track_id").agg(F.count_if(fast | (F.col("w") > 2)).alias("hard_cues"), F.count(F.lit(1)).alias("n_cues"))
