"""The derivations of tables.py, and pieces shared by several checks, as DuckDB SQL."""

from __future__ import annotations

from .. import constants as K

END = "[.?!…。？！؟۔।]"


def quoted(items) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in items)


def ends_sentence_sql(text: str) -> str:
    """ends_sentence in SQL."""
    t = f"regexp_replace(regexp_replace({text}, '\\s+$', ''), '[\"'')\\]}}”’»]+$', '')"
    w = f"regexp_replace(regexp_extract({t}, '(\\S+)\\.$', 1), '^[(\"''“‘«]+', '')"
    return (f"(regexp_matches({t}, '{END}$') and ({t} like '%..' or not (lower({w}) in ({quoted(K.ABBREVIATIONS)}) "
            f"or (regexp_matches({w}, '^\\p{{Lu}}$') and {w} not in ('I', 'A')))))")


TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "d0": ((), r"""d0t as (
  select conv_id, turn, role, string_split(trim(regexp_replace(text, '[ \n\t]+', ' ', 'g')), ' ') as tk from conversations),
d0k as (
  select conv_id as track_id, turn * 1000 + k as id, role, array_to_string(tk[k * 5 + 1 : k * 5 + 5], ' ') as text
  from (select *, unnest(range(0, (len(tk) - 1) // 5 + 1)) as k from d0t)),
d0g as (
  select *, greatest(200, length(text) * 40) as dur,
    case when id % 5 = 4 then 2500 when id % 3 = 1 then 0 else 120 end as gap from d0k),
d0s as (
  select *, coalesce(sum(dur + gap) over (partition by track_id order by id rows between unbounded preceding and 1 preceding), 0)::bigint as start_ms
  from d0g),
d0 as (
  select track_id, id, start_ms / 1000.0 as "start", (start_ms + dur + case when id % 4 = 2 then 700 else 0 end) / 1000.0 as "end", text,
    case track_id % 3 when 0 then 'en' when 1 then 'fr' else 'ja' end as language,
    case role when 'user' then 0 when 'assistant' then 1 else 2 end as speaker,
    start_ms, start_ms + dur + case when id % 4 = 2 then 700 else 0 end as end_ms
  from d0s)"""),
    "d2": ((), """d2 as (
  select vec_id // 400 as track_id, vec_id % 400 as id, (vec_id % 400) * 4000 as start_ms,
    (vec_id % 400) * 4000 + 600 + (vec_id * 37) % 3000 as end_ms,
    ((vec_id % 400) * 4000) / 1000.0 as "start", ((vec_id % 400) * 4000 + 600 + (vec_id * 37) % 3000) / 1000.0 as "end",
    list_transform(range(0, len(embedding)), lambda i: embedding[i + 1]::double * 2.4 + case when i = label then 4.0 else 0.0 end) as vector,
    label as voice from embeddings)"""),
    "d3": ((), """d3 as (
  select item_id as sentence_id, target, cand_ix, text as source_text,
    case cand_ix when 0 then text when 1 then left(text, length(text) // 4) when 2 then lower(text) else repeat(text, 4) end as text,
    ((item_id * 31 + cand_ix * 17) % 100) / 100.0 as score
  from benchmark, (select unnest(['ur', 'fr']) as target) t, (select unnest(range(0, 4)) as cand_ix) c)"""),
    "d4": ((), """d4 as (
  select user_id as track_id, row_number() over (partition by user_id order by event_id) - 1 as ms, value * value as sumsq, 1 as n
  from events)"""),
    "d5": ((), """d5r as (
  select user_id as job, event_id as seq, ts, event_type, row_number() over (partition by user_id order by event_id) - 1 as rank from events),
d5 as (
  select job, seq, ts, case event_type when 'view' then 'status' when 'click' then 'progress'
      when 'purchase' then 'segment' when 'signup' then 'finished' else 'error' end as event,
    least(3, rank // 20) as step, 4 as steps, seq % 100 as done, case when seq % 37 = 0 then 0 else 100 end as total,
    seq % 25 as cue, concat('message ', (seq % 7)::varchar) as message
  from d5r)"""),
    "d6": ((), """d6 as (
  select doc_id // 40 as track_id, doc_id as line_no, attempt,
    ((doc_id * 7919 + attempt * 104729) % 100) / 100.0 as error,
    length(text) * (1000 + 700 * ((doc_id + attempt * 13) % 8)) + 12000 as n_samples, length(text) as n_chars,
    (doc_id + attempt) % 3 = 0 as sped_up, (doc_id + attempt) % 11 = 0 as trimmed, (doc_id + attempt) % 7 = 0 as ran_on
  from documents, (select unnest(range(0, 3)) as attempt) a)"""),
    "d7": ((), """d7 as (
  select conv_id * 1000 + turn as clip_id,
    (['native', 'alpha', 'beta', 'gamma', 'delta'])[conv_id % 5 + 1] as engine, (['en', 'fr', 'de'])[turn % 3 + 1] as language,
    case role when 'user' then 'FEMALE' when 'assistant' then 'MALE' else 'OTHER' end as gender,
    text as ref,
    case when (conv_id + turn) % 7 = 0 then concat(text, ' ', text) when (conv_id + turn) % 11 = 0 then '' else replace(text, 'e', '') end as hyp,
    length(text) * 11 as work_ms, length(text) * 70 + conv_id % 13 as audio_ms,
    case when conv_id % 5 = 0 then null else ((conv_id * 17 + turn * 5) % 100) / 100.0 end as similarity
  from conversations)"""),
    "d8": ((), """d8 as (
  select page_id as file_id,
    concat(case when page_id % 4 < 2 then '/lib/d' else '/lib/./d' end, (page_id // 2) % 7, '/clip', (page_id // 2) % 1000,
      case when page_id % 11 = 0 then '.txt' when page_id % 2 = 1 then '_en.SRT' when page_id % 6 = 0 then '.mp3' else '.mp4' end) as path,
    length(html) as bytes, (['pending', 'done', 'error', 'done'])[page_id % 4 + 1] as status,
    case when page_id % 5 = 0 then 'ur' else '' end as chosen_language
  from pages)"""),
    # sentence islands of cues: a break after a cue that ends a sentence or before a long gap
    "islands": (("d0",), f"""isl0 as (
  select *, case when lag(id) over w is null then 1 when lag({ends_sentence_sql('text')}) over w or "start" - lag("end") over w > 2.0 then 1 else 0 end as hard
  from d0 window w as (partition by track_id order by id)),
islands as (
  select *, max(case when hard = 1 then id end) over (partition by track_id order by id) as island from isl0)"""),
}


def with_clause(needs) -> str:
    seen: list[str] = []

    def visit(name):
        for dep in TABLES[name][0]:
            visit(dep)
        if name not in seen:
            seen.append(name)

    for n in needs:
        visit(n)
    if not seen:
        return ""
    return "with recursive " + ",\n".join(TABLES[n][1] for n in seen) + "\n"
