"""One query per operator, each over its whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (chat, decontaminate, katz_trigrams, langid, licenses, mixing, neardup, negatives, phrases, pii, quality, tokens,
               urls)
from .common import crc_remainder, table
from .registry import ORACLES, QUERIES, query  # noqa: F401

CONTAMINATED_SQL = r"""
with doc as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
item as (
  select cast(item_id as varchar) as item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
pattern as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as p
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from item where len(w) > 0)),
place as (
  select r, n, i, array_to_string(w[i:i + n - 1], ' ') as p
  from (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as i
        from doc, (select distinct n from pattern) where len(w) >= n)),
hit as (select r, i, place.n, item_id from place join pattern using (n, p)),
word as (select r, count(distinct k) as n_hit from (select r, unnest(generate_series(i, i + n - 1)) as k from hit) group by r),
named as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names
  from (select distinct r, item_id from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join word using (r) left join named using (r)
"""


@query("op10_decontaminate", CONTAMINATED_SQL)
def op10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_items(docs, table(spark, sf, "benchmark")))


@query("op5_mix")
def op5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_langid")
def op4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op9_neardup")
def op9(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@query("op8_quality")
def op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "kept")


@query("op7_pii")
def op7(spark, sf):
    return pii.digest(pii.find(table(spark, sf, "documents").select("doc_id", "text")))


@query("op1_licenses", licenses.scan_sql())
def op1(spark, sf):
    return licenses.digest(licenses.scan(table(spark, sf, "documents").select("doc_id", "text")))


CHAT_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(role) + length(regexp_replace(role, '[^\\<\[\r]', '', 'g')) + length(text)
        + length(regexp_replace(text, '[^\\<\[\r]', '', 'g')) + 13 as chars from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from e group by conv_id
"""


@query("op2_chat", CHAT_SQL)
def op2(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest(chat.read_back(chat.format_chats(turns.unionByName(extra))))


URL_RULES = [urls.Rule("org", "/", "allow"), urls.Rule("example.org", "/es/", "block"), urls.Rule("example.org", "/en/1", "block"),
             urls.Rule("com", "/fr/", "allow"), urls.Rule("com", "/de/", "block")]
# Hosts with these words are bad examples for the templates; on other hosts the page itself tells.
BAD_HOSTS = r"(?:^|[.-])(?:casino|bets|pills|spam|adult|ads)(?:[.-]|$)"


@query("op3_urls")
def op3(spark, sf):
    label = (F.when(F.col("ruled") == "allow", True).when((F.col("ruled") == "block") | F.col("host").rlike(BAD_HOSTS), False)
             .otherwise(urls.page_evidence(F.col("html"))))
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return urls.filter_urls(pages, URL_RULES, label).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query("op6_katz")
def op6(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = crc_remainder(F.col("doc_id"), 10) == 0
    model = katz_trigrams.train(docs.where(~out))
    return katz_trigrams.score(docs, model).select("doc_id", out.alias("held_out"), "n_tokens", "n_known",
                                          F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op12_tokens")
def op12(spark, sf):
    """Fills a cache of its own, so that every run encodes all distinct texts."""
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), keep_text=False)


@query("op11_phrases", phrases.mine_sql())
def op11(spark, sf):
    return phrases.mine(table(spark, sf, "documents").select("lang", "text"))


@query("op13_negatives", negatives.mine_sql())
def op13(spark, sf):
    return negatives.mine(table(spark, sf, "embeddings"))
