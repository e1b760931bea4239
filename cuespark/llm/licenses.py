"""License scans by sentence rules.

A text is cut into sentences; a sentence whose normalised form is a known licence sentence becomes
its identifier, others are passed over; rules, tried in order, take runs of identifiers out of the
sequence and name a licence. All in SQL functions, one map over the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_of

# Normalised licence sentences (lower case, everything but letters and digits a blank).
SENTENCES = {
    "released under the mit license": "MITname",
    "licensed under the mit license": "MITname",
    "this software is released under the mit license": "MITname",
    "the mit license": "MITtitle",
    "mit license": "MITtitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITperm",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITnowarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITnoliability",
    "licensed under the apache license version 2 0": "Apache2name",
    "licensed under the apache license version 2 0 the license": "Apache2name",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheAt",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheAt",
    "http www apache org licenses license 2 0": "ApacheUrl",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheBasis",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "this work is licensed under the gnu general public license version 3": "GPL3name",
    "licensed under the gnu general public license version 3": "GPL3name",
    "this work is licensed under the gnu general public license version 2": "GPL2name",
    "licensed under the gnu general public license version 2": "GPL2name",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2plus",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLnowarranty",
    "see the gnu general public license for more details": "GPLsee",
    "you should have received a copy of the gnu general public license along with this program": "GPLcopy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDperm",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "licensed under cc by nc 4 0": "CCBYNC4name",
    "licensed under cc by 4 0": "CCBY4name",
    "licensed under cc by sa 4 0": "CCBYSA4name",
    "this work is licensed under a creative commons attribution 4 0 international license": "CCBY4name",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CCBYNC4name",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CCBYSA4name",
}
# Every known sentence contains one of these; texts without any are not cut up.
TRIGGERS = ("licen", "permission", "copyright", "warrant", "redistribut")

# Rules in the order they are tried; a run of identifiers names a licence.
RULES = (
    (("MITtitle", "MITperm", "MITnotice", "MITnowarranty", "MITnoliability"), "MIT"),
    (("MITperm", "MITnotice", "MITnowarranty", "MITnoliability"), "MIT"),
    (("Apache2name", "ApacheUse", "ApacheAt", "ApacheUrl", "ApacheBasis", "ApacheSee"), "Apache-2.0"),
    (("Apache2name", "ApacheUse", "ApacheAt", "ApacheBasis", "ApacheSee"), "Apache-2.0"),
    (("GPL3plus", "GPLnowarranty", "GPLsee", "GPLcopy"), "GPL-3.0-or-later"),
    (("GPL2plus", "GPLnowarranty", "GPLsee", "GPLcopy"), "GPL-2.0-or-later"),
    (("BSDperm", "BSDsource", "BSDbinary", "BSDendorse"), "BSD-3-Clause"),
    (("BSDperm", "BSDsource", "BSDbinary"), "BSD-2-Clause"),
    (("GPL3plus",), "GPL-3.0-or-later"),
    (("GPL2plus",), "GPL-2.0-or-later"),
    (("GPL3name",), "GPL-3.0-only"),
    (("GPL2name",), "GPL-2.0-only"),
    (("Apache2name",), "Apache-2.0"),
    (("MITname",), "MIT"),
    (("CCBY4name",), "CC-BY-4.0"),
    (("CCBYNC4name",), "CC-BY-NC-4.0"),
    (("CCBYSA4name",), "CC-BY-SA-4.0"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sentence_pattern(sentences: dict[str, str]) -> str:
    """A known sentence between two marks: on one line, else over several lines of a paragraph."""
    longest = sorted(sentences, key=lambda s: (-len(s), s))
    wrapped = [s.replace(" ", "[ \\n]++") for s in longest if " " in s]
    end = r"(?= ?[S\n])"
    return rf"[S\n] ?((?:{'|'.join(longest)}){end}|(?:{'|'.join(wrapped)}){end})"


def sentence_ids(text: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order. A sentence starts and ends at a line's
    end, or at a full stop, question or exclamation mark before blanks. It may go on over the lines of a
    paragraph, with or without comment marks; a line without letters and digits ends the paragraph."""
    known = F.create_map(*[F.lit(x) for kv in sentences.items() for x in kv])
    low = F.translate(text, _UPPER, _LOWER)
    # the text is in lower case: an S marks the end of a sentence or paragraph, a line's end stays
    marked = F.concat(F.lit("S"), F.regexp_replace(low, r"[.!?](?:[ \t]|\r?\n)", "S"), F.lit("S"))
    marked = F.regexp_replace(F.regexp_replace(marked, r"\n[^a-z0-9S]*\n", "S"), r"[^a-z0-9S\n]+", " ")
    found = F.regexp_extract_all(marked, F.lit(_sentence_pattern(sentences)), F.lit(1))
    ids = F.transform(found, lambda s: known[F.regexp_replace(s, r"[ \n]+", " ")])
    none = F.expr("cast(array() as array<string>)")
    return F.when(low.rlike("|".join(TRIGGERS)), ids).otherwise(none)


def scan(docs: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules=RULES) -> DataFrame:
    """The documents' columns and sentence_ids, licenses (in rule order, each once), rest (identifiers
    that no rule took).

    A rule takes every run of its identifiers; what it took separates what stands around it. Null and
    empty texts have no sentence. Rows are judged one by one; a result replaces an input column of its name.
    """
    d = docs.withColumn("sentence_ids", sentence_ids(text_of(text), sentences or SENTENCES))
    # a rule's run is found as ",a,b,"; every identifier has its own commas, so that runs side by side are both found
    state = F.struct(F.concat(F.lit(","), F.array_join(F.transform("sentence_ids", lambda i: F.concat(i, F.lit(","))), ",")).alias("seq"),
                     F.expr("cast(array() as array<string>)").alias("found"))
    listed = F.array(*[F.struct(F.lit("," + ",,".join(ids) + ",").alias("run"), F.lit(name).alias("name")) for ids, name in rules])
    done = F.aggregate(listed, state, lambda s, r: F.when(F.contains(s["seq"], r["run"]), F.struct(
        F.replace(s["seq"], r["run"], F.lit(";")).alias("seq"),
        F.array_append(s["found"], r["name"]).alias("found"))).otherwise(s))
    end = free_name(docs, "end")
    d = d.withColumn(end, F.when(F.size("sentence_ids") == 0, state).otherwise(done))
    rest = F.filter(F.split(F.col(end)["seq"], "[,;]+"), lambda x: x != "")
    return d.withColumns({"licenses": F.array_distinct(F.col(end)["found"]), "rest": rest}).drop(end)


def scan_sql(doc: str = "doc_id", sentences: dict[str, str] | None = None, rules=RULES) -> str:
    """DuckDB SQL for doc, sequence, licenses, rest of the table `documents`."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in (sentences or SENTENCES).items())
    steps, found, last = [], [], "s0"
    for k, (ids, name) in enumerate(rules):
        run = "," + ",,".join(ids) + ","
        steps.append(f"s{k + 1} as (select *, contains(seq{k}, '{run}') as f{k}, replace(seq{k}, '{run}', ';') as seq{k + 1} from s{k})")
        before = [f"f{j}" for j in range(k) if rules[j][1] == name]
        found.append(f"case when f{k} and not ({' or '.join(before) or 'false'}) then ['{name}'] else [] end")
        last = f"s{k + 1}"
    names = found[0]
    for f in found[1:]:
        names = f"list_concat({names}, {f})"
    return f"""
with known(sentence, id) as (values {known}),
doc as (select row_number() over () as r, {doc}, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents),
cut as (select r, generate_subscripts(c, 1) as k, unnest(c) as s
        from (select r, string_split(regexp_replace(t, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) as c from doc)),
ids as (select r, k, id from cut join known on trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) = sentence),
line as (select r, string_agg(id, ',' order by k) as sequence, ',' || string_agg(id || ',', ',' order by k) as seq0 from ids group by r),
s0 as (select {doc}, coalesce(sequence, '') as sequence, coalesce(seq0, ',') as seq0 from doc left join line using (r)),
{', '.join(steps)},
named as (select *, {names} as l from {last})
select {doc}, sequence,
  array_to_string(l, ',') as licenses,
  array_to_string([x for x in regexp_split_to_array(seq{len(rules)}, '[,;]+') if x <> ''], ',') as rest
from named"""


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    return found.select(doc, F.array_join("sentence_ids", ",").alias("sequence"), F.array_join("licenses", ",").alias("licenses"),
                        F.array_join("rest", ",").alias("rest"))
