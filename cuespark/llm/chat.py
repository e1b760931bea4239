"""Chat formatting by incremental black-box rendering.

A template is a function from turns (role, text) to a string, and nothing is assumed about it.
It is asked for every prefix of a conversation. Where a longer output begins with the shorter one,
the difference is the new turn's span; where it does not, the template rewrites history, and the
place from which it did is reported. A second rendering with the new turn's text left empty shows
where inside the span the text stands: that is what a loss mask covers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

WINDOW = 32             # turns of a window
CONTEXT = 2             # turns before it that are rendered with it

# The escapes: none of the characters that control strings start with is left in an escaped text.
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "\r": "\\r"}
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}


def escape(text: str) -> str:
    return text.translate({ord(k): v for k, v in _ESCAPES.items()})


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text, flags=re.S)


def marked(turns: Sequence[Turn]) -> str:
    """The standard template: each turn between its role mark and an end mark."""
    return "".join(f"<|{escape(role)}|>\n{escape(text)}<|end|>\n" for role, text in turns)


_MARKED = re.compile(r"<\|(.*?)\|>\n([^<]*)<\|end\|>\n", re.S)


def read_marked(formatted: str) -> list[Turn]:
    """The turns of an output of `marked`."""
    return [(unescape(role), unescape(text)) for role, text in _MARKED.findall(formatted)]


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def _prefixes(turns: Sequence[Turn], template: Template, given: int = 0) -> tuple[str, list[dict]]:
    """The output for all turns, and where each turn behind the `given` ones stands in it."""
    before, found = template(turns[:given]), []
    for k in range(given, len(turns)):
        role, after = turns[k][0], template(turns[:k + 1])
        start = len(before) if after.startswith(before) else _common(before, after)
        bare = template([*turns[:k], (role, "")])
        head = _common(after, bare)
        tail = len(bare) - head
        if len(after) - tail < head or after[len(after) - tail:] != bare[head:]:
            tail = _common(after[head:][::-1], bare[head:][::-1])
        found.append({"start": start, "end": len(after), "text_start": head, "text_end": len(after) - tail,
                      "rewrites": start < len(before)})
        before = after
    return before, found


def _by_windows(turns: Sequence[Turn], template: Template, window: int) -> tuple[str, list[dict]] | None:
    """As _prefixes, from windows of turns with CONTEXT turns before them; None if that doesn't give the whole output."""
    parts, found, length = [], [], 0
    for a in range(0, len(turns), window):
        lead = turns[max(0, a - CONTEXT):a]
        out, spans = _prefixes([*lead, *turns[a:a + window]], template, len(lead))
        if any(s["rewrites"] for s in spans):
            return None
        first = len(template(lead)) if a else 0
        found += [{k: v if k == "rewrites" else v - first + length for k, v in s.items()} for s in spans]
        parts.append(out[first:])
        length += len(parts[-1])
    whole = "".join(parts)
    return (whole, found) if whole == template(turns) else None


def trace(turns: Sequence[Turn], template: Template, window: int = WINDOW) -> tuple[str, list[dict]]:
    """The output for all turns, and for each turn its span, its text's span and whether it rewrote.

    start, end: what the turn added to the output before it (from the first changed character if
    earlier output was rewritten). text_start, text_end: the turn's text, in the same output.
    rewrites: the output before isn't a prefix of the output with this turn; spans found earlier
    then hold only up to `start`.

    Prefixes of a long conversation cost the square of its turns. So they are rendered in windows
    of turns first; where the windows rewrite nothing and their additions make up exactly the
    output for all turns, they are the answer, else every prefix is rendered whole.
    """
    done = _by_windows(turns, template, window) if len(turns) > window else None
    return done or _prefixes(turns, template)


SPANS = "array<struct<role:string,start:int,end:int,text_start:int,text_end:int,rewrites:boolean>>"


def format_chats(turns: DataFrame, template: Template = marked, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """conv, formatted, spans (in code points), rewrites: one row for each conversation.

    Turns are ordered by number, then role, then text; equal rows are turns of their own. Null roles
    and texts count as empty; rows without conversation are one conversation. Other columns are not
    looked at. A conversation is one row and is rendered in one task.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(conv).alias(conv)).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    chats = chats.select(conv, F.transform("turns", lambda t: t["role"]).alias("roles"),
                         F.transform("turns", lambda t: t["text"]).alias("texts"))
    key = turns.schema[conv].dataType.simpleString()

    def run(batches):
        for batch in batches:
            formatted, spans, rewrites = [], [], []
            for roles, texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist()):
                out, found = trace(list(zip(roles, texts)), template)
                formatted.append(out)
                spans.append([{"role": r, **f} for r, f in zip(roles, found)])
                rewrites.append(any(f["rewrites"] for f in found))
            kind = pa.list_(pa.struct([("role", pa.string()), *((n, pa.int32()) for n in ("start", "end", "text_start", "text_end")),
                                       ("rewrites", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(conv), pa.array(formatted, pa.string()), pa.array(spans, kind), pa.array(rewrites, pa.bool_())],
                names=[conv, "formatted", "spans", "rewrites"])

    return chats.mapInArrow(run, f"`{conv}` {key}, formatted string, spans {SPANS}, rewrites boolean")


def read_back(formatted: DataFrame, conv: str = "conv_id", trained: str = "assistant") -> DataFrame:
    """conv, turns (read from the output of `marked`), loss (unescaped text under the mask), formatted_chars."""
    key = formatted.schema[conv].dataType.simpleString()

    def run(batches):
        for batch in batches:
            outs = batch.column("formatted").to_pylist()
            turns = [[{"role": r, "text": t} for r, t in read_marked(x)] for x in outs]
            loss = ["".join(unescape(x[s["text_start"]:s["text_end"]]) for s in spans if s["role"] == trained)
                    for x, spans in zip(outs, batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(conv), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                 pa.array(loss, pa.string()), pa.array([len(x) for x in outs], pa.int64())],
                names=[conv, "turns", "loss", "formatted_chars"])

    return formatted.mapInArrow(run, f"`{conv}` {key}, turns array<struct<role:string,text:string>>, loss string, formatted_chars bigint")


def digest(read: DataFrame, conv: str = "conv_id") -> DataFrame:
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
