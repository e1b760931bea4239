"""Sentence units: which cues are translated or spoken together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.spread import distribute_text, spread_parts
from ..functions.text import ends_sentence, is_no_space, trim_ws
from ..session import key_type, settle
from .ordered import BLK, BLOCK, attach, blocked, ordered, runs
from .timing import joined_text


def sentence_islands(cues: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add `island`: the first cue id between hard breaks (a sentence end, a pause over two seconds)."""
    return runs(
        cues, {"ends": ends_sentence("text"), "start": F.col("start"), "end": F.col("end")},
        lambda prev, cur: prev("ends") | ((cur("start") - prev("end")) > K.UNIT_MAX_GAP_SECONDS),
        "island", block=block)


def _next_start(lengths: np.ndarray, limit: int) -> np.ndarray:
    """For every cue as the first of a unit, the index of the cue that starts the next unit.

    A unit holding cues i..j-1 takes cue j as well unless its length so far, one separator per
    cue included, plus the cue is over the limit. `len(lengths)` means: not in this block.
    """
    n = len(lengths)
    used = np.concatenate([[0], np.cumsum(lengths + 1)])      # used[j]: length before cue j
    need = used[:-1] + lengths                                 # non-decreasing in j
    nxt = np.searchsorted(need, used[:-1] + limit, side="right")
    return np.minimum(np.maximum(nxt, np.arange(1, n + 1)), n)


def _block_maps(limit: int):
    """Per (island, block): where a unit that is open at the block's edge would go on.

    The only thing a block needs to know about the past is how much of the open unit is used
    up, and that decides which of its first cues starts the next unit. So the block is
    summarized by: the entry cue -> the unit open when the block ends, and its length. A unit
    holds at most limit + 1 cues, hence at most limit + 2 entries, whatever the block's size.
    """
    def fn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy(np.int64)
        ln = pdf["n"].to_numpy(np.int64)
        n = len(ln)
        used = np.concatenate([[0], np.cumsum(ln + 1)])
        nxt = _next_start(ln, limit)
        last = np.arange(n)                                    # last unit start reachable from i
        for i in range(n - 1, -1, -1):
            if nxt[i] < n:
                last[i] = last[nxt[i]]
        m = min(n, limit + 2)
        return pd.DataFrame([{
            "track_id": key[0], "island": key[1], BLK: key[2],
            "need": (used[:m] + ln[:m]).tolist(), "open_len": (used[n] - used[last])[:m].tolist(),
            "open_id": ids[last][:m].tolist(), "total": int(used[n])}])
    return fn


def _chain(limit: int):
    """Walk the block summaries of one island in order; give each block the unit open at its edge."""
    def fn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLK)
        opened, unit, out = 0, -1, []
        for need, open_len, open_id, total in zip(pdf["need"], pdf["open_len"], pdf["open_id"], pdf["total"]):
            out.append((opened, unit))
            e = int(np.searchsorted(np.asarray(need), limit - opened, side="right")) if opened else 0
            if e < len(open_len):
                opened, unit = int(open_len[e]), int(open_id[e])
            else:
                opened += int(total)
        return pd.DataFrame({"track_id": key[0], "island": key[1], BLK: pdf[BLK].to_numpy(),
                             "opened": [o for o, _ in out], "open_unit": [u for _, u in out]})
    return fn


def _pack(limit: int):
    """The unit of every cue, for cues sorted by (track, island, block, id); a block starts with the
    unit that is open at its edge."""
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used, unit = None, 0, -1
        for pdf in batches:
            out = []
            cols = [pdf[c].tolist() for c in ("track_id", "island", BLK, "id", "n", "opened", "open_unit")]
            for track, island, blk, cue, n, opened, open_unit in zip(*cols):
                if (track, island, blk) != key:
                    key, used, unit = (track, island, blk), opened, open_unit
                if used == 0 or used + n > limit:
                    used, unit = 0, cue
                used += n + 1
                out.append(unit)
            yield pd.DataFrame({"track_id": pdf["track_id"], "id": pdf["id"], "unit_id": out})
    return fn


def sentence_units(cues: DataFrame, *, max_chars: int = K.UNIT_MAX_CHARS, block: int = BLOCK) -> DataFrame:
    """Add `unit_id`, the id of the first cue of the sentence unit every cue belongs to.

    Islands between hard breaks that fit the length limit are units as they are. Longer islands
    are packed first-fit. That packing depends on where it began, so if an island has several
    blocks, they are summarized in parallel, the summaries (one row per block) are chained, and
    the blocks are packed in parallel: no island is ever gathered in one task. The islands are written to the
    shared folder once, since several branches read them.
    """
    columns, kt = cues.columns, key_type(cues)
    c = settle(sentence_islands(cues, block).withColumn("_n", F.length("text").cast("bigint")), "islands")
    c = blocked(c, "id", block)
    spots = c.groupBy("track_id", "island", BLK).agg(
        F.sum(F.col("_n") + 1).alias("_tot"), F.count(F.lit(1)).alias("_cnt"))
    whole = Window.partitionBy("track_id", "island")
    spots = spots.select("track_id", "island", BLK, (
        (F.sum("_tot").over(whole) - 1 > max_chars) & (F.sum("_cnt").over(whole) > 1)).alias("_long"),
        (F.count(F.lit(1)).over(whole) > 1).alias("_multi"))
    c = c.join(spots, ["track_id", "island", BLK])
    parts = c.where("_long").select("track_id", "id", "island", BLK, "_multi", F.col("_n").alias("n"))
    maps = parts.where("_multi").groupBy("track_id", "island", BLK).applyInPandas(
        _block_maps(max_chars), f"track_id {kt}, island long, {BLK} long, need array<long>, "
                                "open_len array<long>, open_id array<long>, total long")
    entry = maps.groupBy("track_id", "island").applyInPandas(
        _chain(max_chars), f"track_id {kt}, island long, {BLK} long, opened long, open_unit long")
    parts = parts.join(entry, ["track_id", "island", BLK], "left").withColumns({
        "opened": F.coalesce("opened", F.lit(0)), "open_unit": F.coalesce("open_unit", F.lit(-1))})
    parts = parts.repartition("track_id", "island", BLK).sortWithinPartitions("track_id", "island", BLK, "id")
    packed = parts.mapInPandas(_pack(max_chars), f"track_id {kt}, id long, unit_id long")
    packed = blocked(packed, "id", block).withColumnRenamed("unit_id", "_packed")
    c = c.join(packed, ["track_id", BLK, "id"], "left")
    return c.select(*columns, F.coalesce("_packed", "island").alias("unit_id"))


def join_units(members: DataFrame, language: str = "language") -> DataFrame:
    """One row per unit: member ids, times, and the joined text.

    A unit is bounded (its texts stop at the length limit, one cue over at most), so its cues
    may be collected.
    """
    rows = members.groupBy("track_id", "unit_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "start", "end", "text"))).alias("members"),
        F.min(language).alias("language"))
    texts = F.transform("members", lambda m: F.struct(m["id"].alias("id"), m["text"].alias("text")))
    return rows.select(
        "track_id", "unit_id", "members", F.transform("members", lambda m: m["id"]).alias("member_ids"),
        F.element_at("members", 1)["start"].alias("start"), F.element_at("members", -1)["end"].alias("end"),
        joined_text(texts, is_no_space("language")).alias("text"), "language")


def spoken_units(cues: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Add `line_id`: blank cues go, and a sentence is split where the speaker changes.

    Takes cues with `unit_id`; the line is named by its first cue.
    """
    return runs(
        cues.where(trim_ws("text") != ""), {"unit": F.col("unit_id"), "speaker": F.col(speaker)},
        lambda prev, cur: (prev("unit") != cur("unit")) | (prev("speaker") != cur("speaker")), "line_id")


def spoken_lines(cues: DataFrame, speaker: str = "speaker") -> DataFrame:
    """One row per line to speak: first cue, start, end, speaker and joined text."""
    c = spoken_units(cues, speaker)
    rows = c.groupBy("track_id", "line_id").agg(
        F.collect_list(F.struct("id", "text")).alias("_m"), F.min_by("start", "id").alias("start"),
        F.max_by("end", "id").alias("end"), F.min_by(speaker, "id").alias("speaker"),
        F.min("language").alias("language"))
    return rows.select("track_id", "line_id", "start", "end", "speaker", "language",
                       joined_text(F.col("_m"), is_no_space("language")).alias("text"))


def slot_ends(lines: DataFrame, media_end=None) -> DataFrame:
    """Add `slot_end`: where the next line starts, or one second after the last, within the media."""
    out = ordered(lines, lead={"_nx": F.col("start")}, order="line_id")
    last = F.col("end") + K.LAST_CUE_TAIL_SECONDS
    if media_end is not None:
        end = media_end if not isinstance(media_end, (int, float)) else F.lit(float(media_end))
        last = F.least(last, end)
    return out.withColumn("slot_end", F.coalesce("_nx", last)).drop("_nx")


def spread_translation(units: DataFrame, target_lang: str | None = None) -> DataFrame:
    """Share each unit's `translated` text over its cues, by the length of their texts."""
    lang = F.lit(target_lang) if target_lang is not None else F.col("target_lang")
    weights = F.transform("members", lambda m: F.greatest(F.length(m["text"]), F.lit(1)).cast("bigint"))
    u = units.withColumn("_parts", distribute_text("translated", weights, is_no_space(lang)))
    u = u.select("track_id", "unit_id", lang.alias("language"),
                 F.explode(spread_parts(F.col("members"), F.col("_parts"))).alias("p"))
    return u.select("track_id", "unit_id", "p.*", "language")


__all__ = ["sentence_islands", "sentence_units", "join_units", "spoken_units", "spoken_lines",
           "slot_ends", "spread_translation", "attach"]
