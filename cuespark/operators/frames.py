"""Signal energy per millisecond: silence, pauses, edges and clips.

A frame row is (track_id, ms, sumsq, n): the sum of squares and the number of samples of one
millisecond. Frames are the longest ordered tracks of all, so everything here works block by
block with a halo: rows near a block's edge are also sent to the block next door, and no step
gathers a track.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import constants as K
from ..session import key_type
from .ordered import ordered

FULL_SCALE = 32768.0
BLOCK_MS = 65536


def frame_energy(samples: DataFrame, rate: int = 16000) -> DataFrame:
    """Sum of squares per millisecond of samples in -1..1, in 16-bit units, clipped.

    Millisecond k holds the samples from k * rate / 1000 to (k + 1) * rate / 1000, both rounded down;
    one that lacks samples, as the last of a track may, is left out.
    """
    x = F.least(F.greatest(F.col("x") * FULL_SCALE, F.lit(-32768.0)), F.lit(32767.0))
    ms = F.expr(f"((i + 1) * 1000 + {rate} - 1) div {rate} - 1")
    whole = F.expr(f"(ms + 1) * {rate} div 1000 - ms * {rate} div 1000")
    f = samples.groupBy("track_id", ms.alias("ms")).agg(F.sum(x * x).alias("sumsq"), F.count(F.lit(1)).alias("n"))
    return f.where(F.col("n") >= whole)


def track_lengths(frames: DataFrame) -> DataFrame:
    return frames.groupBy("track_id").agg((F.max("ms") + 1).alias("length"))


def db_level(db: float) -> float:
    return 10 ** (db / 20) * FULL_SCALE


def _silent_starts(sumsq: np.ndarray, n: np.ndarray, least: int, threshold: float) -> np.ndarray:
    """For every start whose window of `least` ms lies within the arrays: whether its RMS is at or below the threshold.

    Prefix sums of whole numbers: squares are scaled by the power of two that just keeps their total within 62 bits, so
    windows are differences without loss, and whole-number squares stay exact.
    """
    total = float(sumsq.sum())
    scale = 2.0 ** (61 - max(0, math.ceil(math.log2(total + 1))))
    squares = np.concatenate([[0], np.cumsum(np.rint(sumsq * scale).astype(np.int64))])
    samples = np.concatenate([[0], np.cumsum(n.astype(np.int64))])
    ss, sn = squares[least:] - squares[:-least], samples[least:] - samples[:-least]
    return np.sqrt(ss / scale / np.maximum(sn, 1)) <= threshold


def _block_silences(least: int, threshold: float, step: int, block_ms: int, schema: pa.Schema):
    """One row per block of rows sorted by (track, block, ms): its silent starts, joined as far as the block goes."""
    def summary(track, block: int, ms: np.ndarray, sumsq: np.ndarray, n: np.ndarray) -> tuple:
        first = block * block_ms
        size = int(ms[-1]) - first + 1
        dense, counts = np.zeros(size), np.zeros(size, np.int64)
        np.add.at(dense, ms - first, sumsq)
        np.add.at(counts, ms - first, n)
        starts, last = np.zeros(0, np.int64), None
        if size >= least:
            silent = np.flatnonzero(_silent_starts(dense, counts, least, threshold))
            silent = silent[silent < block_ms]
            at_end = size - least
            if len(silent) and silent[-1] == at_end and (first + at_end) % step:
                last = first + at_end                       # counts only if the track ends with these frames
            starts = silent[(first + silent) % step == 0] + first
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1] + step) & (starts[1:] > starts[:-1] + least)
        edges = np.flatnonzero(new)
        ends = np.append(edges[1:], len(starts)) - 1 if len(edges) else edges
        return track, block, int(ms[-1]), last, [{"first": int(starts[i]), "last": int(starts[j])} for i, j in zip(edges, ends)]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        def close() -> tuple:
            return summary(*key, *(np.concatenate(c) for c in zip(*held)))

        for batch in batches:
            tracks, blocks = batch.column("track_id").to_pylist(), batch.column("_b").to_numpy()
            columns = [batch.column(c).to_numpy() for c in ("ms", "sumsq", "n")]
            done, at = [], 0
            while at < len(tracks):
                now, to = (tracks[at], int(blocks[at])), at + 1
                if now == (tracks[-1], int(blocks[-1])):
                    to = len(tracks)
                else:
                    while (tracks[to], blocks[to]) == now:
                        to += 1
                if key is not None and now != key:
                    done.append(close())
                    held = []
                key = now
                held.append([c[at:to] for c in columns])
                at = to
            yield table(done)
        if key is not None:
            yield table([close()])

    return fn


def _blocks(frames: DataFrame, least: int, threshold: float, step: int) -> DataFrame:
    """Per block of a track: its joined silent starts `r` (first, last), the starts before it, and the track's length.

    One scan of the frames. A frame within a window's reach of a block's edge is also sent to the blocks before; what
    crosses edges comes from a window over the blocks, one row each.
    """
    f = frames.select("track_id", F.col("ms").cast("bigint").alias("ms"), F.col("sumsq").cast("double").alias("sumsq"), F.col("n").cast("bigint").alias("n"))
    blk, reach = (F.expr(f"(ms - {k}) div {BLOCK_MS}") for k in (0, least - 1))
    f = f.withColumn("_b", F.explode(F.sequence(F.greatest(F.when(F.col("ms") < least - 1, 0).otherwise(reach), F.lit(0)), blk)))
    f = f.repartition("track_id", "_b").sortWithinPartitions("track_id", "_b", "ms")
    schema = T._parse_datatype_string(f"track_id {key_type(frames)}, _b bigint, seen bigint, tail bigint, r array<struct<first:bigint,last:bigint>>")
    d = f.mapInArrow(_block_silences(least, threshold, step, BLOCK_MS, to_arrow_schema(schema)), schema)
    track = Window.partitionBy("track_id")
    # the last start of the track counts off the step, too
    d = d.withColumn("length", F.max("seen").over(track) + 1)
    tail = F.when((F.col("seen") + 1 == F.col("length")) & F.col("tail").isNotNull(), F.col("tail"))
    last = F.try_element_at("r", F.lit(-1))
    goes_on = (tail == last["last"] + step) | (tail <= last["last"] + least)
    longer = F.concat(F.slice("r", F.lit(1), F.greatest(F.size("r") - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), tail.alias("last"))))
    d = d.withColumn("r", F.when(tail.isNull(), F.col("r")).when((F.size("r") > 0) & goes_on, longer).otherwise(
        F.concat("r", F.array(F.struct(tail.alias("first"), tail.alias("last"))))))
    along = track.orderBy("_b")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("head", F.try_element_at("r", F.lit(1))["first"]).withColumn("end_", F.try_element_at("r", F.lit(-1))["last"])
    d = d.withColumn("prev", F.last("end_", ignorenulls=True).over(before)).withColumn("final", F.lead("_b").over(along).isNull())
    joined = F.col("prev").isNotNull() & ((F.col("head") == F.col("prev") + step) | (F.col("head") <= F.col("prev") + least))
    d = d.withColumn("joined", F.coalesce(joined, F.lit(False)))
    opened = F.when((F.size("r") > 1) | ~F.col("joined"), F.try_element_at("r", F.lit(-1))["first"])
    return d.withColumn("open", F.last(opened, ignorenulls=True).over(before)).select("track_id", "_b", "r", "prev", "joined", "open", "final", "length")


def silence_ranges(frames: DataFrame, min_ms: int, threshold: float, step: int = 1) -> DataFrame:
    """Silent ranges (track_id, start, end): windows of `min_ms` at or below the RMS threshold, joined.

    Windows start at every multiple of `step` and at the last start. A start goes on with the range unless it is neither
    the next step nor inside the last window. A window is a stretch of time: a missing frame holds no samples, and a
    window without any is silent (of a block of 65,536 ms without any frame nothing is known, it has no silence).
    """
    d = _blocks(frames, min_ms, threshold, step)
    first = F.struct(F.col("open").alias("first"), F.try_element_at("r", F.lit(1))["last"].alias("last"))
    own = F.when(F.col("joined"), F.concat(F.array(first), F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))))).otherwise(F.col("r"))
    s = d.select("track_id", F.explode(own).alias("x"))
    return s.groupBy("track_id", F.col("x.first").alias("start")).agg((F.max("x.last") + min_ms).alias("end"))


def sounding_ranges(frames: DataFrame, min_ms: int, threshold: float, step: int = 1, silent_tracks: bool = False) -> DataFrame:
    """What is left of every track between its silences: (track_id, start, end, length), from one scan of the frames.

    A wholly silent track has none, or with `silent_tracks` one row without start and end.
    """
    d = _blocks(frames, min_ms, threshold, step)
    none = F.lit(None).cast("bigint")

    def span(start, end):
        return F.struct(start.alias("start"), end.alias("end"))

    begins = F.transform("r", lambda x: x["first"])
    ends = F.concat(F.array(F.col("prev") + min_ms), F.transform("r", lambda x: x["last"] + min_ms))
    gaps = F.transform(begins, lambda x, i: span(F.coalesce(F.get(ends, i), F.lit(0).cast("bigint")), x))
    gaps = F.when(F.col("joined"), F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0)))).otherwise(gaps)
    rest = span(F.coalesce(F.try_element_at("r", F.lit(-1))["last"] + min_ms, F.col("prev") + min_ms, F.lit(0).cast("bigint")), F.col("length"))
    gaps = F.filter(F.concat(gaps, F.when(F.col("final"), F.array(rest)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))),
                    lambda x: x["start"] < x["end"])
    if silent_tracks:
        # only a block that is its track's last and lies in a silence from 0 can tell that there was no sound
        whole = F.col("final") & (F.coalesce(F.when(F.col("joined") & (F.size("r") == 1), F.col("open")), F.when(F.size("r") == 1, F.col("r")[0]["first"]),
                                             F.when(F.size("r") == 0, F.col("open"))) == 0) & (F.size(gaps) == 0)
        gaps = F.when(whole, F.array(span(none, none))).otherwise(gaps)
    return d.select("track_id", "length", F.explode(gaps).alias("x")).select("track_id", "x.start", "x.end", "length")


def nonsilent_ranges(silences: DataFrame, lengths: DataFrame) -> DataFrame:
    """What is left of [0, length] between silences of one's own; nothing for a wholly silent track.

    `sounding_ranges` gives the same for those of silence_ranges without reading the frames again.
    """
    s = ordered(silences, lag={"_pe": F.col("end")}, order="start")
    head = s.select("track_id", F.coalesce("_pe", F.lit(0)).alias("s"), F.col("start").alias("e"), F.col("_pe").isNull().alias("_first"))
    head = head.where(~(F.col("_first") & (F.col("e") == 0))).drop("_first")
    last = silences.groupBy("track_id").agg(F.max("end").alias("_last"), F.min("start").alias("_begin"))
    tail = lengths.join(last, "track_id", "left").where(F.col("_last").isNull() | (F.col("_last") != F.col("length")))
    tail = tail.select("track_id", F.coalesce("_last", F.lit(0)).alias("s"), F.col("length").alias("e"))
    return head.unionByName(tail).select("track_id", F.col("s").alias("start"), F.col("e").alias("end"))


def keep_ranges(ranges: DataFrame, mid_ms: int, lengths: DataFrame | None = None) -> DataFrame:
    """Widen the sounding ranges by `mid_ms`, within the track; neighbours that then overlap meet in the middle.

    `ranges` has its track's `length`, as sounding_ranges gives it, or `lengths` has (track_id, length).

    The middle is between one range's own end and the next one's own start, neither of which an
    earlier meeting moves, so every boundary depends on two neighbours only.
    """
    if lengths is not None:
        ranges = ranges.drop("length").join(lengths, "track_id")
    r = ranges.select("track_id", "start", (F.col("start") - mid_ms).alias("_s"), (F.col("end") + mid_ms).alias("_e"), "length")
    r = ordered(r, lead={"_ns": F.col("_s")}, lag={"_pe": F.col("_e")}, order="start")
    start = F.when(F.col("_pe") > F.col("_s"), F.floor((F.col("_pe") + F.col("_s")) / 2)).otherwise(F.col("_s"))
    end = F.when(F.col("_ns") < F.col("_e"), F.floor((F.col("_e") + F.col("_ns")) / 2)).otherwise(F.col("_e"))
    return r.select("track_id", F.greatest(start.cast("bigint"), F.lit(0).cast("bigint")).alias("start"), F.least(end.cast("bigint"), "length").alias("end"))


def trim_edges(frames: DataFrame, threshold: float, lead_ms: int = 100, trail_ms: int = 300, chunk: int = 10) -> DataFrame:
    """What remains of a track without its quiet edges: (track_id, start, end) in ms, from two scans of the frames.

    Chunks are counted from each end; `lead_ms` and `trail_ms` of the quiet stay. Chunks from the
    end are counted on what the first cut leaves.
    """
    def loud_chunk(rows: DataFrame, at: Column, *more: str) -> DataFrame:
        """The first loud chunk, and the last ms, of every track."""
        c = rows.groupBy("track_id", *more, F.floor(at / chunk).alias("_c")).agg(
            F.sum("sumsq").alias("ss"), F.sum("n").alias("sn"), F.max("ms").alias("_ms"))
        loud = F.sqrt(F.col("ss") / F.col("sn")) >= threshold
        return c.groupBy("track_id", *more).agg(F.min(F.when(loud, F.col("_c") * chunk)).alias("_at"), (F.max("_ms") + 1).alias("_length"))

    def quiet(length: Column) -> Column:
        return F.least(F.coalesce("_at", length), length)

    lead = loud_chunk(frames, F.col("ms")).select(
        "track_id", F.greatest(quiet(F.col("_length")) - lead_ms, F.lit(0)).alias("start"), F.col("_length").alias("length"))
    rest = _on_frames(frames, lead).where("ms >= start")
    trail = loud_chunk(rest, F.col("length") - 1 - F.col("ms"), "start", "length").select(
        "track_id", quiet(F.col("length") - F.col("start")).alias("quiet"))
    return lead.join(trail, "track_id", "left").select(
        "track_id", "start", (F.col("length") - F.greatest(F.coalesce("quiet", F.lit(0)) - trail_ms, F.lit(0))).alias("end"))


def _on_frames(frames: DataFrame, per_track: DataFrame) -> DataFrame:
    """A track's row on each of its frames. It is copied to the track's blocks, which its `length` tells, so that a long
    track is joined block by block and the frames are read once."""
    blocks = per_track.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(length - 1) div {BLOCK_MS}"))))
    return frames.withColumn("_b", F.expr(f"ms div {BLOCK_MS}").cast("bigint")).join(blocks, ["track_id", "_b"]).drop("_b")


def split_point(ranges: DataFrame, lengths: DataFrame | None = None, max_ms: int = 15000, min_ms: int = 3000,
                over_ms: int = 20000) -> DataFrame:
    """Where to cut a long recording: the last sound that starts in time; (track_id, cut).

    `ranges` are sounding_ranges with `silent_tracks`, or any ranges with `lengths` beside them. The sounds that count are
    those that end in time and the first that does not, so one aggregate per track tells. Tracks no
    longer than `over_ms` and tracks without sound are left whole.
    """
    if lengths is not None:
        ranges = lengths.join(ranges.drop("length"), "track_id", "left")
    in_time = F.max(F.when(F.col("end") <= max_ms, F.col("start")))
    over = F.min(F.when(F.col("end") > max_ms, F.col("start")))
    r = ranges.groupBy("track_id").agg(in_time.alias("_in"), over.alias("_over"), F.max("length").alias("length"), F.max("start").isNotNull().alias("_some"))
    best = F.coalesce(F.greatest("_in", F.when(F.col("_over") <= max_ms, F.col("_over"))), F.lit(0))
    cut = F.when(best < min_ms, F.least(F.lit(max_ms), F.col("length"))).otherwise(best)
    return r.select("track_id", F.when((F.col("length") <= over_ms) | ~F.col("_some"), F.col("length")).otherwise(cut).alias("cut"))


def loud_span(frames: DataFrame, below_peak_db: float = 35.0, frame_ms: int = 20, full: float = 1.0) -> DataFrame:
    """Start and end (ms) of what is not padding: from 2 frames before the first loud one to 3 past the last."""
    c = frames.withColumn("_f", F.floor(F.col("ms") / frame_ms))
    c = c.groupBy("track_id", "_f").agg(F.sum("sumsq").alias("ss"), F.sum("n").alias("sn"), F.count(F.lit(1)).alias("w"))
    c = c.where(F.col("w") == frame_ms).select(
        "track_id", "_f", (20 * F.log10(F.sqrt(F.col("ss") / F.col("sn")) / full + 1e-9)).alias("level"))
    top = c.groupBy("track_id").agg(F.max("level").alias("_top"), F.count(F.lit(1)).alias("_n"))
    loud = _with_frames(c, top).where(F.col("level") > F.col("_top") - below_peak_db)
    return loud.groupBy("track_id").agg(
        (F.greatest(F.min("_f") - 2, F.lit(0)) * frame_ms).alias("start"),
        (F.least(F.max("_n"), F.max("_f") + 3) * frame_ms).alias("end"))


def _with_frames(c: DataFrame, per_track: DataFrame) -> DataFrame:
    from .ordered import attach
    return attach(c, per_track, order="_f", block=BLOCK_MS, how="inner")


def cut_frames(frames: DataFrame, cues: DataFrame, pad: float = 0.0, rate: int = 1000, bucket: int = 1000) -> DataFrame:
    """The frames every cue spans, `pad` seconds wider: an interval join on (track, time bucket)."""
    lo = F.greatest(F.lit(0), ((F.col("start") - pad) * rate).cast("bigint"))
    hi = F.greatest(F.lit(0), ((F.col("end") + pad) * rate).cast("bigint"))
    c = cues.withColumn("_lo", lo).withColumn("_hi", hi).where("_hi > _lo")
    c = c.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_lo") / bucket), F.floor((F.col("_hi") - 1) / bucket))))
    f = frames.withColumn("_k", F.floor(F.col("ms") / bucket))
    j = f.join(c.select("track_id", "id", "_lo", "_hi", "_k"), ["track_id", "_k"])
    return j.where((F.col("ms") >= F.col("_lo")) & (F.col("ms") < F.col("_hi"))).select("track_id", "id", "ms", "sumsq", "n")


def clip_scores(cut: DataFrame) -> DataFrame:
    """Length in samples and length times RMS of every cue's frames."""
    return cut.groupBy("track_id", "id").agg(F.sum("n").alias("n_samples"), F.sum("sumsq").alias("_ss")).select(
        "track_id", "id", "n_samples", (F.col("n_samples") * F.sqrt(F.col("_ss") / F.col("n_samples"))).alias("score"))


def reference_clips(scored: DataFrame, speakers: DataFrame, rate: int = 1000,
                    seconds: float = K.REFERENCE_SECONDS) -> DataFrame:
    """Per speaker the best clips, taken while those before them hold less than `seconds`.

    Clips are pruned to the best `seconds / shortest clip` per task before the running total, so
    the window sees a bounded list: a clip has at least one sample, hence at most seconds * rate.
    """
    most = int(seconds * rate) + 1
    s = scored.join(speakers.select("track_id", "id", "speaker"), ["track_id", "id"]).where("n_samples > 0")
    w = Window.partitionBy("track_id", "speaker").orderBy(F.col("score").desc(), "id")
    s = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    before = F.coalesce(F.sum("n_samples").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("_before", before).where(F.col("_before") < seconds * rate)
    return s.select("track_id", "speaker", "rank", "id", "n_samples", "score")


def fallback_references(speakers: DataFrame, clips: DataFrame, seconds: float = K.REFERENCE_SECONDS) -> DataFrame:
    """Speakers without any clip take the first seconds of their track: (track_id, speaker, start, end)."""
    some = clips.select("track_id", "speaker").distinct()
    none = speakers.select("track_id", "speaker").distinct().join(some, ["track_id", "speaker"], "left_anti")
    return none.select("track_id", "speaker", F.lit(0.0).alias("start"), F.lit(float(seconds)).alias("end"))
