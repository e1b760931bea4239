"""The operators that follow running jobs, as Structured Streaming queries.

Every function takes a streaming DataFrame and returns one, so a user picks source, trigger and
sink. `drain` runs what is available now into a table, for tests and catch-up runs.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import constants as K
from ..operators.build import SEGMENT_SPAN, WORDS, Builder, Layout
from ..operators.files import classify, normal_path
from ..operators.jobs import status_columns
from ..session import fresh_path, key_type


def stream_table(spark: SparkSession, path: str, schema, files_per_batch: int = 4) -> DataFrame:
    """A parquet folder as a stream of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over all that is available; the emitted rows, with the `batch` that emitted them.

    Each batch is written under its own number, so a batch that is run again after a failure
    replaces itself.
    """
    spark = stream.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, name + "-state")

    def store(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(store)
         .option("checkpointLocation", state).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(out)


def latest_rows(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of every key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    u = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_u"))
    return u.select(*keys, "_u.*")


def job_status_stream(events: DataFrame) -> DataFrame:
    """Per job its last message, step, progress and flags, in update mode."""
    return events.groupBy("job").agg(*status_columns())


def live_cues_stream(events: DataFrame, keys: tuple[str, ...] = ("job", "cue")) -> DataFrame:
    """The last write per cue wins, in update mode. Late rows with a lower `seq` change nothing."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_v")).select(*keys, "_v.*")


# --- state -----------------------------------------------------------------------------------------

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store; a store that the session names itself is left alone."""
    if spark.conf.get(STORE, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKSDB)


# --- cues ------------------------------------------------------------------------------------------

PIECE = ["n_words", "start", "end", "text", "language", "final", "word", "begins", "stops"]
TAIL = "+"          # before the language of a tail, so that one without a language is told from none
CUE = ["pos", "start", "end", "text", "language", "gap"]


class CueState(StatefulProcessor):
    """One track's cue builder.

    `progress` says which segment and cue number come next, and that a track has ended; `tail` are the words
    of the unfinished cue; `waiting` holds what has arrived too early, a row for each piece of a segment with its words as bytes,
    written once and removed once. Nothing is rewritten as a whole.
    """

    def __init__(self, layout: Layout, timeout_ms: int | None, ttl_ms: int | None):
        self.layout, self.timeout_ms, self.ttl_ms = layout, timeout_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "next bigint, id bigint, gap boolean, done boolean, language string, held bigint", self.ttl_ms)
        self.tail = handle.getListState("tail", "pos bigint, word string, start double, end double", self.ttl_ms)
        self.waiting = handle.getMapState(
            "waiting", "seg bigint, at bigint",
            "n_words bigint, start double, end double, text string, language string, final boolean, words binary",
            self.ttl_ms)

    # what has arrived in this batch is looked at first, so that a piece in order is never stored
    def _piece(self, arrived: dict, s: dict, seg: int, at: int):
        if (seg, at) in arrived:
            return arrived.pop((seg, at))
        if s["held"] and (stored := self.waiting.getValue((seg, at))) is not None:      # None: nothing there
            self.waiting.removeKey((seg, at))
            s["held"] -= 1
            return self._unstored(stored)
        return None

    # words go to the state as one value: Spark would convert them one by one
    @staticmethod
    def _stored(piece: tuple) -> tuple:
        return (*piece[:6], pickle.dumps(piece[6:]))

    @staticmethod
    def _unstored(row) -> tuple:
        return (*row[:6], *pickle.loads(row[6]))

    def _pieces(self, arrived: dict, s: dict, seg: int) -> list[tuple] | None:
        """All pieces of a segment, in order; None, and nothing taken, while one is missing."""
        at, found = 0, []
        while True:
            piece = self._piece(arrived, s, seg, at)
            if piece is None:
                arrived.update(found)
                return None
            found.append(((seg, at), tuple(piece)))
            at += len(piece[6])
            if at >= piece[0]:
                return [p for _, p in found]

    def _take(self, b: Builder, s: dict, seg: int, pieces: list[tuple], gap: bool) -> list[tuple]:
        """Cues that a segment completes. What comes before a missing one does not run on behind it."""
        made = []
        if gap:
            made += self._told(b.flush(), s)
            s["gap"] = True
        _, start, end, text, language, _ = pieces[0][:6]
        word, begins, stops = ([x for p in pieces for x in p[k]] for k in (6, 7, 8))
        pos = seg * SEGMENT_SPAN
        made += self._told(b.add(pos, word, begins, stops, language) if word else b.alone(pos, start, end, text, language), s)
        s["next"] = seg + 1
        return made

    @staticmethod
    def _told(cues: list[tuple], s: dict) -> list[tuple]:
        out = []
        for c in cues:
            if c[3]:
                out.append((s["id"], *c, s["gap"]))
                s["id"], s["gap"] = s["id"] + 1, False
        return out

    def _load(self) -> tuple[dict, Builder]:
        at = self.progress.get() if self.progress.exists() else (0, 0, False, False, "", 0)
        s = dict(zip(("next", "id", "gap", "done", "language", "held"), at))
        s["tail"] = bool(s["language"]) and not s["done"]
        return s, Builder(self.layout, [tuple(w) for w in self.tail.get()] if s["tail"] else [], s["language"].removeprefix(TAIL))

    def _keep(self, s: dict, b: Builder, over: bool) -> None:
        if over and s["held"]:
            for at in list(self.waiting.keys()):
                self.waiting.removeKey(at)
        if b.tail:
            self.tail.put(b.tail)
        elif s["tail"]:
            self.tail.clear()
        self.progress.update((s["next"], s["id"], s["gap"], over, TAIL + b.tail_language if b.tail else "", 0 if over else s["held"]))
        if self.timeout_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)

    def _frame(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["track_id", "id", *CUE])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, b = self._load()
        if s["done"]:               # late copies after the end
            for _ in rows:
                pass
            return
        arrived: dict = {}
        for pdf in rows:
            for seg, at, *piece in zip(*[pdf[c].tolist() for c in ("id", "at", *PIECE)]):
                if seg >= s["next"]:
                    piece[6:] = [x.tolist() for x in piece[6:]]
                    arrived.setdefault((int(seg), int(at)), tuple(piece))
        out, over = [], False
        while not over and (pieces := self._pieces(arrived, s, s["next"])) is not None:
            out += self._take(b, s, s["next"], pieces, False)
            over = any(p[5] for p in pieces)
        if over:
            out += self._told(b.flush(), s)
        else:
            for at, piece in arrived.items():
                if at[0] >= s["next"] and not (s["held"] and self.waiting.containsKey(at)):
                    self.waiting.updateValue(at, self._stored(piece))
                    s["held"] += 1
        self._keep(s, b, over)
        if self.timeout_ms and not over:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Silence: missing segments and pieces are given up, the rest is built in order and the track ends."""
        s, b = self._load()
        held: dict = {}
        for (seg, at), piece in self.waiting.iterator() if s["held"] else ():
            held.setdefault(int(seg), {})[int(at)] = self._unstored(piece)
        out = []
        for seg in sorted(held):
            pieces = [held[seg][at] for at in sorted(held[seg])]
            whole = sum(len(p[6]) for p in pieces) >= pieces[0][0]
            out += self._take(b, s, seg, pieces, seg > s["next"] or min(held[seg]) > 0)
            s["gap"] = s["gap"] or not whole
        out += self._told(b.flush(), s)
        self._keep(s, b, True)
        yield from self._frame(key, out)

    def close(self) -> None:
        pass


def cue_builder_stream(segments: DataFrame, layout: Layout = Layout(), timeout_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Cues as their segments arrive: (track_id, id, pos, start, end, text, language, gap).

    Takes segments as operators.build.build_cues does, with `final`, true on the last one of a track.
    Segments are taken in id order from 0: early ones wait in the state, repeated ones are dropped, also those that
    come again after the track's end. A segment may come in pieces, over as many batches as it likes: rows of its id with `n_words`, the words
    of the whole segment, and `at`, where the piece's words begin in it; it waits until all are there.

    Silence for `timeout_ms`, if given, ends a track too: what is missing is then given up, what waited behind it is built in
    order, and the first cue behind a gap has `gap` true; without one a missing segment holds back what follows it.
    State that is not written for `ttl_ms`, if given, is removed, the note that a track has ended as well. With either
    the query keeps running batches, so it does not go with an available-now trigger.
    """
    keyed_state(segments.sparkSession)
    w = F.coalesce("words", F.array().cast(WORDS))
    rows = segments.select(
        "track_id", F.col("id").cast("bigint"), (F.col("at").cast("bigint") if "at" in segments.columns else F.lit(0).cast("bigint")).alias("at"),
        (F.col("n_words") if "n_words" in segments.columns else F.size(w)).cast("bigint").alias("n_words"), "start", "end", "text",
        F.coalesce("language", F.lit("")).alias("language"), F.coalesce("final", F.lit(False)).alias("final"),
        F.transform(w, lambda x: F.coalesce(x["word"], F.lit(""))).alias("word"),
        F.transform(w, lambda x: F.coalesce(x["start"], F.col("start"))).alias("begins"),
        F.transform(w, lambda x: F.coalesce(x["end"], F.col("end"))).alias("stops"))
    track = key_type(segments)
    timed = timeout_ms or ttl_ms
    return rows.groupBy("track_id").transformWithStateInPandas(
        CueState(layout, timeout_ms, ttl_ms),
        f"track_id {track}, id long, pos long, start double, end double, text string, language string, gap boolean",
        "Append", "ProcessingTime" if timed else "None")


def _load(state: GroupState, empty: dict) -> dict:
    return json.loads(state.get[0]) if state.exists else empty


def _drained(wait: dict, start: int, give_up: bool):
    """Waiting entries that can be taken now: those without a gap before them, or all of them in
    order if the missing ones are given up. Yields (number, entry, whether something is missing before)."""
    at = start
    for n in sorted(map(int, wait)):
        if n > at and not give_up:
            return
        yield n, wait.pop(str(n)), n > at
        at = n + 1


def _units_step(s: dict, arrived: list[tuple], give_up: bool) -> list[tuple]:
    """(id, unit_id) of the cues that can be told now; rows are (number, id, start, end, n, ends)."""
    for number, *rest in arrived:
        if number >= s["next"]:
            s["wait"].setdefault(str(number), rest)
    out = []
    for number, (cue, start, end, n, ends), gap in _drained(s["wait"], s["next"], give_up):
        s["next"] = number + 1
        if gap or s["unit"] is None or start - s["end"] > K.UNIT_MAX_GAP_SECONDS or s["len"] + n > K.UNIT_MAX_CHARS:
            s["unit"], s["len"] = cue, 0
        out.append((cue, s["unit"]))
        s["len"] += n + 1
        s["end"] = end
        if ends:
            s["unit"] = None
    return out


def sentence_unit_stream(cues: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """The sentence unit of every cue as it arrives: (track_id, id, unit_id).

    Takes (track_id, id, number, start, end, n, ends): `number` counts the cues of a track from 1,
    `n` is the text length, `ends` says that the text ends a sentence. Early cues wait in the state.
    Silence for `timeout_ms`, if given, gives up missing numbers, releases what waited in order (a
    unit does not run over a gap) and removes the track's state.
    """
    def fn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = _load(state, {"next": 1, "unit": None, "len": 0, "end": 0.0, "wait": {}})
        names = ("number", "id", "start", "end", "n", "ends")
        rows = [r for pdf in batches for r in zip(*[pdf[c].tolist() for c in names])]
        out = _units_step(s, rows, state.hasTimedOut)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["track_id", "id", "unit_id"])
        if state.hasTimedOut:
            state.remove()
            return
        state.update((json.dumps(s),))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)

    return cues.groupBy("track_id").applyInPandasWithState(
        fn, f"track_id {key_type(cues)}, id long, unit_id long", "state string", "append",
        GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


# --- files ---------------------------------------------------------------------------------------------

LISTING, LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 32


def few_listers(spark: SparkSession) -> None:
    """Have the files of a batch looked up by a few tasks; Spark's own default is a task for each file, each with a report to the driver.

    A session that sets the number itself keeps its own.
    """
    if spark.conf.get(LISTING) == "10000":
        spark.conf.set(LISTING, LISTERS)


def file_arrival_stream(spark: SparkSession, root: str, pattern: str = "*", files_per_batch: int = 2000, forget: str | None = None) -> DataFrame:
    """New files under a folder as they are found: (path, bytes, ext, kind), each path once.

    Only names and sizes are read. Paths already seen are dropped by the stream's own state. With `forget`, a span such as
    "7 days", a path is remembered only until files that are younger by so much have come, so the state does not grow for ever.
    """
    few_listers(spark)
    f = (spark.readStream.format("binaryFile")
         .schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
         .option("maxFilesPerTrigger", files_per_batch).load(root))
    f = f.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("bytes"), "modificationTime")
    f = classify(f.withColumn("path", normal_path("path")))
    seen = f.withWatermark("modificationTime", forget).dropDuplicatesWithinWatermark(["path"]) if forget else f.dropDuplicates(["path"])
    return seen.drop("modificationTime")
