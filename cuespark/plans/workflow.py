"""Chains of steps over whole corpora: translate, transliterate, in any order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import units
from ..operators.routing import script_for_language
from ..session import settle
from ..sources.writers import WRITERS


@dataclass(frozen=True)
class Translate:
    """Translate sentence units into `target` with `model`: a DataFrame function that adds `translated`."""

    target: str
    model: Callable[[DataFrame], DataFrame]
    source: str = "auto"
    input: int | None = None


@dataclass(frozen=True)
class Transliterate:
    """Convert every cue's text into the script `target` with `model`, a function of (text, script) Columns."""

    target: str
    model: Callable[[Column, Column], Column]
    source: str = "auto"
    input: int | None = None


@dataclass
class Result:
    """Tracks of every step in order, tracks that were rejected, and notes."""

    steps: list[DataFrame] = field(default_factory=list)
    errors: list[DataFrame] = field(default_factory=list)

    def documents(self, step: int, fmt: str = "srt") -> DataFrame:
        return WRITERS[fmt](self.steps[step])


COLUMNS = ["track_id", "id", "start", "end", "text", "language", "script"]


def _translate(step: Translate, cues: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = F.coalesce("language", F.lit(""))
    source = known if step.source == "auto" else F.lit(step.source)
    c = cues.withColumn("_source", source)
    errors = c.where("_source = ''").select(
        "track_id", F.lit("This step does not know what language the track is in; name a source.").alias("error")).distinct()
    kept = c.where(F.col("_source") == step.target)
    todo = c.where((F.col("_source") != "") & (F.col("_source") != step.target))
    u = units.join_units(units.sentence_units(todo), "_source")
    u = step.model(u.withColumn("target", F.lit(step.target)))
    u = settle(u, "translated")
    failed = u.where(F.col("translated").isNull()).groupBy("track_id").agg(F.count("*").alias("n"))
    errors = errors.unionByName(failed.select("track_id", F.concat(
        F.lit("No translation for "), F.col("n").cast("string"), F.lit(" sentence units; their cues are left out.")).alias("error")))
    done = units.spread_translation(u, step.target)
    done = done.select("track_id", "id", "start", "end", F.col("translated").alias("text"), "language", F.lit("").alias("script"))
    return kept.select(*COLUMNS).unionByName(done), errors


def _transliterate(step: Transliterate, cues: DataFrame) -> tuple[DataFrame, DataFrame]:
    auto = F.coalesce(F.nullif("script", F.lit("")), script_for_language("language"))
    c = cues.withColumn("_script", auto if step.source == "auto" else F.lit(step.source))
    name = F.col("language")
    errors = c.where("_script = ''").select(
        "track_id", F.concat(F.lit("There is no transliteration from the script of '"), name, F.lit("'.")).alias("error")).distinct()
    done = c.where("_script <> ''").withColumn("text", step.model(F.col("text"), F.col("_script"))).withColumn(
        "script", F.lit(step.target))
    return done.select(*COLUMNS), errors


def run_workflow(source: DataFrame, steps: list[Translate | Transliterate]) -> Result:
    """Run steps over cue tracks. A step reads the source, or the output of an earlier step.

    A track that a step cannot take is left out of it and listed in `errors`; the others go on.
    The source is stored once when several steps read it.
    """
    if "script" not in source.columns:
        source = source.withColumn("script", F.lit(""))
    source = source.select(*COLUMNS)
    if sum(s.input is None for s in steps) > 1:
        source = settle(source, "source")
    out = Result()
    for i, step in enumerate(steps):
        if step.input is not None and not 0 <= step.input < i:
            raise ValueError(f"step {i} reads step {step.input}, which does not come before it")
        text = source if step.input is None else out.steps[step.input]
        done, errors = _translate(step, text) if isinstance(step, Translate) else _transliterate(step, text)
        if any(s.input == i for s in steps):
            done = settle(done, f"step{i}")
        out.steps.append(done)
        out.errors.append(errors.withColumn("step", F.lit(i)))
    return out


__all__ = ["Translate", "Transliterate", "Result", "run_workflow"]
