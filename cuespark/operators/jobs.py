"""Events of running jobs: status, progress, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step_fraction(done, total) -> Column:
    """Progress inside a step, or -1 when the total is not known."""
    d, t = F.col(done), F.col(total)
    return F.when(t > 0, F.least(F.lit(1.0), d / F.when(t > 0, t))).otherwise(-1.0)


def progress_fraction(events: DataFrame) -> DataFrame:
    """Per job: how far it is, counting its steps and the furthest point reached in the last one."""
    p = events.where("event in ('status', 'progress')").select(
        "job", "seq", "step", "steps", F.when(F.col("event") == "progress", step_fraction("done", "total")).otherwise(0.0).alias("f"))
    by_step = p.groupBy("job", "step").agg(F.max("f").alias("f"), F.max("seq").alias("seq"), F.max("steps").alias("steps"))
    last = by_step.groupBy("job").agg(F.max_by(F.struct("step", "f", "steps"), "seq").alias("l"))
    return last.select("job", "l.step", F.least(F.lit(1.0), (F.col("l.step") + F.greatest(F.col("l.f"), F.lit(0.0))) / F.greatest(
        F.col("l.steps"), F.lit(1))).alias("fraction"))


def status_columns() -> list[Column]:
    """The aggregates of job_status, for batch and streaming alike."""
    told = F.col("event").isin("status", "progress")
    return [
        F.max_by(F.when(F.col("event") == "status", F.col("message")), F.when(F.col("event") == "status", F.col("seq"))).alias("message"),
        F.max_by("step", F.when(told, F.col("seq"))).alias("step"),
        F.max_by(step_fraction("done", "total"), F.when(F.col("event") == "progress", F.col("seq"))).alias("stage_progress"),
        F.count_if(F.col("event") == "segment").alias("segments"),
        F.bool_or(F.col("event") == "finished").alias("finished"),
        F.bool_or(F.col("event") == "error").alias("failed"),
        F.max("seq").alias("last_seq")]


def job_status(events: DataFrame) -> DataFrame:
    """Per job: last message, step and stage progress, segments so far, finished and failed flags."""
    return events.groupBy("job").agg(*status_columns())


def recent_results(results: DataFrame, count: int = 100, finished: str = "finished_at") -> DataFrame:
    """The most recently finished jobs; each task keeps its own top rows before they meet."""
    return results.orderBy(F.col(finished).desc(), F.col("job").desc()).limit(count)


def run_summary(results: DataFrame, run: str = "run") -> DataFrame:
    """Per run: files done, failed and cancelled, the first warning and how many more there are."""
    first = F.min_by(F.col("warning"), F.when(F.col("warning").isNotNull(), F.col("position")))
    n = F.count("warning")
    return results.groupBy(run).agg(
        F.count_if(F.col("state") == "ok").alias("ok"), F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "cancelled").alias("cancelled"),
        F.concat(first, F.when(n > 1, F.concat(F.lit(" (+"), (n - 1).cast("string"), F.lit(" more)"))).otherwise("")).alias("note"))
