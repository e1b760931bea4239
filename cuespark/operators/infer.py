"""Batch inference with the user's own models."""

from __future__ import annotations

import sys
import types
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .rerank import choose_candidate

KEPT_MODELS = 2


def _model(key: str, load: Callable[[str], Any]) -> Any:
    """A loaded model; a Python worker keeps the last few, over tasks, while Spark reuses it."""
    home = sys.modules.setdefault("_cuespark_models", types.ModuleType("_cuespark_models"))
    models: OrderedDict[str, Any] = home.__dict__.setdefault("models", OrderedDict())
    if key in models:
        models.move_to_end(key)
        return models[key]
    models[key] = load(key)
    while len(models) > KEPT_MODELS:
        models.popitem(last=False)
    return models[key]


def _answers(model, run, texts: list[str], batch: int):
    """One (output, error) per text. A failing batch is tried row by row, so one bad row fails alone."""
    out: list[tuple[Any, str | None]] = []
    for i in range(0, len(texts), batch):
        part = texts[i:i + batch]
        try:
            out += [(o, None) for o in run(model, part)]
        except Exception:  # noqa: BLE001
            for t in part:
                try:
                    out.append((run(model, [t])[0], None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, f"{type(e).__name__}: {e}"))
    return out


def infer(df: DataFrame, load: Callable[[str], Any], run: Callable[[Any, list[str]], list[Any]], *,
          text: str = "text", model: str | Column = "model", out: str = "output", out_type: str = "string",
          batch: int = 8) -> DataFrame:
    """Add `out` and `error`: run(load(model key), texts) in batches; empty texts stay empty.

    Rows keep their partitions: nothing is shuffled, and a model everyone uses does not become
    one task. Inside a partition rows are sorted by model, so a worker loads each model once.
    """
    given = df.columns
    key = F.lit(model) if isinstance(model, str) and model not in given else F.col(model) if isinstance(model, str) else model
    d = df.withColumn("_model", key)
    if isinstance(model, Column) or model in given:
        d = d.sortWithinPartitions("_model")
    empty = [] if out_type.startswith("array") else ""

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text].fillna("").str.strip()
            outs = pd.Series([empty] * len(pdf), index=pdf.index, dtype=object)
            errors = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            for k, rows in texts[texts != ""].groupby(pdf["_model"]):
                for ix, (o, e) in zip(rows.index, _answers(_model(k, load), run, rows.tolist(), batch)):
                    outs.at[ix], errors.at[ix] = o, e
            yield pdf.drop(columns=["_model"]).assign(**{out: outs, "error": errors})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return d.mapInPandas(fn, f"{fields}, `{out}` {out_type}, error string")


def _hop(units: DataFrame, hop: int, legs: str, load, run, candidates, batch: int = 8) -> DataFrame:
    """One leg of every row that has one and has not failed: a new `_cur`, or `_options` if it is the last leg and there is
    something to choose from. Rows come sorted by route, so those of a leg are together; every text is given to its model once."""
    d = units.withColumn("_leg", F.when(F.col("_err").isNull(), F.get(legs, F.lit(hop)))).withColumn("_last", F.size(legs) == hop + 1)

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            now, errors, options = (pdf[c].astype(object) for c in ("_cur", "_err", "_options"))
            texts = pdf["_cur"].fillna("").str.strip()
            for (leg, last), rows in texts.groupby([pdf["_leg"], pdf["_last"]]):
                choose = bool(last) and candidates is not None
                now.loc[rows.index] = ""
                rows = rows[rows != ""]
                answers = _answers(_model(leg, load), candidates if choose else run, rows.tolist(), batch) if len(rows) else []
                for ix, (o, e) in zip(rows.index, answers):
                    errors.at[ix] = e
                    if choose:
                        options.at[ix] = o
                    else:
                        now.at[ix] = None if o is None else o.strip()
            yield pdf.drop(columns=["_leg", "_last"]).assign(_cur=now, _err=errors, _options=options)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields)
    return d.mapInPandas(fn, fields)


def infer_route(units: DataFrame, load, run, *, hops: int = 2, legs: str = "legs", text: str = "text",
                candidates=None, score=None, keys=("track_id", "unit_id"), spoken_from: str | None = None) -> DataFrame:
    """Translate along each row's legs, one stage per hop; add `translated` and `error`.

    A row carries where it is: its text so far, its error, and the options of its last leg. So every hop is one pass
    over all rows, without branches, and no model sees a text of a leg twice. Rows are sorted by their legs once, before the first hop.

    With `candidates` (a run function that returns several options per text) and `score` (takes
    the exploded options, adds `score`), the last leg is re-ranked. The routed rows are then written once, as options and
    rows are read apart; what is shuffled to choose has no texts unless they are compared by length.
    """
    u = units.sortWithinPartitions(legs).withColumns({"_cur": F.col(text), "_err": F.lit(None).cast("string"), "_options": F.lit(None).cast("array<string>")})
    for hop in range(hops):
        u = _hop(u, hop, legs, load, run, candidates)
    left = F.size(legs) - hops          # a longer route ends in a language on the way: that is no translation
    if candidates is not None:
        u = settle(u, "routed")
        options = u.where("_options is not null").select(*keys, "target", F.col(text).alias("source_text"), F.posexplode("_options").alias("cand_ix", "text"))
        best = choose_candidate(score(options), keys=keys, spoken_from=spoken_from).select(*keys, F.col("cand_ix").alias("_best"))
        u = u.join(best, list(keys), "left").withColumn("_cur", F.coalesce(F.trim(F.get("_options", F.col("_best"))), "_cur")).drop("_best")
    unfinished = F.concat(F.lit("the route has "), left.cast("string"), F.lit(" more legs than hops"))
    u = u.withColumn("_err", F.when(F.col("_err").isNull() & (left > 0), unfinished).otherwise(F.col("_err")))
    u = u.withColumn("_cur", F.when(left > 0, F.lit(None)).otherwise(F.col("_cur")))
    return u.drop("_options").withColumnRenamed("_cur", "translated").withColumnRenamed("_err", "error")
