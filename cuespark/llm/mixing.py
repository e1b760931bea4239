"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target t and size s is wanted t / s times: its whole part always,
the rest with that probability. Probabilities of a source are made integral two at a time: words
of expected mass move from one document to the other, in a random direction that keeps each
probability's mean, until one of the two is 0 or 1. The source's expected words never change, so
what is taken differs from the target by less than the last undecided document.

The pairs form a tree. Documents are dealt to buckets by hash; within a bucket each source is
one stream that leaves at most one undecided document. Those are dealt to FAN times fewer
buckets, and so on until one is left for each source, which a coin decides. A hot source is
thus spread over all buckets, no task holds more than one undecided document, and all coins
are hashes of the rows, so that reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import word_count

WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 4096
FAN = 16


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ranked(values: DataFrame, column: str) -> DataFrame:
    """Adds `rank` (from 0) by code point, nulls last, without sorting in one task."""
    v = settle(values.repartitionByRange(F.col(column).asc_nulls_last())
               .withColumn("part", F.spark_partition_id()), "ranked")
    before, offsets = 0, []
    for part, n in sorted(v.groupBy("part").count().collect()):     # a row for each partition
        offsets += [F.lit(part), F.lit(before)]
        before += n
    order = Window.partitionBy("part").orderBy(F.col(column).asc_nulls_last())
    offset = F.create_map(*offsets)[F.col("part")] if offsets else F.lit(0)
    return v.select("*", (F.row_number().over(order) - 1 + offset).alias("rank")).drop("part")


def targets(sizes: DataFrame, source: str = "source", weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, from one row per source with its source_size.

    All targets together are `share` times all sizes, divided by the weights that sources get in
    turn; a target above `most` times its source is cut to that and the excess shared again.
    """
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = settle(ranked(sizes, source).select(source, "source_size", cycle.alias("weight")), "mix-sources")
    cap = F.col("source_size") * F.lit(float(most))
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, capped = 0.0, -1
    while True:
        above = cap < F.lit(level) * F.col("weight")
        n, held, open_weight = s.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
                                     F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (total - held) / open_weight
    return s.select(source, "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def _pivot(keys: list[str]):
    """For Arrow batches sorted by `keys`: settle p of all rows of a key but one at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                 # the undecided row of an earlier batch, as a batch of one row
        key, p0, size0 = None, 0.0, 0
        for batch in batches:
            at = batch.schema.get_field_index("p")

            def with_p(part, values, at=at):
                return part.set_column(at, "p", pa.array(values, pa.float64()))

            names = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            p, size, coin = (batch.column(c).to_pylist() for c in ("p", "size", "coin"))
            mine = None             # index of the undecided row, if it is in this batch
            for i, name in enumerate(names):
                if name != key:
                    if held is not None:
                        yield with_p(held, [p0])
                        held = None
                    key, mine = name, None
                if not 0.0 < p[i] < 1.0:
                    continue
                if mine is None and held is None:
                    mine, p0, size0 = i, p[i], size[i]
                    continue
                a, b, u, v = p0, p[i], size0, size[i]
                up, down = min((1 - a) * u, b * v), min(a * u, (1 - b) * v)     # words that can move either way
                if coin[i] * (up + down) < down:
                    a, b = (1.0 if (1 - a) * u <= b * v else a + up / u), (0.0 if b * v <= (1 - a) * u else b - up / v)
                else:
                    a, b = (0.0 if a * u <= (1 - b) * v else a - down / u), (1.0 if (1 - b) * v <= a * u else b + down / v)
                if 0.0 < a < 1.0:
                    p0, p[i] = a, b
                    if mine is not None:
                        p[mine] = a
                    continue
                if held is not None:
                    yield with_p(held, [a])
                    held = None
                else:
                    p[mine] = a
                mine, p[i] = (i, b) if 0.0 < b < 1.0 else (None, b)
                p0, size0 = b, v
            if mine is None:
                yield with_p(batch, p)
            else:
                yield with_p(batch.slice(0, mine), p[:mine])
                yield with_p(batch.slice(mine + 1), p[mine + 1:])
                held = batch.slice(mine, 1)
        if held is not None:
            yield held.set_column(held.schema.get_field_index("p"), "p", pa.array([p0], pa.float64()))

    return run


def _coin(seed: int, *columns) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _streams(df: DataFrame, keys: list[str], *then: str) -> DataFrame:
    """Long documents first: shorter ones then take up what they leave, and little is open at the end."""
    return (df.repartition(*keys).sortWithinPartitions(*keys, F.desc("size"), *then)
            .mapInArrow(_pivot(keys), df.schema))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, doc: str = "doc_id",
        text: str = "text", source: str = "source", seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The documents' columns and size (words), source_size, target, copies, taken (words).

    Null and empty texts have size 0 and get the whole part of their source's ratio. Null sources
    are one source. Repeated rows are decided each. A result replaces an input column of its name; no other
    name clashes, since the documents' own columns are numbered until the end.
    A source without words has target 0 and no copies.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = [names[c] for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    docs = docs.toDF(*names.values())
    doc, text, source = names[doc], names[text], names[source]
    d = docs.select(*dict.fromkeys([*own, doc, source]), word_count(text).alias("size"), F.xxhash64(F.col(text)).alias("mark"))
    slim = settle(docs.select(F.col(source).alias("source"), word_count(text).alias("size"))
                  .groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sizes")
    rows = slim.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(rows / bucket_rows))
    t = targets(slim.select("source", "source_size"), "source", weights, share, most).withColumnRenamed("source", "__source")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    d = (d.join(t, _same(d[source], t["__source"]), "left").drop("__source")
         .withColumn("ratio", ratio).withColumn("copies", F.floor("ratio"))
         .withColumn("p", F.when(F.col("size") > 0, F.col("ratio") - F.col("copies")).otherwise(0.0)).drop("ratio")
         .withColumn("coin", _coin(seed, F.col(doc), "mark"))
         .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(doc), "mark"), F.lit(buckets)).cast("int")))
    first = settle(_streams(d, ["bucket", source], doc, "mark"), "mix-first")
    open_rows = (F.col("p") > 0) & (F.col("p") < 1)

    # the tree: a unit is the one row that a source has left undecided in a bucket
    units = first.where(open_rows).select(F.col(source).alias("s"), F.col("bucket").alias("unit"), "p", "size",
                                          F.col("bucket").alias("knot"))
    decided, level = None, 0
    while buckets > 1:
        buckets, level = -(-buckets // FAN), level + 1
        units = (units.withColumn("knot", F.expr(f"knot div {FAN}").cast("int"))
                 .withColumn("coin", _coin(seed + 1 + level, "s", "unit")))
        units = settle(_streams(units, ["knot", "s"], "unit"), f"mix-level{level}")
        done = units.where(~open_rows).select("s", "unit", "p")
        decided = done if decided is None else decided.unionByName(done)
        units = units.where(open_rows).drop("coin")
    last = units.select("s", "unit", (_coin(seed, "s", "unit") < F.col("p")).cast("double").alias("p"))
    decided = last if decided is None else decided.unionByName(last)
    decided = decided.withColumnRenamed("p", "last_p")
    left = first.where(open_rows)
    left = (left.join(decided, _same(left[source], decided["s"]) & (left["bucket"] == decided["unit"]))
            .withColumn("p", F.col("last_p")).select(*first.columns))
    both = first.where(~open_rows).unionByName(left)
    copies = (F.col("copies") + F.col("p")).cast("long")
    back = [F.col(i).alias(c) for c, i in names.items() if i in own]
    return both.select(*back, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
