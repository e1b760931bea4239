"""Neighbours and running totals in an ordered track, safe for tracks of any length.

A plain window over a track puts the whole track into one task. Here a track is cut into
blocks of consecutive ids: `id div BLOCK`. Ids are unique in a track, so a block never holds
more than BLOCK rows whatever the data looks like, and a track that owns a third of the table
is spread over as many tasks as it has blocks. What crosses a block boundary (the nearest row
on the other side, the total so far) comes from one summary row per block. The summary is
partially aggregated before it is shuffled; for tracks that fit in one block it is empty, and
adaptive execution then drops the join.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536
BLK = "_blk"


def blocked(df: DataFrame, order: str = "id", block: int = BLOCK) -> DataFrame:
    """Add the block number of every row."""
    return df.withColumn(BLK, F.floor(F.col(order) / F.lit(block)).cast("bigint"))


def ordered(
    df: DataFrame,
    *,
    lead: Mapping[str, Column] | None = None,
    lag: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    maxs: Mapping[str, Column] | None = None,
    keys: Sequence[str] = ("track_id",),
    order: str = "id",
    block: int = BLOCK,
) -> DataFrame:
    """Add columns that look along the track in `order`.

    lead / lag  the expression on the next / previous row (null at the ends of the track)
    sums, maxs  the sum / maximum of the expression over all earlier rows (0 / null at first)
    """
    lead, lag, sums, maxs = dict(lead or {}), dict(lag or {}), dict(sums or {}), dict(maxs or {})
    keys = list(keys)
    original = df.columns
    df = blocked(df, order, block)
    within = Window.partitionBy(*keys, BLK).orderBy(order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*keys).orderBy(BLK)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)

    def packed(cols):
        return F.struct(F.lit(1).alias("here"), *[c.alias(n) for n, c in cols.items()])

    aggs, carried = [], []
    if lead:
        aggs.append(F.min_by(packed(lead), order).alias("__first"))
        carried.append(F.lead("__first").over(along).alias("__next"))
    if lag:
        aggs.append(F.max_by(packed(lag), order).alias("__last"))
        carried.append(F.lag("__last").over(along).alias("__prev"))
    for n, c in sums.items():
        aggs.append(F.sum(c).alias("__s_" + n))
        carried.append(F.sum("__s_" + n).over(earlier).alias("__c_" + n))
    for n, c in maxs.items():
        aggs.append(F.max(c).alias("__m_" + n))
        carried.append(F.max("__m_" + n).over(earlier).alias("__c_" + n))
    summary = df.groupBy(*keys, BLK).agg(*aggs).select(*keys, BLK, *carried)
    names = [c for c in summary.columns if c not in (*keys, BLK)]
    summary = summary.where(" or ".join(f"`{c}` is not null" for c in names))

    local = []
    if lead:
        local.append(F.lead(packed(lead)).over(within).alias("__ln"))
    if lag:
        local.append(F.lag(packed(lag)).over(within).alias("__lp"))
    local += [F.sum(c).over(before).alias("__l_" + n) for n, c in sums.items()]
    local += [F.max(c).over(before).alias("__l_" + n) for n, c in maxs.items()]
    out = df.select("*", *local).join(summary, [*keys, BLK], "left")

    added = [F.coalesce("__ln", "__next")[n].alias(n) for n in lead]
    added += [F.coalesce("__lp", "__prev")[n].alias(n) for n in lag]
    added += [(F.coalesce("__l_" + n, F.lit(0)) + F.coalesce("__c_" + n, F.lit(0))).alias(n) for n in sums]
    added += [F.greatest("__l_" + n, "__c_" + n).alias(n) for n in maxs]
    return out.select(*[F.col(f"`{c}`") for c in original], *added)


def runs(
    df: DataFrame,
    probe: Mapping[str, Column],
    is_new: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    name: str,
    *,
    keys: Sequence[str] = ("track_id",),
    order: str = "id",
    block: int = BLOCK,
) -> DataFrame:
    """Add `name`: the order value of the first row of the run every row belongs to.

    `is_new(previous, current)` says whether a row starts a run, from the probed columns of it
    and of the row before. Blocks find their runs alone, taking their first row as a start; one
    summary row per block then says which first rows only go on with an earlier run.
    """
    keys = list(keys)
    original = df.columns
    packed = F.struct(*[c.alias(n) for n, c in probe.items()])
    d = blocked(df, order, block).withColumn("__p", packed)
    within = Window.partitionBy(*keys, BLK).orderBy(order)
    along = Window.partitionBy(*keys).orderBy(BLK)

    def differs(prev: str, cur: str) -> Column:
        new = is_new(lambda n: F.col(prev)[n], lambda n: F.col(cur)[n])
        return F.col(prev).isNull() | F.coalesce(new, F.lit(False))

    d = d.withColumn("__q", F.lag("__p").over(within))
    d = d.withColumn("__s", F.when(differs("__q", "__p"), F.col(order)))
    edges = d.groupBy(*keys, BLK).agg(
        F.min_by("__p", order).alias("__f"), F.max_by("__p", order).alias("__l"),
        F.min(order).alias("__a"), F.max("__s").alias("__z"))
    edges = edges.withColumn("__w", F.lag("__l").over(along))
    edges = edges.withColumn("__new", differs("__w", "__f"))
    edges = edges.withColumn("__own", F.when(F.col("__new") | (F.col("__z") != F.col("__a")), F.col("__z")))
    edges = edges.withColumn("__go", F.max("__own").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    edges = edges.where(~F.col("__new")).select(*keys, BLK, "__a", "__go")
    d = d.withColumn("__r", F.max("__s").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.join(edges, [*keys, BLK], "left")
    run = F.when(F.col("__r") == F.col("__a"), F.col("__go")).otherwise(F.col("__r"))
    return d.select(*[F.col(f"`{c}`") for c in original], run.alias(name))


def renumber(df: DataFrame, name: str = "id", *, keys: Sequence[str] = ("track_id",),
             order: str = "id", start: int = 0, block: int = BLOCK) -> DataFrame:
    """Number the rows of every track densely in `order`."""
    out = ordered(df, sums={"_n": F.lit(1).cast("bigint")}, keys=keys, order=order, block=block)
    return out.withColumn(name, F.col("_n") + F.lit(start)).drop("_n")


def attach(df: DataFrame, per_track: DataFrame, *, keys: Sequence[str] = ("track_id",),
           order: str = "id", how: str = "left", block: int = BLOCK) -> DataFrame:
    """Join one row per track onto the rows of the track, block by block.

    The per-track row is first copied to each block the track has (a narrow, pre-aggregated
    list), so the wide side is joined on (track, block) and a huge track never meets in one
    task.
    """
    keys = list(keys)
    df = blocked(df, order, block)
    spots = df.select(*keys, BLK).distinct()
    return df.join(spots.join(per_track, keys, "inner"), [*keys, BLK], how).drop(BLK)
