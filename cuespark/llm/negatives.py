"""Hard-negative mining with a multiway hyperplane tree over whole-number vectors.

A split point takes the vectors that are nearer to it than to its siblings. With each split point the tree
holds the least and greatest distance from it to the vectors of every sibling's subtree, and each subtree's
range of squared lengths. A query asks for scores (inner products) within a window; with the lengths that is an
annulus of distances around the query, and the triangle inequality rules a sibling out as soon as one split
point's stored range cannot meet it. What is left is compared exactly in the leaves, so the result is exact.
Windows begin as narrow as the sample, and for positives the query's own leaf, prove to be enough.

The tree is fitted on a bounded sample (`sample` distinct vectors, those of least hash); every row is put into it,
and the stored ranges are taken over all rows. Equal vectors of one label are one node that keeps its few
smallest ids, as no more can be asked for; a large leaf is dealt over chunks. Queries meet leaves by a sort of (leaf, chunk):
leaf vectors first, then the queries that could not rule the leaf out, which stream past them. Where nothing can be
ruled out (vectors without any structure) that is the stated query set against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

FANOUT = 16
SAMPLE = 16_384                 # distinct vectors that the tree is fitted on, if they have 256 components at most
LEAF = 2_048                    # vectors of a leaf, about, as far as the sample can tell
CHUNK = 8_192                   # vectors that a task compares at a time
SCALE = 256
EXACT = 2 ** 53                 # squared lengths below keep inner products exact in doubles
FAR = 2 ** 62                   # a window without an end
NODE = "label bigint, vec binary, ids array<bigint>"


@dataclass
class Split:
    """An inner node: its split points, their children's numbers, and per (child, split point) the range of squared distances."""
    points: np.ndarray
    children: list[int]
    low: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    high: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


@dataclass
class Tree:
    """Nodes by number, 0 is the root; a number without a split is a leaf. length: per node the range of squared lengths."""
    splits: dict[int, Split]
    sample: np.ndarray                      # and labels: the rows that the tree was fitted on
    labels: np.ndarray
    length: dict[int, tuple[float, float]] = field(default_factory=dict)
    chunks: dict[int, int] = field(default_factory=dict)


def squared(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (x @ points.T)


def fit(sample: np.ndarray, labels: np.ndarray, rows: int, leaf: int = LEAF, most: int = FANOUT) -> Tree:
    """Split points: candidates of the sample, chosen so that each is far from those before it. A node has as many
    children as it has leaves' worth of rows, `most` at most."""
    rng, tree = np.random.default_rng(0), Tree({}, sample, labels)
    todo, numbers = [(0, np.arange(len(sample)))], 0
    share = rows / max(1, len(sample))
    while todo:
        number, own = todo.pop()
        fanout = min(most, -int(-len(own) * share // leaf))
        if fanout < 2 or len(own) < 2 * fanout:
            continue
        candidates = sample[rng.choice(own, min(len(own), 4 * fanout), replace=False)]
        chosen, nearest = [0], squared(candidates, candidates[:1])[:, 0]
        while len(chosen) < fanout and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared(candidates, candidates[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            continue
        points = candidates[chosen]
        to = squared(sample[own], points).argmin(1)
        children = list(range(numbers + 1, numbers + 1 + len(points)))
        numbers += len(points)
        tree.splits[number] = Split(points, children)
        todo += [(c, own[to == j]) for j, c in enumerate(children)]
    return tree


def descend(tree: Tree, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(node, rows that come to it, their squared distances to its split points or None at a leaf)."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        number, own = todo.pop()
        if not len(own):
            continue
        split = tree.splits.get(number)
        if split is None:
            yield number, own, None
            continue
        d = squared(x[own], split.points)
        yield number, own, d
        to = d.argmin(1)
        todo += [(c, own[to == j]) for j, c in enumerate(split.children)]


def survivors(tree: Tree, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, queries for which it may hold a vector whose inner product is within a window).

    low, high: per query and window; a window with low > high asks for nothing.
    """
    own_length = (x * x).sum(1)
    todo = [(0, np.arange(len(x)), low <= high)]
    while todo:
        number, own, open_ = todo.pop()
        least, most = tree.length.get(number, (0.0, 0.0))
        # the annulus of each window, by the lengths within the subtree; a bound on the score by Cauchy-Schwarz
        reach = np.sqrt(own_length[own] * most)[:, None] * (1 + 1e-9) + 1
        top, bottom = np.minimum(high[own], reach), np.maximum(low[own], -reach)
        open_ = open_ & (bottom <= top)
        inner = own_length[own][:, None] + least - 2 * top
        outer = own_length[own][:, None] + most - 2 * bottom
        open_ &= outer >= 0
        alive = open_.any(1)
        own, open_, inner, outer = own[alive], open_[alive], inner[alive], outer[alive]
        if not len(own) or number not in tree.length:
            continue
        split = tree.splits.get(number)
        if split is None:
            yield number, own
            continue
        d = np.sqrt(np.maximum(squared(x[own], split.points), 0))
        inner, outer = np.sqrt(np.maximum(inner, 0)), np.sqrt(np.maximum(outer, 0))
        for j, child in enumerate(split.children):
            if child not in tree.length:
                continue                                            # no row came to it
            near, far = np.sqrt(split.low[j])[None, None, :], np.sqrt(split.high[j])[None, None, :]
            spare = 1e-6 * (1 + far)
            meets = ((d[:, None, :] - outer[:, :, None] <= far + spare) & (inner[:, :, None] - d[:, None, :] <= far + spare)
                     & (d[:, None, :] + outer[:, :, None] >= near - spare)).all(2) & open_
            left = meets.any(1)
            if left.any():
                todo.append((child, own[left], meets[left]))


# --- rows to vectors

def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.float64)


def whole_numbers(df: DataFrame, vec_id: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """(id, label, vec: little-endian whole numbers padded with zeros to the largest width; that width)."""
    usable = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                       F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    width = max(1, usable.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0])
    usable = usable.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            sizes = np.diff(v.offsets.to_numpy())
            whole = np.zeros((len(v), width))
            whole[np.arange(width)[None, :] < sizes[:, None]] = np.floor(SCALE * v.flatten().to_numpy())
            exact = ((whole * whole).sum(1) < EXACT) & (np.abs(whole).max(1) < 2 ** 31)
            rows = [r.tobytes() for r in whole[exact].astype("<i4")]
            keep = pa.array(exact)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(keep), batch.column("label").filter(keep), pa.array(rows, pa.binary())],
                                             ["id", "label", "vec"])
    return usable.mapInArrow(run, "id bigint, label bigint, vec binary"), width


def _key() -> Column:
    return F.md5(F.concat(F.col("label").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("vec")))


# --- building the tree

def _put(tree, width: int) -> Callable:
    """Nodes with their leaf and chunk."""
    def run(batches):
        for batch in batches:
            x, leaf = matrix(batch.column("vec"), width), np.zeros(batch.num_rows, np.int32)
            for number, own, d in descend(tree.value, x):
                if d is None:
                    leaf[own] = number
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *(batch.column(c) for c in ("label", "vec", "ids"))], ["leaf", "label", "vec", "ids"])
    return run


def _ranges(tree, width: int) -> Callable:
    """Per node, and per child and split point, the ranges that a batch's rows span; point -1 stands for squared lengths."""
    def run(batches):
        for batch in batches:
            x = matrix(batch.column("vec"), width)
            lengths, rows = (x * x).sum(1), []
            for number, own, d in descend(tree.value, x):
                rows.append((number, -1, lengths[own].min(), lengths[own].max(), len(own)))
                if d is not None:
                    to = d.argmin(1)
                    for j, child in enumerate(tree.value.splits[number].children):
                        if (to == j).any():
                            part = d[to == j]
                            rows += [(child, i, lo, hi, 0) for i, (lo, hi) in enumerate(zip(part.min(0), part.max(0)))]
            node, point, low, high, n = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), pa.array(point, pa.int32()), pa.array(low, pa.float64()), pa.array(high, pa.float64()), pa.array(n, pa.int64())],
                                             ["node", "point", "low", "high", "n"])
    return run


def build(nodes: DataFrame, width: int, sample: int = SAMPLE, leaf: int = LEAF, chunk: int = CHUNK) -> tuple[DataFrame, Tree]:
    """(nodes with leaf and chunk, the tree with the ranges of all of them). What comes to the driver is bounded by `sample`."""
    spark = nodes.sparkSession
    rows = nodes.count()
    taken = nodes.select("vec", "label").orderBy(F.xxhash64("vec"), "vec", "label").limit(max(1, min(sample, 2 ** 22 // width))).toArrow()
    tree = fit(matrix(taken["vec"], width), taken["label"].to_numpy(), rows, leaf)
    shared = spark.sparkContext.broadcast(tree)
    placed = settle(nodes.mapInArrow(_put(shared, width), f"leaf int, {NODE}"), "negatives-leaves")
    spans = (placed.mapInArrow(_ranges(shared, width), "node int, point int, low double, high double, n bigint").groupBy("node", "point")
             .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toArrow().to_pylist())
    for split in tree.splits.values():
        split.low = np.full((len(split.children), len(split.points)), np.inf)
        split.high = np.full((len(split.children), len(split.points)), -np.inf)
    parent = {c: (s, j) for s in tree.splits.values() for j, c in enumerate(s.children)}
    for r in spans:
        if r["point"] < 0:
            tree.length[r["node"]] = (r["low"], r["high"])
            tree.chunks[r["node"]] = -(-r["n"] // chunk)
        else:
            split, j = parent[r["node"]]
            split.low[j, r["point"]], split.high[j, r["point"]] = max(0.0, r["low"]), max(0.0, r["high"])
    chunks = {n: c for n, c in tree.chunks.items() if n not in tree.splits and c > 1}
    if not chunks:
        return placed.withColumn("chunk", F.lit(0)), tree
    of = F.create_map(*[F.lit(x) for pair in chunks.items() for x in pair])
    return placed.withColumn("chunk", F.pmod(F.xxhash64("vec", "label"), F.coalesce(of[F.col("leaf")], F.lit(1))).cast("int")), tree


# --- searching it

MEETING = "leaf int, chunk int, kind int, key string, label bigint, vec binary, ids array<bigint>, low array<bigint>, high array<bigint>"


def raised(tree: Tree, x: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, want: int, same: bool) -> np.ndarray:
    """Windows without what the sample alone proves to be useless: scores below its `want`-th best in the window."""
    scores = x @ tree.sample.T
    alike = labels[:, None] == tree.labels[None, :]
    right, low = alike if same else ~alike, low.copy()
    if scores.shape[1] >= want:
        for w in range(low.shape[1]):
            inside = np.where(right & (scores >= low[:, w, None]) & (scores <= high[:, w, None]), scores, -np.inf)
            low[:, w] = np.maximum(low[:, w], np.partition(inside, scores.shape[1] - want, 1)[:, scores.shape[1] - want])
    return low


def _route(tree, width: int, want: int, same: bool, home: bool) -> Callable:
    """Queries (key, label, vec, low, high), once for every leaf and chunk that they must see; `home`: their own leaf only."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x = matrix(part.column("vec"), width)
                low, high = _windows(part)
                low = raised(tree.value, x, part.column("label").to_numpy(), low, high, want, same)
                if home:
                    met = [(n, own) for n, own, d in descend(tree.value, x) if d is None and n in tree.value.length]
                else:
                    met = list(survivors(tree.value, x, low, high))
                for leaf, own in met:
                    chosen = part.take(pa.array(own))
                    for chunk in range(tree.value.chunks.get(leaf, 1)):
                        n = len(own)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, v, np.int32)) for v in (leaf, chunk, 1)]
                            + [chosen.column("key").cast(pa.string()), chosen.column("label"), chosen.column("vec").cast(pa.binary()),
                               pa.nulls(n, pa.list_(pa.int64())), _lists(low[own]), _lists(high[own])],
                            ["leaf", "chunk", "kind", "key", "label", "vec", "ids", "low", "high"])
    return run


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Windows as arrays of (query, window); queries with fewer are filled up with windows that ask for nothing."""
    out = []
    for name, fill in (("low", 1.0), ("high", 0.0)):
        lists = batch.column(name)
        sizes = np.diff(lists.offsets.to_numpy())
        filled = np.full((len(lists), max(1, sizes.max(initial=0))), fill)
        filled[np.arange(filled.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
        out.append(filled)
    return out[0], out[1]


def _lists(windows: np.ndarray) -> pa.Array:
    n, width = windows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(windows.ravel().astype(np.int64)))


def first(scores: np.ndarray, ids: list, want: int) -> list[tuple[int, int]]:
    """The `want` entries (score, id) of highest score, then smallest id; each node has a few ids."""
    if len(scores) > want:
        keep = scores >= np.partition(scores, len(scores) - want)[len(scores) - want]
        scores, ids = scores[keep], [i for i, k in zip(ids, keep) if k]
    return sorted(((int(s), i) for s, own in zip(scores, ids) for i in own), key=lambda e: (-e[0], e[1]))[:want]


def _meet(width: int, want: int, same: bool) -> Callable:
    """Best entries of each query and window within each leaf chunk; rows come sorted by leaf, chunk and kind."""
    def run(batches):
        at, held, ready = None, [], None
        for batch in batches:
            spots = np.column_stack([batch.column(c).to_numpy() for c in ("leaf", "chunk", "kind")])
            edges = [0, *(np.flatnonzero((spots[1:] != spots[:-1]).any(1)) + 1), len(spots)] if len(spots) else []
            found = []
            for a, b in zip(edges, edges[1:]):
                spot, part = tuple(spots[a, :2]), batch.slice(a, b - a)
                if spot != at:
                    at, held, ready = spot, [], None
                if spots[a, 2] == 0:
                    held.append((matrix(part.column("vec"), width), part.column("label").to_numpy(), part.column("ids").to_pylist()))
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = [np.concatenate(x) if i < 2 else sum(x, []) for i, x in enumerate(zip(*held))]
                x, labels, ids = ready
                for start in range(0, part.num_rows, 256):
                    some = part.slice(start, 256)
                    low, high = _windows(some)
                    scores = matrix(some.column("vec"), width) @ x.T
                    alike = some.column("label").to_numpy()[:, None] == labels[None, :]
                    right = alike if same else ~alike
                    keys = some.column("key").to_pylist()
                    for w in range(low.shape[1]):
                        inside = right & (scores >= low[:, w, None]) & (scores <= high[:, w, None])
                        for q in np.flatnonzero(inside.any(1)):
                            on = np.flatnonzero(inside[q])
                            found += [(keys[q], w, s, i) for s, i in first(scores[q, on], [ids[k] for k in on], want)]
            if found:
                key, w, s, i = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(w, pa.int32()), pa.array(s, pa.int64()), pa.array(i, pa.int64())],
                                                 ["key", "window", "score", "id"])
    return run


def search(leaves: DataFrame, tree, width: int, queries: DataFrame, want: int, same: bool, home: bool = False) -> DataFrame:
    """key, window, found: the `want` best (score, id) of each query's windows, among rows of its own label or of others."""
    asked = queries.mapInArrow(_route(tree, width, want, same, home), MEETING)
    held = leaves.select("leaf", "chunk", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("key"), "label", "vec", "ids",
                         *[F.lit(None).cast("array<bigint>").alias(c) for c in ("low", "high")])
    met = held.unionByName(asked).repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "kind")
    entries = met.mapInArrow(_meet(width, want, same), "key string, window int, score bigint, id bigint")
    best = F.row_number().over(Window.partitionBy("key", "window").orderBy(F.desc("score"), "id"))
    return (entries.withColumn("place", best).where(F.col("place") <= want).groupBy("key", "window")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score", "id"))), lambda e: F.struct(e["score"].alias("score"), e["id"].alias("id"))).alias("found")))


def mine(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 50, positives: int = 5,
         negatives: int = 3, sample: int = SAMPLE, leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 x). Anchors are rows whose id is divisible by `every`; positives are the first `positives`
    other rows of an anchor's label by inner product (ties: smaller id), negatives the first `negatives` rows of
    other labels whose score is from 50 % to 95 % of the positive's. Rows without id, label or vector, or with
    a null or non-finite component take no part, nor do vectors whose squared length reaches 2 ** 53 (or a component 2 ** 31).
    A shorter vector counts as padded with zeros. Repeated rows are each a row: a copy of the anchor is a positive, and
    an anchor that occurs twice is answered twice. An empty table gives none; other columns are not read.
    """
    spark = df.sparkSession
    rows, width = whole_numbers(df, vec_id, vector, label)
    rows = settle(rows, "negatives-vectors")
    # a node keeps the ids that can be asked for: the anchor itself and the positives, or the negatives
    keep = max(positives + 1, negatives)
    place = F.row_number().over(Window.partitionBy("label", "vec").orderBy("id"))
    nodes = (rows.withColumn("place", place).where(F.col("place") <= keep).groupBy("label", "vec")
             .agg(F.array_sort(F.collect_list("id")).alias("ids")))
    leaves, tree = build(settle(nodes, "negatives-nodes"), width, sample, leaf, chunk)
    shared = spark.sparkContext.broadcast(tree)

    anchors = rows.where(F.col("id") % every == 0).select("id", "label", "vec", _key().alias("key"))
    asked = settle(anchors.dropDuplicates(["key"]).select("key", "label", "vec"), "negatives-queries")

    def window(low, high):
        return [F.array(F.lit(x).cast("long")) if isinstance(x, int) else F.array(x) for x in (low, high)]

    # an anchor's own leaf first: what it gives bounds the search of the others from below
    low, high = window(-FAR, FAR)
    near = search(leaves, shared, width, asked.withColumns({"low": low, "high": high}), positives + 1, True, home=True)
    least = near.where(F.size("found") > positives).select("key", F.element_at("found", -1)["score"].alias("least"))
    bounded = asked.join(least, "key", "left").withColumns({"low": F.array(F.coalesce("least", F.lit(-FAR).cast("long"))), "high": high})
    best = settle(search(leaves, shared, width, bounded.select("key", "label", "vec", "low", "high"), positives + 1, True), "negatives-positives")

    # one window for each score that a positive has: 50 p <= 100 s <= 95 p
    levels = F.array_distinct(F.transform("found", lambda e: e["score"]))
    # (a negative score has no such window)
    half, most = (F.expr(f"transform(levels, p -> if(p < 0, {none}L, {bound}))") for bound, none in (("(p + 1) div 2", 1), ("p * 19 div 20", 0)))
    windows = asked.join(best.select("key", levels.alias("levels")), "key").select("key", "label", "vec", half.alias("low"), most.alias("high"))
    hard = search(leaves, shared, width, windows, negatives, False)

    positive = best.select("key", "found", levels.alias("levels"))
    answers = (positive.join(hard.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "found"))).alias("hard")), "key")
               .select("key", "found", "levels", "hard"))
    own = F.filter("found", lambda e: e["id"] != F.col("anchor_id"))
    seen = F.size(F.filter("found", lambda e: e["id"] == F.col("anchor_id")))
    # of rows that share the anchor's id one is the anchor; further ones are other rows
    again = F.when(seen > 1, F.slice(F.filter("found", lambda e: e["id"] == F.col("anchor_id")), F.lit(2), seen - 1)).otherwise(F.filter(F.col("found"), lambda e: F.lit(False)))
    others = F.slice(F.array_sort(F.concat(own, again), lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1))
                                  .when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)), 1, positives)
    # window numbers count from 0 in the order of levels
    pairs = (anchors.select(F.col("id").alias("anchor_id"), "key").join(answers, "key")
             .select("anchor_id", "levels", "hard", F.explode(others).alias("p"))
             .select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"),
                     F.col("hard")[(F.array_position("levels", F.col("p.score")) - 1).cast("int")].alias("n")))
    return pairs.select("anchor_id", "positive_id", "positive_score", F.posexplode("n").alias("at", "n")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score",
        F.col("n.score").alias("negative_score"))


def mine_sql(every: int = 50, positives: int = 5, negatives: int = 3) -> str:
    """The same rows by comparing all pairs, for small tables of distinct ids."""
    return f"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as v
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pair as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as alike, cast(list_inner_product(a.v, b.v) as bigint) as s
  from v a join v b on a.vec_id % {every} = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, id as positive_id, s as positive_score from pair where alike
  qualify row_number() over (partition by anchor_id order by s desc, id) <= {positives})
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by s desc, id) as int) as rank,
  id as negative_id, positive_score, s as negative_score
from p join pair using (anchor_id) where not alike and 50 * positive_score <= 100 * s and 100 * s <= 95 * positive_score
qualify rank <= {negatives}
"""
