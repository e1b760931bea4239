"""Hard negatives against all pairs, and what the tree rules out."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuespark.llm import negatives


def brute(rows, every=50, positives=5, wanted=3):
    live = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for k, (i, v, label) in enumerate(live):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, y) for n, (j, w, y) in enumerate(live) if n != k]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            hard = sorted(x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:wanted]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(hard, 1)]
    return sorted(out)


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(parts)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)).astype(np.float32)
    rows = [(i, (centres[k := int(rng.integers(12))] * rng.choice([1, 1, 3]) + rng.normal(scale=.15, size=6)).astype(np.float32).tolist(), int((k + rng.integers(3)) % 10))
            for i in range(900)]
    return rows + [(2000 + i, rows[3][1], int(i % 3)) for i in range(400)]         # one vector in hundreds of copies


@pytest.mark.parametrize("options", [{}, {"leaf": 40, "sample": 300, "chunk": 25}, {"leaf": 10, "sample": 1300}, {"sample": 1}])
def test_equal_to_brute_force(spark, clustered, options):
    got = negatives.mine(table(spark, clustered), **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(clustered)


def _tree(x, leaf):
    tree = negatives.fit(x, np.zeros(len(x), int), len(x), leaf)
    rows = [r for b in negatives._ranges(type("B", (), {"value": tree}), x.shape[1])(
        [pa.RecordBatch.from_pydict({"vec": [v.astype("<i4").tobytes() for v in x]})]) for r in b.to_pylist()]
    parent = {c: (s, j) for s in tree.splits.values() for j, c in enumerate(s.children)}
    for s in tree.splits.values():
        s.low, s.high = np.full((len(s.children), len(s.points)), np.inf), np.full((len(s.children), len(s.points)), -np.inf)
    for r in rows:
        if r["point"] < 0:
            tree.length[r["node"]] = (r["low"], r["high"])
        else:
            s, j = parent[r["node"]]
            s.low[j, r["point"]], s.high[j, r["point"]] = r["low"], r["high"]
    return tree


@pytest.mark.parametrize("seed", range(5))
def test_elimination_is_safe_and_eliminates(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=200, size=(30, 8))
    x = np.floor(centres[rng.integers(30, size=3000)] + rng.normal(scale=8, size=(3000, 8)))
    tree = _tree(x, 60)
    home = np.zeros(len(x), int)
    for n, own, d in negatives.descend(tree, x):
        if d is None:
            home[own] = n
    queries = x[rng.integers(3000, size=40)]
    scores = queries @ x.T
    best = np.sort(scores, 1)[:, ::-1]
    low, high = np.floor(best[:, [5, 900]] * .95), np.ceil(best[:, [0, 900]])
    met = {n: set(own.tolist()) for n, own in negatives.survivors(tree, queries, low, high)}
    inside = ((scores[:, None, :] >= low[:, :, None]) & (scores[:, None, :] <= high[:, :, None])).any(1)
    for q, k in zip(*np.nonzero(inside)):
        assert q in met.get(home[k], ())
    top = sum(len(own) for _, own in negatives.survivors(tree, queries, np.floor(best[:, 5:6]), best[:, :1]))
    assert top < 0.5 * len(queries) * len(set(home.tolist()))      # near neighbours leave most leaves out


def test_edges(spark):
    v = [1.0, 0.5, -0.25]
    rows = [(0, v, 1), (0, v, 1), (0, [1.0, 0.5], 1), (50, v, None), (100, None, 1), (150, [1.0, None], 1), (None, v, 1), (200, [float("nan"), 1.0], 2),
            (250, [float("inf")], 1), (300, [], 3), (350, [3e38], 1), (1, [0.75, 0.5], 2), (2, [0.75, 0.5], 2), (3, v, 4), (4, [0.9] * 3, 5), (5, [-1.0, -1.0], 1), (400, [0.001], 1)]
    got = negatives.mine(table(spark, rows).withColumns({c: F.lit("x") for c in ("id", "vec", "leaf", "chunk", "key", "rank", "ids")}))
    # the row with a component too large for exact products takes no part
    want = brute([r for r in rows if r[0] != 350])
    assert sorted(map(tuple, got.collect())) == want and want
    assert negatives.mine(table(spark, rows[:1])).collect() == []
    assert negatives.mine(table(spark, rows).limit(0)).collect() == []
    assert negatives.mine(table(spark, [(100, None, 1), (None, None, None)])).collect() == []


def test_query_has_every_anchor(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted(map(tuple, negatives.mine(df, leaf=50).collect())) == brute(rows)
