"""N-gram Jaccard self-join: a MinHash LSH forest finds candidates, set intersection verifies them.

A document is the set of its five-word shingles. A tree of the forest orders documents by a label
of MinHash values; documents under one prefix of the label are candidates of each other. A link
of similarity s is found at prefix length d with probability 1 - (1 - s^d)^trees. The prefix is
shortened from the full label, in all trees at once, until that reaches the target recall for the
weakest link that counts, one at the threshold: every link is then found at least that surely,
whatever other links the table has.

Nothing is paired inside a bucket of the forest. A bucket gives one edge per document, to its
smallest member; components of these edges are the groups within which every pair is compared.
A group's sets are compared in blocks of bounded size, one task for each pair of blocks, by matrix
products; only sums per document leave the task, so rows never grow with the square of a group.
Copies (equal sets) are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import WORDS_SQL, free_name, words
from .graph import components

SIZE = 5                # words of a shingle
TREES = 32
DEPTH = 7               # MinHash values of a full label
LEAST_DEPTH = 1         # reaches a recall of 0.9999 for links from 0.25 on
BLOCK = 400_000         # shingles of a block; a node counts NODE more
NODE = 400

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 63, TREES * DEPTH, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, TREES * DEPTH, np.int64).astype(np.uint64)


def shingle_set(word_hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit shingle values; a text of fewer words is one shingle of them all."""
    w = word_hashes.astype(np.uint64)
    if not len(w):
        return w
    span = min(size, len(w))
    h = np.full(len(w) - span + 1, span, np.uint64)
    for j in range(span):
        h = h * _MULTIPLIER + w[j:len(w) - span + 1 + j]
    return np.unique(mixed(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[k:k + 2048, None] * _A + _B).min(0))
    return low


def prefix_keys(sig: np.ndarray) -> dict[int, np.ndarray]:
    """For each prefix length, one 64-bit key per tree for the label's prefix."""
    labels, keys = sig.reshape(TREES, DEPTH), {}
    key = mixed(np.arange(TREES, dtype=np.uint64), 77)
    for d in range(DEPTH):
        key = mixed(key * _MULTIPLIER + labels[:, d])
        keys[d + 1] = key
    return keys


def _sketch(docs: DataFrame, doc: str, text: str, depth: int) -> DataFrame:
    """doc, mark (hash of the text), node, twin (128 bits that name the shingle set), n, keys (of the prefixes)."""
    def run(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("node", "twin", "n", "keys")}
            column = batch.column("w")
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            for a, b in zip(ends[:-1], ends[1:]):
                s = shingle_set(flat[a:b])
                out["n"].append(len(s))
                if not len(s):
                    for c in out:
                        if c != "n":
                            out[c].append(None)
                    continue
                out["node"].append(np.int64(mixed(s, 1).sum(dtype=np.uint64).astype(np.int64)))
                out["twin"].append(np.int64(mixed(s, 2).sum(dtype=np.uint64).astype(np.int64)))
                out["keys"].append(prefix_keys(signature(s))[depth].astype(np.int64))
            kinds = {c: pa.list_(pa.int64()) if c == "keys" else pa.int64() for c in out}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("mark"), *(pa.array(v, kinds[c]) for c, v in out.items())],
                names=["doc", "mark", *out])

    kind = docs.schema[doc].dataType.simpleString()
    schema = f"doc {kind}, mark bigint, node bigint, twin bigint, n bigint, keys array<bigint>"
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    return docs.select(F.col(doc).alias("doc"), F.xxhash64(F.col(text)).alias("mark"), hashes.alias("w")).mapInArrow(run, schema)


def found_share(similarity: np.ndarray, depth: int) -> np.ndarray:
    """Probability that the forest shows a link of that similarity at that prefix length."""
    return 1 - (1 - similarity ** depth) ** TREES


def depth_for(threshold: float, target_recall: float) -> int:
    """The longest prefix that shows a link at the threshold with the target's probability."""
    for depth in range(DEPTH, LEAST_DEPTH - 1, -1):
        if found_share(threshold, depth) >= target_recall:
            return depth
    raise ValueError(f"the forest can't find links of {threshold} with a recall of {target_recall}")


def _compare(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node", ignore_index=True)
        sets = [shingle_set(np.asarray(w, np.int64)) for w in group["w"]]
        k, lengths = len(sets), np.array([len(s) for s in sets], np.float64)
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(k), lengths.astype(np.int64))
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        shared = np.zeros((k, k))
        for first in range(0, int(at[-1]) + 1, 4096):       # a shingle is a column
            a, b = np.searchsorted(at, (first, first + 4096))
            marks = np.zeros((k, 4096), np.float32)
            marks[owner[a:b], at[a:b] - first] = 1
            shared += marks @ marks.T
        similarity = shared / (lengths[:, None] + lengths[None, :] - shared)
        linked = similarity >= threshold - 1e-12
        np.fill_diagonal(linked, False)
        block, i, j = group["block"].to_numpy(), group["i"].iloc[0], group["j"].iloc[0]
        if i != j:                                          # pairs inside a block belong to that block's own task
            linked &= block[:, None] != block[None, :]
        label = np.arange(k)
        reach = linked | np.eye(k, dtype=bool)
        while True:
            new = np.where(reach, label[None, :], k).min(1)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        return pd.DataFrame({"node": group["node"], "label": group["node"].to_numpy()[label],
                             "links": (linked * group["m"].to_numpy()[None, :]).sum(1).astype(np.int64)})

    return run


def _verified(docs: DataFrame, sketch: DataFrame, doc: str, text: str, threshold: float) -> DataFrame:
    """node, label, links of the nodes that have candidates."""
    rows = sketch.select("node", F.explode("keys").alias("key")).repartition("key")
    heads = rows.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("other")).where("head != other")
    edges = rows.join(heads, "key").where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    groups = components(edges).withColumnRenamed("label", "knot")
    texts = (sketch.join(groups, "node").groupBy("knot", "node", "mark")
             .agg(F.count("*").alias("m"), F.min("doc").alias("doc"), F.min("n").alias("n")))
    nodes = settle(texts.groupBy("knot", "node").agg(
        F.sum("m").alias("m"), F.min("n").alias("n"), F.min(F.struct("mark", "doc")).alias("one")), "near-nodes")
    sizes = nodes.groupBy("knot").agg(F.ceil(F.sum(F.col("n") + NODE) / F.lit(BLOCK)).alias("blocks"))
    plan = nodes.join(sizes, "knot").select(
        "knot", "node", "m", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
        F.col("one.mark").alias("mark"), F.col("one.doc").alias("doc"))
    d = docs.select(F.xxhash64(F.col(text)).alias("d_mark"), F.col(doc).alias("d_doc"), F.col(text).alias("text"))
    # a merge join at every size: the candidates grow with the corpus and are not to be broadcast
    one = (d.join(plan.hint("merge"), (F.col("d_mark") == F.col("mark")) & F.col("d_doc").eqNullSafe(F.col("doc")))
           .select("knot", "node", "m", "blocks", "block", F.transform(words("text"), lambda w: F.xxhash64(w)).alias("w")))
    pair = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("with")
    blocks = one.select("*", pair).select(
        "knot", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "m", "w")
    compared = blocks.groupBy("knot", "i", "j").applyInPandas(
        _compare(threshold), "node bigint, label bigint, links bigint")
    return settle(compared, "near-links")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = 0.8,
                    target_recall: float = 0.9999) -> DataFrame:
    """doc, class_id, n_links: one row for each document.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is at
    least `threshold`; n_links counts the linked rows, copies included. A class is a connected
    component of links; class_id is its smallest doc. Words stand between ASCII blanks. A text of
    one to four words is one shingle; null, empty and blank texts have no shingle, no link and a
    class of their own. Rows with equal doc and text are copies. Other columns are not looked at.
    """
    return _classes(docs, doc, text, threshold, target_recall).select(F.col("doc").alias(doc), "class_id", "n_links")


def _classes(docs: DataFrame, doc: str, text: str, threshold: float = 0.8, target_recall: float = 0.9999) -> DataFrame:
    """doc, mark (hash of the text), label (of the class; null without words), class_id, n_links of each row."""
    sketch = settle(_sketch(docs, doc, text, depth_for(threshold, target_recall)), "near-sketch")
    verified = _verified(docs, sketch, doc, text, threshold)
    tied = verified.groupBy("node").agg(F.min("label").alias("label"), F.max("label").alias("high"), F.sum("links").alias("links"))
    tied = settle(tied, "near-tied")
    if tied.where("label != high").limit(1).count():        # groups of several blocks: join their parts
        parts = components(verified.select(F.col("node").alias("a"), F.col("label").alias("b")))
        tied = tied.drop("label").join(parts, "node")
    copies = sketch.where("node is not null").groupBy("node", "twin").agg(F.count("*").alias("m"), F.min("doc").alias("first"))
    copies = copies.join(tied.select("node", "label", "links"), "node", "left").select(
        "node", "twin", "first", F.coalesce("label", "node").alias("label"),
        (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    copies = settle(copies, "near-copies")
    classes = copies.groupBy("label").agg(F.min("first").alias("class_id"))
    out = sketch.select("doc", "mark", "node", "twin").join(
        copies.join(classes, "label").select("node", "twin", "label", "class_id", "n_links"), ["node", "twin"], "left")
    return out.select("doc", "mark", "label", F.coalesce("class_id", "doc").alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, with its own columns: the smallest doc, and of several texts
    under that doc the one with the smallest hash. Documents without words all stay. Of rows that
    are equal in doc and text one stays.
    """
    rows = settle(_classes(docs, doc, text, **options).where("label is not null").groupBy("label", "doc", "mark")
                  .agg(F.count("*").alias("rows")), "near-rows")
    mark, times, at_doc, at_mark = (free_name(docs, n) for n in ("mark", "rows", "at_doc", "at_mark"))
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "mark")).alias("one"))
    first = first.select("label", F.col("one.doc").alias(at_doc), F.col("one.mark").alias(at_mark))
    stay = rows.join(first, "label").where(F.col("doc").eqNullSafe(F.col(at_doc)) & (F.col("mark") == F.col(at_mark)))
    stay = stay.select(at_doc, at_mark, F.col("rows").alias(times))
    kept = (docs.withColumn(mark, F.xxhash64(F.col(text)))
            .join(stay, (F.col(mark) == F.col(at_mark)) & F.col(doc).eqNullSafe(F.col(at_doc)), "left")
            .where(F.col(times).isNotNull() | ~F.coalesce(F.col(text), F.lit("")).rlike(WORDS_SQL)))
    several = F.coalesce(F.col(times) > 1, F.lit(False))
    once, repeated = kept.where(~several), kept.where(several).dropDuplicates([doc, mark])
    return once.unionByName(repeated).select(*docs.columns)
