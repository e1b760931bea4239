"""Katz backoff of order 3: trigrams, below them the discounted bigrams of `katz`, below those its unigrams.

A seen trigram has its count, discounted by Good-Turing, over that of its two words of context; for an unseen one the context's
backoff weight is multiplied by the bigram level, which backs off in the same way. Discounts are of each order's own counts of counts.
Every text begins with two starts, so that a bigram's count is the sum of its trigrams' counts.

Work is dealt by the word before the scored one, as in `katz`: a bucket holds a word's trigrams with all words before it, and so its
bigrams and both levels of contexts. Only for the words that are split over buckets the two-word contexts are summed up
across buckets. Words that the sample finds frequent go between tasks as two-byte codes, all others as their hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import settle
from . import katz
from .common import bytes_of, text_of
from .katz import (CUTOFF, DELTA, SAMPLE, SLICE, SUMS, Deal, WordHashes, _arrays, _bounds, _by_run, _discard, _flat, _lookup,
                   _packed_rows, _pieces, _plain, _squeezed, _sums, by_context, by_key, good_turing, in_order,
                   lean_shuffles, mixed, pair_key)

CODES = 65_000                  # frequent words that have codes
ESCAPE = 65_535                 # stands for a word without one
SLOT_BITS = 21                  # of a hash, by which its code is looked up
START, END = np.uint64(0), np.uint64(1)
# h: each context word once, n: how many w are its own; m: how many u and c are a pair's own; the x columns hold words without codes
NGRAMS = "bucket int, h binary, hx binary, n binary, w binary, wx binary, m binary, u binary, ux binary, c binary"
PAIRS = "r int, bucket int, k binary, c binary, kept binary, below binary"
CONTEXTS = "bucket int, ch binary, cc binary, cw binary, cb binary"       # word, its count, whole, weight
WEIGHTS = "r int, bucket int, k binary, whole binary, weight binary, own binary"


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Words(WordHashes):
    """The code of a frequent word, the hash of any other. often: of each slot, one word at most."""

    def __init__(self, often: np.ndarray):
        self.often = np.append(np.zeros(2, np.uint64), often)           # by code
        self.codes = np.zeros(1 << SLOT_BITS, np.uint16)
        self.codes[_slot(often)] = np.arange(2, len(self.often))

    def of_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h, n = super().of_all(texts)
        code = self.codes[_slot(h)]
        return np.where((code > 0) & (self.often[code] == h), code, np.maximum(h, np.uint64(ESCAPE + 1))), n


@dataclass
class Plan:
    """How bigrams are dealt, in codes; the hashes of the words that have one."""
    deal: Deal
    often: np.ndarray


def _plan(rows: DataFrame) -> Plan:
    """From a sample by place, as katz._deal; at most CODES rows come to the driver."""
    chosen = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SAMPLE)) == 0
    seen = settle(rows.where(chosen).mapInArrow(katz._sampled, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "katz-sample")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(8, math.ceil(3 * total * SAMPLE / katz.BUCKET))       # of a third of the tokens, as a task holds both orders of them
    least = min(buckets, 2048)
    top = [(r["h"] % (1 << 64), r["n"]) for r in seen.orderBy(F.desc("n"), "h").limit(CODES).collect()]
    often = np.array([h for h, _ in top if h != int(katz.START)], np.uint64)
    often = often[np.sort(np.unique(_slot(often), return_index=True)[1])]       # the most frequent one of a slot
    code = {h: i + 2 for i, h in enumerate(often.tolist())} | {int(katz.START): int(START)}
    parts = {code.get(h, max(h, ESCAPE + 1)): math.ceil(n * least / total) for h, n in top if n * least > total}
    keys = sorted(parts)
    return Plan(Deal(buckets, np.array(keys, np.uint64), np.array([parts[k] for k in keys], np.int64)), often)


def _split(deal: Deal, h: np.ndarray) -> np.ndarray:
    return np.isin(h, deal.split)


def _coded(bounds: np.ndarray, words: np.ndarray) -> list[pa.Array]:
    """The words between each two bounds: codes, and what has none."""
    rare = words >= ESCAPE
    codes = np.where(rare, np.uint64(ESCAPE), words).astype(np.uint16)
    return [_packed_rows(bounds, codes), _packed_rows(np.append(0, np.cumsum(rare))[bounds], words[rare], _plain)]


def _decoded(codes: np.ndarray, rest: np.ndarray) -> np.ndarray:
    words = codes.astype(np.uint64)
    words[codes == ESCAPE] = rest
    return words


def _words(table: pa.Table, name: str) -> np.ndarray:
    return _decoded(_flat(table, name, np.uint16), _flat(table, name + "x", np.uint64))


def _before(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The word before each context word of the same text."""
    u = np.full(len(h), START)
    inner = np.flatnonzero(row[1:] == row[:-1]) + 1
    u[inner] = h[inner - 1]
    return u


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _ngram_rows(bucket: np.ndarray, at: np.ndarray, h: np.ndarray, w: np.ndarray, u: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """Columns of NGRAMS, a row between each two bounds."""
    new = _changes(h)
    new[at[:-1]] = True
    contexts = np.flatnonzero(new)
    pairs = np.flatnonzero(new | _changes(w)) if len(h) else contexts
    of, end = np.searchsorted(pairs, at), np.append(pairs, len(h))
    n = np.diff(np.searchsorted(pairs, np.append(contexts, len(h)))).astype(np.int32)
    to = np.searchsorted(contexts, at)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[at[:-1]], pa.int32()), *_coded(to, h[contexts]), _packed_rows(to, n), *_coded(of, w[pairs]),
         _packed_rows(of, np.diff(end).astype(np.int32)), *_coded(at, u), _packed_rows(at, c)],
        names=["bucket", "h", "hx", "n", "w", "wx", "m", "u", "ux", "c"])


def _count(plan):
    def run(batches):
        words, deal = Words(plan.value.often), plan.value.deal
        for batch in batches:
            for _, _, h, w, row in _pieces(batch, words, START, END):
                u = _before(h, row)
                bucket = deal.bucket(h, w)
                at = mixed(h)
                pair = mixed(at + w)
                key = ((at >> np.uint64(48)) << np.uint64(48)) | ((pair >> np.uint64(52)) << np.uint64(36)) | (mixed(pair + u) >> np.uint64(28))
                order = by_key(key, bucket)
                h, w, u, bucket = h[order], w[order], u[order], bucket[order]
                first = np.flatnonzero(_changes(bucket, h, w, u))       # a trigram that comes twice is added up in its bucket
                c = np.diff(np.append(first, len(h))).astype(np.int64)
                h, w, u, bucket = h[first], w[first], u[first], bucket[first]
                yield _ngram_rows(bucket, _bounds(bucket), h, w, u, c)

    return run


def _spread(table: pa.Table):
    """(contexts, n, w, m, u, c) of all rows."""
    return (_words(table, "h"), _flat(table, "n", np.int32), _words(table, "w"), _flat(table, "m", np.int32), _words(table, "u"), _flat(table, "c"))


def merged(h: np.ndarray, w: np.ndarray, u: np.ndarray, c: np.ndarray):
    """Distinct trigrams with their summed counts; those of a context are together, and in it those of a pair."""
    if not len(h):
        return h, w, u, c
    pairs = pair_key(h, w)
    triples = pair_key(pairs, u)
    order = in_order(triples)
    at = np.flatnonzero(_changes(triples[order]))
    first, c = order[at], np.add.reduceat(c[order], at)
    del triples
    first, c, pairs = first[order := in_order(pairs[first])], c[order], pairs[first[order]]
    at = np.flatnonzero(_changes(pairs))
    run, to = np.diff(np.append(at, len(pairs))), in_order(mixed(h[first[at]]))       # pairs as they are, and by context
    ahead = np.cumsum(run[to]) - run[to]
    order = np.arange(len(pairs)) + np.repeat(at[to] - ahead, run[to])
    first, c = first[order], c[order]
    return h[first], w[first], u[first], c


def _merge(table: pa.Table) -> pa.Table:
    pa.default_memory_pool().release_unused()       # what earlier buckets took
    bucket = table.column("bucket")[0].as_py()
    h, n, w, m, u, c = _spread(table)
    del table
    h, w, u, c = merged(np.repeat(np.repeat(h, n), m), np.repeat(w, m), u, c)
    pairs = np.flatnonzero(_changes(h, w))                  # a pair stays whole
    at = np.unique(np.append(pairs[np.searchsorted(pairs, np.arange(0, pairs[-1] + 1, SLICE))], len(h)))
    return pa.Table.from_batches([_ngram_rows(np.full(len(h), bucket, np.int32), at, h, w, u, c)])


def _each(batches):
    """(bucket, contexts, n, w, m, c) of every stored row."""
    for batch in batches:
        kinds = {"h": np.uint16, "hx": np.uint64, "n": np.int32, "w": np.uint16, "wx": np.uint64, "m": np.int32, "c": np.int64}
        for bucket, (h, hx, n, w, wx, m, c) in zip(batch.column("bucket").to_pylist(), _arrays(batch, **kinds)):
            yield bucket, _decoded(h, hx), n, _decoded(w, wx), m, c


def _context_counts(batches):
    for _, h, n, _, m, c in _each(batches):
        yield pa.RecordBatch.from_pydict({"w": h.view(np.int64), "c": _by_run(n, _by_run(m, c))})


def _counts_of_counts(batches):
    totals = np.zeros((2, CUTOFF + 2), np.int64)
    for _, _, _, _, m, c in _each(batches):
        for total, x in zip(totals, (_by_run(m, c), c)):
            total += np.bincount(np.minimum(x, CUTOFF + 2), minlength=CUTOFF + 3)[:CUTOFF + 2]
    yield pa.RecordBatch.from_pydict({"o": np.repeat([2, 3], CUTOFF + 2), "r": np.tile(np.arange(CUTOFF + 2), 2), "n": totals.ravel()})


def _followers(batches):
    """Words without codes that each bucket has to know the counts of."""
    for bucket, _, _, w, _, _ in _each(batches):
        w = np.unique(w[w > ESCAPE])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), bucket), pa.int32()), pa.array(w.view(np.int64))], names=["bucket", "w"])


@dataclass
class Model:
    """Tables: ngrams (NGRAMS), unigrams (w, c), contexts (CONTEXTS), pairs (WEIGHTS; of split words only).

    often: counts of the words that have codes; discounts: those of bigrams and of trigrams; whole and weight as in katz.Model.
    """
    plan: Plan
    ngrams: DataFrame
    unigrams: DataFrame
    contexts: DataFrame
    pairs: DataFrame
    often: np.ndarray
    discounts: list[np.ndarray]
    tokens: int
    vocabulary: int
    documents: int

    @property
    def base(self) -> float:
        return self.tokens + DELTA * (self.vocabulary + 1)


def _freed(c: np.ndarray, kept: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what discounted counts are divided by, backoff weight) of contexts."""
    whole = np.where(kept < c, c, c + 1).astype(float)
    return whole, (1 - kept / whole) / (1 - below)


def _context_sums(plan, often, d: np.ndarray, base: float):
    """Contexts of a word as CONTEXTS; if it is split, cw and cb are the sums over this bucket's share of what is kept and what is below."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        h, n, w, m, _, c = _spread(left)
        c, names, rare = _by_run(m, c), right.column("w").to_numpy().view(np.uint64), w > ESCAPE
        low, order = np.empty(len(w)), np.argsort(names)
        low[~rare] = often.value[w[~rare].astype(np.int64)]
        low[rare] = right.column("c").to_numpy()[order][np.searchsorted(names[order], w[rare])]
        keys, inverse = np.unique(h, return_inverse=True)          # a context's run may be cut by SLICE
        sums = [np.bincount(inverse, _by_run(n, x), len(keys)) for x in (c, d[np.minimum(c, CUTOFF + 1)] * c, (low + DELTA) / base)]
        split = _split(plan.value.deal, keys)
        order = np.argsort(split, kind="stable")
        at = [0, len(keys) - int(split.sum()), len(keys)]
        columns = (keys, sums[0].astype(np.int64), *(np.where(split, x, y) for x, y in zip(sums[1:], _freed(*sums))))
        return pa.Table.from_arrays([pa.array([left.column("bucket")[0].as_py()] * 2, pa.int32()), pa.array([False, True]),
                                     *(_packed_rows(at, x[order]) for x in columns)], names=["bucket", "split", "ch", "cc", "cw", "cb"])

    return run


def _rows_of_sums(batches):
    for batch in batches:
        for h, c, kept, below in _arrays(batch, ch=np.int64, cc=np.int64, cw=float, cb=float):
            yield pa.RecordBatch.from_pydict({"h": h, "c": c, "kept": kept, "below": below})


def _split_contexts(deal: Deal, sums: DataFrame) -> list[tuple]:
    """Rows of CONTEXTS of the split words, a few thousand at most: known wherever a bigram of them can be asked for, not only where one was seen."""
    rows = (sums.where("split").mapInArrow(_rows_of_sums, "h bigint, c bigint, kept double, below double")
            .groupBy("h").agg(F.sum("c"), F.sum("kept"), F.sum("below")).collect())
    found = {h: (c, *map(float, _freed(c, kept, below))) for h, c, kept, below in rows}
    homes = {}
    for bucket, h in deal.homes():
        if h in found:
            homes.setdefault(bucket, []).append((h, *found[h]))
    return [(bucket, *(bytearray(_squeezed(np.array(x, kind))) for x, kind in zip(zip(*rows), (np.int64, np.int64, float, float))))
            for bucket, rows in homes.items()]


class Bucket:
    """Trigrams and bigrams of a bucket with their probabilities, and its contexts of two words."""

    def __init__(self, left: pa.Table, discounts: list[np.ndarray]):
        pa.default_memory_pool().release_unused()
        two, three = discounts
        h, n, w, m, u, c = _spread(left)
        contexts, seen_c, whole, weight = (_flat(left, x, k) for x, k in (("ch", np.int64), ("cc", np.int64), ("cw", float), ("cb", float)))
        order = np.argsort(contexts)
        self.contexts, self.seen_c, self.whole, self.weight = contexts[order], seen_c[order], whole[order], weight[order]
        h, times = np.repeat(h, n), _by_run(m, c)
        place, _ = _lookup(self.contexts, h.view(np.int64))
        pairs = pair_key(h, w)
        value = two[np.minimum(times, CUTOFF + 1)] * times / self.whole[place] if len(h) else np.empty(0)
        triples, self.of = pair_key(np.repeat(pairs, m), u), pair_key(u, np.repeat(h, m))
        self.h, self.c = np.repeat(h, m), c
        del u, w, n, times
        self.kept = three[np.minimum(c, CUTOFF + 1)] * c
        self.below = np.repeat(value, m)
        order = in_order(pairs)
        self.pairs, self.value = pairs[order], value[order]
        self.order = in_order(triples)
        self.triples = triples[self.order]

    def sums(self, chosen=slice(None)):
        """(contexts of two words, c, kept, below, which of them each chosen trigram has)."""
        of = self.of[chosen]
        order, inverse = in_order(of), np.empty(len(of), np.int64)
        keys = of[order]
        new = _changes(keys)
        keys, inverse[order] = keys[new], np.cumsum(new) - 1
        return (keys, *(np.bincount(inverse, x[chosen], len(keys)) for x in (self.c, self.kept, self.below)), inverse)

    def ready(self, k: np.ndarray, whole: np.ndarray, weight: np.ndarray) -> None:
        """Probabilities of the trigrams; k, whole, weight: contexts that other buckets have a share of."""
        self.two, *sums, inverse = self.sums()
        self.two_whole, self.two_weight = _freed(*sums)
        at, _ = _lookup(self.two, k)
        self.two_whole[at], self.two_weight[at] = whole, weight
        self.three = (self.kept / self.two_whole[inverse])[self.order]
        del self.h, self.c, self.kept, self.below, self.of, self.order


def _split_sums(plan, discounts: list[np.ndarray]):
    def run(table: pa.Table) -> pa.Table:
        b, deal = Bucket(table, discounts), plan.value.deal
        keys, c, kept, below, _ = b.sums(_split(deal, b.h))
        r = ((keys >> np.uint64(1)) % np.uint64(deal.buckets)).astype(np.int32)
        order = np.argsort(r, kind="stable")
        at = _bounds(r[order]) if len(r) else np.zeros(1, np.int64)
        bucket = table.column("bucket")[0].as_py()
        return pa.Table.from_arrays([pa.array(r[order][at[:-1]], pa.int32()), pa.array([bucket] * (len(at) - 1), pa.int32()),
                                     *(_packed_rows(at, x[order]) for x in (keys, c, kept, below))], names=["r", "bucket", "k", "c", "kept", "below"])

    return run


def _pair_weights(table: pa.Table) -> pa.Table:
    """Each bucket's contexts of two words with their weights; `own` once for each of them."""
    parts = [x for batch in table.to_batches() for x in _arrays(batch, k=np.uint64, c=float, kept=float, below=float)]
    k, *sums = (np.concatenate(x) for x in zip(*parts))
    keys, first, inverse = np.unique(k, return_index=True, return_inverse=True)
    whole, weight = _freed(*(np.bincount(inverse, x, len(keys)) for x in sums))
    own = np.zeros(len(k), np.uint8)
    own[first] = 1
    at = np.cumsum([0, *(len(p[0]) for p in parts)])
    return pa.Table.from_arrays([*(table.column(n).combine_chunks() for n in ("r", "bucket")), *(_packed_rows(at, x) for x in (k, whole[inverse], weight[inverse], own))],
                                names=["r", "bucket", "k", "whole", "weight", "own"])


def _logs_of_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """Logarithms of the weights of those contexts of two words (left) that are known (right, as WEIGHTS)."""
    own = _flat(right, "own", np.uint8) == 1
    keys, weight = _flat(right, "k", np.uint64)[own], _flat(right, "weight", float)[own]
    order, wanted = np.argsort(keys), left.column("k").to_numpy()
    at, known = _lookup(keys[order], wanted.view(np.uint64))
    return pa.table({"k": wanted[known], "log": np.log10(weight[order][at[known]])})


def _left(ngrams: DataFrame, contexts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """What a bucket needs to know, in rows of their own: NGRAMS, CONTEXTS, packed contexts of two words."""
    tables = [ngrams, contexts] + ([pairs.select("bucket", "k", F.col("whole").alias("kw"), F.col("weight").alias("kb"))] if pairs is not None else [])
    names = list(dict.fromkeys([*ngrams.columns, *contexts.columns, "k", "kw", "kb"]))
    tables = [t.select([n if n in t.columns else F.expr("X''").alias(n) for n in names]) for t in tables]
    return reduce(DataFrame.unionByName, tables)


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts all documents given; a null text is empty (its end is still a token)."""
    spark = docs.sparkSession
    rows = docs.select(bytes_of(text).alias("text"))
    with lean_shuffles(spark):
        plan = _plan(rows)
        shared = spark.sparkContext.broadcast(plan)
        ngrams = settle(rows.mapInArrow(_count(shared), NGRAMS).groupBy("bucket").applyInArrow(_merge, NGRAMS), "katz-ngrams")
        # every token but the end is a context as often as it occurs, and the start as often as the end
        start, end = F.lit(int(START)), F.lit(int(END))
        unigrams = settle(ngrams.mapInArrow(_context_counts, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c"))
                          .select(F.when(F.col("w") == start, end).otherwise(F.col("w")).alias("w"), "c"), "katz-unigrams")
        total, size, documents = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"),
                                              F.coalesce(F.sum(F.when(F.col("w") == end, F.col("c"))), F.lit(0))).first()
        counts = ngrams.mapInArrow(_counts_of_counts, "o bigint, r bigint, n bigint").groupBy("o", "r").agg(F.sum("n").alias("n")).collect()
        discounts = [np.array([*good_turing({c["r"]: c["n"] for c in counts if c["o"] == o}), 1.0]) for o in (2, 3)]
        often = np.zeros(ESCAPE, np.int64)
        for w, c in unigrams.where(F.col("w").between(1, ESCAPE - 1)).collect():
            often[w] = c
        model = Model(plan, ngrams, unigrams, None, None, often, discounts, total, size, documents)

        known = ngrams.mapInArrow(_followers, "bucket int, w bigint").join(unigrams, "w")
        sums = settle(ngrams.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(
            _context_sums(shared, spark.sparkContext.broadcast(often), discounts[0], model.base), CONTEXTS.replace(",", ", split boolean,", 1)), "katz-contexts")
        model.contexts = sums.where("not split").drop("split")
        if len(plan.deal.split):
            model.contexts = model.contexts.unionByName(spark.createDataFrame(_split_contexts(plan.deal, sums), CONTEXTS))
        if len(plan.deal.split):
            model.pairs = settle(_left(ngrams, model.contexts).groupBy("bucket").applyInArrow(_split_sums(shared, discounts), PAIRS)
                                 .groupBy("r").applyInArrow(_pair_weights, WEIGHTS), "katz-pairs")
    return model


def _occurrences(plan, key: pa.DataType):
    def run(batches):
        chunk, words, deal = TaskContext.get().partitionId() << 32, Words(plan.value.often), plan.value.deal
        for batch in batches:
            for a, b, h, w, row in _pieces(batch, words, START, END):
                u, bucket = _before(h, row), deal.bucket(h, w)
                order = by_context(h, bucket)
                at = _bounds(bucket[order])
                bounds, keys, runs = katz._runs(h[order], at)
                n = len(at) - 1
                docs = pa.ListArray.from_arrays(       # once for a chunk
                    pa.array(np.append(0, np.full(n, b - a)), pa.int32()), batch.column("doc").slice(a, b - a).cast(key))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[order][at[:-1]], pa.int32()), pa.array(np.full(n, chunk), pa.int64()), pa.array(np.full(n, b - a), pa.int32()),
                     docs, *_coded(bounds, keys), _packed_rows(bounds, runs), *_coded(at, w[order]), *_coded(at, u[order]), _packed_rows(at, row[order])],
                    names=["bucket", "chunk", "size", "docs", "h", "hx", "n", "w", "wx", "u", "ux", "row"])
                chunk += 1

    return run


def _score(plan, often, discounts: list[np.ndarray], base: float, documents: int, key: pa.DataType):
    end_base = math.log10((documents + DELTA) / base)
    asked = {"h": np.uint16, "hx": np.uint64, "n": np.int32, "w": np.uint16, "wx": np.uint64, "u": np.uint16, "ux": np.uint64, "row": np.int32}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b, deal = Bucket(left, discounts), plan.value.deal
        b.ready(*(_flat(left, n, k) for n, k in (("k", np.uint64), ("kw", float), ("kb", float))))
        out = {n: [] for n in ("chunk", "docs", *SUMS, "w", "row", "k", "krow")}
        for batch in right.to_batches():
            for chunk, size, docs, (h, hx, n, w, wx, u, ux, row) in zip(batch.column("chunk").to_pylist(), batch.column("size").to_pylist(),
                                                                        batch.column("docs"), _arrays(batch, **asked)):
                h, w, u = _decoded(h, hx), _decoded(w, wx), _decoded(u, ux)
                # what a context has is looked up once for its run
                place, known = _lookup(b.contexts, h.view(np.int64))
                first = h == START
                count = np.where(known & ~first, b.seen_c[place], 0) if len(b.contexts) else np.zeros(len(h), np.int64)
                level = np.where(first, end_base, np.log10((count + DELTA) / base))
                told = np.where(first, documents > 0, count > 0)
                backoff = np.where(known, b.weight[place], 1.0) if len(b.contexts) else np.ones(len(h))
                of = np.repeat(np.arange(len(h)), n)
                v = h[of]
                pair = pair_key(v, w)
                at, seen = _lookup(b.triples, pair_key(pair, u))
                value = b.three[at] if len(b.three) else np.ones(len(w))
                rest = np.flatnonzero(~seen)
                at, held = _lookup(b.pairs, pair[rest])
                low = backoff[of[rest]]
                low[held] = b.value[at[held]]
                two = pair_key(u[rest], v[rest])
                at, here = _lookup(b.two, two)
                low[here] *= b.two_weight[at[here]]
                away = np.flatnonzero(~here)
                away = away[_split(deal, v[rest[away]])]        # another bucket may know the context
                lost = np.flatnonzero(~held)
                common = w[rest[lost]] < ESCAPE
                low[lost[common]] *= (often.value[w[rest[lost[common]]].astype(np.int64)] + DELTA) / base
                lost = rest[lost[~common]]
                value[rest] = low
                out["chunk"].append(chunk)
                out["docs"].append(docs.values)
                for name, x in _sums(row, size, told[of], level[of], np.log10(value)).items():
                    out[name].append(x)
                out["w"].append(w[lost].view(np.int64))
                out["row"].append(row[lost])
                out["k"].append(two[away].view(np.int64))
                out["krow"].append(row[rest[away]])
        types = {"docs": key, "w": pa.int64(), "row": pa.int32(), "k": pa.int64(), "krow": pa.int32()}
        lists = {n: pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, out[n])]), pa.int32()),
            pa.concat_arrays([pa.array(x).cast(kind) for x in out[n]]) if out[n] else pa.array([], kind)) for n, kind in types.items()}
        columns = {"chunk": pa.array(out["chunk"], pa.int64()), **lists, **{n: pa.array(out[n], pa.binary()) for n in SUMS}}
        return pa.table({n: columns[n] for n in out})

    return run


def score(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", blocks: int = 3) -> DataFrame:
    """doc, n_tokens, n_known, base_score, score: one row for each document, as katz.score."""
    spark = docs.sparkSession
    shared, often = spark.sparkContext.broadcast(model.plan), spark.sparkContext.broadcast(model.often)
    kind = docs.schema[doc].dataType
    key, name = to_arrow_type(kind), kind.simpleString()
    left = _left(model.ngrams, model.contexts, model.pairs)
    results = None
    for k in range(blocks):
        with lean_shuffles(spark):
            rows = (docs.where(F.pmod(F.xxhash64(F.lit("block"), F.col(doc), F.length(text_of(text))), F.lit(blocks)) == k)
                    .select(F.col(doc).alias("doc"), bytes_of(text).alias("text")))
            occurrences = rows.mapInArrow(_occurrences(shared, key), f"bucket int, chunk bigint, size int, docs array<{name}>, h binary, hx binary, "
                                          "n binary, w binary, wx binary, u binary, ux binary, row binary")
            parts = settle(left.groupBy("bucket").cogroup(occurrences.groupBy("bucket")).applyInArrow(
                _score(shared, often, model.discounts, model.base, model.documents, key),
                f"chunk bigint, docs array<{name}>, at binary, tokens binary, known binary, base binary, score binary, "
                "w array<bigint>, row array<int>, k array<bigint>, krow array<int>"), "katz-parts")
            done = parts.drop("w", "row", "k", "krow").groupBy("chunk").applyInArrow(
                katz._add(key), f"chunk bigint, row int, doc {name}, n_tokens bigint, n_known bigint, base_score double, score double")
            end = F.log10((F.coalesce("c", F.lit(0)) + DELTA) / F.lit(model.base))
            unseen = parts.select("chunk", F.explode(F.arrays_zip("w", "row")).alias("x")).select("chunk", "x.row", "x.w")
            backed = unseen.join(model.unigrams, "w", "left").select("chunk", "row", end.alias("log"))
            if model.pairs is not None:
                asked = parts.select("chunk", F.explode(F.arrays_zip("k", "krow")).alias("x")).select("chunk", F.col("x.krow").alias("row"), "x.k")
                buckets = model.plan.deal.buckets
                wanted = asked.select("k").distinct().withColumn("r", F.expr(f"cast(shiftrightunsigned(k, 1) % {buckets} as int)"))     # r as in _split_sums
                logs = wanted.groupBy("r").cogroup(model.pairs.select("r", "k", "weight", "own").groupBy("r")).applyInArrow(_logs_of_pairs, "k bigint, log double")
                backed = backed.unionByName(asked.join(logs, "k").select("chunk", "row", "log"))
            backed = backed.groupBy("chunk", "row").agg(F.sum("log").alias("backed"))
            done = settle(done.join(backed, ["chunk", "row"], "left").withColumn("score", F.col("score") + F.coalesce("backed", F.lit(0.0)))
                          .select("doc", "n_tokens", "n_known", "base_score", "score"), "katz-scores")
            _discard(parts)
        results = done if results is None else results.unionByName(done)
    return results.withColumnRenamed("doc", doc)
