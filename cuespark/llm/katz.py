"""Language-model scoring: a Katz backoff bigram model, trained here.

Counts that occur up to CUTOFF times are discounted by Good-Turing; what the discounts free in a
context goes to the words not seen there, in proportion to the unigram level below, and the context's
backoff weight is computed from exactly those sums, so that every context's probabilities add up to 1.
A token is scored by the bigram if it was seen, else by the weight of its context times the unigram
(add-DELTA over the vocabulary and one unknown word), which is the recursion's end.

Tokens are 64-bit hashes of words. Work is dealt by context into buckets whose number grows with the
corpus. What goes between tasks are numpy arrays as compressed bytes, a row per bucket, with each context once
and the length of its run; a context that holds much of the corpus is split over several buckets by
the next word, and its sums are put together afterwards. Documents are scored in `blocks`, one after the other, so that the space
that shuffles take is a fraction of the corpus; each step is written before the next begins, and
its shuffle files are given back. Nothing but counts of counts and totals comes to the driver.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import settle
from .common import bytes_of, text_of

DELTA = 0.1
CUTOFF = 5                      # counts above are taken as they are
CHUNK = 500_000                 # tokens that a task sorts at a time; bytes of text that it hashes
BATCH = 8 << 20                 # bytes of rows that go to Python at a time
BUCKET = 2_000_000              # tokens of a bucket, about
SLICE = 125_000                 # bigrams of a stored row
LONG = 512                      # bytes; longer words are hashed one by one
SAMPLE = 16                     # one row in so many tells how many buckets there are and which contexts are split
START, END = np.uint64(0x5BF0A8B1457695FD), np.uint64(0xD4E12C77A9B3F06B)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_INSIDE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)        # the first n bytes of eight
COUNTS = "bucket int, h binary, n binary, w binary, c binary"         # h: each context once, n: how many of w and c are its own


@contextmanager
def lean_shuffles(spark: SparkSession):
    """Shuffle files of a query go when it ends, not when the driver happens to collect garbage; rows reach Python by a few MB."""
    ours = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH)}
    before = {key: spark.conf.get(key, None) for key in ours}
    for key, value in ours.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _discard(df: DataFrame) -> None:
    """Delete a settled table that no later step reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(h) + w)


class WordHashes:
    """64-bit hashes of the words between ASCII blanks, A-Z lower-cased: of all words of many texts at once, eight bytes after eight."""

    def of(self, text: bytes) -> np.ndarray:
        return self.of_all(pa.array([text], pa.binary()))[0]

    def of_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, number of words of each text)."""
        _, offsets, data = texts.buffers()
        kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
        at = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        if at[0] == at[-1]:
            return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]]
        at -= at[0]
        inside = _INSIDE[raw]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = at[(at > 0) & (at < len(raw))]             # nothing stands between two texts
        starts[edges], ends[edges - 1] = inside[edges], inside[edges - 1]
        first = np.flatnonzero(starts)
        size = np.flatnonzero(ends) + 1 - first
        low = np.zeros(len(raw) + 8, np.uint8)
        low[:-8] = _LOWER[raw]
        eight = np.ndarray(len(raw) + 1, np.dtype("<u8"), low, strides=(1,))         # those that begin at each byte
        h = mixed(mixed(size.astype(np.uint64) + START) ^ (eight[first] & _FIRST[np.minimum(size, 8)]))
        rest, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(rest):
            h[rest] = mixed(h[rest] ^ (eight[first[rest] + k] & _FIRST[np.minimum(size[rest] - k, 8)]))
            k += 8
            rest = rest[size[rest] > k]
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(low[first[i]:first[i] + size[i]].tobytes())
        return h, np.diff(np.searchsorted(first, at))


@dataclass
class Deal:
    """Which bucket a bigram belongs to: by its context, and a split context by its next word too."""
    buckets: int
    split: np.ndarray           # contexts that are split, sorted
    parts: np.ndarray           # into how many buckets

    def bucket(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        slot = mixed(h)
        if len(self.split):
            at = np.minimum(np.searchsorted(self.split, h), len(self.split) - 1)
            parts = np.where(self.split[at] == h, self.parts[at], 1).astype(np.uint64)
            slot = slot + mixed(w) % parts
        return (slot % np.uint64(self.buckets)).astype(np.int32)

    def homes(self) -> list[tuple[int, int]]:
        """(bucket, context) of every bucket that a bigram of a split context can belong to, seen or not."""
        slot = np.repeat(mixed(self.split), self.parts)
        slot += np.concatenate([np.arange(n, dtype=np.uint64) for n in self.parts]) if len(slot) else slot
        pairs = zip((slot % np.uint64(self.buckets)).tolist(), np.repeat(self.split, self.parts).view(np.int64).tolist())
        return sorted(set(pairs))


def _sampled(batches):
    hashes = WordHashes()
    for batch in batches:
        for _, _, h, _, _ in _pieces(batch, hashes):
            keys, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": keys.view(np.int64), "n": n})


def _deal(rows: DataFrame) -> Deal:
    """rows: text (bytes). The sample decides where a bigram is counted, not what is counted.

    It goes by place and not by text, so that copies of a text are sampled like any other rows.
    """
    chosen = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SAMPLE)) == 0
    seen = settle(rows.where(chosen).mapInArrow(_sampled, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "katz-sample")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(8, math.ceil(total * SAMPLE / BUCKET))
    least = min(buckets, 2048) * 2
    parts = {r["h"] % (1 << 64): math.ceil(r["n"] * least / total) for r in seen.where(F.col("n") * least > total).collect()}   # `least` at most
    keys = sorted(parts)
    return Deal(buckets, np.array(keys, np.uint64), np.array([parts[k] for k in keys], np.int64))


def _tokens(words: np.ndarray, lengths: np.ndarray, start: np.uint64, end: np.uint64):
    """(h, w, index of the row) of rows with so many tokens."""
    stops = np.cumsum(lengths) - 1
    w, inner = np.full(len(words) + len(lengths), end, np.uint64), np.ones(len(words) + len(lengths), bool)
    inner[stops] = False
    w[inner] = words
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[np.append(0, stops[:-1] + 1)] = start
    return h, w, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def _pieces(batch: pa.RecordBatch, hashes: WordHashes, start: np.uint64 = START, end: np.uint64 = END):
    """(first row, end row, h, w, index of the row) of about CHUNK tokens each."""
    texts, rows = batch.column("text"), batch.num_rows
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // CHUNK       # hashed at a time
    a, size, parts, lengths = 0, 0, [], []
    for i, b in pairwise(_bounds(part).tolist() if rows else []):
        words, n = hashes.of_all(texts.slice(i, b - i))
        parts.append(words)
        lengths.append(n + 1)
        size += len(words) + b - i
        if size < CHUNK and b < rows:
            continue
        yield a, b, *_tokens(np.concatenate(parts), np.concatenate(lengths), start, end)
        a, size, parts, lengths = b, 0, [], []


def _squeezed(values: np.ndarray) -> bytes:
    """The values as compressed bytes: all first bytes, then all second ones, and so on, behind the length of that."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T)
    return planes.nbytes.to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def _plain(values: np.ndarray) -> bytes:
    """As _squeezed, for hashes that hardly repeat: nothing is gained by compressing them."""
    return bytes(4) + values.tobytes() if len(values) else b""


def _packed_rows(bounds: np.ndarray, values: np.ndarray, pack=_squeezed) -> pa.Array:
    """The values between each two bounds, as compressed bytes."""
    return pa.array([pack(values[a:b]) for a, b in pairwise(np.asarray(bounds).tolist())], pa.binary())


def _unpacked(array: pa.Array, kind) -> np.ndarray:
    """All values of a column of packed rows."""
    if not len(array):
        return np.empty(0, kind)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int32)[array.offset:array.offset + len(array) + 1].tolist()
    parts = []
    for a, b in pairwise(offsets):
        if a < b:
            row = data.slice(a, b - a)
            size = int.from_bytes(row.slice(0, 4).to_pybytes(), "little")
            if not size:
                parts.append(np.frombuffer(row.slice(4).to_pybytes(), kind))
                continue
            raw = pa.decompress(row.slice(4), size, "zstd")
            planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
            parts.append(np.ascontiguousarray(planes.T).view(kind).ravel())
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, kind)


def _runs(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal contexts between the bounds: (bounds of the runs, contexts, lengths)."""
    new = np.empty(len(h), bool)
    new[:1] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    new[bounds[:-1]] = True
    starts = np.flatnonzero(new)
    return np.searchsorted(starts, bounds), h[starts], np.diff(np.append(starts, len(h))).astype(np.int32)


def _bounds(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    return np.append(np.append(0, np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1), len(sorted_keys))


def merged(h: np.ndarray, w: np.ndarray, c: np.ndarray | None = None):
    """Distinct pairs, in no order, with their summed counts (without c, each counts one)."""
    keys = pair_key(h, w)
    order = np.argsort(keys)
    at = _bounds(keys[order]) if len(h) else np.zeros(1, np.int64)
    first = order[at[:-1]]
    counts = np.diff(at) if c is None else np.add.reduceat(c[order], at[:-1]) if len(h) else c
    return h[first], w[first], counts.astype(np.int64)


def by_key(key: np.ndarray, bucket: np.ndarray | int = 0) -> np.ndarray:
    """Order by bucket and, within it, by the first bits of the key. The places are sorted along: that is much faster than argsort."""
    bucket, low = np.asarray(bucket, np.uint64), len(key).bit_length()
    high = int(bucket.max(initial=0)).bit_length()
    key = (key >> np.uint64(high + low)) << np.uint64(low)
    if high:
        key |= bucket << np.uint64(64 - high)
    key |= np.arange(len(key), dtype=np.uint64)
    key.sort()
    return (key & np.uint64((1 << low) - 1)).astype(np.int64)


def in_order(key: np.ndarray) -> np.ndarray:
    """np.argsort of hashes."""
    order = by_key(key)
    there = key[order]
    return np.argsort(key) if (there[1:] < there[:-1]).any() else order


def by_context(h: np.ndarray, bucket: np.ndarray | int = 0) -> np.ndarray:
    """Order by bucket and, within it, with equal contexts together, but for a few."""
    return by_key(mixed(h), bucket)


def by_pair(h: np.ndarray, w: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Order by bucket, with equal contexts together and, but for a few, equal pairs."""
    at = mixed(h)
    key = (at >> np.uint64(42)) << np.uint64(22)
    key |= mixed(at + w) >> np.uint64(42)
    return np.argsort((bucket.astype(np.uint64) << np.uint64(44)) | key)


def _count(deal):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for _, _, h, w, _ in _pieces(batch, hashes):
                # a bucket is counted in two halves, so that a task needs half the memory
                bucket = deal.value.bucket(h, w) * 2 + (w & np.uint64(1)).astype(np.int32)
                order = by_pair(h, w, bucket)
                h, w, bucket = h[order], w[order], bucket[order]
                new = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (bucket[1:] != bucket[:-1]))
                first = np.flatnonzero(new)                    # a pair that comes twice is added up in its bucket
                c = np.diff(np.append(first, len(h))).astype(np.int64)
                h, w, bucket = h[first], w[first], bucket[first]
                yield pa.RecordBatch.from_arrays(_count_rows(bucket, _bounds(bucket), h, w, c), names=["bucket", "h", "n", "w", "c"])

    return run


def _count_rows(bucket: np.ndarray, at: np.ndarray, h: np.ndarray, w: np.ndarray, c: np.ndarray) -> list[pa.Array]:
    """Columns of COUNTS, a row between each two bounds; bucket tells that of each pair."""
    bounds, keys, n = _runs(h, at)
    return [pa.array(bucket[at[:-1]], pa.int32()), _packed_rows(bounds, keys), _packed_rows(bounds, n), _packed_rows(at, w), _packed_rows(at, c)]


def _flat(table: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    """All values of an array column or, if it is bytes, of its packed rows."""
    column = table.column(name)
    if pa.types.is_binary(column.type):
        parts = [_unpacked(c, kind) for c in column.chunks]
    else:
        parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(parts).astype(kind, copy=False) if parts else np.empty(0, kind)


def _merge(table: pa.Table) -> pa.Table:
    bucket = table.column("bucket")[0].as_py() // 2
    h = np.repeat(_flat(table, "h", np.uint64), _flat(table, "n", np.int32))
    w, c = _flat(table, "w", np.uint64), _flat(table, "c")
    del table
    h, w, c = merged(h, w, c)
    order = by_context(h)
    h, w, c = h[order], w[order], c[order]
    at = np.append(np.arange(0, len(h), SLICE), len(h))
    return pa.table(_count_rows(np.full(len(h), bucket, np.int32), at, h, w, c), names=["bucket", "h", "n", "w", "c"])


def _arrays(batch: pa.RecordBatch, **kinds):
    """The packed arrays of each row."""
    columns = [(batch.column(n), kind) for n, kind in kinds.items()]
    for i in range(batch.num_rows):
        yield [_unpacked(c.slice(i, 1), kind) for c, kind in columns]


def _by_run(lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values of each run; no run is empty."""
    return np.add.reduceat(values, np.cumsum(lengths, dtype=np.int64) - lengths) if len(values) else values


def _context_counts(batches):
    for batch in batches:
        for h, n, c in _arrays(batch, h=np.int64, n=np.int32, c=np.int64):
            yield pa.RecordBatch.from_pydict({"w": h, "c": _by_run(n, c)})


def _counts_of_counts(batches):
    total = np.zeros(CUTOFF + 2, np.int64)
    for batch in batches:
        for (c,) in _arrays(batch, c=np.int64):
            total += np.bincount(np.minimum(c, CUTOFF + 2), minlength=CUTOFF + 3)[:CUTOFF + 2]
    yield pa.RecordBatch.from_pydict({"r": np.arange(CUTOFF + 2), "n": total})


def good_turing(counts: dict[int, int]) -> list[float]:
    """Discounts of the counts 1 to CUTOFF (index 0 is unused).

    A discount that the counts of counts put outside (0, 1), as in small corpora, is (r - 0.5) / r.
    """
    n = [counts.get(r, 0) for r in range(CUTOFF + 2)]
    out = [1.0]
    whole = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUTOFF + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - whole) / (1 - whole) if n[r] and whole < 1 else 0.0
        out.append(d if 0.0 < d < 1.0 else (r - 0.5) / r)
    return out


@dataclass
class Model:
    """Tables: bigrams (as COUNTS), unigrams (w, c), contexts (bucket, h, c, whole, weight).

    whole: what a context's discounted counts are divided by; weight: its backoff weight.
    """
    deal: Deal
    bigrams: DataFrame
    unigrams: DataFrame
    contexts: DataFrame
    discounts: list[float]
    tokens: int
    vocabulary: int
    documents: int

    @property
    def base(self) -> float:
        return self.tokens + DELTA * (self.vocabulary + 1)


def _context_sums(discounts: list[float], base: float):
    d = np.array([*discounts, 1.0])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        h, n, w, c = _flat(left, "h"), _flat(left, "n", np.int32), _flat(left, "w"), _flat(left, "c")
        names = right.column("w").to_numpy()
        order = np.argsort(names)
        low = right.column("c").to_numpy()[order][np.searchsorted(names[order], w)]
        keys, inverse = np.unique(h, return_inverse=True)          # a context's run may be cut by SLICE
        size, bucket = len(keys), left.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket] * size, pa.int32()), "h": keys,
                         "c": np.bincount(inverse, _by_run(n, c), size).astype(np.int64),
                         "kept": np.bincount(inverse, _by_run(n, d[np.minimum(c, CUTOFF + 1)] * c), size),
                         "below": np.bincount(inverse, _by_run(n, (low + DELTA) / base), size)})

    return run


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts all documents given; a null text is empty (its end is still a token)."""
    spark = docs.sparkSession
    rows = docs.select(bytes_of(text).alias("text"))
    with lean_shuffles(spark):
        deal = _deal(rows)
        shared = spark.sparkContext.broadcast(deal)
        bigrams = settle(rows.mapInArrow(_count(shared), COUNTS).groupBy("bucket").applyInArrow(_merge, COUNTS), "katz-bigrams")
        # every token but the end is a context as often as it occurs, and the start as often as the end
        contexts = bigrams.mapInArrow(_context_counts, "w bigint, c bigint")
        start, end = (F.lit(int(x.astype(np.int64))) for x in (START, END))
        unigrams = settle(contexts.groupBy("w").agg(F.sum("c").alias("c"))
                          .select(F.when(F.col("w") == start, end).otherwise(F.col("w")).alias("w"), "c"), "katz-unigrams")
        total, size, documents = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"),
                                              F.coalesce(F.sum(F.when(F.col("w") == end, F.col("c"))), F.lit(0))).first()
        counts = bigrams.mapInArrow(_counts_of_counts, "r bigint, n bigint").groupBy("r").agg(F.sum("n")).collect()
        discounts = good_turing(dict(map(tuple, counts)))
        model = Model(deal, bigrams, unigrams, None, discounts, total, size, documents)

        def followers(batches):
            for batch in batches:
                for bucket, (w,) in zip(batch.column("bucket").to_pylist(), _arrays(batch, w=np.int64)):
                    w = np.unique(w)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), bucket), pa.int32()), pa.array(w)], names=["bucket", "w"])

        known = bigrams.mapInArrow(followers, "bucket int, w bigint").join(unigrams, "w")
        sums = settle(bigrams.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(
            _context_sums(discounts, model.base), "bucket int, h bigint, c bigint, kept double, below double"), "katz-sums")
        whole = F.when(F.sum("kept") < F.sum("c"), F.sum("c")).otherwise(F.sum("c") + 1).cast("double")
        weights = sums.groupBy("h").agg(F.sum("c").alias("c"), whole.alias("whole"),
                                        F.sum("kept").alias("kept"), F.sum("below").alias("below"))
        weights = weights.select("h", "c", "whole", ((1 - F.col("kept") / F.col("whole")) / (1 - F.col("below"))).alias("weight"))
        # a split context is known wherever a bigram of it can be asked for, not only where one was seen
        homes = spark.createDataFrame(deal.homes(), "bucket int, h bigint")         # `least` of _deal and the number of split contexts at most
        places = sums.select("bucket", "h").join(homes.select("h").distinct(), "h", "left_anti").select("bucket", "h").unionByName(homes)
        model.contexts = settle(places.join(weights, "h"), "katz-contexts")
        _discard(sums)
    return model


def _occurrences(deal, key: pa.DataType):
    def run(batches):
        chunk, hashes = TaskContext.get().partitionId() << 32, WordHashes()
        for batch in batches:
            for a, b, h, w, row in _pieces(batch, hashes):
                bucket = deal.value.bucket(h, w)
                order = by_context(h, bucket)
                at = _bounds(bucket[order])
                bounds, keys, runs = _runs(h[order], at)
                n = len(at) - 1
                docs = pa.ListArray.from_arrays(       # once for a chunk
                    pa.array(np.append(0, np.full(n, b - a)), pa.int32()), batch.column("doc").slice(a, b - a).cast(key))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[order][at[:-1]], pa.int32()), pa.array(np.full(n, chunk), pa.int64()), pa.array(np.full(n, b - a), pa.int32()),
                     docs, _packed_rows(bounds, keys), _packed_rows(bounds, runs), _packed_rows(at, w[order]), _packed_rows(at, row[order])],
                    names=["bucket", "chunk", "size", "docs", "h", "n", "w", "row"])
                chunk += 1

    return run


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    order, at = in_order(wanted) if wanted.dtype == np.uint64 else np.argsort(wanted), np.empty(len(wanted), np.int64)
    at[order] = np.searchsorted(keys, wanted[order])           # in order, several times as fast
    np.minimum(at, len(keys) - 1, out=at)
    return at, keys[at] == wanted


SUMS = {"at": np.int32, "tokens": np.int32, "known": np.int32, "base": float, "score": float}


def _sums(row: np.ndarray, size: int, known: np.ndarray, base: np.ndarray, score: np.ndarray) -> dict[str, bytes]:
    """Columns of SUMS: which of a chunk's documents have a token here, and the sums of these. A chunk of `size` documents has a row in
    each bucket, so that one with all of its documents would grow with the number of both."""
    tokens = np.bincount(row, minlength=size)
    at = np.flatnonzero(tokens)
    sums = (at, tokens[at], *(np.bincount(row, x, size)[at] for x in (known, base, score)))
    return {n: _squeezed(x.astype(kind)) for (n, kind), x in zip(SUMS.items(), sums)}


def _score(discounts: list[float], base: float, documents: int, key: pa.DataType):
    d = np.array([*discounts, 1.0])
    end_base = math.log10((documents + DELTA) / base)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        h = np.repeat(_flat(left, "h", np.uint64), _flat(left, "n", np.int32))
        pairs, c = pair_key(h, _flat(left, "w", np.uint64)), _flat(left, "c")
        del h
        order = np.argsort(pairs)
        pairs, c = pairs[order], c[order]
        contexts, seen_c, whole, weight = (_flat(left, n, k) for n, k in (("ch", np.int64), ("cc", np.int64), ("cw", float), ("cb", float)))
        order = np.argsort(contexts)
        contexts, seen_c, whole, weight = (x[order] for x in (contexts, seen_c, whole, weight))
        start = START.astype(np.int64)
        out = {n: [] for n in ("chunk", "docs", *SUMS, "w", "row")}
        for batch in right.to_batches():
            for chunk, size, docs, (h, n, w, row) in zip(batch.column("chunk").to_pylist(), batch.column("size").to_pylist(), batch.column("docs"),
                                                         _arrays(batch, h=np.int64, n=np.int32, w=np.int64, row=np.int32)):
                # what a context has is looked up once for its run
                place, known = _lookup(contexts, h)
                first = h == start
                count = np.where(known & ~first, seen_c[place], 0) if len(contexts) else np.zeros(len(h), np.int64)
                level = np.where(first, end_base, np.log10((count + DELTA) / base))
                told = np.where(first, documents > 0, count > 0)
                backoff = np.where(known, weight[place], 1.0) if len(contexts) else np.ones(len(h))
                of = np.repeat(np.arange(len(h)), n)
                at, seen = _lookup(pairs, pair_key(h.view(np.uint64)[of], w.view(np.uint64)))
                value = backoff[of]
                if len(pairs):      # a seen bigram's context is known, since it was counted with it
                    hit = np.flatnonzero(seen)
                    times = c[at[hit]]
                    value[hit] = d[np.minimum(times, CUTOFF + 1)] * times / whole[place[of[hit]]]
                out["chunk"].append(chunk)
                out["docs"].append(docs.values)
                for name, x in _sums(row, size, told[of], level[of], np.log10(value)).items():
                    out[name].append(x)
                out["w"].append(w[~seen])
                out["row"].append(row[~seen])
        types = {"docs": key, "w": pa.int64(), "row": pa.int32()}
        lists = {n: pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, out[n])]), pa.int32()),
            pa.concat_arrays([pa.array(x).cast(kind) for x in out[n]]) if out[n] else pa.array([], kind)) for n, kind in types.items()}
        columns = {"chunk": pa.array(out["chunk"], pa.int64()), **lists, **{n: pa.array(out[n], pa.binary()) for n in SUMS}}
        return pa.table({n: columns[n] for n in out})

    return run


def _add(key: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        """The parts of a chunk's documents from all buckets."""
        docs = [c.flatten() for c in table.column("docs").chunks]
        docs = pa.concat_arrays(docs).cast(key)
        sums = {n: np.zeros(len(docs), np.int64 if kind is np.int32 else kind) for n, kind in SUMS.items() if n != "at"}
        for batch in table.to_batches():
            for at, *parts in _arrays(batch, **SUMS):
                for total, part in zip(sums.values(), parts):
                    total[at] += part           # no document comes twice in a part
        return pa.table({"chunk": pa.array(np.full(len(docs), table.column("chunk")[0].as_py())), "row": pa.array(np.arange(len(docs), dtype=np.int32)),
                         "doc": docs, "n_tokens": sums["tokens"], "n_known": sums["known"], "base_score": sums["base"], "score": sums["score"]})

    return run


def score(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", blocks: int = 2) -> DataFrame:
    """doc, n_tokens, n_known, base_score, score: one row for each document, repeated rows included.

    score is the log10 probability of the text's words and its end. A null text is empty: its end
    alone is scored. Documents are told apart by their place in the input, so doc may repeat or be null.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.deal)
    kind = docs.schema[doc].dataType
    key, name = to_arrow_type(kind), kind.simpleString()
    none, numbers, empty = F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<double>)"), F.expr("X''")
    packed = model.contexts.groupBy("bucket").agg(F.collect_list(F.struct("h", "c", "whole", "weight")).alias("x"))     # of one bucket
    left = model.bigrams.select("bucket", "h", "n", "w", "c", none.alias("ch"), none.alias("cc"), numbers.alias("cw"), numbers.alias("cb"))
    left = left.unionByName(packed.select("bucket", *[empty.alias(n) for n in ("h", "n", "w", "c")], F.col("x.h").alias("ch"),
                                          F.col("x.c").alias("cc"), F.col("x.whole").alias("cw"), F.col("x.weight").alias("cb")))
    results = None
    for k in range(blocks):
        with lean_shuffles(spark):
            rows = (docs.where(F.pmod(F.xxhash64(F.lit("block"), F.col(doc), F.length(text_of(text))), F.lit(blocks)) == k)
                    .select(F.col(doc).alias("doc"), bytes_of(text).alias("text")))
            occurrences = rows.mapInArrow(_occurrences(shared, key), f"bucket int, chunk bigint, size int, docs array<{name}>, "
                                          "h binary, n binary, w binary, row binary")
            parts = settle(left.groupBy("bucket").cogroup(occurrences.groupBy("bucket")).applyInArrow(
                _score(model.discounts, model.base, model.documents, key),
                f"chunk bigint, docs array<{name}>, at binary, tokens binary, known binary, base binary, score binary, "
                "w array<bigint>, row array<int>"), "katz-parts")
            whole = parts.drop("w", "row").groupBy("chunk").applyInArrow(
                _add(key), f"chunk bigint, row int, doc {name}, n_tokens bigint, n_known bigint, base_score double, score double")
            end = F.log10((F.coalesce("c", F.lit(0)) + DELTA) / F.lit(model.base))
            unseen = parts.select("chunk", F.explode(F.arrays_zip("w", "row")).alias("x")).select("chunk", "x.row", "x.w")
            backed = (unseen.join(model.unigrams, "w", "left").groupBy("chunk", "row").agg(F.sum(end).alias("backed")))
            done = settle(whole.join(backed, ["chunk", "row"], "left").withColumn("score", F.col("score") + F.coalesce("backed", F.lit(0.0)))
                          .select("doc", "n_tokens", "n_known", "base_score", "score"), "katz-scores")
            _discard(parts)
        results = done if results is None else results.unionByName(done)
    return results.withColumnRenamed("doc", doc)
