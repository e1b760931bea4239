"""Phrase collocation mining over subtrees of word suffixes, partitioned by their prefixes.

The suffixes of all pieces, cut off after LONGEST words, form a tree of each language; a phrase's
frequency is the sum of the leaves under its node. The tree is never built whole. It is partitioned
vertically: suffixes are dealt to groups by their first two words, so that a group holds about
`budget` suffixes, and those under a pair that alone exceeds the budget by their first three. Each group
sorts its suffixes, which lays the leaves of its subtrees side by side, and reads all counts from them.

A node below `least` has no candidate under it. So words are counted first, then pairs, and a suffix ends
before a word or pair that is too rare. Those known to be frequent are kept in two Bloom filters of a
fixed size: what they let through in error costs space in a group, never a wrong count. Equal suffixes
are made one, with a count, in each task before they are shuffled, so no pair, line or passage makes a
group large by being repeated.

Words are 64-bit hashes, seeded by their language, until the phrases that are returned get their words back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import bytes_of
from .katz import mixed, pair_key

LONGEST = 4
LEAST = 30
BUDGET = 1_000_000              # suffixes of a group, about
MOST_HEAVY = 65_536             # pairs that are dealt by three words; beyond that the budget grows
CHUNK = 1_000_000               # words that a task sorts at a time
REMEMBERED = 300_000            # words whose hashes a task keeps at hand
FILTER_BITS = 26                # a Bloom filter has 2 ** 26 bits, 8 MB
BREAK = b"\xff"                 # occurs in no UTF-8 text
_FOLD = bytes(255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
W = ["w1", "w2", "w3", "w4"]


def fold_words(text: bytes) -> list[bytes]:
    """Words between blanks and tabs, A-Z lower-cased, with BREAK where a piece ends."""
    return text.translate(_FOLD).replace(BREAK, b" \xff ").split()


class WordKeys(dict):
    """64-bit key of each word of one language; 0 is for breaks."""

    def __init__(self, lang: str):
        super().__init__({BREAK: 0})
        self.seed = xxhash.xxh3_64_intdigest(lang)

    def __missing__(self, word: bytes) -> int:
        self[word] = key = xxhash.xxh3_64_intdigest(word, self.seed) or 1
        return key


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """Keys of the words of all texts in order, a 0 at every break and between texts, in arrays of about `size`."""
    keys: dict[str, WordKeys] = {}
    parts, held = [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if sum(map(len, keys.values())) > REMEMBERED:
                keys.clear()
            of = keys.get(lang) or keys.setdefault(lang, WordKeys(lang))
            words = fold_words(text)
            parts += [np.fromiter(map(of.__getitem__, words), np.uint64, len(words)), np.zeros(1, np.uint64)]
            held += len(words)
            if held >= size:
                yield np.concatenate(parts)
                parts, held = [], 0
    if parts:
        yield np.concatenate(parts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, key, n of a task's words; n of all its words under the null word."""
    def emit() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(BREAK, None)
            of, words = WordKeys(lang), list(counts)
            keys = np.fromiter(map(of.__getitem__, words), np.uint64, len(words)).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * (len(words) + 1), pa.string()), "word": pa.array([*words, None], pa.binary()).cast(pa.string()),
                "key": pa.array([*keys.tolist(), 0], pa.int64()), "n": pa.array([*counts.values(), sum(counts.values())], pa.int64())})

    held: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            held.setdefault(lang, Counter()).update(fold_words(text))
            if sum(map(len, held.values())) > REMEMBERED:
                yield from emit()
                held.clear()
    yield from emit()


# --- Bloom filters: two bits of a key's mixed hash, in words of 64 bits

def _bits(keys: np.ndarray) -> Iterator[np.ndarray]:
    h, mask = mixed(keys), np.uint64(2 ** FILTER_BITS - 1)
    yield h & mask
    yield (h >> np.uint64(32)) & mask


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the filter that keys set, and the bits in them."""
    at = np.concatenate(list(_bits(keys)))
    slot, back = np.unique(at >> np.uint64(6), return_inverse=True)
    bits = np.zeros(len(slot), np.uint64)
    np.bitwise_or.at(bits, back, np.uint64(1) << (at & np.uint64(63)))
    return slot.astype(np.int64), bits.view(np.int64)


def has(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in _bits(keys):
        found &= (filter_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def _filter(slots: DataFrame) -> np.ndarray:
    """The filter of rows slot, bits; at most 2 ** 20 rows come to the driver."""
    rows = slots.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(2 ** (FILTER_BITS - 6), np.uint64)
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _key_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot, bits = _slots(batch.column("key").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_pydict({"slot": slot, "bits": bits})


# --- counts and subtrees

def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values))


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _dealt(bucket: np.ndarray, columns: list[np.ndarray], counts: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per bucket: its distinct rows, sorted, and how often each occurs."""
    order = np.lexsort([*columns[::-1], bucket])
    bucket, columns = bucket[order], [c[order] for c in columns]
    at = _runs([bucket, *columns])
    n = np.diff(np.append(at, len(bucket))) if counts is None else np.add.reduceat(counts[order], at)
    bucket, columns = bucket[at], [c[at] for c in columns]
    starts = _runs([bucket])
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), *(_lists(c.view(np.int64), starts) for c in columns), _lists(n.astype(np.int64), starts)],
                                      ["bucket", *W[:len(columns)], "n"])


def _pairs(frequent, buckets: int, chunk: int) -> Callable:
    def run(batches):
        for keys in _chunks(batches, chunk):
            keys = np.where(has(frequent.value, keys), keys, np.uint64(0))
            a, b = keys[:-1], keys[1:]
            ok = (a != 0) & (b != 0)
            pair = pair_key(a[ok], b[ok])
            if len(pair):
                yield _dealt(pair % np.uint64(buckets), [pair])
    return run


def _pair_counts(least: int, budget: int) -> Callable:
    """Of a bucket: what frequent pairs set in the filter, how often they occur, and pairs beyond the budget."""
    def run(table: pa.Table) -> pa.Table:
        pair = np.concatenate([c.values.to_numpy() for c in table["w1"].chunks]).view(np.uint64)
        counts = np.concatenate([c.values.to_numpy() for c in table["n"].chunks])
        order = np.argsort(pair)
        pair = pair[order]
        at = _runs([pair])
        n, pair = np.add.reduceat(counts[order], at), pair[at]
        slot, bits = _slots(pair[n >= least])
        return pa.table({"slots": pa.array([slot]), "bits": pa.array([bits]), "n": pa.array([int(n[n >= least].sum())]),
                         "heavy": pa.array([pair[n > budget].view(np.int64)], pa.list_(pa.int64()))})
    return run


def _is_heavy(heavy: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return np.isin(pair, heavy) if len(heavy) else np.zeros(len(pair), bool)


def _suffixes(frequent, frequent_pairs, heavy, groups: int, chunk: int) -> Callable:
    """Suffixes of two words or more, up to the first rare word or pair, dealt to the groups of their prefixes."""
    def run(batches):
        for keys in _chunks(batches, chunk):
            keys = np.where(has(frequent.value, keys), keys, np.uint64(0))
            keys = np.append(keys, np.zeros(LONGEST, np.uint64))
            pair = pair_key(keys[:-1], keys[1:])
            on = (keys[:-1] != 0) & (keys[1:] != 0)
            on[on] = has(frequent_pairs.value, pair[on])
            at = np.flatnonzero(on)
            if not len(at):
                continue
            third = on[at + 1]
            fourth = third & on[at + 2]
            w = [keys[at], keys[at + 1], np.where(third, keys[at + 2], np.uint64(0)), np.where(fourth, keys[at + 3], np.uint64(0))]
            prefix = pair[at]
            prefix = np.where(_is_heavy(heavy.value, prefix), pair_key(prefix, w[2]), prefix)
            yield _dealt(mixed(prefix) % np.uint64(groups), w)
    return run


def _subtrees(least: int, heavy) -> Callable:
    """Nodes of a group's subtrees that occur often enough; those of pairs that other groups share in any case."""
    def run(table: pa.Table) -> pa.Table:
        w = [np.concatenate([c.values.to_numpy() for c in table[name].chunks]).view(np.uint64) for name in W]
        counts = np.concatenate([c.values.to_numpy() for c in table["n"].chunks])
        order = np.lexsort(w[::-1])
        w, counts = [c[order] for c in w], counts[order]
        found = []
        for depth in range(2, LONGEST + 1):
            at = _runs(w[:depth])
            n = np.add.reduceat(counts, at)
            node = [c[at] for c in w[:depth]] + [np.zeros(len(at), np.uint64)] * (LONGEST - depth)
            keep = (n >= least) | _is_heavy(heavy.value, pair_key(node[0], node[1])) if depth == 2 else (n >= least) & (node[depth - 1] != 0)
            found.append([c[keep].view(np.int64) for c in node] + [n[keep]])
        return pa.table({name: np.concatenate(c) for name, c in zip([*W, "n"], zip(*found))})
    return run


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, budget: int = BUDGET,
                     chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(words, nodes): lang, word, key, n of words that occur `least` times, and under a null word the language's
    number of words; w1 to w4 (0: none), n of phrases of two to four words that do."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), bytes_of(text).alias("text"))
    words = (rows.mapInArrow(_counted, "lang string, word string, key bigint, n bigint").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
             .where((F.col("n") >= least) | F.col("word").isNull()))
    words = settle(words, "phrases-words")
    total = words.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    budget = max(budget, total // MOST_HEAVY)
    send = spark.sparkContext.broadcast
    frequent = send(_filter(words.where("word is not null").select("key").mapInArrow(_key_slots, "slot bigint, bits bigint")))

    arrays = "bucket int, w1 array<bigint>, {}n array<bigint>"
    pairs = (rows.mapInArrow(_pairs(frequent, max(8, total // budget), chunk), arrays.format("")).groupBy("bucket")
             .applyInArrow(_pair_counts(least, budget), "slots array<bigint>, bits array<bigint>, n bigint, heavy array<bigint>"))
    pairs = settle(pairs, "phrases-pairs")
    frequent_pairs = send(_filter(pairs.select(F.explode(F.arrays_zip("slots", "bits")).alias("x")).select("x.slots", "x.bits").withColumnRenamed("slots", "slot")))
    heavy = send(np.sort(pairs.select(F.explode("heavy").alias("h")).toArrow()["h"].to_numpy()).view(np.uint64))
    groups = max(8, (pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // budget)

    nodes = (rows.mapInArrow(_suffixes(frequent, frequent_pairs, heavy, groups, chunk), arrays.format("".join(f"{w} array<bigint>, " for w in W[1:])))
             .groupBy("bucket").applyInArrow(_subtrees(least, heavy), "w1 bigint, w2 bigint, w3 bigint, w4 bigint, n bigint"))
    return words, settle(nodes.groupBy(*W).agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases-nodes")


# --- scores

def _phrase(*words: str):
    """A phrase as a struct of four words, 0 where it is shorter."""
    return F.struct(*[(F.col(words[i]) if i < len(words) else F.lit(0).cast("long")).alias(p) for i, p in enumerate(["p1", "p2", "p3", "p4"])])


def _of_length(make: Callable[[list[str]], list]):
    """An array made from the words of each candidate, by its length."""
    return F.when(F.col("w3") == 0, F.array(*make(W[:2]))).when(F.col("w4") == 0, F.array(*make(W[:3]))).otherwise(F.array(*make(W)))


def _cuts(words: list[str]) -> list:
    return [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), _phrase(*part).alias("part"))
            for k in range(1, len(words)) for side, part in (("l", words[:k]), ("r", words[k:]))]


def _inner(words: list[str]) -> list:
    return [_phrase(*words[i:i + n]) for n in range(2, len(words)) for i in range(len(words) - n + 1)]


P = ["p1", "p2", "p3", "p4"]


def _score(a: str, l: str, r: str):  # noqa: E741
    return f"cast(cast(2000000 as decimal(7,0)) * cast({a} as decimal(19,0)) div (cast({l} as decimal(19,0)) + cast({r} as decimal(19,0))) as bigint)"


def scored(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """w1 to w4, a, l, r, score of every candidate that no longer one with 80 % of its occurrences contains."""
    known = nodes.toDF(*P, "f").unionByName(words.where("word is not null").select(
        F.col("key").alias("p1"), *[F.lit(0).cast("long").alias(p) for p in P[1:]], F.col("n").alias("f")))
    cuts = nodes.select(*W, F.col("n").alias("a"), F.explode(_of_length(_cuts)).alias("c")).select(*W, "a", "c.k", "c.side", "c.part.*").join(known, P)
    both = cuts.groupBy(*W, "a").agg(*[F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{s}{k}")
                                       for k in range(1, LONGEST) for s in "lr"])
    lowest = F.least(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(_score("a", f"l{k}", f"r{k}")).alias("score"), F.lit(k).alias("k"),
                                                                   F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)])
    longer = (nodes.where("w3 <> 0").select("n", F.explode(F.when(F.col("w4") == 0, F.array(*_inner(W[:3]))).otherwise(F.array(*_inner(W)))).alias("s"))
              .groupBy("s").agg(F.max("n").alias("longer")).select(*[F.col(f"s.{p}").alias(w) for p, w in zip(P, W)], "longer"))
    contained = F.coalesce(F.expr("100 * cast(longer as decimal(19,0)) >= 80 * cast(a as decimal(19,0))"), F.lit(False))
    return both.join(longer, W, "left").where(~contained).select(*W, "a", lowest.alias("x")).select(*W, "a", "x.l", "x.r", "x.score")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = 2000, budget: int = BUDGET,
         chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two to four words.

    A null language is `und`; null, empty and blank texts have no words; repeated rows count each; an empty
    table, or one without a phrase that occurs `least` times, gives none. Words that differ in anything but
    the case of A-Z are different words. Ties are broken by the phrase's UTF-8 bytes. Columns other than
    text and language are not read.
    """
    words, nodes = frequent_phrases(docs, text, lang, least, budget, chunk)
    of_first = words.where("word is not null").select("lang", F.col("key").alias("w1"))
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = (scored(words, nodes).join(of_first, "w1").withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top)
             .select("lang", *W, "a", "l", "r", "score"))
    spelled = (first.select("*", F.posexplode(F.array(*W)).alias("at", "key")).where("key <> 0")
               .join(words.where("word is not null").select("key", "word"), "key").groupBy(*first.columns)
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    totals = words.where("word is null").select("lang", "n")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return (spelled.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def mine_sql(least: int = LEAST, top: int = 2000) -> str:
    """The same rows, for tables that fit one machine."""
    return rf"""
with piece as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from piece),
total as (select lang, cast(sum(len(w)) as bigint) as n from split group by lang),
f as (
  select lang, k, phrase, count(*) as f from (
    select lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in generate_series(1, len(w) - k + 1)]) as phrase
    from split, (values (1), (2), (3), (4)) as length (k) where len(w) >= k)
  group by lang, k, phrase having count(*) >= {least}),
c as (select lang, k as m, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1),
cut as (
  select lang, m, phrase, a, w, k, array_to_string(w[1:k], ' ') as x, array_to_string(w[k + 1:m], ' ') as y
  from c, (values (1), (2), (3)) as place (k) where k < m),
scored as (
  select cut.*, l.f as l, r.f as r, cast(2000000::hugeint * a // (l.f::hugeint + r.f) as bigint) as score
  from cut join f as l on l.lang = cut.lang and l.phrase = x and l.k = cut.k join f as r on r.lang = cut.lang and r.phrase = y and r.k = m - cut.k
  qualify row_number() over (partition by cut.lang, cut.phrase, m order by score, cut.k) = 1),
inner_ as (
  select lang, n, array_to_string(w[i:i + n - 1], ' ') as phrase, max(a) as longer
  from (select lang, a, w, n, unnest(generate_series(1, m - n + 1)) as i from c, (values (2), (3)) as size (n) where n < m) group by all),
kept as (
  select scored.* from scored left join inner_ on inner_.lang = scored.lang and inner_.phrase = scored.phrase and inner_.n = m
  where longer is null or 100::hugeint * longer < 80::hugeint * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join total using (lang) qualify rank <= {top}
"""
