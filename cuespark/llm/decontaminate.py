"""Benchmark decontamination: Wu-Manber search for many word windows at once.

Patterns are windows of consecutive benchmark words (an item shorter than a window is one
pattern). Patterns of one length form a `Matcher`. It looks at the last BLOCK words of the
current position: the shift table tells how far the window can move because no pattern has
that block nearer to its end; where the shift is zero, the bucket of that suffix lists the
patterns to compare word by word. Ordinary text is passed in steps of about a window.

Documents are only mapped, never shuffled. Patterns are sent to the executors in blocks of at
most `block_words` words, one pass over the documents per block, so what is broadcast has a
fixed size however large the benchmark is.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import add_columns, bytes_of, free_name

WINDOW = 10
BLOCK = 2

# ASCII letters in lower case and digits stay, other ASCII is blank, bytes of other characters stay.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if 65 <= b <= 90 else 32
              for b in range(256))


def fold_words(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_FOLD).split()


class Matcher:
    """Wu-Manber tables for patterns that all have `length` words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set]):
        self.length = len(next(iter(patterns)))
        self.block = min(BLOCK, self.length)
        self.far = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key = pattern[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.far), self.length - end)
            self.bucket[pattern[-self.block:]].append((pattern[:self.block], pattern, items))

    def occurrences(self, words: list[bytes]):
        """(start, items) of every place where a pattern stands."""
        length, block, far, shift, bucket = self.length, self.block, self.far, self.shift, self.bucket
        end, total = length, len(words)
        while end <= total:
            key = tuple(words[end - block:end])
            step = shift.get(key, far)
            if step == 0:
                start = end - length
                head = tuple(words[start:start + block])
                for first, pattern, items in bucket[key]:
                    if first == head and tuple(words[start:end]) == pattern:
                        yield start, items
                step = 1
            end += step


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]


def matchers(patterns: dict[tuple[bytes, ...], set]) -> list[Matcher]:
    by_length: dict[int, dict] = defaultdict(dict)
    for pattern, items in patterns.items():
        by_length[len(pattern)][pattern] = items
    return [Matcher(p) for _, p in sorted(by_length.items())]


def search(words: list[bytes], tables: list[Matcher], spans: list[int], items: set) -> list[int]:
    """Merged [start, end) spans of words inside occurrences, added to earlier ones; adds to items."""
    found = list(zip(spans[::2], spans[1::2]))
    for m in tables:
        for start, names in m.occurrences(words):
            found.append((start, start + m.length))
            items |= names
    found.sort()
    merged: list[int] = []
    for a, b in found:
        if merged and a <= merged[-1]:
            merged[-1] = max(merged[-1], b)
        else:
            merged += [a, b]
    return merged


def _blocks(benchmark: DataFrame, item: str, text: str, size: int, block_words: int):
    """Pattern tables of at most about `block_words` words each, read block by block."""
    b = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), bytes_of(text).alias("text"))
    total = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-int(total) // (2 * block_words)))         # a word and its blank have two bytes at least
    for k in range(count):
        patterns: dict[tuple[bytes, ...], set] = defaultdict(set)
        for row in b.where(F.pmod(F.xxhash64("item"), F.lit(count)) == k).toLocalIterator():
            for w in windows(fold_words(bytes(row.text)), size):
                patterns[w].add(row.item)
        yield k == count - 1, matchers(patterns) if patterns else []


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
               item_text: str = "text", window: int = WINDOW, block_words: int = 1_000_000) -> DataFrame:
    """The documents' columns and n_words, n_hit, n_items, items (sorted as strings), spans (word
    positions, start and end in turn).

    Null and empty texts have no words: nothing is hit, and such an item matches nothing. Equal
    items are each named; an item without id counts as the item "null". Repeated rows are judged
    each. A result replaces an input column of its name. An item whose text is larger than a
    block makes a block of its own.
    """
    raw, spans_at, items_at = (free_name(docs, n) for n in ("bytes", "spans", "items"))
    state = [(spans_at, "array<int>"), (items_at, "array<string>")]
    fields = [("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items", "array<string>"),
              ("spans", "array<int>")]
    df, first = docs, True
    for last, tables in _blocks(benchmark, item, item_text, window, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(tables)

        def scan(batch, shared=shared, first=first, last=last):
            out = defaultdict(list)
            texts = batch.column(raw).to_pylist()
            before = [([], [])] * len(texts) if first else list(
                zip(batch.column(spans_at).to_pylist(), batch.column(items_at).to_pylist()))
            for t, (spans, items) in zip(texts, before):
                w, items = fold_words(t), set(items)
                spans = search(w, shared.value, spans, items)
                if last:
                    out["n_words"].append(len(w))
                    out["n_hit"].append(sum(spans[1::2]) - sum(spans[::2]))
                    out["n_items"].append(len(items))
                out["items" if last else items_at].append(sorted(items))
                out["spans" if last else spans_at].append(spans)
            return out if texts else {n: [] for n, _ in (fields if last else state)}

        df = add_columns(df.withColumn(raw, bytes_of(F.col(text))), scan, fields if last else state,
                         [raw] + ([] if first else [spans_at, items_at]) * last)
        if not last:
            df = settle(df, "decontaminate")
        first = False
    return df


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    return found.select(
        doc, "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Only the documents in which no item window occurs, with their own columns."""
    clash = [f for f in ("n_words", "n_hit", "n_items", "items", "spans") if f in docs.columns]
    names = {c: f"__own_{c}" for c in clash}        # results would replace them: carried under other names
    found = find_items(docs.withColumnsRenamed(names), benchmark, **options).where("n_hit = 0")
    own = [F.col(names.get(c, c)).alias(c) for c in docs.columns]
    return found.select(*own)
