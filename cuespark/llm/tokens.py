"""Token counts with a digest cache.

A text is known by the digest of its normalised content, a tokenizer by the digest of its file and
of the library's version. Stored counts are joined by both; only distinct texts without one are
encoded, and their counts are appended to the cache, a Parquet table partitioned by tokenizer.

Copies are made one before anything is shuffled. The texts of the misses are shuffled once, by
digest; the join back to the documents carries their own columns and the digest only, and a hot
digest in it is left to Spark's splitting of skewed joins. A cache row may occur twice (two
runs at once, or a write that was repeated): counts are deduplicated when they are read.

Within a task texts are cut at ASCII blanks. Normalisation, splitting and merging of this kind of tokenizer
never look across a blank, so a text's count is the sum of its segments', and the library encodes
each distinct segment once, special strings and all.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import BLANKS, free_name, text_of

LIMIT = 2048
REMEMBERED = 300_000            # segments whose counts a task keeps at hand
AT_ONCE = 20_000                # segments that the library gets in one call
CACHE = "content string, n_tokens bigint"

_loaded: dict = {}


def version(path: str) -> str:
    """Digest of a tokenizer: its file's bytes and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(tokenizers.__version__.encode() + b"\n" + f.read()).hexdigest()


def normalised(text) -> Column:
    """Runs of ASCII blanks as one blank, none at the ends; A-Z lower-cased where the text is ASCII throughout
    and has no `<|`, so that no special string arises from another one. Never changes the count."""
    t = F.btrim(F.regexp_replace(text_of(text), BLANKS, " "))
    plain = (F.length(t) == F.octet_length(t)) & ~F.contains(t, F.lit("<|"))
    return F.when(plain, F.lower(t)).otherwise(t)


class Counter(dict):
    """Token counts of segments without blanks, as the library gives them; for tokenizers that drop white space."""

    def __init__(self, path: str, expected: str):
        if version(path) != expected:
            raise ValueError(f"{path} is another tokenizer, or library, than the driver's")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count(self, texts: list[bytes]) -> list[int]:
        if len(self) > REMEMBERED:
            self.clear()
        cut = [t.split() for t in texts]
        new = list(set().union(*cut).difference(self))
        for i in range(0, len(new), AT_ONCE):
            part = new[i:i + AT_ONCE]
            got = self.tokenizer.encode_batch_fast([s.decode() for s in part], add_special_tokens=False)
            self.update(zip(part, map(len, got)))
        return [sum(map(self.__getitem__, segments)) for segments in cut]


def _slices(batch: pa.RecordBatch, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, at most about `size` bytes of text together (a longer text is alone)."""
    start, held = 0, 0
    for i, value in enumerate(batch.column("text")):
        n = len(value.as_buffer())
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def encode(texts: DataFrame, path: str, expected: str) -> DataFrame:
    """content, n_tokens of rows content, text (bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, expected) not in _loaded:
            _loaded[path, expected] = Counter(path, expected)
        counter = _loaded[path, expected]
        for batch in batches:
            for part in _slices(batch):
                n = counter.count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("content").cast(pa.string()), pa.array(n, pa.int64())], ["content", "n_tokens"])
    return texts.mapInArrow(run, CACHE)


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """content, n_tokens of one tokenizer, one row per content; none where the cache is not yet there."""
    from pyspark.errors import AnalysisException

    try:
        table = spark.read.schema(f"{CACHE}, tokenizer string").parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)
    return table.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def fill(docs: DataFrame, path: str, cache: str, text: str = "text") -> None:
    """Append the counts of texts that the cache does not have to it."""
    spark, tokenizer = docs.sparkSession, version(path)
    norm = docs.select(normalised(text).alias("text"))
    # one row per distinct text before the cache is asked: a hot text is one row of each task
    distinct = norm.select(F.sha2("text", 256).alias("content"), "text").groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(stored(spark, cache, tokenizer).select("content"), "content", "left_anti")
    counted = encode(misses.select("content", F.encode("text", "UTF-8").alias("text")), path, tokenizer)
    counted.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, text: str = "text", limit: int = LIMIT,
                 keep_text: bool = True) -> DataFrame:
    """The documents' columns and n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    `path` is a tokenizer file that driver and executors have, `cache` a folder that all see; without one
    the call has a cache of its own in the shared folder. Without begin, end or added special tokens, truncation
    or padding; special strings inside texts count as the library's default has it. Null counts as the
    empty text, which has no tokens. Repeated rows are each counted. A result replaces an input
    column of its name; other columns stay. An empty table gives none. Without `keep_text` the text does not go through the join.
    """
    spark = docs.sparkSession
    cache = cache or fresh_path(spark, "token-counts")
    fill(docs, path, cache, text)
    content, counted = free_name(docs, "content"), free_name(docs, "n_tokens")
    counts = stored(spark, cache, version(path)).select(F.col("content").alias(content), F.col("n_tokens").alias(counted))
    own = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit") and (keep_text or c != text)]
    bytes_ = free_name(docs, "n_bytes")
    keyed = docs.select(*own, F.octet_length(text_of(text)).cast("long").alias(bytes_), F.sha2(normalised(text), 256).alias(content))
    return keyed.join(counts, content, "left").select(
        *own, F.col(bytes_).alias("n_bytes"), F.col(counted).alias("n_tokens"), (F.col(counted) > limit).alias("over_limit"))
