"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BLANKS = r"[\x20\x09-\x0D]+"
WORDS_SQL = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text) -> Column:
    """Words between ASCII blanks; none for null."""
    return F.filter(F.split(text_of(text), BLANKS), lambda w: w != "")


def word_count(text) -> Column:
    """Number of words() without making the array twice."""
    bare = F.btrim(text_of(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANKS))).cast("long")


def bytes_of(text) -> Column:
    """UTF-8 bytes, null as empty: Python then takes them without decoding."""
    return F.encode(text_of(text), "UTF-8")


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; a null key counts as empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % modulus


def extended(schema: T.StructType, fields: Iterable[tuple[str, str]]) -> T.StructType:
    """A schema with result fields at its end; a result replaces an input column of the same name."""
    new = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    return T.StructType([f for f in schema if f.name not in new.names] + list(new))


def add_columns(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, list]],
                fields: Iterable[tuple[str, str]], drop: Iterable[str] = ()) -> DataFrame:
    """Result columns computed in Python for each Arrow batch, beside the columns that come in.

    `make` returns the values of each field. Columns in `drop` are inputs of `make` only.
    """
    fields, drop = list(fields), set(drop)
    kept = T.StructType([f for f in df.schema if f.name not in drop])
    out = extended(kept, fields)
    arrow = to_arrow_schema(out)
    results = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch)
            columns = [pa.array(made[f.name], type=f.type) if f.name in results
                       else batch.column(f.name).cast(f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, out)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have."""
    name = f"__{stem}"
    while name in df.columns:
        name += "_"
    return name
