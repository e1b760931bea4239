"""Benchmark inputs and stored results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = ("engine string, source string, target string, language string, model string, count long, chrf double, "
          "mean_cer double, failed_rate double, real_time_factor double, seconds_per_sentence double, "
          "meaning struct<mean:double,median:double,p90:double,min:double,max:double,n:long>, unsupported string")


def load_results(spark: SparkSession, path: str, schema: str = RESULT, multi_line: bool = True) -> DataFrame:
    """All result rows stored as JSON under a path or glob: one object per file, or per line."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def append_results(results: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Store the results of finished jobs under a folder for each key.

    A job's folder is replaced as a whole, so that a run which is killed half way and repeated stores each
    result once; the folders of other jobs stay. Rows with a `failure` are not stored: their jobs run again.
    Keys name jobs, not rows: their number is that of the folders. A null key has a folder of its own, which an
    empty one shares.
    """
    if "failure" in results.columns:
        results = results.where("failure is null").drop("failure")
    (results.write.partitionBy(*keys).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path))


def stored_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What `append_results` has stored; the schema tells the keys' types, in its own order of columns."""
    df = spark.read.schema(schema).parquet(path)
    return df.select(*[f.name for f in spark.createDataFrame([], schema).schema])


def parse_utterances(lines: DataFrame, order: str = "n") -> DataFrame:
    """(file, text, gender) of tab-separated lines; the first line of every file name wins.

    No quoting. Repeated files are folded before the shuffle.
    """
    f = F.split("value", "\t")
    r = lines.select(order, F.get(f, F.lit(1)).alias("file"), F.get(f, F.lit(2)).alias("text"), F.get(f, F.lit(6)).alias("gender"))
    r = r.where("file is not null").groupBy("file").agg(F.min_by(F.struct(order, "text", "gender"), order).alias("r"))
    return r.select("file", "r.text", "r.gender", F.col(f"r.{order}").alias(order))


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    """Utterances of a TSV file, in file order by `n`."""
    lines = spark.read.text(path).select("value", F.struct(
        F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("n"))
    return parse_utterances(lines)
