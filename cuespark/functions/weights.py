"""Speaking weight of text: how long it takes to say, relative to one Latin letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def block_table(spark) -> DataFrame:
    """The fixed table of code point blocks (first, last, weight): a few dozen rows."""
    rows, first = [], 0
    for last, kind in K.WEIGHT_BLOCKS:
        rows.append((first, last, K.WEIGHTS[kind]))
        first = last + 1
    rows.append((first, K.UPPER_CJK_FROM, K.WEIGHTS["default"]))
    rows.append((K.UPPER_CJK_FROM + 1, 0x7FFFFFFF, K.WEIGHTS["cjk"]))
    return spark.createDataFrame(rows, "first int, last int, weight double")


def _kind_weight(ch: Column) -> Column:
    """Weight decided by what kind of character it is, before its block matters."""
    return (F.when(ch.rlike("^[A-Za-z]$"), K.WEIGHTS["latin"])
            .when(ch == " ", K.WEIGHTS["space"])
            .when(ch == "ـ", K.WEIGHTS["mark"])
            .when(ch.rlike(r"^\p{M}$"), K.WEIGHTS["mark"])
            .when(ch.rlike(r"^[\p{P}\p{S}]$"), K.WEIGHTS["punctuation"])
            .when(ch.rlike(r"^\p{Z}$"), K.WEIGHTS["space"])
            .when(ch.rlike(r"^\p{N}$"), K.WEIGHTS["digit"]))


def char_weights(chars: DataFrame, char: str = "ch") -> DataFrame:
    """(character, weight) of distinct characters: a range join with the small block table."""
    d = chars.select(char).distinct().withColumn("_code", F.ascii(char))
    # first letters of distinct characters: `ascii` gives the full code point of the character
    blocks = F.broadcast(block_table(chars.sparkSession))       # fixed size
    j = d.join(blocks, F.col("_code").between(F.col("first"), F.col("last")), "left")
    return j.select(char, F.coalesce(_kind_weight(F.col(char)), "weight", F.lit(K.WEIGHTS["default"])).alias("weight"))


def _weight_classes() -> list[tuple[str, float]]:
    """Character classes with their weights, in the order in which a character is claimed."""
    first, of = 0, {}
    for last, kind in [*K.WEIGHT_BLOCKS, (K.UPPER_CJK_FROM, "default"), (0x10FFFF, "cjk")]:
        of.setdefault(K.WEIGHTS[kind], []).append(rf"\x{{{first:X}}}-\x{{{last:X}}}")
        first = last + 1
    kinds = [("A-Za-z", "latin"), (" ", "space"), (r"ـ\p{M}", "mark"), (r"\p{P}\p{S}", "punctuation"), (r"\p{Z}", "space"), (r"\p{N}", "digit")]
    return [(c, K.WEIGHTS[k]) for c, k in kinds] + [("".join(ranges), w) for w, ranges in of.items()]


def text_weights(texts: DataFrame, keys, text: str = "text") -> DataFrame:
    """Sum of the character weights of every text: (keys, weight); one row for each row.

    Within the row: each class is taken out of what the classes before have left, and what it
    took is a difference of lengths.
    """
    keys = list(keys)
    d = texts.select(*keys, F.coalesce(text, F.lit("")).alias("_left"), F.lit(0.0).alias("weight"))
    for chars, weight in _weight_classes():
        d = d.withColumn("_next", F.regexp_replace("_left", f"[{chars}]+", ""))
        d = d.select(*keys, (F.col("weight") + (F.length("_left") - F.length("_next")) * F.lit(weight)).alias("weight"), F.col("_next").alias("_left"))
    return d.select(*keys, "weight")


def estimate_duration(weight: Column, ref_weight: Column, ref_length: Column, speed: Column | None = None,
                      low: float = 50.0, boost: float = 3.0) -> Column:
    """Tokens a text needs, from a reference's weight and length; short ones are raised by a root curve."""
    plain = weight / (ref_weight / ref_length)
    raised = F.when(plain < low, low * F.pow(plain / low, 1.0 / boost)).otherwise(plain)
    est = F.when((ref_length <= 0) | (ref_weight == 0), 0.0).otherwise(raised)
    if speed is not None:
        est = F.when((speed > 0) & (speed != 1.0), est / speed).otherwise(est)
    return F.greatest(F.lit(1), F.floor(est)).cast("bigint")
