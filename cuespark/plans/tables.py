"""Input tables of the operators, derived from the given parquet tables.

All derivations are plain arithmetic on whole tables and whole texts, in integers
(milliseconds, samples) so that any engine gets the same numbers. tables_sql.py states the
same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ordered
from ..session import settle


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One table. A table stored in fewer pieces than there are cores is spread first.

    At scale a table has many more pieces than cores and nothing is shuffled.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """An input table as a stored one: operators that read their input in several branches read files."""
    return settle(df, name)


def cues(spark, sf) -> DataFrame:
    """Cue tracks: five tokens of a conversation turn per cue, with pauses and overlaps."""
    return stored(_cues(spark, sf), "cues")


def _cues(spark, sf) -> DataFrame:
    c = read(spark, sf, "conversations")
    c = c.select(
        F.col("conv_id").alias("track_id"), "turn", "role",
        F.split(F.trim(F.regexp_replace("text", "[ \n\t]+", " ")), " ").alias("tk"))
    c = c.select("*", F.explode(F.expr("sequence(0, (size(tk) - 1) div 5)")).alias("k"))
    c = c.select(
        "track_id", (F.col("turn") * 1000 + F.col("k")).alias("id"),
        F.array_join(F.slice("tk", F.col("k").cast("int") * 5 + 1, F.lit(5)), " ").alias("text"),
        F.expr("case track_id % 3 when 0 then 'en' when 1 then 'fr' else 'ja' end").alias("language"),
        F.expr("case role when 'user' then 0 when 'assistant' then 1 else 2 end").alias("speaker"))
    c = c.withColumn("dur", F.expr("greatest(200, length(text) * 40)").cast("bigint"))
    c = c.withColumn("gap", F.expr("case when id % 5 = 4 then 2500 when id % 3 = 1 then 0 else 120 end").cast("bigint"))
    c = ordered(c, sums={"start_ms": F.col("dur") + F.col("gap")})
    c = c.withColumn("end_ms", F.expr("start_ms + dur + case when id % 4 = 2 then 700 else 0 end"))
    return c.select(
        "track_id", "id", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"),
        "text", "language", "speaker", "start_ms", "end_ms")


def words(spark, sf) -> DataFrame:
    """Word timestamps: every token of a document, a long pause after each 25 words."""
    d = read(spark, sf, "documents").select(
        F.col("doc_id").alias("track_id"), F.col("lang").alias("language"),
        F.expr(r"filter(split(text, '[ \n\t]+'), t -> t <> '')").alias("tk"))
    w = d.select("track_id", "language", F.posexplode("tk").alias("i", "token"))
    return w.select(
        "track_id", F.col("i").cast("bigint").alias("i"), F.concat(F.lit(" "), "token").alias("word"),
        F.expr("i * 300L + 1000L * (i div 25)").alias("start_ms"),
        F.expr("i * 300L + 1000L * (i div 25) + 270").alias("end_ms"), "language")


def segments(spark, sf) -> DataFrame:
    """Raw segments of 20 words with word timestamps, in track order."""
    d = read(spark, sf, "documents").select(
        F.col("doc_id").alias("track_id"), F.col("lang").alias("language"), F.expr(r"btrim(text, ' \n\t')").alias("bare"))
    d = d.where("bare <> ''").select("track_id", "language", F.split("bare", "[ \n\t]+").alias("tk"))
    # Cut the tokens up before exploding, so that no row carries its whole document along.
    d = d.select("track_id", "language", F.posexplode(F.expr(
        "transform(sequence(0, (size(tk) - 1) div 20), s -> slice(tk, cast(s * 20 + 1 as int), 20))")).alias("seg", "part"))
    d = d.withColumn("words", F.expr(
        """transform(part, (x, j) -> struct(
             concat(' ', x) as word,
             ((seg * 20 + j) * 300L + 1000L * ((seg * 20 + j) div 25)) / 1000.0D as start,
             ((seg * 20 + j) * 300L + 1000L * ((seg * 20 + j) div 25) + 270) / 1000.0D as `end`))"""))
    return d.select(
        "track_id", F.col("seg").cast("bigint").alias("id"), F.col("words")[0]["start"].alias("start"),
        F.element_at("words", -1)["end"].alias("end"),
        F.concat(F.lit(" "), F.array_join("part", " ")).alias("text"), "words", "language")


def vectors(spark, sf) -> DataFrame:
    """Speaker vectors of timed cues, 400 to a track, close inside a label."""
    e = read(spark, sf, "embeddings")
    return e.select(
        F.expr("vec_id div 400").alias("track_id"), F.expr("vec_id % 400").alias("id"),
        F.expr("(vec_id % 400) * 4000").alias("start_ms"),
        F.expr("(vec_id % 400) * 4000 + 600 + (vec_id * 37) % 3000").alias("end_ms"),
        F.expr("((vec_id % 400) * 4000) / 1000.0D").alias("start"),
        F.expr("((vec_id % 400) * 4000 + 600 + (vec_id * 37) % 3000) / 1000.0D").alias("end"),
        F.expr("transform(embedding, (x, i) -> cast(x as double) * 2.4D + if(i = label, 4.0D, 0.0D))").alias("vector"),
        F.col("label").alias("voice"))


def candidates(spark, sf) -> DataFrame:
    """Four candidate translations per sentence, each into Urdu and French."""
    b = read(spark, sf, "benchmark")
    b = b.select("item_id", "text", F.explode(F.array(F.lit("ur"), F.lit("fr"))).alias("target"))
    b = b.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cand_ix"))
    return b.select(
        F.col("item_id").alias("sentence_id"), "target", "cand_ix", F.col("text").alias("source_text"),
        F.expr("""case cand_ix when 0 then text when 1 then left(text, length(text) div 4)
                  when 2 then lower(text) else repeat(text, 4) end""").alias("text"),
        F.expr("((item_id * 31 + cand_ix * 17) % 100) / 100.0D").alias("score"))


def frames(spark, sf) -> DataFrame:
    """Signal energy per millisecond: one frame per event, per user."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("track_id"), "event_id", "value")
    e = ordered(e, sums={"ms": F.lit(1).cast("bigint")}, order="event_id")
    return e.select("track_id", "ms", (F.col("value") * F.col("value")).alias("sumsq"), F.lit(1).alias("n"))


def job_events(spark, sf) -> DataFrame:
    """Events of running jobs: one job per user."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), "ts", "event_type")
    e = ordered(e, sums={"rank": F.lit(1).cast("bigint")}, keys=("job",), order="seq")
    return job_event_columns(e)


def job_event_columns(e: DataFrame) -> DataFrame:
    return e.select(
        "job", "seq", "ts",
        F.expr("""case event_type when 'view' then 'status' when 'click' then 'progress'
                  when 'purchase' then 'segment' when 'signup' then 'finished' else 'error' end""").alias("event"),
        F.expr("least(3, rank div 20)").alias("step"), F.lit(4).alias("steps"),
        F.expr("seq % 100").alias("done"),
        F.expr("case when seq % 37 = 0 then 0 else 100 end").alias("total"),
        F.expr("seq % 25").alias("cue"),
        F.concat(F.lit("message "), F.expr("seq % 7").cast("string")).alias("message"))


def takes(spark, sf) -> DataFrame:
    """Three spoken takes of every document, 40 lines to a track."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("attempt"))
    return d.select(
        F.expr("doc_id div 40").alias("track_id"), F.col("doc_id").alias("line_no"), "attempt",
        F.expr("((doc_id * 7919 + attempt * 104729) % 100) / 100.0D").alias("error"),
        F.expr("length(text) * (1000 + 700 * ((doc_id + attempt * 13) % 8)) + 12000").alias("n_samples"),
        F.length("text").alias("n_chars"),
        F.expr("(doc_id + attempt) % 3 = 0").alias("sped_up"),
        F.expr("(doc_id + attempt) % 11 = 0").alias("trimmed"),
        F.expr("(doc_id + attempt) % 7 = 0").alias("ran_on"))


def clips(spark, sf) -> DataFrame:
    """Scored clips: each conversation turn as spoken text and what was heard of it."""
    c = read(spark, sf, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("clip_id"),
        F.expr("element_at(array('native', 'alpha', 'beta', 'gamma', 'delta'), cast(conv_id % 5 as int) + 1)").alias("engine"),
        F.expr("element_at(array('en', 'fr', 'de'), cast(turn % 3 as int) + 1)").alias("language"),
        F.expr("if(role = 'user', 'FEMALE', if(role = 'assistant', 'MALE', 'OTHER'))").alias("gender"),
        F.col("text").alias("ref"),
        F.expr("""case when (conv_id + turn) % 7 = 0 then concat(text, ' ', text)
                       when (conv_id + turn) % 11 = 0 then ''
                       else replace(text, 'e', '') end""").alias("hyp"),
        F.expr("length(text) * 11L").alias("work_ms"), F.expr("length(text) * 70L + conv_id % 13").alias("audio_ms"),
        F.expr("if(conv_id % 5 = 0, null, ((conv_id * 17 + turn * 5) % 100) / 100.0D)").alias("similarity"))


def files(spark, sf) -> DataFrame:
    """A file list: media and subtitles of the same name, some repeated, some of other kinds."""
    p = read(spark, sf, "pages")
    p = p.withColumn("n", F.expr("page_id div 2"))
    p = p.withColumn("ext", F.expr("""case when page_id % 11 = 0 then '.txt' when page_id % 2 = 1 then '_en.SRT'
                                            when page_id % 6 = 0 then '.mp3' else '.mp4' end"""))
    return p.select(
        F.col("page_id").alias("file_id"),
        F.expr("concat(if(page_id % 4 < 2, '/lib/d', '/lib/./d'), n % 7, '/clip', n % 1000, ext)").alias("path"),
        F.length("html").cast("bigint").alias("bytes"),
        F.expr("element_at(array('pending', 'done', 'error', 'done'), cast(page_id % 4 as int) + 1)").alias("status"),
        F.expr("if(page_id % 5 = 0, 'ur', '')").alias("chosen_language"))
