"""File queues: scanning, kinds, languages in names, pairing, output paths."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..sources.folders import FolderTree

WORD = r"(?U)([\s._\-\[(]+)([A-Za-z]+)[\])]?\s*$"
TAGS = r"(?iU)([\s._\-\[(]+(" + "|".join(K.SUBTITLE_TAGS) + r")[\])]?\s*)+$"
SEPARATORS = " ._-[("


def walk_folders(spark: SparkSession, roots: Sequence[str], extensions: Sequence[str]) -> DataFrame:
    """(path, bytes, error): files below the roots, and folders that could not be read.

    Folders of a mounted file system are walked in parallel, subtree by subtree; a root of another store is listed by
    Spark's own file reader, which fails on folders that it cannot read.
    """
    wanted = [e.lower().lstrip(".") for e in extensions]
    stores = [r for r in roots if "://" in r and not r.startswith("file:")]
    mounted = [r for r in roots if r not in stores]
    found = None
    if mounted or not stores:
        spark.dataSource.register(FolderTree)
        f = spark.read.format("folder_tree").option("roots", json.dumps(mounted)).load()
        found = f.where(F.col("error").isNotNull() | extension("path").isin(wanted))
    if stores:
        any_case = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in wanted]
        s = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("ignoreMissingFiles", True).option("pathGlobFilter", "*.{" + ",".join(any_case) + "}")
             .load(stores).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("error")))
        found = s if found is None else found.unionByName(s)
    return found


def scan_files(spark: SparkSession, roots: Sequence[str], extensions: Sequence[str]) -> DataFrame:
    """(path, bytes) of files below the roots, in the order a file browser lists them.

    Only names and sizes are read. A folder's own files come before its subfolders, both in
    case-insensitive order. Links to folders are not followed; folders that cannot be read are left out, walk_folders names them.
    """
    return walk_folders(spark, roots, extensions).where("error is null").select("path", "bytes").orderBy(browse_key("path"))


def browse_key(path: str) -> Column:
    """Sort key that lists a folder's files before its subfolders."""
    parts = F.split(F.lower(path), "/")
    n = F.size(parts)
    return F.transform(parts, lambda p, i: F.concat(F.when(i == n - 1, "0").otherwise("1"), p))


def extension(path: str) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def classify(files: DataFrame, path: str = "path") -> DataFrame:
    """Add `ext` (upper case, FILE if none) and `kind`: video, subtitle or audio."""
    e = extension(path)
    kind = F.when(e.isin(K.VIDEO_EXTENSIONS), "video").when(e.isin(K.SUBTITLE_EXTENSIONS), "subtitle").otherwise("audio")
    return files.withColumn("ext", F.when(e == "", "FILE").otherwise(F.upper(e))).withColumn("kind", kind)


def normal_path(path: str) -> Column:
    """The path without empty and `.` parts, and with `..` resolved."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(done, p):
        up = (p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, p))

    solved = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(F.size(a) == 0, F.array(p)).otherwise(step(a, p)))
    return F.concat(F.when(F.startswith(F.col(path), F.lit("/")), "/").otherwise(""), F.array_join(solved, "/"))


def dedupe_files(files: DataFrame, existing: DataFrame | None = None, order: str = "file_id") -> DataFrame:
    """The first row of every normalized path, without those already known.

    Copies are folded before the shuffle, so a path that fills a third of the list stays cheap.
    """
    f = files.withColumn("path", normal_path("path"))
    rest = [c for c in f.columns if c != "path"]
    f = f.groupBy("path").agg(F.min_by(F.struct(*rest), order).alias("_f")).select("path", "_f.*")
    if existing is not None:
        f = f.join(existing.select(normal_path("path").alias("path")).distinct(), "path", "left_anti")
    return f


def _language_code(word: Column) -> Column:
    w = F.lower(word)
    named = F.create_map(*[F.lit(x) for kv in K.LANGUAGE_WORDS.items() for x in kv])
    return F.when(F.length(w) == 2, F.when(w.isin(K.SUPPORTED_LANGUAGES), w)).otherwise(named[w])


def split_language(files: DataFrame, path: str = "path") -> DataFrame:
    """Add `language`, the tag that ends the file name, and `base_path`, the path without it.

    Reads two-letter codes with a region, three-letter codes and English names, before tags
    such as `forced`. A name must remain in front of the tag.
    """
    d = files.withColumn("_dir", F.regexp_extract(path, r"^(.*/)?", 0))
    d = d.withColumn("_name", F.substr(path, F.length("_dir") + 1))
    d = d.withColumn("_ext", F.regexp_extract("_name", r"^.*[^.](\.[^.]*)$", 1))
    d = d.withColumn("_stem", F.substr("_name", F.lit(1), F.length("_name") - F.length("_ext")))
    d = d.withColumn("_s0", F.regexp_replace("_stem", TAGS, ""))

    def look(d, src, n):
        d = d.withColumn(f"_sep{n}", F.regexp_extract(src, WORD, 1)).withColumn(f"_w{n}", F.regexp_extract(src, WORD, 2))
        d = d.withColumn(f"_s{n}", F.regexp_replace(src, WORD, ""))
        named = (F.col(f"_w{n}") != "") & (F.btrim(F.col(f"_s{n}"), F.lit(SEPARATORS)) != "")
        return d.withColumn(f"_c{n}", F.when(named, _language_code(F.col(f"_w{n}")))).withColumn(f"_ok{n}", named)

    d = look(look(d, "_s0", 1), "_s1", 2)
    region = (F.col("_ok1") & F.col("_c1").isNull() & (F.col("_sep1") == "-") & (F.length("_w1") <= 4)
              & (F.length("_w2") == 2) & F.col("_c2").isNotNull())
    code = F.when(F.col("_c1").isNotNull(), F.col("_c1")).when(region, F.col("_c2"))
    stem = F.when(F.col("_c1").isNotNull(), F.col("_s1")).when(region, F.col("_s2"))
    return d.select(*files.columns, F.coalesce(code, F.lit("")).alias("language"),
                    F.when(code.isNotNull(), F.concat("_dir", stem, "_ext")).otherwise(F.col(path)).alias("base_path"))


def effective_language(files: DataFrame) -> DataFrame:
    """Add `text_language`: the chosen language, else the one in the file name."""
    return files.withColumn("text_language", F.coalesce(F.nullif("chosen_language", F.lit("")), "language"))


def runnable_files(files: DataFrame) -> DataFrame:
    """Unfinished files, or every file when all are done."""
    todo = files.agg(F.count_if(F.col("status") != "done").alias("_todo"))
    return files.crossJoin(F.broadcast(todo)).where(           # one row
        (F.col("status") != "done") | (F.col("_todo") == 0)).drop("_todo")


def queue_totals(files: DataFrame) -> DataFrame:
    """How many files, bytes, done, failed and runnable ones there are."""
    open_ = F.count_if(F.col("status") != "done")
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "error").alias("failed"),
        F.when(open_ > 0, open_).otherwise(F.count(F.lit(1))).alias("runnable"))


def stem_key(path: str) -> Column:
    return F.lower(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""))


def pair_companions(subtitles: DataFrame, media: DataFrame, order: str = "file_id") -> DataFrame:
    """Each subtitle with the first media file of the same name; `media_path` is null for others.

    Media are folded to one row per name first, so equal names never multiply.
    """
    s = split_language(subtitles.select("path", order)).withColumn("_k", stem_key("base_path"))
    m = media.withColumn("_k", stem_key("path")).groupBy("_k").agg(F.min_by("path", order).alias("media_path"))
    return s.join(m, "_k", "left").select("path", order, "language", "media_path")


def unpaired(pairs: DataFrame) -> DataFrame:
    return pairs.where("media_path is null").select("path", "language")


def output_paths(tracks: DataFrame, formats: Sequence[str], suffix: Column | str = "", folder: str | None = None) -> DataFrame:
    """One row per input and format: `output`, and `error` where it would overwrite an input
    or two inputs share it.

    Subtitle inputs lose their language tag first, media names are kept whole.
    """
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    t = split_language(tracks)
    base = F.when(extension("path").isin(K.SUBTITLE_EXTENSIONS), F.col("base_path")).otherwise(F.col("path"))
    stem = F.regexp_replace(base, r"(?<=[^/])\.[^./]*$", "")
    if folder:
        stem = F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_extract(stem, r"[^/]*$", 0))
    t = t.withColumn("_stem", F.concat(stem, suffix)).withColumn("format", F.explode(F.array(*[F.lit(f) for f in formats])))
    t = t.withColumn("output", F.concat("_stem", F.lit("."), "format"))
    ins = tracks.select(normal_path("path").alias("_p")).groupBy("_p").agg(F.lit(True).alias("_in"))
    same = t.groupBy("output").agg(F.count(F.lit(1)).alias("_n"))
    t = t.join(same, "output").withColumn("_p", normal_path("output")).join(ins, "_p", "left")
    return t.select(*tracks.columns, "format", "output", F.when(
        F.col("_in"), F.concat(F.lit("Writing "), F.regexp_extract("output", r"[^/]*$", 0), F.lit(" would overwrite the input file.")))
        .when(F.col("_n") > 1, "Several inputs would write this file.").alias("error"))
