"""A sink that writes subtitle files under the names a user expects.

Spark's file formats name their files themselves. `subtitle_files` is a Python data source whose tasks write each document
to a staging folder of their own; only the driver's commit, once all tasks have ended well, moves files to their names.
A task that fails, is killed or runs twice leaves no file in place: its folder is not in the list that is committed. The staging folder goes
with the commit or abort (a task that is still running at an abort may leave its part of it behind, nothing else). Paths may be of any store that pyarrow.fs opens (local and mounted folders, s3, gs, hdfs).
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.files import output_paths
from ..session import shared_folder
from .writers import WRITERS

MOVES = 16                      # files that are moved at a time


def _store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else posixpath.abspath(path))


@dataclass
class Staged(WriterCommitMessage):
    """Where a task lists what it has staged: one line a file, its place and its name to be."""
    listing: str
    files: int


class SubtitleFiles(DataSource):
    """Rows of `output` (a path) and `document`. Option `staging`: a folder in the outputs' store that all tasks share."""

    @classmethod
    def name(cls) -> str:
        return "subtitle_files"

    def schema(self) -> str:
        return "output string, document string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SubtitleWriter(posixpath.join(self.options["staging"], uuid.uuid4().hex))


class SubtitleWriter(DataSourceWriter):
    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator: Iterator) -> Staged:
        """Stage a task's documents; every attempt has a folder of its own."""
        folder = posixpath.join(self.staging, uuid.uuid4().hex)
        store, at = _store(folder)
        store.create_dir(at)
        listing, n = f"{at}/listing", 0
        try:
            with store.open_output_stream(listing) as names:
                for n, row in enumerate(iterator, 1):
                    staged = f"{at}/{n}"
                    with store.open_output_stream(staged) as f:
                        f.write(row["document"].encode())
                    names.write(json.dumps([staged, row["output"]]).encode() + b"\n")
        except BaseException:
            store.delete_dir(at)
            raise
        return Staged(listing, n)

    def commit(self, messages: list[Staged | None]) -> None:
        """Move everything to its name; a name that two rows have is an error before anything is moved."""
        store, at = _store(self.staging)
        listings, seen = [m.listing for m in messages if m is not None], set()
        for moves in self._listed(store, listings):
            for _, output in moves:
                if hash(output) in seen:
                    raise ValueError(f"several rows write {output}")
                seen.add(hash(output))

        def move(pair: tuple[str, str]) -> None:
            _, output = _store(pair[1])
            store.create_dir(posixpath.dirname(output))
            store.move(pair[0], output)

        with ThreadPoolExecutor(MOVES) as pool:
            for moves in self._listed(store, listings):
                list(pool.map(move, moves))
        store.delete_dir(at)

    @staticmethod
    def _listed(store, listings: list[str]) -> Iterator[list[tuple[str, str]]]:
        for listing in listings:
            with store.open_input_stream(listing) as f:
                yield [tuple(json.loads(line)) for line in f.read().splitlines()]

    def abort(self, messages: list[Staged | None]) -> None:
        store, at = _store(self.staging)
        if store.get_file_info(at).type.name != "NotFound":
            store.delete_dir(at)


def save_files(documents: DataFrame, staging: str | None = None) -> None:
    """Write rows (output, document), each as the file its `output` names; a file that is there is replaced.

    Either all files come to be or, if a task fails, none. (If the driver itself is lost while it moves them, those moved
    stay; running the write again completes it.)
    """
    spark = documents.sparkSession
    spark.dataSource.register(SubtitleFiles)
    (documents.select("output", "document").write.format("subtitle_files").option("staging", staging or f"{shared_folder(spark)}/staging")
     .mode("append").save())


def write_tracks(cues: DataFrame, tracks: DataFrame, formats: Sequence[str], suffix: Column | str = "", folder: str | None = None,
                 staging: str | None = None, **layout) -> DataFrame:
    """Write every track's cues in every format, beside its input file or into `folder`: (track_id, path, format, output, error).

    `tracks` has (track_id, path). Lines are as long as the track's script or language wants. An output that would overwrite an input, or that
    two inputs share, is not written and has an `error`.
    """
    named = output_paths(tracks, formats, suffix, folder)
    good = named.where("error is null").select("track_id", "format", "output")
    made = None
    for name in formats:
        docs = WRITERS[name](cues, **({} if name == "lrc" else layout)).select("track_id", F.lit(name).alias("format"), "document")
        made = docs if made is None else made.unionByName(docs)
    save_files(good.join(made, ["track_id", "format"]).select("output", "document"), staging)
    return named.select("track_id", "path", "format", "output", "error")
