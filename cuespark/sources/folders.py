"""Walking folders as a Python data source: `folder_tree`.

The driver looks a few levels down, until there are subtrees enough for all tasks; each task then walks its own. Links to folders are
not followed, links to files are. A folder that cannot be read is a row with an `error`, and the walk goes on.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUBTREES = 256                  # folders at which the driver stops looking further down


def local_path(path: str) -> str:
    """A `file:` address as a path."""
    return "/" + path[len("file:"):].lstrip("/") if path.startswith("file:") else path


def entries(folder: str) -> tuple[list[tuple[str, int]], list[str], str | None]:
    """(files with their sizes, subfolders, error) of one folder."""
    files, folders = [], []
    try:
        with os.scandir(folder) as found:
            for e in found:
                try:
                    if e.is_dir(follow_symlinks=False):
                        folders.append(e.path)
                    elif e.is_file():
                        files.append((e.path, e.stat().st_size))
                except OSError:
                    continue                                    # gone meanwhile
    except OSError as e:
        return [], [], f"Skipped {folder}: {e.strerror or e}"
    return files, sorted(folders), None


@dataclass
class Subtree(InputPartition):
    folder: str
    deep: bool                  # with everything below, or the folder's own files only


class FolderTree(DataSource):
    """(path, bytes, error) of everything below the folders of option `roots`, a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return "path string, bytes bigint, error string"

    def reader(self, schema) -> DataSourceReader:
        roots = dict.fromkeys(os.path.normpath(local_path(r)) for r in json.loads(self.options["roots"]))
        return FolderReader(list(roots), int(self.options.get("subtrees", SUBTREES)))


class FolderReader(DataSourceReader):
    def __init__(self, roots: list[str], subtrees: int):
        self.roots, self.subtrees = roots, subtrees

    def partitions(self) -> list[Subtree]:
        """Subtrees of about one level, and the folders above them."""
        above, level = [], self.roots
        while level and len(level) < self.subtrees:
            below = [(f, entries(f)[1]) for f in level]
            if not any(b for _, b in below):
                break
            above += [f for f, _ in below]
            level = [b for _, bs in below for b in bs]
        return [Subtree(f, False) for f in above] + [Subtree(f, True) for f in level]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        todo = [partition.folder]
        while todo:
            folder = todo.pop()
            files, folders, error = entries(folder)
            if error:
                yield folder, None, error
            yield from ((path, size, None) for path, size in files)
            if partition.deep:
                todo += folders
