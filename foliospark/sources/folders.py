"""Inventory of a mounted folder as a data source: partitions are folders, each walked by its own task."""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import unquote, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def local_path(path: str) -> str:
    """The path in ``file:`` URLs; other texts are paths already."""
    return unquote(urlsplit(path).path) if path.startswith("file:") else path


def _children(folder: str) -> Iterator[os.DirEntry]:
    """What lies in a folder; one that is missing, was removed or can't be read has nothing."""
    try:
        with os.scandir(folder) as entries:
            yield from entries
    except OSError:
        return


class FolderPartition(InputPartition):
    """A folder, with all below it or only its own files."""

    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class FolderReader(DataSourceReader):
    """Names are listed where the partition runs; the driver only lists the folders of the first two levels."""

    def __init__(self, root: str, glob: str, recursive: bool, links: bool):
        self.root, self.glob, self.recursive, self.links = root, glob, recursive, links

    def _folders(self, folder: str) -> list[str]:
        return sorted(e.path for e in _children(folder) if e.is_dir(follow_symlinks=False))

    def partitions(self) -> list[FolderPartition]:
        parts = [FolderPartition(self.root, False)]
        if self.recursive:
            for first in self._folders(self.root):
                parts.append(FolderPartition(first, False))
                parts += [FolderPartition(second, True) for second in self._folders(first)]
        return parts

    def read(self, partition: FolderPartition) -> Iterator[tuple]:
        waiting = [partition.folder]
        while waiting:
            for e in _children(waiting.pop()):
                if e.is_dir(follow_symlinks=False):
                    if partition.deep:
                        waiting.append(e.path)
                elif fnmatchcase(e.name, self.glob) and (self.links or not e.is_symlink()):
                    try:
                        facts = e.stat() if e.is_file() else None
                    except OSError:  # removed while it was listed
                        continue
                    if facts:
                        yield e.path, datetime.datetime.fromtimestamp(facts.st_mtime, datetime.timezone.utc), facts.st_size


class FolderSource(DataSource):
    """``spark.read.format("folder_inventory").option("recursive", "true").load(path)``; options ``glob``, ``recursive``, ``links``."""

    @classmethod
    def name(cls) -> str:
        return "folder_inventory"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length bigint"

    def reader(self, schema) -> FolderReader:
        given = self.options
        return FolderReader(given["path"], given.get("glob", "*"), given.get("recursive", "true") == "true", given.get("links", "false") == "true")
