"""Directory listings as a data source: machines' folders dealt to at most TASKS partitions, what cannot be read as a row of its own.

`spark.dataSource.register(FolderListing)`, then `spark.read.format("folder_listing").option("machine", "desktop_([0-9]+)")
.load(root)`. The root must be mounted on the driver and on every executor.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "machine long, dir string, file string, bytes long, mtime double, error string"
NAME = "folder_listing"
FILTERS = "spark.sql.python.filterPushdown.enabled"
TASKS = 256  #: fewer folders are a task each


@dataclass
class Folder:
    machine: int | None
    path: str
    error: str | None = None


@dataclass
class Folders(InputPartition):
    folders: list[Folder]


def walk(path: str, base: str) -> Iterator[tuple[str, str | None, int | None, float | None, str | None]]:
    """(dir, file, bytes, mtime, error) of all files below, folders by name; a folder or file that fails is one row."""
    try:
        with os.scandir(path) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError as e:
        yield os.path.relpath(path, base), None, None, None, f"{type(e).__name__}: {e.strerror}"
        return
    for e in entries:
        if e.name.startswith((".", "_")):
            continue
        try:
            if e.is_dir():
                yield from walk(e.path, base)
            else:
                stat = e.stat()
                yield os.path.relpath(path, base), e.name, stat.st_size, stat.st_mtime, None
        except OSError as x:
            yield os.path.relpath(path, base), e.name, None, None, f"{type(x).__name__}: {x.strerror}"


class ListingReader(DataSourceReader):
    def __init__(self, root: str, pattern: str):
        self.root, self.pattern, self.wanted = root, re.compile(pattern), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equality and membership on the machine choose folders; all else is left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("machine",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[Folders]:
        """The folders right below the root whose name tells a machine, dealt in turn, and one for a root that cannot be read."""
        try:
            with os.scandir(self.root) as found:
                names = sorted(e.name for e in found if not e.name.startswith((".", "_")) and e.is_dir())
        except OSError as e:
            return [Folders([Folder(None, self.root, f"{type(e).__name__}: {e.strerror}")])]
        told = [(self.pattern.fullmatch(n), n) for n in names]
        out = [Folder(int(m[1]), os.path.join(self.root, n)) for m, n in told if m and (self.wanted is None or int(m[1]) in self.wanted)]
        return [Folders(out[i::TASKS]) for i in range(min(TASKS, len(out)))] or [Folders([Folder(None, self.root, "")])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder in partition.folders:
            if folder.error is not None:
                if folder.error:
                    yield None, ".", None, None, None, folder.error
                continue
            for row in walk(folder.path, folder.path):
                yield folder.machine, *row


class FolderListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"].removeprefix("file:"), self.options.get("machine", "([0-9]+)"))


def read_listing(spark: SparkSession, root: str, machine: str = "([0-9]+)") -> DataFrame:
    """(machine, dir, file, bytes, mtime, error) of all files below the machines' folders of `root`, whose names match
    `machine` with the number as its group. Names that begin with a dot or an underscore are left out; folders of other
    names too. An error row has a null file where the folder itself failed."""
    spark.dataSource.register(FolderListing)
    spark.conf.set(FILTERS, "true")
    return spark.read.format(NAME).option("machine", machine).load(root)


def write_files(rows: DataFrame, root: str) -> None:
    """(path, text): one file for each path below `root`, which must be mounted as for a listing. Paths are unique; a file
    appears whole, so a task that runs again changes nothing."""
    base = root.removeprefix("file:")

    def write(part) -> None:
        for row in part:
            to = os.path.join(base, row.path)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            new = os.path.join(os.path.dirname(to), f".{uuid.uuid4().hex}")
            with open(new, "w", encoding="utf-8", newline="") as f:
                f.write(row.text)
            os.replace(new, to)

    rows.select("path", "text").foreachPartition(write)
