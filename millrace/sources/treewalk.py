"""Data source ``treewalk``: one row per entry of a directory tree, metadata only.

The driver lists the uppermost directories until there are entries enough to deal to
the tasks, each of which walks the subtrees of its own.
Symbolic links are reported and never followed. No file is opened.
"""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, parent string, depth int, kind string, size long, nlink int, extension string"
ARROW = pa.schema(
    [
        ("path", pa.string()), ("parent", pa.string()), ("depth", pa.int32()), ("kind", pa.string()), ("size", pa.int64()), ("nlink", pa.int32()),
        ("extension", pa.string())
    ]
)
BATCH = 8192
#: Entries for each task, so that tasks end at about one time, and the most directories that the driver lists for it.
SPREAD, MOST_LISTED = 8, 256


def extension_of(name: str) -> str:
    """The lower-cased last suffix; ``(none)`` for none, for dot files, and for a trailing dot."""
    stem, dot, suffix = name.rpartition(".")
    return f".{suffix}".lower() if dot and suffix and stem.strip(".") else "(none)"


class _Subtrees(InputPartition):
    """Entries (path, whether to go into it); None stands for the root itself."""

    def __init__(self, entries: list[tuple[str, bool]] | None):
        self.entries = entries
        super().__init__(0)


class TreeWalkReader(DataSourceReader):
    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = root, tasks

    def partitions(self) -> list[InputPartition]:
        if not os.path.lexists(self.root):
            raise FileNotFoundError(f"no such path: {self.root}")
        if not os.path.isdir(self.root):
            return [_Subtrees(None)]
        try:
            waiting = deque((n, True) for n in sorted(os.listdir(self.root)))
        except OSError:
            return [_Subtrees(None)]
        done: list[tuple[str, bool]] = []
        listed = 0
        while waiting and listed < MOST_LISTED and len(waiting) + len(done) < SPREAD * self.tasks:
            path, _ = waiting.popleft()
            full = os.path.join(self.root, path)
            try:
                inside = sorted(os.listdir(full)) if os.path.isdir(full) and not os.path.islink(full) else None
            except OSError:
                inside = None
            listed += inside is not None
            done.append((path, inside is None))
            waiting.extend((f"{path}/{n}", True) for n in inside or ())
        entries = [*done, *waiting]
        return [_Subtrees(entries[i :: self.tasks]) for i in range(min(self.tasks, max(1, len(entries))))]

    def read(self, partition: _Subtrees) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in self._rows(partition):
            held.append(row)
            if len(held) == BATCH:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    def _rows(self, partition: _Subtrees) -> Iterator[tuple]:
        if partition.entries is None:
            if os.path.isdir(self.root):
                yield "", "", 0, "unreadable_dir", None, None, "(none)"
            else:
                yield self._entry(os.path.basename(self.root), "", os.path.basename(self.root), self.root, 0)[0]
            return
        todo = [(*path.rpartition("/")[::2], path.count("/") + 1, go_in) for path, go_in in reversed(partition.entries)]
        while todo:
            parent, name, depth, go_in = todo.pop()
            path = f"{parent}/{name}" if parent else name
            row, is_dir = self._entry(path, parent, name, os.path.join(self.root, path), depth)
            if is_dir and go_in:
                try:
                    inside = sorted(os.listdir(os.path.join(self.root, path)), reverse=True)
                except OSError:
                    row = (*row[:3], "unreadable_dir", *row[4:])
                    inside = []
                todo += [(path, n, depth + 1, True) for n in inside]
            yield row

    @staticmethod
    def _entry(path: str, parent: str, name: str, full: str, depth: int) -> tuple[tuple, bool]:
        try:
            found = os.lstat(full)
        except OSError:
            return (path, parent, depth, "unreadable_file", None, None, extension_of(name)), False
        mode = found.st_mode
        kind = "symlink" if stat.S_ISLNK(mode) else "dir" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "other"
        at = depth if kind == "dir" else max(0, depth - 1)
        return (
            path, parent, at, kind, found.st_size if kind == "file" else None, found.st_nlink if kind == "file" else None, extension_of(name)
        ), kind == "dir"


class TreeWalk(DataSource):
    """Options: path; tasks (default 8)."""

    @classmethod
    def name(cls) -> str:
        return "treewalk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeWalkReader(self.options["path"], int(self.options.get("tasks", "8")))


def walk(spark: SparkSession, path: str, tasks: int = 8) -> DataFrame:
    """The entries under ``path`` (a directory that all executors see, or one file)."""
    spark.dataSource.register(TreeWalk)
    return spark.read.format("treewalk").option("path", str(path)).option("tasks", str(tasks)).load()
