"""Trees of files as a Spark data source: folders are the partitions, ignore rules prune them before they are listed."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size_bytes long, mtime_ms long, content binary"
ARROW = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("mtime_ms", pa.int64()), ("content", pa.binary())])
#: Folders that the driver opens up to find partitions; all below is walked by executors.
FOLDERS = 64
BATCH_BYTES = 8 << 20


def glob_pattern(glob: str) -> str:
    """A glob as an expression over whole relative paths: ``**/`` is any folders, ``*`` and ``?`` stay in one part."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] in "*?":
            out, i = out + ("[^/]*" if glob[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^(?:{out})$"


def ignore_pattern(rule: str) -> str:
    """A gitignore-like rule, relative to any folder unless it holds a slash before its end; a match takes all below it."""
    body = rule.strip().removeprefix("**/")
    held = "/" in body.rstrip("/").removesuffix("/**")
    inner = glob_pattern(body.rstrip("/").removesuffix("/**").removeprefix("/"))[1:-1]
    return f"^{'' if held else '(?:[^/]+/)*'}{inner}(?:/.*)?$"


def filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URL or local path, and the path in it."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class Rules:
    """Which paths of a tree are taken and which folders are entered."""

    def __init__(self, include: Sequence[str], exclude: Sequence[str]):
        either = lambda patterns: re.compile("|".join(f"(?:{p})" for p in patterns) or r"(?!)")
        self.taken, self.left = either(map(glob_pattern, include)), either([*map(glob_pattern, exclude), *map(ignore_pattern, exclude)])
        self.closed = either(map(ignore_pattern, exclude))

    def enters(self, folder: str) -> bool:
        return not folder.rsplit("/", 1)[-1].startswith(".") and not self.closed.match(folder)

    def takes(self, path: str) -> bool:
        return bool(self.taken.match(path)) and not self.left.match(path) and not path.rsplit("/", 1)[-1].startswith(".")


@dataclass
class Folder(InputPartition):
    """A folder to list, with everything below it if ``deep``."""

    path: str
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.rules = Rules(json.loads(options.get("include", '["**"]')), json.loads(options.get("exclude", "[]")))
        self.max_bytes = int(options["max_bytes"]) if options.get("max_bytes") else None

    def _list(self, files: fs.FileSystem, base: str, folder: str) -> Iterator[tuple[str, fs.FileInfo | os.DirEntry | None]]:
        """(relative path, its file) of taken files and (relative path, None) of entered folders; a folder that has gone is empty.

        A local folder is read entry by entry, so a folder of any number of files takes no memory for each; other
        file systems hand over a folder's listing as a whole.
        """
        if isinstance(files, fs.LocalFileSystem):
            try:
                with os.scandir(f"{base}/{folder}" if folder else base) as entries:
                    for entry in entries:
                        path = f"{folder}/{entry.name}" if folder else entry.name
                        if entry.is_dir():
                            if self.rules.enters(path):
                                yield path, None
                        elif self.rules.takes(path) and entry.is_file():
                            yield path, entry
            except FileNotFoundError:
                if not folder:
                    raise
            return
        for info in files.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=bool(folder))):
            path = info.path[len(base) :].lstrip("/")
            if info.type == fs.FileType.Directory and self.rules.enters(path):
                yield path, None
            elif info.type == fs.FileType.File and self.rules.takes(path):
                yield path, info

    def partitions(self) -> Sequence[Folder]:
        files, base = filesystem(self.root)
        out, todo = [], [""]
        while todo and len(out) + len(todo) < FOLDERS:
            folder = todo.pop(0)
            out.append(Folder(folder, False))
            todo += [path for path, info in self._list(files, base, folder) if info is None]
        return out + [Folder(f, True) for f in todo]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(self.root)
        todo, rows, held = [partition.path], [], 0
        while todo:
            for path, info in self._list(files, base, todo.pop()):
                if info is None:
                    if partition.deep:
                        todo.append(path)
                    continue
                row = self._row(files, path, info)
                if row is None:
                    continue
                rows.append(row)
                held += len(row[3] or b"") + 100
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, files: fs.FileSystem, path: str, info: fs.FileInfo | os.DirEntry) -> tuple | None:
        """A file that goes between listing and reading is no file."""
        content = None
        try:
            size, at = (info.size, info.mtime_ns or 0) if isinstance(info, fs.FileInfo) else ((stat := info.stat()).st_size, stat.st_mtime_ns)
            if self.max_bytes is None or size <= self.max_bytes:
                with files.open_input_stream(info.path) as f:
                    content = f.read()
        except FileNotFoundError:
            return None
        return path, size, at // 1_000_000, content

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class TreeSource(DataSource):
    """``spark.read.format("file_tree").options(include=..., exclude=..., max_bytes=...).load(root)``

    include and exclude are JSON lists of globs. The root is a local path or a URL that Arrow's file systems
    know (file, hdfs, s3, gs).
    """

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:  # noqa: ANN001
        return TreeReader(self.options)
