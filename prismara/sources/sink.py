"""A sink of named files that appear when the whole write has succeeded.

Tasks write below a hidden folder of the write, each attempt in a folder of
its own, and tell the driver which. When all tasks have succeeded, the files
of the attempts that count are moved to their names; when the write fails, the
hidden folder goes. So a task that is killed or runs twice leaves nothing, and
a failed job leaves no file. Any file system that Arrow reaches will do. Tasks
may still run when a write has failed; they make no folder anew, so that they
fail too. (Object stores have no folders: there a task that is killed after
that may leave the file that it was writing.)
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from posixpath import dirname

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, HIDDEN = "named_files", "_writing"
#: How often the hidden folder is removed while tasks that still run add files, and the seconds in between.
TRIES, PAUSE = 200, 0.05


@dataclass
class Attempt(WriterCommitMessage):
    """The folder of an attempt, and how many files it holds."""

    folder: str
    files: int


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path, and the path on it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class NamedFilesWriter(DataSourceArrowWriter):
    """``hidden`` names a folder of the write that is there already; else the first file of each attempt makes it."""

    def __init__(self, root: str, hidden: str | None = None):
        self.root = root.rstrip("/")
        self.there = hidden is not None
        self.hidden = hidden or f"{HIDDEN}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        system, root = file_system(self.root)
        folder, files, made = f"{self.hidden}/{uuid.uuid4().hex}", 0, set()
        for batch in iterator:
            for name, data in zip(batch.column("name"), batch.column("data"), strict=True):
                to = f"{root}/{folder}/{_inside(name.as_py())}"
                if not made:
                    system.create_dir(f"{root}/{folder}", recursive=not self.there)
                    made.add(f"{root}/{folder}")
                missing = []
                while (above := dirname(missing[-1] if missing else to)) not in made:
                    missing.append(above)
                for level in reversed(missing):
                    system.create_dir(level, recursive=False)
                    made.add(level)
                with system.open_output_stream(to, compression=None) as out:
                    out.write(data.as_buffer())
                files += 1
        return Attempt(folder, files)

    def commit(self, messages: list[Attempt | None]) -> None:
        system, root = file_system(self.root)
        for message in messages:
            if not message or not message.files:
                continue
            start = f"{root}/{message.folder}"
            found = [f.path for f in system.get_file_info(fs.FileSelector(start, recursive=True)) if f.is_file]
            for folder in {dirname(f) for f in found}:
                system.create_dir(root + folder[len(start) :], recursive=True)
            for file in found:
                system.move(file, root + file[len(start) :])
        self._clear()

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = file_system(self.root)
        for left in reversed(range(TRIES)):
            if system.get_file_info(f"{root}/{self.hidden}").type == fs.FileType.NotFound:
                return
            try:
                system.delete_dir(f"{root}/{self.hidden}")
            except OSError:  # a task has added a file meanwhile
                if not left:
                    raise
                time.sleep(PAUSE)


def _inside(name: str | None) -> str:
    if not name or name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"{name!r} does not name a file below the folder that is written to")
    return name


class NamedFiles(DataSource):
    """Rows ``name`` (below the path) and ``data``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        if "path" not in self.options:
            raise ValueError(f"{FORMAT} needs a path")
        if not {"name", "data"} <= set(schema.names):
            raise ValueError(f"{FORMAT} needs the columns name and data")
        return NamedFilesWriter(self.options["path"], self.options.get("hidden"))


def write_named(files: DataFrame, root: str) -> None:
    """Write ``data`` of each row to ``root``/``name``: all files or, if the write fails, none.

    A file that is there already is replaced. Two rows of one name leave either's
    data; a null name, or one that leads out of ``root``, fails the write; null
    data is an empty file.
    """
    from pyspark.sql import functions as F

    files.sparkSession.dataSource.register(NamedFiles)
    empty = F.coalesce(F.col("data").cast("binary"), F.lit(b""))
    rows = files.select("name", empty.alias("data"))
    writer = NamedFilesWriter(root, f"{HIDDEN}-{uuid.uuid4().hex}")
    system, path = file_system(writer.root)
    system.create_dir(f"{path}/{writer.hidden}", recursive=True)
    try:
        rows.write.format(FORMAT).mode("append").option("path", root).option("hidden", writer.hidden).save()
    finally:
        writer.abort([])
