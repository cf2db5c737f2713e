"""Programs as files of their own, by a data source: ``df.write.format("programs").save(path)`` and back.

A program lies under ``path/task/sample/file``. Tasks write their rows themselves, each file under
another name first and then renamed, into one folder beside ``path``; the commit is a single rename of that
folder, whatever the number of files, and an abort deletes it: a write that fails leaves nothing, and a task that
runs twice writes the same files again. Readers list the folders of tasks only; what is in them is listed and
read by the tasks of the job, ``folders`` of them each.

Names: ``/`` in a task or sample becomes ``_``, as path-safe ids do; null or empty names and files are refused. A null
program is an empty file. Rows of one name: one of them stays, so names are for the caller to
make unique. Other columns are refused. A path that exists is replaced by ``overwrite`` and refused by ``append``.
"""

from __future__ import annotations

import contextlib
import os
import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..session import ship

SCHEMA = "task string, sample string, file string, program string"
#: Folders of tasks that a reading task takes.
FOLDERS = 64
#: Times that an abort deletes what a write has left.
TRIES = 10


def _opened(path: str):
    """The file system of a path (any that Arrow knows) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}") if not path.startswith("file:/") or path.startswith("file://") else fs.FileSystem.from_uri("file://" + path[5:])


def _listed(system, path: str) -> list:
    from pyarrow import fs

    return sorted((f for f in system.get_file_info(fs.FileSelector(path)) if not f.base_name.startswith((".", "_"))), key=lambda f: f.base_name)


class Programs(DataSource):
    """Folders of program files."""

    @classmethod
    def name(cls) -> str:
        return "programs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("folders", FOLDERS)), self.options.get("suffix", ""))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if sorted(schema.fieldNames()) != ["file", "program", "sample", "task"]:
            raise ValueError(f"programs have the columns {SCHEMA}, not {schema.fieldNames()}")
        return _Writer(self.options["path"], overwrite)


@dataclass
class _Folders(InputPartition):
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str, folders: int, suffix: str):
        self.path, self.folders, self.suffix = path, folders, suffix

    def partitions(self) -> list[InputPartition]:
        system, root = _opened(self.path)
        names = [f.base_name for f in _listed(system, root)]
        return [_Folders(names[at : at + self.folders]) for at in range(0, len(names), self.folders)] or [_Folders([])]

    def read(self, partition: _Folders):
        system, root = _opened(self.path)
        for task in partition.names:
            for sample in _listed(system, posixpath.join(root, task)):
                for f in _listed(system, sample.path):
                    if f.base_name.endswith(self.suffix):
                        with system.open_input_stream(f.path) as stream:
                            yield task, sample.base_name, f.base_name, stream.read().decode("utf-8", "replace")


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        head, tail = posixpath.split(self.path)
        self.staged = f"{head}/_{tail}-{uuid.uuid4().hex}"
        # Tasks only add to this folder: one that still runs after an abort finds it gone.
        system, root = _opened(self.staged)
        system.create_dir(root)

    def write(self, rows) -> WriterCommitMessage:
        system, root = _opened(self.staged)
        made: set[str] = set()
        n = 0
        for row in rows:
            parts = [(row[c] or "").replace("/", "_") for c in ("task", "sample", "file")]
            if any(p.strip(".") == "" or p.startswith(("_", ".")) for p in parts):
                raise ValueError(f"no name for a file: {parts}")
            folder = posixpath.join(root, *parts[:2])
            if folder not in made:
                for place in (posixpath.dirname(folder), folder):
                    system.create_dir(place, recursive=False)
                made.add(folder)
            first = posixpath.join(folder, f".{uuid.uuid4().hex}")
            with system.open_output_stream(first) as out:
                out.write((row["program"] or "").encode())
            system.move(first, posixpath.join(folder, parts[2]))
            n += 1
        return _Written(n)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, root = _opened(self.staged)
        target = _opened(self.path)[1]
        there = system.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        if there:
            system.delete_dir(target)
        system.move(root, target)

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, root = _opened(self.staged)
        for _ in range(TRIES):  # a killed task may still be adding a file
            if system.get_file_info(root).type == fs.FileType.NotFound:
                return
            with contextlib.suppress(OSError):
                system.delete_dir(root)


def register(spark: SparkSession) -> None:
    """Make ``programs`` a format of the session."""
    ship(spark)
    spark.dataSource.register(Programs)
