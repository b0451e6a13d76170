"""Export rows as named CSV files with a byte order mark, all of them or none.

Register ``ExportSink`` and write with format ``tagloom_export``: options ``path`` (a folder, by any address that Arrow's
file systems know and executors reach) and ``name``. Each task writes a file of its own below a folder of the job; when all
are done they get their names (``name-0.csv`` and so on; one task: ``name.csv``). If the job fails, the folder goes, and
nothing was seen under its name. Tasks that are run twice, and rows that were not committed, leave nothing.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed value: the mark at the beginning of a file.
MARK = "\ufeff"


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    rows: int


class ExportWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if not options.get("path"):
            raise ValueError("tagloom_export needs a path")
        self.path, self.file_name = options["path"].rstrip("/"), options.get("name", "export")
        self.columns, self.overwrite = schema.names, overwrite
        self.work = f"{self.path}/_writing-{uuid4().hex}"

    def _system(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        system, folder = self._system(self.work)
        system.create_dir(folder, recursive=True)
        file, n = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}.csv", 0
        with system.open_output_stream(file) as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as out:
            out.write(MARK)
            rows = csv.writer(out)
            rows.writerow(self.columns)
            for row in iterator:
                rows.writerow(["" if v is None else v for v in row])
                n += 1
        return Written(context.partitionId(), file, n)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        done = [m for m in done if m.rows] or done[:1]  # an empty table is one file with a header
        system, folder = self._system(self.path)
        named = [(m.file, f"{folder}/{self.file_name}{f'-{k}' if len(done) > 1 else ''}.csv") for k, m in enumerate(done)]
        taken = [target for _, target in named if system.get_file_info(target).type != fs.FileType.NotFound]
        if taken and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{taken[0]} is there already")
        for file, target in named:
            system.move(file, target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, folder = self._system(self.work)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class ExportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tagloom_export"

    def writer(self, schema: StructType, overwrite: bool) -> ExportWriter:
        return ExportWriter(self.options, schema, overwrite)
