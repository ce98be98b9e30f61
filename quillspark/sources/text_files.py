"""Rows as files: each row's text a file of its name, written by the tasks, put in place together.

Tasks write below a folder of the job's own; once all have ended well, the files move to their names, and if one fails the
folder goes and nothing has changed. A file of the same name is replaced, others stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .event_files import reached


@dataclass
class Written(WriterCommitMessage):
    """Names of a task's files, and the folder that holds them."""

    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.own = f"_writing-{uuid.uuid4().hex}"

    def _at(self) -> tuple[fs.FileSystem, str]:
        system, top = reached(self.folder)
        return system, top

    def write(self, iterator: Iterator[Row]) -> Written:
        system, top = self._at()
        folder = f"{top}/{self.own}/{uuid.uuid4().hex}"  # an attempt's own: one that is tried again leaves nothing that counts
        system.create_dir(folder, recursive=True)
        names = []
        for row in iterator:
            if not row.name or "/" in row.name or row.name in (".", "..") or row.name.startswith("_"):
                raise ValueError(f"not a file name: {row.name!r}")
            with system.open_output_stream(f"{folder}/{row.name}") as f:
                f.write((row.text or "").encode())
            names.append(row.name)
        return Written(folder, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, top = self._at()
        all_ = [(m.folder, n) for m in messages if isinstance(m, Written) for n in m.names]
        if len({n for _, n in all_}) < len(all_):
            raise ValueError("two rows have the same file name")
        for folder, name in all_:
            system.move(f"{folder}/{name}", f"{top}/{name}")
        self._gone()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._gone()

    def _gone(self) -> None:
        system, top = self._at()
        if system.get_file_info(f"{top}/{self.own}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/{self.own}")


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_text_files(files: DataFrame, folder: str) -> None:
    """Files of name and text in the folder, all of them or none."""
    files.sparkSession.dataSource.register(TextFiles)
    files.select("name", "text").write.format("text_files").mode("append").save(folder)
