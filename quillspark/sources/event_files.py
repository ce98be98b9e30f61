"""Growing files of event lines as a stream: each whole line once, by byte offsets.

A process appends lines to a file while it works; what stands after the last line break is not a line yet, nor is half a
character. An offset says for each file how many of its bytes have been read, always up to a line break. Large additions
are cut into pieces at line breaks, which tasks read apart. A file that has become shorter than what was read is an error.
Files are reached by pyarrow: local paths that all machines share, or addresses like hdfs:// and s3://.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, start long, value string"
#: Bytes that one task reads; bytes that are looked at together.
PIECE_BYTES, BLOCK_BYTES = 64 << 20, 1 << 20


def reached(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Piece(InputPartition):
    """Lines of a file that begin within [start, end), where lines of the whole addition begin at `first`."""

    def __init__(self, path: str, first: int, start: int, end: int):
        self.path, self.first, self.start, self.end = path, first, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.suffix = options.get("suffix", ".jsonl")
        self.piece = int(options.get("piecebytes", PIECE_BYTES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system, top = reached(self.folder)
        found = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
        names = sorted(x.path for x in found if x.is_file and x.path.endswith(self.suffix))
        return {n: self._whole(system, n) for n in names}

    @staticmethod
    def _whole(system: fs.FileSystem, path: str) -> int:
        """Bytes of a file up to its last line break."""
        with system.open_input_file(path) as f:
            end = f.size()
            while end > 0:
                start = max(0, end - BLOCK_BYTES)
                at = f.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, to in end.items():
            first = start.get(path, 0)
            if to < first:
                raise ValueError(f"{path} has become shorter than what was read of it")
            out += [Piece(path, first, at, min(to, at + self.piece)) for at in range(first, to, self.piece)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = reached(self.folder)
        with system.open_input_file(partition.path) as f:
            at = partition.start
            if at > partition.first:  # the line that the piece before ends in is that one's
                f.seek(at - 1)
                at += self._line(f)[1] - 1
            else:
                f.seek(at)
            starts: list[int] = []
            values: list[str] = []
            size = 0
            while at < partition.end:
                raw, n = self._line(f)
                starts.append(at)
                values.append(raw.decode("utf-8", "replace"))
                at += n
                size += n
                if size > BLOCK_BYTES:
                    yield self._batch(partition.path, starts, values)
                    starts, values, size = [], [], 0
            if starts:
                yield self._batch(partition.path, starts, values)

    @staticmethod
    def _line(f) -> tuple[bytes, int]:
        """The line at the file's place, without its break, and its bytes with it."""
        parts, begin = [], f.tell()
        while True:
            block = f.read(4096)
            at = block.find(b"\n")
            if at >= 0 or not block:
                parts.append(block[: max(at, 0)])
                raw = b"".join(parts)
                f.seek(begin + len(raw) + 1)
                return raw.removesuffix(b"\r"), len(raw) + 1
            parts.append(block)

    @staticmethod
    def _batch(path: str, starts: list[int], values: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(values, pa.string())], names=["path", "start", "value"])


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Reader({k.lower(): v for k, v in self.options.items()})


def growing_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """path, start (the line's first byte) and value of every whole line of the folder's files, as a stream."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("suffix", suffix).option("pieceBytes", piece_bytes).load(folder)


def offsets_of(text: str) -> dict[str, int]:
    """A stored offset, as bytes by file."""
    return json.loads(text)
