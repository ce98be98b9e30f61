"""The files of a source tree as a table: a Python data source that walks folders in parallel.

Spark's own file sources leave out names that begin with a dot or an underscore, which a tree scan must keep. One
partition reads one top-level entry (large folders are split once more). Cheap tests come first: names, ignore patterns,
size; then the bytes are read, binary files are dropped and the rest is decoded with U+FFFD for what is not UTF-8.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import MAX_FILE_BYTES, MAX_FILES, SKIP_DIRS, SKIP_EXTENSIONS, SKIP_FILES, SNIFF_BYTES, language, priority
from ..functions.text import content_hash, is_generated, is_minified


class IgnoreRules:
    """Ignore patterns of a tree's root: later ones win, ! takes back, a slash anchors, a trailing one means folders."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern[str], bool, bool]] = []
        for raw in text.split("\n"):
            line = re.sub(r"(?<!\\)\s+$", "", raw.rstrip("\r"))
            if not line or line.startswith("#"):
                continue
            back = line.startswith("!")
            line = line[back:]
            line = line[1:] if line.startswith(("\\#", "\\!")) else line
            folder = line.endswith("/")
            body = line.rstrip("/")
            if body:
                self.rules.append((re.compile(self._pattern(body)), folder, back))

    @staticmethod
    def _pattern(body: str) -> str:
        anchored = "/" in body
        body = body.lstrip("/")
        out, i = "" if anchored else "(?:.*/)?", 0
        while i < len(body):
            c = body[i]
            if body.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif body.startswith("/**", i) and i + 3 == len(body):
                out, i = out + "/.+", i + 3
            elif c == "*":
                while body.startswith("*", i + 1):
                    i += 1
                out, i = out + "[^/]*", i + 1
            elif c == "?":
                out, i = out + "[^/]", i + 1
            elif c == "[" and (end := body.find("]", i + 2)) > 0:
                inner = body[i + 1 : end].replace("\\", "\\\\")
                out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            elif c == "\\" and i + 1 < len(body):
                out, i = out + re.escape(body[i + 1]), i + 2
            else:
                out, i = out + re.escape(c), i + 1
        return out + r"\Z"

    def ignores(self, path: str, folder: bool) -> bool:
        """Whether a path, or a folder above it, is ignored."""
        parts = path.split("/")
        for n in range(1, len(parts) + 1):
            here, is_folder = "/".join(parts[:n]), folder or n < len(parts)
            hit = False
            for pattern, folders_only, back in self.rules:
                if (is_folder or not folders_only) and pattern.match(here):
                    hit = not back
            if hit:
                return True
        return False


class _Part(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def _extension(name: str) -> str:
    return os.path.splitext(name)[1].lower()


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root
        try:
            with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
                self.rules = IgnoreRules(f.read())
        except OSError:
            self.rules = IgnoreRules("")

    def _enters(self, rel: str) -> bool:
        return os.path.basename(rel) not in SKIP_DIRS and not self.rules.ignores(rel, True)

    def _list(self, rel: str) -> tuple[list[str], list[str]]:
        """Folders and files of a folder; what can't be read is left out."""
        folders, files = [], []
        try:
            names = sorted(os.listdir(os.path.join(self.root, rel)))
        except OSError:
            return folders, files
        for name in names:
            path = f"{rel}/{name}" if rel else name
            full = os.path.join(self.root, path)
            if os.path.isdir(full):
                folders.append(path)
            elif os.path.isfile(full):
                files.append(path)
        return folders, files

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = [_Part("", False)]
        for top in self._list("")[0]:
            if self._enters(top):
                out.append(_Part(top, False))
                out += [_Part(x, True) for x in self._list(top)[0] if self._enters(x)]
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            folders, files = self._list(todo.pop())
            for path in files:
                row = self._file(path)
                if row:
                    yield row
            if partition.deep:
                todo += [x for x in folders if self._enters(x)]

    def _file(self, path: str) -> tuple | None:
        name, full = os.path.basename(path), os.path.join(self.root, path)
        if name in SKIP_FILES or _extension(name) in SKIP_EXTENSIONS or self.rules.ignores(path, False):
            return None
        try:
            size = os.path.getsize(full)
            if not 1 <= size <= MAX_FILE_BYTES:
                return None
            with open(full, "rb") as f:
                raw = f.read()
        except OSError:
            return None
        if b"\0" in raw[:SNIFF_BYTES]:
            return None
        return path, size, raw.decode("utf-8", "replace")


class RepoFiles(DataSource):
    """spark.read.format("repo_files").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return "file_path string, size bigint, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def scan(spark: SparkSession, root: str, limit: int = MAX_FILES) -> DataFrame:
    """file_path, language, content and content_hash of a tree: source folders first, then in the order of a dictionary."""
    spark.dataSource.register(RepoFiles)
    found = spark.read.format("repo_files").load(root)
    own = found.where(~is_generated(F.col("content")) & ~is_minified(F.col("content")))
    ordered = own.orderBy(F.desc(priority(F.col("file_path"))), F.collate("file_path", "UNICODE"), "file_path").limit(limit)
    return ordered.select("file_path", language(F.col("file_path")).alias("language"), "content", content_hash(F.col("content")).alias("content_hash"))
