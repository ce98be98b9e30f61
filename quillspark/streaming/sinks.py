"""An append-only table that takes each batch of a stream once, for foreachBatch."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = re.compile(r"(batch|upto)=(\d+)")


class BatchTable:
    """A folder with one subfolder for each batch of a stream. A batch counts once Spark has committed its write there (its
    _SUCCESS is the last file): a batch that the stream sends again, since it ended between output and commit, changes
    nothing, and what a broken write has left is written anew. Batches up to a number can be merged into one.

    One stream writes a table; it is tied to the stream's checkpoint, which numbers the batches."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _found(self) -> dict[tuple[str, int], str]:
        """The folders of committed writes."""
        top = self._path(self.folder)
        fs, out = self._fs(top), {}
        for s in fs.listStatus(top) if fs.exists(top) else []:
            at = s.getPath()
            if (m := _BATCH.fullmatch(at.getName())) and fs.exists(self._path(at, "_SUCCESS")):
                out[m[1], int(m[2])] = str(at)
        return out

    def merged(self) -> int:
        """The last batch that was merged, or -1."""
        return max((n for kind, n in self._found() if kind == "upto"), default=-1)

    def batches(self) -> list[int]:
        """The batches that count and aren't merged."""
        found = self._found()
        return sorted(n for kind, n in found if kind == "batch" and n > self.merged())

    def __call__(self, df: DataFrame, batch: int) -> None:
        """What foreachBatch is given."""
        found = self._found()
        if ("batch", batch) in found or any(kind == "upto" and n >= batch for kind, n in found):
            df.write.format("noop").mode("overwrite").save()  # operators with state still have to commit theirs
            return
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def read(self, after: int = -1) -> DataFrame:
        """The rows, with `batch`, of all batches or those after one: a listener that was cut off goes on from its last."""
        found, merged = self._found(), self.merged()
        paths = [p for (kind, n), p in found.items() if (kind == "batch" and n > max(after, merged)) or (kind == "upto" and n == merged > after)]
        schema = f"{self.schema}, batch long"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.where(F.col("batch") > after)

    def merge(self) -> None:
        """All batches so far as one; readers see the old ones until the new one is whole."""
        own, before = self.batches(), self.merged()
        if not own:
            return
        self.read().write.mode("overwrite").parquet(f"{self.folder}/upto={own[-1]}")
        for name in [f"batch={n}" for n in own] + ([f"upto={before}"] if before >= 0 else []):
            at = self._path(f"{self.folder}/{name}")
            self._fs(at).delete(at, True)


def written_once(stream: DataFrame, table: BatchTable, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, **trigger):
    """Start a stream into the table; `then` hears of each batch after it is written, again if a batch is sent again."""

    def take(df: DataFrame, batch: int) -> None:
        table(df, batch)
        if then is not None:
            then(df, batch)

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(**trigger) if trigger else writer).start()
