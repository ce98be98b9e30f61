"""Helpers that the training-data operators share: session set-up, shared storage, word hashing on Arrow buffers."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows in an Arrow batch: long texts make the default of 10,000 too large for a worker's memory.
ARROW_ROWS = 512

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches and let executors import this package wherever the driver runs."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    folder = Path(tempfile.mkdtemp(prefix="quillspark-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    (folder / "quillspark_code.zip").write_bytes(blob.getvalue())
    sc.addPyFile(str(folder / "quillspark_code.zip"))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only on a local master, where it is unset, a folder of
    our own; on a cluster a machine's own folder would be lost with it, so there it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if spark.sparkContext.applicationId not in _own_dirs:
            _own_dirs[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="quillspark-shared-")
            atexit.register(shutil.rmtree, _own_dirs[spark.sparkContext.applicationId], ignore_errors=True)
        folder = _own_dirs[spark.sparkContext.applicationId]
    return folder.rstrip("/")


def remove(spark: SparkSession, text: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


SHARED = "shared-ids"


class Scope:
    """The folders that stored() made while the scope was open; drop() removes them, but for those of kept frames, which
    are stored ones themselves, and then the shared ids that keyed() rows need."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def drop(self, *keep: DataFrame) -> None:
        kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in keep for f in df.inputFiles()}
        kept |= {x.rsplit("/", 1)[-1] for x in self.paths if keep and x.rsplit("/", 1)[-1].startswith(SHARED)}
        for text in self.paths:
            if text.rsplit("/", 1)[-1] not in kept:
                remove(self.spark, text)
        self.paths = [x for x in self.paths if x.rsplit("/", 1)[-1] in kept]


#: The open scopes of this thread of work.
_scopes: ContextVar[tuple[Scope, ...]] = ContextVar("scopes", default=())


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Within it, stored() notes its folders; what an inner scope has left belongs to the outer one."""
    own, outer = Scope(spark), _scopes.get()
    mark = _scopes.set((*outer, own))
    try:
        yield own
    finally:
        _scopes.reset(mark)
        if outer:
            outer[-1].paths += own.paths


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: this cuts the lineage and outlives any executor. What no scope
    removes goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _scopes.get():
        _scopes.get()[-1].paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: The sign bit, which marks the keys of rows without an id of their own.
_ODD = -(1 << 63)
#: Shared ids that are broadcast at most.
BROADCAST_IDS = 2_000_000


def shared_ids(docs: DataFrame) -> DataFrame | None:
    """doc_id of the rows whose id is null or not theirs alone; None if every row has an id of its own."""
    found = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), SHARED)
    return found if found.limit(1).count() else None


def keyed(docs: DataFrame, key: str, shared: DataFrame | None, *more: str) -> DataFrame:
    """The rows with a long `key` by which they can be found again: the doc_id where it is the row's own; where it is null
    or shared, a negative hash of the doc_id, the text and the columns `more`, so that only repeated rows share a key."""
    own = F.col("doc_id").cast("long")
    if shared is None:
        return docs.withColumn(key, own)
    marked = shared.where("doc_id IS NOT NULL").select(F.col("doc_id").alias(f"{key}_id"))
    marked = F.broadcast(marked) if small_enough(marked, BROADCAST_IDS) else marked
    other = F.xxhash64("doc_id", "text", *more).bitwiseOR(F.lit(_ODD))
    both = docs.join(marked, F.col("doc_id") == F.col(f"{key}_id"), "left")
    odd = F.col("doc_id").isNull() | F.col(f"{key}_id").isNotNull()
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(odd, other).otherwise(own).alias(key))


def fresh(docs: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column has."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if `df` has at most `rows` rows; reads no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows


# ---- words of Arrow string columns, as numpy ----

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes of text that are hashed together at most, if no single text is longer.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) <= n:
        m = 1 << max(16, n.bit_length())
        a, b = np.full(m, base), np.full(m, np.uint64(pow(int(base), -1, 1 << 64)))
        a[0] = b[0] = 1
        have = _powers[int(base)] = (np.multiply.accumulate(a), np.multiply.accumulate(b))
    return have


def texts(column: pa.Array, chunk: int = CHUNK):
    """(first row, offsets, bytes) of runs of rows with about `chunk` bytes; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + chunk, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, offs[lo : hi + 1] - offs[lo], data[offs[lo] : offs[hi]]
        lo = hi


def words(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each text the number of its first word, with the total last."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ok = ~_SPACES[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], ok[:-1])) & ~edge[:-1]
    after = np.concatenate((ok[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(ok & ~before), np.flatnonzero(ok & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(_P, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _Q)


def window_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every k consecutive word hashes; the caller leaves out those that cross a text's end."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _power(_Q, n + 1)
    total = np.zeros(n + 1, np.uint64)
    salted = mix(hashes + np.uint64(seed)) if seed else hashes
    np.cumsum(salted * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def inside(first: np.ndarray, k: int, n_windows: int) -> np.ndarray:
    """Which windows of k words lie within one text."""
    ok = np.ones(n_windows, bool)
    for b in first[1:-1]:
        ok[max(0, b - k + 1) : b] = False
    return ok


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def let(value, body):
    """`body` of `value`, which is evaluated once: an optimizer that inlines aliases can't move it into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text):
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
