"""Joins, latest-of-group, numbering and change detection, as functions on DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Values of a change set that are tested in place.
FEW = 1000


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each group that is last in `order` (nulls first): an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Rows numbered from 1 within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def next_version(versions: DataFrame, key: str) -> DataFrame:
    """key, next_version: one more than the largest version, or 1."""
    return versions.groupBy(key).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("long").alias("next_version"))


def with_count(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Left rows with the number of right rows of their key, 0 for none."""
    counts = right.groupBy(key).agg(F.count("*").alias(name))
    return left.join(counts, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def last_of_group(df: DataFrame, key: Column, order: Sequence[str], count: str) -> DataFrame:
    """The row of each group that is last in `order` (nulls first), with the group's size: one aggregate."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(key.alias("_key")).agg(row, F.count("*").alias(count)).select("_row.*", count)


def changes_only(df: DataFrame, key: str, order: Sequence[str], watched: Sequence[str]) -> DataFrame:
    """Rows whose watched columns differ from those of the row before them in the group; the first row is a change."""
    now = F.struct(*watched)
    before = F.lag(now).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(now)).drop("_before")


def overlapping(df: DataFrame, array: str, key: Sequence[str], wanted: DataFrame, column: str) -> DataFrame:
    """Rows whose array shares a value with a column of another frame; null arrays share nothing. Up to FEW values are
    tested in place, without a shuffle."""
    few = [r[0] for r in wanted.select(column).where(F.col(column).isNotNull()).distinct().limit(FEW + 1).collect()]
    if len(few) <= FEW:
        values = F.array(*map(F.lit, few)).cast(df.schema[array].dataType)
        return df.where(F.coalesce(F.arrays_overlap(array, values), F.lit(False)))
    hit = df.select(*key, F.explode(array).alias(column)).join(wanted.select(column).distinct(), column, "left_semi").select(*key).distinct()
    return df.join(hit, list(key), "left_semi")


def suffixes(path: Column) -> Column:
    """All suffixes of a path at its slashes, the whole path first."""
    each = lambda p: F.transform(F.sequence(F.size(F.split(p, "/")), F.lit(1), F.lit(-1)), lambda i: F.call_function("substring_index", p, F.lit("/"), -i))
    return F.element_at(F.transform(F.array(path), each), 1)  # the path is made once, not for each of its suffixes


def valid_citations(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Citations (column path) with valid: they equal a file, its base name or a suffix of it at a slash. Files are
    expanded into their suffixes, which turns the suffix test into an equality join."""
    known = files.select(F.explode(suffixes(F.col("path"))).alias("path")).distinct().withColumn("_known", F.lit(True))
    return citations.join(known, "path", "left").withColumn("valid", F.coalesce("_known", F.lit(False))).drop("_known")


def longest_suffix(paths: DataFrame, files: DataFrame, key: Sequence[str], path: str, name: str) -> DataFrame:
    """Rows with the longest suffix of a path that is a file, null if none is."""
    own = paths.select(*key, F.posexplode(suffixes(F.regexp_replace(path, "^/+", ""))).alias("_pos", "_suffix"))
    hit = own.join(files.select(F.col("path").alias("_suffix")).distinct(), "_suffix")
    best = hit.groupBy(*key).agg(F.min_by("_suffix", "_pos").alias(name))
    return paths.join(best, list(key), "left")


def zero_filled(df: DataFrame, column: str, values: Sequence[str], name: str = "n") -> DataFrame:
    """Counts of each of the given values, 0 for those that don't occur; one aggregate, no join."""
    counts = df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    pairs = F.array(*[F.struct(F.lit(v).alias(column), F.col(v).alias(name)) for v in values])
    return counts.select(F.inline(pairs))
