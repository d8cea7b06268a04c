"""Tables that change: whole versions behind a pointer, and rewrites of the partitions that a batch touches.

A versioned table is a folder with one folder of data for each version and a log of commits, a row each. A version is written
first and committed last, by adding one small file to the log, so a reader sees the old one or the new one and a crash before the
commit leaves the old one. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.filings import upsert
from ..operators.series import latest_wins

_COMMIT = "version long, folder string"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """``version, folder`` of all commits; no rows where nothing has been committed."""
    try:
        return spark.read.schema(_COMMIT).parquet(f"{root}/_commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMIT)


def _current(spark: SparkSession, root: str):
    return versions(spark, root).agg(F.max(F.struct("version", "folder")).alias("x")).first().x


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the last commit. A frame that was read before a later commit goes on reading its own version."""
    last = _current(spark, root)
    if last is None:
        raise FileNotFoundError(f"{root}: nothing has been committed")
    return spark.read.parquet(f"{root}/{last.folder}")


def stage_version(df: DataFrame, root: str) -> str:
    """Write ``df`` as a version that no reader sees yet; its folder."""
    folder = f"data-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root}/{folder}")
    return folder


def commit_version(spark: SparkSession, root: str, folder: str) -> int:
    """Make a staged version the current one."""
    last = _current(spark, root)
    version = 0 if last is None else last.version + 1
    spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder")).coalesce(1).write.mode("append").parquet(f"{root}/_commits")
    return version


def publish(df: DataFrame, root: str) -> int:
    """``df`` as the new version of the table; it may be read from the old one."""
    return commit_version(df.sparkSession, root, stage_version(df, root))


def compact_current(spark: SparkSession, root: str, keys: list[str], order: list[str]) -> int:
    """Of the rows of each key the last by ``order``, as the new version."""
    return publish(latest_wins(read_current(spark, root), keys, order), root)


# ---- partitions -----------------------------------------------------------------------------------------------------


def bucket_of(keys: list[str], buckets: int):
    """The partition of a key in tables that have none of their own."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def _replace(merged: DataFrame, path: str, by: list[str]) -> None:
    """Write the partitions of ``merged`` in place of those of the same values. They are written beside the table first, since the
    rows come from the partitions that go, so a crash at any point is mended by merging the same batch once more."""
    spark = merged.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    merged.write.parquet(staged)
    rows = spark.read.schema(merged.schema).parquet(staged)
    rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(staged)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _touched(spark: SparkSession, path: str, batch: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the partitions that ``batch`` has rows of; the others' files aren't opened. The driver gets the partitions' names,
    null being one."""
    table = spark.read.schema(batch.schema).option("basePath", path).parquet(path)
    names = batch.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
    values = names.collect()
    for k, c in enumerate(by):  # conditions on partition columns choose the folders before the job starts
        known = [r[k] for r in values if r[k] is not None]
        table = table.where(F.col(c).isin(known) | F.col(c).isNull() if len(known) < len(values) else F.col(c).isin(known))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return table.join(F.broadcast(names), same, "left_semi").select(batch.columns)


def upsert_partitions(batch: DataFrame, path: str, keys: list[str], by: list[str]) -> None:
    """Upsert ``batch``, which has a key once, into the table at ``path`` that is partitioned by ``by``; a key lies in one partition.

    Only the partitions that the batch touches are read and written; all other files stay as they are. A table that isn't there yet
    is made; a null is a partition of its own.
    """
    _merge(batch, path, by, lambda old: upsert(old, batch, keys))


def replace_day_partitions(batch: DataFrame, path: str, keys: list[str], by: list[str]) -> None:
    """``batch`` in place of all rows of its ``keys``, which may repeat on either side; otherwise as ``upsert_partitions``."""
    _merge(batch, path, by, lambda old: old.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch))


def _merge(batch: DataFrame, path: str, by: list[str], merge) -> None:
    try:
        merged = merge(_touched(batch.sparkSession, path, batch, by))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        merged = batch
    _replace(merged, path, by)
