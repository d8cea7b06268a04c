"""What the corpus operators share: the shared folder, written cuts of lineage, and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Folders made here because the session names none (tests); by application.
_own: dict[str, str] = {}
_path: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: What has been written since each scope that is still open began: folders and tables; outside of all, results.
_scopes = threading.local()
_results: dict[str, list[str]] = {}


def one_machine(master: str) -> bool:
    """Whether driver and executors share a disk without a named folder."""
    return master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset.

    Our own is on the driver's disk, so a cluster has to name one.
    """
    if named := spark.conf.get("spark.checkpoint.dir", ""):
        return named
    if not one_machine(spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="fathomlake-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def _open() -> list[list[str]]:
    if not hasattr(_scopes, "held"):
        _scopes.held = []
    return _scopes.held


def _note(spark: SparkSession, name: str) -> None:
    (_open()[-1] if _open() else _results.setdefault(spark.sparkContext.applicationId, [])).append(name)


def _delete(spark: SparkSession, name: str) -> None:
    if "/" not in name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession, rows: int = 1000):
    """What is written inside goes at the end. Inside, Arrow batches hold no more than ``rows`` texts: by default they hold
    10,000, too much memory for long texts. The session's setting is put back."""
    before = spark.conf.get(BATCH_ROWS)
    _open().append([])
    spark.conf.set(BATCH_ROWS, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)
        discard(spark, _open().pop())


def written(operator):
    """The operator's result as a table written inside a scratch of its own, which alone stays; the next scope outside
    takes it over, or else ``release``."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **more) -> DataFrame:
        spark = docs.sparkSession
        with scratch(spark):
            out = cut(operator(docs, *args, **more), operator.__name__)
            _open()[-1].remove(_path[out])
        _note(spark, _path[out])
        return out

    return run


@contextmanager
def noted(spark: SparkSession):
    """The list of what is written inside and stays."""
    _open().append(names := [])
    try:
        yield names
    finally:
        _open().pop()


def discard(spark: SparkSession, names: list[str]) -> None:
    while names:
        _delete(spark, names.pop())


def release(spark: SparkSession) -> None:
    """Delete the results that operators have written in this application; call it when they have been used."""
    discard(spark, _results.pop(spark.sparkContext.applicationId, []))


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it: lineage ends here, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _note(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path[out] = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete cuts that nothing reads any more, before their scope ends."""
    for frame in frames:
        path = _path.pop(frame)
        for held in [*_open(), *_results.values()]:
            if path in held:
                held.remove(path)
        _delete(frame.sparkSession, path)


def bucketed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` as a table in buckets of ``column``, which joins and groups by that column read in place. Its files lie in the
    shared folder, not in the session's warehouse, which may be a folder of the driver alone."""
    spark = rows.sparkSession
    name = f"fathomlake_{uuid.uuid4().hex}"
    n = partitions(spark)
    path = f"{shared_dir(spark)}/{name}"
    _note(spark, name)
    _note(spark, path)
    rows.repartition(n, column).write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, column).saveAsTable(name)
    return spark.table(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df``, a table of one or two numbers a row, to be sent to all tasks if it has been counted to have ``rows`` at most
    (8 MB of numbers)."""
    return F.broadcast(df) if df.count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every vertex of ``edges(a, b)`` with the smallest vertex of its component: columns ``v, label``.

    Contraction: every vertex points to its smallest neighbour or itself, pointers are followed to their ends by doubling, and
    the links between different ends, each once, are the graph of the next round. So a link is joined to the ends once, and
    later rounds see only what is left; rounds and doublings follow the logarithm of the longest path. Each round ends in
    written tables. Null ends and loops link nothing.
    """
    links = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    while True:
        both = links.union(links.select("b", "a"))
        ends = _ends(cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low")).select("v", F.least("v", "low").alias("label")), "ends"))
        a, b = (ends.select(F.col("v").alias(c), F.col("label").alias(f"{c}_end")) for c in ("a", "b"))
        met = links.join(a, "a").join(b, "b").where("a_end <> b_end")
        after = cut(met.select(F.least("a_end", "b_end").alias("a"), F.greatest("a_end", "b_end").alias("b")).distinct(), "edges")
        if labels is None:
            labels = ends
        else:
            up = cut(labels.join(_renamed(ends), "label", "left").select("v", F.coalesce("up", "label").alias("label")), "labels")
            drop(labels, ends)
            labels = up
        drop(links)
        links = after
        if links.limit(1).count() == 0:
            drop(links)
            return labels.select("v", "label")


def _renamed(pointers: DataFrame) -> DataFrame:
    return pointers.select(F.col("v").alias("label"), F.col("label").alias("up"))


def _ends(pointers: DataFrame) -> DataFrame:
    """The end of each chain of ``pointers(v, label)``, all of which point to a row of the table; written anew at each doubling."""
    while True:
        after = cut(pointers.join(_renamed(pointers), "label").select("v", F.col("label").alias("old"), F.col("up").alias("label")), "ends")
        drop(pointers)
        pointers = after
        if pointers.where("label <> old").limit(1).count() == 0:
            return pointers
