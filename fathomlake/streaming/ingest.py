"""Incremental ingest with Structured Streaming: keyed writes, outcome logs, and the ledger of dates.

A keyed write appends each micro-batch in a folder of its own and settles keys on reading, so that a flush costs what it
brings, not what is there. A batch that is tried again overwrites its own folder, which makes the writes idempotent.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.filings import apply_contract, missing_dates
from ..operators.series import latest_wins

_log = logging.getLogger(__name__)


def stream_upsert(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Write all that is there to ``target``; of rows of a key in one micro-batch the last by ``order`` stays."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_wins(batch, keys, order).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last write of every key."""
    return latest_wins(spark.read.parquet(target), keys, ["batch_id"]).drop("batch_id")


def compact(spark: SparkSession, target: str, keys: list[str], to: str) -> DataFrame:
    """The settled rows as one batch in a new place, from which readers and later compactions go on."""
    read_upserted(spark, target, keys).write.mode("overwrite").parquet(f"{to}/batch_id=-1")
    return read_upserted(spark, to, keys)


def outcomes(rows: DataFrame, rules: dict[str, str], key: str) -> DataFrame:
    """``key, status, n_ok, n_rejected``: SUCCESS without rejects, FAILED with nothing else, PARTIAL_FAIL between."""
    ok, bad = apply_contract(rows, rules)
    both = ok.select(key, F.lit(0).alias("r")).unionByName(bad.select(key, F.lit(1).alias("r")))
    counts = both.groupBy(key).agg(F.count_if(F.col("r") == 0).alias("n_ok"), F.count_if(F.col("r") == 1).alias("n_rejected"))
    return counts.withColumn("status", _status())


def _status() -> Column:
    return F.when(F.col("n_rejected") == 0, "SUCCESS").when(F.col("n_ok") == 0, "FAILED").otherwise("PARTIAL_FAIL")


def stream_ingest(stream: DataFrame, root: str, rules: dict[str, str], key: str, checkpoint: str) -> StreamingQuery:
    """Rows that meet the contract to ``root/accepted``, the others with reasons to ``root/rejects``, and a log entry for
    every document to ``root/log``. A bad row never fails the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ok, bad = apply_contract(batch, rules)
        for name, df in (("accepted", ok), ("rejects", bad), ("log", outcomes(batch, rules, key))):
            df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_outcomes(stream: DataFrame, root: str, rules: dict[str, str], key: str, checkpoint: str) -> StreamingQuery:
    """Keep the outcome of every document over all micro-batches in ``root/outcomes``, whichever batches its rows come in.

    The counts of a document are state of the query, restored from the checkpoint after a restart; each batch writes the
    documents whose counts it has changed, in a folder of its own, and ``read_outcomes`` settles them.
    """
    met = F.lit(True)
    for rule in rules.values():
        met = met & F.coalesce(F.expr(rule), F.lit(False))
    counts = stream.select(key, met.alias("ok")).groupBy(key).agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_rejected"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("status", _status()).write.mode("overwrite").parquet(f"{root}/outcomes/batch_id={batch_id}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_outcomes(spark: SparkSession, root: str, key: str) -> DataFrame:
    """``key, n_ok, n_rejected, status``: one row a document, as its last batch left it."""
    return latest_wins(spark.read.parquet(f"{root}/outcomes"), [key], ["batch_id"]).drop("batch_id")


def due_chunks(ledger: DataFrame, end: str, days: int = 1825, size: int = 7) -> DataFrame:
    """``date, chunk``: days without a completed entry, newest first, in chunks of ``size``. The calendar has ``days`` rows."""
    done = ledger.where("status = 'COMPLETED'").select("date")
    place = F.row_number().over(W.orderBy(F.desc("date")))
    return missing_dates(done, end, days).withColumn("chunk", F.floor((place - 1) / size).cast("int"))


def mark_completed(ledger: DataFrame, dates: DataFrame) -> DataFrame:
    """The ledger after a chunk succeeded: ``dates(date, doc_count)`` are completed, what failed stays due."""
    new = dates.select("date", F.lit("COMPLETED").alias("status"), F.col("doc_count").cast("long").alias("doc_count"))
    return new.unionByName(ledger.select("date", "status", F.col("doc_count").cast("long").alias("doc_count")).join(new, "date", "left_anti"))


_LEDGER = "date date, status string, doc_count long"


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """``date, status, doc_count`` of the days that are marked; none where no chunk has been loaded."""
    try:
        return spark.read.schema(_LEDGER).parquet(f"{root}/ledger").select("date", "status", "doc_count")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def load_due(spark: SparkSession, root: str, load: Callable[[list[date]], DataFrame], end: str, days: int = 1825, size: int = 7, most: int | None = None) -> list[date]:
    """Load the days that are due, the newest first, in chunks of ``size``; ``most``: chunks of this call. The days that are done.

    ``load`` gives the rows of some days, with a column ``date``. A chunk's rows replace those of its days in ``root/data``, one
    folder a day, and then its days are marked in the ledger, in a folder named by the chunk's last day; days without rows are marked
    too, and rows of other days are left out. A chunk that fails stays due, the next ones are tried all the same, and loading a
    chunk again changes nothing.
    """
    due = due_chunks(read_ledger(spark, root), end, days, size).collect()  # days of the calendar
    chunks: dict[int, list[date]] = {}
    for row in due:
        chunks.setdefault(row.chunk, []).append(row.date)
    done = []
    for chunk in [chunks[k] for k in sorted(chunks)][:most]:
        try:
            wanted = spark.createDataFrame([(d,) for d in chunk], "date date")
            rows = load(chunk).withColumn("date", F.col("date").cast("date")).join(F.broadcast(wanted), "date", "left_semi")
            rows.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{root}/data")
            counted = spark.read.schema(rows.schema).parquet(f"{root}/data").where(F.col("date").isin(chunk)).groupBy("date").agg(F.count("*").alias("n"))
            marks = wanted.join(counted, "date", "left").select("date", F.lit("COMPLETED").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("doc_count"))
            marks.coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/chunk={max(chunk)}")
            done += chunk
        except ImportError:
            raise
        except Exception:
            _log.exception("days up to %s stay due", max(chunk))
    return done
