"""What is to be fetched again: existence flags and due times, for all symbols or documents at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _flag(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    return df.join(other.select(key).distinct().withColumn(name, F.lit(True)), key, "left").na.fill(False, [name])


def has_statements(df: DataFrame, statements: DataFrame, key: str) -> DataFrame:
    return _flag(df, statements, key, "has_statements")


def sync_need(candidates: DataFrame, filings: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``full_sync``: not among the filings; ``facts_repair``: among them, but without facts."""
    both = _flag(_flag(candidates, filings, key, "_filed"), facts, key, "_facts")
    return both.withColumn("full_sync", ~F.col("_filed")).withColumn("facts_repair", F.col("_filed") & ~F.col("_facts")).drop("_filed", "_facts")


def due_for_sync(symbols: DataFrame, status: DataFrame, now: str, force: bool = False) -> DataFrame:
    """Symbols that didn't succeed in the last 24 hours or fail in the last five minutes; all if forced."""
    if force:
        return symbols
    at = F.lit(now).cast("timestamp_ntz")
    recent = lambda state, span: (F.col("last_status") == state) & (F.col("last_sync_at") > at - F.expr(f"INTERVAL {span}"))
    fresh = F.coalesce(recent("SUCCESS", "24 HOUR") | recent("FAILED", "5 MINUTE"), F.lit(False))
    return symbols.join(status.select("ticker", "last_status", "last_sync_at"), "ticker", "left").where(~fresh).select(symbols.columns)
