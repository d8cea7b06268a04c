"""Keyed reads, filters and cleaned views of prices, universes and filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The exchanges of the US universe.
EXCHANGES = ["NASDAQ", "NYSE", "AMEX"]


def filter_forms(df: DataFrame, forms: list[str], since: str | None = None, form: str = "form_code", filed: str = "filed_date") -> DataFrame:
    kept = df.where(F.col(form).isin(forms))
    return kept if since is None else kept.where(F.col(filed) >= F.lit(since).cast("date"))


def filter_company(df: DataFrame, prefix: str, column: str = "edinet_code") -> DataFrame:
    return df.where(F.col(column).startswith(prefix))


def lookup(df: DataFrame, wanted: DataFrame, on: list[str], newest: list[str]) -> DataFrame:
    """Rows of the wanted keys, by key and the newest first; repeated keys in ``wanted`` repeat nothing."""
    return df.join(wanted.select(*on), on, "left_semi").orderBy(*on, *[F.desc(c) for c in newest])


def list_symbols(df: DataFrame, market: str | None = None, search: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of ``symbol, name, market`` by symbol; ``search`` is found in either text, in any case."""
    if market is not None:
        df = df.where(F.col("market") == market)
    if search is not None:
        found = lambda c: F.contains(F.lower(c), F.lit(search.lower()))
        df = df.where(found("symbol") | found("name"))
    return df.orderBy("symbol").offset(offset).limit(limit)


def query_lake(spark: SparkSession, sql: str, view: str, limit: int = 100) -> DataFrame:
    """``sql`` with ``{T}`` for the view's name; at most ``limit`` rows, as the interface promises."""
    return spark.sql(sql.replace("{T}", view)).limit(limit)


def prices_between(df: DataFrame, start: str, end: str, key: str = "ticker", date: str = "date", fallback: bool = True) -> DataFrame:
    """Rows with a close in the window; with ``fallback`` all rows with a close of the keys that have none there."""
    known = df.where("close is not null")
    inside = known.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return inside.unionByName(known.join(inside.select(key).distinct(), key, "left_anti")) if fallback else inside


def all_prices(index: DataFrame, crypto: DataFrame, stock: DataFrame) -> DataFrame:
    """One table of the three, with the ``source`` each row is from; columns that one of them lacks are null."""
    named = [df.withColumn("source", F.lit(n)) for n, df in (("index", index), ("crypto", crypto), ("stock", stock))]
    return named[0].unionByName(named[1], allowMissingColumns=True).unionByName(named[2], allowMissingColumns=True)


def clean_crypto(df: DataFrame) -> DataFrame:
    """Rows with a close above 0; other missing numbers are 0."""
    return df.dropna(subset=["close"]).na.fill(0).where("close > 0")


def enforce_macro(df: DataFrame, symbol: str, source: str, load: Column) -> DataFrame:
    """Fixed columns; days at midnight, values that aren't numbers null. Without a column date the first two are date and value."""
    names = {c.lower(): c for c in df.columns}
    date, value = (names["date"], names["value"]) if "date" in names else df.columns[:2]
    return df.select(F.to_date(date).alias("date"), F.lit(symbol).alias("symbol"), F.col(value).try_cast("double").alias("value"), F.lit(source).alias("source"), load.alias("load_timestamp"))


def clean_universe(df: DataFrame, exchanges: list[str] = EXCHANGES) -> DataFrame:
    """Distinct symbols of capital letters, points and hyphens on the exchanges, sorted."""
    return df.where(F.col("exchange").isin(exchanges) & F.col("symbol").rlike(r"^[A-Z.\-]+$")).select("symbol").distinct().orderBy("symbol")


def build_universe(*directories: DataFrame) -> DataFrame:
    out = directories[0].select("symbol")
    for d in directories[1:]:
        out = out.union(d.select("symbol"))
    return out.where("symbol is not null").distinct()


def union_statements(frames: list[tuple[DataFrame, str, str]]) -> dict[str, DataFrame]:
    """Frames as (rows, table, period type) to one frame a table, each row with its ``period_type``."""
    out: dict[str, DataFrame] = {}
    for df, table, period in frames:
        rows = df.withColumn("period_type", F.lit(period))
        out[table] = out[table].unionByName(rows, allowMissingColumns=True) if table in out else rows
    return out
