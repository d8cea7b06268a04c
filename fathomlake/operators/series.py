"""Time series of many symbols at once: revisions, marks, coverage, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the one that is last by ``order``: a partial aggregate, so nothing is sorted or gathered."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    top = F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("x")
    return df.groupBy(*keys).agg(top).select(*keys, "x.*").select(*df.columns)


def high_water_mark(df: DataFrame, key: str, date: str, default: str = "2000-01-01") -> DataFrame:
    return df.groupBy(key).agg(F.coalesce(F.max(date), F.lit(default).cast("date")).alias("mark"))


def latest_value(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The last value of each key by ``order``; one that is no number is null."""
    known = F.max_by(value, F.struct(*order))
    if dict(df.dtypes)[value] in ("double", "float"):
        known = F.nanvl(known, F.lit(None).cast(dict(df.dtypes)[value]))
    return df.groupBy(key).agg(known.alias(value), F.max(order[0]).alias(order[0]))


def latest_rates(df: DataFrame, order: list[str]) -> DataFrame:
    """``symbol, rate``: the last rate of each currency, and 1 for USD, whatever the loads say of it."""
    known = latest_value(df.where("symbol <> 'USD'"), "symbol", "rate", order).select("symbol", "rate")
    return known.union(df.sparkSession.range(1).select(F.lit("USD"), F.lit(1.0)))


def series_asc(df: DataFrame, key: str, date: str) -> DataFrame:
    return df.orderBy(key, date)


def newest(df: DataFrame, at: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` newest rows: each task keeps its own, and one takes the best of those."""
    return df.orderBy(F.desc(at), *ties).limit(n)


def union_loads(*loads: DataFrame) -> DataFrame:
    """Loads one after another, by column name; repeats stay, and columns that one of them lacks are null."""
    out = loads[0]
    for df in loads[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def point_in_time(df: DataFrame, keys: list[str], order: list[str], load: str, at: str) -> DataFrame:
    """The series as it was known at a time."""
    return latest_wins(df.where(F.col(load) <= F.lit(at).cast("timestamp_ntz")), keys, order)


def incremental(source: DataFrame, target: DataFrame, key: str, date: str) -> DataFrame:
    """Rows of ``source`` from each key's last date in ``target`` on, that day included; keys new to it whole."""
    marks = target.groupBy(key).agg(F.max(date).alias("mark"))
    return source.join(marks, key, "left").where(F.col("mark").isNull() | (F.col(date) >= F.col("mark"))).select(source.columns)


def series_coverage(df: DataFrame, key: str, date: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("n"))


def last_n(df: DataFrame, part: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*part).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def daily_returns(df: DataFrame, part: list[str], order: str, value: str) -> DataFrame:
    """``ret`` against the row before; none after a value that is not above 0."""
    before = F.lag(value).over(W.partitionBy(*part).orderBy(order))
    return df.withColumn("prev", before).where("prev > 0").withColumn("ret", F.col(value) / F.col("prev") - 1).drop("prev")


def max_drawdown(df: DataFrame, part: list[str], order: str, value: str) -> DataFrame:
    peak = F.max(value).over(W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    down = F.when(F.col("peak") > 0, (F.col(value) - F.col("peak")) / F.col("peak") * 100).otherwise(0.0)
    return df.withColumn("peak", peak).groupBy(*part).agg(F.min(down).alias("max_drawdown"))


def risk_metrics(returns: DataFrame, part: list[str], rf: float = 0.05) -> DataFrame:
    """Annualised volatility (percent), Sharpe and Sortino ratios of the returns of each group."""
    m, s = F.avg("ret"), F.stddev_pop("ret")
    down = F.sqrt(F.sum(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")).otherwise(0.0)) / F.count("ret"))
    out = returns.groupBy(*part).agg(m.alias("m"), s.alias("s"), down.alias("d"))
    year = F.sqrt(F.lit(252.0))
    excess = F.col("m") * 252 - rf
    return out.select(*part, (F.col("s") * year * 100).alias("volatility"), F.when(F.col("s") > 0, excess / (F.col("s") * year)).otherwise(0.0).alias("sharpe"), F.when(F.col("d") > 0, excess / (F.col("d") * year)).otherwise(9.99).alias("sortino"))


def beta_corr(pairs: DataFrame, part: list[str], a: str, b: str) -> DataFrame:
    """Beta of ``a`` on ``b`` (1 if ``b`` doesn't vary) and their correlation (0 if either doesn't)."""
    out = pairs.groupBy(*part).agg(F.covar_pop(a, b).alias("c"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"))
    return out.select(*part, F.when(F.col("vb") > 0, F.col("c") / F.col("vb")).otherwise(1.0).alias("beta"), F.when((F.col("va") > 0) & (F.col("vb") > 0), F.col("c") / F.sqrt(F.col("va") * F.col("vb"))).otherwise(0.0).alias("corr"))


def aligned_beta_corr(own: DataFrame, bench: DataFrame, part: list[str], date: str) -> DataFrame:
    """Beta and correlation of the returns ``own(*part, date, ret)`` with ``bench(date, ret)``.

    Null where a group hasn't as many returns as the benchmark, or on other days.
    """
    pairs = own.join(bench.select(date, F.col("ret").alias("_b")), date)
    counts = own.groupBy(*part).agg(F.count("ret").alias("_n")).join(pairs.groupBy(*part).agg(F.count("*").alias("_both")), part, "left")
    of_bench = bench.agg(F.count("ret").alias("_m"))
    found = counts.crossJoin(F.broadcast(of_bench)).join(beta_corr(pairs, part, "ret", "_b"), part, "left")
    same = (F.col("_n") == F.col("_m")) & (F.col("_both") == F.col("_m"))
    return found.select(*part, F.when(same, F.col("beta")).alias("beta"), F.when(same, F.col("corr")).alias("corr"))


def price_spikes(df: DataFrame, part: str, order: str, close: str, threshold: float = 0.5, split: str | None = None) -> DataFrame:
    """Rows whose close has changed by more than the threshold; ``split``: a column of split ratios, where null, 0 and 1 are
    none, that tells whether a change came ``with_split``."""
    if split is not None:
        df = df.withColumn("with_split", ~F.coalesce(F.col(split).isin(0, 1), F.lit(True)))
    before = F.lag(close).over(W.partitionBy(part).orderBy(order))
    return df.withColumn("prev", before).withColumn("change", F.try_divide(F.col(close) - F.col("prev"), F.col("prev"))).where(F.abs("change") > threshold)


def profile_history(df: DataFrame, key: str, at: list[str], digest: str) -> DataFrame:
    """Entries whose hash differs from the entry before; ``valid_to``: when the next begins."""
    w = W.partitionBy(key).orderBy(*at)
    new = df.withColumn("_p", F.lag(digest).over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col(digest))).drop("_p")
    return new.withColumn("valid_to", F.lead(at[0]).over(w))


def validate_ohlc(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that hold together and rows that don't; rows with a null among the five values are in neither."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    whole = df.dropna(subset=["open", "high", "low", "close", "volume"])
    good = (h >= lo) & o.between(lo - 1e-6, h + 1e-6) & c.between(lo - 1e-6, h + 1e-6) & (F.least(o, h, lo, c) >= 0) & (v >= 0)
    return whole.where(good), whole.where(~good)


def ohlc_average(df: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("open", "high", "low", "close")]
    return df.withColumn("avg_price", (parts[0] + parts[1] + parts[2] + parts[3]) / 4).where("avg_price > 0")


def enforce_ohlcv(df: DataFrame, source: str, ticker: str, load: Column) -> DataFrame:
    """Fixed columns and types; missing prices null, missing volume 0, bad numbers null, dates at midnight."""
    num = lambda c, t: F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)
    prices = [num(c, "float").alias(c) for c in ("open", "high", "low", "close")]
    return df.select(F.to_date("date").alias("date"), *prices, F.coalesce(num("volume", "long"), F.lit(0).cast("long")).alias("volume"), F.lit(ticker).alias("ticker"), F.lit(source).alias("source"), load.alias("load_timestamp"))


def normalize_fx(df: DataFrame, inverse: DataFrame, start: str) -> DataFrame:
    """Rates as 1 unit = X USD: pairs in ``inverse(symbol)`` are inverted, rows before ``start`` go; ``usd_rates`` has USD's."""
    flagged = df.join(inverse.withColumn("_i", F.lit(True)), "symbol", "left").where(F.col("date") >= F.lit(start).cast("date"))
    return flagged.withColumn("rate", F.when(F.col("_i"), F.try_divide(F.lit(1.0), F.col("rate"))).otherwise(F.col("rate"))).drop("_i")


def usd_rates(spark: SparkSession, start: str, end: str) -> DataFrame:
    """A row ``symbol, date, rate`` of 1 USD = 1 for every day of the range."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.lit("USD").alias("symbol"), F.explode(days).alias("date"), F.lit(1.0).alias("rate"))


def mixed_frequency(df: DataFrame, key: str, date: str, value: str, grid: DataFrame) -> DataFrame:
    """Every key on every date of ``grid(date)``, with its last value known by then."""
    full = df.select(key).distinct().crossJoin(grid).join(df, [key, date], "left")
    return full.withColumn(value, F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(date).rowsBetween(W.unboundedPreceding, 0)))


def yield_spread(df: DataFrame, date: str, long: str, short: str) -> DataFrame:
    at = df.groupBy(date).agg(F.max(F.when(F.col("symbol") == long, F.col("value"))).alias("long"), F.max(F.when(F.col("symbol") == short, F.col("value"))).alias("short"))
    return at.dropna().select(date, (F.col("long") - F.col("short")).alias("spread"), (F.col("long") < F.col("short")).alias("inverted"))


def benchmark_performance(df: DataFrame, key: str, date: str, close: str, asof: str, days: int = 365, rows: int = 260) -> DataFrame:
    """Change in percent over a year to ``asof``; of the last rows if the year has fewer than two, else 0."""
    ranked = df.where(F.col(close).isNotNull()).withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(F.desc(date))))
    year = F.col(date) >= F.date_sub(F.lit(asof).cast("date"), days)
    agg = ranked.groupBy(key).agg(F.count_if(year).alias("n"), *[f(F.when(c, F.col(close)), F.when(c, F.col(date))).alias(x) for x, f, c in (("y0", F.min_by, year), ("y1", F.max_by, year), ("r0", F.min_by, F.col("k") <= rows), ("r1", F.max_by, F.col("k") <= rows))])
    change = lambda a, b: F.coalesce((F.try_divide(F.col(b), F.col(a)) - 1) * 100, F.lit(0.0))
    return agg.select(key, F.when(F.col("n") >= 2, change("y0", "y1")).otherwise(change("r0", "r1")).alias("performance"))
