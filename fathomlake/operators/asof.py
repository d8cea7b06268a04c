"""As-of joins by key: each row gets the last value of its key at or before its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str, tolerance_days: int | None = None, unit: str = "month", salts: int = 1) -> DataFrame:
    """``left`` with ``value`` and ``value_at`` of the last row of ``right(by, at, value)`` with the same key that isn't later.

    Both sides are put together and cut by key and time slice (``unit`` of ``date_trunc``); a window carries the last value
    through a slice. What a slice begins with is the last value of the key's slices before it, found on one row a key and slice,
    and enters it as a row of its own. So no task holds a whole key; where one slice of a key is too much still, ``salts``
    deals its rows of ``left`` to so many windows, each of which sees all its values.

    ``tolerance_days``: a value that is more days old counts as none. Null values, keys and times of ``right`` count as none;
    of several values at one time the greatest stays. Rows of ``left`` without key or time stay and get null; repeats stay.
    """
    slice_ = lambda c: F.date_trunc(unit, F.col(c))
    known = right.where(F.col(by).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(by).alias("_k"), F.col(at).alias("_t")).agg(F.max(value).alias("_v"))
    known = known.withColumn("_s", slice_("_t"))
    rows = left.select(F.col(by).alias("_k"), F.col(at).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row")).withColumn("_s", slice_("_t"))
    value_of = F.struct(F.col("_t").alias("at"), F.col("_v").alias("value"))
    none = F.lit(None).cast(_type(known.select(value_of.alias("x"))))

    last = known.groupBy("_k", "_s").agg(F.max_by(value_of, "_t").alias("_last"))
    asked = rows.groupBy("_k", "_s").agg(F.lit(True).alias("_asked"))
    before = W.partitionBy("_k").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    carried = last.join(asked, ["_k", "_s"], "full").withColumn("_x", F.last("_last", ignorenulls=True).over(before))
    carried = carried.where("_asked and _x is not null").select("_k", "_s", F.lit(None).cast(_type(known.select("_t"))).alias("_t"), F.lit(0).alias("_side"), "_x")

    offered = carried.unionByName(known.select("_k", "_s", "_t", F.lit(0).alias("_side"), value_of.alias("_x")))
    row_type = _type(rows.select("_row"))
    offered = offered.withColumn("_row", F.lit(None).cast(row_type)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asking = rows.select("_k", "_s", "_t", F.lit(1).alias("_side"), none.alias("_x"), "_row", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int").alias("_salt"))
    # A carried value has no time in its slice and comes first; at one time values come before the rows that ask.
    order = W.partitionBy("_k", "_s", "_salt").orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = offered.unionByName(asking).withColumn("_x", F.last("_x", ignorenulls=True).over(order)).where("_side = 1")
    found = F.col("_x")
    if tolerance_days is not None:
        found = F.when(F.datediff(F.to_date("_t"), F.to_date("_x.at")) <= tolerance_days, found)
    return seen.select("_row.*", found["value"].alias(value), found["at"].alias(f"{value}_at"))


def _type(one: DataFrame):
    return one.schema[0].dataType


def convert_historical(df: DataFrame, history: DataFrame, value: Column | str, target: str, at: str, tolerance_days: int | None = None, unit: str = "month") -> DataFrame:
    """``converted``: ``value`` from the row's ``currency`` into ``target`` at the rates to USD of its day, from ``history(symbol,
    date, rate)``; USD is 1, and so is a rate that is missing, zero or too old. ``rate``: that of the row's currency, or null."""
    rates = history.where("symbol <> 'USD' and rate <> 0").select(F.col("symbol").alias("_currency"), F.col("date").cast("date").alias("_day"), "rate")
    value = F.col(value) if isinstance(value, str) else value
    asked = df.withColumns({"_currency": F.coalesce("currency", F.lit("USD")), "_day": F.to_date(at), "_value": value})
    out = asof_join(asked, rates, "_currency", "_day", "rate", tolerance_days, unit)
    to = F.lit(1.0)
    if target != "USD":
        # One row for each day that is asked for.
        days = asked.select("_day").distinct().withColumn("_currency", F.lit(target))
        shown = asof_join(days, rates, "_currency", "_day", "rate", tolerance_days, unit).select("_day", F.col("rate").alias("_to"))
        out, to = out.join(shown, "_day", "left"), F.coalesce("_to", F.lit(1.0))
    converted = F.col("_value") * F.coalesce("rate", F.lit(1.0)) / to
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "rate", converted.alias("converted"))
