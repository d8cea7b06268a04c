"""Allocation against targets, and plans that rebalance without selling, for all accounts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def category_drift(holdings: DataFrame, targets: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Total, target, drift and status of every target category of every account. ``targets`` is small: a row a category."""
    sums = holdings.groupBy("account_id", "category").agg(F.sum("value").alias("current"))
    grid = sums.select("account_id").distinct().crossJoin(F.broadcast(targets))
    full = grid.join(sums, ["account_id", "category"], "left").withColumn("current", F.coalesce("current", F.lit(0.0)))
    return with_drift(full, threshold)


def with_drift(grid: DataFrame, threshold: float = 0.02) -> DataFrame:
    """``grid(account_id, category, ratio, current)``, a row for each account and target category, with total, target, drift and status.
    Sums of doubles depend on their order, so the total is taken in the order of the categories."""
    whole = W.partitionBy("account_id").orderBy("category").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    full = grid.withColumn("total", F.sum("current").over(whole))
    share = F.coalesce(F.try_divide("current", "total"), F.lit(0.0)) - F.col("ratio")
    status = F.when(share > threshold, "OVER").when(share < -threshold, "UNDER").otherwise("OK")
    return full.withColumn("target", F.col("total") * F.col("ratio")).withColumn("drift", F.col("current") - F.col("target")).withColumn("drift_ratio", share).withColumn("status", status)


def drift_counts(drift: DataFrame) -> DataFrame:
    return drift.groupBy("account_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OK", "OVER", "UNDER")])


def invalid_targets(targets: DataFrame) -> DataFrame:
    return targets.groupBy("account_id").agg(F.sum("ratio").alias("total")).where(F.abs(F.col("total") - 1) > 0.0001)


def rebalance_plan(drift: DataFrame) -> DataFrame:
    """The least new total at which no category but cash has to be sold, and what to buy of each."""
    w = W.partitionBy("account_id")
    floor = F.max(F.when((F.col("category") != "CASH") & (F.col("ratio") > 0), F.col("current") / F.col("ratio"))).over(w)
    out = drift.withColumn("new_total", F.greatest(F.coalesce(floor, F.lit(0.0)), F.col("total")))
    buy = F.greatest(F.col("new_total") * F.col("ratio") - F.col("current"), F.lit(0.0))
    return out.withColumn("buy", F.when(buy > 0.01, buy).otherwise(0.0)).withColumn("investment", F.col("new_total") - F.col("total"))


def split_buys(plan: DataFrame, holdings: DataFrame) -> DataFrame:
    """A category's purchase over its assets by their share, or equally where the category is empty."""
    w = W.partitionBy("account_id", "category")
    shares = holdings.withColumn("s", F.sum("value").over(w)).withColumn("n", F.count("*").over(w))
    shares = shares.withColumn("share", F.when(F.col("s") > 0, F.col("value") / F.col("s")).otherwise(1.0 / F.col("n")))
    return shares.join(plan.where("buy > 0").select("account_id", "category", "buy"), ["account_id", "category"]).withColumn("asset_buy", F.col("buy") * F.col("share"))


def asset_results(inputs: DataFrame, config: DataFrame) -> DataFrame:
    """Wide inputs, an account a row and an asset a column, to ``account_id, asset, category, value``; accounts of zeros go.

    ``config(asset, category)`` has a row for each asset; columns it doesn't name are left out.
    """
    assets = [c for c in inputs.columns if c != "account_id"]
    worth = inputs.na.fill(0.0, assets).where(" or ".join(f"`{c}` > 0" for c in assets))
    long = worth.select("account_id", *[F.col(c).cast("double").alias(c) for c in assets]).unpivot("account_id", assets, "asset", "value")
    return long.join(F.broadcast(config), "asset").select("account_id", "asset", "category", "value")


def targets(defaults: DataFrame, overrides: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each account's ratio of every category: its own where it has one, else the default. ``defaults``: a row a category."""
    own = overrides.select("account_id", "category", F.col("ratio").alias("_o"))
    grid = accounts.select("account_id").distinct().crossJoin(F.broadcast(defaults.select("category", "ratio")))
    return grid.join(own, ["account_id", "category"], "left").select("account_id", "category", F.coalesce("_o", "ratio").alias("ratio"))
