"""Portfolios of all accounts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .asof import convert_historical


def positions(tx: DataFrame) -> DataFrame:
    """Held quantity and average cost (buying fees included) by account, ticker, asset type and currency; one pass."""
    buy, sell = F.col("type") == "BUY", F.col("type") == "SELL"
    base = tx.withColumn("currency", F.coalesce("currency", F.lit("USD")))
    q = base.groupBy("account_id", "ticker", "asset_type", "currency").agg(F.sum(F.when(buy, F.col("quantity"))).alias("bought"), F.sum(F.when(buy, F.col("quantity") * F.col("price") + F.col("fee"))).alias("cost"), F.coalesce(F.sum(F.when(sell, F.col("quantity"))), F.lit(0.0)).alias("sold"))
    return q.where("bought - sold > 0").select("account_id", "ticker", "asset_type", "currency", (F.col("bought") - F.col("sold")).alias("quantity"), F.try_divide("cost", "bought").alias("avg_price"))


def attach_price(pos: DataFrame, latest: DataFrame) -> DataFrame:
    """The latest price, or the average cost where there is none or it is 0.

    ``latest`` has a row for each ticker of the market and goes to all tasks; dealt by ticker, the positions would meet in a few.
    """
    return pos.join(F.broadcast(latest.select("ticker", F.col("close").alias("_p"))), "ticker", "left").withColumn("price", F.coalesce(F.nullif("_p", F.lit(0.0)), "avg_price")).drop("_p")


def convert_currency(df: DataFrame, fx: DataFrame, value: str, target: str) -> DataFrame:
    """``value`` from its currency by way of USD into ``target``; a missing or zero rate counts as 1.

    ``fx`` has a row for each currency and goes to all tasks; dealt by currency, the rows would meet in a few."""
    rates = fx.select(F.col("symbol").alias("currency"), F.nullif("rate", F.lit(0.0)).alias("_r"))
    to = fx.where(F.col("symbol") == target).agg(F.coalesce(F.nullif(F.max("rate"), F.lit(0.0)), F.lit(1.0)).alias("_t"))
    return df.join(F.broadcast(rates), "currency", "left").crossJoin(F.broadcast(to)).withColumn("converted", F.col(value) * F.coalesce("_r", F.lit(1.0)) / F.col("_t")).drop("_r", "_t")


def asof_price(tx: DataFrame, px: DataFrame, tolerance_days: int = 5) -> DataFrame:
    """``px(date, price)`` of the trade date or the nearest day before it within the tolerance; 0 counts as missing.

    Trades join their day by equality, so the join never loops, and no row needs an id; the days, one row each, go to all tasks.
    """
    return tx.join(F.broadcast(_near(px, tolerance_days)), F.to_date(tx["timestamp"]) == F.col("_day")).drop("_day")


def _near(px: DataFrame, tolerance_days: int) -> DataFrame:
    """``_day, asof_price``: every price is offered to the days that can still see it and the nearest stays, once for each day."""
    known = px.where("price > 0").select(F.col("date").alias("_d"), F.col("price").alias("_p"))
    offered = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(tolerance_days))).alias("_o")).select(F.date_add("_d", F.col("_o")).alias("_day"), "_o", "_p")
    return offered.groupBy("_day").agg(F.min_by("_p", F.struct("_o", "_p")).alias("asof_price"))


def shadow_benchmark(tx: DataFrame, px: DataFrame, fx: DataFrame, by: list[str], historical_fx: bool = False, tolerance_days: int | None = None) -> DataFrame:
    """What the invested money would hold of the benchmark: units and USD cost; buys without a price in reach are left out.

    Rates are today's, ``fx(symbol, rate)``; with ``historical_fx`` those of the day of each buy, from ``fx(symbol, date, rate)``.
    """
    buys = tx.where("type = 'BUY'").withColumn("currency", F.coalesce("currency", F.lit("USD"))).withColumn("amount", F.col("quantity") * F.col("price"))
    usd = convert_historical(buys, fx, "amount", "USD", "timestamp", tolerance_days) if historical_fx else convert_currency(buys, fx, "amount", "USD")
    return asof_price(usd, px).groupBy(*by).agg(F.sum("converted").alias("shadow_cost"), F.sum(F.col("converted") / F.col("asof_price")).alias("shadow_units"))


def alpha_metrics(df: DataFrame) -> DataFrame:
    """Returns of portfolio and benchmark, and alpha, from columns pmv, pcost, bmv, bcost."""
    r = lambda v, c: F.when(F.col(c) > 0, (F.col(v) - F.col(c)) / F.col(c) * 100).otherwise(0.0)
    out = df.withColumn("p_ret", r("pmv", "pcost")).withColumn("b_ret", r("bmv", "bcost"))
    return out.withColumn("alpha_pct", F.when((F.col("bmv") > 0) & (F.col("pcost") > 0), (F.col("pmv") / F.col("bmv") - 1) * 100).otherwise(F.col("p_ret") - F.col("b_ret"))).withColumn("alpha_value", F.col("pmv") - F.col("bmv"))


def account_totals(tx: DataFrame, latest: DataFrame, px: DataFrame, fx: DataFrame, tolerance_days: int = 5) -> DataFrame:
    """``account_id, pmv, pcost, bcost, units``: USD value and cost of what is held, and what the buys would have cost and
    hold of the benchmark ``px``; accounts with holdings and with a buy that has a price in reach.

    Positions, cost basis and shadow come from one pass over the transactions: sums by position, then by ticker, then by
    account, each of which goes on from the keys of the one before.
    """
    buy, sell = F.col("type") == "BUY", F.col("type") == "SELL"
    amount = F.when(buy, F.col("quantity") * F.col("price"))
    usd = convert_currency(tx.withColumn("currency", F.coalesce("currency", F.lit("USD"))).withColumn("amount", amount), fx, "amount", "USD")
    seen = usd.join(F.broadcast(_near(px, tolerance_days)), F.to_date(usd["timestamp"]) == F.col("_day"), "left")
    pos = seen.groupBy("account_id", "ticker", "asset_type", "currency").agg(
        F.sum(F.when(buy, F.col("quantity"))).alias("bought"), F.sum(F.col("amount") + F.col("fee")).alias("cost"), F.coalesce(F.sum(F.when(sell, F.col("quantity"))), F.lit(0.0)).alias("sold"),
        F.sum("converted").alias("usd"), F.sum(F.when(F.col("asof_price").isNotNull(), F.col("converted"))).alias("bcost"), F.sum(F.col("converted") / F.col("asof_price")).alias("units"))
    pos = pos.withColumn("held", F.when(F.col("bought") > F.col("sold"), F.col("bought") - F.col("sold"))).withColumn("avg_price", F.try_divide("cost", "bought"))
    valued = convert_currency(attach_price(pos, latest).withColumn("value", F.col("held") * F.col("price")), fx, "value", "USD")
    sums = [F.sum(c).alias(c) for c in ("held", "bought", "usd", "converted", "bcost", "units")]
    by_ticker = valued.groupBy("account_id", "ticker").agg(*sums)
    out = by_ticker.groupBy("account_id").agg(F.sum("converted").alias("pmv"), F.sum(F.col("held") * F.try_divide("usd", "bought")).alias("pcost"), F.sum("bcost").alias("bcost"), F.sum("units").alias("units"))
    return out.where("pmv is not null and pcost is not null and bcost is not null")


def cost_basis_usd(tx: DataFrame, pos: DataFrame, fx: DataFrame) -> DataFrame:
    """USD cost of what is held: the average buying price (no fees) of the account's ticker, times the held quantity."""
    buys = tx.where("type = 'BUY'").withColumn("currency", F.coalesce("currency", F.lit("USD"))).withColumn("amount", F.col("quantity") * F.col("price"))
    avg = convert_currency(buys, fx, "amount", "USD").groupBy("account_id", "ticker").agg((F.sum("converted") / F.sum("quantity")).alias("unit_cost"))
    held = pos.groupBy("account_id", "ticker").agg(F.sum("quantity").alias("quantity"))
    return held.join(avg, ["account_id", "ticker"]).groupBy("account_id").agg(F.sum(F.col("quantity") * F.col("unit_cost")).alias("cost_basis"))


def portfolio_summary(assets: DataFrame) -> DataFrame:
    """Market value, gain, gain in percent of the cost, and weight of each asset, and its account's total; ``assets`` has quantity, price, avg_price."""
    total = F.sum("market_value").over(W.partitionBy("account_id"))
    paid = F.col("avg_price") * F.col("quantity")
    out = assets.withColumn("market_value", F.col("quantity") * F.col("price")).withColumn("gain", (F.col("price") - F.col("avg_price")) * F.col("quantity")).withColumn("gain_pct", F.coalesce(F.try_divide("gain", paid) * 100, F.lit(0.0)))
    return out.withColumn("total", total).withColumn("weight", F.coalesce(F.try_divide("market_value", "total") * 100, F.lit(0.0)))


def top_holdings(assets: DataFrame, k: int | None = None, asset_type: str | None = None) -> DataFrame:
    """The assets (of one type) of each account with their rank by market value; the first ``k`` of them."""
    if asset_type is not None:
        assets = assets.where(F.col("asset_type") == asset_type)
    order = W.partitionBy("account_id").orderBy(F.desc("market_value"), "ticker", "asset_type", "currency")
    ranked = assets.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def gain_totals(assets: DataFrame) -> DataFrame:
    """Market value, gain and gain in percent of the cost of each account; ``assets``: ``portfolio_summary``."""
    cost = F.sum(F.col("avg_price") * F.col("quantity"))
    gain = F.sum("gain")
    return assets.groupBy("account_id").agg(F.sum("market_value").alias("total_market_value"), gain.alias("total_gain"), F.coalesce(F.try_divide(gain, cost) * 100, F.lit(0.0)).alias("gain_percent"))


def currencies_needed(pos: DataFrame, display: str) -> DataFrame:
    """Currencies of the positions, USD and the one shown, once each."""
    have = pos.select(F.coalesce("currency", F.lit("USD")).alias("currency")).distinct()
    named = have.sparkSession.range(1).select(F.explode(F.array(F.lit("USD"), F.lit(display))).alias("currency"))
    return have.union(named).distinct()


def transactions_desc(tx: DataFrame, *ties: str) -> DataFrame:
    """The newest first; ``ties``: columns that order trades of the same time."""
    return tx.orderBy(F.desc("timestamp"), *ties)


#: Days whose sums are columns of one row.
DAYS = 32


def daily_values(px: DataFrame, pos: DataFrame, dates: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Value of each account on each of ``dates(date)``, a few years of days; days without a positive total are left out.

    ``px(ticker, date, close)`` may hold several closes of a day: the last by ``order``, of equals the greatest, counts.

    Days are cut into blocks of ``DAYS``, and a ticker's closes of a block are the columns of one row. A holding meets them once
    for each block, and the sums of an account are kept column by column, with partial sums, so that no list of holdings is
    built. Holdings are dealt by account beforehand, three numbers a row, to twice the session's shuffle partitions, which adaptive
    execution doesn't join, since each account becomes a row for each day; where the closes are small, which adaptive execution
    sees from what it has written, they go to the holdings, and the sums need no further exchange.
    """
    days = dates.select("date").where("date is not null").distinct().agg(F.sort_array(F.collect_list("date")).alias("days")).select(F.posexplode("days").alias("place", "date"))
    days = days.select("date", F.floor(F.col("place") / DAYS).alias("block"), (F.col("place") % DAYS).alias("slot"))
    close = F.max_by("close", F.struct(*order, "close")) if order else F.max("close")
    one = px.where("close is not null").join(F.broadcast(days), "date").groupBy("ticker", "block", "slot").agg(close.alias("close"))
    wide = one.groupBy("ticker", "block").agg(*[F.sum(F.when(F.col("slot") == i, F.col("close"))).alias(f"c{i}") for i in range(DAYS)])
    held = pos.where("quantity is not null").select("account_id", "ticker", "quantity").repartition(2 * int(pos.sparkSession.conf.get("spark.sql.shuffle.partitions")), "account_id")
    sums = held.join(wide, "ticker").groupBy("account_id", "block").agg(*[F.sum(F.col("quantity") * F.col(f"c{i}")).alias(f"c{i}") for i in range(DAYS)])
    each = sums.select("account_id", "block", F.posexplode(F.array(*[f"c{i}" for i in range(DAYS)])).alias("slot", "value")).where("value > 0")
    return each.join(F.broadcast(days), ["block", "slot"]).select("account_id", "date", "value")
