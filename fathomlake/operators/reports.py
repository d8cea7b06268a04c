"""Figures and reports drawn from portfolios, series and logs, for all accounts or symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import CURRENCY_SYMBOLS
from .series import daily_returns, max_drawdown, risk_metrics


def benchmark_table(perf: DataFrame, shadow: DataFrame, replaced: str = "^GSPC") -> DataFrame:
    """``account_id, ticker, gain``: the benchmarks' changes; for ``replaced`` the account's shadow return unless it is 0.

    ``perf(ticker, performance)`` has a row for each benchmark followed, a short list; ``shadow(account_id, b_ret)``.
    """
    own = (F.col("ticker") == replaced) & (F.col("b_ret") != 0)
    return shadow.crossJoin(F.broadcast(perf)).select("account_id", "ticker", F.when(own, F.col("b_ret")).otherwise(F.col("performance")).alias("gain"))


def sleeve_alpha(assets: DataFrame, asset_type: str) -> DataFrame:
    """Of each account's assets of the type: summed gain over the benchmark's, its shadow value, and the first in percent of it."""
    over = F.col("gain") - F.col("benchmark_gain")
    out = assets.where(F.col("asset_type") == asset_type).groupBy("account_id").agg(F.sum(over).alias("alpha"), F.sum(F.col("market_value") - over).alias("shadow_value"))
    return out.withColumn("alpha_pct", F.when(F.col("shadow_value") > 0, F.col("alpha") / F.col("shadow_value") * 100).otherwise(0.0))


def shadow_daily(values: DataFrame, units: DataFrame, bench: DataFrame) -> DataFrame:
    """Benchmark value of the account's shadow units on the days of ``values(account_id, date)``."""
    on = values.select("account_id", "date").join(bench.select("date", "close"), "date")
    return on.join(units.select("account_id", "shadow_units"), "account_id").select("account_id", "date", (F.col("shadow_units") * F.col("close")).alias("shadow_value"))


def attach_macro(df: DataFrame, latest: DataFrame, names: dict[str, str]) -> DataFrame:
    """The latest values of the named symbols as columns of every row, 0 where there is none; the side input is one row."""
    row = latest.agg(*[F.coalesce(F.max(F.when(F.col("symbol") == s, F.col("value"))), F.lit(0.0)).alias(n) for n, s in names.items()])
    return df.crossJoin(F.broadcast(row))


def attach_crypto_meta(pos: DataFrame, meta: DataFrame) -> DataFrame:
    """``crypto_metadata``: a struct of the columns of ``meta`` for CRYPTO positions that have a row there, else null."""
    fields = [c for c in meta.columns if c != "ticker"]
    packed = meta.select(F.col("ticker").alias("_m"), F.struct(*fields).alias("crypto_metadata"))
    return pos.join(packed, (pos["ticker"] == F.col("_m")) & (pos["asset_type"] == "CRYPTO"), "left").drop("_m")


def effective_yield(tx: DataFrame, values: DataFrame) -> DataFrame:
    """Percent gained on the money put in, sales, dividends and fees counted; ``values(account_id, market_value)`` is what is held."""
    paid = lambda t: F.sum(F.when(F.col("type") == t, F.col("quantity") * F.col("price")).otherwise(0.0))
    flows = tx.groupBy("account_id").agg(paid("BUY").alias("bought"), paid("SELL").alias("sold"), paid("DIVIDEND").alias("dividends"), F.sum(F.coalesce("fee", F.lit(0.0))).alias("fees"))
    full = flows.join(values, "account_id", "left").withColumn("put_in", F.col("bought") + F.col("fees"))
    gained = F.coalesce("market_value", F.lit(0.0)) + F.col("sold") + F.col("dividends") - F.col("put_in")
    return full.select("account_id", (F.try_divide(gained, "put_in") * 100).alias("effective_yield"))


def backfill_progress(progress: DataFrame, now: Column, total_days: int = 1825) -> DataFrame:
    """One row: days done and failed, done in the last hour, of how many, and the last one done; one pass."""
    done = F.col("status") == "completed"
    recent = done & (F.col("updated_at") > now - F.expr("INTERVAL 1 HOUR"))
    return progress.agg(F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(recent).alias("rate_per_hour"), F.lit(total_days).alias("total_days"), F.max(F.when(done, F.col("target_date"))).alias("latest_date"))


def validation_summary(rejects: DataFrame, batch: str) -> DataFrame:
    """Violations of each batch, and its distinct tickers in order, as text."""
    once = rejects.groupBy(batch, "ticker").agg(F.count("*").alias("n"))
    return once.groupBy(batch).agg(F.sum("n").alias("violations"), F.concat_ws(",", F.array_sort(F.collect_list("ticker"))).alias("tickers"))


def cagr(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Yearly growth in percent between the first and the last value; null without two days or a first value above 0."""
    ends = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, date).alias("a"), F.max_by(value, date).alias("b"), F.datediff(F.max(date), F.min(date)).alias("days"))
    growth = F.pow(F.col("b") / F.col("a"), F.lit(365.0) / F.col("days")) - 1
    return ends.select(key, F.when((F.col("days") > 0) & (F.col("a") > 0), growth * 100).alias("cagr"))


def relative_strength(px: DataFrame, bench: DataFrame) -> DataFrame:
    """Close over the benchmark's close of the day; null where that is 0."""
    return px.select("ticker", "date", "close").join(bench.select("date", F.col("close").alias("_b")), "date").select("ticker", "date", F.try_divide("close", "_b").alias("strength"))


def index_statistics(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Return from first to last value, volatility of the daily returns and deepest fall, all in percent, by key."""
    whole = df.where(F.col(value).isNotNull()).groupBy(key).agg(((F.try_divide(F.max_by(value, date), F.min_by(value, date)) - 1) * 100).alias("total_return"))
    vol = risk_metrics(daily_returns(df, [key], date, value), [key]).select(key, "volatility")
    return whole.join(vol, key, "left").join(max_drawdown(df, [key], date, value), key, "left")


def allocation_report(assets: DataFrame, drift: DataFrame) -> DataFrame:
    """Rows of a typed export: each account's assets, then its categories, ratios in percent."""
    total = drift.groupBy("account_id").agg(F.max("total").alias("total"))
    pct = lambda c: c * 100
    rows = assets.join(total, "account_id").select("account_id", F.lit("Asset").alias("type"), F.col("asset").alias("name"), "category", "value", pct(F.try_divide("value", "total")).alias("ratio"), F.lit(None).cast("double").alias("target_ratio"), F.lit(None).cast("string").alias("status"))
    share = F.coalesce(F.try_divide("current", "total"), F.lit(0.0))
    return rows.unionByName(drift.select("account_id", F.lit("Category").alias("type"), F.col("category").alias("name"), F.lit(None).cast("string").alias("category"), F.col("current").alias("value"), pct(share).alias("ratio"), pct(F.col("ratio")).alias("target_ratio"), "status"))


def money(c: Column | str, symbol: str = "¥") -> Column:
    """Whole units with separators; halves go up, also where a sum comes out a millionth below."""
    x = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(symbol), F.format_number(F.floor(x + 0.500001), 0))


def percent(c: Column) -> Column:
    tenths = F.floor(c * 1000 + 0.500001).cast("long")
    size = F.abs(tenths)
    return F.concat(F.when(tenths < 0, "-").otherwise(""), F.floor(size / 10).cast("string"), F.lit("."), (size % 10).cast("string"), F.lit("%"))


def _joined(lines: Column) -> Column:
    """An array of structs that end with a line ``t``, in their order, as one text; none of null."""
    return F.array_join(F.transform(F.array_sort(F.filter(lines, lambda x: x["t"].isNotNull())), lambda x: x["t"]), "\n")


def allocation_markdown(holdings: DataFrame, targets: DataFrame, currency: str = "JPY") -> DataFrame:
    """One Markdown document an account: summary, categories against targets, assets, and what to buy of which asset, as
    ``rebalance_plan`` and ``split_buys`` tell.

    ``holdings(account_id, asset, category, value)``; ``targets(category, ratio)``: a row a category. An account's assets are one
    row, as they are in its document; so ``holdings`` is read once and nothing is joined but the targets.
    """
    from .allocation import rebalance_plan, with_drift

    symbol = CURRENCY_SYMBOLS.get(currency, currency)
    cells = lambda *parts: F.concat(F.lit("| "), *[x for p in parts for x in (p, F.lit(" | "))][:-1], F.lit(" |"))
    share = lambda v: F.coalesce(F.try_divide(v, F.col("total")), F.lit(0.0))
    # What doesn't depend on the rest of the account is written before the rows meet, where Spark compiles it.
    begun = F.concat(F.lit("| "), "asset", F.lit(" | "), "category", F.lit(" | "), money("value", symbol), F.lit(" | ")).alias("begun")
    held = holdings.groupBy("account_id").agg(F.collect_list(F.struct("category", "asset", "value", begun)).alias("held"))
    numbered = targets.select("category", "ratio", F.row_number().over(W.orderBy("category")).alias("_n"))
    # Of an account's rows, one for each target, each has the assets of its category, and the first has all.
    grid = held.crossJoin(F.broadcast(numbered)).select(
        "account_id", "category", "ratio", F.when(F.col("_n") == 1, F.col("held")).alias("held"), F.filter("held", lambda x: x["category"] == F.col("category")).alias("own"))
    current = F.aggregate("own", F.lit(0.0), lambda total, x: total + F.coalesce(x["value"], F.lit(0.0)))
    plan = rebalance_plan(with_drift(grid.withColumn("current", current)))
    part = lambda x: F.col("buy") * F.when(F.col("current") > 0, x["value"] / F.col("current")).otherwise(1.0 / F.size("own"))
    parts = _joined(F.transform("own", lambda x: F.struct(x["asset"].alias("asset"), F.concat(F.lit("- "), x["asset"], F.lit(": "), money(part(x), symbol)).alias("t"))))
    parts = F.when(F.size("own") > 0, F.concat(F.lit("\n"), parts)).otherwise("")
    buy = F.when(F.col("buy") > 0, F.concat(F.lit("### "), "category", F.lit(" (+"), money("buy", symbol), F.lit(")"), parts))
    row = cells("category", percent(F.col("ratio")), percent(share(F.col("current"))), "status")
    doc = plan.select("account_id", "category", "total", "investment", "held", row.alias("row"), buy.alias("buy")).groupBy("account_id").agg(
        F.max("total").alias("total"), F.max("investment").alias("investment"), F.first("held", ignorenulls=True).alias("held"),
        F.collect_list(F.struct("category", F.col("row").alias("t"))).alias("rows"), F.collect_list(F.struct("category", F.col("buy").alias("t"))).alias("buys"))
    assets = F.transform("held", lambda x: F.struct(x["category"].alias("category"), x["asset"].alias("asset"), F.concat(x["begun"], percent(share(x["value"])), F.lit(" |")).alias("t")))
    head = F.concat(F.lit("# Portfolio Rebalance Report\n\n- Total: "), money("total", symbol), F.lit("\n- Required investment: "), money("investment", symbol), F.lit(f"\n- Currency: {currency}"))
    buys = _joined(F.col("buys"))
    body = F.concat(
        head, F.lit("\n\n| Category | Target | Current | Status |\n| :--- | :---: | :---: | :---: |\n"), _joined(F.col("rows")),
        F.lit("\n\n| Asset | Category | Value | Share |\n| :--- | :--- | :---: | :---: |\n"), _joined(assets), F.lit("\n\n"),
        F.when(buys == "", "No purchases.").otherwise(buys))
    return doc.select("account_id", body.alias("markdown"))
