"""Rates and prices as of their day, revised prices, facts and statements with bad cells, and filings by filer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as H
from ..operators import filings as D
from ..operators import portfolio as P
from .queries import BENCH, VALUES, _bench, query, rounded, s4

#: Buys with the last rate at or before their day; {0}: how old it may be.
_ASOF = """fxh AS (SELECT symbol, date AS day, rate FROM fx_history WHERE rate <> 0 AND symbol <> 'USD'),
    b AS (SELECT account_id, coalesce(currency, 'USD') AS currency, CAST(timestamp AS DATE) AS day, quantity * price AS amount FROM transactions WHERE type = 'BUY'),
    j AS (SELECT b.*, CASE WHEN b.day - f.day <= {0} THEN f.rate END AS rate FROM b ASOF LEFT JOIN fxh f ON b.currency = f.symbol AND b.day >= f.day)"""


def _buys(tx):
    return tx.where("type = 'BUY'").withColumns({"currency": F.coalesce("currency", F.lit("USD")), "amount": F.col("quantity") * F.col("price")})


@query(f"+{_ASOF.format(5)} SELECT account_id, currency, count(*) AS n_buys, count(rate) AS n_rated, {s4('sum(amount * coalesce(rate, 1))')} AS usd FROM j GROUP BY account_id, currency", "transactions", "fx_history")
def historical_fx(tx, fx):
    """USD value of the buys at the rates of their days, at most five days old."""
    usd = H.convert_historical(_buys(tx), fx, "amount", "USD", "timestamp", 5)
    return rounded(usd.groupBy("account_id", "currency").agg(F.count("*").alias("n_buys"), F.count("rate").alias("n_rated"), F.sum("converted").alias("usd")), "usd")


@query(f"+{_ASOF.format(100000)}, y AS (SELECT day, rate FROM fxh WHERE symbol = 'JPY') SELECT account_id, {s4('sum(amount * coalesce(j.rate, 1) / coalesce(y.rate, 1))')} AS jpy FROM j ASOF LEFT JOIN y ON j.day >= y.day GROUP BY account_id", "transactions", "fx_history")
def historical_fx_carried(tx, fx):
    """Value of the buys in JPY at the last rates known on their days, however old."""
    jpy = H.convert_historical(_buys(tx), fx, "amount", "JPY", "timestamp")
    return rounded(jpy.groupBy("account_id").agg(F.sum("converted").alias("jpy")), "jpy")


@query(f"+{BENCH}, {_ASOF.format(100000)} SELECT account_id, {s4('sum(amount * coalesce(j.rate, 1))')} AS shadow_cost, {s4('sum(amount * coalesce(j.rate, 1) / n.price)')} AS shadow_units FROM j JOIN near n ON n.day = j.day GROUP BY account_id", "transactions", "benchmark_daily", "fx_history")
def shadow_benchmark_historical(tx, daily, fx):
    return rounded(P.shadow_benchmark(tx, _bench(daily), fx, ["account_id"], historical_fx=True), "shadow_cost", "shadow_units")


_REVISED = VALUES.replace("JOIN stock_prices USING (ticker)", "JOIN revised USING (ticker)")


@query(f"+revised AS (SELECT ticker, date, CASE WHEN extract(DAY FROM date) % 3 = 0 THEN close + 1 ELSE close END AS close FROM stock_prices), {_REVISED} SELECT account_id, date, {s4('value')} AS value FROM dv", "transactions", "stock_prices", "benchmark_daily")
def daily_values_revised(tx, px, daily):
    """Daily values from a lake that holds several loads of a day; the last one counts."""
    load = lambda df, n: df.select("ticker", "date", "close", F.lit(n).alias("load"))
    later = px.where("day(date) % 3 = 0").withColumn("close", F.col("close") + 1)
    loads = load(px, 2).unionByName(load(later, 3)).unionByName(load(px.withColumn("close", F.col("close") * 9), 1))
    return rounded(P.daily_values(loads, P.positions(tx), daily.select("date").orderBy(F.desc("date")).limit(252), ("load",)), "value")


_BAD = " OR ".join(f"({c} IS NOT NULL AND try_cast({c} AS {t}) IS NULL)" for c, t in D.US_CELLS.items())


@query(f"""+f AS (SELECT md5(concat_ws('|', ticker, accession_number, concept, period_start, period_end, period_instant)) AS fact_id, accession_number, ticker, concept, label, CAST(numeric_value AS DOUBLE) AS value, unit_ref AS unit,
        CAST(fiscal_year AS INT) AS fiscal_year, fiscal_period, CAST(period_start AS DATE) AS period_start, CAST(period_end AS DATE) AS period_end, CAST(period_instant AS DATE) AS period_instant
        FROM us_facts_dirty WHERE numeric_value IS NOT NULL AND numeric_value <> 'NaN' AND NOT ({_BAD})),
    r AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY value DESC, unit DESC, label DESC, fiscal_year DESC, fiscal_period DESC) AS k FROM f)
    SELECT fact_id, accession_number, ticker, concept, label, {s4('value')} AS value, unit, fiscal_year, fiscal_period, period_start, period_end, period_instant FROM r WHERE k = 1""", "us_facts_dirty")  # fmt: skip
def us_facts_by_contract(facts):
    return rounded(D.normalize_us_facts(facts), "value")


_REASONS = ", ".join(f"CASE WHEN {c} IS NOT NULL AND try_cast({c} AS {t}) IS NULL THEN '{c}' END" for c, t in D.US_CELLS.items())


@query(f"SELECT accession_number, concept, numeric_value, fiscal_year, period_end, concat_ws(',', {_REASONS}) AS reasons FROM us_facts_dirty WHERE {_BAD}", "us_facts_dirty")
def us_fact_rejects(facts):
    return D.us_fact_rejects(facts).select("accession_number", "concept", "numeric_value", "fiscal_year", "period_end", F.concat_ws(",", "reasons").alias("reasons"))


@query(f"""SELECT ticker, item, date, {s4('value')} AS value, 'Annual' AS period_type FROM (SELECT ticker, item, '1995-12-31' AS date, try_cast(y1995 AS DOUBLE) AS value FROM statement_matrix_dirty
    UNION ALL SELECT ticker, item, '1996-12-31', y1996 FROM statement_matrix_dirty WHERE NOT isnan(y1996)) WHERE value IS NOT NULL""", "statement_matrix_dirty")  # fmt: skip
def stack_dirty_statements(m):
    wide = m.withColumnsRenamed({"y1995": "1995-12-31 00:00:00", "y1996": "1996-12-31 00:00:00"})
    return rounded(D.stack_statements(wide, "item", "Annual", ["ticker"]), "value")


@query("SELECT doc_id, edinet_code, sec_code, filer_name, submit_datetime FROM registry WHERE filer_name LIKE '%any 12%' AND sec_code LIKE '%1%' AND submit_datetime >= '1996-01-01' AND submit_datetime <= '2000-12-31' ORDER BY submit_datetime DESC, doc_id DESC LIMIT 1000", "registry")
def search_filings_by_filer(r):
    """The newest thousand filings of the filers whose name has a part: a top-n by contract."""
    return D.search_filings(r, name="1", filer="any 12", since="1996-01-01", until="2000-12-31").select("doc_id", "edinet_code", "sec_code", "filer_name", "submit_datetime")
