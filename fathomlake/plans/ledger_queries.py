"""Queries of ledgers, loads and statements: orders, appends, reshaping and what the lake holds, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation as A
from ..operators import filings as D
from ..operators import portfolio as P
from ..operators import retrieval as V
from ..operators import series as S
from ..sources import lake as L
from .queries import ASSET, FORMS, POS, PX, _assets, _IN_FORMS, query, rounded, s4

# ---- orders and appends --------------------------------------------------------------------------------------------

_TX = "account_id, ticker, type, price, quantity, timestamp"


@query(f"SELECT account_id, ticker, type, {s4('price')} AS price, quantity, timestamp FROM transactions ORDER BY timestamp DESC", "transactions")
def transactions_desc(tx):
    return rounded(P.transactions_desc(tx.select(*_TX.split(", ")), "account_id", "ticker"), "price")


@query(f"SELECT symbol, date, {s4('rate')} AS rate, load_timestamp FROM fx_load ORDER BY load_timestamp DESC LIMIT 1000", "fx_load")
def newest(fx):
    """The newest thousand loads: a top-n by contract."""
    return rounded(S.newest(fx, "load_timestamp", 1000), "rate")


@query(f"SELECT ticker, date, {s4('close')} AS close FROM stock_prices ORDER BY ticker, date", "stock_prices")
def series_asc(px):
    return rounded(S.series_asc(px.select("ticker", "date", "close"), "ticker", "date"), "close")


@query(f"SELECT symbol, date, {s4('rate')} AS rate, NULL AS source FROM fx_load UNION ALL SELECT symbol, date, {s4('value')}, source FROM macro_load", "fx_load", "macro_load")
def union_loads(fx, m):
    return rounded(S.union_loads(fx.select("symbol", "date", "rate"), m.select("symbol", "date", F.col("value").alias("rate"), "source")), "rate")


@query("SELECT DISTINCT CAST(code AS VARCHAR) AS code FROM facts_wide WHERE disclosed_date = DATE '1995-06-15'", "facts_wide")
def companies_in_batch(w):
    return D.companies_in_batch(w.where("disclosed_date = DATE'1995-06-15'").withColumnRenamed("code", "Code"))


@query(f"SELECT doc_id, edinet_code, n_chars FROM filings WHERE n_chars BETWEEN 500 AND 900 AND form_code IN ({_IN_FORMS}) ORDER BY n_chars DESC, doc_id LIMIT 1000", "filings")
def search_filings_range(f):
    """Matches within two bounds, the greatest first: a top-n by contract."""
    found = D.search_filings(f.where(F.col("form_code").isin(FORMS)), since="500", until="900", at="n_chars")
    return found.select("doc_id", "edinet_code", "n_chars")


# ---- rates and prices ----------------------------------------------------------------------------------------------


@query(f"SELECT symbol, {s4('arg_max(rate, load_timestamp)')} AS rate FROM fx_load WHERE symbol <> 'USD' GROUP BY symbol UNION ALL SELECT 'USD', 1e0", "fx_load")
def latest_rates(fx):
    return rounded(S.latest_rates(fx, ["load_timestamp"]), "rate")


@query(f"SELECT symbol, date, {s4('rate')} AS rate FROM fx_load UNION ALL SELECT 'USD', CAST(d AS DATE), 1e0 FROM generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 1 DAY) t(d)", "fx_load")
def rates_with_usd(fx):
    return rounded(S.union_loads(fx.select("symbol", "date", "rate"), S.usd_rates(fx.sparkSession, "2024-01-01", "2024-03-31")), "rate")


@query(f"+r AS (SELECT ticker, date, close, volume % 3 AS split, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM stock_prices) SELECT ticker, date, {s4('(close - prev) / nullif(prev, 0)')} AS change, split NOT IN (0, 1) AS with_split FROM r WHERE abs((close - prev) / nullif(prev, 0)) > 0.5", "stock_prices")
def price_spikes_by_split(px):
    spikes = S.price_spikes(px.withColumn("split", F.col("volume") % 3), "ticker", "date", "close", split="split")
    return rounded(spikes.select("ticker", "date", "change", "with_split"), "change")


@query("SELECT ticker, date FROM stock_prices WHERE NOT (high - 50 >= low AND open BETWEEN low - 1e-6 AND high - 50 + 1e-6 AND close BETWEEN low - 1e-6 AND high - 50 + 1e-6 AND least(open, high - 50, low, close) >= 0 AND volume >= 0)", "stock_prices")
def validate_ohlc_rejects(px):
    """Rows that don't hold together once 50 is taken off each high, so that there are some."""
    return S.validate_ohlc(px.withColumn("high", F.col("high") - 50))[1].select("ticker", "date")


@query(f"SELECT 'index' AS source, ticker, date, {s4('close')} AS close FROM benchmark_daily UNION ALL SELECT CASE WHEN CAST(substr(ticker, 7) AS INT) > 20 THEN 'crypto' ELSE 'stock' END, ticker, date, {s4('close')} FROM stock_prices", "benchmark_daily", "stock_prices")
def all_prices_rows(daily, px):
    crypto = "CAST(substr(ticker, 7) AS INT) > 20"
    return rounded(V.all_prices(daily, px.where(crypto), px.where(f"NOT ({crypto})")).select("source", "ticker", "date", "close"), "close")


# ---- portfolio -----------------------------------------------------------------------------------------------------


@query(f"+{POS}, {PX}, {ASSET} SELECT account_id, {s4('sum(market_value)')} AS total_market_value, {s4('sum((price - avg_price) * quantity)')} AS total_gain, {s4('coalesce(sum((price - avg_price) * quantity) / nullif(sum(avg_price * quantity), 0) * 100, 0)')} AS gain_percent FROM asset GROUP BY account_id", "transactions", "stock_prices")
def gain_totals(tx, px):
    return rounded(P.gain_totals(_assets(tx, px)), "total_market_value", "total_gain", "gain_percent")


@query(f"+{POS}, {PX}, {ASSET} SELECT account_id, ticker, currency, {s4('market_value')} AS market_value, {s4('coalesce((price - avg_price) * quantity / nullif(avg_price * quantity, 0) * 100, 0)')} AS gain_pct, CAST(row_number() OVER (PARTITION BY account_id ORDER BY market_value DESC, ticker, asset_type, currency) AS INT) AS rank FROM asset WHERE asset_type = 'CRYPTO'", "transactions", "stock_prices")
def holdings_of_type(tx, px):
    held = P.top_holdings(_assets(tx, px), asset_type="CRYPTO")
    return rounded(held.select("account_id", "ticker", "currency", "market_value", "gain_pct", "rank"), "market_value", "gain_pct")


@query("SELECT account_id, total FROM (SELECT account_id, sum(ratio) AS total FROM (SELECT account_id, CASE WHEN account_id % 3 = 0 AND category = 'INDEX' THEN 0.5e0 ELSE ratio END AS ratio FROM account_inputs CROSS JOIN allocation_target) GROUP BY account_id) WHERE abs(total - 1) > 0.0001", "account_inputs", "allocation_target")
def invalid_targets(inputs, defaults):
    own = inputs.where("account_id % 3 = 0").select("account_id", F.lit("INDEX").alias("category"), F.lit(0.5).alias("ratio"))
    return rounded(A.invalid_targets(A.targets(defaults, own, inputs)), "total")


# ---- filings and statements ----------------------------------------------------------------------------------------


#: Cells that are there and can't be read.
_UNREAD = " OR ".join(f"({c} IS NOT NULL AND try_cast({c} AS {t}) IS NULL)" for c, t in D.US_CELLS.items())


@query(f"""+f AS (SELECT md5(concat_ws('|', ticker, accession_number, concept, period_start, period_end, period_instant)) AS fact_id, accession_number, ticker, concept, label, CAST(numeric_value AS DOUBLE) AS value, unit_ref AS unit,
        CAST(fiscal_year AS INT) AS fiscal_year, fiscal_period, CAST(period_start AS DATE) AS period_start, CAST(period_end AS DATE) AS period_end, CAST(period_instant AS DATE) AS period_instant
        FROM us_facts WHERE numeric_value IS NOT NULL AND numeric_value <> 'NaN' AND NOT ({_UNREAD})),
    r AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY value DESC, unit DESC NULLS LAST, label DESC NULLS LAST, fiscal_year DESC NULLS LAST, fiscal_period DESC NULLS LAST, period_start DESC NULLS LAST, period_end DESC NULLS LAST, period_instant DESC NULLS LAST) AS k FROM f)
    SELECT fact_id, accession_number, ticker, concept, label, {s4('value')} AS value, unit, fiscal_year, fiscal_period, period_start, period_end, period_instant FROM r WHERE k = 1""", "us_facts")  # fmt: skip
def normalize_us_facts(facts):
    """One fact for each key; of those that share it the greatest stays."""
    return rounded(D.normalize_us_facts(facts), "value")


@query(f"SELECT ticker, item, date, {s4('value')} AS value, 'Annual' AS period_type FROM (SELECT ticker, item, '1995-12-31' AS date, y1995 AS value FROM statement_matrix UNION ALL SELECT ticker, item, '1996-12-31', y1996 FROM statement_matrix) WHERE value IS NOT NULL", "statement_matrix")
def stack_statements(m):
    wide = m.withColumnsRenamed({"y1995": "1995-12-31 00:00:00", "y1996": "1996-12-31 00:00:00"})
    return rounded(D.stack_statements(wide, "item", "Annual", ["ticker"]), "value")


@query(f"SELECT code, fiscal_period, {s4('l_extendedprice')} AS value, CASE WHEN l_returnflag = 'R' THEN 'balance_sheet' ELSE 'financials' END AS table_name, CASE WHEN l_returnflag = 'A' THEN 'Quarterly' ELSE 'Annual' END AS period_type FROM facts_wide", "facts_wide")
def union_statements_rows(w):
    of = lambda c: w.where(F.col("l_returnflag") == c).select("code", "fiscal_period", F.col("l_extendedprice").alias("value"))
    frames = V.union_statements([(of("A"), "financials", "Quarterly"), (of("N"), "financials", "Annual"), (of("R"), "balance_sheet", "Annual")])
    rows = [df.withColumn("table_name", F.lit(t)) for t, df in frames.items()]
    return rounded(rows[0].unionByName(rows[1]), "value")


@query("SELECT doc_id, concat_ws(',', CASE WHEN NOT coalesce(n_chars > 100, false) THEN 'size' END, CASE WHEN form_code IS NULL THEN 'form' END) AS reasons FROM filings WHERE NOT coalesce(n_chars > 100 AND form_code IS NOT NULL, false)", "filings")
def contract_rejects(f):
    bad = D.apply_contract(f, {"size": "n_chars > 100", "form": "form_code IS NOT NULL"})[1]
    return bad.select("doc_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("SELECT doc_id, op FROM filing_changes WHERE doc_id % 2 = 0", "filings", "filing_changes")
def missing_changes(f, changes):
    """Changes of documents that a table without the even ones hasn't."""
    return D.missing_changes(f.where("doc_id % 2 = 1"), changes, "doc_id").select("doc_id", "op")


@query("SELECT ticker, count(*) - 1 AS retry_count, arg_max(sector, struct_pack(a := snapshot_at, b := tiebreak)) AS status, arg_max(coalesce(industry, ''), struct_pack(a := snapshot_at, b := tiebreak)) AS error_message FROM profile_snapshots GROUP BY ticker", "profile_snapshots")
def ingestion_errors(snap):
    log = snap.select("ticker", F.col("sector").alias("status"), F.coalesce("industry", F.lit("")).alias("error_message"), "snapshot_at", "tiebreak")
    return D.ingestion_state(log, "ticker", ["snapshot_at", "tiebreak"])


@query("+i AS (SELECT DISTINCT c.cik, t.ticker FROM (SELECT lpad(CAST(code AS VARCHAR), 10, '0') AS cik FROM facts_wide) c JOIN (SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS cik, arg_max(coalesce(form_code, 'UNKNOWN'), n_chars) AS ticker FROM filings GROUP BY doc_id) t ON t.cik = c.cik) SELECT * FROM i WHERE ticker <> 'UNKNOWN'", "facts_wide", "filings")
def attach_ticker(w, f):
    companies = f.select(F.col("doc_id").alias("cik"), F.coalesce("form_code", F.lit("UNKNOWN")).alias("ticker"), F.col("n_chars").alias("ordinal"))
    return D.attach_ticker(w.select(F.col("code").alias("cik")).distinct(), companies).select("cik", "ticker")


@query("SELECT f.doc_id AS cik, a AS accession_number, 'd' || f.doc_id AS primaryDocument, CAST(2000 + k AS VARCHAR) AS filingDate FROM filings f CROSS JOIN (VALUES (0), (1)) t(k) CROSS JOIN LATERAL (SELECT '000' || k || '24' || f.doc_id AS a)", "filings")
def resolve_metadata(f):
    """Each company's two filings by their accession numbers, from arrays of equal length."""
    of = lambda make: F.array(*[make(k) for k in (0, 1)])
    number = lambda k, mark: F.concat(F.lit(f"000{k}{mark}24{mark}"), F.col("doc_id").cast("string"))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    submissions = f.select(F.col("doc_id").alias("cik"), of(lambda k: number(k, "-")).alias("accessionNumber"), of(lambda k: F.lit(str(2000 + k))).alias("filingDate"), of(lambda k: F.lit("10-K")).alias("form"), of(lambda k: name).alias("primaryDocument"), of(lambda k: F.lit("x")).alias("primaryDocDescription"))
    index = f.select(F.col("doc_id").alias("cik"), F.explode(of(lambda k: number(k, ""))).alias("accession_number"))
    return D.resolve_metadata(index, submissions).select("cik", "accession_number", "primaryDocument", "filingDate")


# ---- what the lake holds -------------------------------------------------------------------------------------------


@query("SELECT 'prices' AS table_name, count(*) AS n, count(DISTINCT ticker) AS symbols FROM stock_prices UNION ALL SELECT 'rates', count(*), count(DISTINCT symbol) FROM fx_load", "stock_prices", "fx_load")
def lake_status(px, fx):
    return L.lake_status({"prices": (px, "ticker"), "rates": (fx, "symbol")})


@query("+f AS (SELECT CAST(doc_id AS VARCHAR) AS id, n_chars, row_number() OVER (ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) AS k FROM filings), m AS (SELECT CAST(tiebreak AS VARCHAR) AS id, value, row_number() OVER (ORDER BY tiebreak DESC) AS k FROM macro_load) "
       "SELECT 'filings' AS table_name, CAST(k AS INT) AS rank, id, CAST(n_chars AS VARCHAR) AS at FROM f WHERE k <= 5 UNION ALL SELECT 'macro', CAST(k AS INT), id, id FROM m WHERE k <= 5", "filings", "macro_load")  # fmt: skip
def newest_rows(f, m):
    """Five samples of each table: the audit's report."""
    return L.newest_rows({"filings": (f, "doc_id", "n_chars"), "macro": (m, "tiebreak", "tiebreak")})
