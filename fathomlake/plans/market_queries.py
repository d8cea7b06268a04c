"""Queries of filters, keyed reads, unions and reports over the driver's tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation as A
from ..operators import filings as D
from ..operators import portfolio as P
from ..operators import reports as R
from ..operators import retrieval as V
from ..operators import series as S
from .queries import ASSET, DRIFT, FORMS, POS, PX, SHADOW, VALUES, _assets, _bench, _fx, _IN_FORMS, _values, query, rounded, s4

# ---- filters and keyed reads ---------------------------------------------------------------------------------------


@query(f"SELECT doc_id, form_code FROM filings WHERE form_code IN ({_IN_FORMS})", "filings")
def filter_forms(f):
    return V.filter_forms(f, FORMS).select("doc_id", "form_code")


@query("SELECT doc_id, edinet_code FROM filings WHERE edinet_code LIKE 'src1%'", "filings")
def filter_company(f):
    return V.filter_company(f, "src1").select("doc_id", "edinet_code")


@query("SELECT f.doc_id, f.edinet_code, f.n_chars FROM filings f WHERE f.doc_id IN (SELECT doc_id FROM facts_present)", "filings", "facts_present")
def lookup(f, wanted):
    return V.lookup(f, wanted, ["doc_id"], ["n_chars"]).select("doc_id", "edinet_code", "n_chars")


@query("SELECT symbol, name, market FROM directory WHERE market = 'US' AND contains(lower(name), '2') ORDER BY name LIMIT 20 OFFSET 5", "directory")
def list_symbols(d):
    """A page of a listing: the limit is the interface's."""
    return V.list_symbols(d.select(F.col("name").alias("symbol"), F.col("symbol").alias("name"), "market"), "US", "2", 20, 5).select(F.col("name").alias("symbol"), F.col("symbol").alias("name"), "market")


@query(f"SELECT ticker, date, {s4('close')} AS close FROM stock_prices WHERE close > 0 ORDER BY ticker, date LIMIT 100", "stock_prices")
def query_lake(px):
    """Free SQL over the price lake, with its cap on rows."""
    px.createOrReplaceTempView("lake_prices")
    return rounded(V.query_lake(px.sparkSession, "SELECT ticker, date, close FROM {T} WHERE close > 0 ORDER BY ticker, date", "lake_prices"), "close")


@query(f"+w AS (SELECT *, close IS NOT NULL AND date BETWEEN DATE '1992-02-01' AND DATE '1992-02-10' AS inside FROM stock_prices), g AS (SELECT *, bool_or(inside) OVER (PARTITION BY ticker) AS seen FROM w WHERE close IS NOT NULL) SELECT ticker, date, {s4('close')} AS close FROM g WHERE inside OR NOT seen", "stock_prices")
def prices_between(px):
    return rounded(V.prices_between(px.select("ticker", "date", "close"), "1992-02-01", "1992-02-10"), "close")


_CRYPTO = "CAST(substr(ticker, 7) AS INT) > 20"


@query(f"SELECT source, count(*) AS n, {s4('avg(close)')} AS close FROM (SELECT 'index' AS source, close FROM benchmark_daily UNION ALL SELECT CASE WHEN {_CRYPTO} THEN 'crypto' ELSE 'stock' END, close FROM stock_prices) GROUP BY source", "benchmark_daily", "stock_prices")
def all_prices(daily, px):
    both = V.all_prices(daily, px.where(_CRYPTO), px.where(f"NOT ({_CRYPTO})"))
    return rounded(both.groupBy("source").agg(F.count("*").alias("n"), F.avg("close").alias("close")), "close")


@query(f"SELECT symbol, date, {s4('coalesce(value, 0)')} AS open, {s4('close')} AS close FROM (SELECT symbol, date, CASE WHEN value > 5 THEN value END AS value, value - 1 AS close FROM macro_load) WHERE close > 0", "macro_load")
def clean_crypto(m):
    return rounded(V.clean_crypto(m.select("symbol", "date", F.when(F.col("value") > 5, F.col("value")).alias("open"), (F.col("value") - 1).alias("close"))), "open", "close")


@query(f"SELECT CAST(load_timestamp AS DATE) AS date, 'DGS10' AS symbol, CASE WHEN value > 1 THEN {s4('value')} END AS value, 'fred' AS source, load_timestamp FROM macro_load WHERE symbol = 'DGS10'", "macro_load")
def enforce_macro(m):
    raw = m.where("symbol = 'DGS10'").select(F.col("load_timestamp").alias("Date"), F.when(F.col("value") > 1, F.col("value").cast("string")).otherwise("bad").alias("Value"), "load_timestamp")
    return rounded(V.enforce_macro(raw, "DGS10", "fred", F.col("load_timestamp")), "value")


@query("SELECT DISTINCT symbol FROM directory WHERE exchange IN ('NASDAQ', 'NYSE', 'AMEX') AND regexp_matches(symbol, '^[A-Z.\\-]+$')", "directory")
def clean_universe(d):
    return V.clean_universe(d)


@query("SELECT symbol FROM directory WHERE market = 'US' UNION SELECT name FROM directory WHERE market = 'JP'", "directory")
def build_universe(d):
    return V.build_universe(d.where("market = 'US'"), d.where("market = 'JP'").select(F.col("name").alias("symbol")))


@query("SELECT CASE WHEN l_returnflag = 'R' THEN 'balance_sheet' ELSE 'financials' END AS table_name, CASE WHEN l_returnflag = 'A' THEN 'Quarterly' ELSE 'Annual' END AS period_type, count(*) AS n FROM facts_wide GROUP BY ALL", "facts_wide")
def union_statements(w):
    of = lambda c: w.where(F.col("l_returnflag") == c)
    frames = V.union_statements([(of("A"), "financials", "Quarterly"), (of("N"), "financials", "Annual"), (of("R"), "balance_sheet", "Annual")])
    counted = [df.groupBy("period_type").agg(F.count("*").alias("n")).withColumn("table_name", F.lit(t)) for t, df in frames.items()]
    return counted[0].unionByName(counted[1])


# ---- filings -------------------------------------------------------------------------------------------------------


@query("SELECT f.doc_id, f.form_code, c.edinet_code FROM filings f JOIN (SELECT doc_id, min(edinet_code) AS edinet_code FROM filing_changes GROUP BY doc_id) c ON c.doc_id = f.doc_id", "filings", "filing_changes")
def backfill_targets(f, wanted):
    return D.backfill_targets(f, wanted, "edinet_code").select("doc_id", "form_code", "edinet_code")


@query(f"+b AS (SELECT symbol, date, rate + 1 AS rate FROM fx_load WHERE date >= DATE '2024-01-10' AND symbol <> 'EUR') SELECT symbol, date, {s4('rate')} AS rate FROM b UNION ALL SELECT symbol, date, {s4('rate')} FROM fx_load f WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = f.symbol AND b.date = f.date)", "fx_load")
def replace_days(fx):
    rows = fx.select("symbol", "date", "rate")
    return rounded(D.replace_days(rows, rows.where("date >= DATE'2024-01-10' AND symbol <> 'EUR'").withColumn("rate", F.col("rate") + 1), ["symbol", "date"]), "rate")


@query("""SELECT doc_id, '{' || string_agg('"' || element || '":"' || context || '"', ',' ORDER BY element) || '}' AS sections FROM (SELECT doc_id, element, max(context) AS context FROM statement_facts GROUP BY ALL) GROUP BY doc_id""", "statement_facts")
def pack_sections(facts):
    return D.pack_sections(facts, "doc_id", "element", "context")


@query(f"SELECT account_id, ticker, {s4('price')} AS price, timestamp, CAST(NULL AS VARCHAR) AS memo, coalesce(currency, 'USD') AS currency FROM transactions", "transactions")
def evolve_transactions(tx):
    old = tx.withColumnRenamed("timestamp", "date").select("account_id", "ticker", "price", "date", "currency")
    return rounded(D.evolve_transactions(old), "price")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, element AS item_name, {s4('value')} AS item_value, 'JPY' AS unit, context AS context_id, CAST(ordinal AS INT) AS fiscal_year, 'FY' AS fiscal_period, 's' AS session_id FROM statement_facts", "statement_facts")
def migrate_facts(facts):
    old = facts.select("doc_id", F.col("element").alias("item_name"), F.col("value").alias("item_value"), F.lit("JPY").alias("unit"), F.col("context").alias("context_id"), F.col("ordinal").alias("fiscal_year"), F.lit("FY").alias("fiscal_period"), F.lit("s").alias("session_id"), F.lit("x").alias("ticker"))
    return rounded(D.migrate_facts(old), "item_value")


_GAIN = s4("CASE WHEN ticker = '^GSPC' AND b_ret <> 0 THEN b_ret ELSE performance END")
_US10Y = s4("(SELECT value FROM ml WHERE symbol = 'DGS10')")

# ---- reports -------------------------------------------------------------------------------------------------------


@query(f"+{SHADOW}, s AS (SELECT account_id, sum(usd) AS cost, sum(usd / bp) * (SELECT arg_max(close, date) FROM benchmark_daily) AS v FROM buys GROUP BY account_id), r AS (SELECT account_id, CASE WHEN cost > 0 THEN (v - cost) / cost * 100 ELSE 0 END AS b_ret FROM s), "
       "p AS (SELECT ticker, (arg_max(close, date) / arg_min(close, date) - 1) * 100 AS performance FROM (SELECT ticker, date, close FROM benchmark_daily UNION ALL SELECT ticker, date, close FROM stock_prices WHERE ticker = 'Brand#1') GROUP BY ticker) "
       f"SELECT account_id, ticker, {_GAIN} AS gain FROM r CROSS JOIN p", "transactions", "stock_prices", "benchmark_daily", "fx_load")  # fmt: skip
def benchmark_table(tx, px, daily, fx):
    now = daily.agg(F.max_by("close", "date").alias("now"))
    shadow = P.shadow_benchmark(tx, _bench(daily), _fx(fx), ["account_id"]).crossJoin(F.broadcast(now))
    value = F.col("shadow_units") * F.col("now")
    ret = shadow.select("account_id", F.when(F.col("shadow_cost") > 0, (value - F.col("shadow_cost")) / F.col("shadow_cost") * 100).otherwise(0.0).alias("b_ret"))
    followed = daily.select("ticker", "date", "close").unionByName(px.where("ticker = 'Brand#1'").select("ticker", "date", "close"))
    perf = followed.groupBy("ticker").agg(((F.max_by("close", "date") / F.min_by("close", "date") - 1) * 100).alias("performance"))
    return rounded(R.benchmark_table(perf, ret), "gain")


@query(f"+{SHADOW}, {POS}, {PX}, {ASSET}, u AS (SELECT account_id, ticker, sum(usd / bp) * (SELECT arg_max(close, date) FROM benchmark_daily) - sum(usd) AS bg FROM buys GROUP BY ALL), "
       "j AS (SELECT a.account_id, market_value, (price - avg_price) * quantity - bg AS d FROM asset a JOIN u ON u.account_id = a.account_id AND u.ticker = a.ticker WHERE asset_type = 'CRYPTO'), "
       "g AS (SELECT account_id, sum(d) AS alpha, sum(market_value - d) AS sv FROM j GROUP BY account_id) "
       f"SELECT account_id, {s4('alpha')} AS alpha, {s4('sv')} AS shadow_value, {s4('CASE WHEN sv > 0 THEN alpha / sv * 100 ELSE 0 END')} AS alpha_pct FROM g", "transactions", "stock_prices", "benchmark_daily", "fx_load")  # fmt: skip
def sleeve_alpha(tx, px, daily, fx):
    now = daily.agg(F.max_by("close", "date").alias("now"))
    shadow = P.shadow_benchmark(tx, _bench(daily), _fx(fx), ["account_id", "ticker"]).crossJoin(F.broadcast(now))
    gains = shadow.select("account_id", "ticker", (F.col("shadow_units") * F.col("now") - F.col("shadow_cost")).alias("benchmark_gain"))
    return rounded(R.sleeve_alpha(_assets(tx, px).join(gains, ["account_id", "ticker"]), "CRYPTO"), "alpha", "shadow_value", "alpha_pct")


@query(f"+{VALUES}, {SHADOW}, u AS (SELECT account_id, sum(usd / bp) AS units FROM buys GROUP BY account_id) SELECT account_id, date, {s4('units * b.close')} AS shadow_value FROM dv JOIN benchmark_daily b USING (date) JOIN u USING (account_id)", "transactions", "stock_prices", "benchmark_daily", "fx_load")
def shadow_daily(tx, px, daily, fx):
    units = P.shadow_benchmark(tx, _bench(daily), _fx(fx), ["account_id"])
    return rounded(R.shadow_daily(_values(tx, px, daily), units, daily), "shadow_value")


_MACRO = "ml AS (SELECT symbol, arg_max(value, struct_pack(a := load_timestamp, b := tiebreak)) AS value FROM macro_load GROUP BY symbol)"


@query(f"+{PX}, {_MACRO} SELECT ticker, {s4('close')} AS close, {_US10Y} AS us10y, CAST(0 AS DOUBLE) AS policy FROM px", "stock_prices", "macro_load")
def attach_macro(px, m):
    latest = S.latest_value(m, "symbol", "value", ["load_timestamp", "tiebreak"])
    return rounded(R.attach_macro(S.latest_value(px, "ticker", "close", ["date"]).select("ticker", "close"), latest, {"us10y": "DGS10", "policy": "NONE"}), "close", "us10y", "policy")


@query(f"+{POS} SELECT account_id, p.ticker, asset_type, p.currency, m.supply, {s4('m.market_cap')} AS market_cap FROM pos p LEFT JOIN crypto_meta m ON m.ticker = p.ticker AND p.asset_type = 'CRYPTO'", "transactions", "crypto_meta")
def attach_crypto_meta(tx, meta):
    out = R.attach_crypto_meta(P.positions(tx), meta)
    return rounded(out.select("account_id", "ticker", "asset_type", "currency", "crypto_metadata.supply", "crypto_metadata.market_cap"), "market_cap")


@query(f"+{POS}, {PX}, {ASSET}, v AS (SELECT account_id, sum(market_value) AS mv FROM asset GROUP BY account_id), f AS (SELECT account_id, coalesce(sum(quantity * price) FILTER (WHERE type = 'BUY'), 0) AS b, coalesce(sum(quantity * price) FILTER (WHERE type IN ('SELL', 'DIVIDEND')), 0) AS s, sum(fee) AS fee FROM transactions GROUP BY account_id) "
       f"SELECT account_id, {s4('(coalesce(mv, 0) + s - b - fee) / nullif(b + fee, 0) * 100')} AS effective_yield FROM f LEFT JOIN v USING (account_id)", "transactions", "stock_prices")  # fmt: skip
def effective_yield(tx, px):
    values = _assets(tx, px).groupBy("account_id").agg(F.sum("market_value").alias("market_value"))
    return rounded(R.effective_yield(tx, values), "effective_yield")


@query("SELECT count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'completed' AND updated_at > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 1 HOUR) AS rate_per_hour, CAST(1825 AS INT) AS total_days, max(target_date) FILTER (WHERE status = 'completed') AS latest_date FROM progress", "progress")
def backfill_progress(p):
    return R.backfill_progress(p, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query("SELECT extract(YEAR FROM date) AS batch, CAST(count(*) AS BIGINT) AS violations, string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers FROM stock_prices WHERE NOT (high >= low + 100) GROUP BY batch", "stock_prices")
def validation_summary(px):
    """Rows that break a stricter rule than the market's, so that there are some: a day's range of 100 or more."""
    bad = px.where("NOT (high >= low + 100)").withColumn("batch", F.year("date").cast("long"))
    return R.validation_summary(bad, "batch")


@query(f"+e AS (SELECT ticker, arg_min(close, date) AS a, arg_max(close, date) AS b, date_diff('day', min(date), max(date)) AS days FROM stock_prices WHERE close IS NOT NULL GROUP BY ticker) SELECT ticker, CASE WHEN days > 0 AND a > 0 THEN {s4('(pow(b / a, 365e0 / days) - 1) * 100')} END AS cagr FROM e", "stock_prices")
def cagr(px):
    return rounded(R.cagr(px, "ticker", "date", "close"), "cagr")


@query(f"SELECT s.ticker, date, {s4('s.close / nullif(b.close, 0)')} AS strength FROM stock_prices s JOIN benchmark_daily b USING (date)", "stock_prices", "benchmark_daily")
def relative_strength(px, daily):
    return rounded(R.relative_strength(px, daily), "strength")


@query("+r AS (SELECT ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM stock_prices), d AS (SELECT ticker, close, max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM stock_prices) "
       f"SELECT t.ticker, {s4('t')} AS total_return, {s4('v')} AS volatility, {s4('m')} AS max_drawdown FROM (SELECT ticker, (arg_max(close, date) / arg_min(close, date) - 1) * 100 AS t FROM stock_prices GROUP BY ticker) t "
       "JOIN (SELECT ticker, stddev_pop(ret) * sqrt(252) * 100 AS v FROM r GROUP BY ticker) v ON v.ticker = t.ticker JOIN (SELECT ticker, min((close - peak) / peak * 100) AS m FROM d GROUP BY ticker) m ON m.ticker = t.ticker", "stock_prices")  # fmt: skip
def index_statistics(px):
    return rounded(R.index_statistics(px, "ticker", "date", "close"), "total_return", "volatility", "max_drawdown")


# ---- allocation ----------------------------------------------------------------------------------------------------


@query(f"+u AS (SELECT account_id, asset, value FROM (SELECT * FROM account_inputs WHERE sp500 > 0 OR us_stock > 0 OR jp_bond > 0 OR btc > 0) UNPIVOT (value FOR asset IN (sp500, us_stock, jp_bond, btc))) SELECT account_id, asset, category, {s4('value')} AS value FROM u JOIN asset_config USING (asset)", "account_inputs", "asset_config")
def asset_results(inputs, config):
    return rounded(A.asset_results(inputs, config), "value")


@query("+o AS (SELECT account_id, 'INDEX' AS category, CAST(0.5 AS DOUBLE) AS ratio FROM account_inputs WHERE account_id % 2 = 0) SELECT a.account_id, t.category, coalesce(o.ratio, t.ratio) AS ratio FROM account_inputs a CROSS JOIN allocation_target t LEFT JOIN o ON o.account_id = a.account_id AND o.category = t.category", "account_inputs", "allocation_target")
def targets(inputs, defaults):
    own = inputs.where("account_id % 2 = 0").select("account_id", F.lit("INDEX").alias("category"), F.lit(0.5).alias("ratio"))
    return A.targets(defaults, own, inputs)


@query(f"+{DRIFT} SELECT h.account_id, 'Asset' AS type, asset AS name, category, {s4('value')} AS value, {s4('value / nullif(t.total, 0) * 100')} AS ratio, CAST(NULL AS DOUBLE) AS target_ratio, CAST(NULL AS VARCHAR) AS status FROM holdings h JOIN (SELECT account_id, max(total) AS total FROM drift GROUP BY account_id) t USING (account_id) "
       f"UNION ALL SELECT account_id, 'Category', category, NULL, {s4('current')}, {s4('coalesce(current / nullif(total, 0), 0) * 100')}, {s4('ratio * 100')}, status FROM drift", "holdings", "allocation_target")  # fmt: skip
def allocation_report(h, t):
    return rounded(R.allocation_report(h, A.category_drift(h, t)), "value", "ratio", "target_ratio")


_YEN = "'¥' || format('{{:,}}', CAST(floor({0} + 0.500001) AS BIGINT))"
_PCT = "printf('%.1f', floor(({0}) * 1000 + 0.500001) / 10) || '%'"
_MD = f"""h AS (SELECT h.account_id, string_agg('| ' || asset || ' | ' || category || ' | ' || {_YEN.format('value')} || ' | ' || {_PCT.format('coalesce(value / nullif(t.total, 0), 0)')} || ' |', chr(10) ORDER BY category, asset) AS assets
    FROM holdings h JOIN (SELECT account_id, max(total) AS total FROM drift GROUP BY account_id) t USING (account_id) GROUP BY h.account_id),
    w AS (SELECT *, sum(value) OVER (PARTITION BY account_id, category) AS sv, count(*) OVER (PARTITION BY account_id, category) AS n FROM holdings),
    parts AS (SELECT w.account_id, w.category, string_agg('- ' || asset || ': ' || {_YEN.format('b.buy * CASE WHEN sv > 0 THEN w.value / sv ELSE 1e0 / n END')}, chr(10) ORDER BY asset) AS lines
    FROM w JOIN buys b ON b.account_id = w.account_id AND b.category = w.category WHERE b.buy > 0 GROUP BY ALL)"""


@query(f"+{DRIFT}, {_MD} SELECT b.account_id, '# Portfolio Rebalance Report' || chr(10) || chr(10) || '- Total: ' || {_YEN.format('max(total)')} || chr(10) || '- Required investment: ' || {_YEN.format('max(new_total - total)')} || chr(10) || '- Currency: JPY' || chr(10) || chr(10) || '| Category | Target | Current | Status |' || chr(10) || '| :--- | :---: | :---: | :---: |' || chr(10) || "
       f"string_agg('| ' || b.category || ' | ' || {_PCT.format('ratio')} || ' | ' || {_PCT.format('coalesce(current / nullif(total, 0), 0)')} || ' | ' || status || ' |', chr(10) ORDER BY b.category) || chr(10) || chr(10) || '| Asset | Category | Value | Share |' || chr(10) || '| :--- | :--- | :---: | :---: |' || chr(10) || max(h.assets) || chr(10) || chr(10) || "
       f"coalesce(string_agg('### ' || b.category || ' (+' || {_YEN.format('buy')} || ')' || coalesce(chr(10) || parts.lines, ''), chr(10) ORDER BY b.category) FILTER (WHERE buy > 0), 'No purchases.') AS markdown "
       "FROM buys b JOIN h ON h.account_id = b.account_id LEFT JOIN parts ON parts.account_id = b.account_id AND parts.category = b.category GROUP BY b.account_id", "holdings", "allocation_target")  # fmt: skip
def allocation_markdown(h, t):
    return R.allocation_markdown(h, t)
