"""Queries over the driver's tables, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import allocation as A
from ..operators import filings as D
from ..operators import portfolio as P
from ..operators import series as S
from .bindings import bound, with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The annual, quarterly and amended forms that are followed.
FORMS = ["030000", "030001", "043000", "043001", "040000", "040001"]
_IN_FORMS = ", ".join(f"'{f}'" for f in FORMS)


def query(sql: str, *tables: str, first: str = ""):
    """Register a function of the bound tables (in this order) as a query with this SQL; ``first``: more tables for the SQL."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[bound(spark, sf_dir, t) for t in tables])

        name = f.__name__.lstrip("_")
        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        ORACLE[name] = with_tables(sql, *tables) if tables else sql
        return run

    return wrap


def s4(x: str) -> str:
    return f"(floor(({x}) * 1e4 + 0.501e0) / 1e4 + 0e0)"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: X.stable4(F.col(c)) for c in columns})


FX = "fx AS (SELECT symbol, arg_max(rate, load_timestamp) AS rate FROM fx_load GROUP BY symbol)"
POS = """pos AS (SELECT * FROM (SELECT account_id, ticker, asset_type, coalesce(currency, 'USD') AS currency,
    sum(CASE WHEN type = 'BUY' THEN quantity END) - coalesce(sum(CASE WHEN type = 'SELL' THEN quantity END), 0) AS quantity,
    sum(CASE WHEN type = 'BUY' THEN quantity * price + fee END) / nullif(sum(CASE WHEN type = 'BUY' THEN quantity END), 0) AS avg_price
    FROM transactions GROUP BY ALL) WHERE quantity > 0)"""
PX = "px AS (SELECT ticker, arg_max(close, date) AS close FROM stock_prices GROUP BY ticker)"
ASSET = """asset AS (SELECT p.*, coalesce(nullif(x.close, 0), p.avg_price) AS price,
    p.quantity * coalesce(nullif(x.close, 0), p.avg_price) AS market_value FROM pos p LEFT JOIN px x USING (ticker))"""


def _fx(load: DataFrame) -> DataFrame:
    return S.latest_value(load, "symbol", "rate", ["load_timestamp"])


def _assets(tx: DataFrame, px: DataFrame) -> DataFrame:
    return P.portfolio_summary(P.attach_price(P.positions(tx), S.latest_value(px, "ticker", "close", ["date"])))


# ---- portfolio -----------------------------------------------------------------------------------------------------


@query(f"+{POS}, {PX}, {ASSET} SELECT account_id, ticker, asset_type, currency, quantity, {s4('price')} AS price, {s4('market_value')} AS market_value, "
       f"{s4('(price - avg_price) * quantity')} AS gain, {s4('coalesce(market_value / nullif(sum(market_value) OVER (PARTITION BY account_id), 0) * 100, 0)')} AS weight FROM asset",
       "transactions", "stock_prices")
def portfolio_value(tx, px):
    """Every held position of every account with its market value, gain and weight: the flagship."""
    return rounded(_assets(tx, px).select("account_id", "ticker", "asset_type", "currency", "quantity", "price", "market_value", "gain", "weight"), "price", "market_value", "gain", "weight")


@query(f"+{POS} SELECT account_id, ticker, asset_type, currency, quantity, {s4('avg_price')} AS avg_price FROM pos", "transactions")
def positions(tx):
    return rounded(P.positions(tx), "avg_price")


@query(f"+{POS}, {PX}, {ASSET}, {FX} SELECT account_id, {s4('sum(market_value * coalesce(nullif(f.rate, 0), 1)) / max(t.rate)')} AS value_jpy "
       "FROM asset a LEFT JOIN fx f ON a.currency = f.symbol CROSS JOIN (SELECT coalesce(nullif(max(rate), 0), 1) AS rate FROM fx WHERE symbol = 'JPY') t GROUP BY account_id",
       "transactions", "stock_prices", "fx_load")
def convert_currency(tx, px, fx):
    out = P.convert_currency(_assets(tx, px), _fx(fx), "market_value", "JPY")
    return rounded(out.groupBy("account_id").agg(F.sum("converted").alias("value_jpy")), "value_jpy")


BENCH = """bench AS (SELECT date, p AS price FROM (SELECT date, (coalesce(open, 0) + coalesce(high, 0) + coalesce(low, 0) + coalesce(close, 0)) / 4 AS p FROM benchmark_daily) WHERE p > 0),
    near AS (SELECT d.day, arg_min(b.price, date_diff('day', b.date, d.day)) AS price FROM (SELECT DISTINCT CAST(timestamp AS DATE) AS day FROM transactions) d
    JOIN bench b ON b.date <= d.day AND date_diff('day', b.date, d.day) <= 5 GROUP BY d.day)"""


def _bench(daily: DataFrame) -> DataFrame:
    return S.ohlc_average(daily).select("date", F.col("avg_price").alias("price"))


@query(f"+{BENCH} SELECT day, {s4('price')} AS price FROM near", "transactions", "benchmark_daily")
def asof_price(tx, daily):
    days = tx.select(F.to_date("timestamp").alias("timestamp")).distinct()
    return rounded(P.asof_price(days, _bench(daily)).select(F.col("timestamp").alias("day"), F.col("asof_price").alias("price")), "price")


SHADOW = f"""{FX}, {BENCH}, buys AS (SELECT t.account_id, t.ticker, quantity * t.price * coalesce(nullif(f.rate, 0), 1) / (SELECT coalesce(nullif(max(rate), 0), 1) FROM fx WHERE symbol = 'USD') AS usd, n.price AS bp
    FROM transactions t JOIN near n ON n.day = CAST(t.timestamp AS DATE) LEFT JOIN fx f ON f.symbol = coalesce(t.currency, 'USD') WHERE t.type = 'BUY')"""


@query(f"+{SHADOW} SELECT account_id, ticker, {s4('sum(usd)')} AS shadow_cost, {s4('sum(usd / bp)')} AS shadow_units FROM buys GROUP BY ALL", "transactions", "benchmark_daily", "fx_load")
def shadow_benchmark(tx, daily, fx):
    return rounded(P.shadow_benchmark(tx, _bench(daily), _fx(fx), ["account_id", "ticker"]), "shadow_cost", "shadow_units")


COST = """avgs AS (SELECT account_id, ticker, sum(quantity * price * coalesce(nullif(f.rate, 0), 1)) / (SELECT coalesce(nullif(max(rate), 0), 1) FROM fx WHERE symbol = 'USD') / sum(quantity) AS unit_cost
    FROM transactions t LEFT JOIN fx f ON f.symbol = coalesce(t.currency, 'USD') WHERE type = 'BUY' GROUP BY ALL),
    basis AS (SELECT p.account_id, sum(p.quantity * a.unit_cost) AS cost_basis FROM (SELECT account_id, ticker, sum(quantity) AS quantity FROM pos GROUP BY ALL) p JOIN avgs a USING (account_id, ticker) GROUP BY p.account_id)"""


@query(f"+{FX}, {POS}, {COST} SELECT account_id, {s4('cost_basis')} AS cost_basis FROM basis", "transactions", "fx_load")
def cost_basis_usd(tx, fx):
    return rounded(P.cost_basis_usd(tx, P.positions(tx), _fx(fx)), "cost_basis")


@query(f"+{SHADOW}, {POS}, {PX}, {ASSET}, {COST}, m AS (SELECT account_id, sum(market_value * coalesce(nullif(f.rate, 0), 1)) AS pmv FROM asset a LEFT JOIN fx f ON f.symbol = a.currency GROUP BY account_id), "
       "s AS (SELECT account_id, sum(usd) AS bcost, sum(usd / bp) * (SELECT arg_max(close, date) FROM benchmark_daily) AS bmv FROM buys GROUP BY account_id), "
       "j AS (SELECT account_id, pmv, cost_basis AS pcost, bmv, bcost, CASE WHEN cost_basis > 0 THEN (pmv - cost_basis) / cost_basis * 100 ELSE 0 END AS p_ret, CASE WHEN bcost > 0 THEN (bmv - bcost) / bcost * 100 ELSE 0 END AS b_ret FROM m JOIN s USING (account_id) JOIN basis USING (account_id)) "
       f"SELECT account_id, {s4('p_ret')} AS p_ret, {s4('b_ret')} AS b_ret, {s4('CASE WHEN bmv > 0 AND pcost > 0 THEN (pmv / bmv - 1) * 100 ELSE p_ret - b_ret END')} AS alpha_pct, {s4('pmv - bmv')} AS alpha_value FROM j",
       "transactions", "stock_prices", "benchmark_daily", "fx_load")
def alpha_metrics(tx, px, daily, fx):
    latest = S.latest_value(px, "ticker", "close", ["date"])
    now = daily.agg(F.max_by("close", "date").alias("now"))
    totals = P.account_totals(tx, latest, _bench(daily), _fx(fx)).crossJoin(F.broadcast(now))
    out = P.alpha_metrics(totals.withColumn("bmv", F.col("units") * F.col("now")))
    return rounded(out.select("account_id", "p_ret", "b_ret", "alpha_pct", "alpha_value"), "p_ret", "b_ret", "alpha_pct", "alpha_value")


@query(f"+{POS}, {PX}, {ASSET} SELECT account_id, ticker, asset_type, currency, {s4('market_value')} AS market_value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY market_value DESC, ticker, asset_type, currency) AS INT) AS rank FROM asset) WHERE rank <= 3", "transactions", "stock_prices")
def top_holdings(tx, px):
    return rounded(P.top_holdings(_assets(tx, px), 3).select("account_id", "ticker", "asset_type", "currency", "market_value", "rank"), "market_value")


@query("SELECT DISTINCT coalesce(currency, 'USD') AS currency FROM transactions UNION SELECT 'USD' UNION SELECT 'JPY'", "transactions")
def currencies_needed(tx):
    return P.currencies_needed(tx, "JPY")


VALUES = f"""{POS}, days AS (SELECT date FROM benchmark_daily ORDER BY date DESC LIMIT 252), dv AS (SELECT account_id, date, sum(quantity * close) AS value FROM (SELECT account_id, ticker, sum(quantity) AS quantity FROM pos GROUP BY ALL)
    JOIN stock_prices USING (ticker) JOIN days USING (date) GROUP BY ALL HAVING sum(quantity * close) > 0),
    rets AS (SELECT * FROM (SELECT account_id, date, value, value / nullif(lag(value) OVER (PARTITION BY account_id ORDER BY date), 0) - 1 AS ret FROM dv) WHERE ret IS NOT NULL)"""


def _values(tx: DataFrame, px: DataFrame, daily: DataFrame) -> DataFrame:
    return P.daily_values(px, P.positions(tx), daily.select("date").orderBy(F.desc("date")).limit(252))


@query(f"+{VALUES} SELECT account_id, date, {s4('value')} AS value FROM dv", "transactions", "stock_prices", "benchmark_daily")
def daily_values(tx, px, daily):
    return rounded(_values(tx, px, daily), "value")


@query(f"+{VALUES}, r AS (SELECT account_id, avg(ret) AS m, stddev_pop(ret) AS s, sqrt(sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) / count(*)) AS d FROM rets GROUP BY account_id) "
       f"SELECT account_id, {s4('s * sqrt(252) * 100')} AS volatility, {s4('CASE WHEN s > 0 THEN (m * 252 - 0.05e0) / (s * sqrt(252)) ELSE 0 END')} AS sharpe, {s4('CASE WHEN d > 0 THEN (m * 252 - 0.05e0) / (d * sqrt(252)) ELSE 9.99 END')} AS sortino FROM r",
       "transactions", "stock_prices", "benchmark_daily")
def risk_metrics(tx, px, daily):
    returns = S.daily_returns(_values(tx, px, daily), ["account_id"], "date", "value")
    return rounded(S.risk_metrics(returns, ["account_id"]), "volatility", "sharpe", "sortino")


@query(f"+{VALUES} SELECT account_id, {s4('min((value - peak) / peak * 100)')} AS max_drawdown FROM (SELECT *, max(value) OVER (PARTITION BY account_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM dv) GROUP BY account_id", "transactions", "stock_prices", "benchmark_daily")
def max_drawdown(tx, px, daily):
    return rounded(S.max_drawdown(_values(tx, px, daily), ["account_id"], "date", "value"), "max_drawdown")


@query("+days AS (SELECT date, close FROM benchmark_daily ORDER BY date DESC LIMIT 252), b AS (SELECT * FROM (SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS ret FROM days) WHERE ret IS NOT NULL), "
       "o AS (SELECT * FROM (SELECT ticker, date, s.close / nullif(lag(s.close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM stock_prices s JOIN days USING (date)) WHERE ret IS NOT NULL), "
       "n AS (SELECT ticker, count(*) AS n FROM o GROUP BY ticker), p AS (SELECT ticker, o.ret AS a, b.ret AS b FROM o JOIN b USING (date)), "
       "g AS (SELECT ticker, count(*) AS k, CASE WHEN var_pop(b) > 0 THEN covar_pop(a, b) / var_pop(b) ELSE 1 END AS beta, CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) ELSE 0 END AS corr FROM p GROUP BY ticker) "
       f"SELECT n.ticker, CASE WHEN n = m AND k = m THEN {s4('beta')} END AS beta, CASE WHEN n = m AND k = m THEN {s4('corr')} END AS corr FROM n LEFT JOIN g ON g.ticker = n.ticker CROSS JOIN (SELECT count(*) AS m FROM b)",
       "stock_prices", "benchmark_daily")
def beta_corr(px, daily):
    """Of each ticker's returns with the benchmark's over its last 252 days; null where their numbers differ."""
    days = daily.select("date", "close").orderBy(F.desc("date")).limit(252)
    bench = S.daily_returns(days.withColumn("all", F.lit(0)), ["all"], "date", "close").select("date", "ret")
    own = S.daily_returns(px.select("ticker", "date", "close").join(days.select("date"), "date"), ["ticker"], "date", "close").select("ticker", "date", "ret")
    return rounded(S.aligned_beta_corr(own, bench, ["ticker"], "date"), "beta", "corr")


# ---- series --------------------------------------------------------------------------------------------------------


@query(f"+k AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY load_timestamp DESC, tiebreak DESC) AS k FROM macro_load) SELECT symbol, date, {s4('value')} AS value, load_timestamp FROM k WHERE k = 1", "macro_load")
def latest_wins(m):
    return rounded(S.latest_wins(m, ["symbol", "date"], ["load_timestamp", "tiebreak"]).select("symbol", "date", "value", "load_timestamp"), "value")


@query(f"+k AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY load_timestamp DESC, tiebreak DESC) AS k FROM macro_load WHERE load_timestamp <= TIMESTAMP '2024-01-15 00:00:00') SELECT symbol, date, {s4('value')} AS value FROM k WHERE k = 1", "macro_load")
def point_in_time(m):
    return rounded(S.point_in_time(m, ["symbol", "date"], ["load_timestamp", "tiebreak"], "load_timestamp", "2024-01-15 00:00:00").select("symbol", "date", "value"), "value")


@query("SELECT symbol, max(date) AS mark FROM fx_load GROUP BY symbol", "fx_load")
def high_water_mark(fx):
    return S.high_water_mark(fx, "symbol", "date")


@query(f"SELECT symbol, {s4('arg_max(rate, load_timestamp)')} AS rate, max(load_timestamp) AS load_timestamp FROM fx_load GROUP BY symbol", "fx_load")
def latest_value(fx):
    return rounded(_fx(fx), "rate")


@query("SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM stock_prices GROUP BY ticker", "stock_prices")
def series_coverage(px):
    return S.series_coverage(px, "ticker", "date")


@query(f"+m AS (SELECT symbol, max(date) AS mark FROM fx_load WHERE date < DATE '2024-01-15' GROUP BY symbol) SELECT f.symbol, f.date, {s4('rate')} AS rate, load_timestamp FROM fx_load f LEFT JOIN m USING (symbol) WHERE mark IS NULL OR f.date >= mark", "fx_load")
def incremental(fx):
    return rounded(S.incremental(fx, fx.where("date < DATE'2024-01-15'"), "symbol", "date"), "rate")


@query(f"SELECT symbol, date, CASE WHEN symbol IN ('JPY', 'CNY') THEN {s4('1e0 / nullif(rate, 0)')} ELSE {s4('rate')} END AS rate, load_timestamp FROM fx_load WHERE date >= DATE '2024-01-10'", "fx_load")
def normalize_fx(fx):
    inverse = fx.sparkSession.createDataFrame([("JPY",), ("CNY",)], "symbol string")
    return rounded(S.normalize_fx(fx, inverse, "2024-01-10").select("symbol", "date", "rate", "load_timestamp"), "rate")


@query(f"+k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM stock_prices) SELECT ticker, date, {s4('close')} AS close FROM k WHERE k <= 260", "stock_prices")
def last_n(px):
    return rounded(S.last_n(px, ["ticker"], [F.desc("date")], 260).select("ticker", "date", "close"), "close")


@query(f"+r AS (SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM stock_prices) SELECT ticker, date, {s4('ret')} AS ret FROM r WHERE ret IS NOT NULL", "stock_prices")
def daily_returns(px):
    return rounded(S.daily_returns(px, ["ticker"], "date", "close").select("ticker", "date", "ret"), "ret")


@query(f"+r AS (SELECT ticker, date, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM stock_prices) SELECT ticker, date, {s4('(close - prev) / nullif(prev, 0)')} AS change FROM r WHERE abs((close - prev) / nullif(prev, 0)) > 0.5", "stock_prices")
def price_spikes(px):
    return rounded(S.price_spikes(px, "ticker", "date", "close").select("ticker", "date", "change"), "change")


@query("+h AS (SELECT *, md5(concat('sector:', sector, '|', CASE WHEN industry IS NOT NULL THEN concat('industry:', industry, '|') ELSE '' END)) AS hash FROM profile_snapshots), p AS (SELECT *, lag(hash) OVER (PARTITION BY ticker ORDER BY snapshot_at, tiebreak) AS prev FROM h) "
       "SELECT ticker, snapshot_at, hash, lead(snapshot_at) OVER (PARTITION BY ticker ORDER BY snapshot_at, tiebreak) AS valid_to FROM p WHERE prev IS NULL OR prev <> hash", "profile_snapshots")  # fmt: skip
def profile_history(snap):
    hashed = snap.withColumn("hash", X.profile_hash("sector", "industry"))
    return S.profile_history(hashed, "ticker", ["snapshot_at", "tiebreak"], "hash").select("ticker", "snapshot_at", "hash", "valid_to")


@query("SELECT ticker, count(*) AS n FROM stock_prices WHERE high >= low AND open BETWEEN low - 1e-6 AND high + 1e-6 AND close BETWEEN low - 1e-6 AND high + 1e-6 AND least(open, high, low, close) >= 0 AND volume >= 0 GROUP BY ticker", "stock_prices")
def validate_ohlc(px):
    return S.validate_ohlc(px)[0].groupBy("ticker").agg(F.count("*").alias("n"))


@query(f"SELECT ticker, date, {s4('(open + high + low + close) / 4')} AS avg_price FROM stock_prices WHERE open + high + low + close > 0", "stock_prices")
def ohlc_average(px):
    return rounded(S.ohlc_average(px).select("ticker", "date", "avg_price"), "avg_price")


@query(f"+k AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY load_timestamp DESC, tiebreak DESC) AS k FROM macro_load), a AS (SELECT date, max(CASE WHEN symbol = 'DGS10' THEN value END) AS l, max(CASE WHEN symbol = 'DFF' THEN value END) AS s FROM k WHERE k = 1 GROUP BY date) SELECT date, {s4('l - s')} AS spread, l < s AS inverted FROM a WHERE l IS NOT NULL AND s IS NOT NULL", "macro_load")
def yield_spread(m):
    return rounded(S.yield_spread(S.latest_wins(m, ["symbol", "date"], ["load_timestamp", "tiebreak"]), "date", "DGS10", "DFF"), "spread")


@query("+y AS (SELECT *, date >= DATE '1998-06-30' - 365 AS y, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM stock_prices WHERE close IS NOT NULL AND date <= DATE '1998-06-30'), "
       "g AS (SELECT ticker, count(*) FILTER (WHERE y) AS n, arg_min(close, date) FILTER (WHERE y) AS y0, arg_max(close, date) FILTER (WHERE y) AS y1, arg_min(close, date) FILTER (WHERE k <= 260) AS r0, arg_max(close, date) FILTER (WHERE k <= 260) AS r1 FROM y GROUP BY ticker) "
       f"SELECT ticker, {s4('CASE WHEN n >= 2 THEN coalesce((y1 / nullif(y0, 0) - 1) * 100, 0) ELSE coalesce((r1 / nullif(r0, 0) - 1) * 100, 0) END')} AS performance FROM g", "stock_prices")  # fmt: skip
def benchmark_performance(px):
    return rounded(S.benchmark_performance(px.where("date <= DATE'1998-06-30'"), "ticker", "date", "close", "1998-06-30"), "performance")


# ---- allocation ----------------------------------------------------------------------------------------------------

DRIFT = """s AS (SELECT account_id, category, sum(value) AS current FROM holdings GROUP BY ALL), g AS (SELECT a.account_id, t.category, t.ratio, coalesce(s.current, 0) AS current FROM (SELECT DISTINCT account_id FROM s) a CROSS JOIN allocation_target t LEFT JOIN s ON s.account_id = a.account_id AND s.category = t.category),
    d AS (SELECT *, sum(current) OVER (PARTITION BY account_id) AS total FROM g), e AS (SELECT *, total * ratio AS target, coalesce(current / nullif(total, 0), 0) - ratio AS drift_ratio FROM d),
    drift AS (SELECT *, CASE WHEN drift_ratio > 0.02 THEN 'OVER' WHEN drift_ratio < -0.02 THEN 'UNDER' ELSE 'OK' END AS status FROM e),
    plan AS (SELECT *, greatest(coalesce(max(CASE WHEN category <> 'CASH' AND ratio > 0 THEN current / ratio END) OVER (PARTITION BY account_id), 0), total) AS new_total FROM drift),
    buys AS (SELECT *, CASE WHEN new_total * ratio - current > 0.01 THEN new_total * ratio - current ELSE 0 END AS buy FROM plan)"""


@query(f"+{DRIFT} SELECT account_id, category, {s4('current')} AS current, {s4('target')} AS target, {s4('drift_ratio')} AS drift_ratio, status FROM drift", "holdings", "allocation_target")
def category_drift(h, t):
    return rounded(A.category_drift(h, t).select("account_id", "category", "current", "target", "drift_ratio", "status"), "current", "target", "drift_ratio")


@query(f"+{DRIFT} SELECT account_id, count(*) FILTER (WHERE status = 'OK') AS ok, count(*) FILTER (WHERE status = 'OVER') AS over, count(*) FILTER (WHERE status = 'UNDER') AS under FROM drift GROUP BY account_id", "holdings", "allocation_target")
def drift_counts(h, t):
    return A.drift_counts(A.category_drift(h, t))


@query(f"+{DRIFT} SELECT account_id, category, {s4('new_total')} AS new_total, {s4('new_total - total')} AS investment, {s4('buy')} AS buy FROM buys", "holdings", "allocation_target")
def rebalance_plan(h, t):
    return rounded(A.rebalance_plan(A.category_drift(h, t)).select("account_id", "category", "new_total", "investment", "buy"), "new_total", "investment", "buy")


@query(f"+{DRIFT}, w AS (SELECT *, sum(value) OVER (PARTITION BY account_id, category) AS sv, count(*) OVER (PARTITION BY account_id, category) AS n FROM holdings) SELECT w.account_id, w.category, w.asset, {s4('b.buy * CASE WHEN sv > 0 THEN w.value / sv ELSE 1e0 / n END')} AS asset_buy FROM w JOIN buys b ON b.account_id = w.account_id AND b.category = w.category WHERE b.buy > 0", "holdings", "allocation_target")
def split_buys(h, t):
    plan = A.rebalance_plan(A.category_drift(h, t))
    return rounded(A.split_buys(plan, h).select("account_id", "category", "asset", "asset_buy"), "asset_buy")


# ---- filings -------------------------------------------------------------------------------------------------------


@query("SELECT f.doc_id FROM filings f WHERE NOT EXISTS (SELECT 1 FROM facts_present x WHERE x.doc_id = f.doc_id)", "filings", "facts_present")
def filings_missing_facts(f, facts):
    return D.missing(f, facts, ["doc_id"]).select("doc_id")


@query(f"SELECT f.doc_id, n.doc_id IS NOT NULL AS has_narratives, x.doc_id IS NOT NULL AS has_facts FROM filings f LEFT JOIN narratives_present n ON n.doc_id = f.doc_id LEFT JOIN facts_present x ON x.doc_id = f.doc_id WHERE form_code IN ({_IN_FORMS}) AND (n.doc_id IS NULL OR x.doc_id IS NULL)", "filings", "narratives_present", "facts_present")
def incomplete_filings(f, n, x):
    return D.incomplete_filings(f, n, x, FORMS).select("doc_id", "has_narratives", "has_facts")


@query("SELECT doc_id FROM filings WHERE doc_id NOT IN (SELECT doc_id FROM facts_present) AND doc_id NOT IN (SELECT doc_id FROM narratives_present WHERE doc_id % 3 = 0)", "filings", "facts_present", "narratives_present")
def pending_documents(f, done, log):
    status = log.withColumn("status", F.when(F.col("doc_id") % 3 == 0, "SUCCESS").otherwise("FAILED"))
    return D.pending_documents(f, done, status).select("doc_id")


@query("SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '1998-08-02' - 1824, DATE '1998-08-02', INTERVAL 1 DAY) t(d) WHERE CAST(d AS DATE) NOT IN (SELECT date FROM benchmark_daily)", "benchmark_daily")
def missing_dates(daily):
    return D.missing_dates(daily, "1998-08-02", 1825)


@query("SELECT edinet_code, count(*) AS n, max(doc_id) AS latest, CAST(grouping(edinet_code) AS INT) AS is_total FROM filings GROUP BY ROLLUP (edinet_code)", "filings")
def filing_stats(f):
    return D.filing_stats(f, "edinet_code", "doc_id")


@query("SELECT doc_id, edinet_code, sec_code, form_code FROM filings WHERE edinet_code = 'src1' AND sec_code LIKE '%e%' AND form_code = '030001' ORDER BY doc_id DESC LIMIT 1000", "filings")
def search_filings(f):
    """The newest thousand matches: a top-n by contract."""
    return D.search_filings(f, code="src1", name="e", form="030001").select("doc_id", "edinet_code", "sec_code", "form_code")


@query("+u AS (SELECT DISTINCT code, fiscal_period, disclosed_date, l_quantity, l_extendedprice, l_discount, l_returnflag FROM facts_wide), "
       "t AS (SELECT code, fiscal_period, disclosed_date, tag, value FROM (SELECT code, fiscal_period, disclosed_date, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_discount AS DOUBLE) AS l_discount FROM u) UNPIVOT (value FOR tag IN (l_quantity, l_extendedprice, l_discount))) "
       f"SELECT code, fiscal_period, disclosed_date, tag, {s4('value')} AS value, md5(concat_ws('|', code, fiscal_period, disclosed_date, tag)) AS fact_id FROM t", "facts_wide")  # fmt: skip
def melt_facts(wide):
    return rounded(D.melt_facts(wide.distinct(), ["code", "fiscal_period", "disclosed_date"]), "value")


@query(f"+b AS (SELECT symbol, date, arg_max(rate, load_timestamp) + 1 AS rate FROM fx_load WHERE date >= DATE '2024-01-10' GROUP BY ALL), t AS (SELECT symbol, date, arg_max(rate, load_timestamp) AS rate FROM fx_load WHERE date <= DATE '2024-01-15' GROUP BY ALL) SELECT symbol, date, {s4('rate')} AS rate FROM b UNION ALL SELECT symbol, date, {s4('rate')} FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = t.symbol AND b.date = t.date)", "fx_load")
def upsert(fx):
    one = S.latest_wins(fx, ["symbol", "date"], ["load_timestamp"]).select("symbol", "date", "rate")
    old = S.latest_wins(fx.where("date <= DATE'2024-01-15'"), ["symbol", "date"], ["load_timestamp"]).select("symbol", "date", "rate")
    batch = one.where("date >= DATE'2024-01-10'").withColumn("rate", F.col("rate") + 1)
    return rounded(D.upsert(old, batch, ["symbol", "date"]), "rate")


@query(f"+t AS (SELECT symbol, date, arg_max(rate, load_timestamp) AS rate FROM fx_load WHERE date <= DATE '2024-01-15' GROUP BY ALL), b AS (SELECT symbol, date, arg_max(rate, load_timestamp) AS rate FROM fx_load GROUP BY ALL) SELECT symbol, date, {s4('rate')} AS rate FROM t UNION ALL SELECT symbol, date, {s4('rate')} FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE b.symbol = t.symbol AND b.date = t.date)", "fx_load")
def insert_ignore(fx):
    one = S.latest_wins(fx, ["symbol", "date"], ["load_timestamp"]).select("symbol", "date", "rate")
    old = S.latest_wins(fx.where("date <= DATE'2024-01-15'"), ["symbol", "date"], ["load_timestamp"]).select("symbol", "date", "rate")
    return rounded(D.insert_ignore(old, one, ["symbol", "date"]), "rate")


@query("SELECT ticker, count(*) - 1 AS retry_count, arg_max(sector, struct_pack(a := snapshot_at, b := tiebreak)) AS status FROM profile_snapshots GROUP BY ticker", "profile_snapshots")
def ingestion_state(snap):
    return D.ingestion_state(snap.withColumnRenamed("sector", "status"), "ticker", ["snapshot_at", "tiebreak"])


@query("SELECT CAST(count(*) FILTER (WHERE n_chars > 100 AND form_code IS NOT NULL) AS BIGINT) AS ok, CAST(count(*) FILTER (WHERE NOT coalesce(n_chars > 100 AND form_code IS NOT NULL, false)) AS BIGINT) AS rejected FROM filings", "filings")
def apply_contract(f):
    ok, bad = D.apply_contract(f, {"size": "n_chars > 100", "form": "form_code IS NOT NULL"})
    return ok.agg(F.count("*").alias("ok")).crossJoin(bad.agg(F.count("*").alias("rejected")))
