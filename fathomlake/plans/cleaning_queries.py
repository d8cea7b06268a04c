"""Queries of the column helpers over the driver's tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import series as S
from ..sources.lake import json_field as field
from .queries import query, rounded, s4


@query(f"SELECT CAST(load_timestamp AS DATE) AS date, {s4('value')} AS open, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS low, CASE WHEN value > 5 THEN {s4('value')} END AS close, CASE WHEN value > 5 THEN tiebreak ELSE 0 END AS volume, 'DGS10' AS ticker, 'lake' AS source, load_timestamp FROM macro_load WHERE symbol = 'DGS10'", "macro_load")
def enforce_ohlcv(m):
    good = F.col("value") > 5
    raw = m.where("symbol = 'DGS10'").select(F.col("load_timestamp").alias("date"), F.col("value").alias("open"), F.when(good, F.col("value").cast("string")).otherwise("invalid").alias("close"), F.when(good, F.col("tiebreak").cast("string")).alias("volume"), "load_timestamp")
    out = S.enforce_ohlcv(raw, "lake", "DGS10", F.col("load_timestamp"))
    return rounded(out.withColumns({c: F.col(c).cast("decimal(12,6)").cast("double") for c in ("open", "high", "low", "close")}), "open", "close")


@query("SELECT doc_id, edinet_code AS filer_code, form_code FROM filings", "filings")
def snake_columns(f):
    return X.snake_columns(f.select(F.col("doc_id").alias(" Doc ID "), F.col("edinet_code").alias("Filer Code"), F.col("form_code").alias("Form Code")))


@query("SELECT doc_id, coalesce(form_code, sec_code) AS code FROM filings", "filings")
def pick_column(f):
    return f.select("doc_id", X.pick_column(f, ["absent", "form_code", "sec_code"]).alias("code"))


@query("+c AS (SELECT doc_id, ' ' || CAST(doc_id + 12300 AS VARCHAR) || ' ' AS raw FROM filings) SELECT doc_id, CASE WHEN length(trim(raw)) = 5 AND trim(raw) LIKE '%0' THEN substr(trim(raw), 1, 4) ELSE trim(raw) END AS code, CASE WHEN length(trim(raw)) = 5 AND trim(raw) LIKE '%0' THEN substr(trim(raw), 1, 4) ELSE trim(raw) END || '.T' AS ticker FROM c", "filings")
def normalize_jp_code(f):
    raw = F.concat(F.lit(" "), (F.col("doc_id") + 12300).cast("string"), F.lit(" "))
    return f.select("doc_id", X.normalize_jp_code(raw).alias("code"), X.normalize_jp_code(raw, ".T").alias("ticker"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE upper(edinet_code) END AS ticker, CASE WHEN doc_id % 3 = 0 THEN 'index' WHEN sec_code = 'de' THEN 'crypto' ELSE 'stock' END AS source FROM filings", "filings")
def standardize_ticker(f):
    raw = F.concat(F.lit(" "), "edinet_code", F.when(F.col("doc_id") % 5 == 0, "!").otherwise("-usd"), F.lit(" "))
    marked = F.concat(F.when(F.col("doc_id") % 3 == 0, "^").otherwise(""), "edinet_code")
    return f.select("doc_id", X.standardize_ticker(raw).alias("ticker"), X.route_source(marked, F.when(F.col("sec_code") == "de", "CRYPTO").otherwise("STOCK")).alias("source"))


@query("SELECT symbol, date, CASE WHEN tiebreak % 4 > 1 THEN tiebreak END AS mark FROM macro_load", "macro_load")
def clean_nonfinite(m):
    k = F.col("tiebreak") % 4
    mark = F.when(k == 0, float("nan")).when(k == 1, float("-inf")).otherwise(F.col("tiebreak").cast("double"))
    return X.clean_nonfinite(m.select("symbol", "date", mark.alias("mark"))).withColumn("mark", F.col("mark").cast("long"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN form_code END AS form_code FROM filings", "filings")
def empty_to_null(f):
    return X.empty_to_null(f.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("form_code")).otherwise("").alias("form_code")))


@query("SELECT doc_id, edinet_code || chr(9) || sec_code AS text FROM filings", "filings")
def strip_nonprintable(f):
    return f.select("doc_id", X.strip_nonprintable(F.concat("edinet_code", F.lit("\x07\t​"), "sec_code")).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE n_chars * 1000e0 END AS value FROM filings", "filings")
def parse_number(f):
    """Numbers with separators; a dash is none."""
    text = F.when(F.col("doc_id") % 4 == 0, "-").otherwise(F.format_number(F.col("n_chars") * 1000, 0))
    return f.select("doc_id", X.parse_number(F.concat(F.lit(" "), text)).alias("value"))


@query(r"SELECT doc_id, CASE tag WHEN 'BusinessRisksTextBlock' THEN 'business_risk' WHEN 'ManagementPolicyBusinessEnvironmentIssuesToAddressTextBlock' THEN 'management_policy' WHEN 'ResearchAndDevelopmentActivitiesTextBlock' THEN 'research_development' "
       r"WHEN 'AnalysisOfFinancialPositionOperatingResultsAndCashFlowsTextBlock' THEN 'mda' ELSE lower(regexp_replace(regexp_replace(regexp_replace(tag, 'TextBlock$', ''), '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) END AS section FROM tags", "tags")  # fmt: skip
def normalize_section(t):
    return t.select("doc_id", X.normalize_section(F.col("tag")).alias("section"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^[ \t]+|[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM texts", "texts")
def clean_text(t):
    return t.select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("digest"))


@query("SELECT user_ts AS at, CAST(user_ts AS DATE) AS day, CAST(user_ts AS DATE) AS zoned FROM (SELECT load_timestamp AS user_ts FROM fx_load)", "fx_load")
def to_day(fx):
    """Of a time, and of an ISO text with a zone, which is dropped."""
    zoned = F.concat(F.date_format("load_timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))
    return fx.select(F.col("load_timestamp").alias("at"), X.to_day(F.col("load_timestamp")).alias("day"), X.to_day(zoned).alias("zoned"))


@query("SELECT doc_id, '000' || CAST(doc_id AS VARCHAR) || '24' AS accession, lpad(CAST(doc_id AS VARCHAR), 10, '0') AS cik FROM filings", "filings")
def accession(f):
    path = F.concat(F.lit("edgar/data/7/000-"), F.col("doc_id").cast("string"), F.lit("-24.txt"))
    return f.select("doc_id", X.accession(path).alias("accession"), X.zero_pad(F.col("doc_id").cast("string")).alias("cik"))


@query("SELECT account_id, ticker, CASE currency WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'JPY' THEN '¥' WHEN 'CNY' THEN '¥' END AS symbol FROM transactions", "transactions")
def currency_symbol(tx):
    return tx.select("account_id", "ticker", X.currency_symbol(F.col("currency")).alias("symbol"))


@query("SELECT doc_id, edinet_code AS code, CAST(n_chars AS VARCHAR) AS size, CAST(NULL AS VARCHAR) AS none FROM filings", "filings")
def json_field(f):
    info = f.select("doc_id", F.to_json(F.struct(F.struct("edinet_code").alias("data"), "n_chars")).alias("info"))
    return info.select("doc_id", field("info", "$.data.edinet_code").alias("code"), field("info", "$.n_chars").alias("size"), field("info", "$.x").alias("none"))
